"""The change feed in batches, each processed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


class ChangeReader:
    """Hands a table's changes to a function, in batches of whole snapshots: ``process(f)`` calls f(changes, batch) for what has come since
    the last call, where ``batch`` is the last snapshot in it. Progress is kept in the catalog under ``query``, so that another reader of
    that name goes on there; a batch whose function fails comes again. The batches are lazy DataFrames, read by the executors."""

    def __init__(self, lake, table: str, query: str, schema: str = "main", start: int = 0):
        self.lake, self.table, self.query, self.schema, self.start = lake, table, query, schema, start

    @property
    def offset(self) -> int:
        """The last snapshot that has been processed."""
        return max(self.start, self.lake.catalog.progress(f"read {self.query}"))

    def process(self, run: Callable[[DataFrame, int], None], upto: int | None = None) -> int:
        """Process all changes up to a snapshot (by default the current one); returns the last one processed."""
        to = self.lake.current_snapshot() if upto is None else upto
        if to > self.offset:
            run(self.lake.changes(self.table, self.offset, to, self.schema), to)
            self.lake.catalog.note_progress(f"read {self.query}", to)
        return self.offset
