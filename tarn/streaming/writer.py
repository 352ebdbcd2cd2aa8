"""Micro-batches into lake tables, and event-time windows over streams of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


class StreamWriter:
    """Buffers frames and appends them as one batch at ``flush_threshold`` rows; closing flushes, and compacts after more than one flush."""

    def __init__(self, lake, table: str, schema: str = "main", flush_threshold: int = 10_000, compact_on_close: bool = True, schema_evolution: str = "strict"):
        self.lake, self.table, self.schema, self.threshold, self.compact, self.evolution = lake, table, schema, flush_threshold, compact_on_close, schema_evolution
        self.buffer: list[DataFrame] = []
        self.buffer_rows = self.flush_count = self._flushed = 0

    @property
    def total_rows(self) -> int:
        return self._flushed + self.buffer_rows

    def append(self, df: DataFrame) -> None:
        df = df.persist()  # computed once, for the count and for the flush
        n = df.count()
        if not n:
            df.unpersist()
        else:
            self.buffer.append(df)
            self.buffer_rows += n
            if self.buffer_rows >= self.threshold:
                self.flush()

    def flush(self) -> None:
        if not self.buffer:
            return
        rows = self.buffer[0]
        for b in self.buffer[1:]:
            rows = rows.unionByName(b, allowMissingColumns=self.evolution == "merge")
        self.lake.write(rows, self.table, "append", self.schema, self.evolution)
        self._flushed += self.buffer_rows
        self.flush_count += 1
        self._empty()

    def _empty(self) -> None:
        for b in self.buffer:
            b.unpersist()
        self.buffer, self.buffer_rows = [], 0

    def close(self) -> None:
        self.flush()
        if self.compact and self.flush_count > 1:
            self.lake.rewrite_data_files(self.table, self.schema)

    def __enter__(self) -> StreamWriter:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.close()
        else:
            self._empty()


def batch_sink(lake, table: str, query: str, schema: str = "main") -> Callable[[DataFrame, int], None]:
    """For ``writeStream.foreachBatch``: each batch is committed once, however often it is delivered. The commit notes the last
    batch of each query beside the snapshots, so that their expiry does not forget it. Empty batches are not noted."""

    def commit(df: DataFrame, batch_id: int) -> None:
        if lake.catalog.progress(query) >= batch_id or df.isEmpty():
            return
        if not lake.exists(table, schema):
            lake.create_table(table, df.schema, schema)
        lake.insert(df, table, schema, batch=(query, batch_id))

    return commit
