"""Insert, overwrite, delete, update, merge, add files. Every call is one snapshot; a call that changes nothing makes none.

Messages of argument errors are fixed values.
"""

from __future__ import annotations

import uuid
from collections import Counter
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.types import pack_value
from ..plans.scan import VISIBLE, Scanner, TableAt, place, quoted
from . import files as FILES


def condition(x: str | Column | None) -> Column:
    return F.lit(True) if x is None else F.expr(x) if isinstance(x, str) else x


def value(x) -> Column:
    """An update's value: a Column, an expression as ``expr:...`` text via ``lake.expr``, or a literal."""
    return x if isinstance(x, Column) else F.lit(x)


def same(keys: list[str], left: str, right: str) -> Column:
    out = None
    for k in keys:
        c = F.col(f"{left}.{quoted(k)}").eqNullSafe(F.col(f"{right}.{quoted(k)}"))
        out = c if out is None else out & c
    return out


class Dml:
    def write(self, df: DataFrame, name: str, mode: str = "error", schema: str = "main", schema_evolution: str = "strict", inline_limit: int = 0, author: str | None = None, message: str | None = None, **retry) -> None:
        """mode error (fail if the table exists), append or overwrite (create it if absent: a snapshot of its own)."""
        if mode not in ("error", "append", "overwrite"):
            raise ValueError(f"Invalid mode: {mode}")
        exists = self.exists(name, schema)
        if exists and mode == "error":
            raise ValueError(f"Table '{schema}.{name}' already exists")
        if not exists:
            self.create_table(name, df.schema, schema)
        elif schema_evolution == "merge":
            known = {c.name.lower() for c in self.at(name, schema).columns}
            for f in df.schema.fields:
                if f.name.lower() not in known:
                    self.add_column(name, f.name, f.dataType, schema=schema)
        elif schema_evolution != "strict":
            raise ValueError(f"Invalid schema_evolution: {schema_evolution}")
        if mode == "overwrite" and exists:
            self.overwrite(df, name, schema, author=author, message=message, **retry)
        elif exists or not df.isEmpty():
            if not df.isEmpty():
                self.insert(df, name, schema, inline_limit, author, message, **retry)

    def insert(self, df: DataFrame, name: str, schema: str = "main", inline_limit: int = 0, author=None, message=None, batch: tuple[str, int] | None = None, **retry) -> int:
        """With ``batch`` (a streaming query's name and the batch's number), nothing happens if that batch is there already."""
        asked = inline_limit

        def run() -> int:
            t = self.at(name, schema)
            rows = FILES.fitted(df, t)
            inline_limit = asked or int(self.option("data_inlining_row_limit", t) or 0)
            if inline_limit > 0 and self._inlined_count(t) < inline_limit:
                few = rows.limit(inline_limit - self._inlined_count(t) + 1).collect()
                if not few:
                    raise ValueError("Cannot insert empty DataFrame")
                if self._inlined_count(t) + len(few) <= inline_limit:
                    with self.catalog.transaction("insert", t.id, t.snapshot, author, message) as tx:
                        if not batch or tx.advance(*batch):
                            self._inline(tx, t, few)
                            tx.changes.append(f"inserted_into_table:{t.id}")
                            tx.extra = batch and f"{batch[0]}:{batch[1]}"
                    return tx.snapshot
            new = FILES.write_files(self, t, rows)
            if not new:
                raise ValueError("Cannot insert empty DataFrame")
            with self.catalog.transaction("insert", t.id, t.snapshot, author, message) as tx:
                if not batch or tx.advance(*batch):
                    FILES.register(tx, t, new)
                    tx.changes.append(f"inserted_into_table:{t.id}")
                    tx.extra = batch and f"{batch[0]}:{batch[1]}"
            return tx.snapshot

        return self.retrying(run, **retry)

    def create_table_as(self, df: DataFrame, name: str, schema: str = "main", author=None, message=None) -> int:
        """Table and rows in one snapshot."""
        if self.exists(name, schema):
            raise ValueError(f"Table '{schema}.{name}' already exists")

        def run() -> int:
            started = self.catalog.head()
            nodes = FILES.columns_of(df.schema)
            folder = self.schema_folder(schema) + f"{name}/"
            self._number(nodes)
            t = TableAt(-1, name, schema, folder, started, nodes)
            new = FILES.write_files(self, t, df)
            with self.catalog.transaction("ddl", None, started, author, message) as tx:
                t.id = self._create(tx, name, schema, nodes)
                if new:
                    FILES.register(tx, t, new)
                    tx.changes.append(f"inserted_into_table:{t.id}")
            return tx.snapshot

        return self.retrying(run)

    def overwrite(self, df: DataFrame, name: str, schema: str = "main", author=None, message=None, **retry) -> int:
        def run() -> int:
            t = self.at(name, schema)
            new = FILES.write_files(self, t, FILES.fitted(df, t))
            with self.catalog.transaction("overwrite", t.id, t.snapshot, author, message) as tx:
                self._end_rows(tx, t)
                tx.run("DELETE FROM {table_column_stats} WHERE table_id = ?", t.id)
                tx.run("UPDATE {table_stats} SET record_count = 0, file_size_bytes = 0 WHERE table_id = ?", t.id)
                FILES.register(tx, t, new)
                tx.changes += [f"deleted_from_table:{t.id}"] + [f"inserted_into_table:{t.id}"] * bool(new)
            return tx.snapshot

        return self.retrying(run, **retry)

    def truncate(self, name: str, schema: str = "main") -> int:
        return self.overwrite(self.spark.createDataFrame([], self.at(name, schema).spark_schema()), name, schema)

    def add_files(self, name: str, paths: list[str], schema: str = "main", **retry) -> int:
        """Register existing Parquet files as they are; every footer must have the table's columns, by name and type."""
        if not paths:
            raise ValueError("file_paths must not be empty")

        def run() -> int:
            t = self.at(name, schema)
            new = []
            names = {c.id: c.name for c in t.columns}
            sizes = {f: dict(FILES.listing(self, f)) for f in {p.removeprefix("file://").rsplit("/", 1)[0] for p in paths}}
            if bad := [p for p in paths if p.rsplit("/", 1)[-1][:1] in "_."]:
                raise ValueError(f"Spark does not read files whose names begin with _ or . ({bad[0]})")
            with ThreadPoolExecutor(8) as pool:
                schemas = list(pool.map(lambda p: self.spark.read.parquet(p).schema, paths))
            for p, got in zip(paths, schemas, strict=True):
                want = {c.name: c.spark().simpleString() for c in t.columns}
                have = {f.name: f.dataType.simpleString() for f in got.fields}
                if want != have:
                    raise ValueError(f"Schema mismatch: {p} has {have}, the table {want}")
                local = p.removeprefix("file://")
                size = sizes[local.rsplit("/", 1)[0]].get(local, 0)
                new.append({"path": local, "relative": False, "bytes": size, "values": []})
            known = FILES.footers(self, {f["path"]: f["bytes"] for f in new}, t.columns, ours=False)
            new = [f | known[place(f["path"])] for f in new]
            with self.catalog.transaction("insert", t.id, t.snapshot) as tx:
                mapping = tx.catalog_id()
                tx.insert("column_mapping", mapping_id=mapping, table_id=t.id, type="map_by_name")
                tx.insert_many("name_mapping", [{"mapping_id": mapping, "column_id": i, "source_name": n, "target_field_id": i, "is_partition": 0} for i, n in names.items()])
                FILES.register(tx, t, new, mapping=mapping, partition_id=None)
                tx.changes.append(f"inserted_into_table:{t.id}")
            return tx.snapshot

        return self.retrying(run, **retry)

    @contextmanager
    def staged(self, df: DataFrame, t: TableAt):
        """A copy of ``df`` that stays the same however often it is read, in the shared store."""
        path = self.new_folder(t.folder, f".staging-{uuid.uuid4().hex}")
        df.write.parquet(path)
        try:
            yield self.spark.read.schema(df.schema).parquet(path)
        finally:
            self.remove(path)

    def delete(self, name: str, where: str | Column, schema: str = "main", author=None, message=None, **retry) -> int:
        """Rows for which the predicate is true go; returns how many."""

        def run() -> int:
            t = self.at(name, schema)
            scanner = Scanner(self, t)
            hit = self._hits(scanner, where).select("_fid", "_pos")
            if (files := self._at_once(scanner, where)) is not None:
                deletes = FILES.write_deletes(self, scanner, hit, None, files)
                if deletes:
                    self._commit_change(t, deletes, [], [], "delete", author, message)
                return sum(d["new"] for d in deletes.values())
            with self.staged(hit, t) as positions:
                counts = {i: n for i, (n,) in FILES.touched(positions).items()}
                if counts:
                    self._commit_change(t, FILES.write_deletes(self, scanner, positions, counts), self._inline_hits(positions, counts), [], "delete", author, message)
            return sum(counts.values())

        return self.retrying(run, **retry)

    def update(self, name: str, updates: dict, where: str | Column | None = None, schema: str = "main", author=None, message=None, **retry) -> int:
        """Set columns (values or Columns; earlier assignments are visible to later ones) where the predicate is true."""

        def run() -> int:
            t = self.at(name, schema)
            scanner = Scanner(self, t)
            with self.staged(self._hits(scanner, where), t) as rows:
                files = self._at_once(scanner, where)
                counts = None if files is not None else {i: n for i, (n,) in FILES.touched(rows).items()}
                if counts == {}:
                    return 0
                new, deletes = self.together(lambda: FILES.write_files(self, t, self._assigned(rows, t, updates)), lambda: FILES.write_deletes(self, scanner, rows, counts, files))
                if new:
                    self._commit_change(t, deletes, self._inline_hits(rows, counts or {}), new, "update", author, message)
            return sum(f["rows"] for f in new)

        return self.retrying(run, **retry)

    def merge(self, name: str, source: DataFrame, on: str | list[str], when_matched_update=None, when_matched_delete: bool = False, when_not_matched_insert: bool = True, when_not_matched_by_source_delete: bool = False, when_not_matched_by_source_update: dict | None = None, schema: str = "main", author=None, message=None, **retry) -> tuple[int, int]:
        """(changed, inserted). Keys compare null-safe. ``when_matched_update``: None, True (the source's row) or a dict over the target's row."""
        if when_matched_update and when_matched_delete:
            raise ValueError("when_matched_update and when_matched_delete are mutually exclusive")
        if when_not_matched_by_source_delete and when_not_matched_by_source_update:
            raise ValueError("when_not_matched_by_source_delete and when_not_matched_by_source_update are mutually exclusive")
        keys = [on] if isinstance(on, str) else list(on)

        def run() -> tuple[int, int]:
            t = self.at(name, schema)
            own = [t.column(k).name for k in keys]
            scanner = Scanner(self, t)
            lower = {c.lower(): c for c in source.columns}
            offered = source.select(*[F.col(quoted(lower[c.name.lower()])).cast(c.spark()).alias(c.name) for c in t.columns if c.name.lower() in lower])
            known = {c.name.lower() for c in t.columns}
            if extra := [c for c in source.columns if c.lower() not in known]:
                raise ValueError(f"Schema mismatch: columns {extra} are not in table '{t.name}'")
            with self.staged(offered, t) as s:
                target = scanner.frame(internal=True).alias("t")
                some = s.groupBy(*map(quoted, own)).agg(F.count("*").alias("_times")).alias("s")
                changed = inserted = 0
                counts: Counter = Counter()
                gone, fresh = [], []
                match_acts = when_matched_update is not None and when_matched_update is not False or when_matched_delete
                with self.staged(target.join(some, same(own, "t", "s")).select("t.*", "s._times"), t) as hit:
                    if match_acts:
                        found = FILES.touched(hit, F.max("_times"))
                        if when_matched_update is True and any(times > 1 for _, times in found.values()):
                            raise ValueError("a row of the target matches several rows of the source")
                        counts.update({i: n for i, (n, _) in found.items()})
                        changed = sum(counts.values())
                    counts_of_hits = changed
                    if changed:
                        gone.append(hit.select("_fid", "_pos"))
                        if when_matched_update is True:
                            at = hit.select(*map(quoted, own)).alias("t")
                            fresh.append(FILES.fitted(s.alias("s").join(at, same(own, "s", "t")).select("s.*"), t))
                        elif isinstance(when_matched_update, dict):
                            fresh.append(self._assigned(hit, t, when_matched_update))
                    if when_not_matched_insert:
                        there = hit.select(*map(quoted, own)).distinct().alias("t")
                        fresh.append(FILES.fitted(s.alias("s").join(there, same(own, "s", "t"), "left_anti"), t))
                    with self.staged(target.join(some, same(own, "t", "s"), "left_anti") if when_not_matched_by_source_delete or when_not_matched_by_source_update else scanner.empty(True), t) as left:
                        by_file = {i: n for i, (n,) in FILES.touched(left).items()} if when_not_matched_by_source_delete or when_not_matched_by_source_update else {}
                        if by_file:
                            counts.update(by_file)
                            changed += sum(by_file.values())
                            gone.append(left.select("_fid", "_pos"))
                            if when_not_matched_by_source_update:
                                fresh.append(self._assigned(left, t, when_not_matched_by_source_update))
                        if gone or fresh:
                            rows = fresh[0] if fresh else None
                            for f in fresh[1:]:
                                rows = rows.unionByName(f)
                            positions = gone[0] if gone else None
                            for g in gone[1:]:
                                positions = positions.unionByName(g)
                            new, deletes = self.together(lambda: FILES.write_files(self, t, rows) if rows is not None else [], lambda: FILES.write_deletes(self, scanner, positions, counts) if gone else {})
                            # every other row written replaces one that goes
                            inserted = sum(f["rows"] for f in new) - (counts_of_hits if match_acts and not when_matched_delete else 0) - (sum(by_file.values()) if when_not_matched_by_source_update else 0)
                            if new or gone:
                                self._commit_change(t, deletes, self._inline_hits(positions, counts), new, "update" if gone else "insert", author, message)
            return changed, inserted

        return self.retrying(run, **retry)

    def _hits(self, scanner: Scanner, where) -> DataFrame:
        if isinstance(where, str):
            return scanner.frame(where, internal=True)
        return scanner.frame(internal=True).filter(condition(where))

    def _assigned(self, rows: DataFrame, t: TableAt, updates: dict) -> DataFrame:
        for k, v in updates.items():
            c = t.column(k)
            rows = rows.withColumn(c.name, value(v).cast(c.spark()))
        return rows.select(*[F.col(quoted(c.name)) for c in t.columns])

    def _at_once(self, scanner: Scanner, where) -> list[dict] | None:
        """The files that a change may touch, if its delete files can be written without counting first: no inlined rows, few old positions."""
        if self._inlined_count(scanner.t):
            return None
        files = scanner.data_files()
        files = scanner.prune(files, where) if isinstance(where, str) else files
        old = scanner.delete_files()
        return files if sum(old[f["data_file_id"]]["delete_count"] for f in files if f["data_file_id"] in old) <= FILES.FEW_POSITIONS else None

    def _inline_hits(self, positions: DataFrame, counts: dict[int, int]) -> list[tuple[int, int]]:
        """Inlined rows among the positions: as many as inlined rows are allowed to be."""
        return [(r["_fid"], r["_pos"]) for r in positions.filter("_fid < 0").collect()] if any(i < 0 for i in counts) else []

    def _commit_change(self, t, deletes, inline, new, kind, author, message) -> None:
        with self.catalog.transaction(kind, t.id, t.snapshot, author, message) as tx:
            FILES.register_deletes(tx, t, deletes)
            tables = [r["table_name"] for r in self.catalog.rows("SELECT * FROM {inlined_data_tables} WHERE table_id = ? ORDER BY schema_version", t.id)]
            for fid, row in inline:
                tx.run(f'UPDATE "{tables[-1 - fid]}" SET end_snapshot = ? WHERE row_id = ? AND end_snapshot IS NULL', tx.snapshot, row)
            if new:
                FILES.register(tx, t, new)
                tx.changes.append(f"inserted_into_table:{t.id}")
            if deletes or inline:
                tx.changes.append(f"deleted_from_table:{t.id}")

    def _end_rows(self, tx, t: TableAt) -> None:
        tx.end("data_file", "table_id = ?", t.id)
        tx.end("delete_file", "table_id = ?", t.id)
        for r in self.catalog.rows("SELECT table_name FROM {inlined_data_tables} WHERE table_id = ?", t.id):
            tx.run(f"UPDATE \"{r['table_name']}\" SET end_snapshot = ? WHERE end_snapshot IS NULL", tx.snapshot)

    def _inlined_count(self, t: TableAt) -> int:
        return sum(self.catalog.rows(f"SELECT count(*) AS n FROM \"{r['table_name']}\" WHERE {VISIBLE}", t.snapshot, t.snapshot)[0]["n"] for r in self.catalog.rows("SELECT table_name FROM {inlined_data_tables} WHERE table_id = ?", t.id))

    def _inline(self, tx, t: TableAt, rows: list) -> None:
        version = tx.run("SELECT max(schema_version) FROM {schema_versions} WHERE table_id = ?", t.id).fetchone()[0] or 0
        table = f"{self.catalog.prefix}inlined_data_{t.id}_{version}"
        columns = ", ".join(f"c{c.id}" for c in t.columns)
        if not tx.run("SELECT 1 FROM {inlined_data_tables} WHERE table_name = ?", table).fetchone():
            typed = ", ".join(f"c{c.id}{self.catalog.backend.untyped}" for c in t.columns)
            tx.run(f'CREATE TABLE "{table}" (row_id INTEGER, begin_snapshot INTEGER, end_snapshot INTEGER, {typed})')
            tx.insert("inlined_data_tables", table_id=t.id, table_name=table, schema_version=version)
        stats = tx.run("SELECT record_count, next_row_id, file_size_bytes FROM {table_stats} WHERE table_id = ?", t.id).fetchone() or (0, 0, 0)
        for i, r in enumerate(rows):
            tx.run(f'INSERT INTO "{table}" (row_id, begin_snapshot, {columns}) VALUES ({", ".join("?" * (2 + len(t.columns)))})', stats[1] + i, tx.snapshot, *[pack_value(v, c.kind) for v, c in zip(r, t.columns, strict=True)])
        tx.run("DELETE FROM {table_stats} WHERE table_id = ?", t.id)
        tx.insert("table_stats", table_id=t.id, record_count=stats[0] + len(rows), next_row_id=stats[1] + len(rows), file_size_bytes=stats[2])


