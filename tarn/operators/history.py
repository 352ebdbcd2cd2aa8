"""The change feed, compaction, expiry, clean-up, and the catalog as tables.

Messages of argument errors and the names of output columns are fixed values.
"""

from __future__ import annotations

import datetime as dt
import json
import os

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scan import VISIBLE, Scanner, few, listed, place, place_of_row, quoted
from ..sources.catalog import VERSION, instant
from . import files as FILES


class History:
    # --- change feed: snapshots in (start, end], columns as at end

    def _span(self, name: str, start: int, end: int | None, schema: str) -> tuple[Scanner, int]:
        end = self.catalog.head() if end is None else end
        if start > end:
            raise ValueError(f"start ({start}) must not be after end ({end})")
        self.catalog.at(end)
        return Scanner(self, self.at(name, schema, end)), end

    def _compactions(self, t) -> set[int]:
        return {r["snapshot_id"] for r in self.catalog.rows("SELECT snapshot_id, changes_made FROM {snapshot_changes}") if f"compacted_table:{t.id}" in (r["changes_made"] or "").split(",")}

    def insertions(self, name: str, start: int = 0, end: int | None = None, schema: str = "main") -> DataFrame:
        sc, end = self._span(name, start, end, schema)
        skip = self._compactions(sc.t)
        files = [f for f in self.catalog.rows("SELECT * FROM {data_file} WHERE table_id = ? AND (begin_snapshot > ? OR partial_max > ?) AND begin_snapshot <= ?", sc.t.id, start, start, end) if f["begin_snapshot"] not in skip or f["partial_max"] is not None]
        rows = sc.united([*sc.files_frame(files, {}, True, upto=end), sc.inlined("begin_snapshot > ? AND begin_snapshot <= ?", start, end, internal=True)], True)
        return self._feed(rows.filter(F.col("_row_snapshot").between(start + 1, end)), sc)

    def _feed(self, rows: DataFrame, sc: Scanner) -> DataFrame:
        return rows.select(F.col("_row_snapshot").alias("snapshot_id"), *[F.col(quoted(c.name)) for c in sc.t.columns])

    def deletions(self, name: str, start: int = 0, end: int | None = None, schema: str = "main") -> DataFrame:
        """New positions of each delete file, live rows of files that ended otherwise than by compaction, inlined rows that ended."""
        sc, end = self._span(name, start, end, schema)
        skip = self._compactions(sc.t)
        every = {f["data_file_id"]: f for f in self.catalog.rows("SELECT * FROM {data_file} WHERE table_id = ?", sc.t.id)}
        deletes = [d for d in self.catalog.rows("SELECT * FROM {delete_file} WHERE table_id = ? AND begin_snapshot <= ?", sc.t.id, end) if d["data_file_id"] in every]
        frames = []
        new = sorted({d["data_file_id"] for d in deletes if d["begin_snapshot"] > start})
        if new:
            # files are cumulative: a position went in the first one that has it
            of = [d for d in deletes if d["data_file_id"] in set(new)]
            owner = listed(self.spark, [(place(sc.path(d)), d["data_file_id"], d["begin_snapshot"]) for d in of], ["_of", "_f", "_s"], [pa.string(), pa.int64(), pa.int64()])
            went = sc.delete_rows(of, place_of_row().alias("_of")).join(few(owner, len(of)), "_of").groupBy("_f", F.col("pos").alias("_p")).agg(F.min("_s").alias("_went")).filter(F.col("_went") > start)
            for part in sc.files_frame([every[i] for i in new], {}, True, upto=end):
                hit = part.join(went, (F.col("_fid") == F.col("_f")) & (F.col("_pos") == F.col("_p")))
                frames.append(hit.withColumn("_row_snapshot", F.col("_went")).select(part.columns))
        ended = [f for f in every.values() if f["end_snapshot"] is not None and start < f["end_snapshot"] <= end and f["end_snapshot"] not in skip]
        if ended:
            before = {d["data_file_id"]: d for d in self.catalog.rows("SELECT * FROM {delete_file} WHERE table_id = ?", sc.t.id) for f in [every.get(d["data_file_id"])] if f and f["end_snapshot"] and d["begin_snapshot"] < f["end_snapshot"] and (d["end_snapshot"] is None or d["end_snapshot"] >= f["end_snapshot"])}
            ends = listed(self.spark, [(f["data_file_id"], f["end_snapshot"]) for f in ended], ["_f", "_went"], [pa.int64(), pa.int64()])
            for part in sc.files_frame(ended, {f["data_file_id"]: before[f["data_file_id"]] for f in ended if f["data_file_id"] in before}, True, upto=end):
                frames.append(part.join(few(ends, len(ended)), F.col("_fid") == F.col("_f")).withColumn("_row_snapshot", F.col("_went")).select(part.columns))
        kept = f" AND end_snapshot NOT IN ({','.join(map(str, skip))})" if skip else ""
        frames.append(sc.inlined(f"end_snapshot > ? AND end_snapshot <= ?{kept}", start, end, internal=True, stamp="end_snapshot"))
        return self._feed(sc.united(frames, True), sc)

    def changes(self, name: str, start: int = 0, end: int | None = None, schema: str = "main") -> DataFrame:
        """snapshot_id, change_type and the columns; a snapshot that both inserts and deletes is an update, before and after."""
        added, gone = self.insertions(name, start, end, schema), self.deletions(name, start, end, schema)
        t = self.at(name, schema, self.catalog.head() if end is None else end)
        both = [r["snapshot_id"] for r in self.catalog.rows("SELECT snapshot_id, changes_made FROM {snapshot_changes} WHERE snapshot_id > ?", start) if {f"inserted_into_table:{t.id}", f"deleted_from_table:{t.id}"} <= set((r["changes_made"] or "").split(","))]
        label = lambda plain, changed: F.when(F.col("snapshot_id").isin(both), F.lit(changed)).otherwise(F.lit(plain)) if both else F.lit(plain)
        out = added.withColumn("change_type", label("insert", "update_postimage")).unionByName(gone.withColumn("change_type", label("delete", "update_preimage")))
        return out.select("snapshot_id", "change_type", *[F.col(quoted(c.name)) for c in t.columns])

    # --- maintenance

    def rewrite_data_files(self, name: str, schema: str = "main") -> int:
        """All live rows into few files, deletes applied; -1 if there is nothing to gain. History stays readable."""

        def run() -> int:
            t = self.at(name, schema)
            sc = Scanner(self, t)
            files, deletes = sc.data_files(), sc.delete_files()
            if len(files) <= 1 and not deletes:
                return -1
            rows = sc.united(sc.files_frame(files, deletes, False))
            size = sum(f["file_size_bytes"] or 0 for f in files)
            new = FILES.write_files(self, t, rows if t.partition else rows.coalesce(max(1, size // self.file_size(t))))
            with self.catalog.transaction("compact", t.id, t.snapshot) as tx:
                ids = ",".join(str(f["data_file_id"]) for f in files)
                tx.end("data_file", f"data_file_id IN ({ids})")
                tx.end("delete_file", f"data_file_id IN ({ids})")
                # what others have inserted since stays counted
                tx.run("UPDATE {table_stats} SET record_count = record_count - ?, file_size_bytes = file_size_bytes - ? WHERE table_id = ?", sum(f["record_count"] for f in files), size, t.id)
                if not tx.run("SELECT 1 FROM {data_file} WHERE table_id = ? AND end_snapshot IS NULL", t.id).fetchone():
                    tx.run("DELETE FROM {table_column_stats} WHERE table_id = ?", t.id)
                FILES.register(tx, t, new)
                tx.changes.append(f"compacted_table:{t.id}")
            return tx.snapshot

        return self.retrying(run)

    def merge_adjacent_files(self, name: str, schema: str = "main", min_file_size: int = 0, max_file_size: int | None = None) -> int:
        """Files of one partition without deletes, stored alike, become one that keeps each row's snapshot; -1 if there are none."""
        if self.catalog.version == "0.3":
            raise ValueError("merge_adjacent_files requires catalog version 0.4 or later")

        def run() -> int:
            t = self.at(name, schema)
            sc = Scanner(self, t)
            touched = {d["data_file_id"] for d in self.catalog.rows("SELECT data_file_id FROM {delete_file} WHERE table_id = ?", t.id)}
            values = {}
            for r in self.catalog.rows("SELECT * FROM {file_partition_value} WHERE table_id = ? ORDER BY partition_key_index", t.id):
                values.setdefault(r["data_file_id"], []).append(r["partition_value"])
            current = sc.types_at(t.snapshot)
            groups: dict[tuple, list[dict]] = {}
            for f in sc.data_files():
                if f["data_file_id"] not in touched and sc.types_at(f["begin_snapshot"]).items() <= current.items() and min_file_size <= (f["file_size_bytes"] or 0) < (max_file_size or 1 << 62):
                    groups.setdefault((f["partition_id"], *values.get(f["data_file_id"], [])), []).append(f)
            made = []
            for (pid, *vals), files in groups.items():
                if len(files) < 2:
                    continue
                rows = sc.united(sc.files_frame(files, {}, True), True).drop("_fid", "_pos")
                flat = type(t)(**{**t.__dict__, "partition": [], "partition_id": None})
                size = sum(f["file_size_bytes"] or 0 for f in files)
                new = FILES.write_files(self, flat, rows.coalesce(max(1, size // self.file_size(t))), snapshot_rows=True)
                for n in new:
                    n["values"] = vals
                made.append((pid, files, new))
            if not made:
                return -1
            with self.catalog.transaction("compact", t.id, t.snapshot) as tx:
                now = dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f+00")
                for pid, files, new in made:
                    FILES.register(tx, t, new, begin=min(f["begin_snapshot"] for f in files), partial_max=max(f["partial_max"] or f["begin_snapshot"] for f in files), partition_id=pid)
                    for f in files:
                        tx.run("UPDATE {table_stats} SET record_count = record_count - ?, file_size_bytes = file_size_bytes - ? WHERE table_id = ?", f["record_count"], f["file_size_bytes"], t.id)
                        self._forget(tx, f, sc.path(f), now)
                tx.changes.append(f"compacted_table:{t.id}")
            return tx.snapshot

        return self.retrying(run)

    def _forget(self, tx, f: dict, path: str, now: str) -> None:
        for table in ("data_file", "file_column_stats", "file_partition_value"):
            tx.run(f"DELETE FROM {{{table}}} WHERE data_file_id = ?", f["data_file_id"])
        if f["path_is_relative"]:  # an added file is not ours to delete
            tx.insert("files_scheduled_for_deletion", data_file_id=f["data_file_id"], path=path, path_is_relative=0, schedule_start=now)

    def expire_snapshots(self, older_than_snapshot: int | None = None, keep_last_n: int | None = None) -> int:
        """Forget old snapshots and what only they see; returns how many. Their files are scheduled for deletion."""
        if older_than_snapshot is not None and keep_last_n is not None:
            raise ValueError("Cannot specify both older_than_snapshot and keep_last_n")
        if older_than_snapshot is None and keep_last_n is None:
            raise ValueError("Must specify either older_than_snapshot or keep_last_n")
        if keep_last_n is not None and keep_last_n < 1:
            raise ValueError("keep_last_n must be >= 1")
        ids = [r["snapshot_id"] for r in self.catalog.rows("SELECT snapshot_id FROM {snapshot} ORDER BY snapshot_id")]
        kept = set(ids[-keep_last_n:]) if keep_last_n else {i for i in ids if i >= older_than_snapshot} | {ids[-1]}
        gone = [i for i in ids if i not in kept]
        if not gone:
            return 0
        first = min(kept)
        con = self.catalog.connection()
        con.execute("BEGIN IMMEDIATE")
        try:
            run = lambda sql, *a: con.execute(self.catalog.sql(sql), a)
            now = dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f+00")
            folders = {r["table_id"]: (r["sp"], r["tp"]) for r in self.catalog.rows("SELECT t.table_id, s.path AS sp, t.path AS tp FROM {table} t JOIN {schema} s ON s.schema_id = t.schema_id")}
            for table in ("data_file", "delete_file"):
                for r in [dict(x) for x in run(f"SELECT * FROM {{{table}}} WHERE end_snapshot <= ?", first)]:
                    if r["path_is_relative"] and r["table_id"] in folders:
                        run("INSERT INTO {files_scheduled_for_deletion} VALUES (?, ?, 0, ?)", r["data_file_id"], self.catalog.data_path + "".join(folders[r["table_id"]]) + r["path"], now)
                run(f"DELETE FROM {{{table}}} WHERE end_snapshot <= ?", first)
            for table in ("file_column_stats", "file_partition_value"):
                run(f"DELETE FROM {{{table}}} WHERE data_file_id NOT IN (SELECT data_file_id FROM {{data_file}})")
            for table in ("schema", "table", "view", "macro", "tag", "column_tag", "partition_info", "sort_info"):
                run(f"DELETE FROM {{{table}}} WHERE end_snapshot <= ?", first)
            run("DELETE FROM {column} WHERE end_snapshot <= ? AND table_id NOT IN (SELECT table_id FROM {table})", first)  # else old files still need them
            for it in self.catalog.rows("SELECT table_name FROM {inlined_data_tables}"):
                run(f"DELETE FROM \"{it['table_name']}\" WHERE end_snapshot <= ?", first)
            marks = ",".join(map(str, gone))
            run(f"DELETE FROM {{snapshot}} WHERE snapshot_id IN ({marks})")
            run(f"DELETE FROM {{snapshot_changes}} WHERE snapshot_id IN ({marks})")
            con.execute("COMMIT")
        except BaseException:
            con.execute("ROLLBACK")
            raise
        return len(gone)

    def delete_orphaned_files(self, dry_run: bool = False, spare_hours: float = 24) -> list[str]:
        """Parquet files under the data path that no row of the catalog names; returns them. Files of writes that have not ended are spared,
        unless they began more than ``spare_hours`` ago; such a write then fails at its commit and runs again."""
        listed = [p for p, _ in FILES.listing(self, self.catalog.data_path)]
        # in this order: what was listed and has landed since is named by now
        old = dt.datetime.now(dt.timezone.utc) - dt.timedelta(hours=spare_hours)
        flying = {f for f, at in self.catalog.in_flight().items() if at > old}
        named = {r["path"] for table in ("data_file", "delete_file", "files_scheduled_for_deletion") for r in self.catalog.rows(f"SELECT path FROM {{{table}}}")}
        ours = lambda p: any(p == n or p.endswith("/" + n) for n in ("/".join(p.split("/")[-k:]) for k in range(1, p.count("/") + 2)) if n in named) or p in named
        found = [p for p in listed if not ours(p) and not flying & set(p.split("/"))]
        if not dry_run:
            for f, at in self.catalog.in_flight().items():
                if at <= old:
                    self.catalog.forget_write(f)
            for p in found:
                self.remove(p)
        return found

    vacuum = delete_orphaned_files

    def cleanup_old_files(self, older_than=None, cleanup_all: bool = False, dry_run: bool = False) -> list[str]:
        """Delete files scheduled for deletion."""
        if older_than is None and not cleanup_all:
            raise ValueError("Must specify either older_than or cleanup_all")
        due = [r for r in self.catalog.rows("SELECT rowid AS row_at, * FROM {files_scheduled_for_deletion}") if cleanup_all or instant(r["schedule_start"]) < instant(older_than)]
        for r in [] if dry_run else due:
            self.remove(r["path"] if not r["path_is_relative"] else self.catalog.data_path + r["path"])
            self.catalog.connection().execute(self.catalog.sql("DELETE FROM {files_scheduled_for_deletion} WHERE rowid = ?"), (r["row_at"],))
        return [r["path"] for r in due]

    def flush_inlined(self, name: str, schema: str = "main") -> int:
        """Inlined rows into a data file; -1 if there are none. A compaction: no change in content."""

        def run() -> int:
            t = self.at(name, schema)
            rows = Scanner(self, t).inlined(VISIBLE, t.snapshot, t.snapshot)
            if rows is None:
                return -1
            new = FILES.write_files(self, t, rows.coalesce(1))
            with self.catalog.transaction("compact", t.id, t.snapshot) as tx:
                for r in self.catalog.rows("SELECT table_name FROM {inlined_data_tables} WHERE table_id = ?", t.id):
                    tx.run(f"UPDATE \"{r['table_name']}\" SET end_snapshot = ? WHERE end_snapshot IS NULL AND begin_snapshot <= ?", tx.snapshot, t.snapshot)
                FILES.register(tx, t, new)
                tx.changes.append(f"compacted_table:{t.id}")
            return tx.snapshot

        return self.retrying(run)

    def migrate(self) -> str:
        """Bring an older catalog to the current version, in place; returns the version it had."""
        old = self.catalog.version
        con = self.catalog.connection()
        from ..sources.catalog import LAYOUT

        con.execute("BEGIN IMMEDIATE")
        try:
            for table, columns in LAYOUT.items():
                con.execute(self.catalog.sql(f"CREATE TABLE IF NOT EXISTS {{{table}}} ({columns})"))
                have = {r[1] for r in con.execute(self.catalog.sql(f"PRAGMA table_info({{{table}}})"))}
                for c in columns.split(", "):
                    if c.split()[0] not in have:
                        con.execute(self.catalog.sql(f"ALTER TABLE {{{table}}} ADD COLUMN {c.replace(' PRIMARY KEY', '')}"))
            con.execute(self.catalog.sql("UPDATE {metadata} SET value = ? WHERE key = 'version' AND scope IS NULL"), (VERSION,))
            con.execute("COMMIT")
        except BaseException:
            con.execute("ROLLBACK")
            raise
        self.catalog.version = VERSION
        return old

    # --- inspection

    def _rows(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    def snapshots(self) -> DataFrame:
        return self._rows([tuple(r.values()) for r in self.catalog.rows("SELECT snapshot_id, snapshot_time, schema_version FROM {snapshot} ORDER BY snapshot_id")], "snapshot_id long, snapshot_time string, schema_version long")

    def current_snapshot(self) -> int:
        return self.catalog.head()

    def list_snapshots(self, limit: int = 20) -> list[dict]:
        return self.catalog.rows("SELECT s.*, c.changes_made, c.author, c.commit_message FROM {snapshot} s LEFT JOIN {snapshot_changes} c USING (snapshot_id) ORDER BY snapshot_id DESC LIMIT ?", limit)

    def snapshot_changes(self, snapshot_id: int | None = None) -> DataFrame:
        rows = self.catalog.rows("SELECT snapshot_id, changes_made, author, commit_message FROM {snapshot_changes} ORDER BY snapshot_id")
        return self._rows([tuple(r.values()) for r in rows if snapshot_id in (None, r["snapshot_id"])], "snapshot_id long, changes_made string, author string, commit_message string")

    def table_info(self) -> DataFrame:
        s = self.catalog.head()
        out = []
        for schema in self.catalog.rows(f"SELECT * FROM {{schema}} WHERE {VISIBLE}", s, s):
            for t in self._tables(schema["schema_id"], s):
                f = self.catalog.rows(f"SELECT count(*) AS n, coalesce(sum(file_size_bytes), 0) AS b, coalesce(sum(record_count), 0) AS r FROM {{data_file}} WHERE table_id = ? AND {VISIBLE}", t["table_id"], s, s)[0]
                d = self.catalog.rows(f"SELECT count(*) AS n, coalesce(sum(delete_count), 0) AS r FROM {{delete_file}} WHERE table_id = ? AND {VISIBLE}", t["table_id"], s, s)[0]
                inlined = self._inlined_count(self.at(t["table_name"], schema["schema_name"]))
                out.append((schema["schema_name"], t["table_name"], t["table_id"], f["n"], f["b"], d["n"], d["r"], f["r"] - d["r"] + inlined))
        return self._rows(out, "schema_name string, table_name string, table_id long, file_count long, file_size_bytes long, delete_file_count long, delete_row_count long, live_row_count long")

    def list_files(self, name: str, schema: str = "main", version: int | None = None) -> DataFrame:
        sc = Scanner(self, self.at(name, schema, self.catalog.at(version)))
        gone = sc.delete_files()
        rows = [(sc.path(f), f["file_size_bytes"], sc.path(d) if (d := gone.get(f["data_file_id"])) else None, d["delete_count"] if d else 0) for f in sc.data_files()]
        return self._rows(rows, "data_file string, data_file_size_bytes long, delete_file string, delete_row_count long")

    def list_schemas(self) -> DataFrame:
        s = self.catalog.head()
        return self._rows([(r["schema_id"], r["schema_name"]) for r in self.catalog.rows(f"SELECT * FROM {{schema}} WHERE {VISIBLE} ORDER BY schema_id", s, s)], "schema_id long, schema_name string")

    def list_tables(self, schema: str = "main") -> DataFrame:
        return self._rows([(r["table_id"], r["table_name"]) for r in self._tables(self.schema_row(schema)["schema_id"], self.catalog.head())], "table_id long, table_name string")

    def list_views(self, schema: str = "main") -> list[str]:
        return sorted(r["view_name"] for r in self._views(self.schema_row(schema)["schema_id"], self.catalog.head()))

    def get_view(self, name: str, schema: str = "main") -> dict:
        found = self._views(self.schema_row(schema)["schema_id"], self.catalog.head(), name)
        if not found:
            raise ValueError(f"View '{schema}.{name}' not found")
        return {"view_name": name, "sql": found[0]["sql"], "dialect": found[0]["dialect"], "column_aliases": json.loads(found[0]["column_aliases"] or "null")}

    def view(self, name: str, schema: str = "main") -> DataFrame:
        """Evaluate a stored view: its SQL over the schema's tables."""
        v = self.get_view(name, schema)
        self.register(schema)
        df = self.spark.sql(v["sql"])
        return df.toDF(*v["column_aliases"]) if v["column_aliases"] else df

    def register(self, schema: str = "main") -> None:
        """Every table of a schema as a temporary view, at the current snapshot."""
        for r in self._tables(self.schema_row(schema)["schema_id"], self.catalog.head()):
            self.table(r["table_name"], schema).createOrReplaceTempView(quoted(r["table_name"]))

    def list_macros(self, schema: str = "main") -> DataFrame:
        rows = [(m["macro_id"], m["macro_name"], i["type"]) for m in self._macros(self.schema_row(schema)["schema_id"], self.catalog.head()) for i in self.catalog.rows("SELECT * FROM {macro_impl} WHERE macro_id = ?", m["macro_id"])]
        return self._rows(rows, "macro_id long, name string, type string")

    def get_macro(self, name: str, schema: str = "main") -> dict:
        found = self._macros(self.schema_row(schema)["schema_id"], self.catalog.head(), name)
        if not found:
            raise ValueError(f"Macro '{schema}.{name}' not found")
        i = self.catalog.rows("SELECT * FROM {macro_impl} WHERE macro_id = ?", found[0]["macro_id"])[0]
        p = self.catalog.rows("SELECT * FROM {macro_parameters} WHERE macro_id = ? ORDER BY column_id", found[0]["macro_id"])
        return {"name": name, "type": i["type"], "dialect": i["dialect"], "sql": i["sql"], "parameters": [{"name": x["parameter_name"], "type": x["parameter_type"], "default": x["default_value"], "default_type": x["default_value_type"]} for x in p]}

    def table_tags(self, name: str, schema: str = "main") -> DataFrame:
        t = self.at(name, schema)
        return self._rows([(r["key"], r["value"]) for r in self.catalog.rows("SELECT * FROM {tag} WHERE object_id = ? AND end_snapshot IS NULL ORDER BY key", t.id)], "key string, value string")

    def column_tags(self, name: str, column: str, schema: str = "main") -> DataFrame:
        t = self.at(name, schema)
        return self._rows([(r["key"], r["value"]) for r in self.catalog.rows("SELECT * FROM {column_tag} WHERE table_id = ? AND column_id = ? AND end_snapshot IS NULL ORDER BY key", t.id, t.column(column).id)], "key string, value string")

    def sort_keys(self, name: str, schema: str = "main") -> DataFrame:
        t = self.at(name, schema)
        names = {str(c.id): c.name for c in t.columns}
        return self._rows([(s["sort_key_index"], names.get(s["expression"], s["expression"]) if s["dialect"] == "column" else s["expression"], s["sort_direction"], s["null_order"]) for s in t.sort], "sort_key_index long, expression string, sort_direction string, null_order string")

    def options(self) -> DataFrame:
        return self._rows([(r["key"], r["value"], r["scope"], r["scope_id"]) for r in self.catalog.rows("SELECT * FROM {metadata} ORDER BY key")], "key string, value string, scope string, scope_id long")

    def settings(self) -> DataFrame:
        return self._rows([(self.catalog.backend.name, self.catalog.data_path)], "catalog_type string, data_path string")

    def catalog_info(self) -> dict:
        return {"version": self.catalog.version, "data_path": self.catalog.data_path, "snapshot": self.catalog.head(), "path": os.path.abspath(self.catalog.path)}
