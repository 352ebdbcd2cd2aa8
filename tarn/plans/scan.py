"""From a table at a snapshot to a lazy DataFrame.

Files whose columns are stored alike are read together: files with field ids by id, added files by their names. Deleted
positions are taken away by an anti join on (file name, row index), inlined rows are united, and everything ends
in one projection, so that filters and column pruning reach the Parquet scan.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import Node, from_text, unpack_value
from .prune import Range, compile_predicate

#: Delete positions up to this many (some 100 MB in memory) are broadcast as they are.
BROADCAST_DELETES = 2_000_000
#: More are broadcast as bitmaps, if the files that have them hold up to this many rows (a bit each: 100 MB); beyond it, both sides are shuffled.
BROADCAST_BITS = 800_000_000
#: Rows to a bitmap.
BITMAP = 32_768
#: Tables with a row a file are broadcast up to this many rows (some 100 MB in memory); more are joined by shuffling.
BROADCAST_FILES = 500_000
VISIBLE = "begin_snapshot <= ? AND (end_snapshot IS NULL OR end_snapshot > ?)"


def listed(spark, rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> DataFrame:
    """Rows of the catalog as a DataFrame that is part of the plan: no job makes it."""
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return spark.createDataFrame(pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names))


def few(df: DataFrame, n: int) -> DataFrame:
    """A table of ``n`` rows, broadcast if they are not many."""
    return F.broadcast(df) if n <= BROADCAST_FILES else df


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def place(path: str) -> str:
    """A path without its scheme: the key by which files are told apart."""
    return re.sub("^[a-z0-9]+:/+", "/", path)


def place_of_row() -> Column:
    """The same of the file that a row is read from; Spark gives it as an encoded URI."""
    return F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^[a-z0-9]+:/+", "/")


@dataclass
class TableAt:
    """A table as a snapshot sees it."""

    id: int
    name: str
    schema: str
    folder: str
    snapshot: int
    columns: list[Node]
    partition_id: int | None = None
    partition: list[tuple[Node, str]] = field(default_factory=list)
    sort: list[dict] = field(default_factory=list)

    def spark_schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.spark()) for c in self.columns])

    def column(self, name: str) -> Node:
        for c in self.columns:
            if c.name == name:
                return c
        for c in self.columns:
            if c.name.lower() == name.lower():
                return c
        raise ValueError(f"Column '{name}' not found in table '{self.name}'")


def tree(rows: list[dict]) -> list[Node]:
    """Top-level columns in order, from catalog rows."""
    below = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["column_order"], r["column_id"])):
        below[r["parent_column"]].append(r)

    def node(r) -> Node:
        return Node(r["column_name"], r["column_type"], [node(x) for x in below[r["column_id"]]], r["column_id"])

    return [node(r) for r in below[None]]


class Scanner:
    def __init__(self, lake, t: TableAt):
        self.lake, self.store, self.spark, self.t = lake, lake.catalog, lake.spark, t
        self.history = self.store.rows("SELECT * FROM {column} WHERE table_id = ?", t.id)
        self.pruned = 0

    def types_at(self, snapshot: int) -> dict[int, str]:
        return {r["column_id"]: r["column_type"] for r in self.history if r["begin_snapshot"] <= snapshot and (r["end_snapshot"] is None or r["end_snapshot"] > snapshot)}

    def data_files(self, snapshot: int | None = None) -> list[dict]:
        s = self.t.snapshot if snapshot is None else snapshot
        return self.store.rows(f"SELECT * FROM {{data_file}} WHERE table_id = ? AND {VISIBLE} ORDER BY data_file_id", self.t.id, s, s)

    def delete_files(self, snapshot: int | None = None) -> dict[int, dict]:
        s = self.t.snapshot if snapshot is None else snapshot
        return {r["data_file_id"]: r for r in self.store.rows(f"SELECT * FROM {{delete_file}} WHERE table_id = ? AND {VISIBLE}", self.t.id, s, s)}

    def path(self, r: dict) -> str:
        return self.t.folder + r["path"] if r["path_is_relative"] else r["path"]

    def prune(self, files: list[dict], where: str) -> list[dict]:
        """Those files that may hold matching rows; ``pruned`` counts the others."""
        kinds = {c.name.lower(): c.kind for c in self.t.columns}
        test, used = compile_predicate(self.spark, where, kinds)
        if not used or not files:
            return files
        ids = {c.id: c for c in self.t.columns if c.name.lower() in used}
        stats = defaultdict(dict)
        s = self.t.snapshot
        seen = f"data_file_id IN (SELECT data_file_id FROM {{data_file}} WHERE table_id = ? AND {VISIBLE})"
        for r in self.store.rows(f"SELECT data_file_id, column_id, null_count, min_value, max_value FROM {{file_column_stats}} WHERE table_id = ? AND column_id IN ({','.join(map(str, ids))}) AND {seen}", self.t.id, self.t.id, s, s):
            stats[r["data_file_id"]][r["column_id"]] = r
        specs = {(r["partition_id"], r["partition_key_index"]): r for r in self.store.rows("SELECT * FROM {partition_column} WHERE table_id = ?", self.t.id)}
        values = defaultdict(dict)
        if any(x["column_id"] in ids and x["transform"] == "identity" for x in specs.values()):
            for r in self.store.rows(f"SELECT * FROM {{file_partition_value}} WHERE table_id = ? AND {seen}", self.t.id, self.t.id, s, s):
                values[r["data_file_id"]][r["partition_key_index"]] = r["partition_value"]
        out = []
        for f in files:
            of = {}
            known = self.types_at(f["begin_snapshot"])
            for i, c in ids.items():
                r = stats[f["data_file_id"]].get(i)
                n = f["record_count"]
                if i not in known and not f["mapping_id"]:
                    of[c.name.lower()] = Range(None, None, n, n)  # the column came later: all null
                    continue
                floating = c.kind.startswith("float")
                x = Range(floating=floating)
                if r:
                    x = Range(from_text(r["min_value"], c.kind), from_text(r["max_value"], c.kind), r["null_count"], n, floating)
                for k, v in values[f["data_file_id"]].items():
                    spec = specs.get((f["partition_id"], k))
                    if spec and spec["column_id"] == i and spec["transform"] == "identity":
                        v = from_text(v, c.kind)
                        x = Range(v, v, n if values[f["data_file_id"]][k] is None else 0, n, floating)
                of[c.name.lower()] = x
            if test(of):
                out.append(f)
        self.pruned = len(files) - len(out)
        return out

    def files_frame(self, files: list[dict], deletes: dict[int, dict], internal: bool, upto: int | None = None) -> list[DataFrame]:
        """One DataFrame for each kind of file."""
        upto = self.t.snapshot if upto is None else upto
        groups = defaultdict(list)
        layers: dict[str, int] = defaultdict(int)
        for f in files:
            name = place(self.path(f))
            layer = layers[name]
            layers[name] += 1
            known = self.types_at(f["begin_snapshot"])
            kinds = tuple(sorted((i, k) for i, k in known.items()))
            partial = f["partial_max"] is not None
            groups[(f["mapping_id"], kinds, partial, f["data_file_id"] in deletes, layer)].append(f)
        return [self._group(k, g, deletes, internal, upto) for k, g in groups.items()]

    def _group(self, key, files, deletes, internal, upto) -> DataFrame:
        mapping, kinds, partial, has_deletes, _ = key
        known = dict(kinds)
        snap = self.lake.snapshot_column
        if mapping:
            sources = {r["column_id"]: r["source_name"] for r in self.store.rows("SELECT column_id, source_name FROM {name_mapping} WHERE mapping_id = ? AND parent_column IS NULL", mapping)}
            old = {c.id: c for c in tree([r for r in self.history if r["begin_snapshot"] <= files[0]["begin_snapshot"] and (r["end_snapshot"] is None or r["end_snapshot"] > files[0]["begin_snapshot"])])}
            plain = {i: _without_ids(old[i].spark()) for i in sources if i in old}
            schema = T.StructType([T.StructField(sources[i], plain[i]) for i in plain])
            value = lambda c: F.col(quoted(sources[c.id])) if c.id in plain else F.lit(None)
            stored = lambda c: plain.get(c.id)
        else:
            schema = T.StructType([c.field(known) for c in self.t.columns])
            value = lambda c: F.col(quoted(c.name))
            stored = lambda c: _without_ids(c.spark(known))
        if partial:
            schema = schema.add(snap, T.LongType())
        df = self.spark.read.schema(schema).parquet(*[self.path(f) for f in files])
        hidden = {}
        if partial or internal:
            hidden["_row_snapshot"] = F.col(quoted(snap)) if partial else F.lit(None).cast("long")
        # file names alone tell these files apart, mostly; they cost nothing a row
        names = [place(self.path(f)) for f in files]
        short = [n.rsplit("/", 1)[-1] for n in names]
        by_name = len(set(short)) == len(short) and all(re.fullmatch(r"[\w.=-]+", n, re.ASCII) for n in short)
        if has_deletes or internal:
            hidden |= {"_name": F.col("_metadata.file_name") if by_name else place_of_row(), "_pos": F.col("_metadata.row_index")}
        df = df.select(*[(value(c) if stored(c) == _without_ids(c.spark()) else value(c).cast(_without_ids(c.spark()))).alias(c.name) for c in self.t.columns], *[v.alias(k) for k, v in hidden.items()])
        if partial and any(f["partial_max"] > upto for f in files):
            df = df.filter(F.col("_row_snapshot") <= upto)
        if has_deletes:
            own = [deletes[f["data_file_id"]] for f in files]
            gone = self.positions(own)
            if by_name:
                gone = gone.withColumn("_gone_name", F.substring_index("_gone_name", "/", -1))
            n = sum(d["delete_count"] for d in own)
            if n > BROADCAST_DELETES and sum(f["record_count"] for f in files) <= BROADCAST_BITS:
                df = _without_bits(df, gone)
            else:
                gone = F.broadcast(gone) if n <= BROADCAST_DELETES else gone
                df = df.join(gone, (F.col("_name") == F.col("_gone_name")) & (F.col("_pos") == F.col("_gone_pos")), "left_anti")
        if internal:
            ids = listed(self.spark, [(n, f["data_file_id"], f["begin_snapshot"]) for n, f in zip(short if by_name else names, files, strict=True)], ["_file_name", "_fid", "_begin"], [pa.string(), pa.int64(), pa.int64()])
            df = df.join(few(ids, len(files)), F.col("_name") == F.col("_file_name")).withColumn("_row_snapshot", F.coalesce("_row_snapshot", "_begin"))  # a row a file
            return df.select(*[F.col(quoted(c.name)) for c in self.t.columns], "_fid", "_pos", "_row_snapshot")
        return df.select(*[F.col(quoted(c.name)) for c in self.t.columns])

    def delete_rows(self, deletes: list[dict], *more: Column) -> DataFrame:
        """(file_path, pos, ...) of delete files. Rows of a cumulative file that came after the snapshot, where it says so, are left out."""
        late = [d for d in deletes if d["partial_max"] is not None and d["partial_max"] > self.t.snapshot]
        plain = [d for d in deletes if d not in late]
        snap, frames = self.lake.snapshot_column, []
        if plain:
            frames.append(self.spark.read.schema("file_path string, pos long").parquet(*[self.path(d) for d in plain]).select("file_path", "pos", *more))
        if late:
            frames.append(self.spark.read.schema(f"file_path string, pos long, `{snap}` long").parquet(*[self.path(d) for d in late]).filter(F.coalesce(F.col(quoted(snap)), F.lit(0)) <= self.t.snapshot).select("file_path", "pos", *more))
        return frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])

    def positions(self, deletes: list[dict]) -> DataFrame:
        """(_gone_name, _gone_pos) of delete files."""
        raw = self.delete_rows(deletes)
        return raw.select(F.regexp_replace("file_path", "^[a-z0-9]+:/+", "/").alias("_gone_name"), F.col("pos").alias("_gone_pos"))

    def inlined(self, condition: str, *args, internal: bool = False, stamp: str = "begin_snapshot") -> DataFrame | None:
        """Inlined rows by a condition on begin_snapshot and end_snapshot; columns are matched by id. ``stamp`` is what ``_row_snapshot`` tells."""
        rows = []
        for k, it in enumerate(self.store.rows("SELECT * FROM {inlined_data_tables} WHERE table_id = ? ORDER BY schema_version", self.t.id)):
            names = {c["name"] for c in self.store.rows(f"PRAGMA table_info(\"{it['table_name']}\")")}
            for r in self.store.rows(f"SELECT * FROM \"{it['table_name']}\" WHERE {condition}", *args):
                out = tuple(unpack_value(r[f"c{c.id}"], c.spark()) if f"c{c.id}" in names else None for c in self.t.columns)
                rows.append(out + ((-1 - k, r["row_id"], r[stamp]) if internal else ()))
        if not rows:
            return None
        schema = T.StructType([T.StructField(f"c{i}", _without_ids(c.spark())) for i, c in enumerate(self.t.columns)] + ([T.StructField(x, T.LongType()) for x in ("_fid", "_pos", "_row_snapshot")] if internal else []))
        return self.spark.createDataFrame(rows, schema).toDF(*[c.name for c in self.t.columns], *(("_fid", "_pos", "_row_snapshot") if internal else ()))

    def empty(self, internal: bool = False) -> DataFrame:
        schema = T.StructType([T.StructField(c.name, _without_ids(c.spark())) for c in self.t.columns])
        for x in ("_fid", "_pos", "_row_snapshot") if internal else ():
            schema = schema.add(x, T.LongType())
        return self.spark.createDataFrame([], schema)

    def united(self, frames: list[DataFrame | None], internal: bool = False) -> DataFrame:
        out = None
        for f in frames:
            if f is not None:
                out = f if out is None else out.union(f)
        return self.empty(internal) if out is None else out

    def frame(self, where: str | None = None, internal: bool = False) -> DataFrame:
        files = self.data_files()
        if where:
            files = self.prune(files, where)
        s = self.t.snapshot
        df = self.united([*self.files_frame(files, self.delete_files(), internal), self.inlined(VISIBLE, s, s, internal=internal)], internal)
        return df.filter(where) if where else df


def _without_bits(df: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of ``df`` (_name, _pos, ...) that are not in ``gone`` (_gone_name, _gone_pos), by a bitmap for each stretch of a file."""
    stretch = lambda pos: F.floor(pos / BITMAP)
    maps = gone.groupBy("_gone_name", stretch(F.col("_gone_pos")).alias("_gone_part")).agg(F.bitmap_construct_agg(F.col("_gone_pos") % BITMAP).alias("_bits"))
    joined = df.join(F.broadcast(maps), (F.col("_name") == F.col("_gone_name")) & (stretch(F.col("_pos")) == F.col("_gone_part")), "left")
    bit = F.col("_pos") % BITMAP
    byte = F.conv(F.hex(F.substring("_bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.call_function("getbit", byte, (bit % 8).cast("int")) == 1
    return joined.filter(F.isnull("_bits") | ~held).select(df.columns)


def _without_ids(t: T.DataType) -> T.DataType:
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, _without_ids(f.dataType)) for f in t.fields])
    if isinstance(t, T.ArrayType):
        return T.ArrayType(_without_ids(t.elementType))
    if isinstance(t, T.MapType):
        return T.MapType(_without_ids(t.keyType), _without_ids(t.valueType))
    return t
