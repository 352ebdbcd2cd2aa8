"""Writing a DataFrame as a table's Parquet files, on the executors, and describing the files for the catalog."""

from __future__ import annotations

import datetime as dt
import math
import os
import uuid
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import transforms
from ..functions.types import Node, from_spark, from_text, to_text
from ..plans.scan import Scanner, TableAt, few, listed, place, place_of_row, quoted

#: With so many old positions in the files that a change may touch, they are written again rather than asked which files are touched.
FEW_POSITIONS = 1_000_000
#: Kinds whose least and greatest values are kept.
RANGED = ("int", "uint", "float", "decimal", "varchar", "date", "timestamp")


def fitted(df: DataFrame, t: TableAt) -> DataFrame:
    """The table's columns in order, cast; absent ones are null, unknown ones an error."""
    have = {c.lower(): c for c in df.columns}
    known = {c.name.lower() for c in t.columns}
    if extra := [c for c in df.columns if c.lower() not in known and not c.startswith("_row_")]:
        raise ValueError(f"Schema mismatch: columns {extra} are not in table '{t.name}'")
    return df.select(*[(F.col(quoted(have[c.name.lower()])) if c.name.lower() in have else F.lit(None)).cast(c.spark()).alias(c.name) for c in t.columns])


def sort_columns(t: TableAt, names: set[str]) -> list:
    out = []
    for s in t.sort:
        if s["dialect"] == "column" and s["expression"].isdigit():
            found = [c.name for c in t.columns if c.id == int(s["expression"])]
            c = F.col(quoted(found[0])) if found else None
        else:
            c = F.expr(s["expression"]) if s["dialect"] == "spark" else F.col(quoted(s["expression"])) if s["expression"] in names else None
        if c is not None:
            down, first = s["sort_direction"] == "DESC", s["null_order"] == "NULLS_FIRST"
            out.append(c.desc_nulls_first() if down and first else c.desc_nulls_last() if down else c.asc_nulls_first() if first else c.asc_nulls_last())
    return out


def write_files(lake, t: TableAt, df: DataFrame, snapshot_rows: bool = False) -> list[dict]:
    """Write ``df`` (columns of the table, and the row-snapshot column with ``snapshot_rows``) and describe each file: path under the
    table's folder, rows, bytes, footer, statistics by column id and partition values."""
    stamped = [F.col(quoted(c.name)).cast(c.spark()).alias(c.name, metadata={"parquet.field.id": c.id}) for c in t.columns]
    if snapshot_rows:
        stamped.append(F.col("_row_snapshot").alias(lake.snapshot_column))
    keys = [f"__p{i}" for i in range(len(t.partition))]
    source = df
    for k, (c, how) in zip(keys, t.partition, strict=True):
        source = source.withColumn(k, transforms.encoded(transforms.apply(how, F.col(quoted(c.name)), c.kind)))
    if keys:
        # adaptive execution splits large partition values and puts small ones together; without it, files_per_partition salts them
        source = source.hint("rebalance", *keys) if lake.files_per_partition <= 1 else source.repartition(*keys, F.floor(F.rand(0) * lake.files_per_partition))
    order = sort_columns(t, set(df.columns)) if lake.option("sort_on_insert", t) != "false" else []
    out = source.select(*stamped, *keys) if not order else source.sortWithinPartitions(*keys, *order).select(*stamped, *keys)
    sub = uuid.uuid4().hex
    writer = out.write.options(**parquet_options(lake, t))
    (writer.partitionBy(*keys) if keys else writer).parquet(lake.new_folder(t.folder, sub))
    return described(lake, t, sub)


def parquet_options(lake, t: TableAt) -> dict[str, str]:
    """The writer's options from those of the table, its schema or the catalog."""
    codec = lake.option("parquet_compression", t) or "zstd"
    out = {"compression": codec}
    if (level := lake.option("parquet_compression_level", t)) and codec in ("zstd", "gzip", "brotli"):
        out[{"zstd": "parquet.compression.codec.zstd.level", "gzip": "zlib.compress.level", "brotli": "compression.brotli.quality"}[codec]] = level
    if size := lake.option("parquet_row_group_size_bytes", t):
        out["parquet.block.size"] = size
    if rows := lake.option("parquet_row_group_size", t):
        out["parquet.block.row.count.limit"] = rows
    if (version := lake.option("parquet_version", t)) in ("1", "2"):
        out["parquet.writer.version"] = f"v{version}"
    return out


def listing(lake, folder: str) -> list[tuple[str, int]]:
    """(path, bytes) of Parquet files below a folder."""
    if (local := lake.local_path(folder)) is not None:
        head = folder.removesuffix("/")  # as the caller writes it
        return [(head + os.path.join(d, f)[len(local.removesuffix("/")) :], os.path.getsize(os.path.join(d, f))) for d, _, names in os.walk(local) for f in sorted(names) if f.endswith(".parquet")]
    fs, path = lake.file_system(folder)
    out, found = [], fs.listFiles(path, True) if fs.exists(path) else None
    while found is not None and found.hasNext():
        x = found.next()
        if (name := x.getPath().toString()).endswith(".parquet"):
            out.append((name, x.getLen()))
    return out


def described(lake, t: TableAt, sub: str) -> list[dict]:
    files = []
    base = t.folder + sub
    for path, size in listing(lake, base):
        relative = path[path.index(sub) :]
        values = []
        for part in relative.split("/")[1:-1]:
            coded = unquote(part.partition("=")[2])
            values.append(None if coded == "n" else coded[1:])
        files.append({"path": relative, "relative": True, "full": path, "bytes": size, "values": values})
    stats = footers(lake, {f["full"]: f["bytes"] for f in files}, t.columns)
    for f in files:
        f |= stats[place(f["full"])]
    for f in files:
        if not f["rows"]:  # of a task without rows
            lake.remove(f["full"])
    return [f for f in files if f["rows"]]


def footers(lake, paths: dict[str, int], columns: list[Node], names: dict[int, str] | None = None, ours: bool = True) -> dict[str, dict]:
    """Statistics from Parquet footers, by place; ``paths`` gives each file's size. In files of
    Spark's writer NaN is a chunk's greatest value or its range is left out; of files that are not ``ours``, NaN is unknown. What cannot be read is unknown."""
    wanted = {(names or {}).get(c.id, c.name): c for c in columns if c.kind.startswith(RANGED) and not c.kind.startswith("interval") or c.kind == "boolean"}

    def one(path: str) -> tuple[str, dict]:
        m = metadata(lake, path, paths[path])
        out: dict[int, dict] = {}
        for i in range(m.num_columns):
            if (c := wanted.get(m.schema.column(i).path)) is None:
                continue
            low = high = None
            nulls, whole, size, nan = 0, c.kind != "boolean", 0, False
            for g in range(m.num_row_groups):
                chunk = m.row_group(g).column(i)
                size += chunk.total_compressed_size
                try:
                    s = chunk.statistics
                    if s is not None and s.has_min_max:
                        s.min, s.max
                except (NotImplementedError, ValueError, OSError):  # such as the old 96-bit timestamps
                    s = None
                if s is not None and s.has_min_max:
                    nan = nan or any(isinstance(x, float) and math.isnan(x) for x in (s.min, s.max))
                else:
                    nan = nan or s is None or not s.has_null_count or s.null_count < chunk.num_values
                if s is None or not s.has_null_count:
                    nulls = None
                elif nulls is not None:
                    nulls += s.null_count
                if s is None or not s.has_min_max:
                    if s is None or s.null_count != chunk.num_values and s.num_values:
                        whole = False
                    continue
                a, b = plain(s.min, c.kind), plain(s.max, c.kind)
                if a is None or b is None:
                    whole = False
                    continue
                low, high = a if low is None else min(low, a), b if high is None else max(high, b)
            floating = {"nan": int(nan) if ours else None} if c.kind.startswith("float") else {}
            out[c.id] = {"nulls": nulls, "min": to_text(low) if whole else None, "max": to_text(high) if whole else None, "bytes": size, **floating}
        return place(path), {"rows": m.num_rows, "footer": m.serialized_size, "stats": out}

    with ThreadPoolExecutor(16) as pool:
        return dict(pool.map(one, paths))


def plain(v, kind: str):
    """A footer's value in the catalog's terms; None if it cannot be trusted."""
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, dt.datetime) and v.tzinfo is not None:
        v = v.astimezone(dt.timezone.utc).replace(tzinfo=None)
    if kind in ("timestamp", "timestamptz", "timestamp_ns"):
        return v if isinstance(v, dt.datetime) else None
    if kind == "date":
        return v if isinstance(v, dt.date) else None
    if kind == "varchar":
        return v.decode("utf-8", "surrogateescape") if isinstance(v, bytes) else v if isinstance(v, str) else None
    return v


def metadata(lake, path: str, size: int = 0):
    """A Parquet file's footer; of a file in another store, only that part is fetched."""
    import pyarrow.parquet as pq

    if (local := lake.local_path(path)) is not None:
        return pq.read_metadata(local)
    fs, p = lake.file_system(path)
    size = size or fs.getFileStatus(p).getLen()
    read = lake.spark._jvm.org.apache.commons.io.IOUtils.toByteArray
    stream = fs.open(p)
    try:
        stream.seek(size - 8)
        tail = bytes(read(stream, 8))
        length = int.from_bytes(tail[:4], "little")
        stream.seek(size - 8 - length)
        footer = bytes(read(stream, length))
    finally:
        stream.close()
    return pq.read_metadata(pa.BufferReader(b"PAR1" + footer + tail))


def register(tx, t: TableAt, files: list[dict], begin: int | None = None, partial_max: int | None = None, mapping: int | None = None, partition_id: int | None = -1) -> list[int]:
    """Enter files, their statistics and partition values, and add to the table's totals."""
    tx.land({f["path"].split("/")[0] for f in files if f["relative"]})
    stats = tx.run("SELECT record_count, next_row_id, file_size_bytes FROM {table_stats} WHERE table_id = ?", t.id).fetchone() or (0, 0, 0)
    rows, next_row, size = stats
    part = t.partition_id if partition_id == -1 else partition_id
    ids, col_rows, val_rows, file_rows = [], [], [], []
    for f in files:
        ids.append(fid := tx.file_id())
        file_rows.append({"data_file_id": fid, "table_id": t.id, "begin_snapshot": tx.snapshot if begin is None else begin, "path": f["path"], "path_is_relative": int(f["relative"]), "file_format": "parquet", "record_count": f["rows"], "file_size_bytes": f["bytes"], "footer_size": f["footer"], "row_id_start": next_row, "partition_id": part if f["values"] else None, "partial_max": partial_max, "mapping_id": mapping})
        for c, s in f["stats"].items():
            col_rows.append({"data_file_id": fid, "table_id": t.id, "column_id": c, "value_count": f["rows"] - (s["nulls"] or 0), "null_count": s["nulls"], "min_value": s["min"], "max_value": s["max"], "contains_nan": s.get("nan"), "column_size_bytes": s.get("bytes")})
        for i, v in enumerate(f["values"]):
            val_rows.append({"data_file_id": fid, "table_id": t.id, "partition_key_index": i, "partition_value": v})
        rows, next_row, size = rows + f["rows"], next_row + f["rows"], size + f["bytes"]
    tx.insert_many("data_file", file_rows)
    tx.insert_many("file_column_stats", col_rows)
    tx.insert_many("file_partition_value", val_rows)
    tx.run("DELETE FROM {table_stats} WHERE table_id = ?", t.id)
    tx.insert("table_stats", table_id=t.id, record_count=rows, next_row_id=next_row, file_size_bytes=size)
    widen(tx, t, files)
    return ids


def widen(tx, t: TableAt, files: list[dict]) -> None:
    """Merge files' ranges into the table's."""
    kinds = {c.id: c.kind for c in t.columns}
    have = {r[0]: list(r)[1:] for r in tx.run("SELECT column_id, contains_null, min_value, max_value, contains_nan FROM {table_column_stats} WHERE table_id = ?", t.id)}
    for f in files:
        for c, s in f["stats"].items():
            nulls, low, high, nan = have.get(c, [0, None, None, s.get("nan")])
            if s.get("nan") != nan:
                nan = 1 if 1 in (nan, s.get("nan")) else None
            pick = lambda a, b, of: b if a is None else a if b is None else to_text(of(from_text(a, kinds.get(c, "")), from_text(b, kinds.get(c, "")))) if from_text(a, kinds.get(c, "")) is not None else a  # noqa: E731, B023
            have[c] = [int(bool(nulls) or bool(s["nulls"])), pick(low, s["min"], min), pick(high, s["max"], max), nan]
    tx.run("DELETE FROM {table_column_stats} WHERE table_id = ?", t.id)
    tx.insert_many("table_column_stats", [{"table_id": t.id, "column_id": c, "contains_null": n, "min_value": a, "max_value": b, "contains_nan": x} for c, (n, a, b, x) in have.items()])


def touched(positions: DataFrame, *more) -> dict[int, tuple]:
    """How many of ``positions`` (_fid, _pos) lie in each file, and other aggregates. A row a touched file."""
    return {r[0]: tuple(r)[1:] for r in positions.groupBy("_fid").agg(F.count("*").alias("n"), *more).collect()}


def write_deletes(lake, scanner: Scanner, positions: DataFrame, counts: dict[int, int] | None, files: list[dict] | None = None) -> dict[int, dict]:
    """Cumulative delete files for the data files of ``positions`` (_fid, _pos), no position twice: what is new joined to what was
    deleted before, which one scan reads for all files. Without ``counts`` (new positions by file) one job evaluates and writes:
    the old positions of all ``files`` that may be touched go along, and those that turn out to have nothing new are thrown away."""
    files = {f["data_file_id"]: f for f in (scanner.data_files() if files is None else files) if counts is None or f["data_file_id"] in counts}
    if not files:
        return {}
    old = scanner.delete_files()
    named = listed(lake.spark, [(i, scanner.path(f)) for i, f in files.items()], ["_fid", "file_path"], [pa.int64(), pa.string()])
    rows = positions.filter("_fid >= 0").select("_fid", F.col("_pos").alias("pos"))
    if before := [old[i] for i in files if i in old]:
        # each delete file belongs to one data file; paths in it do not tell which, as a file may have been added twice
        owner = listed(lake.spark, [(place(scanner.path(d)), d["data_file_id"]) for d in before], ["_of", "_fid"], [pa.string(), pa.int64()])
        gone = scanner.delete_rows(before, place_of_row().alias("_of")).join(few(owner, len(before)), "_of")
        rows = rows.unionByName(gone.select("_fid", "pos"))
    rows = rows.repartition(F.col("_fid")).sortWithinPartitions("_fid", "pos").join(few(named, len(files)), "_fid").select("_fid", "file_path", "pos")
    sub = uuid.uuid4().hex
    rows.write.option("compression", "zstd").partitionBy("_fid").parquet(lake.new_folder(scanner.t.folder, sub))
    out = {}
    for path, size in listing(lake, scanner.t.folder + sub):
        relative = path[path.index(sub) :]
        fid = int(relative.split("/")[1].partition("=")[2])
        out[fid] = {"path": relative, "bytes": size, "full": path}
    if counts is None:
        sizes = row_counts(lake, {d["full"]: d["bytes"] for d in out.values()})
    for fid, d in out.items():
        had = old[fid]["delete_count"] if fid in old else 0
        d["new"] = sizes[place(d["full"])] - had if counts is None else counts[fid]
        d["count"] = d["new"] + had
        if not d["new"]:
            lake.remove(d["full"])
    return {fid: d for fid, d in out.items() if d["new"]}


def row_counts(lake, sizes: dict[str, int]) -> dict[str, int]:
    """Rows of each file, by place."""
    with ThreadPoolExecutor(16) as pool:
        return dict(pool.map(lambda p: (place(p), metadata(lake, p, sizes[p]).num_rows), sizes))


def register_deletes(tx, t: TableAt, deletes: dict[int, dict]) -> None:
    tx.land({d["path"].split("/")[0] for d in deletes.values()})
    for fid, d in deletes.items():
        tx.end("delete_file", "data_file_id = ?", fid)
        tx.insert("delete_file", delete_file_id=tx.file_id(), table_id=t.id, begin_snapshot=tx.snapshot, data_file_id=fid, path=d["path"], path_is_relative=1, format="parquet", delete_count=d["count"], file_size_bytes=d["bytes"])


def columns_of(schema: T.StructType | dict) -> list[Node]:
    if isinstance(schema, T.StructType):
        return [from_spark(f.name, f.dataType) for f in schema.fields]
    from ..functions.types import parse

    return [parse(k, v) if isinstance(v, str) else from_spark(k, v) for k, v in schema.items()]
