"""Queries over lake tables, and the same results as DuckDB SQL over the raw tables.

Each query builds what it needs in a fresh lake that lives as long as the process: its catalog on the driver's disk, its data in
the folder that the cluster shares (``spark.checkpoint.dir``), or beside the catalog where none is named.
"""

from __future__ import annotations

import atexit
import contextlib
import datetime as dt
import re
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .api import Lake
from .errors import LakeError
from .operators.ddl import option_value
from .sources.catalog import CONFLICTS
from .streaming.reader import ChangeReader
from .streaming.writer import batch_sink

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
_LAKES: dict[tuple, Lake] = {}


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder that all executors reach: under ``spark.checkpoint.dir``; a temporary one only on a local master without it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        path = f"{named.rstrip('/')}/tarn-{kind}-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, path)
        return path
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix=f"tarn-{kind}-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have gone before
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def fresh(spark: SparkSession) -> Lake:
    catalog = tempfile.mkdtemp(prefix="tarn-catalog-")
    atexit.register(shutil.rmtree, catalog, ignore_errors=True)
    return Lake(spark, f"{catalog}/catalog.db", shared_folder(spark, "lake"))


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def loaded(spark: SparkSession, sf_dir: str) -> Lake:
    """A lake that holds every table as it is; queries only read it."""
    key = (id(spark), sf_dir)
    if key not in _LAKES:
        lake = _LAKES[key] = fresh(spark)
        for t in "region nation customer supplier part orders lineitem events embeddings conversations".split():
            lake.create_table_as(raw(spark, sf_dir, t), t)
    return _LAKES[key]


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


Q1 = """SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS DOUBLE) AS sum_qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS sum_base, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) AS sum_disc,
round(avg(l_quantity), 6) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus"""


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = fresh(spark)
    lake.create_table_as(raw(spark, sf_dir, "lineitem"), "lineitem")
    lake.table("lineitem", where="l_shipdate <= TIMESTAMP_NTZ '1998-09-02 00:00:00'").createOrReplaceTempView("lineitem")
    return spark.sql(Q1)


def over(lake: Lake, sql: str, *tables: str) -> DataFrame:
    """SQL over lake tables."""
    for t in tables:
        lake.table(t).createOrReplaceTempView(t)
    return lake.spark.sql(sql)


# --- scans and sinks


@query("SELECT * FROM orders")
def scan_roundtrip(spark, d):
    return loaded(spark, d).table("orders")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000")
def scan_projection_filter(spark, d):
    return loaded(spark, d).table("orders", columns=["o_orderkey", "o_totalprice"], where="o_totalprice > 100000")


@query("SELECT * FROM orders")
def append_two_batches(spark, d):
    lake, o = fresh(spark), raw(spark, d, "orders")
    lake.write(o.filter("o_orderkey % 2 = 0"), "o")
    lake.write(o.filter("o_orderkey % 2 = 1"), "o", "append")
    return lake.table("o")


@query("SELECT * FROM orders WHERE o_orderstatus = 'F'")
def overwrite(spark, d):
    lake, o = fresh(spark), raw(spark, d, "orders")
    lake.write(o, "o")
    lake.write(o.filter("o_orderstatus = 'F'"), "o", "overwrite")
    return lake.table("o")


@query("SELECT * FROM nation")
def truncate_insert(spark, d):
    lake, n = fresh(spark), raw(spark, d, "nation")
    lake.write(n, "n")
    lake.truncate("n")
    lake.insert(n, "n")
    return lake.table("n")


@query("SELECT * FROM orders WHERE o_orderkey % 2 = 0")
def time_travel_version(spark, d):
    lake, o = fresh(spark), raw(spark, d, "orders")
    v = lake.create_table_as(o.filter("o_orderkey % 2 = 0"), "o")
    lake.insert(o.filter("o_orderkey % 2 = 1"), "o")
    return lake.table("o", version=v)


@query("SELECT * FROM orders WHERE o_orderkey % 2 = 0")
def time_travel_timestamp(spark, d):
    lake, o = fresh(spark), raw(spark, d, "orders")
    v = lake.create_table_as(o.filter("o_orderkey % 2 = 0"), "o")
    when = next(r["snapshot_time"] for r in lake.list_snapshots() if r["snapshot_id"] == v)
    lake.insert(o.filter("o_orderkey % 2 = 1"), "o")
    return lake.table("o", timestamp=when)


@query("SELECT * FROM customer")
def add_files(spark, d):
    lake = fresh(spark)
    lake.create_table("c", raw(spark, d, "customer").schema)
    lake.add_files("c", [f"{d}/customer.parquet"])
    return lake.table("c")


@query("SELECT c_custkey AS id, c_name, c_acctbal, CAST(NULL AS VARCHAR) AS note FROM customer WHERE c_custkey > 10 AND c_custkey % 5 <> 0")
def add_files_rename_delete(spark, d):
    lake = fresh(spark)
    lake.create_table("c", raw(spark, d, "customer").schema)
    lake.add_files("c", [f"{d}/customer.parquet"])
    lake.rename_column("c", "c_custkey", "id")
    lake.drop_column("c", "c_nationkey")
    lake.drop_column("c", "c_mktsegment")
    lake.add_column("c", "note", "varchar")
    lake.delete("c", "id <= 10")
    lake.delete("c", "id % 5 = 0")
    return lake.table("c")


@query("SELECT vec_id, label, len(embedding) AS dims, round(CAST(embedding[1] AS DOUBLE), 5) AS first FROM embeddings")
def nested_list_roundtrip(spark, d):
    return loaded(spark, d).table("embeddings").select("vec_id", "label", F.size("embedding").cast("long").alias("dims"), F.round(F.col("embedding")[0].cast("double"), 5).alias("first"))


@query("SELECT n_nationkey AS k FROM nation UNION ALL SELECT n_nationkey + 100 AS k FROM nation")
def schema_namespaces(spark, d):
    lake, n = fresh(spark), raw(spark, d, "nation")
    lake.create_schema("other")
    lake.write(n.select(F.col("n_nationkey").alias("k")), "t")
    lake.write(n.select((F.col("n_nationkey") + 100).alias("k")), "t", schema="other")
    return lake.table("t").union(lake.table("t", schema="other"))


@query("SELECT * FROM (VALUES ('created_schema', 1), ('created_table', 1), ('inserted_into_table', 3), ('deleted_from_table', 2), ('altered_table', 1)) t(kind, n)")
def snapshots_log(spark, d):
    lake, n = fresh(spark), raw(spark, d, "nation")
    lake.write(n, "n")
    lake.delete("n", "n_nationkey = 1")
    lake.update("n", {"n_name": "x"}, "n_nationkey = 2")
    lake.add_column("n", "c", "int")
    lake.insert(n.limit(1), "n")
    made = lake.snapshot_changes().select(F.explode(F.split("changes_made", ",")).alias("c"))
    return made.groupBy(F.regexp_extract("c", "^[a-z_]+", 0).alias("kind")).agg(F.count("*").cast("int").alias("n"))


@query("SELECT 'orders' AS table_name, 1 AS file_count, count(*) AS live_row_count FROM orders")
def table_info(spark, d):
    lake = fresh(spark)
    lake.create_table_as(raw(spark, d, "orders").coalesce(1), "orders")
    return lake.table_info().select("table_name", F.col("file_count").cast("int"), "live_row_count")


# --- delete, update, merge


@query("SELECT * FROM orders WHERE NOT (o_totalprice > 150000 AND o_orderstatus = 'O')")
def delete_pred(spark, d):
    lake = fresh(spark)
    lake.create_table_as(raw(spark, d, "orders"), "o")
    lake.delete("o", "o_totalprice > 150000 AND o_orderstatus = 'O'")
    return lake.table("o")


@query("SELECT * FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 2 <> 0")
def delete_repeat(spark, d):
    lake = fresh(spark)
    lake.create_table_as(raw(spark, d, "orders"), "o")
    lake.delete("o", "o_orderkey % 3 = 0")
    lake.delete("o", "o_orderkey % 3 = 0 OR o_orderkey % 2 = 0")
    return lake.table("o")


@query("SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s FROM orders WHERE NOT coalesce(nullif(o_orderstatus, 'F') = 'O', false)")
def delete_null_pred(spark, d):
    lake = fresh(spark)
    lake.create_table_as(raw(spark, d, "orders").selectExpr("o_orderkey", "nullif(o_orderstatus, 'F') AS s"), "o")
    lake.delete("o", "s = 'O'")
    return lake.table("o")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'Z' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def update_literal(spark, d):
    lake = fresh(spark)
    lake.create_table_as(raw(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o")
    lake.update("o", {"o_orderstatus": "Z"}, "o_orderkey % 10 = 0")
    return lake.table("o")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 1 THEN o_custkey * 2 ELSE o_custkey END AS o_custkey FROM orders")
def update_expr(spark, d):
    lake = fresh(spark)
    lake.create_table_as(raw(spark, d, "orders").select("o_orderkey", "o_custkey"), "o")
    lake.update("o", {"o_custkey": F.col("o_custkey") * 2}, F.col("o_orderkey") % 7 == 1)
    return lake.table("o")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'E' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 4 <> 0")
def update_then_delete(spark, d):
    lake = fresh(spark)
    lake.create_table_as(raw(spark, d, "orders").selectExpr("o_orderkey", "o_orderstatus AS s"), "o")
    lake.update("o", {"s": "E"}, "o_orderkey % 2 = 0")
    lake.delete("o", "s = 'E' AND o_orderkey % 4 = 0")
    return lake.table("o")


def _half(spark, d) -> tuple[Lake, DataFrame]:
    lake, o = fresh(spark), raw(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    lake.create_table_as(o.filter("o_orderkey % 3 <> 0"), "o")
    return lake, o.filter("o_orderkey % 2 = 0").withColumn("o_orderstatus", F.lit("M"))


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN 'M' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0")
def merge_upsert(spark, d):
    lake, source = _half(spark, d)
    lake.merge("o", source, "o_orderkey", when_matched_update=True)
    return lake.table("o")


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 2 <> 0")
def merge_matched_delete(spark, d):
    lake, source = _half(spark, d)
    lake.merge("o", source, "o_orderkey", when_matched_delete=True, when_not_matched_insert=False)
    return lake.table("o")


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 'M' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0")
def merge_insert_only(spark, d):
    lake, source = _half(spark, d)
    lake.merge("o", source, "o_orderkey")
    return lake.table("o")


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 'M' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 2 = 0")
def merge_by_source_delete(spark, d):
    lake, source = _half(spark, d)
    lake.merge("o", source, "o_orderkey", when_not_matched_by_source_delete=True)
    return lake.table("o")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey + 1 ELSE -1 END AS o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 3 <> 0")
def merge_by_source_update(spark, d):
    lake, source = _half(spark, d)
    lake.merge("o", source, "o_orderkey", when_matched_update={"o_custkey": F.col("o_custkey") + 1}, when_not_matched_insert=False, when_not_matched_by_source_update={"o_custkey": -1})
    return lake.table("o")


@query("SELECT conv_id, turn, CASE WHEN turn = 0 THEN 'first' ELSE role END AS role FROM conversations")
def merge_composite_key(spark, d):
    lake, c = fresh(spark), raw(spark, d, "conversations").select("conv_id", "turn", "role")
    lake.create_table_as(c, "c")
    lake.merge("c", c.filter("turn = 0").withColumn("role", F.lit("first")), ["conv_id", "turn"], when_matched_update=True)
    return lake.table("c")


# --- schema evolution


def _two(spark, d, change) -> Lake:
    """Nations 0-12, a change of schema, nations 13-24 under the new one."""
    lake, n = fresh(spark), raw(spark, d, "nation")
    lake.create_table_as(n.filter("n_nationkey < 13"), "n")
    change(lake, n.filter("n_nationkey >= 13"))
    return lake


@query("SELECT n_nationkey, n_name, n_regionkey, CASE WHEN n_nationkey >= 13 THEN '7' END AS extra FROM nation")
def add_column(spark, d):
    def change(lake, n):
        lake.add_column("n", "extra", "varchar", default="1")
        lake.insert(n.withColumn("extra", F.lit("7")), "n")

    return _two(spark, d, change).table("n")


@query("SELECT n_nationkey, n_regionkey FROM nation")
def drop_column(spark, d):
    def change(lake, n):
        lake.drop_column("n", "n_name")
        lake.insert(n.drop("n_name"), "n")

    return _two(spark, d, change).table("n")


@query("SELECT n_nationkey, n_name AS label, n_regionkey FROM nation WHERE n_name <> 'x'")
def rename_column(spark, d):
    def change(lake, n):
        lake.rename_column("n", "n_name", "label")
        lake.insert(n.withColumnRenamed("n_name", "label"), "n")

    return _two(spark, d, change).table("n", where="label <> 'x'")


@query("SELECT n_nationkey, n_regionkey, coalesce(CASE WHEN n_nationkey >= 13 THEN 5 END, -1) AS n_name FROM nation")
def drop_readd(spark, d):
    def change(lake, n):
        lake.drop_column("n", "n_name")
        lake.add_column("n", "n_name", "int")
        lake.insert(n.withColumn("n_name", F.lit(5)), "n")

    return _two(spark, d, change).table("n").withColumn("n_name", F.coalesce("n_name", F.lit(-1)))


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")
def set_type(spark, d):
    def change(lake, n):
        lake.set_type("n", "n_nationkey", "bigint")
        lake.set_type("n", "n_regionkey", "varchar")
        lake.insert(n, "n")

    return _two(spark, d, change).table("n")


@query("SELECT n_nationkey AS k, n_name AS a, CASE WHEN n_nationkey >= 13 THEN n_regionkey ELSE -1 END AS c FROM nation")
def struct_evolution(spark, d):
    lake, n = fresh(spark), raw(spark, d, "nation")
    lake.create_table_as(n.filter("n_nationkey < 13").selectExpr("n_nationkey AS k", "struct(n_name AS a, n_regionkey AS b) AS s"), "n")
    lake.set_type("n", "s", "struct(a text, c int, d int)")  # another number of parts: they are known by name
    lake.insert(n.filter("n_nationkey >= 13").selectExpr("n_nationkey AS k", "struct(n_name AS a, n_regionkey AS c, 0 AS d) AS s"), "n")
    return lake.table("n").select("k", "s.a", F.coalesce("s.c", F.lit(-1)).alias("c"))


@query("SELECT n_nationkey AS k, n_name AS title, n_regionkey AS b FROM nation")
def struct_rename(spark, d):
    lake, n = fresh(spark), raw(spark, d, "nation")
    lake.create_table_as(n.filter("n_nationkey < 13").selectExpr("n_nationkey AS k", "struct(n_name AS a, n_regionkey AS b) AS s"), "n")
    lake.set_type("n", "s", "struct(title text, b int)")
    lake.insert(n.filter("n_nationkey >= 13").selectExpr("n_nationkey AS k", "struct(n_name AS title, n_regionkey AS b) AS s"), "n")
    return lake.table("n").select("k", "s.title", "s.b")


@query("SELECT n_nationkey, n_name AS label, n_regionkey FROM nation WHERE NOT starts_with(n_name, 'NATION_1')")
def rename_then_delete(spark, d):
    lake = fresh(spark)
    lake.create_table_as(raw(spark, d, "nation"), "n")
    lake.rename_column("n", "n_name", "label")
    lake.delete("n", "startswith(label, 'NATION_1')")
    return lake.table("n")


# --- layout and pruning


def _partitioned(spark, d, table: str, keys: list) -> Lake:
    lake, rows = fresh(spark), raw(spark, d, table)
    lake.create_table("t", rows.schema)
    lake.set_partitioned_by("t", keys)
    lake.insert(rows, "t")
    return lake


def _pruned(lake: Lake, where: str) -> DataFrame:
    """The rows, and whether files were skipped."""
    some, every = lake.files_scanned("t", where)
    return lake.table("t", where=where).withColumn("skips", F.lit(some < every))


@query("SELECT *, true AS skips FROM orders WHERE o_orderstatus = 'F'")
def partition_identity(spark, d):
    return _pruned(_partitioned(spark, d, "orders", ["o_orderstatus"]), "o_orderstatus = 'F'")


@query("SELECT *, true AS skips FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01 00:00:00'")
def partition_year(spark, d):
    return _pruned(_partitioned(spark, d, "orders", [("o_orderdate", "year")]), "o_orderdate < '1996-01-01'")


@query("SELECT *, true AS skips FROM orders WHERE o_orderdate >= TIMESTAMP '1997-03-01 00:00:00' AND o_orderdate < TIMESTAMP '1997-04-01 00:00:00'")
def partition_month(spark, d):
    return _pruned(_partitioned(spark, d, "orders", [("o_orderdate", "month")]), "o_orderdate >= '1997-03-01' AND o_orderdate < '1997-04-01'")


@query("SELECT event_id, ts, value, true AS skips FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-06 00:00:00'")
def partition_day(spark, d):
    return _pruned(_partitioned(spark, d, "events", [("ts", "day")]), "ts >= '2024-01-05' AND ts < '2024-01-06'").select("event_id", "ts", "value", "skips")


@query("SELECT event_id, ts, true AS skips FROM events WHERE ts >= TIMESTAMP '2024-01-05 06:00:00' AND ts < TIMESTAMP '2024-01-05 08:00:00'")
def partition_hour(spark, d):
    lake, rows = fresh(spark), raw(spark, d, "events")
    lake.create_table("t", rows.schema)
    lake.set_partitioned_by("t", [("ts", "hour")])
    lake.insert(rows, "t")
    return _pruned(lake, "ts >= '2024-01-05 06:00:00' AND ts < '2024-01-05 08:00:00'").select("event_id", "ts", "skips")


@query("SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1996-06-01 00:00:00'")
def partition_evolution(spark, d):
    lake, o = fresh(spark), raw(spark, d, "orders")
    lake.create_table("t", o.schema)
    lake.set_partitioned_by("t", ["o_orderstatus"])
    lake.insert(o.filter("o_orderkey % 2 = 0"), "t")
    lake.set_partitioned_by("t", [("o_orderdate", "year")])
    lake.insert(o.filter("o_orderkey % 2 = 1"), "t")
    return lake.table("t", where="o_orderdate >= '1996-06-01'")


@query("SELECT *, true AS skips FROM orders WHERE o_orderkey = 77")
def stats_pruning(spark, d):
    lake, o = fresh(spark), raw(spark, d, "orders")
    lake.create_table("t", o.schema)
    lake.insert(o.repartitionByRange(4, "o_orderkey"), "t")
    return _pruned(lake, "o_orderkey = 77")


@query("SELECT * FROM orders WHERE o_custkey BETWEEN 10 AND 20")
def sorted_write(spark, d):
    lake, o = fresh(spark), raw(spark, d, "orders")
    lake.create_table("t", o.schema)
    lake.set_sorted_by("t", [("o_custkey", "DESC", "NULLS_FIRST")])
    lake.insert(o, "t")
    return lake.table("t", where="o_custkey BETWEEN 10 AND 20")


# --- inlined rows and the change feed


@query("SELECT * FROM nation")
def inlined_read(spark, d):
    lake, n = fresh(spark), raw(spark, d, "nation")
    lake.create_table("n", n.schema)
    lake.insert(n.filter("n_nationkey < 10"), "n", inline_limit=20)
    lake.insert(n.filter("n_nationkey >= 10"), "n", inline_limit=20)
    return lake.table("n")


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'even' ELSE n_name END AS n_name, n_regionkey FROM nation WHERE n_nationkey % 5 <> 0")
def inlined_delete_update(spark, d):
    lake, n = fresh(spark), raw(spark, d, "nation")
    lake.create_table("n", n.schema)
    lake.insert(n, "n", inline_limit=100)
    lake.delete("n", "n_nationkey % 5 = 0")
    lake.update("n", {"n_name": "even"}, "n_nationkey % 2 = 0")
    return lake.table("n")


@query("SELECT n_nationkey AS id, n_name, n_regionkey FROM nation")
def inlined_rename(spark, d):
    lake, n = fresh(spark), raw(spark, d, "nation")
    lake.create_table("n", n.schema)
    lake.insert(n, "n", inline_limit=100)
    lake.rename_column("n", "n_nationkey", "id")
    return lake.table("n")


def _story(spark, d) -> tuple[Lake, int]:
    lake, n = fresh(spark), raw(spark, d, "nation")
    start = lake.create_table_as(n.filter("n_nationkey < 10"), "n")
    lake.insert(n.filter("n_nationkey >= 10"), "n")
    lake.delete("n", "n_nationkey IN (3, 12)")
    lake.delete("n", "n_nationkey IN (3, 4, 13)")
    lake.update("n", {"n_name": "u"}, "n_nationkey = 20")
    return lake, start


_CHANGES = """SELECT 1 AS s, 'insert' AS change_type, n_nationkey, n_name FROM nation WHERE n_nationkey >= 10
UNION ALL SELECT 2, 'delete', n_nationkey, n_name FROM nation WHERE n_nationkey IN (3, 12) UNION ALL SELECT 3, 'delete', n_nationkey, n_name FROM nation WHERE n_nationkey IN (4, 13)
UNION ALL SELECT 4, 'update_preimage', n_nationkey, n_name FROM nation WHERE n_nationkey = 20 UNION ALL SELECT 4, 'update_postimage', n_nationkey, 'u' FROM nation WHERE n_nationkey = 20"""


def _numbered(df: DataFrame, start: int) -> DataFrame:
    return df.withColumn("s", (F.col("snapshot_id") - start).cast("int"))


@query("SELECT 1 AS s, n_nationkey FROM nation WHERE n_nationkey >= 10 UNION ALL SELECT 4, 20")
def cdc_inserts(spark, d):
    lake, start = _story(spark, d)
    return _numbered(lake.insertions("n", start), start).select("s", "n_nationkey")


@query("SELECT * FROM (VALUES (2, 3), (2, 12), (3, 4), (3, 13), (4, 20)) t(s, n_nationkey)")
def cdc_deletes(spark, d):
    lake, start = _story(spark, d)
    return _numbered(lake.deletions("n", start), start).select("s", "n_nationkey")


@query(_CHANGES)
def cdc_updates(spark, d):
    lake, start = _story(spark, d)
    return _numbered(lake.changes("n", start), start).select("s", "change_type", "n_nationkey", "n_name")


@query(_CHANGES)
def cdc_after_compaction(spark, d):
    lake, start = _story(spark, d)
    lake.rewrite_data_files("n")
    return _numbered(lake.changes("n", start), start).select("s", "change_type", "n_nationkey", "n_name")


# --- maintenance


@query("SELECT * FROM orders WHERE o_orderkey % 4 <> 0")
def rewrite(spark, d):
    lake, o = fresh(spark), raw(spark, d, "orders")
    lake.create_table_as(o.filter("o_orderkey % 2 = 0"), "o")
    lake.insert(o.filter("o_orderkey % 2 = 1"), "o")
    lake.delete("o", "o_orderkey % 4 = 0")
    lake.rewrite_data_files("o")
    return lake.table("o")


@query("SELECT 'now' AS at, o_orderkey FROM orders UNION ALL SELECT 'then', o_orderkey FROM orders WHERE o_orderkey % 2 = 0")
def merge_adjacent_time_travel(spark, d):
    lake, o = fresh(spark), raw(spark, d, "orders").select("o_orderkey")
    v = lake.create_table_as(o.filter("o_orderkey % 2 = 0"), "o")
    lake.insert(o.filter("o_orderkey % 2 = 1"), "o")
    lake.merge_adjacent_files("o")
    return lake.table("o").select(F.lit("now").alias("at"), "o_orderkey").union(lake.table("o", version=v).select(F.lit("then"), "o_orderkey"))


@query("SELECT * FROM nation WHERE n_nationkey % 2 = 1")
def expire_keep_last(spark, d):
    lake, n = fresh(spark), raw(spark, d, "nation")
    lake.write(n, "n")
    lake.overwrite(n.filter("n_nationkey % 2 = 1"), "n")
    lake.expire_snapshots(keep_last_n=1)
    lake.cleanup_old_files(cleanup_all=True)
    return lake.table("n")


@query("SELECT * FROM nation")
def vacuum(spark, d):
    lake, n = fresh(spark), raw(spark, d, "nation")
    lake.write(n, "n")
    n.write.parquet(lake.catalog.data_path + "main/n/stray")
    lake.vacuum()
    return lake.table("n")


# --- streams


@query("SELECT event_id, user_id, value FROM events")
def stream_writer(spark, d):
    lake, e = fresh(spark), raw(spark, d, "events").select("event_id", "user_id", "value")
    with lake.stream_writer("e", flush_threshold=3000) as w:
        for i in range(5):
            w.append(e.filter(F.col("event_id") % 5 == i))
    return lake.table("e")


@query("SELECT event_id, event_type FROM events")
def foreach_batch_sink(spark, d):
    lake = fresh(spark)
    folder = shared_folder(spark, "stream")
    schema = raw(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).select("event_id", "event_type")
    commit = batch_sink(lake, "e", "load")

    def twice(df, batch_id):  # a batch that is delivered again is committed once
        commit(df, batch_id)
        commit(df, batch_id)

    q = stream.writeStream.foreachBatch(twice).option("checkpointLocation", folder).trigger(availableNow=True).start()
    q.awaitTermination()
    return lake.table("e")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_window(spark, d):
    return loaded(spark, d).table("events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


@query("SELECT b AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS b FROM events) GROUP BY b")
def sliding_window(spark, d):
    return loaded(spark, d).table("events").groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k"""
)
def session_window(spark, d):
    return loaded(spark, d).table("events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n FROM events GROUP BY 1 HAVING start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def watermark_late_data(spark, d):
    """Hourly counts of a stream in three batches; the last one repeats rows of the first day, which come too late to count."""
    lake, folder, e = fresh(spark), shared_folder(spark, "stream"), raw(spark, d, "events").select("event_id", "ts")
    low, high = e.agg(F.min("ts"), F.max("ts")).first()
    first, second = low + (high - low) / 3, low + (high - low) / 3 * 2
    for name, rows in (("a", e.filter(F.col("ts") < first)), ("b", e.filter(F.col("ts").between(first, second))), ("c", e.filter(F.col("ts") > second).union(e.filter((F.col("ts") < low + dt.timedelta(days=1)) & (F.col("event_id") % 3 == 0))))):
        rows.coalesce(1).write.parquet(f"{folder}/{name}")
    stream = spark.readStream.schema(e.schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", 1).parquet(folder)
    # event times are instants to a watermark
    counts = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 hour").alias("w")).count().select(F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("count").alias("n"))
    lake.create_table("hours", counts.schema)
    q = counts.writeStream.outputMode("append").foreachBatch(batch_sink(lake, "hours", "hours")).option("checkpointLocation", f"{folder}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return lake.table("hours")


@query(_CHANGES)
def cdc_stream(spark, d):
    """The change feed in batches, each delivered twice and kept once."""
    lake, start = _story(spark, d)
    head = lake.current_snapshot()
    out = []
    for to in (head - 2, head, head):
        reader = ChangeReader(lake, "n", "copy", start=start)
        reader.process(lambda df, batch: out.append(df), upto=to)
    return _numbered(out[0].unionByName(out[1]), start).select("s", "change_type", "n_nationkey", "n_name")


@query("SELECT event_id, user_id FROM events WHERE event_id % 2 = 0")
def sink_after_expiry(spark, d):
    lake, e = fresh(spark), raw(spark, d, "events").select("event_id", "user_id")
    commit = batch_sink(lake, "e", "load")
    for i in range(2):
        commit(e.filter(F.col("event_id") % 4 == 2 * i), i)
    lake.expire_snapshots(keep_last_n=1)
    commit(e.filter(F.col("event_id") % 4 == 0), 0)
    return lake.table("e")


# --- definitions, inspection and errors


def _listed(spark, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _error(run) -> str:
    """The name of the error's class, and of the builtin class that it also is."""
    try:
        run()
    except (LakeError, ValueError, NotImplementedError, TypeError) as e:
        return f"{type(e).__name__}/{next(c.__name__ for c in (TypeError, ValueError, NotImplementedError, Exception) if isinstance(e, c))}"
    return "none"


def _names(lake: Lake, schema: str = "main") -> list[str]:
    return sorted(r["table_name"] for r in lake.list_tables(schema).collect())


@query("SELECT * FROM (VALUES ('before', 'a'), ('before', 'b'), ('after', 'b')) t(moment, name)")
def ddl_drop_table(spark, d):
    lake, n = fresh(spark), raw(spark, d, "nation")
    lake.write(n, "a")
    lake.write(n, "b")
    before = _names(lake)
    lake.drop_table("a")
    return _listed(spark, [("before", x) for x in before] + [("after", x) for x in _names(lake)], "moment string, name string")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_nationkey + 100, n_name FROM nation")
def ddl_rename_table(spark, d):
    lake, n = fresh(spark), raw(spark, d, "nation").select("n_nationkey", "n_name")
    v = lake.create_table_as(n.filter("n_nationkey % 2 = 0"), "old")
    lake.rename_table("old", "new")
    lake.insert(n.filter("n_nationkey % 2 = 1"), "new")
    now = lake.table("new").withColumn("n_nationkey", (F.col("n_nationkey") + 100).cast("int"))
    return lake.table("old", version=v).union(now)


@query("SELECT o_orderstatus IS NOT NULL AS partitioned, count(*) AS n FROM (SELECT DISTINCT o_orderstatus FROM orders) GROUP BY 1 UNION ALL SELECT false, 1")
def ddl_reset_partitions(spark, d):
    lake, o = fresh(spark), raw(spark, d, "orders")
    lake.create_table("t", o.schema)
    lake.set_partitioned_by("t", ["o_orderstatus"])
    lake.insert(o, "t")
    lake.reset_partitioned_by("t")
    lake.insert(o.coalesce(1), "t")
    # a large partition value is split into several files, so values are counted; files without a partition are one by one
    files = "SELECT partition_id IS NOT NULL AS p, CASE WHEN partition_id IS NULL THEN data_file_id END AS f, partition_value AS v FROM {data_file} LEFT JOIN {file_partition_value} USING (data_file_id)"
    return _listed(spark, [(r["p"], r["n"]) for r in lake.catalog.rows(f"SELECT p, count(*) AS n FROM (SELECT DISTINCT p, f, v FROM ({files}) x) y GROUP BY 1")], "partitioned int, n long").withColumn("partitioned", F.col("partitioned") == 1)


@query(
    """SELECT 'sorted' AS how, row_number() OVER (ORDER BY k DESC NULLS FIRST, o_orderkey) - 1 AS pos, k, o_orderkey FROM (SELECT nullif(o_custkey, 7) AS k, o_orderkey FROM orders)
UNION ALL SELECT 'reset', row_number() OVER (ORDER BY o_orderkey DESC) - 1, nullif(o_custkey, 7), o_orderkey FROM orders"""
)
def sort_order(spark, d):
    """The order of rows in the files themselves."""
    lake, o = fresh(spark), raw(spark, d, "orders").selectExpr("nullif(o_custkey, 7) AS k", "o_orderkey").coalesce(1)
    lake.create_table("t", o.schema)
    lake.set_sorted_by("t", [("k", "DESC", "NULLS_FIRST"), "o_orderkey"])
    lake.insert(o, "t")
    lake.reset_sorted_by("t")
    lake.insert(o.sortWithinPartitions(F.desc("o_orderkey")), "t")
    files = [r["data_file"] for r in lake.list_files("t").collect()]
    one = lambda how, f: spark.read.parquet(f).select(F.lit(how).alias("how"), F.col("_metadata.row_index").alias("pos"), "k", "o_orderkey")
    return one("sorted", files[0]).union(one("reset", files[1]))


@query("SELECT * FROM (VALUES (0, 'o_custkey', 'DESC', 'NULLS_FIRST'), (1, 'o_orderkey', 'ASC', 'NULLS_LAST')) t(sort_key_index, expression, sort_direction, null_order)")
def sort_keys(spark, d):
    lake, o = fresh(spark), raw(spark, d, "orders")
    lake.create_table("t", o.schema)
    lake.set_sorted_by("t", [("o_custkey", "DESC", "NULLS_FIRST"), "o_orderkey"])
    return lake.sort_keys("t").withColumn("sort_key_index", F.col("sort_key_index").cast("int"))


@query("SELECT * FROM (VALUES ('before', 'main'), ('before', 'side'), ('after', 'main'), ('refused', 'ValueError/ValueError')) t(moment, name)")
def ddl_drop_schema(spark, d):
    lake = fresh(spark)
    lake.create_schema("side")
    lake.write(raw(spark, d, "nation"), "n", schema="side")
    names = lambda: [r["schema_name"] for r in lake.list_schemas().collect()]
    rows = [("before", x) for x in names()] + [("refused", _error(lambda: lake.drop_schema("side")))]
    lake.drop_schema("side", cascade=True)
    return _listed(spark, rows + [("after", x) for x in names()], "moment string, name string")


@query("SELECT * FROM (VALUES ('made', 'v', 'SELECT 1'), ('replaced', 'v', 'SELECT 2'), ('dropped', NULL, NULL)) t(moment, name, sql)")
def ddl_views(spark, d):
    lake = fresh(spark)
    lake.create_view("v", "SELECT 1")
    rows = [("made", "v", lake.get_view("v")["sql"])]
    lake.create_view("v", "SELECT 2", or_replace=True)
    rows.append(("replaced", "v", lake.get_view("v")["sql"]))
    lake.drop_view("v")
    return _listed(spark, rows + [("dropped", *(None, None))] * (lake.list_views() == []), "moment string, name string, sql string")


@query("SELECT * FROM (VALUES ('add', 'scalar', 'a', 'int32', NULL), ('add', 'scalar', 'b', 'int64', '2'), ('pick', 'table', NULL, NULL, NULL)) t(name, kind, parameter, type, value)")
def ddl_macros(spark, d):
    lake = fresh(spark)
    lake.create_macro("add", "a + b", [{"name": "a", "type": "INTEGER"}, {"name": "b", "type": "BIGINT", "default": 2}])
    lake.create_macro("pick", "SELECT 1", kind="table")
    lake.create_macro("gone", "1")
    lake.drop_macro("gone")
    rows = []
    for m in lake.list_macros().collect():
        for p in lake.get_macro(m["name"])["parameters"] or [{"name": None, "type": None, "default": None}]:
            rows.append((m["name"], m["type"], p["name"], p["type"], p["default"]))
    return _listed(spark, rows, "name string, kind string, parameter string, type string, value string")


@query("SELECT * FROM (VALUES ('table', 'owner', 'me'), ('column', 'unit', 'm'), ('column', 'note', 'x')) t(on_what, key, value)")
def tags(spark, d):
    lake = fresh(spark)
    lake.write(raw(spark, d, "nation"), "n")
    for key, value in (("owner", "you"), ("owner", "me"), ("old", "x")):
        lake.set_table_tag("n", key, value)
    lake.delete_table_tag("n", "old")
    for key, value in (("unit", "m"), ("note", "x"), ("bad", "y")):
        lake.set_column_tag("n", "n_name", key, value)
    lake.delete_column_tag("n", "n_name", "bad")
    return lake.table_tags("n").withColumn("on_what", F.lit("table")).union(lake.column_tags("n", "n_name").withColumn("on_what", F.lit("column"))).select("on_what", "key", "value")


@query("SELECT * FROM (VALUES ('parquet_compression', 'snappy', NULL), ('parquet_compression', 'gzip', 'table'), ('target_file_size', '134217728', NULL), ('data_inlining_row_limit', '10', 'schema')) t(key, value, scope)")
def options(spark, d):
    lake = fresh(spark)
    lake.write(raw(spark, d, "nation"), "n")
    lake.set_option("parquet_compression", "ZSTD")
    lake.set_option("parquet_compression", "Snappy")
    lake.set_option("parquet_compression", "gzip", table="n")
    lake.set_option("target_file_size", "128MB")
    lake.set_option("data_inlining_row_limit", 10, schema="main")
    return lake.options().select("key", "value", "scope").filter("key NOT IN ('version', 'created_by', 'encrypted', 'data_path')")


@query("SELECT * FROM (VALUES ('target_file_size', '1GiB', '1073741824'), ('target_file_size', '1.5 kb', '1536'), ('hive_file_pattern', 'ON', 'true'), ('sort_on_insert', '0', 'false'), ('parquet_compression', 'LZ4_RAW', 'lz4_raw'), ('parquet_row_group_size', '-1', 'ValueError/ValueError'), ('target_file_size', '3 parsecs', 'ValueError/ValueError'), ('nonsense', '1', 'ValueError/ValueError')) t(key, given, stored)")
def option_parsing(spark, d):
    asked = [("target_file_size", "1GiB"), ("target_file_size", "1.5 kb"), ("hive_file_pattern", "ON"), ("sort_on_insert", "0"), ("parquet_compression", "LZ4_RAW"), ("parquet_row_group_size", "-1"), ("target_file_size", "3 parsecs"), ("nonsense", "1")]
    held = lambda k, v: e if (e := _error(lambda: option_value(k, v))) != "none" else option_value(k, v)
    return _listed(spark, [(k, v, held(k, v)) for k, v in asked], "key string, given string, stored string")


@query("SELECT * FROM (VALUES (1, 'snappy'), (2, 'gzip'), (3, 'inlined')) t(step, how)")
def options_act(spark, d):
    """What the writer made of the options, by its files' names."""
    lake, n = fresh(spark), raw(spark, d, "nation").coalesce(1)
    lake.create_table("n", n.schema)
    lake.set_option("parquet_compression", "snappy")
    lake.insert(n, "n")
    lake.set_option("parquet_compression", "gzip", table="n")
    lake.insert(n, "n")
    lake.set_option("data_inlining_row_limit", 1000)
    lake.insert(n, "n")
    codecs = [re.search(r"\.(snappy|gz)\.parquet$", r["data_file"])[1].replace("gz", "gzip") for r in lake.list_files("n").collect()]
    inlined = lake.table("n").count() - sum(r["record_count"] for r in lake.catalog.rows("SELECT record_count FROM {data_file}"))
    return _listed(spark, list(enumerate(codecs + ["inlined"] * (inlined == 25), 1)), "step int, how string")


@query("SELECT * FROM (VALUES (0, 'main', 'created_schema', 0), (1, 'main', 'created_table', 1), (2, 'main', 'inserted_into_table', 1), (3, 'main', 'altered_table', 2), (4, 'main', 'deleted_from_table', 2)) t(snapshot_id, schema, kind, schema_version)")
def snapshot_list(spark, d):
    lake = fresh(spark)
    lake.write(raw(spark, d, "nation"), "n")
    lake.add_column("n", "c", "int")
    lake.delete("n", "n_nationkey = 1")
    made = {r["snapshot_id"]: r["changes_made"] for r in lake.list_snapshots(10)}
    at = lake.snapshots().filter(F.col("snapshot_id") <= lake.current_snapshot()).collect()
    return _listed(spark, [(r["snapshot_id"], "main", made[r["snapshot_id"]].partition(":")[0], r["schema_version"]) for r in at], "snapshot_id int, schema string, kind string, schema_version int")


@query("SELECT * FROM (VALUES (4, 'deleted_from_table'), (3, 'inserted_into_table')) t(snapshot_id, kind)")
def snapshot_limit(spark, d):
    lake, n = fresh(spark), raw(spark, d, "nation")
    lake.write(n, "n")
    lake.insert(n, "n")
    lake.delete("n", "n_nationkey = 1")
    return _listed(spark, [(r["snapshot_id"], r["changes_made"].partition(":")[0]) for r in lake.list_snapshots(2)], "snapshot_id int, kind string")


@query("SELECT 'a' AS name, CAST(count(*) AS BIGINT) AS n, CAST(0 AS BIGINT) AS gone FROM nation UNION ALL SELECT 'b', 25, 5")
def list_files(spark, d):
    lake, n = fresh(spark), raw(spark, d, "nation").coalesce(1)
    lake.write(n, "a")
    lake.write(n, "b")
    lake.delete("b", "n_regionkey = 2")
    rows = []
    for name in _names(lake):
        files = lake.list_files(name).collect()
        held = spark.read.parquet(*[r["data_file"] for r in files]).count()
        assert all(r["data_file_size_bytes"] > 0 and (r["delete_file"] is None) == (name == "a") for r in files)
        rows.append((name, held, sum(r["delete_row_count"] for r in files)))
    return _listed(spark, rows, "name string, n long, gone long")


@query("SELECT * FROM (VALUES ('catalog_type', 'sqlite'), ('version', '1.0'), ('views', 'v'), ('tables', 'n'), ('schemas', 'main')) t(what, value)")
def catalog_inspection(spark, d):
    lake = fresh(spark)
    lake.write(raw(spark, d, "nation"), "n")
    lake.create_view("v", "SELECT 1")
    info, settings = lake.catalog_info(), lake.settings().first()
    assert settings["data_path"] == info["data_path"] and info["snapshot"] == lake.current_snapshot()
    return _listed(spark, [("catalog_type", settings["catalog_type"]), ("version", info["version"]), ("views", ",".join(lake.list_views())), ("tables", ",".join(_names(lake))), ("schemas", ",".join(r["schema_name"] for r in lake.list_schemas().collect()))], "what string, value string")


@query(
    """SELECT * FROM (VALUES ('no table', 'TableNotFoundError/ValueError'), ('no schema', 'SchemaNotFoundError/ValueError'), ('no version', 'ValueError/ValueError'), ('both times', 'ValueError/ValueError'),
('bad mode', 'ValueError/ValueError'), ('exists', 'ValueError/ValueError'), ('unknown type', 'ValueError/ValueError'), ('union type', 'UnsupportedUnionTypeError/TypeError'), ('no column', 'ValueError/ValueError'), ('bad span', 'ValueError/ValueError'),
('empty insert', 'ValueError/ValueError'), ('bad transform', 'ValueError/ValueError'), ('several matches', 'ValueError/ValueError'), ('no tag', 'ValueError/ValueError'), ('old catalog', 'CatalogVersionError/ValueError'), ('conflict', 'TransactionConflictError/Exception')) t(what, error)"""
)
def error_types(spark, d):
    lake, n = fresh(spark), raw(spark, d, "nation")
    lake.write(n, "n")
    t = lake.at("n")
    lake.delete("n", "n_nationkey = 24")

    def clash():
        with lake.catalog.transaction("delete", t.id, t.snapshot):
            pass

    def old():
        other = fresh(spark)
        other.catalog.connection().execute(other.catalog.sql("UPDATE {metadata} SET value = '0.1' WHERE key = 'version'"))
        Lake(spark, other.catalog.path)

    cases = {
        "no table": lambda: lake.table("zz"), "no schema": lambda: lake.table("n", "zz"), "no version": lambda: lake.table("n", version=99), "both times": lambda: lake.table("n", version=1, timestamp="2024-01-01"),
        "bad mode": lambda: lake.write(n, "n", "zz"), "exists": lambda: lake.write(n, "n"), "unknown type": lambda: lake.add_column("n", "c", "zz"), "union type": lambda: lake.add_column("n", "c", "union(a int, b text)"),
        "no column": lambda: lake.drop_column("n", "zz"), "bad span": lambda: lake.changes("n", 3, 2), "empty insert": lambda: lake.insert(n.limit(0), "n"), "bad transform": lambda: lake.set_partitioned_by("n", [("n_name", "year")]),
        "several matches": lambda: lake.merge("n", n.union(n), "n_nationkey", when_matched_update=True), "no tag": lambda: lake.delete_table_tag("n", "zz"), "old catalog": old, "conflict": clash,
    }
    return _listed(spark, [(k, _error(f)) for k, f in cases.items()], "what string, error string")


@query("SELECT * FROM nation WHERE false")
def empty_table(spark, d):
    lake, n = fresh(spark), raw(spark, d, "nation")
    lake.create_table("n", n.schema)
    return lake.table("n", where="n_nationkey > 3")


@query("SELECT o_orderkey, o_orderdate, CAST(o_totalprice AS DECIMAL(12,2)) AS price, o_orderkey % 2 = 0 AS even, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderkey % 50 = 1")
def inlined_types(spark, d):
    lake, o = fresh(spark), raw(spark, d, "orders").filter("o_orderkey % 50 = 1").selectExpr("o_orderkey", "o_orderdate", "CAST(o_totalprice AS DECIMAL(12,2)) AS price", "o_orderkey % 2 = 0 AS even", "CAST(o_orderdate AS DATE) AS day")
    lake.create_table("o", o.schema)
    lake.insert(o, "o", inline_limit=100_000)
    return lake.table("o")


@query("SELECT * FROM nation")
def flush_inlined(spark, d):
    lake, n = fresh(spark), raw(spark, d, "nation")
    lake.create_table("n", n.schema)
    lake.insert(n, "n", inline_limit=100)
    lake.flush_inlined("n")
    return lake.table("n", where="n_nationkey >= 0")


@query("SELECT * FROM customer")
def data_path_override(spark, d):
    lake = fresh(spark)
    lake.write(raw(spark, d, "customer"), "c")
    other = shared_folder(spark, "moved") + "/lake"
    fs, old = lake.file_system(lake.catalog.data_path)
    fs.mkdirs(spark._jvm.org.apache.hadoop.fs.Path(other).getParent())
    fs.rename(old, spark._jvm.org.apache.hadoop.fs.Path(other))
    return Lake(spark, lake.catalog.path, other).table("c")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 1 THEN 'u' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 4 <> 0")
def remote_store(spark, d):
    """A store with a scheme of its own: statistics come from one aggregate, listing and deleting go through Hadoop."""
    name, folder = f"lakes{uuid.uuid4().hex[:8]}", shared_folder(spark, "store")
    spark._jsc.hadoopConfiguration().set(f"fs.viewfs.mounttable.{name}.link./data", folder if "://" in folder else f"file://{folder}")
    lake, o = Lake(spark, fresh(spark).catalog.path, f"viewfs://{name}/data/lake"), raw(spark, d, "orders").selectExpr("o_orderkey", "o_orderstatus AS s")
    lake.write(o.filter("o_orderkey % 2 = 0"), "o")
    lake.insert(o.filter("o_orderkey % 2 = 1"), "o")
    lake.delete("o", "o_orderkey % 4 = 0")
    lake.update("o", {"s": "u"}, "o_orderkey % 4 = 1")
    lake.rewrite_data_files("o")
    return lake.table("o", where="o_orderkey >= 0")


@query("SELECT n_nationkey, n_name, CASE WHEN n_nationkey >= 13 THEN n_regionkey END AS extra FROM nation")
def schema_merge(spark, d):
    lake, n = fresh(spark), raw(spark, d, "nation")
    lake.write(n.filter("n_nationkey < 13").select("n_nationkey", "n_name"), "n")
    lake.write(n.filter("n_nationkey >= 13").withColumnRenamed("n_regionkey", "extra"), "n", "append", schema_evolution="merge")
    return lake.table("n")


_STATS = """SELECT 'o_orderkey' AS name, CAST(min(o_orderkey) AS VARCHAR) AS low, CAST(max(o_orderkey) AS VARCHAR) AS high, false AS nulls, count(*) AS n FROM orders
UNION ALL SELECT 'o_orderstatus', min(o_orderstatus), max(o_orderstatus), false, count(*) FROM orders
UNION ALL SELECT 'k', CAST(min(nullif(o_custkey, 7)) AS VARCHAR), CAST(max(nullif(o_custkey, 7)) AS VARCHAR), true, count(nullif(o_custkey, 7)) FROM orders
UNION ALL SELECT 'day', CAST(CAST(min(o_orderdate) AS DATE) AS VARCHAR), CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR), false, count(*) FROM orders"""


def _statistics(spark, d) -> tuple[Lake, dict[int, str]]:
    lake = fresh(spark)
    o = raw(spark, d, "orders").selectExpr("o_orderkey", "o_orderstatus", "nullif(o_custkey, 7) AS k", "CAST(o_orderdate AS DATE) AS day")
    lake.write(o.filter("k % 2 = 0 OR k IS NULL"), "o")
    lake.insert(o.filter("k % 2 = 1"), "o")
    return lake, {c.id: c.name for c in lake.at("o").columns}


@query(_STATS)
def table_statistics(spark, d):
    """The table's ranges, merged from those of its files."""
    lake, names = _statistics(spark, d)
    n = {r["column_id"]: r["n"] for r in lake.catalog.rows("SELECT column_id, sum(value_count) AS n FROM {file_column_stats} GROUP BY 1")}
    return _listed(spark, [(names[r["column_id"]], r["min_value"], r["max_value"], bool(r["contains_null"]), n[r["column_id"]]) for r in lake.catalog.rows("SELECT * FROM {table_column_stats}")], "name string, low string, high string, nulls boolean, n long")


@query(_STATS)
def file_statistics(spark, d):
    """The ranges of all files, put together here."""
    lake, names = _statistics(spark, d)
    rows = [(names[r["column_id"]], r["min_value"], r["max_value"], r["null_count"], r["value_count"]) for r in lake.catalog.rows("SELECT * FROM {file_column_stats}")]
    found = _listed(spark, rows, "name string, low string, high string, nulls long, n long")
    number = F.col("name").isin("o_orderkey", "k")
    least = lambda c, f: F.coalesce(f(F.when(number, F.col(c).cast("long"))).cast("string"), f(F.when(~number, F.col(c))))
    return found.groupBy("name").agg(least("low", F.min).alias("low"), least("high", F.max).alias("high"), (F.sum("nulls") > 0).alias("nulls"), F.sum("n").alias("n"))


@query("SELECT * FROM (VALUES ('x', 0, 1), ('y', 1, 2)) t(name, nan, nulls)")
def nan_flags(spark, d):
    lake = fresh(spark)
    lake.write(raw(spark, d, "nation").selectExpr("CASE WHEN n_nationkey > 0 THEN double(n_nationkey) END AS x", "CASE WHEN n_nationkey > 1 THEN IF(n_nationkey = 5, double('NaN'), 1.5D) END AS y").coalesce(1), "t")
    names = {c.id: c.name for c in lake.at("t").columns}
    return _listed(spark, [(names[r["column_id"]], r["contains_nan"], r["null_count"]) for r in lake.catalog.rows("SELECT * FROM {file_column_stats}")], "name string, nan int, nulls int")


@query("SELECT * FROM (VALUES ('date', '2024-01-02', '2024-01-03'), ('ts', '2024-01-02 03:04:05.500000', '2024-01-02 03:04:06'), ('tz', '2024-01-02 03:04:05', '2024-01-02 03:04:06'), ('dec', '1.50', '2.50'), ('s', '', 'b'), ('ok', NULL, NULL)) t(name, low, high)")
def stat_strings(spark, d):
    lake = fresh(spark)
    rows = "date'2024-01-02', timestamp_ntz'2024-01-02 03:04:05.5', timestamp'2024-01-02 03:04:05Z', 1.5, '', true", "date'2024-01-03', timestamp_ntz'2024-01-02 03:04:06', timestamp'2024-01-02 03:04:06Z', 2.5, 'b', false"
    lake.write(spark.sql(f"SELECT date, ts, tz, CAST(`dec` AS DECIMAL(9,2)) AS dec, s, ok FROM (VALUES ({rows[0]}), ({rows[1]})) t(date, ts, tz, `dec`, s, ok)").coalesce(1), "t")
    names = {c.id: c.name for c in lake.at("t").columns}
    found = {names[r["column_id"]]: (r["min_value"], r["max_value"]) for r in lake.catalog.rows("SELECT * FROM {file_column_stats}")}
    return _listed(spark, [(n, *[x and x.removesuffix("+00") for x in found.get(n, (None, None))]) for n in names.values()], "name string, low string, high string")


@query("SELECT 'delete' AS op, count(*) AS n FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT 'delete again', 0 UNION ALL SELECT 'update', count(*) FROM orders WHERE o_orderkey % 3 = 1 UNION ALL SELECT 'merge changed', count(*) FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 2 = 0 UNION ALL SELECT 'merge inserted', count(*) FROM orders WHERE o_orderkey % 6 = 0 UNION ALL SELECT 'merge nothing', 0 UNION ALL SELECT 'snapshots of nothing', 0")
def dml_counts(spark, d):
    lake, o = fresh(spark), raw(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    lake.write(o, "o")
    rows = [("delete", lake.delete("o", "o_orderkey % 3 = 0")), ("delete again", lake.delete("o", "o_orderkey % 3 = 0")), ("update", lake.update("o", {"o_orderstatus": "u"}, "o_orderkey % 3 = 1"))]
    changed, inserted = lake.merge("o", o.filter("o_orderkey % 2 = 0"), "o_orderkey", when_matched_update=True)
    before = lake.current_snapshot()
    nothing = lake.merge("o", o.filter("o_orderkey < 0"), "o_orderkey", when_matched_update=True)
    return _listed(spark, [*rows, ("merge changed", changed), ("merge inserted", inserted), ("merge nothing", sum(nothing)), ("snapshots of nothing", lake.current_snapshot() - before)], "op string, n long")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 8 < 4")
def concurrent_inserts(spark, d):
    lake, o = fresh(spark), raw(spark, d, "orders").select("o_orderkey")
    lake.create_table("o", o.schema)
    errors = []

    def add(i: int) -> None:
        try:
            lake.insert(o.filter(F.col("o_orderkey") % 8 == i), "o")
        except Exception as e:  # raised below
            errors.append(e)

    threads = [threading.Thread(target=add, args=(i,)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    if errors:
        raise errors[0]
    return lake.table("o")


def _meanwhile(lake: Lake, act) -> None:
    """``act`` commits just before the lake's next transaction opens."""
    real = lake.catalog.transaction

    def first(*args, **named):
        lake.catalog.transaction = real
        act()
        return real(*args, **named)

    lake.catalog.transaction = first


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 1 THEN 'u' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 5 <> 0")
def delete_during_rewrite(spark, d):
    lake, o = fresh(spark), raw(spark, d, "orders").selectExpr("o_orderkey", "o_orderstatus AS s")
    lake.write(o.filter("o_orderkey % 2 = 0"), "o")
    lake.insert(o.filter("o_orderkey % 2 = 1"), "o")
    _meanwhile(lake, lambda: lake.rewrite_data_files("o"))
    lake.delete("o", "o_orderkey % 5 = 0")
    _meanwhile(lake, lambda: lake.rewrite_data_files("o"))
    lake.update("o", {"s": "u"}, "o_orderkey % 3 = 1")
    return lake.table("o")


@query("SELECT o_orderkey FROM orders")
def vacuum_during_insert(spark, d):
    lake, o = fresh(spark), raw(spark, d, "orders").select("o_orderkey")
    lake.write(o.filter("o_orderkey % 2 = 0"), "o")
    _meanwhile(lake, lake.vacuum)
    lake.insert(o.filter("o_orderkey % 2 = 1"), "o")
    return lake.table("o")


@query("SELECT * FROM (VALUES " + ", ".join(f"('{ours}', '{theirs}')" for ours, theirs in (("insert", "altered,dropped"), ("delete", "altered,compacted,deleted,dropped"), ("update", "altered,compacted,deleted,dropped"), ("compact", "altered,compacted,deleted,dropped"), ("overwrite", "altered,deleted,dropped,inserted"), ("ddl", "altered,deleted,dropped,inserted"), ("drop_table", "altered,deleted,dropped,inserted"))) + ") t(ours, theirs)")
def conflict_matrix(spark, d):
    return _listed(spark, [(k, ",".join(sorted(v))) for k, v in CONFLICTS.items()], "ours string, theirs string")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (0, 1) UNION ALL SELECT n_nationkey + 100, n_name FROM nation WHERE n_nationkey <> 0")
def foreign_delete_file(spark, d):
    """A delete file of another writer that holds deletes of later snapshots too, each row with its own: now, and at the snapshot before."""
    lake, n = fresh(spark), raw(spark, d, "nation").select("n_nationkey", "n_name").coalesce(1).sortWithinPartitions("n_nationkey")
    lake.write(n, "n")
    v, t = lake.current_snapshot(), lake.at("n")
    f = lake.catalog.rows("SELECT * FROM {data_file}")[0]
    lake.set_table_tag("n", "k", "v")
    folder = shared_folder(spark, "foreign") + "/d"
    spark.createDataFrame([(t.folder + f["path"], 0, v), (t.folder + f["path"], 1, v + 1)], f"file_path string, pos long, {lake.snapshot_column} long").coalesce(1).write.parquet(folder)
    path = next(r.path for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder).select("path").collect())
    with lake.catalog.transaction("insert", None, v) as tx:
        tx.insert("delete_file", delete_file_id=tx.file_id(), table_id=t.id, begin_snapshot=v, data_file_id=f["data_file_id"], path=path, path_is_relative=0, format="parquet", delete_count=2, partial_max=v + 1)
        tx.changes.append(f"deleted_from_table:{t.id}")
    return lake.table("n").union(lake.table("n", version=v).withColumn("n_nationkey", (F.col("n_nationkey") + 100).cast("int")))


@query("SELECT n_nationkey, n_name FROM nation")
def migrate_catalog(spark, d):
    lake = fresh(spark)
    lake.write(raw(spark, d, "nation").select("n_nationkey", "n_name"), "n")
    con = lake.catalog.connection()
    for change in ("UPDATE {metadata} SET value = '0.3' WHERE key = 'version'", "ALTER TABLE {data_file} DROP COLUMN partial_max", "DROP TABLE {macro_impl}"):
        con.execute(lake.catalog.sql(change))
    old = Lake(spark, lake.catalog.path)
    assert old.migrate() == "0.3" and old.migrate() == "1.0"
    old.create_macro("one", "1")
    return old.table("n")


@query("SELECT * FROM (VALUES (true, false, 1), (false, true, 2)) t(dry, there, left_after)")
def cleanup_old_files(spark, d):
    lake, n = fresh(spark), raw(spark, d, "nation")
    lake.write(n.coalesce(1), "n")
    lake.insert(n.coalesce(1), "n")
    lake.rewrite_data_files("n")
    lake.expire_snapshots(keep_last_n=1)
    due = lake.cleanup_old_files(cleanup_all=True, dry_run=True)
    assert len(due) == 2 and lake.cleanup_old_files(older_than="2000-01-01") == []
    rows = [(False, True, len(due))]
    lake.cleanup_old_files(cleanup_all=True)
    left = lake.cleanup_old_files(cleanup_all=True, dry_run=True)
    return _listed(spark, [*rows, (True, False, lake.list_files("n").count() + len(left))], "dry boolean, there boolean, left_after int")


@query(
    """SELECT o_orderkey, CAST(o_orderkey % 100 AS TINYINT) AS i8, CAST(o_orderkey % 1000 AS SMALLINT) AS i16, CAST(o_totalprice AS FLOAT) AS f, o_totalprice AS g, CAST(o_totalprice AS DECIMAL(12,2)) AS m, o_orderkey % 2 = 0 AS b, o_orderstatus AS s,
CAST(o_orderdate AS DATE) AS day, o_orderdate AS ts, [o_custkey, o_orderkey] AS l FROM orders"""
)
def all_types_roundtrip(spark, d):
    lake = fresh(spark)
    o = raw(spark, d, "orders").selectExpr("o_orderkey", "CAST(o_orderkey % 100 AS TINYINT) AS i8", "CAST(o_orderkey % 1000 AS SMALLINT) AS i16", "CAST(o_totalprice AS FLOAT) AS f", "o_totalprice AS g", "CAST(o_totalprice AS DECIMAL(12,2)) AS m", "o_orderkey % 2 = 0 AS b", "o_orderstatus AS s", "CAST(o_orderdate AS DATE) AS day", "o_orderdate AS ts", "array(o_custkey, o_orderkey) AS l", "CAST(o_orderdate AS TIMESTAMP) AS tz", "named_struct('x', o_custkey) AS st", "map('k', o_orderkey) AS mp", "encode(o_orderstatus, 'UTF-8') AS bin", "make_dt_interval(1, 2) AS iv")
    lake.write(o, "o")
    kept = lake.table("o")
    same = kept.filter("tz = CAST(ts AS TIMESTAMP) AND st.x = l[0] AND mp['k'] = o_orderkey AND decode(bin, 'UTF-8') = s AND iv = make_dt_interval(1, 2)")
    return same.select(o.columns[:11])


@query("SELECT event_id, true AS skips FROM events WHERE ts >= TIMESTAMP '2024-01-05 08:00:00' AND ts < TIMESTAMP '2024-01-06 08:00:00'")
def timestamptz_pruning(spark, d):
    """Instants, asked for in the terms of a session eight hours behind."""
    lake, e = fresh(spark), raw(spark, d, "events").select("event_id", F.to_utc_timestamp(F.col("ts").cast("timestamp"), "UTC").alias("ts"))
    lake.create_table("e", e.schema)
    lake.insert(e.repartitionByRange(8, "ts"), "e")
    zone = spark.conf.get("spark.sql.session.timeZone")
    # the instants of the table's local times, whatever this session's zone
    shift = lambda t: (dt.datetime.fromisoformat(t) - dt.timedelta(hours=8)).isoformat(" ")
    try:
        spark.conf.set("spark.sql.session.timeZone", "-08:00")
        where = f"ts >= '{shift('2024-01-05 08:00:00')}' AND ts < timestamp'{shift('2024-01-06 08:00:00')}'"
        some, every = lake.files_scanned("e", where)
        ids = lake.table("e", where=where).select("event_id", F.lit(some < every).alias("skips"))
        return spark.createDataFrame(ids.collect(), ids.schema)  # read here, in that session's zone: the rows of a day
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


# --- host algebra over lake tables


def _sql(name: str, sql: str, *tables: str, oracle: str | None = None) -> None:
    QUERIES[name] = lambda spark, d: over(loaded(spark, d), sql, *tables)
    ORACLE[name] = oracle or sql


_sql("q1_pricing_summary", Q1, "lineitem")
_sql("q3_shipping_priority", "SELECT l_orderkey, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderdate < TIMESTAMP '1997-03-15 00:00:00' AND l_shipdate > TIMESTAMP '1997-03-15 00:00:00' GROUP BY l_orderkey, o_orderdate", "customer", "orders", "lineitem")
_sql("q5_local_supplier", "SELECT n_name, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name", "customer", "orders", "lineitem", "supplier", "nation", "region")
_sql("q6_forecast_revenue", "SELECT CAST(sum(CAST(l_extendedprice * l_discount AS DECIMAL(18,4))) AS DOUBLE) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.02 AND 0.07 AND l_quantity < 24", "lineitem")
_sql("semi_join", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000)", "customer", "orders")
_sql("anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)", "customer", "orders")
_sql("rank_lag_windows", "SELECT o_custkey, o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r, coalesce(lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), -1) AS prev FROM orders", "orders")
_sql("cube_counts", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)", "orders")
_sql("rollup_counts", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", "lineitem")
_sql("set_operations", "(SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer) UNION ALL (SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier)", "supplier", "customer", "nation")
_sql("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25", "orders")
_sql("count_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag", "lineitem")
_sql("json_props", "SELECT event_type, sum(CAST(get_json_object(props, '$.k') AS BIGINT)) AS k FROM events GROUP BY event_type", "events", oracle="SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY event_type")
_sql("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem", "lineitem")


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY o_orderstatus")
def stored_view(spark, d):
    lake = fresh(spark)
    lake.create_table_as(raw(spark, d, "orders"), "orders")
    lake.create_view("big", "SELECT o_orderstatus, count(*) FROM orders WHERE o_totalprice > 1000 GROUP BY o_orderstatus", column_aliases=["status", "n"])
    return lake.view("big")


@query("SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth FROM orders")
def row_numbers(spark, d):
    return loaded(spark, d).table("orders").select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long").alias("nth"))
