"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

A small round of the operations runs before, untimed, so that the figures are those of a running session and not of a starting JVM.
"""

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def warm_up(spark, q, sink) -> None:
    rows = spark.range(2000).select(F.col("id"), (F.col("id") % 7).cast("string").alias("s"), F.rand(1).alias("v"))
    for _ in range(2):
        lake = q.fresh(spark)
        lake.create_table_as(rows, "t")
        lake.insert(rows, "t")
        sink(lake.table("t", where="id > 5"))
        lake.table("t").groupBy("s").agg(F.sum("v"), F.count("*")).collect()
        lake.delete("t", "id % 10 = 0")
        lake.update("t", {"v": F.col("v") * 2}, "id % 5 = 1")
        lake.merge("t", rows.filter("id % 2 = 0").dropDuplicates(["id"]), "id", when_matched_delete=True)
        sink(lake.table("t"))
        lake.rewrite_data_files("t")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.master": f"local[{cpus}]", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC"}
    spark = SparkSession.builder.config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    from tarn import queries as q

    times: dict[str, float] = {}

    def timed(name: str, run) -> None:
        began = time.perf_counter()
        run()
        times[name] = round(time.perf_counter() - began, 3)

    sink = lambda df: df.write.format("noop").mode("overwrite").save()
    warm_up(spark, q, sink)
    lake = q.fresh(spark)
    events = q.raw(spark, sf_dir, "events").cache()
    events.count()
    timed("ctas_lineitem", lambda: lake.create_table_as(q.raw(spark, sf_dir, "lineitem"), "lineitem"))
    timed("scan_full", lambda: sink(lake.table("lineitem")))
    timed("scan_projection_filter", lambda: sink(lake.table("lineitem", columns=["l_orderkey", "l_quantity"], where="l_quantity > 45")))
    timed("aggregation", lambda: q.over(lake, q.Q1, "lineitem").collect())
    lake.create_table("events", events.schema)
    timed("streaming_append_20", lambda: [lake.insert(events.filter(F.col("event_id") % 20 == i).coalesce(1), "events") for i in range(20)])
    timed("scan_filter_many_files", lambda: sink(lake.table("events", where="event_type = 'error'")))
    timed("read_after_write", lambda: (lake.insert(events.limit(1000), "events"), sink(lake.table("events"))))
    timed("time_travel", lambda: lake.table("events", version=lake.current_snapshot() - 10).count())
    timed("compaction", lambda: lake.rewrite_data_files("events"))
    timed("selective_delete", lambda: lake.delete("events", "event_id % 10 = 0"))
    timed("read_after_delete", lambda: sink(lake.table("events")))
    timed("bulk_update", lambda: lake.update("events", {"value": F.col("value") * 2}, "event_id % 5 = 1"))
    source = events.filter("event_id % 2 = 0").withColumn("value", F.lit(1.0))
    timed("upsert_merge", lambda: lake.merge("events", source, "event_id", when_matched_update=True))
    timed("add_column_50", lambda: [lake.add_column("events", f"c{i}", "int") for i in range(50)])
    timed("read_after_adds", lambda: sink(lake.table("events", columns=["event_id", "c1", "c49"])))
    timed("rename_column_50", lambda: [lake.rename_column("events", f"c{i}", f"d{i}") for i in range(50)])
    timed("read_after_renames", lambda: sink(lake.table("events", columns=["event_id", "d1", "d49"])))
    timed("schema_churn_50", lambda: [(lake.add_column("events", "x", "int"), lake.drop_column("events", "x")) for _ in range(50)])
    wide = events.select("event_id", *[(F.col("value") + i).alias(f"w{i}") for i in range(199)])
    lake.create_table_as(wide.coalesce(4), "wide")
    timed("wide_projection", lambda: sink(lake.table("wide", columns=["event_id", "w1", "w50", "w100", "w198"])))
    lake.create_table_as(events.coalesce(4), "cascade")
    timed("delete_cascade_20", lambda: [lake.delete("cascade", f"event_id % 20 = {i}") for i in range(20)])
    timed("cold_start", lambda: (lake.create_table_as(events.limit(50_000), "cold"), sink(q.Lake(spark, lake.catalog.path).table("cold"))))
    timed("snapshot_history", lambda: lake.list_snapshots(100))
    tables = [lake.create_table(f"t{i}", {"a": "int"}) for i in range(100)]
    timed("list_100_tables", lambda: lake._tables(0, tables[-1]))
    part = q._partitioned(spark, sf_dir, "orders", ["o_orderstatus"])
    timed("partition_pruning", lambda: sink(part.table("t", where="o_orderstatus = 'P'")))
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
