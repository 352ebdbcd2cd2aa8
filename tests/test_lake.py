import datetime as dt
import random
import threading

import pytest
from pyspark.sql import functions as F

from tarn import Lake
from tarn.errors import TableNotFoundError, TransactionConflictError
from tarn.functions.types import parse
from tarn.operators.ddl import option_value
from tarn.sources.catalog import CONFLICTS
from tarn.streaming.writer import batch_sink


@pytest.fixture
def lake(spark, tmp_path):
    return Lake(spark, str(tmp_path / "c.db"))


@pytest.fixture(params=["c.db", "c.duckdb"])
def any_lake(spark, tmp_path, request):
    return Lake(spark, str(tmp_path / request.param))


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def kv(spark, *pairs):
    return spark.createDataFrame(list(pairs), "id long, v string")


@pytest.mark.parametrize("text", ["int32", "decimal(10,2)", "list(varchar)", 'struct("a b" int32, "c" list(map(varchar, int64)))', "map(varchar, struct(\"x\" float64))"])
def test_types_round_trip(text):
    assert parse("c", text).text() == text


def test_type_aliases():
    assert [parse("c", x).text() for x in ("TINYINT", "text", "VARCHAR(20)", "numeric", "int[]", "TIMESTAMP WITH TIME ZONE")] == ["int8", "varchar", "varchar", "decimal(18,3)", "list(int32)", "timestamptz"]
    with pytest.raises(ValueError, match="Unknown type"):
        parse("c", "nonsense")


def test_write_modes_and_snapshots(spark, any_lake):
    lake = any_lake
    lake.write(kv(spark, (1, "a")), "t")
    assert lake.current_snapshot() == 2
    with pytest.raises(ValueError, match="already exists"):
        lake.write(kv(spark, (1, "a")), "t")
    lake.write(kv(spark, (2, "")), "T", "append")
    lake.write(kv(spark, (3, None)), "t", "append")
    assert rows(lake.table("t")) == [(1, "a"), (2, ""), (3, None)]
    assert rows(lake.table("t", version=2)) == [(1, "a")]
    with pytest.raises(ValueError, match="Cannot specify both"):
        lake.table("t", version=1, timestamp="2024-01-01")
    with pytest.raises(ValueError, match="not found"):
        lake.table("t", version=99)
    with pytest.raises(TableNotFoundError):
        lake.table("nope")
    with pytest.raises(ValueError, match="Schema mismatch"):
        lake.insert(kv(spark, (1, "a")).withColumn("x", F.lit(1)), "t")


def test_noop_changes_make_no_snapshot(spark, lake):
    lake.write(kv(spark, (1, "a"), (2, None)), "t")
    s = lake.current_snapshot()
    assert lake.delete("t", "v = 'zz'") == 0
    assert lake.update("t", {"v": "q"}, "id > 5") == 0
    assert lake.merge("t", kv(spark, (1, "b")), "id", when_not_matched_insert=False) == (0, 0)
    assert lake.current_snapshot() == s


def test_merge_rules(spark, lake):
    lake.write(kv(spark, (1, "a"), (2, "b"), (None, "n")), "t")
    with pytest.raises(ValueError, match="mutually exclusive"):
        lake.merge("t", kv(spark, (1, "x")), "id", when_matched_update=True, when_matched_delete=True)
    assert lake.merge("t", kv(spark, (1, "x"), (None, "m"), (7, "new")), "id", when_matched_update=True) == (2, 1)
    assert rows(lake.table("t")) == [(1, "x"), (2, "b"), (7, "new"), (None, "m")]


def test_partition_values_and_null(spark, lake):
    d = spark.createDataFrame([(1, dt.date(2024, 1, 15), "US/x=1"), (2, dt.date(1970, 1, 5), None), (3, None, "")], "i int, d date, s string")
    lake.create_table("t", d.schema)
    lake.set_partitioned_by("t", [("d", "year"), "s"])
    lake.insert(d, "t")
    values = {r["partition_value"] for r in lake.catalog.rows("SELECT partition_value FROM {file_partition_value} WHERE partition_key_index = 0")}
    assert values == {"54", "0", None}
    assert rows(lake.table("t")) == rows(d)
    assert rows(lake.table("t", where="s IS NULL")) == [(2, dt.date(1970, 1, 5), None)]
    assert lake.files_scanned("t", "s = ''") == (1, 3)
    assert lake.delete("t", "i = 1") == 1
    assert len(rows(lake.table("t"))) == 2
    with pytest.raises(ValueError, match="Unsupported partition transform"):
        lake.set_partitioned_by("t", [("d", "bucket")])
    with pytest.raises(ValueError, match="requires a date/timestamp column"):
        lake.set_partitioned_by("t", [("i", "year")])


def test_pruning_is_sound_for_nan_and_null(spark, lake):
    d = spark.createDataFrame([(1, float("nan")), (2, 1.0), (3, None), (4, float("inf"))], "i int, x double")
    lake.create_table("t", d.schema)
    for i in range(1, 5):
        lake.insert(d.filter(f"i = {i}"), "t")
    for where in ("x > 5", "x = 1.0", "x < 5", "x IS NULL", "x IS NOT NULL", "i BETWEEN 2 AND 3", "i IN (1, 4)", "NOT i = 2", "x >= 1 OR i = 3", "abs(i) = 2", "4 <= i"):
        assert rows(lake.table("t", where=where).select("i")) == rows(d.filter(where).select("i")), where
    assert lake.files_scanned("t", "i = 2") == (1, 4)


def test_added_file_twice_and_deletes(spark, lake, tmp_path):
    kv(spark, (1, "a"), (2, "b")).coalesce(1).write.parquet(str(tmp_path / "x"))
    f = str(next((tmp_path / "x").glob("part*.parquet")))
    lake.create_table("t", {"id": "bigint", "v": "varchar"})
    lake.add_files("t", [f, f])
    assert len(rows(lake.table("t"))) == 4
    assert lake.delete("t", "id = 1") == 2
    assert rows(lake.table("t")) == [(2, "b"), (2, "b")]
    with pytest.raises(ValueError, match="must not be empty"):
        lake.add_files("t", [])
    lake.create_table("u", {"id": "int"})
    with pytest.raises(ValueError, match="Schema mismatch"):
        lake.add_files("u", [f])


def test_conflict_matrix_and_retry(spark, lake):
    golden = {"insert": (0, 0, 1, 1), "delete": (0, 1, 1, 1), "update": (0, 1, 1, 1), "overwrite": (1, 1, 1, 1), "ddl": (1, 1, 1, 1), "drop_table": (1, 1, 1, 1)}
    assert {k: tuple(int(x in CONFLICTS[k]) for x in ("inserted", "deleted", "altered", "dropped")) for k in golden} == golden
    lake.write(kv(spark, (1, "a")), "t")
    t = lake.at("t")
    lake.delete("t", "id = 1")
    with pytest.raises(TransactionConflictError), lake.catalog.transaction("delete", t.id, t.snapshot):
        pass
    errors = []

    def add(i):
        try:
            lake.insert(kv(spark, (i, "x")), "t")
        except Exception as e:  # reported below
            errors.append(e)

    threads = [threading.Thread(target=add, args=(i,)) for i in range(4)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert not errors and len(rows(lake.table("t"))) == 4


def test_inlined_rows_types(spark, any_lake):
    lake = any_lake
    d = spark.sql("SELECT 1 AS i, true AS b, date'2024-01-02' AS d, cast(1.50 AS decimal(10,2)) AS m, timestamp_ntz'2024-01-02 03:04:05.5' AS ts, array(1, 2) AS a, struct('x' AS p) AS s, double('NaN') AS f")
    lake.create_table("t", d.schema)
    lake.insert(d, "t", inline_limit=5)
    assert str(lake.table("t").collect()) == str(d.collect())
    assert lake.flush_inlined("t") > 0
    assert str(lake.table("t").collect()) == str(d.collect())
    assert lake.changes("t").count() == 1


def test_views_macros_tags_options(spark, any_lake):
    lake = any_lake
    lake.write(kv(spark, (1, "a")), "t")
    lake.create_view("w", "SELECT id + 1 AS x FROM t")
    assert lake.view("w").collect()[0][0] == 2 and lake.list_views() == ["w"]
    with pytest.raises(ValueError, match="already exists"):
        lake.create_view("w", "SELECT 1")
    lake.drop_view("w")
    lake.create_macro("m", "a + 1", [{"name": "a", "type": "INT", "default": 2}])
    assert lake.get_macro("m")["parameters"][0]["type"] == "int32"
    lake.drop_macro("m")
    version = lake.list_snapshots(1)[0]["schema_version"]
    lake.set_table_tag("t", "k", "v")
    lake.set_column_tag("t", "id", "k", "v")
    assert lake.list_snapshots(1)[0]["schema_version"] == version
    assert rows(lake.table_tags("t")) == rows(lake.column_tags("t", "id")) == [("k", "v")]
    with pytest.raises(ValueError, match="not found"):
        lake.delete_table_tag("t", "zz")
    assert option_value("target_file_size", "1GiB") == str(1 << 30)
    with pytest.raises(ValueError, match="Unsupported option"):
        lake.set_option("nope", 1)
    with pytest.raises(ValueError, match="not empty"):
        lake.drop_schema("main")


def test_expiry_arguments_and_missing_files(spark, lake):
    lake.write(kv(spark, (1, "a")), "t")
    for args, text in (({}, "Must specify either"), ({"keep_last_n": 1, "older_than_snapshot": 1}, "Cannot specify both"), ({"keep_last_n": 0}, "must be >= 1")):
        with pytest.raises(ValueError, match=text):
            lake.expire_snapshots(**args)
    lake.remove(lake.list_files("t").collect()[0]["data_file"])
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        lake.table("t").collect()


def test_batch_sink_commits_once(spark, any_lake):
    lake = any_lake
    commit = batch_sink(lake, "t", "q")
    commit(kv(spark, (1, "a")), 0)
    commit(kv(spark, (1, "a")), 0)
    commit(kv(spark, (2, "b")), 1)
    assert rows(lake.table("t")) == [(1, "a"), (2, "b")]


@pytest.mark.parametrize("few", [1000, -1])
def test_random_story_against_a_model(spark, any_lake, monkeypatch, few):
    lake = any_lake
    monkeypatch.setattr("tarn.operators.files.FEW_POSITIONS", few)
    """Every snapshot after every step reads as an in-memory model says; compaction changes none."""
    rng = random.Random(5)
    lake.create_table("t", {"id": "bigint", "v": "varchar"})
    now: list[tuple] = []
    past = {lake.current_snapshot(): []}
    for step in range(14):
        act = rng.choice(["insert", "insert", "inline", "delete", "update", "merge", "rewrite", "adjacent", "column"])
        some = [(rng.randint(0, 12), f"s{step}")]
        if act in ("insert", "inline"):
            lake.insert(kv(spark, *some, (step, "q")), "t", inline_limit=6 if act == "inline" else 0)
            now = now + some + [(step, "q")]
        elif act == "delete":
            lake.delete("t", f"id % 4 = {step % 4}")
            now = [r for r in now if r[0] % 4 != step % 4]
        elif act == "update":
            lake.update("t", {"v": "up"}, "id % 3 = 1")
            now = [(i, "up" if i % 3 == 1 else v) for i, v in now]
        elif act == "merge":
            lake.merge("t", kv(spark, *some), "id", when_matched_update=True)
            k = some[0][0]
            now = [some[0] if i == k else (i, v) for i, v in now] if any(i == k for i, _ in now) else now + some
        elif act == "rewrite":
            lake.rewrite_data_files("t")
        elif act == "adjacent":
            lake.merge_adjacent_files("t")
        else:
            lake.add_column("t", f"x{step}", "int")
        past[lake.current_snapshot()] = list(now)
    for s, want in past.items():
        assert rows(lake.table("t", version=s).select("id", "v")) == sorted(want, key=repr), s


def test_partition_hour_loads_all_events(spark, monkeypatch):
    from tarn import queries

    made, fresh, d = [], queries.fresh, "/root/testdata/sf0.01"
    monkeypatch.setattr(queries, "fresh", lambda s: made.append(fresh(s)) or made[-1])
    events = queries.raw(spark, d, "events")
    assert queries.partition_hour(spark, d).filter("skips").count() == events.filter("ts >= '2024-01-05 06:00:00' AND ts < '2024-01-05 08:00:00'").count()
    assert made[0].table("t").count() == events.count()


def interloper(lake, monkeypatch, act):
    """``act`` commits just before the next transaction opens."""
    real, done = lake.catalog.transaction, []

    def first(*args, **named):
        if not done:
            done.append(1)
            act()
        return real(*args, **named)

    monkeypatch.setattr(lake.catalog, "transaction", first)
    return done


@pytest.mark.parametrize("compact", ["rewrite_data_files", "merge_adjacent_files", "flush_inlined"])
@pytest.mark.parametrize("change", ["delete", "update", "merge"])
def test_changes_are_not_lost_to_a_compaction(spark, lake, monkeypatch, compact, change):
    inline = 9 if compact == "flush_inlined" else 0
    lake.create_table("t", {"id": "bigint", "v": "varchar"})
    for i in range(3):
        lake.insert(kv(spark, (i, "a"), (i + 10, "b")), "t", inline_limit=inline)
    done = interloper(lake, monkeypatch, lambda: getattr(lake, compact)("t"))
    if change == "delete":
        assert lake.delete("t", "id = 1") == 1
        want = [(0, "a"), (2, "a"), (10, "b"), (11, "b"), (12, "b")]
    elif change == "update":
        assert lake.update("t", {"v": "x"}, "id = 1") == 1
        want = [(0, "a"), (1, "x"), (2, "a"), (10, "b"), (11, "b"), (12, "b")]
    else:
        assert lake.merge("t", kv(spark, (1, "x"), (77, "n")), "id", when_matched_update=True) == (1, 1)
        want = [(0, "a"), (1, "x"), (2, "a"), (10, "b"), (11, "b"), (12, "b"), (77, "n")]
    assert done and rows(lake.table("t")) == sorted(want, key=repr)
    assert not lake.catalog.in_flight() and lake.vacuum(dry_run=True) == []  # the losing attempt has left nothing


def test_compaction_keeps_what_was_inserted_meanwhile(spark, lake, monkeypatch):
    lake.create_table("t", {"id": "bigint", "v": "varchar"})
    for i in range(3):
        lake.insert(kv(spark, (i, "a")), "t", inline_limit=9)
    interloper(lake, monkeypatch, lambda: lake.insert(kv(spark, (9, "z")), "t", inline_limit=9))
    lake.flush_inlined("t")
    assert rows(lake.table("t")) == [(0, "a"), (1, "a"), (2, "a"), (9, "z")]
    monkeypatch.undo()
    lake.insert(kv(spark, (5, "q")), "t")
    interloper(lake, monkeypatch, lambda: lake.insert(kv(spark, (6, "r")), "t"))
    lake.rewrite_data_files("t")
    assert len(rows(lake.table("t"))) == 6
    assert lake.catalog.rows("SELECT record_count FROM {table_stats}")[0]["record_count"] >= 5


def test_vacuum_spares_writes_in_flight(spark, any_lake, monkeypatch, tmp_path):
    lake = any_lake
    lake.write(kv(spark, (1, "a")), "t")
    seen = []
    interloper(lake, monkeypatch, lambda: seen.append(lake.vacuum()))
    lake.insert(kv(spark, (2, "b")), "t")
    assert seen == [[]] and rows(lake.table("t")) == [(1, "a"), (2, "b")]
    monkeypatch.undo()
    # a vacuum that takes the write for dead: it runs again
    interloper(lake, monkeypatch, lambda: seen.append(lake.vacuum(spare_hours=0)))
    lake.insert(kv(spark, (3, "c")), "t")
    assert len(seen[1]) >= 1 and rows(lake.table("t")) == [(1, "a"), (2, "b"), (3, "c")]
    monkeypatch.undo()
    kv(spark, (9, "x")).write.parquet(str(tmp_path / "data/main/t/stray"))
    assert len(lake.vacuum()) >= 1 and lake.vacuum() == []


def test_sink_remembers_batches_after_expiry(spark, lake):
    commit = batch_sink(lake, "t", "q")
    commit(kv(spark, (1, "a")), 0)
    commit(kv(spark, (2, "b")), 1)
    lake.expire_snapshots(keep_last_n=1)
    commit(kv(spark, (1, "a")), 0)
    commit(kv(spark, (2, "b")), 1)
    batch_sink(lake, "t", "other")(kv(spark, (3, "c")), 1)
    assert rows(lake.table("t")) == [(1, "a"), (2, "b"), (3, "c")]


@pytest.mark.parametrize("zone", ["UTC", "America/Los_Angeles"])
def test_timestamps_in_any_zone(spark, lake, zone):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        d = spark.range(6).selectExpr("id", "timestamp'2024-01-04 22:00:00' + make_interval(0, 0, 0, 0, CAST(id AS INT)) AS ts", "timestamp_ntz'2024-01-04 22:00:00' + make_interval(0, 0, 0, 0, CAST(id AS INT)) AS n")
        lake.create_table("t", d.schema)
        for i in range(6):
            lake.insert(d.filter(f"id = {i}"), "t")
        assert str(lake.table("t").orderBy("id").collect()) == str(d.orderBy("id").collect())
        assert lake.catalog.rows("SELECT count(*) AS n FROM {file_column_stats} WHERE min_value IS NOT NULL")[0]["n"] == 18
        for where in ("ts < '2024-01-05 00:00:00'", "ts >= timestamp'2024-01-05 01:00:00'", "ts = '2024-01-05 00:00:00'", "ts < date'2024-01-05'", "n < '2024-01-05 00:00:00'", "n < timestamp'2024-01-05 00:00:00'", "ts > timestamp_ntz'2024-01-05 00:30:00'", "ts BETWEEN '2024-01-04 23:00:00' AND '2024-01-05 00:00:00'", "ts IN ('2024-01-05 02:00:00')", "ts < '2024-01-05 08:00:00Z'"):
            assert rows(lake.table("t", where=where)) == rows(d.filter(where)), where
        assert lake.files_scanned("t", "ts < '2024-01-05 00:00:00'") == (2, 6)
        assert lake.update("t", {"n": F.col("ts").cast("timestamp_ntz")}, "id = 3") == 1 and lake.delete("t", "ts > '2024-01-05 01:30:00'") == 2
        lake.create_table("p", d.schema)
        lake.set_partitioned_by("p", ["ts"])
        lake.insert(d, "p")
        assert rows(lake.table("p", where="ts = '2024-01-05 00:00:00'")) == rows(d.filter("ts = '2024-01-05 00:00:00'"))
        assert len(rows(lake.table("p"))) == 6
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_files_with_old_timestamps_can_be_added(spark, lake, tmp_path):
    spark.conf.set("spark.sql.parquet.outputTimestampType", "INT96")
    d = spark.sql("SELECT 1L AS id, timestamp'2024-01-04 22:00:00' AS ts")
    d.coalesce(1).write.parquet(str(tmp_path / "x"))
    spark.conf.set("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS")
    lake.create_table("t", d.schema)
    lake.add_files("t", [str(next((tmp_path / "x").glob("part*.parquet")))])
    assert str(lake.table("t", where="ts > '2024-01-01'").collect()) == str(d.collect())


def test_merge_refuses_several_source_rows_for_one(spark, lake):
    lake.write(kv(spark, (1, "a"), (2, "b")), "t")
    with pytest.raises(ValueError, match="several rows"):
        lake.merge("t", kv(spark, (1, "x"), (1, "y")), "id", when_matched_update=True)
    assert lake.merge("t", kv(spark, (1, "x"), (1, "y"), (5, "p"), (5, "q")), "id", when_matched_delete=True) == (1, 2)
    assert rows(lake.table("t")) == [(2, "b"), (5, "p"), (5, "q")]
    assert lake.merge("t", kv(spark, (2, "z"), (6, "r")), "id", when_matched_update={}) == (1, 1)
    assert lake.merge("t", kv(spark, (2, "z"), (9, "s")), "id", when_matched_update={"v": "y"}, when_not_matched_by_source_update={"v": "w"}) == (4, 1)
    assert rows(lake.table("t")) == [(2, "y"), (5, "w"), (5, "w"), (6, "w"), (9, "s")]


def test_options_act(spark, lake, tmp_path):
    import pyarrow.parquet as pq

    lake.set_option("parquet_compression", "snappy")
    lake.write(kv(spark, (3, "a"), (1, "b"), (2, None)).coalesce(1), "t")
    lake.set_option("parquet_compression", "gzip", table="t")
    lake.set_sorted_by("t", [("id", "DESC", "NULLS_FIRST")])
    lake.insert(kv(spark, (7, "a"), (8, "b"), (None, "c")).coalesce(1), "t")
    lake.set_option("sort_on_insert", "false", table="t")
    lake.insert(kv(spark, (7, "a"), (8, "b"), (None, "c")).coalesce(1), "t")
    files = [r["data_file"] for r in lake.list_files("t").collect()]
    assert [pq.read_metadata(f).row_group(0).column(0).compression for f in files] == ["SNAPPY", "GZIP", "GZIP"]
    assert [pq.read_table(f).column(0).to_pylist() for f in files[1:]] == [[None, 8, 7], [7, 8, None]]
    lake.set_option("data_inlining_row_limit", 10)
    lake.insert(kv(spark, (5, "x")), "t")
    assert lake.list_files("t").count() == 3 and len(rows(lake.table("t"))) == 10
    lake.set_option("require_commit_message", "yes")
    with pytest.raises(ValueError, match="commit message"):
        lake.insert(kv(spark, (5, "x")), "t")
    lake.insert(kv(spark, (6, "x")), "t", message="six")
    for key, value in (("auto_compact", True), ("write_deletion_vectors", "off"), ("parquet_compression", "lz4_raw"), ("parquet_version", 2)):
        lake.set_option(key, value)


def test_statistics_of_files(spark, lake):
    d = spark.createDataFrame([(1, 1.5, float("nan")), (2, 2.5, 3.0), (3, None, None)], "i int, a double, b double")
    lake.write(d.coalesce(1), "t")
    got = {r["column_id"]: (r["contains_nan"], r["null_count"], r["min_value"], r["column_size_bytes"] > 0) for r in lake.catalog.rows("SELECT * FROM {file_column_stats}")}
    assert got == {1: (None, 0, "1", True), 2: (0, 1, "1.5", True), 3: (1, 1, None, True)}
    assert {r["column_id"]: r["contains_nan"] for r in lake.catalog.rows("SELECT * FROM {table_column_stats}")} == {1: None, 2: 0, 3: 1}


def test_foreign_cumulative_delete_file(spark, lake, tmp_path):
    """A delete file of another writer may hold deletes of later snapshots, each row with its own."""
    lake.write(kv(spark, *[(i, "a") for i in range(6)]).coalesce(1), "t")
    s, t = lake.current_snapshot(), lake.at("t")
    f = lake.catalog.rows("SELECT * FROM {data_file}")[0]
    full = t.folder + f["path"]
    for _ in range(2):
        lake.set_table_tag("t", "k", "v")
    frame = spark.createDataFrame([(full, 0, s), (full, 1, s + 2)], f"file_path string, pos long, {lake.snapshot_column} long")
    frame.coalesce(1).write.parquet(str(tmp_path / "d"))
    path = str(next((tmp_path / "d").glob("part*.parquet")))
    lake.catalog.connection().execute(lake.catalog.sql("INSERT INTO {delete_file} (delete_file_id, table_id, begin_snapshot, data_file_id, path, path_is_relative, format, delete_count, partial_max) VALUES (900, ?, ?, ?, ?, 0, 'parquet', 2, ?)"), (t.id, s, f["data_file_id"], path, s + 2))
    assert [r[0] for r in rows(lake.table("t", version=s))] == [1, 2, 3, 4, 5]
    assert [r[0] for r in rows(lake.table("t"))] == [2, 3, 4, 5]


def test_types_of_foreign_catalogs(spark, lake):
    assert [parse("c", x).kind for x in ("BIT", "UNKNOWN", "UINT", "TIME WITH TIME ZONE", "POINT", "MULTIPOLYGON_ZM")] == ["bit", "unknown", "uint32", "time", "geometry", "geometry"]
    from tarn.errors import UnsupportedUnionTypeError

    with pytest.raises(UnsupportedUnionTypeError):
        parse("c", "UNION(a INT, b VARCHAR)")
    with pytest.raises(TypeError):
        lake.write(spark.sql("SELECT parse_json('1') AS v"), "t")


def test_migration_can_be_undone_and_repeated(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "m.db"))
    lake.write(kv(spark, (1, "a")), "t")
    con = lake.catalog.connection()
    con.execute(lake.catalog.sql("UPDATE {metadata} SET value = '0.3' WHERE key = 'version'"))
    con.execute(lake.catalog.sql("ALTER TABLE {data_file} DROP COLUMN partial_max"))
    con.execute(lake.catalog.sql("DROP TABLE {macro_impl}"))
    old = Lake(spark, str(tmp_path / "m.db"))
    assert old.catalog.version == "0.3"
    with pytest.raises(ValueError, match="0.4"):
        old.merge_adjacent_files("t")
    assert old.migrate() == "0.3" and old.migrate() == "1.0"
    assert rows(old.table("t")) == [(1, "a")]
    con.execute(lake.catalog.sql("UPDATE {metadata} SET value = '0.4' WHERE key = 'version'"))
    assert Lake(spark, str(tmp_path / "m.db"), automatic_migration=True).catalog.version == "1.0"


def test_catalogs_by_prefix_and_content(spark, tmp_path):
    lake = Lake(spark, f"duckdb:{tmp_path}/plain")
    lake.write(kv(spark, (1, "a")), "t")
    lake.merge("t", kv(spark, (1, "b"), (2, "c")), "id", when_matched_update=True)
    again = Lake(spark, f"{tmp_path}/plain")  # by its first bytes
    assert again.settings().first()["catalog_type"] == "duckdb" and rows(again.table("t")) == [(1, "b"), (2, "c")]
    assert again.expire_snapshots(keep_last_n=1) > 0 and again.cleanup_old_files(cleanup_all=True) is not None
    assert Lake(spark, f"sqlite:{tmp_path}/s").settings().first()["catalog_type"] == "sqlite"
    for path in ("postgres://x/y", "host=a dbname=b"):
        with pytest.raises(NotImplementedError):
            Lake(spark, path)


@pytest.mark.parametrize("bits", [10**9, 0])
def test_many_deletes_as_bitmaps_or_shuffled(spark, lake, monkeypatch, bits):
    from tarn.plans import scan

    d = spark.range(100_000).withColumn("v", F.col("id") % 97)
    lake.write(d.coalesce(2), "t")
    lake.delete("t", "id % 7 = 3 OR id BETWEEN 32760 AND 32780 OR id = 0")
    lake.delete("t", "v = 5")
    want = d.filter("NOT (id % 7 = 3 OR id BETWEEN 32760 AND 32780 OR id = 0) AND v <> 5")
    assert lake.table("t").exceptAll(want).isEmpty() and lake.table("t").count() == want.count()
    monkeypatch.setattr(scan, "BROADCAST_DELETES", 10)
    monkeypatch.setattr(scan, "BROADCAST_BITS", bits)
    plan = lake.table("t")._jdf.queryExecution().optimizedPlan().toString()
    assert ("bitmap_construct_agg" in plan) == (bits > 0)
    assert lake.table("t").exceptAll(want).isEmpty() and lake.table("t").count() == want.count()
    assert lake.update("t", {"v": -1}, "id < 50000") == want.filter("id < 50000").count()


def test_stream_writer_computes_frames_once(spark, lake):
    calls = spark.sparkContext.accumulator(0)

    def seen(it):
        for x in it:
            calls.add(1)
            yield x

    df = spark.createDataFrame(spark.sparkContext.parallelize([(i, "a") for i in range(20)], 2).mapPartitions(seen), "id long, v string")
    with lake.stream_writer("t", flush_threshold=5) as w:
        w.append(df)
    assert calls.value == 20 and w.total_rows == 20 and w.flush_count == 1 and lake.table("t").count() == 20


def test_reset_partitions_where_values_fill_several_files(spark, monkeypatch):
    from tarn import queries

    made, fresh = [], queries.fresh
    monkeypatch.setattr(queries, "fresh", lambda s: made.append(fresh(s)) or setattr(made[-1], "files_per_partition", 8) or made[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = queries.ddl_reset_partitions(spark, "/root/testdata/sf0.01").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(map(tuple, got)) == [(False, 1), (True, 3)]
    assert made[0].list_files("t").count() > 4
