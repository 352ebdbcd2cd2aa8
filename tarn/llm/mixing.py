"""Mixing sources to target weights along a time-varying curriculum, with DataFrame functions only.

A source's target is its share of all words by weight, at most ``most`` times its own words; what that cuts off is
shared again by weight among the others. Within a source, documents stand in the order of a hash; whole rounds
take every document, and a last round takes the first ones until the target is met. Each source has a weight
schedule over training time that runs linearly from its start to its end value and is scaled so that its integral is the
source's target. A document's share of its source's taken words, through the inverted integral, is its training position,
each time that it is taken; so at any time the sources share the words in proportion to their schedules.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize

WEIGHTS = (1, 2, 3)
#: (start, end) of the schedule for each weight in turn: sources of weight 1 come early, those of weight 3 late.
SCHEDULES = ((3, 1), (1, 1), (1, 3))
MOST = 3
#: A prefix-sum bucket has about this many rows, or the square root of all rows if that is more.
BUCKET_ROWS = 2000


def position(u: Column, start: Column, end: Column) -> Column:
    """t in [0, 1] with integral of (start + (end - start) x) over [0, t] = u times that over [0, 1]."""
    root = F.sqrt(start * start + (end - start) * (start + end) * u)
    return F.when(start == end, u).otherwise((root - start) / (end - start))


def source_schedules(df: DataFrame, source_column: str = "source", schedules=SCHEDULES) -> DataFrame:
    """(source, start, end): the schedule of each source of ``df``, in turn by name as in ``source_targets``. A row a source; null sorts last."""
    ranked = df.select(F.col(source_column).alias("source")).distinct().withColumn("nth", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    of = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.col("nth") % len(schedules) + 1).cast("int"))
    return ranked.select("source", of([a for a, _ in schedules]).alias("start"), of([b for _, b in schedules]).alias("end"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, most: int = MOST) -> DataFrame:
    """From (source, source_size): also target, start and end. A row a source; null sorts last."""
    every = Window.orderBy("nth")
    ranked = sizes.withColumn("nth", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    turn = F.col("nth") % len(weights)
    of = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (turn + 1).cast("int"))
    ranked = ranked.withColumns({"weight": of(weights).cast("long"), "start": of([a for a, _ in schedules]).cast("double"), "end": of([b for _, b in schedules]).cast("double"), "cap": most * F.col("source_size")})
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy(F.lit(0))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "nth")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumns(
        {
            "left": F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0)),
            "share": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
            "rank": F.row_number().over(by_cap),
        }
    )
    level = ranked.filter(F.col("weight") * F.col("left") <= F.col("cap") * F.col("share")).agg(F.min(F.struct("rank", "left", "share")).alias("level"))
    fit = F.col("rank") >= F.col("level.rank")
    target = F.when(fit, (F.col("weight") * F.col("level.left")).cast("double") / F.col("level.share")).otherwise(F.col("cap").cast("double"))
    # one row joins one row a source; neither side is large
    return ranked.join(F.broadcast(level)).select("source", "source_size", target.alias("target"), "start", "end")


def mix_sources(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", keep_text: bool = False) -> DataFrame:
    """One row per row of ``df``, in the order of first positions: doc_id, size, source_size, target, taken, position, positions.

    ``size`` counts words (null text: 0); ``taken`` is whole rounds times the size, plus the part of the last round
    that falls on the document (a cut falls on one document a source), so a source's taken words are its target
    rounded down. ``positions`` has one for each round that takes the document, ``position`` the first; null where nothing is
    taken. A null source is a source, last in order; rows with a null id are ordered by a hash of their text, rows that repeat an
    id by size. With ``keep_text`` all columns of ``df`` stay, except that the results replace columns of the same names. An empty
    table gives an empty result. Sources are put in order by one task, a row a source.
    """
    size = F.coalesce(F.regexp_count(F.col(text_column).cast("string"), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")
    clash = {"size", "source_size", "target", "taken", "position", "positions"}
    rest = [c for c in df.columns if c not in clash] if keep_text else ["doc_id"]
    key = F.md5(F.coalesce(F.col(id_column).cast("string"), F.col(text_column).cast("string"), F.lit("")))
    own = {"__source": F.col(source_column), "size": size, "__key": key, "__id": F.col(id_column)}
    rows = df.withColumns(own if keep_text else own | {"doc_id": F.col(id_column)}).select(*rest, *own)
    slim = rows if not keep_text else rows.select(*own)
    counted = materialize(slim, "sizes")
    if not keep_text:
        rows = counted
    n = counted.count()
    buckets = max(1, n // max(BUCKET_ROWS, isqrt(n)))
    bucket = F.floor(F.conv(F.substring("__key", 1, 8), 16, 10).cast("long") * buckets / F.lit(1 << 32)).cast("long")
    rows = rows.withColumn("__bucket", bucket)
    by_bucket = materialize(counted.withColumn("__bucket", bucket).groupBy("__source", "__bucket").agg(F.sum("size").alias("n")), "bucket-sizes")
    sources = source_targets(by_bucket.groupBy(F.col("__source").alias("source")).agg(F.sum("n").alias("source_size")))
    ahead = by_bucket.withColumn("ahead", F.coalesce(F.sum("n").over(Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    known = ahead.join(sources, F.col("__source").eqNullSafe(F.col("source"))).select(F.col("__source").alias("s"), F.col("__bucket").alias("b"), "ahead", "source_size", "target", "start", "end")
    within = Window.partitionBy("__source", "__bucket").orderBy("__key", F.col("__id"), "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("__within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(known, F.col("__source").eqNullSafe(F.col("s")) & (F.col("__bucket") == F.col("b")))
    placed = placed.withColumns({"__start": F.col("ahead") + F.col("__within"), "__goal": F.floor("target").cast("long")})
    rounds = F.when(F.col("source_size") > 0, F.expr("__goal div source_size")).otherwise(F.lit(0))
    placed = placed.withColumn("__rounds", rounds).withColumn("__last", F.col("__goal") - F.col("__rounds") * F.col("source_size"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("__last") - F.col("__start")))
    placed = placed.withColumns({"taken": (F.col("__rounds") * F.col("size") + part).cast("long"), "__times": F.col("__rounds") + F.when(part > 0, 1).otherwise(0)})
    ahead = lambda r: (r * F.col("source_size") + F.col("__start")).cast("double") / F.col("__goal")
    each = F.transform(F.sequence(F.lit(0), F.col("__times").cast("int") - 1), lambda r: position(ahead(r), F.col("start"), F.col("end")))
    placed = placed.withColumn("positions", F.when(F.col("taken") > 0, each)).withColumn("position", F.get("positions", F.lit(0)))
    out = placed.select(*rest, "size", "source_size", "target", "taken", "position", "positions", F.col("__key").alias("__tie"))
    order = [F.col("position").asc_nulls_last(), F.col("__tie")]
    return out.repartitionByRange(*order).sortWithinPartitions(*order).drop("__tie")
