"""Near-duplicate detection: fast similarity sketches, banding, exact verification on full shingle sets.

A document's sketch follows fast similarity sketching: in round i every shingle throws the value i + h_i(x) into
a hashed bin, and a bin keeps its least value; from round ``bins`` on, round i throws all shingles into bin
i - bins, so that after at most 2 * bins rounds every coordinate is filled. Two sketches agree in each coordinate
with probability equal to the Jaccard similarity, with concentration as for independent sampling.

Documents of equal shingle sets are one class before anything is compared. Class representatives that share a
band are candidates. Each round compares a bucket's members with one hub, so its cost is linear; members already
linked drop out. What then remains in buckets of several components is compared in blocks: first by sketches
(pairs ``MARGIN`` standard errors below the threshold are dismissed), then on full sets. Large buckets of the same
documents, one a band, are compared once, as a group. No pair inside one component is compared, only links leave a
block, and no bucket is capped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch, map_batches, materialize
from .textops import mix, raw_texts, shingle_sets, slices

BANDS, ROWS = 32, 4
BINS = BANDS * ROWS
#: Six standard errors: a pair of similarity 0.8 is dismissed with probability 1e-8, less than what banding loses.
MARGIN = 6.0
HUB_ROUNDS = 3
#: Between hub rounds, labels spread so many steps: members that still have other labels than their hub are compared, perhaps in vain.
HUB_STEPS = 2
#: Rows to a side of a block; a bucket of more than ``SPLIT`` times as many has larger ones, until a side holds so many bytes of
#: sketches (some ``BRIEF_BYTES`` a row) or sets. Up to there a bucket gives at most 2 * ``SPLIT`` rows a member.
SIDE, SPLIT, SIDE_BYTES, BRIEF_BYTES = 256, 8, 4_000_000, 400
#: Steps in which the members of large buckets agree on their group.
GROUP_STEPS = 3
#: Slim rows up to this many (some 40 MB in memory) are broadcast; more are joined by shuffling.
BROADCAST_IDS = 400_000


def fast_sketches(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """One row of ``bins`` uint64 for each non-empty set: the round above, the hash below."""
    n = len(sets)
    out = np.full(n * bins, np.iinfo(np.uint64).max, np.uint64)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    items = np.concatenate(sets) if n else np.empty(0, np.uint64)
    for i in range(2 * bins):
        if not len(items):
            break
        h = mix(items + np.uint64((i * 0xA24BAED4963EE407 + 0x1234567) & 0xFFFFFFFFFFFFFFFF))
        at = owner * bins + ((h & np.uint64(0xFFFFFF)) * np.uint64(bins) >> np.uint64(24)).astype(np.int64) if i < bins else owner * bins + (i - bins)
        np.minimum.at(out, at, (h >> np.uint64(10)) | np.uint64(i << 54))
        unfilled = (out.reshape(n, bins) == np.iinfo(np.uint64).max).any(axis=1)
        if not unfilled.all():
            more = unfilled[owner]
            owner, items = owner[more], items[more]
    return out.reshape(n, bins)


def set_digest(items: bytes) -> bytes:
    return hashlib.blake2b(items, digest_size=16).digest()


def sketch_rows(df: DataFrame, k: int, id_column: str, text_column: str) -> DataFrame:
    """For each row: its id, set size, a digest of the set, band hashes, and the sketch cut to a byte a coordinate."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(raw_texts(batch), k)
            full = [i for i, s in enumerate(sets) if len(s)]
            bands: list = [None] * len(sets)
            brief: list = [None] * len(sets)
            digest: list = [None] * len(sets)
            if full:
                sketch = fast_sketches([sets[i] for i in full])
                keyed = np.zeros((len(full), BANDS), np.uint64)
                for j in range(ROWS):
                    keyed = mix(keyed * np.uint64(0x9E3779B97F4A7C15) + sketch[:, j::ROWS] + np.arange(BANDS, dtype=np.uint64))
                keyed = keyed.view(np.int64)
                short = (mix(sketch) >> np.uint64(56)).astype(np.uint8)
                for row, i in enumerate(full):
                    bands[i], brief[i] = keyed[row], short[row].tobytes()
                    digest[i] = set_digest(sets[i].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(brief, pa.binary())],
                ["doc_id", "n_shingles", "digest", "bands", "brief"],
            )

    slim = df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return map_batches(slim, rows, "doc_id long, n_shingles long, digest binary, bands array<long>, brief binary")


def small(df: DataFrame) -> DataFrame:
    """A materialized table, broadcast if it has few rows; a larger one is joined by shuffling, where Spark splits skewed keys."""
    return F.broadcast(df) if df.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else df


def shingle_table(df: DataFrame, nodes: DataFrame, k: int, id_column: str, text_column: str) -> DataFrame:
    """(node, items) for the classes in ``nodes`` (node, digest, doc_id); items are the sorted hashes of the full set."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = [s.tobytes() for s in shingle_sets(raw_texts(batch), k)]
            yield pa.RecordBatch.from_arrays([pa.array([set_digest(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())], ["digest", "items"])

    texts = df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    nodes = small(nodes)
    found = map_batches(texts.join(nodes.select("doc_id"), "doc_id", "left_semi").select("text"), rows, "digest binary, items binary")
    # rows may repeat a class, or an id with another text
    return found.join(nodes.select("node", "digest"), "digest").groupBy("node").agg(F.first("items").alias("items"))


def alike(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have 100 * intersection >= percent * union."""
    if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
        return False
    both = np.concatenate([p, q])
    both.sort(kind="stable")  # two sorted runs: a merge
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (len(p) + len(q) - common)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those (a, b) whose full sets have 100 * intersection >= percent * union."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                good[i] = alike(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), batch.column(1).filter(pa.array(good))], ["a", "b"])

    left = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    return map_batches(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y"), rows, "a long, b long")


def components(links: DataFrame, scratch: Scratch, steps: int | None = None) -> DataFrame:
    """(node, component): the least node reachable. Least labels spread along links, then each label takes its own label, until
    nothing changes, or for some ``steps`` where it is enough that nodes of one label are linked."""
    both = scratch.table(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = scratch.table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")))
    while steps is None or steps > 0:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("least"))
        spread = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("component").alias("old"), F.least("component", "least").alias("to"))
        up = labels.select(F.col("node").alias("to"), F.col("component").alias("further"))
        after = scratch.table(spread.join(up, "to", "left").select("node", "old", F.least("to", F.coalesce("further", "to")).alias("component")))
        labels = after.select("node", "component")
        if steps is not None:
            steps -= 1
        elif after.filter("old <> component").isEmpty():
            break
    return labels


def _ordered(x, y):
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def gathered(entries: DataFrame, scratch: Scratch) -> DataFrame:
    """The buckets (key, band, node, component) of several components as what has to be compared, with ``part``: rows of one key meet
    unless their component or part is the same.

    Near copies share large buckets in many bands. The members of such buckets agree on a group, as labels spread from bucket to
    member and back; a group that is cheaper to compare than its shares of the buckets becomes a key of its own (band -1), and is one
    part of each bucket. That choice bears on costs only: two members of a bucket meet there or in their group.
    """
    per_key = entries.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("node").alias("o"), "node")).alias("hub"), F.min("component").alias("least"), F.max("component").alias("most")).filter("least < most")
    per_key = scratch.table(per_key.select("key", "n", F.col("hub.node").alias("label")))
    large = scratch.table(per_key.filter(F.col("n") > SIDE))
    columns = ["key", "band", "node", "component", "part"]
    if large.isEmpty():
        return scratch.table(entries.join(small(per_key), "key", "left_semi").withColumn("part", F.col("component")).select(columns))
    rest = entries.join(small(per_key.filter(F.col("n") <= SIDE)), "key", "left_semi").withColumn("part", F.col("component"))
    wide = scratch.table(entries.join(small(large.select("key", "n")), "key"))
    labels = large.select("key", "label")
    for step in range(GROUP_STEPS):
        votes = wide.join(small(labels), "key").groupBy("node", "label").agg(F.sum("n").alias("w"))
        owns = scratch.table(votes.groupBy("node").agg(F.max(F.struct("w", "label")).alias("m")).select(F.col("node").alias("of"), F.col("m.label").alias("label")))
        shares = wide.join(small(owns), F.col("node") == F.col("of")).groupBy("key", "label").agg(F.count("*").alias("m"))
        shares = scratch.table(shares)
        labels = scratch.table(shares.groupBy("key").agg(F.max(F.struct("m", "label")).alias("top")).select("key", "top.label"))
    pairs = shares.groupBy("label").agg(F.sum(F.col("m") * F.col("m")).alias("apart"))
    sizes = owns.groupBy("label").agg(F.count("*").alias("n"))
    used = scratch.table(pairs.join(sizes, "label").filter(F.col("n") * F.col("n") < F.col("apart")).select("label"))
    owns = scratch.table(owns.join(small(used), "label", "left_semi"))
    wide = scratch.table(wide.drop("n").join(small(owns), F.col("node") == F.col("of"), "left").withColumn("part", F.coalesce("label", -1 - F.col("component"))))
    groups = wide.filter("label is not null").select(F.xxhash64(F.lit("group"), "label").alias("key"), F.lit(-1).alias("band"), "node", "component", F.col("component").alias("part")).distinct()
    return scratch.table(rest.select(columns).unionByName(wide.select(columns)).unionByName(groups))


def in_blocks(entries: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, band, block, turn, node, component, part, asks, asker): members outside a key's largest part meet the whole key, in
    blocks of so many rows and ``bytes`` to a side."""
    by_part = entries.groupBy("key", "part").agg(F.count("*").alias("n"), F.sum("bytes").alias("size"))
    per_key = by_part.groupBy("key").agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.max(F.struct("n", "part", "size")).alias("top"), F.count("*").alias("kinds")).filter("kinds > 1")
    cuts = lambda n, size: F.greatest(F.least(F.ceil(n / SIDE), F.lit(SPLIT)), F.ceil(size / SIDE_BYTES)).cast("int")
    blocks, turns = cuts(F.col("n"), F.col("size")), cuts(F.col("n") - F.col("top.n"), F.col("size") - F.col("top.size"))
    per_key = per_key.select("key", blocks.alias("blocks"), turns.alias("turns"), F.col("top.part").alias("largest"))
    sized = entries.join(small(scratch.table(per_key)), "key").withColumn("asks", F.col("part") != F.col("largest"))
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    targets = sized.withColumn("block", own("blocks")).withColumn("turn", every("turns")).withColumn("asker", F.lit(False))
    askers = sized.filter("asks").withColumn("turn", own("turns")).withColumn("block", every("blocks")).withColumn("asker", F.lit(True))
    columns = ["key", "band", "block", "turn", "node", "component", "part", "asks", "asker"]
    return targets.select(columns).unionByName(askers.select(columns))


class Block:
    """Which rows of a block each asker has to be compared with."""

    def __init__(self, table: pa.Table, percent: int):
        p = percent / 100
        self.least = (p - MARGIN * np.sqrt(p * (1 - p) / BINS)) * BINS
        self.asker, self.asks = (table.column(c).to_numpy(zero_copy_only=False) for c in ("asker", "asks"))
        self.ids, self.of = table.column("node").to_numpy(), table.column("component").to_numpy().copy()
        self.part = table.column("part").to_numpy()
        self.band = table.column("band")[0].as_py()
        self.brief = np.frombuffer(b"".join(table.column("brief").to_pylist()), np.uint8).reshape(-1, BINS)
        self.bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)

    def hopeful(self, i: int) -> np.ndarray:
        """Rows of other components and parts whose sketches do not rule row ``i`` out, in a group or the bucket of the first band that the two share."""
        fit = np.flatnonzero(~self.asker & (self.of != self.of[i]) & (self.part != self.part[i]) & (~self.asks | (self.ids > self.ids[i])))
        fit = fit[np.count_nonzero(self.brief[fit] == self.brief[i], axis=1) >= self.least]
        return fit if self.band < 0 else fit[(self.bands[fit] == self.bands[i]).argmax(axis=1) == self.band]


def block_links(entries: DataFrame, reps: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links between components of one bucket, (a, b).

    First sketches alone dismiss the hopeless pairs, in large blocks; members that are left fetch their full sets, which
    decide in small blocks. What a block has linked is one component from then on, so that a block gives fewer links than it has rows.
    """

    def survivors(table: pa.Table) -> pa.Table:
        block = Block(table, percent)
        some = np.zeros(len(block.ids), bool)
        for i in np.flatnonzero(block.asker):
            fit = block.hopeful(i)
            some[fit] = True
            some[i] = len(fit) > 0
        return table.select(["key", "node", "n_shingles"]).filter(pa.array(some))

    def compare(table: pa.Table) -> pa.Table:
        block = Block(table, percent)
        items = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("items")]
        a, b, of = [], [], block.of
        for i in np.flatnonzero(block.asker):
            for j in block.hopeful(i).tolist():
                if of[i] != of[j] and alike(items[i], items[j], percent):
                    a.append(block.ids[i])
                    b.append(block.ids[j])
                    of[of == of[j]] = of[i]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    brief = reps.select("node", "n_shingles", "bands", "brief")
    entries = gathered(entries, scratch)
    blocks = in_blocks(entries.withColumn("bytes", F.lit(BRIEF_BYTES)), scratch)
    left = blocks.join(brief, "node").groupBy("key", "block", "turn").applyInArrow(survivors, "key long, node long, n_shingles long")
    left = scratch.table(left.distinct())
    if left.isEmpty():
        return scratch.table(df_of_links(entries.sparkSession))
    entries = scratch.table(entries.join(small(left), ["key", "node"]).withColumn("bytes", 8 * F.col("n_shingles") + BRIEF_BYTES).drop("n_shingles"))
    return scratch.table(in_blocks(entries, scratch).join(brief.join(sets, "node"), "node").groupBy("key", "block", "turn").applyInArrow(compare, "a long, b long").distinct())


def df_of_links(spark) -> DataFrame:
    return spark.createDataFrame([], "a long, b long")


def near_duplicates(df: DataFrame, k: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Words are runs of bytes other than space and \\t..\\r, with A-Z lower-cased; a set holds the distinct k-word
    shingles, the whole sequence where there are fewer words. Null or wordless texts have an empty set and link
    with nothing. Two documents link if 100 * intersection >= percent * union; component_id is the least id
    reachable. Rows that repeat an id are one document, which links wherever any of its texts does; a null id stays a
    row of its own (component_id null, kept true) and links nothing. Other columns are ignored; an empty table gives an empty result.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "near")
    rows = materialize(sketch_rows(df, k, id_column, text_column), "sketches")
    known = rows.filter("doc_id is not null")
    classes = known.filter("digest is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "n_shingles", "bands", "brief")).alias("m"))
    # one number to a class of equal sets; fixed once written
    reps = scratch.table(classes.select(F.monotonically_increasing_id().alias("node"), "digest", "m.doc_id", "m.n_shingles", "m.bands", "m.brief"))

    entries = reps.select("node", F.posexplode("bands").alias("band", "hash")).select(F.xxhash64("band", "hash").alias("key"), "band", "node")
    sums = [F.sum(F.xxhash64("node", F.lit(i)).cast("decimal(20,0)")).alias(f"sum{i}") for i in range(2)]
    shared = entries.groupBy("key").agg(F.min("band").alias("band"), F.min("node").alias("least"), F.max("node").alias("most"), *sums).filter("least < most")
    # of buckets with the same members, that of the first band stays
    shared = shared.groupBy("least", "most", "sum0", "sum1").agg(F.min(F.struct("band", "key")).alias("m")).select("m.key")
    entries = scratch.table(entries.join(shared, "key", "left_semi").withColumn("component", F.col("node")))
    found: list[DataFrame] = []
    if not entries.isEmpty():
        asked = scratch.table(reps.select("node", "digest", "doc_id").join(entries.select("node").distinct(), "node", "left_semi"))
        sets = scratch.table(shingle_table(df, asked, k, id_column, text_column))
        tried: list[DataFrame] = []

        def confirm(pairs: DataFrame) -> DataFrame:
            for t in tried:
                pairs = pairs.join(t, ["a", "b"], "left_anti")
            tried.append(pairs := scratch.table(pairs))
            found.append(good := scratch.table(verified(pairs, sets, percent).distinct()))  # few rows in few files
            return good

        for turn in range(HUB_ROUNDS):
            order = F.col("node") if turn == 0 else F.xxhash64("node", F.lit(turn))
            hubs = entries.groupBy("key").agg(F.min(F.struct(order.alias("o"), "node", "component")).alias("hub"), F.min("component").alias("least"), F.max("component").alias("most")).filter("least < most")
            hubs = scratch.table(hubs.select("key", F.col("hub.node").alias("hub"), F.col("hub.component").alias("of")))
            open_ = entries.join(small(hubs), "key")
            good = confirm(open_.filter("component <> of").select(*_ordered(F.col("node"), F.col("hub"))).distinct())
            if good.isEmpty():
                continue
            joined = components(reduce(DataFrame.unionByName, found), scratch, HUB_STEPS).withColumnRenamed("component", "now")
            entries = scratch.table(open_.select("key", "band", "node").join(small(joined), "node", "left").select("key", "band", "node", F.coalesce("now", "node").alias("component")))
        found.append(block_links(entries, reps, sets, percent, scratch))
    # rows of one id with different texts are one document
    again = known.groupBy("doc_id").agg(F.min("digest").alias("first"), F.max("digest").alias("last"), F.max(F.isnull("digest")).alias("blank")).filter("first <> last or blank and first is not null")
    again = scratch.table(again.select("doc_id", "first"))
    placed = rows.select("doc_id", "n_shingles", "digest")
    if not again.isEmpty():
        number = reps.select("digest", "node")
        texts = known.select("doc_id", "digest").join(small(again), "doc_id").filter("digest <> first").distinct()
        found.append(scratch.table(texts.join(number, "digest").select("first", F.col("node").alias("a")).join(number.toDF("first", "b"), "first").select("a", "b").filter("a <> b")))
        placed = placed.join(small(again), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("digest", "first").alias("digest"))
    of = reps.select("digest", F.col("doc_id").alias("component_id"))
    links = reduce(DataFrame.unionByName, found) if found else df_of_links(spark)
    if not links.isEmpty():
        labels = scratch.table(components(links, scratch).join(reps.select("node", "digest", "doc_id"), "node").select("digest", "doc_id", "component"))
        least = labels.groupBy("component").agg(F.min("doc_id").alias("least"))
        linked = labels.join(least, "component").select("digest", "least")
        of = of.join(linked, "digest", "left").select("digest", F.coalesce("least", "component_id").alias("component_id"))
    of = materialize(of, "components")
    out = placed.join(of, "digest", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    if not again.isEmpty():
        out = materialize(out, "near-duplicates")  # reads ``again``, which goes
    scratch.drop()
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
