"""SpotSigs fingerprints: chains of content words that follow common-word anchors.

A word is a run of ASCII letters, digits or bytes of longer characters, with A-Z lower-cased. From every anchor (a
common word) the next ``CHAIN`` content words make a signature; the set of a text's signatures is its fingerprint.
Likeness is the Jaccard similarity of two sets. Sets are partitioned by length so that only sets of the same or of neighbouring
partitions can be alike; others are pruned without counting. ``fingerprints`` compares two given pairs a document that
way, ``matches`` finds all pairs of like fingerprints.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import map_batches, materialize
from .textops import mix, word_hashes

#: Common words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be by for from has have he her his in is it its of on or she that the this to was were which with "
    "als auch auf aus bei das dem den der des die ein eine einen er es ist im mit nach nicht sich sie und von war wie zu zum "
    "au aux avec ce ces dans de du elle en est et il la le les leur mais ne ou par pas pour que qui sa se son sur un une "
    "al como con del el esta fue ha la las lo los más no para pero por su sus una y"
).split()
CHAIN = 2
#: A likeness below this is 0; it sets how wide the partitions of lengths are.
LEAST = 0.05
#: Ranges of ids to a task, which even out what hashing deals to each.
RANGES = 8
_GAP = np.ones(256, bool)
_GAP[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def _anchor_hashes() -> np.ndarray:
    return np.unique(word_hashes([w.encode() for w in ANCHORS], _GAP)[0])


def signatures(texts: list[str], anchors: np.ndarray | None = None, chain: int = CHAIN) -> list[np.ndarray]:
    """Each text's sorted distinct 32-bit signatures. Without any anchored chain, all words are one signature; without words, none."""
    anchors = _anchor_hashes() if anchors is None else anchors
    words, begins = word_hashes([t.encode("utf-8", "surrogatepass").lower() for t in texts], _GAP)
    is_anchor = anchors[np.minimum(np.searchsorted(anchors, words), len(anchors) - 1)] == words
    content = np.flatnonzero(~is_anchor)
    out = []
    spots = np.flatnonzero(is_anchor)
    first = np.searchsorted(content, spots)
    ends = begins[np.searchsorted(begins, spots, "right")]
    whole = first + chain <= len(content)
    whole[whole] &= content[first[whole] + chain - 1] < ends[whole]
    spots, first = spots[whole], first[whole]
    value = words[spots]
    for j in range(chain):
        value = mix(value * np.uint64(0x9E3779B97F4A7C15) + words[content[first + j]])
    short = (value >> np.uint64(32)).astype(np.uint32)
    cuts = np.searchsorted(spots, begins)
    for a, b, x, y in zip(cuts[:-1], cuts[1:], begins[:-1], begins[1:], strict=True):
        if b > a:
            out.append(np.unique(short[a:b]))
        elif y > x:
            out.append(np.frombuffer(hashlib.blake2b(words[x:y].tobytes(), digest_size=4).digest(), np.uint32))
        else:
            out.append(np.empty(0, np.uint32))
    return out


def encode(signature: np.ndarray) -> str:
    """A fingerprint as text: the sorted signatures in base64."""
    return base64.b64encode(signature.astype("<u4").tobytes()).decode()


def decode(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u4")


def level(n: int, least: float) -> int:
    """The partition of a set of ``n`` signatures: sets whose likeness reaches ``least`` are at most one apart."""
    return int(np.floor(np.log(n) / -np.log(least) + 1e-9)) if n else -2


def likeness(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> float:
    """Jaccard similarity; 0 below ``least``, and without counting where partitions or sizes keep it there. Two empty sets are alike."""
    small, large = sorted((len(a), len(b)))
    if not large:
        return 1.0
    if level(large, least) - level(small, least) > 1 or small < least * large:
        return 0.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    both = small + large - common
    return common / both if common >= least * both else 0.0


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many first ones (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_order(df: DataFrame, parts: int, id_column: str, text_column: str) -> DataFrame:
    """(part, lead, doc_id, text, key, hash): rows dealt to ranges of (id, hash of the text), each also with the first row of the range after it (``lead``).

    About ``parts`` ranges of ids of like size; an id that fills several of them is dealt on by the hash."""
    low = -(1 << 63)
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = df.select(F.coalesce(F.col(id_column).cast("long"), F.lit(low)).alias("key"), F.xxhash64(text).alias("hash"), F.col(id_column).cast("long").alias("doc_id"), text.alias("text"))
    found = (rows.agg(F.percentile_approx("key", [i / parts for i in range(1, parts)], 10_000).alias("p")).first()["p"] or []) if parts > 1 else []
    times = Counter(found)  # a long a range
    held = df.sparkSession.sparkContext.broadcast((np.array(sorted(times), np.int64), np.array([0, *(times[k] if times[k] > 1 else 0 for k in sorted(times))])))

    @F.pandas_udf("long")
    def part_of(key: pd.Series, hashed: pd.Series) -> pd.Series:
        cuts, heavy = held.value
        keys = key.to_numpy()
        after = np.searchsorted(cuts, keys, "right")
        n = heavy[after]  # ranges for the id that the cut names, before those of the ids after it
        own = (n > 0) & (cuts[np.maximum(after, 1) - 1] == keys) if len(cuts) else n > 0
        sub = np.minimum((hashed.to_numpy() / 2.0**64 + 0.5) * n, n - 1).astype(np.int64)
        return pd.Series(after * (parts + 1) + np.where(own, sub, n))

    rows = rows.withColumn("part", part_of("key", "hash"))
    heads = sorted((r["part"], r["at"]["key"], r["at"]["hash"]) for r in rows.groupBy("part").agg(F.min(F.struct("key", "hash")).alias("at")).collect())  # a row a range
    columns = ["part", "lead", "doc_id", "text", "key", "hash"]
    own = rows.withColumn("lead", F.lit(False)).select(columns)
    if not heads:
        return own
    after = df.sparkSession.createDataFrame([(heads[i - 1][0], key, h) for i, (_, key, h) in enumerate(heads)], "part long, key long, hash long")
    leads = rows.drop("part").join(F.broadcast(after), ["key", "hash"]).withColumn("lead", F.lit(True)).select(columns)
    return own.unionByName(leads.dropDuplicates(["part", "key", "hash"]))


def fingerprints(df: DataFrame, parts: int | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the one after it by id, then by a hash of the text (null ids first, null text is empty; after the last comes the
    first; a single row is followed by itself). Equal texts have equal fingerprints. A likeness below ``LEAST`` is 0. Other columns are ignored; an
    empty table gives an empty result. Texts cross the network once.
    """
    spark = df.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = in_order(df, parts or RANGES * tasks, id_column, text_column)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [x.split()[0] for x in schema.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = _anchor_hashes()

        def stream() -> Iterator[tuple]:
            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    piece = batch.slice(at, 64)
                    yield from zip(*(c.to_pylist() for c in piece.columns[:4]), strict=True)

        def pairs() -> Iterator[tuple]:
            """(doc_id, text, next text) in order."""
            last = None
            for part, lead, doc_id, text in stream():
                if last is not None and last[0] == part:
                    yield last[1], last[2], text
                    last = None
                    if lead:
                        continue
                if not lead:
                    last = part, doc_id, text

        def done(some: list[tuple]) -> pa.RecordBatch:
            changed = [edited(t, n) for _, t, n in some]
            sets = signatures([t for _, t, _ in some] + changed + [n for _, _, n in some], anchors)
            k = len(some)
            own, new, following = sets[:k], sets[k : 2 * k], sets[2 * k :]
            columns = [
                pa.array([d for d, _, _ in some], pa.int64()),
                pa.array([len(t) for _, t, _ in some], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]),
                pa.array([encode(s) for s in own]),
                pa.array([encode(s) for s in new]),
                pa.array([likeness(a, b) for a, b in zip(own, new, strict=True)], pa.float64()),
                pa.array([likeness(a, b) for a, b in zip(own, following, strict=True)], pa.float64()),
            ]
            return pa.RecordBatch.from_arrays(columns, names)

        some, size = [], 0
        for x in pairs():
            some.append(x)
            size += len(x[1])
            if size >= 500_000:
                yield done(some)
                some, size = [], 0
        if some:
            yield done(some)

    ordered = dealt.repartition(tasks, "part").sortWithinPartitions("part", "lead", "key", "hash")
    return map_batches(ordered.select("part", "lead", "doc_id", "text"), rows, schema)


def matches(prints: DataFrame, least: float = 0.8, id_column: str = "doc_id") -> DataFrame:
    """All pairs (a, b, likeness) of rows with different fingerprints whose likeness reaches ``least``.

    Equal fingerprints are one row, under their least id; null and empty ones match nothing, null ids are left out. Lengths are partitioned so that a set can match in its own
    partition and the next alone; within those, pairs must share one of their rarest signatures (as many as a
    match cannot all miss), and what is left is counted.
    """
    one = materialize(prints.groupBy("fingerprint").agg(F.min(id_column).alias("id")).filter("fingerprint <> '' and id is not null"), "prints")

    @F.pandas_udf("array<long>")
    def items(column):
        return column.map(decode)

    sets = one.withColumn("items", items("fingerprint")).withColumn("n", F.size("items"))
    step = -np.log(least)
    sets = sets.withColumn("level", F.floor(F.log("n") / step).cast("int"))
    each = sets.select("id", "n", "level", F.explode("items").alias("item"))
    rare = each.groupBy("item").agg(F.count("*").alias("df"))
    order = Window.partitionBy("id").orderBy("df", "item")
    head = each.join(rare, "item").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * least) + 1).select("id", "n", "level", "item")
    left = head.withColumn("level", F.explode(F.array("level", F.col("level") + 1)))
    x, y = left.alias("x"), head.alias("y")
    found = x.join(y, ["level", "item"]).filter("x.id <> y.id and (x.n < y.n or (x.n = y.n and x.id < y.id))").filter(F.col("x.n") >= least * F.col("y.n")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    own = sets.select("id", "items")
    both = found.join(own.toDF("a", "p"), "a").join(own.toDF("b", "q"), "b")
    common = F.size(F.array_intersect("p", "q"))
    return both.withColumn("likeness", common / (F.size("p") + F.size("q") - common)).filter(F.col("likeness") >= least).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "likeness")
