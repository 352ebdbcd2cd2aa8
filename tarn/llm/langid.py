"""Language identification by partial matching over bytes.

For each language a context tree counts which byte followed each context of up to three bytes in learning texts.
A byte's probability in a context is its count over (count of all + distinct bytes); what is left is the escape
probability, with which the next shorter context decides, down to one in 256. Statistics are frozen after learning,
so the code length of a byte depends on the three bytes before it alone, and a text's exact code length under every
language is the sum over its four-byte grams. Each distinct gram of a batch walks the trees once. The shortest
code wins; how far it is beyond what texts of that language cost tells texts of other languages and junk.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .storage import map_batches, materialize
from .textops import raw_texts, slices

ORDER = 3
#: So many characters of each language are learned from, or all that it has: its distinct texts in the order of a hash, the last one cut.
LEARN_CHARS = 1_500_000
#: The same for all languages together: with many, each has an equal part of it. This bounds the model.
ALL_CHARS = 8_000_000
#: A text costs too much beyond so many times what texts of its language cost a byte, and so many bits; then the score halves with each half bit a byte.
MOST_TIMES, FREE_BITS = 2.0, 64.0
UNDETERMINED = "und"
_FOLD = bytes(range(256)).lower().translate(bytes.maketrans(b"123456789\t\r\x0b\x0c ", b"000000000\n\n\n\n\n"))
_LETTER = regex.compile(r"\p{L}")


class Tree:
    """Counts of (k + 1)-byte grams of all languages, k = 0 to ORDER: sorted keys (language, gram), and what is known of each context."""

    def __init__(self, lang: np.ndarray, code: np.ndarray, n: np.ndarray):
        self.levels: list[tuple[np.ndarray, ...]] = []
        for k in range(ORDER + 1):
            bits = 8 * (k + 1)
            keys, at = np.unique(lang.astype(np.int64) << bits | code & ((1 << bits) - 1), return_inverse=True)
            counts = np.bincount(at, n, len(keys))
            contexts, first = np.unique(keys >> 8, return_index=True)
            seen, kinds = (np.add.reduceat(counts, first), np.diff(np.append(first, len(keys)))) if len(keys) else (counts, counts)
            self.levels.append((keys, counts, contexts, np.log2(seen + kinds), np.log2(kinds)))

    def costs(self, lang: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each gram after the others, under the language beside it."""
        out = np.zeros(len(code))
        left = np.arange(len(code))
        for k in range(ORDER, -1, -1):
            keys, counts, contexts, total, kinds = self.levels[k]
            if not len(keys):
                break
            bits = 8 * (k + 1)
            key = lang[left].astype(np.int64) << bits | code[left] & ((1 << bits) - 1)
            at = np.minimum(np.searchsorted(contexts, key >> 8), len(contexts) - 1)
            known = contexts[at] == key >> 8
            of = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[of] == key
            out[left[hit]] += total[at[hit]] - np.log2(counts[of[hit]])
            escaped = known & ~hit
            out[left[escaped]] += total[at[escaped]] - kinds[at[escaped]]
            left = left[~hit]
        out[left] += 8.0
        return out


@dataclass
class Model:
    """``usual``: bits a byte that texts of each language cost under counts of other texts of it."""

    languages: list[str]
    tree: Tree
    usual: np.ndarray
    name: str = field(default_factory=lambda: uuid.uuid4().hex)


#: Grams looked up at once, times languages; and bytes of costs that a worker keeps.
_AT_ONCE, _KEPT_BYTES = 1 << 18, 16_000_000
_KNOWN: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def gram_costs(model: Model, codes: np.ndarray) -> np.ndarray:
    """[gram, language] for sorted distinct grams."""
    n = len(model.languages)
    out = np.empty((len(codes), n), np.float32)
    step = max(1, _AT_ONCE // n)
    for a in range(0, len(codes), step):
        some = codes[a : a + step]
        out[a : a + step] = model.tree.costs(np.tile(np.arange(n), len(some)), np.repeat(some.astype(np.int64), n)).reshape(-1, n)
    return out


def kept_costs(model: Model, codes: np.ndarray) -> np.ndarray:
    """The same, from what this worker has looked up before as far as that goes."""
    n = len(model.languages)
    if model.name not in _KNOWN or len(_KNOWN[model.name][0]) * (4 * n + 4) > _KEPT_BYTES:
        _KNOWN.clear()
        _KNOWN[model.name] = np.empty(0, np.uint32), np.empty((0, n), np.float32)
    known, costs = _KNOWN[model.name]
    at = np.searchsorted(known, codes)
    new = np.ones(len(codes), bool)
    if len(known):
        new = known[np.minimum(at, len(known) - 1)] != codes
    if new.any():
        known, costs = np.insert(known, at[new], codes[new]), np.insert(costs, at[new], gram_costs(model, codes[new]), axis=0)
        _KNOWN[model.name] = known, costs
        at = np.searchsorted(known, codes)
    return costs[at]


def grams_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Four-byte grams, one a byte of text (after three bytes of padding before each), and where each text's begin, with one more entry."""
    pad = b"\n" * ORDER
    x = np.frombuffer(b"".join(pad + t.translate(_FOLD) for t in texts), np.uint8)
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=bounds[1:])
    if len(x) <= ORDER:
        return np.empty(0, np.uint32), bounds
    code = x[:-3].astype(np.uint32) << 24 | x[1:-2].astype(np.uint32) << 16 | x[2:-1].astype(np.uint32) << 8 | x[3:]
    ends = bounds[1:-1] + ORDER * np.arange(len(texts) - 1)  # between two texts lie grams that end in the padding
    whole = np.ones(len(code), bool)
    for j in range(ORDER):
        whole[ends + j] = False
    return code[whole], bounds


def code_lengths(model: Model, texts: list[bytes]) -> np.ndarray:
    """Bits of each text under each language."""
    out = np.zeros((len(texts), len(model.languages)))
    codes, bounds = grams_of(texts)
    if len(codes):
        told = pa.array(codes).dictionary_encode()
        distinct = told.dictionary.to_numpy()
        order = np.argsort(distinct)
        costs = np.empty((len(distinct), len(model.languages)), np.float32)
        costs[order] = kept_costs(model, distinct[order])
        some = np.diff(bounds) > 0
        out[some] = np.add.reduceat(costs[told.indices.to_numpy()], bounds[:-1][some], axis=0, dtype=np.float64)
    return out


def last_draws(texts: DataFrame, chars: int) -> DataFrame:
    """From (lang, draw, n, range): for each language the greatest draw that is learned, and how many characters of its text. A row a language.

    Draws are summed in ranges first, so that only one range a language is looked at text by text."""
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = texts.groupBy("lang", "range").agg(F.sum("n").alias("n")).withColumn("before", before(Window.partitionBy("lang").orderBy("range")))
    reached = ranges.filter(F.col("before") < chars).groupBy("lang").agg(F.max(F.struct("range", "before")).alias("at")).select("lang", "at.*")
    inside = texts.join(reached, ["lang", "range"]).withColumn("left", chars - F.col("before") - before(Window.partitionBy("lang").orderBy("draw")))
    return inside.filter("left > 0").groupBy("lang").agg(F.max(F.struct("draw", "left")).alias("last")).select("lang", F.col("last.draw").alias("last"), F.col("last.left").cast("int").alias("left"))


def learn(df: DataFrame, language_column: str = "lang", text_column: str = "text", chars: int = LEARN_CHARS, all_chars: int = ALL_CHARS) -> Model:
    """Gram counts over a bounded sample of the labelled rows; rows without language or text teach nothing.

    Every labelled language is learned, from ``chars`` characters of its distinct texts, or from all if it has fewer; copies teach
    once. If there are so many languages that this would pass ``all_chars``, each has an equal part of those. So the model has at
    most ``all_chars`` characters' grams, whatever the input. Nothing else is left out: all bytes and contexts count.
    """
    rows = df.select(F.col(language_column).cast("string").alias("lang"), F.col(text_column).cast("string").alias("text")).filter("lang is not null and text <> ''").withColumn("draw", F.xxhash64("text"))
    texts = materialize(rows.groupBy("lang", "draw").agg(F.max(F.length("text")).cast("long").alias("n")).withColumn("range", F.shiftright("draw", 52)), "draws")
    n = texts.select("lang").distinct().count()
    if not n:
        return Model([], Tree(*[np.empty(0, np.int64)] * 3), np.empty(0))
    last = materialize(last_draws(texts, min(chars, max(1, all_chars // n))), "last-draws")
    languages = [r["lang"] for r in last.select("lang").orderBy("lang").collect()]  # a row a language
    number = {x: i for i, x in enumerate(languages)}
    picked = rows.join(F.broadcast(last), "lang").filter(F.col("draw") <= F.col("last"))  # a row a language
    picked = picked.groupBy("lang", "draw").agg(F.min("text").alias("text"), F.first("last").alias("last"), F.first("left").alias("left"))
    picked = picked.select("lang", F.pmod("draw", F.lit(2)).cast("int").alias("half"), F.when(F.col("draw") == F.col("last"), F.substring("text", F.lit(1), F.col("left"))).otherwise(F.col("text")).alias("text"))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4_000_000):
            names, halves, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw_texts(batch)
            for lang, half in dict.fromkeys(zip(names, halves, strict=True)):
                code, counts = np.unique(grams_of([t for t, x, h in zip(texts, names, halves, strict=True) if (x, h) == (lang, half)])[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([number[lang]] * len(code), pa.int32()), pa.array([half] * len(code), pa.int32()), pa.array(code.astype(np.int64)), pa.array(counts.astype(np.int64))], ["lang", "half", "code", "n"])

    counted = materialize(map_batches(picked, grams, "lang int, half int, code long, n long").groupBy("lang", "half", "code").agg(F.sum("n").alias("n")), "grams")
    got = counted.toArrow()  # at most ``all_chars`` characters' grams
    lang, half, code, count = (got.column(c).to_numpy() for c in ("lang", "half", "code", "n"))
    return Model(languages, Tree(lang, code, count), usual_bits(lang, half, code, count, len(languages)))


def usual_bits(lang: np.ndarray, half: np.ndarray, code: np.ndarray, n: np.ndarray, languages: int) -> np.ndarray:
    """Bits a byte of each language's texts of either half under the counts of the other; where there is no other, the most of any language."""
    bits, size = np.zeros(languages), np.zeros(languages)
    for h in range(2):
        own = half == h
        both = own & np.isin(lang, lang[~own])
        cost = Tree(lang[~own], code[~own], n[~own]).costs(lang[both], code[both])
        bits += np.bincount(lang[both], n[both] * cost, languages)
        size += np.bincount(lang[both], n[both], languages)
    usual = np.divide(bits, size, out=np.zeros(languages), where=size > 0)
    return np.where(size > 0, usual, usual.max(initial=0) or 8.0)


def predict(df: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """``df`` with lang_pred and score: the best language's share of the probability that all give to the text, halved for each
    half bit a byte that the text costs beyond ``MOST_TIMES`` what texts of that language usually do (and ``FREE_BITS``).

    Null texts and texts without a letter are ``und`` with score 0, as is everything under a model without languages.
    Rows are judged alone and whole. Columns of ``df`` by these names are replaced; others stay.
    """
    df = df.drop("lang_pred", "score")
    names = [f.name for f in df.schema.fields]
    at = names.index(text_column)
    held = df.sparkSession.sparkContext.broadcast(model)  # bounded by ALL_CHARS
    schema = StructType([*df.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in slices(batches, text_column, 1_000_000):
            texts = batch.column(at).to_pylist()
            lettered = np.array([bool(t and _LETTER.search(t)) for t in texts])
            pred, score = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts))
            if m.languages and lettered.any():
                raw = [t for t, x in zip(raw_texts(batch, text_column), lettered, strict=True) if x]
                bits = code_lengths(m, raw)
                best, least = bits.argmin(axis=1), bits.min(axis=1)
                pred[lettered] = np.array(m.languages, object)[best]
                share = 1 / np.exp2(-np.minimum(bits - least[:, None], 1000)).sum(axis=1)
                over = (least - FREE_BITS) / [len(t) for t in raw] - MOST_TIMES * m.usual[best]
                score[lettered] = share * np.exp2(-2 * np.maximum(over, 0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(pred), pa.string()), pa.array(score)], [*names, "lang_pred", "score"])

    return map_batches(df, rows, schema)


def held_out(id_column: Column) -> Column:
    return F.coalesce(F.crc32(id_column.cast("string")) % 3 == 1, F.lit(False))


def identify(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", language_column: str = "lang") -> DataFrame:
    """One row per row: doc_id, held_out, lang_pred, score; learned from the labelled rows whose crc32(doc_id) mod 3 is not 1.

    A null id is never held out. Repeated rows agree; other columns are ignored; an empty table gives an empty result.
    """
    model = learn(df.filter(~held_out(F.col(id_column))), language_column, text_column)
    slim = df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return predict(slim, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
