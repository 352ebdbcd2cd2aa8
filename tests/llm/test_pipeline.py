"""The pipeline's stages against what each must do, on a small table."""

import hashlib
import random
from collections import Counter
from fractions import Fraction

import corpus_pipeline as cp
from tarn.llm import packing, pii


def copies(rows):
    """How often the mixture takes each document, by plain counting: {doc_id: copies}."""
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(sources)}
    own = {s: sum(n for _, n, x in rows if x == s) for s in sources}
    target, left, free = {}, Fraction(sum(own.values())), set(sources)
    while free:
        share = sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * left / share > 3 * own[s]}
        target |= {s: Fraction(3 * own[s]) for s in over} if over else {s: weight[s] * left / share for s in free}
        left, free = left - sum(3 * own[s] for s in over), free - over if over else set()
    out = Counter()
    for s in sources:
        rest = int(target[s])
        order = sorted((hashlib.md5(str(i).encode()).hexdigest(), i, n) for i, n, x in rows if x == s)
        while rest > 0:
            for _, i, n in order:
                out[i] += rest > 0
                rest -= n
    return out


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    say = lambda n: " ".join("".join(rng.choice(["ka", "lo", "mi", "tu"]) for _ in range(3)) for _ in range(n)) + "."
    rows = [(i, say(40), "en", rng.choice("abc"), 0, "x") for i in range(40)]
    rows += [(100, rows[0][1], "en", "a", 0, "x"), (101, rows[1][1] + " more words", None, "a", 0, "x"), (102, "12 34", "en", "a", 0, "x"), (103, None, "en", "a", 0, "x"), (104, say(30) + " mail a@b.co", None, None, 0, "x"), (5, rows[5][1], "en", "b", 0, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, extra string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, str(tmp_path))
        seen[name] = out.collect()
        if name != "packing":
            assert out.columns == cp.COLUMNS
            docs = spark.createDataFrame(seen[name], out.schema)
    assert sorted(r["doc_id"] for r in seen["language_id"]) == sorted([*range(40), 100, 101, 104, 5]) and all(r["lang"] for r in seen["language_id"])
    assert sorted(r["doc_id"] for r in seen["near_dedup"]) == [*range(40), 104]
    a = pii.automaton()
    assert all(not pii.find(r["text"], a) and r["n_chars"] == len(r["text"]) for r in seen["pii"]) and len(seen["pii"]) == 41
    assert {r["doc_id"] for r in seen["mixing"]} <= {r["doc_id"] for r in seen["pii"]}
    e = packing.Encoder(packing.default_tokenizer())
    assert sum(r["length"] for r in seen["packing"]) == sum(len(e.whole(r["text"])) // 2 + 1 for r in seen["mixing"])
    assert cp.run(spark, str(tmp_path)).count() == len(seen["packing"])


def test_mix_takes_what_the_targets_say(spark):
    rng = random.Random(8)
    say = lambda: " ".join(rng.choice(["one", "two", "three"]) for _ in range(rng.randint(5, 60)))
    rows = [(i, say(), "en", rng.choice(["a", "a", "a", "a", "b", "b", "c", None]), 0) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = copies([(i, len(t.split()), s) for i, t, _, s, _ in rows])
    mixed = cp.mix(spark, docs, "").collect()
    assert Counter(r["doc_id"] for r in mixed) == +want and {(r["doc_id"], r["text"]) for r in mixed} <= {(r[0], r[1]) for r in rows}
    e, packed = packing.Encoder(packing.default_tokenizer()), Counter()
    for r in cp.packing(spark, spark.createDataFrame(mixed, docs.schema), "").collect():
        packed[r["doc_id"]] += r["length"]
    assert packed == {r[0]: want[r[0]] * (len(e.whole(r[1])) // 2 + 1) for r in rows if want[r[0]]}


def test_curriculum_reaches_the_windows(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["one", "two", "three"]) for _ in range(100)), "en", "abc"[i % 3], 0) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    cp.mix(spark, docs, "").write.parquet(str(tmp_path / "mixed"))
    pieces = cp.packing(spark, spark.read.parquet(str(tmp_path / "mixed")), "").collect()
    last = max(r["sequence_id"] for r in pieces)
    of = lambda s, late: sum(r["length"] for r in pieces if r["doc_id"] % 3 == s and (r["sequence_id"] > last / 2) == late)
    assert of(0, False) > 1.4 * of(0, True) and of(2, True) > 1.1 * of(2, False)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in cp.STAGES:
        assert stage(spark, docs, "").count() == 0


def test_language_stage_keeps_clean_documents_and_drops_others(spark):
    """On the synthetic documents: the share kept of those in the four languages, and of planted texts in no language that they teach."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(cp.COLUMNS)
    rng = random.Random(7)
    letters = lambda n: " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randint(4, 9))) for _ in range(n))
    foreign = ["これは日本語の文章です。" * 8, "Это обычный русский текст о погоде. " * 5, "这是一个中文句子。" * 9, "مرحبا بكم في هذا النص. " * 6, *(letters(40) for _ in range(16))]
    planted = spark.createDataFrame([(10_000_000 + i, t, None, "src0", len(t)) for i, t in enumerate(foreign)], docs.schema)
    kept = {r["doc_id"] for r in cp.language_id(spark, docs.unionByName(planted), "").select("doc_id").collect()}
    clean = [r["doc_id"] for r in docs.filter("lang is not null and length(text) >= 20").select("doc_id").collect()]
    assert sum(i in kept for i in clean) >= 0.995 * len(clean) and len(clean) > 900
    assert not kept & {10_000_000 + i for i in range(len(foreign))}


def test_stages_on_nulls_ties_and_clashing_columns(spark):
    rows = [(1, "one two three four five six", "en", None, 5, "x", 1), (1, "one two three four five six", "en", None, 5, "x", 1), (None, "seven eight nine ten", None, "a", None, None, 2), (2, None, "en", "a", 0, "y", 3), (3, "", None, "", 0, "z", 4), (None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows * 2, "doc_id long, text string, lang string, source string, n_chars long, taken string, position int")
    seen = {name: stage(spark, docs, "").collect() for name, stage in cp.STAGES}
    assert {r["doc_id"] for r in seen["language_id"]} <= {1, None} and all(r["text"] for r in seen["language_id"])
    assert sorted(str(r["doc_id"]) for r in seen["near_dedup"]) == sorted(["1", "2", "3", *["None"] * 4])
    assert len(seen["pii"]) == 12 and sum(r["text"] is None for r in seen["pii"]) == 4
    assert all(r["text"] for r in seen["mixing"]) and all(list(r.asDict()) == cp.COLUMNS for r in seen["mixing"])
    assert sum(r["offset"] == 0 for r in seen["packing"]) == 1 and sum(r["doc_tokens"] == 1 for r in seen["packing"]) == 6
