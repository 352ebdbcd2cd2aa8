"""From raw documents to packed training windows, in five stages over whole tables.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; every result is written as
Parquet and read again. All but the last return the columns of ``documents``. Empty tables pass through; extra
columns, also of names that the stages use inside, are dropped. Null texts are rejected by the first stage, which finds no
letters in them; the later stages, called alone, keep them: near_dedup and pii as they are, mixing drops them with all
texts without a word, packing gives them their end mark. Rows that tie in every order are equal, so it does not
matter which comes first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.langid import UNDETERMINED, learn, predict
from tarn.llm.mixing import mix_sources, source_schedules
from tarn.llm.neardup import BROADCAST_IDS, near_duplicates
from tarn.llm.packing import pack
from tarn.llm.pii import redact_pii
from tarn.llm.storage import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Below this score a document goes: no language stands out, or the text costs over half a bit a byte more than twice what texts of its
#: language do.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; texts without letters, in other languages or scripts, and junk go.
    A missing label is filled in; null ids and repeated rows are judged like others."""
    docs = docs.select(COLUMNS)
    judged = predict(docs, learn(docs)).filter((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return judged.withColumn("lang", F.coalesce("lang", "lang_pred")).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): that with the least id. Null ids stay; a row that repeats id and text stays once."""
    docs = docs.select(COLUMNS)
    judged = materialize(near_duplicates(docs), "near-duplicates")
    dropped = judged.filter("not kept").select("doc_id").distinct()
    few = F.broadcast(dropped) if dropped.count() <= BROADCAST_IDS else dropped
    docs = docs.join(few, "doc_id", "left_anti")
    again = judged.filter("kept and doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if again.isEmpty():
        return docs
    return docs.join(again, "doc_id", "left_anti").unionByName(docs.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind, lengths to match. Null and empty texts stay."""
    return redact_pii(docs.select(COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them (a part counts as a whole; null and wordless texts are never taken). Null
    sources are a source; documents without an id are told apart by their text. Their training order is set by the packing stage, as no order of rows outlives a table."""
    mixed = mix_sources(docs.select(COLUMNS), keep_text=True)
    return mixed.filter("taken > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int")))).select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 2048 tokens along the mixture's curriculum: each source has its share of the mix,
    early or late as its schedule says, and takes its documents round by round in hash order.

    Null texts are one end mark, null ids are packed row by row. Schedules go to sources in turn by name, as in the mix; a source of which the mix took nothing (a target under one word) has no turn here."""
    docs = docs.select(COLUMNS)
    return pack(docs, schedules=source_schedules(docs))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("pii", pii), ("mixing", mix), ("packing", packing)]
#: SQL cannot express near-duplicate groups, byte models or tokenizing; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
