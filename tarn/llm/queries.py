"""One query opN_<name> for each operator, over its whole table, and SQL for the same rows where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql
from .chat import format_conversations, read_back
from .langid import identify
from .mixing import mix_sources
from .neardup import near_duplicates
from .packing import pack
from .pii import find_pii
from .quality import clean_lines
from .spotsigs import fingerprints
from .urlrules import filter_urls
from .warc import archive_pages


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_find_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(_table(spark, sf_dir, "documents"))


def op2_pack_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"))


def op3_salvage_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(_table(spark, sf_dir, "pages"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), k=4, percent=80)


def op5_chat_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(_table(spark, sf_dir, "conversations").select(own.columns).unionByName(own)))


def op6_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return clean_lines(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op8_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(_table(spark, sf_dir, "documents"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "position", F.get("positions", F.lit(1)).alias("position_2"), F.get("positions", F.lit(2)).alias("position_3"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_find_pii": op1_find_pii,
    "op2_pack_mixture": op2_pack_mixture,
    "op3_salvage_warc": op3_salvage_warc,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_chat_templates": op5_chat_templates,
    "op6_line_quality": op6_line_quality,
    "op7_url_rules": op7_url_rules,
    "op8_spotsigs": op8_spotsigs,
    "op9_mix_sources": op9_mix_sources,
    "op10_language_id": op10_language_id,
}
ORACLE = {"op6_line_quality": sql.OP6, "op7_url_rules": sql.OP7, "op9_mix_sources": sql.OP9}
