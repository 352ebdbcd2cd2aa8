"""Pattern rules over URLs, indexed by their rarest literal token, with DataFrame functions only.

Each rule is filed under that whole token of its pattern that fewest URLs hold. A URL's tokens fetch the rules filed
under them, and only those run their regular expressions. A rule without a whole literal token is filed under
the empty token, which every URL has.
"""

from __future__ import annotations

import re
import re._parser as P
import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The rule table is broadcast up to this many rules (some MB); larger lists are joined by shuffling.
BROADCAST_RULES = 20_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``pattern`` is sought in host + path (``on="place"``) or in the whole lower-cased URL (``on="url"``)."""

    name: str
    action: str
    pattern: str
    on: str = "url"


def place_rule(action: str, place: str) -> Rule:
    """A rule such as ``example.com/en/``: that host and its subdomains, paths that start so."""
    return Rule(place, action, rf"^([^/]*\.)?{re.escape(place)}", "place")


BASE = [place_rule("block", "com/en/"), place_rule("allow", "example.com/en/7"), place_rule("allow", "net/de/"), place_rule("block", "example.net/de/8"), place_rule("block", "org/es/")]
METHOD = [
    Rule("pills", "block", r"\bcheap-pills\b"),
    Rule("casino", "block", r"\bcasino\b"),
    Rule("poker", "block", r"\bonline-poker\b"),
    Rule("adult", "block", r"\bxxx\b"),
    Rule("adult-tube", "block", r"\bporn\b"),
    Rule("loans", "block", r"\bpayday-loans?\b"),
    Rule("replica", "block", r"\breplica-watches\b"),
    Rule("login", "block", r"/wp-login\.php\b"),
    Rule("session", "block", r"[?&]phpsessid="),
]


_ALNUM = frozenset(range(0x30, 0x3A)) | frozenset(range(0x41, 0x5B)) | frozenset(range(0x61, 0x7B))


#: What Spark's patterns read otherwise than Python's parser: classes in classes, boundaries with a kind, octals, quotes.
_NOT_ALIKE = r"&&|\[[^\]]*\[|\\b\{|\\0|\\Q"


def _edge(op, value) -> bool:
    """Whether an element of a parsed pattern always stands for an end of the text or a character that is in no token."""
    if op is P.AT:
        return value in (P.AT_BEGINNING, P.AT_BEGINNING_STRING, P.AT_END, P.AT_END_STRING, P.AT_BOUNDARY)
    if op is P.IN:
        return all(o is P.LITERAL and v not in _ALNUM or o is P.RANGE and not _ALNUM & set(range(v[0], min(v[1], 0x7F) + 1)) for o, v in value)
    return op is P.LITERAL and value not in _ALNUM


def _flat(parsed) -> list[tuple]:
    """The elements that every match passes in order; groups that must match once are opened."""
    out = []
    for op, value in parsed:
        if op is P.SUBPATTERN and not value[1] and not value[2]:
            out += _flat(value[3])
        elif op is P.MAX_REPEAT and value[1] == 1 and value[0] == 0 and len(inner := _flat(value[2])) and _edge(*inner[-1]):
            out.append((None, "ends at an edge"))  # an optional part: left out, the element before stands there
        else:
            out.append((op, value))
    return out


def literal_tokens(pattern: str) -> list[str]:
    """Whole tokens (runs of a-z, 0-9) that every match of the pattern must show; none where the pattern is not understood.

    The pattern is parsed, and only elements that stand in every match count: a token is a run of literals between two
    elements that are surely no part of a token. Branches, repeats and optional groups end a run without being such an element."""
    if re.search(_NOT_ALIKE, pattern):
        return []
    try:
        with warnings.catch_warnings(action="ignore"):
            parsed = P.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return []
    out: list[str] = []
    run, open_ = "", False  # what has been read of a token; whether an edge stood before it
    for op, value in _flat(parsed):
        if op is P.LITERAL and value in _ALNUM:
            run += chr(value)
            continue
        edge = op is not None and _edge(op, value)
        if run and open_ and edge:
            out.append(run.lower())
        run, open_ = "", edge or op is None and open_ and not run
    return out


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"^[\s\S]*?://", "")).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def tokens(url: Column) -> Column:
    """Distinct lower-cased runs of a-z, 0-9, and the empty token."""
    return F.array_distinct(F.array_append(F.split(F.translate(url, _UPPER, _LOWER), "[^a-z0-9]+"), F.lit("")))


def indexed(urls: DataFrame, rules: list[Rule]) -> DataFrame:
    """(token, name, action, pattern, on, rank): each rule under its literal token that the fewest URLs hold."""
    spark = urls.sparkSession
    options = [(i, t) for i, r in enumerate(rules) for t in (literal_tokens(r.pattern) or [""])]
    named = spark.createDataFrame(options, "rank int, token string")
    seen = urls.select(F.explode(tokens(F.col("url"))).alias("token")).join(_small(named.select("token").distinct(), len(options)), "token").groupBy("token").agg(F.count("*").alias("n"))
    best = named.join(seen, "token", "left").groupBy("rank").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("m")).select("rank", F.col("m.token").alias("token"))
    return spark.createDataFrame([(i, r.name, r.action, r.pattern, r.on) for i, r in enumerate(rules)], "rank int, name string, action string, pattern string, on string").join(best, "rank")


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_RULES else df


def filter_urls(df: DataFrame, base: list[Rule] = BASE, method: list[Rule] = METHOD, url_column: str = "url") -> DataFrame:
    """``df`` with host, path, rule and verdict.

    Of the base rules that fit, the longest wins and gives the verdict; else a URL is blocked if a method rule
    matches, and allowed if none does. A null URL or one without ``://`` has empty host and path. Rows are
    judged by their URL, so repeated rows agree; null URLs are spread over the tasks of the join; columns of ``df`` by these names are replaced, others stay.
    """
    rules = base + method
    df = df.drop("host", "path", "rule", "verdict")
    urls = df.select(F.col(url_column).cast("string").alias("url")).filter("url is not null")
    host, path = split_url(F.col("url"))
    asked = urls.withColumns({"place": F.concat(host, path), "token": F.explode(tokens(F.col("url")))})
    index = _small(indexed(urls, rules), len(rules))
    target = F.when(F.col("on") == "place", F.col("place")).otherwise(F.translate("url", _UPPER, _LOWER))
    hits = asked.join(index, "token").filter(F.call_function("rlike", target, F.col("pattern")))
    fits = F.when(F.col("rank") < len(base), F.struct(F.length("name").alias("long"), (-F.col("rank")).alias("first"), "name", "action"))
    found = hits.groupBy(F.col("url").alias("__url")).agg(F.max(fits).alias("__fit"), F.max(F.when(F.col("rank") >= len(base), F.col("action"))).alias("__method"))
    host, path = split_url(F.col(url_column).cast("string"))
    rest = [f.name for f in df.schema.fields if "map" not in f.dataType.simpleString()]
    out = df.withColumn("__key", F.coalesce(F.col(url_column).cast("string"), F.concat(F.lit("\0"), F.xxhash64(*rest).cast("string"))))
    out = out.join(found, F.col("__key") == F.col("__url"), "left").drop("__key")
    return out.withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit("")), "rule": F.col("__fit.name"), "verdict": F.coalesce("__fit.action", "__method", F.lit("allow"))}).drop("__url", "__fit", "__method")
