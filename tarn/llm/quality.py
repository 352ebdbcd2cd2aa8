"""Line-first cleaning with DataFrame functions only.

Every line is judged alone: it must end like a sentence unless it is long, must not be a navigation bar, and must
hold no boilerplate. Failing lines go; a document that loses too much text that way, or fails the base limits,
is rejected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GAP = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
TERMINAL = "[.!?:;,\\u2026\"'\\u201d\\u00bb)\\]][\\x20\\x09-\\x0D]*$"
SHORT_LINE = 8
NAVIGATION = "([|\\u00bb\\u203a>][^|\\u00bb\\u203a>]*){2,}"
BOILERPLATE = (
    "(?i)(all rights reserved|cookie (policy|settings)|use[s]? cookies|terms of (use|service)|privacy policy|enable javascript"
    "|subscribe to|sign (in|up)|log in|click here|read more|share (this|on)|lorem ipsum|powered by|copyright \\S* ?[0-9]{4})"
)
#: One of these is in every lower-cased text that matches BOILERPLATE, and one of those in every text that matches NAVIGATION: texts without are not searched line by line.
BOILERPLATE_PARTS = (
    "all rights reserved", "cookie policy", "cookie settings", "use cookies", "uses cookies", "terms of use", "terms of service", "privacy policy", "enable javascript",
    "subscribe to", "sign in", "sign up", "log in", "click here", "read more", "share this", "share on", "lorem ipsum", "powered by", "copyright ",
)
BARS = ("|", "\u00bb", "\u203a", ">")
WORD = "[^\\x20\\x09-\\x0D]+"
#: Characters at a line's end that are looked at first.
TAIL = 16
#: A document stays if its remaining lines hold at least this share of its words.
LEAST_PERCENT = 50


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, GAP), "")


def has_any(text: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in parts])


def line_passes(line: Column, suspect: Column, barred: Column) -> Column:
    """Lines without a word pass; they only part paragraphs. ``suspect`` and ``barred``: whether the text may have boilerplate, or bars."""
    tail = F.substring(line, -TAIL, TAIL)
    ends = F.when(tail.rlike(WORD), tail.rlike(TERMINAL)).otherwise(line.rlike(TERMINAL))
    whole = ends | (F.regexp_count(line, F.lit(WORD)) >= SHORT_LINE)
    return ~line.rlike(WORD) | (whole & ~(barred & line.rlike(NAVIGATION)) & ~(suspect & line.rlike(BOILERPLATE)))


def _covered(starts: Column) -> Column:
    """Words covered by windows that begin at the ascending positions."""
    steps = F.transform(starts, lambda x, i: F.when(i == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), x - F.get(starts, i - 1))))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda a, b: a + b)


def clean_lines(df: DataFrame, text_column: str = "text") -> DataFrame:
    """``df`` with cleaned_text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    Null text counts as a text without words: all counts 0, base_failed, cleaned_text ''. Rows are judged alone, so
    ties, repeated rows and null ids change nothing; columns of ``df`` by these names are replaced, others stay.
    A text of fewer than eight words has no window. Texts of any length are judged whole.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    df = df.withColumn("__text", text)
    df = df.withColumn("__lower", F.lower("__text"))
    # in one step with the words, which are used often: a projection of its own would be moved into the loop over the lines
    df = df.withColumns({"__words": words(F.col("__text")), "__lines": F.split("__text", "\n"), "__suspect": has_any(F.col("__lower"), BOILERPLATE_PARTS), "__barred": has_any(F.col("__text"), BARS)})
    hashes = F.transform("__words", lambda w: F.xxhash64(w))
    df = df.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "__hashes": hashes,
            "__full": F.filter("__lines", lambda x: x.rlike(WORD)),
            "__good": F.filter("__lines", lambda x: line_passes(x, F.col("__suspect"), F.col("__barred"))),
        }
    )
    n = F.col("n_words").cast("int")
    # a window's hash by doubling: of two words, of four, of eight
    step, name = 1, "__hashes"
    while step < WINDOW:
        far = F.slice(name, F.lit(step + 1), F.greatest(n - 2 * step + 1, F.lit(0)))
        df = df.withColumn(f"__over{2 * step}", F.when(n >= WINDOW, F.zip_with(F.slice(name, F.lit(1), F.size(far)), far, lambda a, b: F.xxhash64(a, b))))
        step, name = 2 * step, f"__over{2 * step}"
    df = df.withColumn("__windows", F.col(name))
    df = df.withColumn("__twice", F.coalesce(F.size(F.array_distinct("__windows")) < F.size("__windows"), F.lit(False)))
    placed = F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("__placed", F.when(F.col("__twice"), placed))
    same = lambda x, i: (F.get(F.col("__placed"), i - 1)["h"] == x["h"]) | (F.get(F.col("__placed"), i + 1)["h"] == x["h"])
    starts = F.sort_array(F.transform(F.filter("__placed", lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["i"]))
    df = df.withColumn("__starts", F.when(F.col("__twice"), starts))
    df = df.withColumns(
        {
            "cleaned_text": F.array_join("__good", "\n"),
            "word_chars": F.length(F.array_join("__words", "")).cast("long"),
            "n_symbols": (F.length("__text") - F.length(F.translate("__text", SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("__full") - F.size(F.array_distinct("__full"))).cast("long"),
            "n_repeat_words": F.when(F.col("__twice"), _covered(F.col("__starts"))).otherwise(F.lit(0).cast("long")),
        }
    )
    df = df.withColumns(
        {
            "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
            "__left": F.when(F.size("__good") == F.size("__lines"), F.col("n_words")).otherwise(F.regexp_count("cleaned_text", F.lit(WORD)).cast("long")),
        }
    )
    df = df.withColumn("kept", ~F.col("base_failed") & (100 * F.col("__left") >= LEAST_PERCENT * F.col("n_words")))
    return df.drop(*[c for c in df.columns if c.startswith("__")])
