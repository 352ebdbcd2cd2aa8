"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds at-signs, plus signs, digits, schemes and identifier cues. From each anchor
a deterministic parser expands to the boundaries of an email, IP address, card, phone number, web address, account or
secret, and validates it. A parser's runs are bounded or do not overlap, failing ones included, so time is linear in the text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import map_batches
from .textops import slices

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account", "secret")
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CHAIN = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_DIAL = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_AFTER_SCHEME = re.compile(r"[^\s<>\"'`{}|\\^]+")
_AFTER_CUE = re.compile(r"(?:\s{0,2}(?:number|no\.?|nr\.?|#))?\s{0,2}[:=]?\s{0,2}[\"']?")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_ACCOUNT = re.compile(r"[0-9](?:[ -]?[0-9]){5,17}(?![0-9])")
_SECRET = re.compile(r"[A-Za-z0-9_+/=-]{16,}")

#: Keys that tell by their beginning what they are. Fixed values.
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "sk_live_", "AIza", "-----BEGIN ")
_KEY = re.compile(
    r"(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])|gh[pos]_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_-]{20}|xox[bp]-[A-Za-z0-9-]{10,}"
    r"|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|-----BEGIN (?:[A-Z]{2,9} ){0,2}PRIVATE KEY-----"
)
_END_KEY, LONGEST_KEY = "PRIVATE KEY-----", 8192
SCHEMES = ("http://", "https://", "ftp://")
CUES = {"iban": "iban", "ssn": "ssn", "social security": "ssn", "account": "account", "acct": "account", "passport": "account", "token": "secret", "secret": "secret", "password": "secret", "api_key": "secret", "api key": "secret"}


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for x in "@+0123456789":
        a.add_word(x, ("digit" if x.isdigit() else x, 1))
    for s in SCHEMES:
        for x in {s, s.upper()}:
            a.add_word(x, ("scheme", len(x)))
    for x in PREFIXES:
        a.add_word(x, ("key", len(x)))
    for cue, kind in CUES.items():
        for x in {cue, cue.upper(), cue.capitalize(), cue.title()}:
            a.add_word(x, (kind, len(x)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(x), 10)) for x in even)) % 10 == 0


def iban_holds(text: str) -> bool:
    x = text.replace(" ", "")
    return 15 <= len(x) <= 34 and int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def find(text: str, anchors: ahocorasick.Automaton) -> list[Span]:
    """All spans, by kind as in ``KINDS``, then start; code points, end exclusive. Spans of one kind do not overlap."""
    spans: dict[str, list[tuple[int, int]]] = {}
    done = dict.fromkeys(KINDS, 0)

    def add(kind: str, a: int, b: int, holds: bool = True) -> None:
        done[kind] = b  # a failing match is passed over as a whole
        if holds:
            spans.setdefault(kind, []).append((a, b))

    for last, (kind, n) in anchors.iter(text):
        at = last - n + 1
        if kind == "digit":
            if at and text[at - 1] in _DIGITS:
                continue
            if at >= done["card"] and (m := _CHAIN.match(text, at)):
                digits = re.sub("[ -]", "", m[0])
                add("card", at, m.end(), 16 <= len(digits) <= 19 and luhn(digits))
            if at >= done["ip"] and (m := _IP.match(text, at)):
                add("ip", at, m.end(), all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in m[0].split(".")))
        elif kind == "@":
            a = at
            while a > done["email"] and text[a - 1] in _LOCAL:
                a -= 1
            if a < at and (m := _DOMAIN.match(text, last + 1)):
                add("email", a, m.end())
        elif kind == "+":
            if m := _DIAL.match(text, at):
                add("phone", at, m.end(), 8 <= sum(c in _DIGITS for c in m[0]) <= 15)
        elif kind == "scheme":
            if at >= done["url"] and (m := _AFTER_SCHEME.match(text, last + 1)) and (body := m[0].rstrip(".,;:!?)]")):
                add("url", at, last + 1 + len(body))
        elif at and text[at - 1].isalnum():
            continue
        elif kind == "key":
            if at >= done["secret"] and (m := _KEY.match(text, at)):
                end = text.find(_END_KEY, m.end(), m.end() + LONGEST_KEY) if m[0].endswith(_END_KEY) else -1
                add("secret", at, m.end() if end < 0 else end + len(_END_KEY))
        else:
            a = _AFTER_CUE.match(text, last + 1).end()
            to = "secret" if kind == "secret" else "account"
            if a < done[to]:
                continue
            if kind == "iban" and (m := _IBAN.match(text, a)):
                while m and not iban_holds(m[0]) and " " in m[0]:  # a following word may look like a group
                    m = _IBAN.fullmatch(text, a, a + m[0].rindex(" "))
                if m and iban_holds(m[0]):
                    add(to, a, m.end())
            elif kind == "ssn" and (m := _SSN.match(text, a)) or kind == "account" and (m := _ACCOUNT.match(text, a)):
                add(to, a, m.end())
            elif kind == "secret" and (m := _SECRET.match(text, a)):
                add(to, a, m.end(), any(c in _DIGITS for c in m[0]))  # a failing run is not looked at again by the cues inside it
    return [(k, a, b) for k in KINDS for a, b in spans.get(k, ())]


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each run of overlapping spans replaced by the first span's kind, as ``<EMAIL>``."""
    if not spans:
        return text
    out, to = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= to:
            out += [text[to:a], f"<{kind.upper()}>"]
        to = max(to, b)
    return "".join([*out, text[to:]])


def find_pii(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Null text counts as empty; null ids stay. Rows are judged alone, so repeated rows agree. Other columns are
    ignored. Whole texts are searched, in batches of bounded size.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for batch in slices(batches):
            found = [find(t, anchors) if t else [] for t in batch.column(1).to_pylist()]
            count = lambda kind: pa.array([sum(s[0] == kind for s in spans) for spans in found], pa.int64())  # noqa: E731, B023
            digests = [hashlib.sha256(written([s for s in spans if s[0] in BASE_KINDS]).encode()).hexdigest() for spans in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(count(k) for k in BASE_KINDS), pa.array(digests, pa.string()), pa.array([written(s) for s in found], pa.string())],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
            )

    slim = df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return map_batches(slim, rows, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact_pii(df: DataFrame, text_column: str = "text", length_column: str | None = "n_chars") -> DataFrame:
    """``df`` with every span replaced by its kind; the length column, if there is one, follows. Null text stays null."""
    names = df.columns
    at = names.index(text_column)
    size = names.index(length_column) if length_column in names else None

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for batch in slices(batches, text_column):
            texts = [redact(t, find(t, anchors)) if t else t for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            if size is not None:
                columns[size] = pa.array([None if t is None else len(t) for t in texts], columns[size].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema.set(at, pa.field(text_column, pa.string())))

    return map_batches(df, rows, df.schema)
