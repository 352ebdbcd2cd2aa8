"""Conversations rendered by compiled templates, with the spans a model should learn, and read back.

Control strings inside texts are escaped, so that marks in the output are the template's own and the output can be
read back to the same turns. Rendering and reading are streams: a task holds a turn at a time, not a conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import map_batches
from .template import Template

CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TEMPLATE = (
    "{% for m in messages %}{{ '<|im_start|>' ~ (m.role | escape_line) ~ '\\n' }}"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "{{ '<|im_end|>' ~ '\\n' }}{% endfor %}"
)
#: Characters of output to a row; a row ends with the piece that reaches this many.
PART = 1_000_000
_TO_ESCAPE = re.compile(r"\\|" + "|".join(map(re.escape, sorted(CONTROL, key=len, reverse=True))))
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str | None) -> str:
    """A backslash is doubled and a control string is broken by one after its first character; no control string is left."""
    return _TO_ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text or "")


def escape_line(text: str | None) -> str:
    return escape(text).replace("\n", "\\n")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def unescape_line(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


FILTERS = {"escape": escape, "escape_line": escape_line}


def format_conversations(df: DataFrame, template: str = TEMPLATE, id_column: str = "conv_id") -> DataFrame:
    """(conv_id, part, text, spans): each conversation's rendering in parts of about a million characters, in order.

    ``df`` has conv_id, turn, role, text; turns are ordered by turn, then role and text (repeated rows are repeated turns).
    Null texts and roles are empty; rows with a null conv_id are one conversation. ``spans`` holds pairs
    [start, end) within the part's text that lie under the template's generation mark; none is split. Other
    columns are ignored; an empty table gives an empty result.
    """
    Template(template, FILTERS)  # fails here, not on the executors

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = Template(template, FILTERS)
        stream = chain.from_iterable(zip(*(c.to_pylist() for c in b.slice(at, 256).columns), strict=True) for b in batches for at in range(0, b.num_rows, 256))
        out: list[tuple] = []
        held = 0

        def batch() -> pa.RecordBatch:
            nonlocal out, held
            ids, parts, texts, spans = zip(*out, strict=True)
            out, held = [], 0
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(parts, pa.int32()), pa.array(texts, pa.string()), pa.array(spans, pa.list_(pa.int64()))], ["conv_id", "part", "text", "spans"])

        for conv, turns in groupby(stream, key=lambda r: r[0]):
            text, spans, size, part, was = [], [], 0, 0, False
            for piece, inside in compiled.pieces(messages=({"turn": t, "role": r or "", "text": x or ""} for _, t, r, x in turns)):
                if size >= PART and not (was and inside):
                    out.append((conv, part, "".join(text), spans))
                    yield batch()
                    text, spans, size, part = [], [], 0, part + 1
                if inside:
                    if was and spans and spans[-1] == size:
                        spans[-1] = size + len(piece)
                    else:
                        spans += [size, size + len(piece)]
                text.append(piece)
                size += len(piece)
                was = inside
            out.append((conv, part, "".join(text), spans))
            held += size
            if held >= PART:
                yield batch()
        if out:
            yield batch()

    order = ["conv_id", "turn", "role", "text"]
    slim = df.select(F.col(id_column).cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_batches(slim.repartition(parts, "conv_id").sortWithinPartitions(*order), rows, "conv_id long, part int, text string, spans array<long>")


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, from the rows of ``format_conversations`` with the default template as they come (in order, unshuffled):
    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = chain.from_iterable(zip(*(c.to_pylist() for c in b.slice(at, 4).columns), strict=True) for b in batches for at in range(0, b.num_rows, 4))
        out = []
        for conv, parts in groupby(stream, key=lambda r: r[0]):
            turns, loss, rest = hashlib.sha256(), hashlib.sha256(), ""
            n = chars = learned = 0
            for _, _, text, spans in parts:
                chars += len(text)
                for a, b in zip(spans[::2], spans[1::2], strict=True):
                    said = unescape(text[a:b])
                    learned += len(said)
                    loss.update(said.encode())
                rest += text
                to = 0
                while m := _TURN.match(rest, to):
                    turns.update(f"{unescape_line(m[1])}\n{unescape(m[2])}\n".encode())
                    n, to = n + 1, m.end()
                rest = rest[to:]
            if rest:
                raise ValueError(f"conversation {conv} does not read back: {rest[:80]!r}")
            out.append((conv, n, turns.hexdigest(), learned, loss.hexdigest(), chars))
            if len(out) == 1000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    return map_batches(formatted.select("conv_id", "part", "text", "spans"), rows, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
