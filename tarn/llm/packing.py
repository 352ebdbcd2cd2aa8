"""Mixture-controlled packing of token streams into windows.

Each source is a queue of its documents' tokens, cut into blocks of ``quantum`` tokens. Deficit round-robin serves,
block by block, the queue that lags most behind its target share: block k of a queue with weight w is due at
(2k + 1) / (2w), and blocks are served in due order, earlier queues first in a tie. That order has a closed form
(how many blocks of every other queue are due before), so with up to MOST_QUEUES sources each task computes the place of its own blocks in the
whole stream, and deficits carry across windows and partitions without any task seeing another's rows. A queue that
runs dry leaves its share to the rest. With more sources, or under schedules, the blocks are sorted by due time instead. The queues' last part-blocks follow at the end, so that only the last
window is padded.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .mixing import MOST, position
from .storage import map_batches, materialize
from .textops import raw_texts, slices

WINDOW = 2048
QUANTUM = 256
EOS = 1
#: With more sources than this, a distributed sort places the blocks (in the same order), so that what a task holds is bounded.
MOST_QUEUES = 1024
#: Units of words whose ids a worker keeps (some 50 MB), and the longest that is kept.
CACHED_UNITS, LONGEST_UNIT = 250_000, 64
#: The tokenizer's own first step, which ``Encoder`` follows over bytes; another one is given whole texts. Fixed value.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_GAP, _LETTER, _DIGIT, _SIGN, _ODD, _WORD = range(6)


def _byte_kinds() -> np.ndarray:
    """What each byte is in text that is lower-case as far as ASCII goes. Bytes from 0x80 count as letters until their pair is looked at."""
    kinds = np.full(256, _ODD, np.uint8)
    kinds[0x21:0x7F] = _SIGN
    kinds[[0x20, 9, 10, 11, 12, 13]] = _GAP
    kinds[0x30:0x3A] = _DIGIT
    kinds[0x61:0x7B] = kinds[0x80:] = _LETTER
    kinds[0x27] = _ODD  # the apostrophe begins units of its own
    return kinds


def _pair_kinds() -> tuple[np.ndarray, np.ndarray]:
    """Of the two-byte sequences (by 64 * lead + rest): Latin letters that are lower-case, or are after adding 0x20 to the second byte; and those latter."""
    plain, upper = np.zeros(1 << 12, bool), np.zeros(1 << 12, bool)
    for c in map(chr, range(0xC0, 0x180)):
        a, b = c.encode()
        at = (a & 0x3F) << 6 | b & 0x3F
        low = c.lower()
        plain[at] = c.isalpha() and c not in "ŉſ" and (low == c or ord(low[0]) == ord(c) + 0x20)
        upper[at] = plain[at] and low != c
    return plain, upper


_KINDS, (_PLAIN, _UPPER) = _byte_kinds(), _pair_kinds()


class Encoder:
    """Token ids as bytes. Texts part at white space, where this kind of tokenizer never joins, and plain words part further
    into runs of letters, digits and signs, as its own first step does; all this on the bytes of many texts at once, so
    that each distinct unit is encoded once. Words with anything else (apostrophes, other scripts, special tokens) are units
    as a whole. A tokenizer with another first step is given whole texts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        steps = (made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        forms = [x.get("type") for x in (made.get("normalizer") or {}).get("normalizers") or []]
        self.parted = steps[0].get("pattern") == {"Regex": _SPLIT} and [x.get("type") for x in steps] == ["Split", "ByteLevel"] and forms == ["NFC", "Replace", "Lowercase"]
        self.units: dict[bytes, bytes] = {}
        if self.parted:
            self.plain = Tokenizer(self.tokenizer.model)  # for units that need no normal form and no parting; shares the vocabulary
            self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _learn(self, new: list[bytes]) -> None:
        """Encode the units joined by spaces, some hundreds at once."""
        for i in range(0, len(new), 500):
            part = new[i : i + 500]
            e = self.plain.encode(b" ".join(part).decode(), add_special_tokens=False)
            ids, of = np.array(e.ids, self.dtype), np.array(e.word_ids)
            cuts = np.flatnonzero(of[1:] != of[:-1]) + 1
            raw, width = ids.tobytes(), self.dtype.itemsize
            at = [0, *(cuts * width).tolist(), len(raw)]
            self.units.update(zip(part, (raw[x:y] for x, y in zip(at[:-1], at[1:], strict=True)), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.encode_raw([t.encode() for t in texts])

    def encode_raw(self, texts: list[bytes]) -> list[bytes]:
        if not self.parted:
            return [self.whole(t.decode()) for t in texts]
        if not texts:
            return []
        joined = b"\n".join(texts) + b"\n"
        low = np.frombuffer(bytearray(joined.lower()), np.uint8)
        kind = _KINDS[low]
        lead = np.flatnonzero(low >= 0xC0)
        pair = (low[lead] & 0x3F).astype(np.int32) << 6 | low[lead + 1] & 0x3F
        plain = (low[lead] < 0xE0) & _PLAIN[pair]
        low[lead[_UPPER[pair] & plain] + 1] += 0x20
        kind[lead[~plain]] = _ODD
        at = joined.find(b"<|")  # may begin a special token
        while at >= 0:
            kind[at] = _ODD
            at = joined.find(b"<|", at + 1)
        odd = self._odd_words(joined, low, kind)
        first = kind != _GAP
        inside = first.copy()
        first[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        bounds = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=bounds[1:])
        begins = np.searchsorted(np.flatnonzero(first), bounds)
        data = low[inside]
        starts = np.append(np.flatnonzero(first[inside]), len(data)).astype(np.int32)
        found = pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(data)]).dictionary_encode()
        keys = found.dictionary.to_pylist()
        if len(self.units) > CACHED_UNITS:
            self.units.clear()
        known = list(map(self.units.get, keys))
        missing = [i for i, x in enumerate(known) if x is None]
        new = [keys[i] for i in missing]
        for k in odd.intersection(new):
            self.units[k] = self.whole(k.decode())
        self._learn([k for k in new if k not in odd] if odd else new)
        for i, k in zip(missing, new, strict=True):
            known[i] = self.units[k] if len(k) <= LONGEST_UNIT else self.units.pop(k)
        ids = pa.array(known, pa.binary()).take(found.indices)
        if not len(ids):
            return [b""] * len(texts)
        at = np.frombuffer(ids.buffers()[1], np.int32)[begins].tolist()
        raw = ids.buffers()[2].to_pybytes()
        return [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def _odd_words(self, joined: bytes, low: np.ndarray, kind: np.ndarray) -> set[bytes]:
        """Make each word with an odd byte one unit of its own bytes, and return those words."""
        odd = np.flatnonzero(kind == _ODD)
        if not len(odd):
            return set()
        gaps = np.flatnonzero(kind == _GAP)
        after = np.unique(np.searchsorted(gaps, odd))
        ends = gaps[after]
        starts = np.where(after > 0, gaps[after - 1] + 1, 0)
        out = set()
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            kind[a:b] = _WORD
            word = joined[a:b]
            low[a:b] = np.frombuffer(word, np.uint8)
            out.add(word)
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for all tasks of a worker, with what it has cached."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_rows(df: DataFrame, tokenizer: str, id_column: str, text_column: str, queue) -> DataFrame:
    """(part, nth, doc_id, queue, ahead, n, ids): ``nth`` row of its task; ``ahead`` counts the queue's tokens before, in the same task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = encoder(tokenizer), TaskContext.get().partitionId()
        end = np.array([EOS], own.dtype).tobytes()
        ahead: dict[str, int] = {}
        done = 0
        for batch in slices(batches):
            ids = [x + end for x in own.encode_raw(raw_texts(batch))]
            n = [len(x) // own.dtype.itemsize for x in ids]
            before = []
            for q, x in zip(batch.column(2).to_pylist(), n, strict=True):
                before.append(ahead.get(q, 0))
                ahead[q] = before[-1] + x
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(n), pa.int32()), pa.array(np.arange(done, done + len(n))), batch.column(0), batch.column(2), pa.array(before, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())],
                ["part", "nth", "doc_id", "queue", "ahead", "n", "ids"],
            )
            done += len(n)

    slim = df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"), queue.alias("queue"))
    return map_batches(slim, rows, "part int, nth long, doc_id long, queue string, ahead long, n long, ids binary")


class Schedule:
    """Where each queue's tokens go in the packed stream."""

    def __init__(self, totals: list[int], weights: list[int], quantum: int):
        self.quantum, self.totals = quantum, np.array(totals, np.int64)
        self.blocks = self.totals // quantum
        self.weights = [max(1, int(w)) for w in weights]
        self.main = int(self.blocks.sum()) * quantum
        self.tail = self.main + np.concatenate([[0], np.cumsum(self.totals - self.blocks * quantum)[:-1]])

    def ranks(self, queue: np.ndarray, block: np.ndarray) -> np.ndarray:
        """How many full blocks are served before each of these."""
        big = (2 * int(block.max(initial=0)) + 1) * max(self.weights) >= 1 << 62
        due = 2 * block.astype(object if big else np.int64) + 1
        weight = np.array(self.weights, object if big else np.int64)[queue]
        out = np.zeros(len(block), np.int64)
        for j, (w, n) in enumerate(zip(self.weights, self.blocks.tolist(), strict=True)):
            least = (due * w - np.where(queue < j, 1, 0)) // weight
            out += np.where(queue == j, block, np.minimum((least + 1) // 2, n)).astype(np.int64)
        return out

    def pieces(self, queue: np.ndarray, start: np.ndarray, n: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``cut_pieces`` of documents whose blocks are placed by this schedule."""
        doc, block = touched(start, n, self.quantum)
        own = queue[doc]
        full = block < self.blocks[own]
        place = np.empty(len(doc), np.int64)
        place[full] = self.ranks(own[full], block[full]) * self.quantum
        place[~full] = self.tail[own[~full]]
        return cut_pieces(start, n, doc, block, place, self.quantum, window)


def touched(start: np.ndarray, n: np.ndarray, quantum: int) -> tuple[np.ndarray, np.ndarray]:
    """(document's index, block) for each block that a document at ``start`` of its queue lies in."""
    first, last = start // quantum, (start + n - 1) // quantum
    count = last - first + 1
    doc = np.repeat(np.arange(len(n)), count)
    return doc, np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + first[doc]


def cut_pieces(start: np.ndarray, n: np.ndarray, doc: np.ndarray, block: np.ndarray, place: np.ndarray, q: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of (document's index, token before, length, place in the stream), from the place of each block that is touched."""
    a = np.maximum(block * q, start[doc])
    b = np.minimum((block + 1) * q, (start + n)[doc])
    place = place + a - block * q
    size = b - a
    over = (place + size - 1) // window > place // window  # only part-blocks straddle windows, and one edge at most
    if over.any():
        head = (window - place % window)[over]
        doc, a, place = (np.concatenate([x, x[over] + y]) for x, y in ((doc, 0), (a, head), (place, head)))
        rest = size[over] - head
        size[over] = head
        size = np.concatenate([size, rest])
        order = np.lexsort((a, doc))
        doc, a, place, size = doc[order], a[order], place[order], size[order]
    joins = np.zeros(len(doc), bool)
    joins[1:] = (doc[1:] == doc[:-1]) & (place[1:] == place[:-1] + size[:-1]) & (place[1:] // window == place[:-1] // window)
    head = np.flatnonzero(~joins)
    return doc[head], (a - start[doc])[head], np.add.reduceat(size, head) if len(head) else size, place[head]


def in_rounds(tokens: DataFrame) -> DataFrame:
    """(part, nth, queue, n, task, ahead) for rows of tokens as their queues take them: the first copies of all documents in hash
    order, then the second ones, and so on; ``ahead`` counts the queue's tokens before, in the same task."""
    slim = tokens.select("part", "nth", "queue", "n", "doc_id", F.xxhash64("ids").alias("hash"))
    alike = Window.partitionBy("queue", "doc_id", "hash")
    slim = slim.withColumns({"copy": F.row_number().over(alike.orderBy("part", "nth")), "copies": F.count("*").over(alike)})
    # many equal rows without an id are as many documents, not rounds of one
    turn = F.when(F.col("doc_id").isNull() & (F.col("copies") > MOST), F.col("copy") % MOST + 1).otherwise(F.col("copy"))
    order = ["queue", turn, F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), "doc_id", "hash", "copy"]
    ordered = slim.repartitionByRange(*order).sortWithinPartitions(*order).select("part", "nth", "queue", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, ahead = TaskContext.get().partitionId(), {}
        for batch in batches:
            before = []
            for q, x in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                before.append(ahead.get(q, 0))
                ahead = {q: before[-1] + x}  # rows are sorted by queue
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([task] * len(before), pa.int32()), pa.array(before, pa.int64())], ["part", "nth", "queue", "n", "task", "ahead"])

    return materialize(map_batches(ordered, run, "part int, nth long, queue string, n long, task int, ahead long"), "rounds")


def _exact(num: str, den: str) -> list[Column]:
    """Columns that sort as num / den does: the whole part and 100 binary places, which tell apart all fractions of parts up to 2^43."""
    out, rest = [F.expr(f"({num}) div ({den})")], f"(({num}) % ({den}))"
    places = []
    for _ in range(5):
        places.append(F.expr(f"shiftleft({rest}, 20) div ({den})"))
        rest = f"(shiftleft({rest}, 20) % ({den}))"
    return [*out, F.shiftleft(places[0], 20) + places[1], F.shiftleft(places[2], 20) + places[3], places[4]]


def place_blocks(tokens: DataFrame, due: list[Column], quantum: int) -> DataFrame:
    """(part, nth, begin, places) for each row of tokens (part, nth, queue, begin, n, total, ...): the place in the stream of each
    block that it touches, in order. Blocks stand by ``due`` (over ``block`` too), queue and number; part-blocks follow, by queue.

    Rows that share a block are sorted next to each other, and that with its first token counts the block's length; so
    a running sum over the sorted rows is the place, whatever the number of queues."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, n = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("begin", "n"))
            doc, block = touched(begin, n, quantum)
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(doc)) for c in batch.columns), pa.array(block)], [*batch.schema.names, "block"])

    slim = tokens.drop("ids", "doc_id", "ahead", "base")
    pieces = map_batches(slim, split, slim.select("*", F.lit(0).cast("long").alias("block")).schema)
    length = F.least(F.lit(quantum), F.col("total") - F.col("block") * quantum)
    names = [f"due{i}" for i in range(len(due))]
    tail = F.col("length") < quantum
    pieces = pieces.withColumn("length", length.cast("long")).withColumns(dict(zip(names, [F.when(~tail, d) for d in due], strict=True))).withColumn("tail", tail)
    order = ["tail", *names, "queue", "block", "begin"]
    ordered = pieces.repartitionByRange(*order).sortWithinPartitions(*order).select("part", "nth", "block", (F.col("begin") <= F.col("block") * quantum).alias("owns"), "length", "begin")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, task = 0, TaskContext.get().partitionId()
        for batch in batches:
            size = batch.column(4).to_numpy()
            own = np.where(batch.column(3).to_numpy(zero_copy_only=False), size, 0)
            after = done + np.cumsum(own)
            done = int(after[-1]) if len(after) else done
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], batch.column(5), pa.array([task] * len(size), pa.int32()), pa.array(after - size), pa.array(own)], ["part", "nth", "block", "begin", "task", "place", "own"])

    placed = materialize(map_batches(ordered, run, "part int, nth long, block long, begin long, task int, place long, own long"), "blocks")
    # a row a task
    before = placed.groupBy("task").agg(F.sum("own").alias("own")).select("task", F.coalesce(F.sum("own").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = placed.join(F.broadcast(before), "task").select("part", "nth", "begin", "block", (F.col("place") + F.col("before")).alias("place"))
    return placed.groupBy("part", "nth", "begin").agg(F.array_sort(F.collect_list(F.struct("block", "place"))).getField("place").alias("places"))


def pack(df: DataFrame, tokenizer: str | None = None, targets: dict[str | None, float] | None = None, schedules: DataFrame | None = None, window: int = WINDOW, quantum: int = QUANTUM, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and then id 1 (null text: id 1 alone); each id lies in one piece. Windows follow
    ``targets`` (share by source, in any unit) until a queue runs dry, whose share then falls to the rest; by default the
    sources' own token counts, so that every window is a small copy of the whole and all queues end together. The price
    is that a document is cut wherever a block of ``quantum`` tokens ends. With ``schedules`` (a row a source: source, start, end) a source's share of the windows moves over the
    stream as its schedule does, each block due at its training position, and documents stand ``in_rounds``. A null
    source is a queue of its own; null or repeated ids are packed row by row; other columns are ignored; an empty
    table gives an empty result. Only the last window may be short.
    """
    if window % quantum:
        raise ValueError("quantum must divide window")
    if targets and schedules is not None:
        raise ValueError("shares are given by targets or by schedules")
    spark, tokenizer = df.sparkSession, tokenizer or default_tokenizer()
    source = F.col(source_column).cast("string")
    queue = F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))
    tokens = materialize(token_rows(df, tokenizer, id_column, text_column, queue), "tokens")
    lined = tokens.withColumn("task", F.col("part")) if schedules is None else in_rounds(tokens)
    sums = materialize(lined.groupBy("task", "queue").agg(F.sum("n").alias("n")), "token-sums")
    closed = schedules is None and sums.select("queue").distinct().limit(MOST_QUEUES + 1).count() <= MOST_QUEUES
    each = Window.partitionBy("queue")
    base = sums.select("task", "queue", F.coalesce(F.sum("n").over(each.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.sum("n").over(each).alias("total"))
    shares = {"n" if s is None else f"s{s}": v for s, v in (targets or {}).items()}
    unit = 1_000_000 / max(sum(shares.values()), 1e-9)
    weights = {s: max(1, round(v * unit)) for s, v in shares.items()}
    begin = (F.col("base") + F.col("ahead")).alias("begin")
    if closed:
        totals = {r[0]: r[1] for r in sums.groupBy("queue").agg(F.sum("n")).collect()}  # at most MOST_QUEUES rows
        names = sorted(totals)
        schedule = Schedule([totals[x] for x in names], [weights.get(x, 1) if targets else totals[x] for x in names], quantum)
        number = {x: i for i, x in enumerate(names)}
        placed = lined.join(base, ["task", "queue"]).select("doc_id", "queue", "n", "ids", begin)
    else:
        if schedules is not None:
            known = schedules.select(F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")).alias("queue"), "start", "end")
            u = (2 * F.col("block") + 1) * quantum / (2 * F.col("total"))
            base, due = base.join(known, "queue", "left").fillna(1.0, ["start", "end"]), [position(u, F.col("start"), F.col("end"))]
        elif targets:
            known = spark.createDataFrame(list(weights.items()), "queue string, weight long")
            base, due = base.join(known, "queue", "left").fillna(1, ["weight"]), _exact("2 * block + 1", "2 * weight")
        else:
            due = _exact("2 * block + 1", "2 * total")
        placed = tokens.join(place_blocks(lined.join(base, ["task", "queue"]).select("*", begin), due, quantum), ["part", "nth"]).select("doc_id", "queue", "n", "ids", "begin", "places")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices([whole], "ids"):
                ids = [x.as_buffer().to_pybytes() for x in batch.column(3)]
                n = batch.column(2).to_numpy()
                wide = len(ids[0]) // int(n[0])
                begin = batch.column(4).to_numpy()
                if closed:
                    doc, a, size, place = schedule.pieces(np.array([number[x] for x in batch.column(1).to_pylist()]), begin, n, window)
                else:
                    doc, a, size, place = cut_pieces(begin, n, *touched(begin, n, quantum), batch.column(5).flatten().to_numpy(), quantum, window)
                crc = np.empty(len(doc), np.int64)
                at, now = -1, b""
                for i, (d, x, m) in enumerate(zip(doc.tolist(), a.tolist(), size.tolist(), strict=True)):
                    if d != at:
                        at, now = d, np.frombuffer(ids[d], f"<u{wide}").astype("<u4").tobytes()
                    crc[i] = zlib.crc32(now[4 * x : 4 * (x + m)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(doc)), *(pa.array(x.astype(np.int64)) for x in (a, size, crc, n[doc], place // window, place % window))],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
                )

    return map_batches(placed, rows, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
