"""Hashing words and shingles of many texts at once with numpy."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

_R = 0x9E3779B97F4A7C15 | 1
#: Word hashes are keyed, so that no one can write words that collide under another key.
KEY = 0x1B873593CC9E2D51
#: Longer words, in bytes, are hashed one by one.
LONG_WORD = 256
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Of eight bytes, the first n.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finisher over uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes], gap: np.ndarray = _SPACE, key: int = KEY) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, and where each text's words begin (one more entry at the end).

    ``gap`` marks the bytes between words; it must hold the newline, which parts the texts. Words are mixed eight bytes
    at a time, each step through a bijection, so that words of one length differ after any differing step but by chance."""
    raw = b"\n".join(texts) + b"\n"
    inside = ~gap[np.frombuffer(raw, np.uint8)]
    edge = inside.copy()
    edge[1:] ^= inside[:-1]
    edges = np.flatnonzero(edge)
    starts, length = edges[0::2], edges[1::2] - edges[0::2]
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=bounds[1:])
    begins = np.searchsorted(starts, bounds)
    if not len(starts):
        return np.empty(0, np.uint64), begins
    eight = np.ndarray(len(raw), "<u8", raw + bytes(8), strides=(1,))
    seed = np.uint64(key) + length.astype(np.uint64) * np.uint64(_R)
    out = mix(seed ^ mix(eight[starts] & _FIRST[np.minimum(length, 8)]))
    more, at = np.flatnonzero((length > 8) & (length <= LONG_WORD)), 8
    while len(more):
        part = eight[starts[more] + at] & _FIRST[np.minimum(length[more] - at, 8)]
        out[more] = mix(out[more] * np.uint64(_R) + mix(part ^ seed[more]))
        at += 8
        more = more[length[more] > at]
    for i in np.flatnonzero(length > LONG_WORD):
        word = raw[starts[i] : starts[i] + length[i]]
        out[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=key.to_bytes(8, "little")).digest(), "little")
    return out, begins


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Each text's sorted distinct k-word shingles as hashes; of fewer words, the whole sequence is one shingle."""
    words, begins = word_hashes([t.lower() for t in texts])
    chain = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for j in range(k if len(chain) else 0):
        chain = mix(chain * np.uint64(_R) + words[j : j + len(chain)] + np.uint64(j + 1))
    out = []
    for a, b in zip(begins[:-1], begins[1:], strict=True):
        if b - a >= k:
            s = np.sort(chain[a : b - k + 1])
            keep = np.ones(len(s), bool)
            keep[1:] = s[1:] != s[:-1]
            out.append(s[keep])
        elif b > a:
            whole = np.full(1, 0x5BD1E995 + int(b - a), np.uint64)
            for w in words[a:b]:
                whole = mix(whole * np.uint64(_R) + w)
            out.append(whole)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", most_bytes: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about ``most_bytes`` of text (a longer text has a piece of its own), so that memory is bounded."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(batch.schema.get_field_index(column))], np.int64)
        group = np.cumsum(sizes) // most_bytes
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(a, b - a)


def raw_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts as UTF-8 bytes; null becomes empty."""
    return [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in batch.column(batch.schema.get_field_index(column))]
