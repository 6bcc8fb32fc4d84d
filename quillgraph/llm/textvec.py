"""Whole-array text primitives: words, word hashes and byte n-grams of many texts at once, over Arrow buffers.

Hashes are 64 bits wide: a polynomial over randomised byte values, then a finaliser. Texts are UTF-8 bytes; every class
of characters used here is decided by single bytes, since all bytes of a non-ASCII character are 0x80 or more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


LOWER = _lower_table()
VALUES = mix(LOWER.astype(np.uint64) * _U(0xD6E8FEB86659FD93) + _U(0x5851F42D4C957F2D)) | _U(1)


def _class(test) -> np.ndarray:
    return np.array([test(b) for b in range(256)])


#: Fixed classes: everything but white space; letters, digits and non-ASCII; letters and non-ASCII.
NOT_SPACE = _class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
ALNUM = _class(lambda b: b >= 0x80 or chr(b).isalnum())
LETTERS = _class(lambda b: b >= 0x80 or chr(b).isalpha())

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0..n-1, and their inverses modulo 2**64."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, SLICE + (SLICE >> 4))
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each followed by a line feed, and where each begins (one more for the end). Null: empty."""
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if not len(texts):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    off = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[off[0] : off[-1]] if texts.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
    off -= off[0]
    return np.insert(data, off[1:], 10), off + np.arange(len(off))


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about so many bytes of text each; a longer text stands alone."""
    texts = batch.column(column)
    if not len(texts):
        return
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    off = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(off, off[at] + most, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end


@dataclass
class Words:
    """start, end: byte positions; hash: of the lower-cased word; first: number of the first word of each text, and one more.

    affix: for each k > 0 that was asked for, hashes of the first k bytes, for k < 0 of the last; 0 for words not longer.
    """

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    affix: dict[int, np.ndarray]


def _spans(total: np.ndarray, down: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
    low = np.where(start > 0, total[start - 1], _U(0))
    return mix((total[end - 1] - low) * down[start] + (end - start).astype(np.uint64) + _U(salt & 0xFFFFFFFF))


def _totals(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers(len(buf))
    total = VALUES[buf]
    total *= up
    return np.cumsum(total, out=total), down


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of non-empty spans of bytes, A-Z as a-z."""
    return _spans(*_totals(buf), start, end)


def word_bounds(buf: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the maximal runs of bytes of a class begin and end."""
    edge = np.flatnonzero(np.diff(kind[buf], prepend=False, append=False))
    return edge[::2], edge[1::2]


def words(buf: np.ndarray, off: np.ndarray, kind: np.ndarray, affixes: tuple[int, ...] = ()) -> Words:
    """Maximal runs of bytes of a class in each text of flat(). A very long text is hashed in pieces that end between words."""
    start, end = word_bounds(buf, kind)
    h = np.zeros(len(start), dtype=np.uint64)
    affix = {k: np.zeros(len(start), dtype=np.uint64) for k in affixes}
    at = 0
    while at < len(start):
        low = start[at]
        to = len(start) if len(buf) - low <= SLICE else max(at + 1, int(np.searchsorted(end, low + SLICE)))
        total, down = _totals(buf[low : end[to - 1]])
        s, e = start[at:to] - low, end[at:to] - low
        h[at:to] = _spans(total, down, s, e)
        for k, out in affix.items():
            longer = np.flatnonzero(e - s > abs(k))
            x = s[longer] if k > 0 else e[longer] + k
            out[at + longer] = _spans(total, down, x, x + abs(k), 7919 * k)
        at = to
    return Words(start, end, h, np.searchsorted(start, off), affix)


def word_hash(word: str | bytes) -> int:
    """The hash that words() gives a single word."""
    data = np.frombuffer(word.encode() if isinstance(word, str) else word, dtype=np.uint8)
    return int(span_hashes(data, np.array([0]), np.array([len(data)]))[0])


def owner(first: np.ndarray) -> np.ndarray:
    """For each item, the number of its text, where first is as in Words."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
