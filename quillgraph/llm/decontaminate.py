"""Operator 8, benchmark decontamination: q-gram lemma filtering with banded alignment.

Method. Texts and benchmark items are reduced to their letters and digits in lower case. An item's patterns are the whole
item up to LONGEST bytes and windows of each size of WINDOWS at each of its strides, so that whatever an item's length, a
verbatim stretch of it of 64 bytes holds a whole window. All q-grams of the items are indexed. A text's q-gram hits fall
into diagonal bands (position in the text less position in the item) that overlap by half. By the q-gram lemma, a place
within k edits of a pattern of m bytes shares at least m + 1 - q (k + 1) q-grams with it in one band; patterns below that
count are dropped, and each region that is left is verified by alignment within the band. k is EDITS of the pattern's
length, less for short patterns so that the lemma's bound stays positive. Items of fewer than SHORTEST letters and digits
have too few q-grams for that and are looked up by hash, word by word, without edits.

Defined results. A row for each document and item with a verified pattern; documents without one give no row. Null or
empty texts match nothing, nor do items without a letter or digit. An item under SHORTEST matches only where its words
stand as whole words in a row; so an item of one common word matches each text that has the word. Repeated rows: a row
each; repeated items count once. Extra columns aren't read.

Scale: the benchmark is taken in blocks of BLOCK bytes. One block's index is broadcast at a time: its matches are written before
the next one is built, and it is destroyed then, so that what is held has a proven bound whatever the benchmark's size. Each
block is one scan of the texts, without a shuffle. clean() shuffles only texts whose hash a bounded filter of the leaking ones holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared, textvec

Q = 10
LONGEST, SHORTEST = 150, 32
WINDOWS = ((60, 5), (100, 10))
EDITS = 0.08
BAND = 16
BLOCK = 2_000_000
_COARSE = 22


def normalise(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters, digits and non-ASCII bytes in lower case, and where each stood."""
    at = np.flatnonzero(textvec.ALNUM[buf])
    return textvec.LOWER[buf[at]], at


def qgrams(x: np.ndarray) -> np.ndarray:
    """Hashes of all runs of Q bytes."""
    if len(x) < Q:
        return np.zeros(0, dtype=np.uint64)
    a = x.astype(np.uint64)
    two = a[:-1] | a[1:] << np.uint64(8)
    four = two[:-2] | two[2:] << np.uint64(16)
    eight = four[:-4] | four[4:] << np.uint64(32)
    n = len(x) - Q + 1
    h = eight[:n] * np.uint64(0x9E3779B97F4A7C15) ^ two[8 : 8 + n] * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ h >> np.uint64(32)


@dataclass
class Index:
    items: list  # id of each item
    parts: np.ndarray  # patterns of each item
    text: np.ndarray  # letters of the items in a row
    begin: np.ndarray  # where each item begins in it (one more for the end)
    owner: np.ndarray  # item of each letter
    fewest: np.ndarray  # least of an item's patterns
    start: np.ndarray  # where each pattern begins in the text, rising
    size: np.ndarray
    budget: np.ndarray
    least: np.ndarray  # q-grams that a region must share
    grams: np.ndarray  # sorted
    first: np.ndarray
    post: np.ndarray  # where each q-gram stands in the text
    coarse: np.ndarray
    short: dict  # by length: hashes, and items by their letters with word marks


def marked(norm: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The letters, those that begin a word higher by 256."""
    return norm + np.uint16(256) * (np.diff(at, prepend=-9) != 1).astype(np.uint16)


def _hashes(rows: np.ndarray) -> np.ndarray:
    return (rows.astype(np.uint64) * textvec.powers(rows.shape[1])[0]).sum(axis=1)


def build_index(items: list[tuple[object, np.ndarray]]) -> Index:
    """items: (id, letters with word marks)."""
    size = np.array([len(x) if len(x) >= SHORTEST else 0 for _, x in items], dtype=np.int64)
    begin = np.concatenate([[0], np.cumsum(size)])
    text = np.concatenate([x for n, (_, x) in zip(size, items, strict=True) if n] or [np.zeros(0, dtype=np.uint16)]).astype(np.uint8)
    owner = np.repeat(np.arange(len(items)), size)
    short: dict[int, dict[bytes, list[int]]] = {}
    pattern = []
    for i, (n, low) in enumerate(zip(size.tolist(), begin.tolist(), strict=False)):
        own = {(low, n)} if 0 < n <= LONGEST else set()
        for m, stride in WINDOWS:
            if n > m:
                own |= {(low + s, m) for s in (*range(0, n - m, stride), n - m)}
        pattern += sorted(own)
        if not n:
            short.setdefault(len(items[i][1]), {}).setdefault(items[i][1].tobytes(), []).append(i)
    start, m = np.array(pattern, dtype=np.int64).reshape(-1, 2).T
    budget = np.minimum((m * EDITS).astype(np.int64), m // Q - 1)
    least = m + 1 - Q * (budget + 1)
    fewest = np.full(len(items), 1 << 20)
    np.minimum.at(fewest, owner[start], least)
    every = qgrams(text)
    at = np.flatnonzero(owner[: len(every)] == owner[Q - 1 :]) if len(every) else np.zeros(0, dtype=np.int64)
    at = at[np.argsort(every[at], kind="stable")]
    unique, first = np.unique(every[at], return_index=True)
    coarse = np.zeros(1 << _COARSE, dtype=bool)
    coarse[unique >> np.uint64(64 - _COARSE)] = True
    table = {n: (np.unique(_hashes(np.array([np.frombuffer(x, dtype=np.uint16) for x in own]))), own) for n, own in short.items()}
    parts = np.where(size > 0, np.bincount(owner[start], minlength=len(items)), 1)
    return Index([k for k, _ in items], parts, text, begin, owner, fewest, start, m, budget, least, unique, np.append(first, len(at)), at, coarse, table)


def banded_distances(patterns: list[bytes], regions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edits of each pattern to a substring of its region that stays in the band, and the diagonal on which it ends.

    regions: (n, longest pattern + 2 BAND), padded with 0. The band holds the diagonals 0 to 2 BAND.
    """
    n, width = len(patterns), 2 * BAND + 1
    size = np.array([len(p) for p in patterns])
    longest = int(size.max())
    text = np.zeros((n, longest), dtype=np.uint8)
    for i, p in enumerate(patterns):
        text[i, : len(p)] = np.frombuffer(p, dtype=np.uint8)
    ramp = np.arange(width, dtype=np.int32)
    row = np.zeros((n, width), dtype=np.int32)
    best, end = np.full(n, 1 << 20), np.zeros(n, dtype=np.int64)
    wide = np.pad(regions, ((0, 0), (0, 1)))
    for r in range(longest):
        step = row + (wide[:, r : r + width] != text[:, r : r + 1])
        step[:, :-1] = np.minimum(step[:, :-1], row[:, 1:] + 1)
        row = np.minimum.accumulate(step - ramp, axis=1) + ramp
        done = np.flatnonzero(size == r + 1)
        if len(done):
            best[done] = row[done].min(axis=1)
            end[done] = row[done].argmin(axis=1)
    return best, end


def _whole(index: Index, norm: np.ndarray, at: np.ndarray, noff: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, first letter, end letter) of the places of the short items."""
    letters = marked(norm, at)
    begins = np.append(letters >= 256, True)
    words = np.flatnonzero(begins[:-1])
    for n, (hashes, own) in index.short.items():
        i = words[words + n <= len(norm)]
        i = i[begins[i + n]]
        for c in range(0, len(i), 1 << 16):
            rows = letters[i[c : c + (1 << 16), None] + np.arange(n)]
            for r in np.flatnonzero(np.isin(_hashes(rows), hashes)):
                low = int(i[c + r])
                d = int(np.searchsorted(noff, low, side="right")) - 1
                if low + n <= noff[d + 1]:
                    yield from ((d, it, low, low + n) for it in own.get(rows[r].tobytes(), ()))


def _regions(index: Index, norm: np.ndarray, noff: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Patterns, and where in the letters the bands begin in which they may stand."""
    none = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    h = qgrams(norm)
    i = np.flatnonzero(index.coarse[h >> np.uint64(64 - _COARSE)])
    if not len(i) or not len(index.grams):
        return none
    k = np.minimum(np.searchsorted(index.grams, h[i]), len(index.grams) - 1)
    hit = index.grams[k] == h[i]
    i, k = i[hit], k[hit]
    inside = i + Q <= noff[np.searchsorted(noff, i, side="right")]
    i, k = i[inside], k[inside]
    if not len(i):
        return none
    count = index.first[k + 1] - index.first[k]
    rep = np.repeat(np.arange(len(i)), count)
    g = index.post[np.repeat(index.first[k] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())]
    least = (int(np.diff(index.begin).max()) >> 4) + 2  # the lowest diagonal may be before the first byte
    band = ((i[rep] - g + index.begin[index.owner[g]]) >> 4) + least
    total = len(index.text)
    seen = np.unique(np.concatenate([band * total + g, (band - 1) * total + g]))  # each hit lies in two bands
    # Groups of hits of one item in one band, near enough to each other for a pattern.
    band, g = seen // total, seen % total
    item = index.owner[g]
    cut = np.flatnonzero((np.diff(band) != 0) | (np.diff(item) != 0) | (np.diff(g) > LONGEST)) + 1
    low, high = np.concatenate([[0], cut]), np.append(cut, len(seen))
    keep = high - low >= index.fewest[item[low]]
    low, high = low[keep], high[keep]
    band, item, lowest, highest = band[low], item[low], g[low], g[high - 1]
    head = np.searchsorted(index.start, np.maximum(lowest - LONGEST, index.begin[item]))
    count = np.searchsorted(index.start, highest, side="right") - head
    rep = np.repeat(np.arange(len(low)), count)
    p = np.repeat(head - (np.cumsum(count) - count), count) + np.arange(count.sum())
    row = band[rep] * total + index.start[p]
    number = np.searchsorted(seen, row + index.size[p] - Q, side="right") - np.searchsorted(seen, row)
    keep = number >= index.least[p]
    p, rep = p[keep], rep[keep]
    return p, (band[rep] - least) * BAND + index.start[p] - index.begin[item[rep]]


def find(index: Index, texts: pa.Array) -> list[tuple[int, int, int, int, int, int]]:
    """(text, item, patterns found, first byte, end byte, most edits of a pattern) for each text and item with a verified pattern."""
    buf, off = textvec.flat(texts)
    norm, at = normalise(buf)
    noff = np.searchsorted(at, off)
    found: dict[tuple[int, int], dict[int, tuple[int, int, int]]] = {}
    for d, it, begin, end in _whole(index, norm, at, noff):
        found.setdefault((d, it), {}).setdefault(-1, (int(at[begin] - off[d]), int(at[end - 1] + 1 - off[d]), 0))
    p, starts = _regions(index, norm, noff)
    order = np.argsort(index.size[p], kind="stable")
    p, starts = p[order], starts[order]
    # The text of a region: the one in which its middle lies; both bands of a hit are tried, so a region cut by a border has another.
    middle = np.clip(starts + BAND + index.size[p] // 2, 0, max(len(norm) - 1, 0))
    doc = np.searchsorted(noff, middle, side="right") - 1
    for c in range(0, len(p), 2048):
        own = slice(c, c + 2048)
        pats = [index.text[x : x + n].tobytes() for x, n in zip(index.start[p[own]], index.size[p[own]], strict=True)]
        regions = np.zeros((len(pats), max(map(len, pats)) + 2 * BAND), dtype=np.uint8)
        for r, (s, d, t) in enumerate(zip(starts[own], doc[own], pats, strict=True)):
            low, high = max(s, noff[d]), min(s + len(t) + 2 * BAND, noff[d + 1])
            if high > low:
                regions[r, low - s : high - s] = norm[low:high]
        dist, diag = banded_distances(pats, regions)
        for r in np.flatnonzero(dist <= index.budget[p[own]]):
            x, d = int(p[c + r]), int(doc[c + r])
            end = min(int(starts[c + r] + len(pats[r]) + diag[r]), int(noff[d + 1]))
            begin = max(int(noff[d]), end - len(pats[r]))
            kept = found.setdefault((d, int(index.owner[index.start[x]])), {})
            if x not in kept or dist[r] < kept[x][2]:
                kept[x] = (int(at[begin] - off[d]), int(at[end - 1] + 1 - off[d]), int(dist[r]))
    return [(d, it, len(v), min(a for a, _, _ in v.values()), max(b for _, b, _ in v.values()), max(e for _, _, e in v.values())) for (d, it), v in sorted(found.items())]


def indexes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block: int = BLOCK):
    """The benchmark's indexes, a block at a time."""
    held, size = [], 0
    for key, text in benchmark.select(F.col(id_col), F.col(text_col).cast("string")).filter(F.col(text_col).isNotNull()).distinct().orderBy(id_col, text_col).toLocalIterator():
        letters = marked(*normalise(np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)))
        if not len(letters):
            continue
        held.append((key, letters))
        size += len(letters)
        if size >= block:
            yield build_index(held)
            held, size = [], 0
    if held:
        yield build_index(held)


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, item_id, parts, item_parts, start, end, edits): the stretch of the text from start to end, in characters, holds parts of an item."""
    src = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    kind, item = src.schema[0].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()

    def rows(held, batch):
        out = []
        for part in textvec.slices(batch, 1):
            for d, it, parts, a, b, edits in find(held.value, part.column(1)):
                data = part.column(1)[d].as_buffer().to_pybytes()
                start = len(data[:a].decode("utf-8", "replace"))
                out.append((part.column(0)[d].as_py(), held.value.items[it], parts, int(held.value.parts[it]), start, start + len(data[a:b].decode("utf-8", "replace")), edits))
        cols = list(zip(*out, strict=True)) if out else [()] * 7
        kinds = [batch.schema.field(0).type, pa.int64() if item == "bigint" else None, pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) if t is not None else pa.array(c) for c, t in zip(cols, kinds, strict=True)], names=[id_col, "item_id", "parts", "item_parts", "start", "end", "edits"])

    return _by_block(src, benchmark, rows, f"`{id_col}` {kind}, item_id {item}, parts int, item_parts int, start bigint, `end` bigint, edits int", "matches")


def _by_block(src: DataFrame, benchmark: DataFrame, rows, schema: str, name: str) -> DataFrame:
    """The union of rows(index, batch) over the benchmark's blocks, each of which is broadcast, used and destroyed in turn."""
    out = None
    for index in indexes(benchmark):
        held = src.sparkSession.sparkContext.broadcast(index)

        def run(batches, held=held):
            for batch in batches:
                yield rows(held, batch)

        made = shared.settle(src.mapInArrow(run, schema), name)
        held.destroy()
        out = made if out is None else out.unionByName(made)
    return src.sparkSession.createDataFrame([], schema) if out is None else out


def _text_key(text: F.Column) -> F.Column:
    """128 bits of a text's hashes."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents without a verified passage, with all their columns."""
    text = F.col(text_col).cast("string")
    src = docs.select(F.xxhash64(text).alias("a"), text.alias("__text"), F.xxhash64(F.lit(1), text).alias("b"))

    def rows(held, batch):
        flags, n = np.zeros(batch.num_rows, dtype=bool), 0
        for part in textvec.slices(batch, 1):
            flags[[n + row[0] for row in find(held.value, part.column(1))]] = True
            n += part.num_rows
        return pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(flags)) for k in (0, 2)], names=["a", "b"])

    leaks = shared.settle(_by_block(src, benchmark, rows, "a bigint, b bigint", "block-leaks").distinct(), "leaks")
    key = shared.spare(docs, "text_key")[0]
    some, rest = shared.split_by(docs.withColumn(key, _text_key(text)), F.col(f"{key}.a"), shared.fingerprint_filter(leaks, "a"))
    some = some.join(leaks.select(F.struct("a", "b").alias(key)).hint("merge"), key, "left_anti")
    return some.select(*docs.columns).unionByName(rest.select(*docs.columns))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "benchmark"))
