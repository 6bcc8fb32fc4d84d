"""Operator 7, n-gram Jaccard join: exact set similarity with set-relation skipping.

Method. A document is the set of its distinct shingles (3 words by contract, 5 in the pipeline), as 64-bit hashes. Documents with equal sets are one class
(its id is a 64-bit hash of the set). Shingles are ordered from rare to frequent; two classes at the threshold share a
shingle in their prefixes under that order, so the index holds prefixes only.

*Index-level skipping.* Lists of one class are dropped where they are counted. An index list is sorted by set size in blocks. For
each entry only blocks within its size bound are met, and a block is skipped as a whole when no position in it leaves
enough shingles to reach the threshold.

*Answer-level skipping.* In each index list the entry in which the shingle comes first has least of its own before it: in a
group of copies that is the text the others were made from. The first round compares every entry with that one only, and
the answers of a set that is linked with it are derived from its answers: both are in one component. In the second round
lists of one component are passed over, and of the others only pairs of different components are compared, within the
bounds, so that no component is lost. Pairs within a group of linked copies are never enumerated: only components are
derived, and a set's links within its component, or their number, are not.

*Verification.* A bitmap of about four bits a shingle travels first: bits that only one of two sets has bound their
intersection from above. The sets themselves travel only for pairs that this bound leaves.

Defined results. Null, empty and blank texts: an empty set, linked with nothing, its own component. Fewer words
than a shingle: the whole sequence as one shingle. Repeated ids: each row is a document, and its component is named by the smallest
id in it; null ids (and those that are no integers) are passed over in that minimum, and a component of null ids only is named null. Extra columns aren't read.

Scale: the order of shingles comes from a table of counts over all documents, of 2**20 to 2**24 counters by their number; any order
is right, a better one only saves work. The first round is joins that Spark can split where a list is long. In the second, a
list of more than LIST entries is dealt as pairs of its parts, so that no task holds more than two parts of a list. Sets
travel only for classes in a candidate pair. Pair tables are compared by joins that Spark can split where a class has many
partners.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared, textvec
from .components import connected_components

OF = 100
COUNTERS, BLOCKS = (20, 24), 16
STEP, LIST = 64, 512
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_ODD = [np.uint64(x) for x in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x6C8E9CF570932BD5)]


@dataclass(frozen=True)
class Rule:
    """Sets of shingle words are linked if OF * intersection >= similar * union."""

    shingle: int = 3
    similar: int = 90

    def prefix(self, n):
        """How many shingles of a set of n must be indexed."""
        return n - (self.similar * n + OF - 1) // OF + 1

    def reach(self, n):
        """The largest set that one of n can be linked with."""
        return n * OF // self.similar

    def enough(self, a, b, common):
        """Whether sets of a and b that share so many, at most, can be linked."""
        return self.similar * (a + b) <= (OF + self.similar) * common


CONTRACT, CORPUS = Rule(3, 90), Rule(5, 80)


def shingle_sets(texts: pa.Array, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Where each text's set begins (and one more), and all sets' hashes, each set sorted."""
    w = textvec.words(*textvec.flat(texts), textvec.NOT_SPACE)
    h, first, k = w.hash, w.first, rule.shingle
    runs = textvec.mix(sum(h[j : len(h) - k + 1 + j] * _ODD[j] for j in range(k))) if len(h) >= k else h[:0]
    out, size = [], np.zeros(len(first), dtype=np.int64)
    for i in range(len(first) - 1):
        a, b = first[i], first[i + 1]
        if b - a >= k:
            out.append(np.unique(runs[a : b - k + 1]))
        elif b > a:  # the whole sequence; its length keeps it apart from runs of k words
            out.append(textvec.mix((h[a:b] * np.array(_ODD[: b - a])).sum(keepdims=True) + np.uint64(b - a)))
        else:
            continue
        size[i + 1] = len(out[-1])
    return np.cumsum(size), np.concatenate(out) if out else h[:0]


def _classes(first: np.ndarray, v: np.ndarray) -> np.ndarray:
    """A hash of each set; 0 for empty ones."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(textvec.mix(v * _ODD[0] + np.uint64(1)))])
    size = np.diff(first)
    return np.where(size > 0, textvec.mix(total[first[1:]] - total[first[:-1]] + size.astype(np.uint64) * _A) | np.uint64(1), np.uint64(0))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def counter_bits(documents: int) -> int:
    """The counters' number grows with the documents', between bounds."""
    return min(max(COUNTERS[0], (8 * documents).bit_length()), COUNTERS[1])


def profiles(docs: DataFrame, rule: Rule, bits: int = COUNTERS[0]) -> DataFrame:
    """docs: (did, text, th). kind 0: a row for each document (did, th, n, c); kind 1: parts of the table of shingle counts."""

    def run(batches):
        counts = np.zeros(1 << bits, dtype=np.int32)
        for batch in batches:
            for part in textvec.slices(batch, 1):
                first, v = shingle_sets(part.column(1), rule)
                if len(v):
                    np.add.at(counts, (v >> np.uint64(64 - bits)).astype(np.int64), np.int32(1))
                n, blank = part.num_rows, pa.nulls(part.num_rows, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(n, np.int32)), part.column(0), part.column(2), pa.array(np.diff(first)), _signed(_classes(first, v)), blank, pa.nulls(n, pa.binary())],
                    names=["kind", "did", "th", "n", "c", "block", "counts"],
                )
        nulls = [pa.nulls(BLOCKS, pa.int64())] * 4
        parts = [zlib.compress(x.tobytes(), 1) for x in counts.reshape(BLOCKS, -1)]
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(BLOCKS, np.int32)), *nulls, pa.array(np.arange(BLOCKS, dtype=np.int32)), pa.array(parts, pa.binary())], names=["kind", "did", "th", "n", "c", "block", "counts"])

    return docs.mapInArrow(run, "kind int, did bigint, th bigint, n bigint, c bigint, block int, counts binary")


def shingle_ranks(rows: DataFrame, bits: int) -> np.ndarray:
    """For each counter a byte that grows with its count. A table of bounded size, summed on the executors."""

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(zlib.decompress(data.as_py()), dtype=np.int32)
                held[block] = held.get(block, 0) + x.astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([np.minimum(255, 8 * np.log2(1 + x)).astype(np.uint8).tobytes() for x in held.values()], pa.binary())], names=["block", "counts"])

    out = np.zeros((BLOCKS, (1 << bits) // BLOCKS), dtype=np.uint8)
    for block, data in rows.select("block", "counts").repartition(BLOCKS, "block").mapInArrow(add, "block int, counts binary").collect():
        out[block] = np.frombuffer(data, dtype=np.uint8)
    return out.ravel()


def prefixes(docs: DataFrame, ranks: np.ndarray, rule: Rule) -> DataFrame:
    """(did, c, n, tokens): each set's rarest shingles."""
    held, low = docs.sparkSession.sparkContext.broadcast(ranks), np.uint64(64 - (len(ranks).bit_length() - 1))

    def run(batches):
        for batch in batches:
            for part in textvec.slices(batch, 1):
                first, v = shingle_sets(part.column(1), rule)
                size, c = np.diff(first), _classes(first, v)
                own = np.flatnonzero(size)
                rank = held.value[(v >> low).astype(np.int64)]
                tokens = [v[first[i] : first[i + 1]][np.argsort(rank[first[i] : first[i + 1]], kind="stable")[: rule.prefix(int(size[i]))]] for i in own]
                off = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int32)
                flat = np.concatenate(tokens) if tokens else v[:0]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(own)), _signed(c[own]), pa.array(size[own]), pa.ListArray.from_arrays(pa.array(off), _signed(flat))], names=["did", "c", "n", "tokens"])

    return docs.mapInArrow(run, "did bigint, c bigint, n bigint, tokens array<bigint>")


def bitmap(v: np.ndarray) -> bytes:
    """A power of two of bits, between four and eight a shingle."""
    bits = 8 << max(4, int(np.ceil(np.log2(max(1, len(v) / 2)))))
    held = np.zeros(bits, dtype=bool)
    held[((v * _ODD[8]) >> np.uint64(7)) & np.uint64(bits - 1)] = True
    return np.packbits(held).tobytes()


def most_common(x: np.ndarray, y: np.ndarray, nx: int, ny: int) -> int:
    """An upper bound of the intersection of two sets of these bitmaps and sizes."""
    while len(x) > len(y):
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2 :]
    return min(nx - int(np.bitwise_count(x & ~y).sum()), ny - int(np.bitwise_count(y & ~x).sum()))


def sets_of(docs: DataFrame, needed: DataFrame, rule: Rule, bitmaps: bool) -> DataFrame:
    """needed: (c, mdoc) distinct; (c, n, members) with each class's set or bitmap, taken from the document that carries it."""
    some = shared.may_hold(docs, "did", shared.fingerprint_filter(needed, "mdoc"))

    def run(batches):
        for batch in batches:
            for part in textvec.slices(batch, 1):
                first, v = shingle_sets(part.column(1), rule)
                sets = [v[first[i] : first[i + 1]] for i in range(part.num_rows)]
                data = [bitmap(x) if bitmaps else x.tobytes() for x in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), _signed(_classes(first, v)), pa.array(np.diff(first)), pa.array(data, pa.binary())], names=["did", "c", "n", "members"])

    rows = some.mapInArrow(run, "did bigint, c bigint, n bigint, members binary")
    found = rows.join(needed.select(F.col("c").alias("c_"), F.col("mdoc").alias("did_")), (F.col("c") == F.col("c_")) & F.col("did").eqNullSafe(F.col("did_"))).select("c", "n", "members")
    return shared.settle(found.dropDuplicates(["c"]), "shingle-sets")


def _compared(docs: DataFrame, pairs: DataFrame, classes: DataFrame, rule: Rule, bitmaps: bool) -> DataFrame:
    """Those of the pairs (a, b) that are linked, or with bitmaps may be."""
    ends = pairs.select(F.col("a").alias("c")).unionByName(pairs.select(F.col("b").alias("c"))).distinct()
    needed = shared.settle(classes.join(ends, "c").select("c", "mdoc"), "needed")
    sets = sets_of(docs, needed, rule, bitmaps)
    shared.release(docs.sparkSession)
    one, two = (sets.select(F.col("c").alias(k), F.col("n").alias(f"n{k}"), F.col("members").alias(f"s{k}")) for k in "ab")
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "sa", "sb")

    def compare(batches):
        for batch in batches:
            keep = []
            for i, (nx, ny, x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), batch.column(5), strict=True)):
                x, y = (np.frombuffer(s.as_buffer(), dtype=np.uint8 if bitmaps else np.uint64) for s in (x, y))
                if bitmaps:
                    common = most_common(x, y, nx, ny)
                else:
                    x, y = (y, x) if len(x) > len(y) else (x, y)
                    at = np.searchsorted(y, x)
                    at[at == len(y)] = 0
                    common = int((y[at] == x).sum())
                if OF * common >= rule.similar * (nx + ny - common):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(keep, pa.int32())) for k in (0, 1)], names=["a", "b"])

    out = shared.settle(both.mapInArrow(compare, "a bigint, b bigint"), "compared")
    shared.discard(needed, sets)
    shared.release(docs.sparkSession)
    return out


def linked_pairs(docs: DataFrame, pairs: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """Those of the candidate pairs (a, b) of classes that are linked."""
    near = _compared(docs, pairs, classes, rule, True)
    out = _compared(docs, near, classes, rule, False)
    shared.discard(near)
    return out


def candidate_pairs(token: np.ndarray, c: np.ndarray, root: np.ndarray, n: np.ndarray, pos: np.ndarray, rule: Rule, side: np.ndarray | None = None) -> np.ndarray:
    """Pairs of entries of one list and different roots within the size and position bounds: an array (pairs, 2) of classes.

    Entries are re-sorted by list and size; blocks of STEP entries are met or skipped as a whole. side: 0, or 1 and 2 in lists
    that hold two parts, of which only entries of different ones are paired.
    """
    order = np.lexsort((n, token))
    side = np.zeros(len(token), dtype=np.int64) if side is None else side[order]
    token, c, root, n, rem = token[order], c[order], root[order], n[order], (n - pos)[order]
    run = np.concatenate([[0], np.cumsum(token[1:] != token[:-1])]) if len(token) else token
    end = np.searchsorted(run << 32 | n, run << 32 | np.minimum(rule.reach(n), (1 << 32) - 1), side="right")
    starts = np.arange(0, len(n), STEP)
    most = np.maximum.reduceat(rem, starts) if len(n) else rem
    out = [np.zeros((0, 2), dtype=np.int64)]
    i_all = np.flatnonzero(end > np.arange(len(n)) + 1)
    count = end[i_all] - i_all - 1
    at = 0
    upto = np.cumsum(count)
    while at < len(i_all):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + (1 << 18), side="right")))
        i = i_all[at:to]
        low, high = (i + 1) // STEP, (end[i] - 1) // STEP
        ib, b = np.repeat(i, high - low + 1), _ranges(low, high - low + 1)
        # All entries of a block within reach are at least as large as i.
        fits = rule.enough(n[ib], n[ib], np.minimum(rem[ib], most[b]))
        ib, b = ib[fits], b[fits]
        lo, hi = np.maximum(b * STEP, ib + 1), np.minimum(b * STEP + STEP, end[ib])
        x, y = np.repeat(ib, hi - lo), _ranges(lo, hi - lo)
        good = rule.enough(n[x], n[y], np.minimum(rem[x], rem[y])) & (root[x] != root[y]) & ((side[x] != side[y]) | (side[x] == 0))
        x, y = c[x[good]], c[y[good]]
        if len(x):
            out.append(np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0))
        at = to
    return np.unique(np.concatenate(out), axis=0)


def _ranges(low: np.ndarray, count: np.ndarray) -> np.ndarray:
    """low[i], low[i] + 1, ... count[i] of them, one after the other."""
    if not len(count):
        return low
    return np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())


def _lists(batches, take):
    """Calls take with the columns of whole lists of a partition that is sorted by the first column."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns)]
        if held is not None:
            cols = [np.concatenate([a, b]) for a, b in zip(held, cols, strict=True)]
        cut = int(np.searchsorted(cols[0], cols[0][-1], side="left"))
        held = [x[cut:] for x in cols]
        yield from take(*(x[:cut] for x in cols))
    if held is not None:
        yield from take(*held)


def _first_of(*keys: np.ndarray) -> np.ndarray:
    change = np.zeros(len(keys[0]), dtype=bool)
    change[:1] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return change


def shared_postings(postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The postings (token, c, n, pos, place) of lists of several classes, and each such list's foremost entry (token, hc, hn, hpos).

    The foremost entry is that of least position; of several such that of the first class.
    """
    place = F.shiftleft(F.least(F.col("pos"), F.lit((1 << 20) - 1)).cast("long"), 43).bitwiseOR(F.shiftrightunsigned("c", 21))
    postings = shared.settle(postings.select("token", "c", "n", "pos", place.alias("place")), "postings")
    lists = postings.groupBy("token").agg(F.min("place").alias("place"), F.min("c").alias("low"), F.max("c").alias("high")).filter("low <> high")
    lists = shared.settle(lists.select("token", F.col("place").alias("head")), "lists")
    both = shared.may_hold(postings, "token", shared.fingerprint_filter(lists, "token")).join(lists, "token")
    held = shared.settle(both, "shared-postings")
    heads = held.filter("place = head").groupBy("token").agg(F.min(F.struct("c", "n", "pos")).alias("h")).select("token", F.col("h.c").alias("hc"), F.col("h.n").alias("hn"), F.col("h.pos").alias("hpos"))
    heads = shared.settle(heads, "list-heads")
    shared.discard(postings, lists)
    shared.release(postings.sparkSession)
    return held.drop("place", "head"), heads


def first_round(held: DataFrame, heads: DataFrame, rule: Rule) -> DataFrame:
    """Candidate pairs (a, b) of a list's foremost entry and each other one."""
    low, high = F.least("n", "hn"), F.greatest("n", "hn")
    near = (high * rule.similar <= low * OF) & rule.enough(low, high, F.least(F.col("n") - F.col("pos"), F.col("hn") - F.col("hpos")))
    return held.join(heads, "token").filter((F.col("c") != F.col("hc")) & near).select(F.least("c", "hc").alias("a"), F.greatest("c", "hc").alias("b")).distinct()


def second_round(held: DataFrame, roots: DataFrame, rule: Rule, most: int = LIST) -> DataFrame:
    """Candidate pairs (a, b) of all classes of different components in a list."""
    rooted = shared.settle(_with_roots(held, roots), "rooted-postings")
    open_ = rooted.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("entries")).filter("low <> high")
    open_ = shared.settle(open_.select("token", F.ceil(F.col("entries") / most).alias("parts")), "open-lists")
    own = F.pmod(F.xxhash64("c"), "parts")
    dealt = rooted.join(open_, "token").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    cell = F.when(F.col("parts") == 1, F.col("token")).otherwise(F.xxhash64("token", F.least("own", "other"), F.greatest("own", "other")))
    dealt = dealt.select(cell.alias("cell"), "c", "root", "n", F.col("pos").cast("long").alias("pos"), side.cast("long").alias("side"))

    def take(token, c, root, n, pos, side):
        if len(token):
            pairs = candidate_pairs(token, c, root, n, pos, rule, side)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    pairs = dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(lambda batches: _lists(batches, take), "a bigint, b bigint").distinct()
    out = shared.settle(pairs, "list-pairs")
    shared.discard(rooted, open_)
    shared.release(held.sparkSession)
    return out


def _with_roots(df: DataFrame, roots: DataFrame) -> DataFrame:
    return df.join(roots.select(F.col("node").alias("c"), "root"), "c", "left").withColumn("root", F.coalesce("root", "c"))


def similarity_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Rule = CONTRACT) -> DataFrame:
    """(did, th, n, c, root, component_id) of every row.

    th: xxhash64 of the text; n: shingles; c: class of documents with equal sets, root: its component, both null for
    empty sets; component_id: the component's smallest id.
    """
    src = docs.select(shared.whole_id(F.col(id_col)).alias("did"), F.col(text_col).cast("string").alias("text"), F.xxhash64(text_col).alias("th"))
    bits = counter_bits(docs.count())
    rows = shared.settle(profiles(src, rule, bits), "set-profiles")
    profile = rows.filter("kind = 0").select("did", "th", "n", F.when(F.col("c") != 0, F.col("c")).alias("c"))
    classes = shared.settle(profile.filter("c is not null").groupBy("c").agg(F.min("did").alias("mdoc")), "set-classes")
    ranks = shingle_ranks(rows.filter("kind = 1"), bits)
    shared.release(docs.sparkSession)
    pre = prefixes(src, ranks, rule)
    # One document of each class carries its prefix on.
    carried = pre.join(classes.select(F.col("c").alias("c_"), F.col("mdoc").alias("did_")), (F.col("c") == F.col("c_")) & F.col("did").eqNullSafe(F.col("did_"))).select("c", "n", "tokens")
    held, heads = shared_postings(carried.select("c", "n", F.posexplode("tokens").alias("pos", "token")))
    tried = shared.settle(first_round(held, heads, rule), "first-pairs")
    links = linked_pairs(src, tried, classes, rule)
    roots = connected_components(links)
    open_ = second_round(held, roots, rule)
    later = shared.settle(open_.join(tried, ["a", "b"], "left_anti"), "second-pairs")
    if not later.isEmpty():
        links = links.unionByName(linked_pairs(src, later, classes, rule))
        roots = connected_components(links)

    named = _with_roots(classes.select("c", "mdoc"), roots)
    least = named.groupBy("root").agg(F.min("mdoc").alias("component_id"))
    named = shared.settle(named.join(least, "root").select("c", "root", "component_id"), "components")
    shared.discard(classes, tried, later, heads, open_)
    shared.release(docs.sparkSession)
    return profile.join(named, "c", "left").select("did", "th", "n", "c", "root", F.when(F.col("c").isNull(), F.col("did")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Rule = CORPUS) -> DataFrame:
    """The documents, all columns, without those that are linked, over any number of links, with one of a smaller id.

    Of rows that repeat an id within a component one stays; empty texts all stay.
    """
    comps = shared.settle(similarity_components(docs, id_col, text_col, rule), "document-components").filter("root is not null")
    key, th = shared.spare(docs, "k_id", "k_text")
    first = F.col("did").eqNullSafe(F.col("component_id"))

    def on(df: DataFrame, other: DataFrame):
        return shared.whole_id(df[id_col]).eqNullSafe(other["did_"]) & (df[th] == other["th_"])

    gone = shared.settle(comps.filter(~first).select(F.col("did").alias("did_"), F.col("th").alias("th_")).distinct(), "duplicates")
    again = comps.filter(first).groupBy("did", "root").count().filter("count > 1").select(F.col("did").alias("a_did"), F.col("root").alias("a_root"))
    rows = shared.settle(comps.join(again, F.col("did").eqNullSafe(F.col("a_did")) & (F.col("root") == F.col("a_root"))).select(F.col("did").alias("did_"), F.col("th").alias("th_"), F.col("a_root").alias(key)).distinct(), "repeated")
    held = gone.unionByName(rows.select("did_", "th_")).distinct()
    shared.release(docs.sparkSession)
    # Only texts that a filter of fixed size holds are shuffled.
    some, rest = shared.split_by(docs.withColumn(th, F.xxhash64(text_col)), th, shared.fingerprint_filter(held, "th_"))
    other = some.join(held.hint("merge"), on(some, held), "left_anti").select(*docs.columns)
    kept = some.join(rows.hint("merge"), on(some, rows)).dropDuplicates([id_col, key]).select(*docs.columns)
    return rest.select(*docs.columns).unionByName(other).unionByName(kept)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = similarity_components(shared.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("did").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


ORACLE = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
d as (
  select doc_id, case when len(ws) >= 3 then list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))
    when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end as sh from w),
s as (select doc_id, len(sh) as n, unnest(sh) as g from d),
half as (
  select a.doc_id as x, b.doc_id as y from s a join s b on a.g = b.g and a.doc_id < b.doc_id and 100 * a.n >= 90 * b.n and 100 * b.n >= 90 * a.n
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 90 * (a.n + b.n - count(*))),
link as (select x, y from half union all select y, x from half),
reach as (select doc_id as x, doc_id as r from d union select link.y, reach.r from reach join link on link.x = reach.x)
select d.doc_id, len(d.sh)::bigint as n_shingles, c.component_id
from d join (select x, min(r) as component_id from reach group by x) c on c.x = d.doc_id
"""
