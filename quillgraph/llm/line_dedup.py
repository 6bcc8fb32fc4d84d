"""Operator 2, line deduplication: pairwise alignment of documents that share rare runs of lines.

Method. Lines are compared by a hash of their bytes (A-Z as a-z); blank lines are passed over. A line alone may be common and
short, so what is looked up is the shortest run of lines of LEAST_WORDS words from each line on, and up to each line: every
common block of so many words is covered by such runs. Each run's frequency is measured over all documents, and its first
holder is found; runs that stand in one document only go. Of its shared runs a document takes the rarest first, and is paired
with that run's first holder, unless the holders it already has cover the run's lines. Each pair is aligned by patience diff:
lines that stand once on either side anchor the alignment by a longest increasing chain, which is extended to equal
neighbours and repeated between anchors. Aligned blocks of LEAST_WORDS words or more are deleted from the later document.
What patience leaves (passages that stand twice on a side and so have no anchor, moved ones) is looked up among the first
document's runs, so that every line in a run of so many words that it has too goes.

So exactly those lines go that stand in a run of LEAST_WORDS words that some earlier document has too, whichever it is: no pair
is lost, though a document meets only as many others as it needs. The first document that holds a line never loses it.

Defined results. Documents are ordered by id, then by the text's hash; ids that are null or no integers come last. Each row is a
document: of rows that are equal in id and text one counts as the first and the others are later copies. Null and empty
texts have no lines and stay as they are. A text whose lines all go is left with its blank lines. Lines repeated
within one document stay, as do shared ones in shorter runs than LEAST_WORDS. Extra columns aren't touched.

Scale: one pass makes a small profile of each text (hashes only), which all joins use. Documents with equal lines are a class:
all but its first lose their lines without being aligned. A first holder's lines travel once for each PARTNERS documents
that are aligned with it, so that one which a third of all documents are aligned with is spread over many tasks. Texts are
shuffled to the list of their lines that go only where a bounded filter holds them, and are cut without Python.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared, textvec

LEAST_WORDS = 25
PARTNERS = 256
_NOT_FEED = np.arange(256) != 10
_DOC = "struct<late:boolean,id:bigint,text:bigint>"


def line_profile(buf: np.ndarray, off: np.ndarray, least: int = LEAST_WORDS):
    """Of each slice: first line of each text (and one more); of each non-blank line its number, hash and words; two hashes of
    each text's lines; and of each shortest run of least words its text, first line, end line and key."""
    lines = textvec.words(buf, off, _NOT_FEED)
    words = textvec.word_bounds(buf, textvec.NOT_SPACE)[0]
    begin = np.searchsorted(words, lines.start)
    count = np.searchsorted(words, lines.end) - begin
    text = textvec.owner(lines.first)
    feeds = np.flatnonzero(buf == 10)
    number = np.searchsorted(feeds, lines.start) - np.searchsorted(feeds, off[:-1])[text]
    some = np.flatnonzero(count)
    text, number, count, h = text[some], number[some], count[some], lines.hash[some]
    first = np.searchsorted(text, np.arange(len(off)))
    up, down = textvec.powers(len(h) + 1)
    total, other = (np.concatenate([[np.uint64(0)], np.cumsum(textvec.mix(h + np.uint64(salt)) * up[:-1])]) for salt in (1, 0x51ED))
    own = tuple(textvec.mix((t[first[1:]] - t[first[:-1]]) * down[first[:-1]] + np.diff(first).astype(np.uint64)) for t in (total, other))
    upto = np.concatenate([[0], np.cumsum(count)])
    here = np.arange(len(h))
    runs = np.concatenate([
        np.stack([here, np.searchsorted(upto, upto[:-1] + least)], axis=1),
        np.stack([np.searchsorted(upto, upto[1:] - least, side="right") - 1, here + 1], axis=1),
    ])
    at = np.concatenate([here, here])
    inside = (runs[:, 0] >= first[text[at]]) & (runs[:, 1] <= first[text[at] + 1])
    runs = np.unique(runs[inside], axis=0)
    start, end = runs[:, 0], runs[:, 1]
    key = textvec.mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    return first, number, h, count, own, (text[start], start, end, key)


def _chain(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain of pairs (sorted by the first) that rises in the second too."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for n, (_, b) in enumerate(pairs):
        k = bisect_left(tops, b)
        if k == len(tops):
            tops.append(b)
            piles.append(n)
        else:
            tops[k], piles[k] = b, n
        back.append(piles[k - 1] if k else -1)
    out, n = [], piles[-1] if piles else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions of equal lines, rising in both."""
    out: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        once: dict[int, list[int]] = {}
        for side, (rows, low, high) in enumerate(((a, a0, a1), (b, b0, b1))):
            for i in range(low, high):
                seen = once.setdefault(rows[i], [0, 0, 0, 0])
                seen[side] += 1
                seen[2 + side] = i
        anchors = _chain(sorted((x[2], x[3]) for x in once.values() if x[0] == 1 and x[1] == 1))
        pa_, pb = a0, b0
        for i, j in anchors:
            if i < pa_ or j < pb:  # taken by the extension of an anchor before it
                continue
            s, t = i, j
            while s > pa_ and t > pb and a[s - 1] == b[t - 1]:
                s, t = s - 1, t - 1
            e, f = i + 1, j + 1
            while e < a1 and f < b1 and a[e] == b[f]:
                e, f = e + 1, f + 1
            work.append((pa_, s, pb, t))
            out.extend(zip(range(s, e), range(t, f), strict=True))
            pa_, pb = e, f
        if anchors:
            work.append((pa_, a1, pb, b1))
    return sorted(out)


def _runs(words: list[int], least: int) -> Iterator[tuple[int, int]]:
    """Where the shortest runs of least words stand: from each line on, and up to each line.

    A line stands in an equal run of least words, however long, only if it stands in an equal one of these.
    """
    upto = [0, *accumulate(words)]
    for n, total in enumerate(upto):
        if (to := bisect_left(upto, total + least)) < len(upto):
            yield n, to
        if (low := bisect_right(upto, total - least) - 1) >= 0:
            yield low, n


def common_lines(a: list[int], b: list[int], words: list[int], least: int = LEAST_WORDS) -> set[int]:
    """Positions in b of all lines in blocks of least words that a has too; words: of b's lines."""
    size, held, gone = dict(zip(b, words, strict=True)), set(a), set()
    block: list[tuple[int, int]] = []
    for i, j in [*patience(a, b), (-9, -9)]:
        if block and (i, j) != (block[-1][0] + 1, block[-1][1] + 1):
            if sum(words[y] for _, y in block) >= least:
                gone |= {y for _, y in block}
            block = []
        block.append((i, j))
    if all(j in gone or line not in held for j, line in enumerate(b)):
        return gone
    # Patience finds no anchor in a passage that stands twice on a side and leaves out moved ones: their runs are looked up.
    # A line that b hasn't counts least words, so that a's other runs are as short as b's.
    runs = {tuple(a[s:e]) for s, e in _runs([size.get(line, least) for line in a], least)}
    for s, e in _runs(words, least):
        if tuple(b[s:e]) in runs:
            gone.update(range(s, e))
    return gone


def _lists(first: np.ndarray, values: np.ndarray, kind, own: np.ndarray) -> pa.ListArray:
    size = np.diff(first)[own]
    off = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    at = np.repeat(first[own] - off[:-1], size) + np.arange(off[-1])
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(values[at], kind))


def _doc(id_col: str, text_col: str) -> F.Column:
    """What orders and names documents."""
    key = shared.whole_id(F.col(id_col))
    return F.struct(key.isNull().alias("late"), F.coalesce(key, F.lit(0).cast("long")).alias("id"), F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("text"))


def profiles(docs: DataFrame, id_col: str, text_col: str, least: int = LEAST_WORDS) -> DataFrame:
    """A row for each document that has a run: its lines, and its runs (key, where they begin and end)."""

    def run(batches):
        for batch in batches:
            for part in textvec.slices(batch, 1):
                first, number, h, count, own, (text, start, end, key) = line_profile(*textvec.flat(part.column(1)), least)
                cut = np.searchsorted(text, np.arange(part.num_rows + 1))
                take = np.flatnonzero(np.diff(cut))
                low = first[text]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(take)), *(pa.array(x[take].view(np.int64)) for x in own), _lists(first, number, pa.int32(), take), _lists(first, h.view(np.int64), pa.int64(), take), _lists(first, count, pa.int32(), take)]
                    + [_lists(cut, key.view(np.int64), pa.int64(), take), _lists(cut, start - low, pa.int32(), take), _lists(cut, end - low, pa.int32(), take)],
                    names=["doc", "one", "two", "number", "line", "words", "key", "start", "end"],
                )

    src = docs.select(_doc(id_col, text_col).alias("doc"), F.col(text_col).cast("string").alias("t"))
    return src.mapInArrow(run, f"doc {_DOC}, one bigint, two bigint, number array<int>, line array<bigint>, words array<int>, key array<bigint>, start array<int>, end array<int>")


def holders_needed(runs: list[tuple[int, int, int, object]]) -> list:
    """runs: (frequency, first line, end line, holder); the holders that cover all lines of the runs, found by the rarest ones."""
    of: dict[object, list[tuple[int, int]]] = {}
    for _, s, e, holder in runs:
        of.setdefault(holder, []).append((s, e))
    covered: set[int] = set()
    out: list = []
    for _, s, e, holder in sorted(runs, key=lambda r: (r[0], r[3], r[1])):
        if holder not in out and not covered.issuperset(range(s, e)):
            out.append(holder)
            for x, y in of[holder]:
                covered.update(range(x, y))
    return out


def partners(prof: DataFrame, copies: DataFrame) -> DataFrame:
    """(doc, holder): the earlier documents with which each document is to be aligned. copies aren't aligned."""
    runs = prof.select("doc", F.explode(F.arrays_zip("key", "start", "end")).alias("r")).select("doc", F.col("r.key").alias("key"), F.col("r.start").alias("s"), F.col("r.end").alias("e"))
    known = runs.groupBy("key").agg(F.min("doc").alias("holder"), F.max("doc").alias("last"), F.count("*").alias("places")).filter("holder < last").select("key", "holder", "places")
    # Settled, so that the join's sides are both plain exchanges, of which Spark splits a hot key's.
    known = shared.settle(known, "line-runs")
    held = runs.join(known, "key").filter("holder < doc").join(copies.select("doc"), "doc", "left_anti")
    held = held.groupBy("doc").agg(F.collect_list(F.struct("places", "s", "e", "holder")).alias("runs"))

    def choose(batches):
        for batch in batches:
            docs, out = [], []
            for doc, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for holder in holders_needed([(r["places"], r["s"], r["e"], tuple(r["holder"].values())) for r in runs]):
                    docs.append(doc)
                    out.append(dict(zip(("late", "id", "text"), holder, strict=True)))
            kind = batch.schema.field(0).type
            yield pa.RecordBatch.from_arrays([pa.array(docs, kind), pa.array(out, kind)], names=["doc", "holder"])

    out = shared.settle(held.mapInArrow(choose, f"doc {_DOC}, holder {_DOC}"), "line-partners")
    shared.discard(known)
    return out


def aligned(prof: DataFrame, pairs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """(doc, gone): the numbers of the lines that each pair's alignment deletes."""
    many = shared.settle(pairs.groupBy("holder").agg(F.ceil(F.count("*") / PARTNERS).alias("parts")), "line-holders")
    pairs = shared.settle(pairs.join(many, "holder").select("doc", "holder", F.pmod(F.xxhash64("doc"), "parts").alias("part")), "line-pairs")
    lines = prof.select("doc", "number", "line", "words").dropDuplicates(["doc"])
    firsts = pairs.select("holder", "part").distinct().join(lines.select(F.col("doc").alias("holder"), "line"), "holder")
    firsts = firsts.select("holder", "part", F.lit(0).alias("kind"), F.lit(None).cast(_DOC).alias("doc"), F.lit(None).cast("array<int>").alias("number"), "line", F.lit(None).cast("array<int>").alias("words"))
    later = pairs.join(lines, "doc").select("holder", "part", F.lit(1).alias("kind"), "doc", "number", "line", "words")
    dealt = firsts.unionByName(later).repartition("holder", "part").sortWithinPartitions("holder", "part", "kind")

    def align(batches):
        held: list[int] = []  # the lines of the holder that came last; its partners follow it
        for batch in batches:
            at, gone = [], []
            for i, (kind, number, line, words) in enumerate(zip(*(batch.column(k) for k in (2, 4, 5, 6)), strict=True)):
                if not kind.as_py():
                    held = line.as_py()
                elif found := common_lines(held, line.as_py(), words.as_py(), least):
                    number = number.as_py()
                    at.append(i)
                    gone.append(sorted(number[j] for j in found))
            yield pa.RecordBatch.from_arrays([batch.column(3).take(pa.array(at, pa.int32())), pa.array(gone, pa.list_(pa.int32()))], names=["doc", "gone"])

    out = shared.settle(dealt.mapInArrow(align, f"doc {_DOC}, gone array<int>"), "line-blocks")
    shared.discard(pairs, many)
    return out


def removals(docs: DataFrame, id_col: str, text_col: str, least: int = LEAST_WORDS) -> DataFrame:
    """(doc, gone, every, again): what each document loses. every: all its lines; again: several rows are this document."""
    prof = shared.settle(profiles(docs, id_col, text_col, least), "line-profiles")
    classes = shared.settle(prof.groupBy("one", "two").agg(F.min("doc").alias("first"), F.count("*").alias("rows")).filter("rows > 1"), "line-copies")
    members = shared.settle(prof.select("doc", "one", "two").join(classes.select("one", "two", "first"), ["one", "two"]).groupBy("doc", "first").agg(F.count("*").alias("rows")), "line-classes")
    copies = members.filter("doc > first")
    pairs = partners(prof, copies)
    blocks = aligned(prof, pairs, least)
    none = F.lit(None).cast("array<int>")
    every = blocks.select("doc", "gone", F.lit(False).alias("every"), F.lit(False).alias("again"))
    every = every.unionByName(members.filter("doc > first or rows > 1").select("doc", none.alias("gone"), (F.col("doc") > F.col("first")).alias("every"), (F.col("rows") > 1).alias("again")))
    out = shared.settle(every.groupBy("doc").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"), F.max("every").alias("every"), F.max("again").alias("again")), "line-removals")
    shared.discard(prof, classes, members, pairs, blocks)
    return out


def _first_rows(rows: DataFrame, doc: str, every: str) -> DataFrame:
    """Rows of documents that stand several times: all but one of each lose all lines. A hot one is counted off in parts first."""
    part, place = shared.spare(rows, "part", "place")
    dealt = rows.withColumn(part, F.floor(F.rand(17) * 256))
    dealt = shared.settle(dealt.withColumn(place, F.row_number().over(Window.partitionBy(doc, part).orderBy(F.lit(0)))), "line-repeats")
    one = dealt.filter(F.col(place) == 1).withColumn(place, F.row_number().over(Window.partitionBy(doc).orderBy(part)))
    return one.unionByName(dealt.filter(F.col(place) > 1)).withColumn(every, F.col(every) | (F.col(place) > 1)).drop(part, place)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """All rows and columns with the text after deletion, and the column lines_removed (with underscores if there is one)."""
    gone = removals(docs, id_col, text_col, least)
    doc, lines, every, again, removed, cut = shared.spare(docs, "doc", "gone", "every", "again", "lines_removed", "cut")
    keyed = docs.withColumn(doc, _doc(id_col, text_col))
    # Only texts that may lose lines are shuffled to the list of their lines.
    key = F.col(f"{doc}.text")
    some, rest = shared.split_by(keyed, key, shared.fingerprint_filter(gone, F.col("doc.text")))
    joined = some.join(gone.select(F.col("doc").alias(doc), F.col("gone").alias(lines), F.col("every").alias(every), F.col("again").alias(again)).hint("merge"), doc, "left")
    if not gone.filter("again").isEmpty():
        twice = F.coalesce(F.col(again), F.lit(False))
        joined = joined.filter(~twice).unionByName(_first_rows(joined.filter(twice), doc, every).select(*joined.columns))
    parts = F.split(F.col(text_col).cast("string"), "\n", -1)
    blank = F.filter(parts, lambda x: ~x.rlike(r"[^\x20\x09-\x0D]"))
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(lines)), lambda i: F.get(parts, i))
    kept = F.when(F.col(every), blank).when(F.size(lines) > 0, left)
    joined = joined.withColumn(cut, kept)
    joined = joined.withColumn(removed, F.when(F.col(cut).isNotNull(), F.size(parts) - F.size(cut)).otherwise(0)).withColumn(text_col, F.when(F.col(cut).isNotNull(), F.array_join(cut, "\n")).otherwise(F.col(text_col)))
    return joined.select(*docs.columns, removed).unionByName(rest.withColumn(removed, F.lit(0)).select(*docs.columns, removed))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs)


ORACLE = r"""
with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents where text is not null),
n as (
  select doc_id, i, translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as words,
    row_number() over (partition by doc_id order by i) as p, sum(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) over (partition by doc_id order by i) as upto
  from l where regexp_matches(line, '[^\x20\x09-\x0D]')),
t as (select doc_id, list(low order by p) as ls from n group by doc_id),
runs as (
  select a.doc_id, a.p as s, b.p as e from n a asof join n b on a.doc_id = b.doc_id and a.upto - a.words + 25 <= b.upto
  union
  select b.doc_id, a.p, b.p from n b asof join (select *, upto - words as before from n) a on a.doc_id = b.doc_id and b.upto - 25 >= a.before),
keyed as (select runs.*, array_to_string(ls[s:e], chr(10)) as k from runs join t using (doc_id)),
held as (select k, min(doc_id) as holder from keyed group by k),
gone as (
  select distinct n.doc_id, n.i from (select keyed.* from keyed join held using (k) where holder < doc_id) g
  join n on n.doc_id = g.doc_id and n.p between g.s and g.e),
kept as (select l.doc_id, string_agg(l.line, chr(10) order by l.i) as text from l anti join gone on l.doc_id = gone.doc_id and l.i = gone.i group by l.doc_id),
lost as (select doc_id, count(*) as c from gone group by doc_id)
select d.doc_id, case when lost.c is null then d.text else coalesce(kept.text, '') end as text, coalesce(lost.c, 0)::int as lines_removed
from documents d left join lost on lost.doc_id = d.doc_id left join kept on kept.doc_id = d.doc_id
"""
