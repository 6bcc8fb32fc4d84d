"""Operator 12, document fingerprints: a Merkle tree over a text's clauses, paragraphs and sections.

Method. A paragraph is a line with its line feeds; its leaves are clauses, up to the next punctuation or CLAUSE letters (FINE
letters in paragraphs of less than SHORT, so that short texts have leaves to compare). A paragraph's hash is that of its leaves' hashes, a section's that of its paragraphs', the root's that of all sections'. A
section ends after an empty line, or after a paragraph whose hash begins with a zero: a rule of the content alone, so that
what stands before or after a passage doesn't move the cuts within it. A fingerprint is the tree as a string; equal roots mean
equal texts, and where roots differ, the differing branches locate the edits (`differences`).

Likeness of two fingerprints: twice the letters of the leaves they share, each as often as in both, by the letters of both; equal
roots are 1, and equal sections and paragraphs are passed over whole. Two empty texts are equal.

The string: root, then a word for each section: its hash, and for each paragraph `,hash` and for each leaf `.hash:letters`.
Hashes are SHA-256: 64 hex digits of the root, 16 of sections and paragraphs, 8 of leaves.

Defined results. Null text: empty. The next document is the next row by id, then by the text's SHA-256; after the last comes the first; a single
row follows itself. Rows without an id come last. Repeated rows: a row each. Very long texts are taken whole. Columns other than the two
that are named aren't read. An empty table gives an empty result.

Scale: rows are dealt in ranges of ids, whose bounds are quantiles, at most RANGES; the rows of an id with very many are dealt
over several. A range is sorted and streamed, so a task holds two texts at a time. The first row of each range goes along to the
range before it. One shuffle of the texts, nothing else.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: Most letters of a clause in a paragraph, in one of less than SHORT letters, and the ranges of ids at most.
CLAUSE, FINE, SHORT, RANGES = 40, 8, 100, 1 << 14

PARAGRAPH = r"[^\n]*\n+|[^\n]+"
LEAF, FINE_LEAF = (rf"[^.!?,;:]{{1,{n}}}[.!?,;:\x20\x09-\x0D]*|[.!?,;:]+[\x20\x09-\x0D]*" for n in (CLAUSE, FINE))
#: Letters of fingerprints in a batch of results, and the id that rows without one are ordered by.
OUT, LAST = 1 << 21, (1 << 63) - 1
NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
RESULT = "doc_id {}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

_paragraphs, _leaves, _fine = (re.compile(x).findall for x in (PARAGRAPH, LEAF, FINE_LEAF))


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def fingerprint(text: str) -> str:
    """The tree of a text as a string."""
    sections, now, hashes, all_hashes = [], [], [], []

    def close():
        whole = _sha("".join(hashes).encode())
        all_hashes.append(whole)
        sections.append(whole[:16] + "".join(now))
        now.clear()
        hashes.clear()

    for paragraph in _paragraphs(text):
        leaves = _leaves(paragraph) if len(paragraph) >= SHORT else _fine(paragraph)
        made = [_sha(x.encode()) for x in leaves]
        own = _sha("".join(made).encode())
        hashes.append(own)
        now.append(f",{own[:16]}." + ".".join([f"{h[:8]}:{len(x)}" for h, x in zip(made, leaves, strict=True)]))
        if own[0] == "0" or paragraph.endswith("\n\n"):
            close()
    if now:
        close()
    return " ".join([_sha("".join(all_hashes).encode()), *sections])


def _branches(words: list[str], others: Counter) -> list[str]:
    """Branches that are left when those that the other side has too are taken away, each as often as it has them."""
    out = []
    for w in words:
        if others[w] > 0:
            others[w] -= 1
        else:
            out.append(w)
    return out


def _letters(leaves: list[str]) -> int:
    return sum([int(x[9:]) for x in leaves])


def _tree(print_: str) -> tuple[str, list[str]]:
    root, *sections = print_.split(" ")
    return root, sections


def _unlike(left: list[str], right: list[str]) -> tuple[list[str], list[str]]:
    return _branches(left, Counter(right)), _branches(right, Counter(left))


def _children(nodes: list[str], mark: str) -> list[str]:
    return [x for node in nodes for x in node.split(mark)[1:]]


def likeness(one: str, two: str) -> float:
    """0 to 1: how much two fingerprints share."""
    (root, a), (other, b) = _tree(one), _tree(two)
    if root == other:
        return 1.0
    total = sum(_letters(_children(_children(side, ","), ".")) for side in (a, b))
    # Whole sections first, then whole paragraphs, then leaves.
    a, b = _unlike(a, b)
    a, b = _unlike(_children(a, ","), _children(b, ","))
    a, b = _unlike(_children(a, "."), _children(b, "."))
    return (total - _letters(a) - _letters(b)) / total


def differences(one: str, two: str) -> list[tuple[int, int]]:
    """Places (begin, end) in the first text whose paragraphs the second text hasn't, neighbours joined."""
    (root, a), (other, b) = _tree(one), _tree(two)
    if root == other:
        return []
    have = Counter(_children(b, ","))
    out, at = [], 0
    for p in _children(a, ","):
        n = _letters(p.split(".")[1:])
        if have[p] > 0:
            have[p] -= 1
        elif out and out[-1][1] == at:
            out[-1] = (out[-1][0], at + n)
        else:
            out.append((at, at + n))
        at += n
    return out


def edited(text: str, following: str) -> str:
    """The text whose last half is replaced by as much of the beginning of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _bounds(ids: DataFrame, n: int) -> list[int]:
    """Bounds of n ranges of ids with about as many rows each; an id with many rows is the bound of several."""
    if n < 2:
        return []
    return ids.agg(F.percentile_approx("i", [k / n for k in range(1, n)], 20 * n)).first()[0] or []


def _range(bounds: list[int]):
    """The range of an id; the rows of an id that is the bound of several ranges are dealt over them in the order of their share."""
    held = np.array(bounds, dtype=np.int64)

    @F.pandas_udf("int")
    def place(i: pd.Series, share: pd.Series) -> pd.Series:
        low, high = (np.searchsorted(held, i.to_numpy(), side) for side in ("left", "right"))
        return pd.Series(np.where(high > low, low + 1 + np.floor(share.to_numpy() * (high - low)).astype(np.int64), high).astype(np.int32))

    return place


def _stream(batches):
    """Rows in order, each followed by its next: the last of a range by the first row of the next range."""
    pending, out, size = None, [], 0
    for batch in batches:
        tails, keys = batch.column(0).to_pylist(), batch.column(1)
        for n, tail in enumerate(tails):
            text = batch.column(2)[n].as_py()
            own = fingerprint(text)
            if pending is not None:
                key, before, print_ = pending
                new = edited(before, text)
                new_print = fingerprint(new)
                out.append((key, len(before), _sha(new.encode()), print_, new_print, likeness(print_, new_print), likeness(print_, own)))
                size += len(print_) + len(new_print)
            pending = None if tail else (keys[n], text, own)
            if size > OUT:
                yield _batch(out, keys.type)
                out, size = [], 0
    if out:
        yield _batch(out, keys.type)


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = [kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    columns = [[x.as_py() for x in c] if k == 0 else c for k, c in enumerate(zip(*rows, strict=True))]
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], names=NAMES)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """A row for each document: length, edited text's digest, both fingerprints, and likeness to the edited and to the next text."""
    spark = docs.sparkSession
    if ranges is None:
        ranges = min(RANGES, 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions()))
    src = docs.select(F.coalesce(shared.whole_id(F.col(id_col)), F.lit(LAST)).alias("i"), F.col(id_col).alias("k"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    place = _range(_bounds(src.select("i"), ranges))
    # The first 60 bits of a text's digest order the rows of an id.
    src = src.withColumn("h", F.conv(F.substring(F.sha2("t", 256), 1, 15), 16, 10).cast("long"))
    src = src.withColumn("range", place("i", F.col("h") / float(1 << 60)))
    firsts = sorted((r["range"], r["e"]["i"], r["e"]["h"]) for r in src.groupBy("range").agg(F.min(F.struct("i", "h")).alias("e")).collect())
    if not firsts:
        return docs.select(F.col(id_col).alias("doc_id")).limit(0).mapInArrow(lambda batches: iter(()), RESULT.format(docs.schema[id_col].dataType.simpleString()))
    # The first row of a range goes along, as its last, to the range before it, and that of the first to the last.
    before = [(r, i, h, firsts[n - 1][0]) for n, (r, i, h) in enumerate(firsts)]
    ends = spark.createDataFrame(before, "range int, i bigint, h bigint, before int")
    tails = src.join(F.broadcast(ends), ["range", "i", "h"]).dropDuplicates(["range"]).select("i", "k", "t", "h", F.col("before").alias("range"), F.lit(True).alias("tail"))
    rows = src.withColumn("tail", F.lit(False)).unionByName(tails)
    ordered = rows.repartition("range").sortWithinPartitions("range", "tail", "i", "h").select("tail", "k", "t")
    return ordered.mapInArrow(_stream, RESULT.format(docs.schema[id_col].dataType.simpleString()))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(shared.table(spark, sf_dir, "documents"))


def _oracle() -> str:
    return rf"""
with d as (
  select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n, coalesce(lead(doc_id) over w, first(doc_id) over w) as next_id, coalesce(lead(coalesce(text, '')) over w, first(coalesce(text, '')) over w) as f
  from documents window w as (order by doc_id, sha256(coalesce(text, '')) rows between unbounded preceding and unbounded following)),
e as (select doc_id, next_id, n, t, left(t, n - n // 2) || left(f, n // 2) as x from d),
v as (select doc_id, 0 as v, t from e union all select doc_id, 1, x from e),
p as (select doc_id, v, unnest(regexp_extract_all(t, '{PARAGRAPH}')) as p, generate_subscripts(regexp_extract_all(t, '{PARAGRAPH}'), 1) as i from v),
q as (select doc_id, v, i, p[-2:] = chr(10) || chr(10) as blank, case when length(p) >= {SHORT} then regexp_extract_all(p, '{LEAF}') else regexp_extract_all(p, '{FINE_LEAF}') end as cs from p),
l as (select doc_id, v, i, blank, list_transform(cs, lambda x: sha256(x)) as ls, list_transform(cs, lambda x: sha256(x)[:8] || ':' || length(x)) as xs from q),
h as (select *, sha256(array_to_string(ls, '')) as own from l),
o as (select *, coalesce(sum((own[1] = '0' or blank)::int) over (partition by doc_id, v order by i rows between unbounded preceding and 1 preceding), 0) as s from h),
s as (
  select doc_id, v, s, sha256(string_agg(own, '' order by i)) as whole,
    string_agg(',' || own[:16] || '.' || array_to_string(xs, '.'), '' order by i) as body from o group by all),
r as (
  select v.doc_id, v.v, sha256(coalesce(string_agg(whole, '' order by s), '')) as root, coalesce(string_agg(' ' || whole[:16] || body, '' order by s), '') as rest
  from v left join s on v.doc_id = s.doc_id and v.v = s.v group by v.doc_id, v.v),
u as (select doc_id, v, unnest(xs) as x from o),
c as (select doc_id, v, x, sum(x[10:]::bigint) as k from u group by all),
m as (select doc_id, v, sum(k) as k from c group by all),
a as (select e.doc_id, sum(least(x.k, y.k)) as k from e join c x on x.doc_id = e.doc_id and x.v = 0 join c y on y.doc_id = e.doc_id and y.v = 1 and y.x = x.x group by 1),
b as (select e.doc_id, sum(least(x.k, y.k)) as k from e join c x on x.doc_id = e.doc_id and x.v = 0 join c y on y.doc_id = e.next_id and y.v = 0 and y.x = x.x group by 1)
select e.doc_id, e.n::bigint as n_chars, sha256(e.x) as edited_sha256, r0.root || r0.rest as fingerprint, r1.root || r1.rest as edited_fingerprint,
  case when r0.root = r1.root then 1.0 else 2 * coalesce(a.k, 0) / (coalesce(m0.k, 0) + coalesce(m1.k, 0)) end::double as near_edited,
  case when r0.root = r2.root then 1.0 else 2 * coalesce(b.k, 0) / (coalesce(m0.k, 0) + coalesce(m2.k, 0)) end::double as near_next
from e join r r0 on r0.doc_id = e.doc_id and r0.v = 0 join r r1 on r1.doc_id = e.doc_id and r1.v = 1 join r r2 on r2.doc_id = e.next_id and r2.v = 0
left join a on a.doc_id = e.doc_id left join b on b.doc_id = e.doc_id
left join m m0 on m0.doc_id = e.doc_id and m0.v = 0 left join m m1 on m1.doc_id = e.doc_id and m1.v = 1 left join m m2 on m2.doc_id = e.next_id and m2.v = 0"""


ORACLE = _oracle()
