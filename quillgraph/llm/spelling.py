"""Operator 13, spelling variants: words one edit apart, found in a forward and a reversed sorted dictionary.

Method. One edit leaves the first or the last half of a word intact. For a pair whose shorter word has L letters the forward
dictionary is sorted by the first half of L letters and the reversed one by the last half, read backwards; a word enters both
for L of its own length and of one less. Words that share a half are a block, a range of the sorted dictionary. A block whose
pairs would cost too much is subdivided: the part that is still open, [a, b) of the shorter word, has the edit in one of its
halves again, so its words go on with a longer shared prefix or suffix. Blocks that are small enough are scanned and each pair
is verified. A pair is counted in one block only: where both halves are intact, in that of the longer prefix.

Words are maximal runs of Latin letters, A-Z lower-cased, of LEAST code points or more and FEWEST occurrences or more; variant
deletions are those of the contract (`slips`). A word's form is its near word of largest n, if that is RATIO times its own;
its root is where the forms end.

Defined results. Null or empty text: no words. A null id counts as the word null. Repeated rows count each. Equal counts: the
near word that comes first in code-point order. Very long words are subdivided until few letters are open. Columns other than
the two that are named aren't read. An empty table gives an empty result.

Scale: texts are read once, in place; words are counted within a task before they are shuffled. A block is counted before it
is gathered and gathered only if small, so no task ever holds a large one, however common a half is; a block that can't be
subdivided further has at most one word for each letter of the alphabet. Forms have at least RATIO times the count, so chains
are as long as a logarithm of the largest count, and roots take the logarithm of that in rounds.
"""

from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: Least code points and occurrences of a word, and how many times as frequent its form must be.
LEAST, FEWEST, RATIO = 6, 5, 5
#: One run in so many, by its hash, loses a letter.
SLIP = 199
#: Letters compared in a block at most, pairs times open letters; a larger block is subdivided.
MOST = 1 << 15
#: Words that a task counts before it hands them on.
HELD = 200_000

RUN = re.compile(rb"[a-z\xc0-\xff]+")
BLOCK = ["reversed", "size", "a", "b", "entry"]
RESULT = ["word", "form", "root", "n", "n_near", "form_n"]


def _utf8(word: bytes) -> bytes:
    return word if word.isascii() else word.decode("latin-1").encode()


def slips(doc: str, word: bytes, every: int = SLIP) -> bytes:
    """The word as it stands in the document: one of so many loses a letter. A word is one byte a code point."""
    h = crc32(_utf8(word), crc32(f"{doc}:".encode()))
    return word if h % every else word[: h % len(word)] + word[h % len(word) + 1 :]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, every: int = SLIP) -> DataFrame:
    """(word, n) of all documents, words of at least so many code points."""

    def count(batches):
        held: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                if not text:
                    continue
                # One byte a code point; what isn't Latin becomes a question mark, which is no letter either.
                runs = Counter(w for w in RUN.findall(text.encode("latin-1", "replace").lower()) if len(w) >= least)
                start = crc32(f"{'null' if doc is None else doc}:".encode())
                for w, n in runs.items():
                    h = crc32(w if w.isascii() else _utf8(w), start)
                    if h % every == 0:
                        w = w[: h % len(w)] + w[h % len(w) + 1 :]
                        if len(w) < least:
                            continue
                    held[w] += n
            if len(held) >= HELD:
                yield _counted(held)
                held = Counter()
        if held:
            yield _counted(held)

    d = docs.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t"))
    return d.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"word": pa.array([w.decode("latin-1") for w in held]), "n": pa.array(held.values(), type=pa.int64())})


def _within(rows: DataFrame) -> DataFrame:
    """Words with (reversed, size, a, b) to the same with their entry: what the words of a block share, in the dictionary's order."""
    prefix = F.expr("left(word, a)")
    suffix = F.reverse(F.expr("right(word, size - b)"))
    return rows.withColumn("entry", F.when(F.col("reversed"), F.concat(suffix, prefix)).otherwise(F.concat(prefix, suffix)))


def _halves(rows: DataFrame) -> DataFrame:
    """A row for the first half of the open part and one for the second."""
    c = F.expr("a + cast(floor((b - a) / 2) as int)")
    both = F.array(F.struct(c.alias("a"), F.col("b").alias("b")), F.struct(F.col("a").alias("a"), c.alias("b")))
    return rows.withColumn("half", F.explode(both)).withColumns({"a": F.col("half.a"), "b": F.col("half.b")}).drop("half")


def dictionaries(words: DataFrame) -> DataFrame:
    """(word, n) to the entries of both dictionaries, for each size of the shorter word."""
    sized = words.withColumn("size", F.explode(F.array(F.length("word"), F.length("word") - 1)))
    open_ = _halves(sized.withColumns({"a": F.lit(0), "b": F.col("size")}))
    return _within(open_.withColumn("reversed", F.col("a") == 0))


def near_pairs(words: list[bytes], size: int, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of a block that are one edit apart, but for those that belong to a block with a longer prefix."""
    length = np.array([len(w) for w in words])
    short, long = np.flatnonzero(length == size), np.flatnonzero(length == size + 1)
    w = b - a

    def middle(at, n):
        return np.frombuffer(b"".join(words[i][a : a + n] for i in at), dtype=np.uint8).reshape(len(at), n)

    s = middle(short, w)
    one, two = np.nonzero(np.triu((s[:, None, :] != s[None, :, :]).sum(-1) == 1, 1))
    left, right = [short[one]], [short[two]]
    if len(long) and len(short):
        t = middle(long, w + 1)
        same = np.cumprod(s[:, None, :] == t[None, :, :w], axis=-1).sum(-1)
        back = np.cumprod((s[:, None, :] == t[None, :, 1:])[:, :, ::-1], axis=-1).sum(-1)
        found = same + back >= w
        if b < size:
            found &= same < w
        one, two = np.nonzero(found)
        left.append(short[one])
        right.append(long[two])
    return np.concatenate(left), np.concatenate(right)


def _scan(batches):
    """Blocks are ranges of rows in order; the last one of a batch may go on in the next."""
    rest = None
    for batch in batches:
        rows = batch if rest is None else pa.concat_batches([rest, batch])
        keys = _keys(rows)
        ends = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]]
        yield from _links(rows, keys, [0, *ends[:-1]], ends)
        rest = rows.slice(ends[-1]) if ends else rows
    if rest is not None and rest.num_rows:
        yield from _links(rest, _keys(rest), [0], [rest.num_rows])


def _keys(rows):
    return list(zip(*[rows.column(k).to_pylist() for k in range(len(BLOCK))], strict=True))


def _links(rows, keys, starts, ends):
    if not ends:
        return
    words = [w.encode("latin-1") for w in rows.column(5).to_pylist()]
    left, right = [], []
    for i, j in zip(starts, ends, strict=False):
        _, size, a, b, _ = keys[i]
        one, two = near_pairs(words[i:j], size, a, b)
        left += [one + i, two + i]
        right += [two + i, one + i]
    at, near = np.concatenate(left), np.concatenate(right)
    if len(at):
        at, near = pa.array(at), pa.array(near)
        yield pa.RecordBatch.from_arrays([rows.column(5).take(at), rows.column(5).take(near), rows.column(6).take(near)], names=["word", "near", "near_n"])


def near_words(words: DataFrame, most: int = MOST) -> DataFrame:
    """(word, n), words distinct, to (word, near, near_n): each pair that is one edit apart, in both directions, once."""
    entries, found, old = dictionaries(words), [], []
    while True:
        entries = shared.settle(entries.select(*BLOCK, "word", "n"), "spelling-entries")
        own = F.length("word") == F.col("size")
        blocks = entries.groupBy(*BLOCK).agg(F.count_if(own).alias("s"), F.count_if(~own).alias("l")).withColumn("pairs", F.expr("cast(s as double) * (s - 1) / 2 + cast(s as double) * l"))
        # A block without a pair is done with.
        blocks = shared.settle(blocks.filter("pairs > 0").select(*BLOCK, (F.expr("pairs * (b - a + 1)") > most).alias("large") & (F.expr("b - a") > 1)).toDF(*BLOCK, "large"), "spelling-blocks")
        small = entries.join(blocks.filter("not large"), BLOCK, "left_semi")
        links = small.repartitionByRange(*BLOCK).sortWithinPartitions(*BLOCK, "word").select(*BLOCK, "word", "n").mapInArrow(_scan, "word string, near string, near_n bigint")
        found.append(shared.settle(links, "spelling-links"))
        old += [entries, blocks]
        if blocks.filter("large").isEmpty():
            break
        entries = _within(_halves(entries.join(blocks.filter("large"), BLOCK, "left_semi").drop("entry")))
    shared.discard(*old)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """(word, form) without cycles to (word, root): forms are followed to the last, twice as far each round."""
    now = shared.settle(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        then = shared.settle(now.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        shared.discard(now)
        now = then
        if now.filter("moved").isEmpty():
            return now.drop("moved")


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, fewest: int = FEWEST, ratio: int = RATIO, every: int = SLIP, most: int = MOST) -> DataFrame:
    """A row for each word: its form and root, its count, how many words are near, and its form's count."""
    words = shared.settle(word_counts(docs, id_col, text_col, least, every).filter(F.col("n") >= fewest), "spelling-words")
    best = near_words(words, most).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    fits = -F.col("best.less") >= F.lit(ratio) * F.col("n")
    out = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n"))
    out = shared.settle(out, "spelling-forms")
    ends = roots(out.filter("form is not null").select("word", "form"))
    return out.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word")).select(*RESULT)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(shared.table(spark, sf_dir, "documents"))


#: Near words by the words that are left when a letter is deleted, without dictionaries; the checksum from its polynomial.
ORACLE = rf"""
with recursive t as (
  select list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, n)) as v),
r as (
  select coalesce(doc_id::varchar, 'null') as doc, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents),
k as (select doc, run, count(*) as k from r where length(run) >= {LEAST} group by all),
b as (
  select doc, run, k, list_concat(list_transform(string_split(doc || ':', ''), lambda x: unicode(x)),
    flatten(list_transform(string_split(run, ''), lambda x: case when unicode(x) < 128 then [unicode(x)] else [195, unicode(x) - 64] end))) as bytes from k),
h as (select doc, run, k, xor(list_reduce(bytes, lambda c, x: xor(v[(xor(c, x::bigint) & 255) + 1], c >> 8), 4294967295::bigint), 4294967295) as h from b, t),
w as (select case when h % {SLIP} = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, sum(k)::bigint as n from h group by all),
v as (select word, n from w where length(word) >= {LEAST} and n >= {FEWEST}),
d as (select word, n, unnest(range(length(word))) as i from v),
e as (select word, n, i, left(word, i::int) || substr(word, i::int + 2) as rest from d),
p as (
  select x.word, y.word as near, y.n as near_n from e x join e y on x.rest = y.rest and x.i = y.i and x.word <> y.word
  union select e.word, v.word, v.n from e join v on e.rest = v.word
  union select v.word, e.word, e.n from e join v on e.rest = v.word),
m as (select word, count(*) as n_near, arg_min(near, (-near_n, encode(near))) as near, max(near_n) as near_n from p group by word),
f as (select v.word, v.n, coalesce(n_near, 0)::bigint as n_near, case when near_n >= {RATIO} * n then near end as form, case when near_n >= {RATIO} * n then near_n end::bigint as form_n from v left join m using (word)),
c as (select word, word as last, 0 as step from f union all select c.word, f.form, step + 1 from c join f on c.last = f.word where f.form is not null),
z as (select word, arg_max(last, step) as root from c group by word)
select word, form, root, n, n_near, form_n from f join z using (word)"""
