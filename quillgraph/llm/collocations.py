"""Operator 11, phrase collocations by hierarchical pair naming.

Method. Texts become chunks, rows of numbers with a mark between pieces. Words have ids, 64 bits of a hash. A frequent phrase of k
words is the pair of the ids of its first and its last k - 1 words, which overlap, and its id is a hash of the two. Before phrases
are counted exactly, they are counted by the upper 32 bits of their ids, in ranges that are tables of fixed size: a phrase whose
bucket stays below the least count is infrequent. Ids of what is counted exactly are checked to be different where one is
frequent, and chosen anew if they aren't. A phrase that holds an infrequent part is infrequent itself, so nothing frequent is lost. The
two ids are parent pointers: a phrase's counts of first parts come along its left parents and those of last parts along its
right parents, which is all that the cuts need; and a phrase is subsumed exactly if one of its children is frequent enough,
since counts fall from a phrase to each that holds it.

Score of a cut of a phrase that stands a times into parts that stand l and r times: floor(2000000 a / (l + r)), in decimals; the
phrase's score is the lowest, ties to the earliest cut.

Defined results. Null text: empty; null language: `und`. Repeated rows count each. Ties are ordered by phrase, in bytes. Very long
texts are cut into chunks that share as many words as a phrase may need, each place being counted in one of them. Columns
other than the two that are named aren't read. An empty table gives an empty result.

Scale: a chunk is some MB of text of one language and is the largest thing that a task holds. Counts are summed within a chunk,
then within a task, then shuffled. Texts are read three times, for words, for pairs, and for the places whose pairs may be
frequent, by filters of bounded size that never decide a result; only those places are written, and from there on chunks shrink
with each round. No dictionary is broadcast or collected. The first phrases of a language
are found in two steps, by shares and then of what the shares have left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared, textvec

#: Least count of a phrase, most words, share of a phrase's count from which a longer one subsumes it, and rows for a language.
LEAST, LONGEST, SUBSUMED, TOP = 30, 4, 80, 2000
#: Words of a chunk at most, and bytes of text that a task gathers before it writes its chunks.
CHUNK, GATHERED = 1 << 19, 4 << 20
#: Rows of a batch of pairs.
SENT = 1 << 16
#: Shares of a language in the first step of the ranking.
SHARES = 256

WORD = np.ones(256, dtype=bool)
WORD[[0x20, 0x09]] = False
BREAK = np.zeros(256, dtype=bool)
BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
WORD[BREAK] = False

#: Bits of a bucket within its range: counts of a range are a table of 32 MB.
RANGE_BITS = 23

CHUNKS = "chunk bigint, own int, ids binary, names binary"
BUCKETS = "part int, steps binary, counts binary"
RESULT = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def tokenize(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of some texts, A-Z lower-cased, and whether each is the first of a piece."""
    buf, _ = textvec.flat(texts)
    start, end = textvec.word_bounds(buf, WORD)
    pieces = np.cumsum(BREAK[buf], dtype=np.int32)[start] if len(start) else np.zeros(0, dtype=np.int32)
    first = np.diff(pieces, prepend=-1) > 0
    off = np.concatenate([[0], np.cumsum(end - start)])
    data = textvec.LOWER[buf[WORD[buf]]]
    made = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(off.astype(np.int64)), pa.py_buffer(data))
    return made, first


def _rows(lang: str, words: list[pa.Array], first: list[np.ndarray], longest: int, most: int):
    """Chunks of a language: own, numbers of words with -1 before each piece, the words, and how often each stands at an own place."""
    encoded = pa.concat_arrays(words).dictionary_encode()
    numbers, first = encoded.indices.to_numpy(), np.concatenate(first)
    for at in range(0, len(numbers), most):
        to = min(at + most + longest - 1, len(numbers))
        part, lead = numbers[at:to], first[at:to]
        own = min(most, len(numbers) - at)
        used, ids = np.unique(part, return_inverse=True)
        n = np.bincount(ids[:own], minlength=len(used))
        place = np.flatnonzero(lead)
        own += int(np.searchsorted(place, own))  # marks before the own words
        yield lang, own, np.insert(ids, place, -1).astype(np.int32), encoded.dictionary.take(pa.array(used)), n


def _scanned(docs: DataFrame, text_col: str, lang_col: str, longest: int, most: int, emit, kind: str) -> DataFrame:
    """What emit makes of each chunk of the texts: (number, language, own, numbers of words, the words, their counts) to batches."""

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        held: dict[str, list] = {}
        size = 0

        def flush():
            nonlocal number
            for lang in sorted(held):
                for row in _rows(lang, *zip(*held[lang], strict=True), longest, most):
                    yield from emit(number, *row)
                    number += 1
            held.clear()

        for batch in batches:
            for part in textvec.slices(batch, 0):
                langs = part.column(1).dictionary_encode()
                for k, lang in enumerate(langs.dictionary.to_pylist()):
                    words, first = tokenize(part.column(0).filter(pa.array(langs.indices.to_numpy() == k)))
                    if len(words):
                        held.setdefault(lang, []).append((words, first))
                size += part.column(0).nbytes
                if size >= GATHERED:
                    yield from flush()
                    size = 0
                    pa.default_memory_pool().release_unused()
        yield from flush()

    d = docs.select(F.col(text_col).cast("string").alias("t"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("g"))
    return d.mapInArrow(run, kind)


def word_ids(lang: str, words: pa.Array, seed: int) -> np.ndarray:
    """64-bit ids of the words of a language, none of them negative; whether they are all different is checked over all words."""
    buf, off = textvec.flat(words)
    h = textvec.span_hashes(buf, off[:-1], off[1:] - 1)
    return (textvec.mix(h ^ np.uint64(textvec.word_hash(f"{seed}|{lang}"))) >> np.uint64(1)).astype(np.int64)


def _bucket_rows(kind: int, ids: np.ndarray, n: np.ndarray):
    """Counts by the upper 32 bits of ids, in rows by range: differences of the sorted buckets as planes of bytes, and counts up to 255."""
    if not len(ids):
        return
    bucket, at = np.unique(ids >> 31, return_inverse=True)
    n = np.minimum(np.bincount(at, weights=n), 255).astype(np.uint8)
    own = bucket >> RANGE_BITS
    cuts = np.flatnonzero(np.diff(own, prepend=-1))
    parts, low, counts = [], [], []
    for i, j in zip(cuts, [*cuts[1:], len(bucket)], strict=True):
        step = np.diff(bucket[i:j] & ((1 << RANGE_BITS) - 1), prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4)
        parts.append(int(own[i]) + (kind << (32 - RANGE_BITS)))
        low.append(step[:, :3].T.tobytes())
        counts.append(n[i:j].tobytes())
    yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(low, pa.binary()), pa.array(counts, pa.binary())], names=["part", "steps", "counts"])


def frequent_buckets(rows: DataFrame, least: int) -> DataFrame:
    """(kind, bucket) of counts that reach least; a table of fixed size for a range at a time."""

    def found(part, held):
        at = np.flatnonzero(held >= min(least, 255)) + ((part & ((1 << (32 - RANGE_BITS)) - 1)) << RANGE_BITS)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), part >> (32 - RANGE_BITS), np.int32)), pa.array(at.astype(np.int64))], names=["kind", "bucket"])

    def add(batches):
        now, held = None, None
        for batch in batches:
            for part, steps, counts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if part != now:
                    if now is not None:
                        yield found(now, held)
                    now, held = part, np.zeros(1 << RANGE_BITS, dtype=np.int32)
                step = np.frombuffer(steps.as_buffer(), dtype=np.uint8).reshape(3, -1).astype(np.int64)
                held[np.cumsum(step[0] + (step[1] << 8) + (step[2] << 16))] += np.frombuffer(counts.as_buffer(), dtype=np.uint8)
        if now is not None:
            yield found(now, held)

    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(add, "kind int, bucket bigint")


def text_buckets(docs: DataFrame, text_col: str, lang_col: str, seed: int, longest: int = LONGEST, most: int = CHUNK) -> DataFrame:
    """Counts by bucket of all words (kind 0) and of all pairs of words (kind 1)."""

    def emit(_, lang, own, ids, words, n):
        names = word_ids(lang, words, seed)
        yield from _bucket_rows(0, names, n)
        codes, _, _, n = _pairs(ids, max(len(names), 1), own)
        yield from _bucket_rows(1, pair_ids(names[codes // max(len(names), 1)], names[codes % max(len(names), 1)], seed), n)

    return _scanned(docs, text_col, lang_col, longest, most, emit, BUCKETS)


def _zero(x: np.ndarray) -> np.ndarray:
    return np.zeros(len(x), dtype=np.int64)


def word_counts(docs: DataFrame, text_col: str, lang_col: str, seed: int, packed: np.ndarray, longest: int = LONGEST, most: int = CHUNK) -> DataFrame:
    """(lang, word, id, n): words whose bucket may be in the filter; with null as the word, all words of each language."""

    def emit(_, lang, own, ids, words, n):
        names = word_ids(lang, words, seed)
        kept = np.flatnonzero(_held(packed, names >> 31, _zero(names)))
        word = pa.concat_arrays([words.take(pa.array(kept)).cast(pa.string()), pa.nulls(1, pa.string())])
        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(word), type=pa.string()), "word": word, "id": np.append(names[kept], -1), "n": np.append(n[kept], n.sum()).astype(np.int64)})

    found = _scanned(docs, text_col, lang_col, longest, most, emit, "lang string, word string, id bigint, n bigint")
    return found.groupBy("lang", "word", "id").agg(F.sum("n").alias("n"))


def _held(packed: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs may be in a filter."""
    hit = np.ones(len(a), dtype=bool)
    for place in _bits(a, b, len(packed) * 8):
        hit &= (packed[place >> 3] >> (place & 7)) & 1 == 1
    return hit


def _frequent_places(own: int, ids: np.ndarray, names: np.ndarray, packed: np.ndarray):
    """A chunk's places whose words may be frequent, as (own, ids, names)."""
    number = np.flatnonzero(_held(packed, names, np.zeros(len(names), dtype=np.int64)))
    return _renamed(ids, own, number, names[number], len(names))


def pair_ids(left: np.ndarray, right: np.ndarray, seed: int) -> np.ndarray:
    """64-bit ids of pairs of words, none of them negative; whether frequent ones are those of one pair is checked over all pairs."""
    h = textvec.mix(left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + textvec.mix(right.astype(np.uint64) + np.uint64(seed)))
    return (h >> np.uint64(1)).astype(np.int64)


def text_chunks(docs: DataFrame, text_col: str, lang_col: str, seed: int, words: np.ndarray, pairs: np.ndarray, longest: int = LONGEST, most: int = CHUNK) -> DataFrame:
    """Chunks of the places of pairs that may be frequent, with the ids of words."""

    def emit(number, lang, own, ids, names, n):
        own, ids, names = _frequent_places(own, ids, word_ids(lang, names, seed), words)
        own, ids, names = _paired_places(own, ids, names, pairs, seed)
        if len(names):
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([own], type=pa.int32()), pa.array([ids.astype(np.int32).tobytes()]), pa.array([names.tobytes()])], names=["chunk", "own", "ids", "names"])

    return _scanned(docs, text_col, lang_col, longest, most, emit, CHUNKS)


def _paired_places(own: int, ids: np.ndarray, names: np.ndarray, pairs: np.ndarray, seed: int):
    """The places of pairs whose bucket may be in the filter, those at a chunk's end that it doesn't own included."""
    width = max(len(names), 1)
    codes, at, which, _ = _pairs(ids, width, own)
    pair = pair_ids(names[codes // width], names[codes % width], seed) if len(codes) else codes
    hit = at[_held(pairs, pair >> 31, _zero(pair))[which]]
    keep = np.zeros(len(ids), dtype=bool)
    keep[hit] = keep[hit + 1] = True
    ids = np.where(keep, ids, -1)
    used = np.unique(ids[ids >= 0])
    return _renamed(ids, own, used, names[used], len(names))


def _pairs(ids: np.ndarray, width: int, own: int):
    """Distinct adjacent pairs of a chunk as codes, the places of all pairs, each place's number among the codes, and counts at own places."""
    at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
    codes, which = np.unique(ids[at].astype(np.int64) * width + ids[at + 1], return_inverse=True)
    return codes, at, which, np.bincount(which[at < own], minlength=len(codes))


def _renamed(ids: np.ndarray, own: int, number: np.ndarray, name: np.ndarray, size: int):
    """A chunk's places with a number among those that have a name; a run of places without one becomes one mark."""
    local = np.full(size + 1, -1, dtype=np.int32)
    local[number] = np.arange(len(number), dtype=np.int32)
    new = local[ids]
    keep = (new >= 0) | (np.concatenate([[0], new[:-1]]) >= 0)
    return int(np.count_nonzero(keep[:own])), new[keep], name


def _bits(a: np.ndarray, b: np.ndarray, bits: int) -> list[np.ndarray]:
    h = textvec.mix(a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + textvec.mix(b.astype(np.uint64) + np.uint64(1)))
    return [(h & np.uint64(bits - 1)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64)]


def _filter(names: DataFrame) -> np.ndarray:
    """A Bloom filter of pairs of integers, of bounded size, OR-ed on executors."""
    bits = min(max(shared.FILTER_BITS[0], 1 << (16 * names.count()).bit_length()), 1 << 26)

    def part(batches):
        held = np.zeros(bits, dtype=bool)
        for batch in batches:
            for place in _bits(batch.column(0).to_numpy(), batch.column(1).to_numpy(), bits):
                held[place] = True
        yield pa.RecordBatch.from_pydict({"packed": [np.packbits(held, bitorder="little").tobytes()]})

    def union(batches):
        held = np.zeros(bits // 8, dtype=np.uint8)
        for batch in batches:
            for packed in batch.column(0):
                held |= np.frombuffer(packed.as_buffer(), dtype=np.uint8)
        yield pa.RecordBatch.from_pydict({"packed": [held.tobytes()]})

    out = np.zeros(bits // 8, dtype=np.uint8)
    for row in names.coalesce(8).mapInArrow(part, "packed binary").mapInArrow(union, "packed binary").collect():
        out |= np.frombuffer(row[0], dtype=np.uint8)
    return out


def _chunk_pairs(batch, seed: int):
    """Of each chunk: its number, own, distinct adjacent pairs' left, right and id, and their counts, and (places, pairs' numbers there, places in all)."""
    for chunk, own, ids, names in zip(*[batch.column(k) for k in range(4)], strict=True):
        names, ids = np.frombuffer(names.as_buffer(), dtype=np.int64), np.frombuffer(ids.as_buffer(), dtype=np.int32)
        width = max(len(names), 1)
        codes, at, which, n = _pairs(ids, width, own.as_py())
        left, right = (names[codes // width], names[codes % width]) if len(codes) else (codes, codes)
        yield chunk.as_py(), own.as_py(), left, right, pair_ids(left, right, seed).astype(np.int64), n, (at, which, len(ids))


def pair_buckets(chunks: DataFrame, seed: int) -> DataFrame:
    """Counts by bucket of the adjacent pairs of chunks."""

    def run(batches):
        for batch in batches:
            for _, _, _, _, pair, n, _ in _chunk_pairs(batch, seed):
                yield from _bucket_rows(1, pair, n)

    return chunks.select("chunk", "own", "ids", "names").mapInArrow(run, BUCKETS)


def pair_counts(chunks: DataFrame, packed: np.ndarray, seed: int) -> DataFrame:
    """(left, right, id, a): the adjacent pairs of chunks whose bucket may be in the filter."""

    def run(batches):
        for batch in batches:
            for _, _, left, right, pair, n, _ in _chunk_pairs(batch, seed):
                kept = np.flatnonzero(_held(packed, pair >> 31, _zero(pair)))
                for at in range(0, len(kept), SENT):
                    s = kept[at : at + SENT]
                    yield pa.RecordBatch.from_pydict({"left": left[s], "right": right[s], "n": n[s].astype(np.int64)})

    def name(batches):
        for batch in batches:
            pair = pair_ids(batch.column(0).to_numpy(), batch.column(1).to_numpy(), seed)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pair), batch.column(2)], names=["left", "right", "id", "a"])

    found = chunks.select("chunk", "own", "ids", "names").mapInArrow(run, "left bigint, right bigint, n bigint")
    return found.groupBy("left", "right").agg(F.sum("n").alias("a")).mapInArrow(name, "left bigint, right bigint, id bigint, a bigint")


def rename(chunks: DataFrame, packed: np.ndarray, seed: int) -> DataFrame:
    """Chunks whose adjacent pairs, if they may be in the filter of frequent ones, are replaced by the pairs' ids; chunks without any go."""

    def run(batches):
        for batch in batches:
            for chunk, own, _, _, pair, _, (at, which, size) in _chunk_pairs(batch, seed):
                ids = np.full(size, -1, dtype=np.int32)
                ids[at] = which
                kept = np.flatnonzero(_held(packed, pair, _zero(pair)))
                own, ids, names = _renamed(ids, own, kept, pair[kept], len(pair))
                if len(names):
                    yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([own], type=pa.int32()), pa.array([ids.astype(np.int32).tobytes()]), pa.array([names.tobytes()])], names=["chunk", "own", "ids", "names"])

    return chunks.select("chunk", "own", "ids", "names").mapInArrow(run, CHUNKS)


def _grown(names: DataFrame, known: DataFrame) -> DataFrame:
    """Named pairs (id, left, right, a) with what their parents know: the phrase, and the counts of its first and of its last parts."""
    left = known.select(F.col("id").alias("left"), "lang", "phrase", "firsts")
    right = known.select(F.col("id").alias("right"), "last", "lasts")
    both = names.join(left, "left").join(right, "right")
    return both.select("id", "lang", "a", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", F.concat("firsts", F.array("a")).alias("firsts"), F.concat("lasts", F.array("a")).alias("lasts"))


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, most: int = CHUNK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, lang, phrase, k, a, firsts, lasts) of all frequent phrases; (id, child), the count of their most frequent child; (lang, n).

    firsts[k] and lasts[k] are the counts of a phrase's first and last k words.
    """
    seed, found = 0, None
    while found is None:  # two words or phrases have one id: all get others
        seed += 1
        found = _phrases(docs, text_col, lang_col, seed, least, longest, most)
    return found


def _phrases(docs: DataFrame, text_col: str, lang_col: str, seed: int, least: int, longest: int, most: int) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    where, end = (docs, text_col, lang_col, seed), (longest, most)
    buckets = shared.settle(frequent_buckets(text_buckets(*where, *end), least), "phrase-buckets")
    shared.release(docs.sparkSession)
    packed, pairs = (_filter(buckets.filter(F.col("kind") == kind).select("bucket", F.lit(0).cast("long"))) for kind in (0, 1))
    shared.discard(buckets)
    words = shared.settle(word_counts(*where, packed, *end), "phrase-words")
    known = words.filter("word is not null")
    if known.agg(F.count("*") > F.count_distinct("id")).first()[0]:
        shared.discard(words)
        return None
    totals = words.filter("word is null").select("lang", "n")
    known = known.filter(F.col("n") >= least).select("id", "lang", F.col("n").alias("a"), F.col("word").alias("phrase"), F.col("word").alias("last"), F.array("n").alias("firsts"), F.array("n").alias("lasts"))
    chunks = shared.settle(text_chunks(*where, _filter(known.select("id", F.lit(0).cast("long"))), pairs, *end), "phrase-chunks")
    found, children = [], []
    for k in range(2, longest + 1):
        if k > 2:
            buckets = shared.settle(frequent_buckets(pair_buckets(chunks, seed), least), "phrase-buckets")
            pairs = _filter(buckets.select("bucket", F.lit(0).cast("long")))
            shared.discard(buckets)
        names = shared.settle(pair_counts(chunks, pairs, seed), "phrase-names")
        shared.release(docs.sparkSession)
        if not names.groupBy("id").agg(F.count("*").alias("n"), F.max("a").alias("a")).filter((F.col("n") > 1) & (F.col("a") >= least)).isEmpty():
            shared.discard(names, chunks)
            return None
        names = names.filter(F.col("a") >= least)
        children.append(names.select(F.col("left").alias("id"), "a").unionByName(names.select(F.col("right").alias("id"), "a")).groupBy("id").agg(F.max("a").alias("child")).withColumn("k", F.lit(k - 1)))
        known = shared.settle(_grown(names, known), "phrase-known")
        found.append(known.withColumn("k", F.lit(k)))
        if k < longest:
            old, chunks = chunks, shared.settle(rename(chunks, _filter(names.select("id", F.lit(0).cast("long"))), seed), "phrase-chunks")
            shared.discard(old)
    shared.discard(chunks)
    phrases, best = found[0], children[0]
    for more in found[1:]:
        phrases = phrases.unionByName(more)
    for more in children[1:]:
        best = best.unionByName(more)
    return phrases, best, totals


def _first(rows: DataFrame, by: list, order: list, top: int, name: str) -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= top)


def mine_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, subsumed: int = SUBSUMED, top: int = TOP, most: int = CHUNK) -> DataFrame:
    """The first phrases of each language by score, with their rank and the counts of the phrase and of the parts at its lowest cut."""
    phrases, best, totals = frequent_phrases(docs, text_col, lang_col, least, longest, most)
    kept = phrases.join(best, ["id", "k"], "left").filter(F.col("child").isNull() | (F.col("child").cast("decimal(38,0)") * 100 < F.col("a").cast("decimal(38,0)") * subsumed))
    cut = """array_min(transform(sequence(1, k - 1), i -> struct(
        (cast(a as decimal(20,0)) * cast(2000000 as decimal(7,0))) div (cast(firsts[i - 1] as decimal(20,0)) + cast(lasts[k - i - 1] as decimal(20,0))) as score,
        i as i, firsts[i - 1] as l, lasts[k - i - 1] as r)))"""
    scored = kept.withColumn("cut", F.expr(cut)).select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(SHARES)).alias("share")
    near = _first(scored.select("*", share), ["lang", "share"], order, top, "place").drop("place", "share")
    return _first(near, ["lang"], order, top, "rank").join(totals, "lang").withColumn("rank", F.col("rank").cast("long")).select(*RESULT)


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(shared.table(spark, sf_dir, "documents"))


#: All phrases of up to LONGEST words by their text, and subsumption by all parts of all longer ones.
ORACLE = rf"""
with p as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from p),
g as (select lang, ws, unnest(range(1, len(ws) + 1)) as i from w),
f as (select lang, k, ws[i : i + k - 1] as ph, count(*) as a from g, range(1, {LONGEST + 1}) t(k) where i + k - 1 <= len(ws) group by all),
n as (select lang, sum(a)::bigint as n from f where k = 1 group by lang),
c as (select * from f where k > 1 and a >= {LEAST}),
sub as (select lang, ph[i : i + j - 1] as ph, max(a) as longer from (select *, unnest(range(1, k + 1)) as i from c) x, range(2, {LONGEST}) t(j) where j < k and i + j - 1 <= k group by all),
kept as (select c.* from c left join sub using (lang, ph) where longer is null or 100 * longer < {SUBSUMED} * a),
cut as (select lang, ph, k, a, unnest(range(1, k)) as i from kept),
scored as (
  select cut.lang, cut.ph, cut.a, x.a as l, y.a as r, i, (2000000::hugeint * cut.a) // (x.a + y.a) as score
  from cut join f x on x.lang = cut.lang and x.ph = cut.ph[1 : i] join f y on y.lang = cut.lang and y.ph = cut.ph[i + 1 : cut.k]),
low as (select lang, array_to_string(ph, ' ') as phrase, a, arg_min((l, r, score), (score, i)) as m from scored group by lang, ph, a),
ranked as (select lang, row_number() over (partition by lang order by m[3] desc, a desc, encode(phrase)) as rank, phrase, a, m[1] as l, m[2] as r, m[3]::bigint as score from low)
select lang, rank, phrase, a, l, r, n, score from ranked join n using (lang) where rank <= {TOP}"""
