"""Operator 5, language identification: a linear-chain conditional random field over words.

Method. Every run of letters is a word. Its emission weights are sums over features: its entry in a learned lexicon, its
first and last two and three bytes (affixes), and its byte trigrams; neighbouring words are tied by learned transitions.
Forward-backward over all words of a text gives each word a probability for each language, so that a text that switches
language is labelled word by word; a text's language is the one with the largest mean probability, which is its score.

Training (in numpy, by gradient ascent on the conditional likelihood) uses a bounded sample of whole texts: for each language
at most PER_LANG ids that aren't held out, those whose hashes come first, and of these as many as have LANG_BYTES of text
together; a text of more than LONGEST bytes isn't trained on. Training sequences splice runs of different languages, from which
transitions are learned.

Defined results. Null text, or one without a letter: `und`, score 0. No labelled row at all: `und` for every text.
Repeated rows: equal results; of rows that repeat an id and a language, the text of the least hash is trained on. Null ids
aren't held out and aren't trained on. Extra columns aren't read, whatever their names.

Scale: two scans (the first reads ids and labels only for the choice of the sample), no shuffle of text but the sample's, a
model of fixed size for each language.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared, textvec

PER_LANG, LANG_BYTES, LONGEST = 400, 600_000, 100_000
AFFIXES = (2, 3, -2, -3)
AFFIX_ROWS, TRIGRAM_ROWS, LEXICON, SLOTS = 1 << 15, 1 << 14, 20_000, 1 << 17
SEQUENCES, LENGTH, EPOCHS, BATCH, RATE = 4000, 40, 4, 100, 0.15
PIECE = 1 << 18
SLICE = 4 << 20


@dataclass
class Model:
    langs: list[str]
    keys: np.ndarray
    ids: np.ndarray
    lexicon: np.ndarray  # (words + 1, languages); row 0 stays zero
    affix: np.ndarray
    trigram: np.ndarray
    trans: np.ndarray  # (languages, languages), logits
    start: np.ndarray


def _trigram_ids(low: np.ndarray) -> np.ndarray:
    x = low.astype(np.uint32)
    return ((x[:-2] * 2654435761 + x[1:-1] * 40503 * 65537 + x[2:] * 2246822519) >> 7) % TRIGRAM_ROWS


def _word_rows(model: Model, w: textvec.Words, at: slice) -> tuple[np.ndarray, list[np.ndarray]]:
    h = w.hash[at]
    slot = (h >> np.uint64(47)).astype(np.int64)
    return np.where(model.keys[slot] == h, model.ids[slot], 0), [(w.affix[k][at] >> np.uint64(49)).astype(np.int64) for k in AFFIXES]


def emissions(model: Model, buf: np.ndarray, w: textvec.Words) -> np.ndarray:
    """(words, languages) weights."""
    out = np.zeros((len(w.start), len(model.langs)), dtype=np.float32)
    at = 0
    while at < len(w.start):
        to = max(at + 1, int(np.searchsorted(w.end, w.start[at] + PIECE)))
        lex, aff = _word_rows(model, w, slice(at, to))
        e = model.lexicon[lex]
        for a in aff:
            e += model.affix[a]
        low = w.start[at]
        s, t = w.start[at:to] - low, w.end[at:to] - low - 2
        own = np.flatnonzero(t > s)
        if len(own):
            g = model.trigram[_trigram_ids(textvec.LOWER[buf[low : w.end[to - 1] + 2] if w.end[to - 1] + 2 <= len(buf) else np.append(buf[low:], [10, 10])])]
            e[own] += np.add.reduceat(g, np.stack([s[own], t[own]], axis=1).ravel(), axis=0)[::2]
        out[at:to] = e
        at = to
    return out


def posteriors(emit: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Forward-backward of all texts at once: step t takes the t-th word of every text that has one. (words, languages)."""
    n_lang, size = emit.shape[1], np.diff(first)
    order = np.argsort(-size, kind="stable")
    longest = int(size.max(initial=0))
    if not longest:
        return np.zeros((0, n_lang), dtype=np.float32)
    live = len(size) - np.searchsorted(np.sort(size), np.arange(longest), side="right")  # texts with more than t words
    block = np.concatenate([[0], np.cumsum(live)])
    rank = np.empty(len(size), dtype=np.int64)
    rank[order] = np.arange(len(size))
    text = textvec.owner(first)
    where = block[np.arange(len(emit)) - first[text]] + rank[text]
    e = np.empty_like(emit)
    e[where] = np.exp(emit - emit.max(axis=1, keepdims=True))
    move = np.exp(trans - trans.max()).astype(np.float32)
    alpha = np.empty_like(e)
    a = e[: live[0]] * np.exp(start - start.max()).astype(np.float32)
    a /= a.sum(axis=1, keepdims=True)
    alpha[: live[0]] = a
    for t in range(1, longest):
        a = (a[: live[t]] @ move) * e[block[t] : block[t + 1]]
        a /= a.sum(axis=1, keepdims=True)
        alpha[block[t] : block[t + 1]] = a
    back = np.ones((live[longest - 1], n_lang), dtype=np.float32)
    for t in range(longest - 2, -1, -1):
        b = np.ones((live[t], n_lang), dtype=np.float32)
        later = (back * e[block[t + 1] : block[t + 2]]) @ move.T
        b[: live[t + 1]] = later / later.sum(axis=1, keepdims=True)
        alpha[block[t] : block[t + 1]] *= b
        back = b
    alpha /= alpha.sum(axis=1, keepdims=True)
    return alpha[where]


def train(texts: list[bytes], langs: list[str], seed: int = 11) -> Model | None:
    """langs: the language of each text."""
    names = sorted(set(langs))
    if not names:
        return None
    n_lang, rng = len(names), np.random.default_rng(seed)
    buf, off = textvec.flat(pa.array(texts, pa.binary()))
    w = textvec.words(buf, off, textvec.LETTERS, AFFIXES)
    word_lang = np.array([names.index(x) for x in langs])[textvec.owner(w.first)]
    if not len(w.hash):
        return None
    seen, inverse, n = np.unique(w.hash, return_inverse=True, return_counts=True)
    common = np.argsort(-n, kind="stable")[:LEXICON]
    common = common[n[common] >= 4]
    keys, ids = np.zeros(SLOTS, dtype=np.uint64), np.zeros(SLOTS, dtype=np.int32)
    for i in range(len(common) - 1, -1, -1):
        slot = int(seen[common[i]] >> np.uint64(47))
        keys[slot], ids[slot] = seen[common[i]], i + 1
    f32 = np.float32
    model = Model(names, keys, ids, np.zeros((len(common) + 1, n_lang), f32), np.zeros((AFFIX_ROWS, n_lang), f32), np.zeros((TRIGRAM_ROWS, n_lang), f32), np.zeros((n_lang, n_lang), f32), np.zeros(n_lang, f32))
    if n_lang == 1:
        return model
    lex, aff = _word_rows(model, w, slice(None))
    tri = _trigram_ids(np.append(textvec.LOWER[buf], [10, 10]).astype(np.uint8))
    count = np.maximum(w.end - w.start - 2, 0)
    tri_first = np.concatenate([[0], np.cumsum(count)])
    tri_ids = tri[np.repeat(w.start - tri_first[:-1], count) + np.arange(tri_first[-1])]
    pools = [np.flatnonzero(word_lang == k) for k in range(n_lang)]
    squares = {k: np.full(getattr(model, k).shape, 1e-2, f32) for k in ("lexicon", "affix", "trigram", "trans", "start")}

    def step(name: str, grad: np.ndarray) -> None:
        value = getattr(model, name)
        grad = grad.astype(f32) + 1e-5 * value
        squares[name] += grad * grad
        value -= RATE * grad / np.sqrt(squares[name])

    def sequences(number: int) -> np.ndarray:
        """Word numbers: one to three runs of running words of a language each."""
        out = np.empty((number, LENGTH), dtype=np.int64)
        for r in range(number):
            cuts = np.sort(rng.integers(1, LENGTH, size=rng.integers(0, 3)))
            for a, b in zip([0, *cuts], [*cuts, LENGTH], strict=True):
                pool = pools[rng.integers(n_lang)]
                out[r, a:b] = pool[(rng.integers(len(pool)) + np.arange(b - a)) % len(pool)]
        return out

    for _ in range(EPOCHS):
        every = sequences(SEQUENCES)
        for at in range(0, SEQUENCES, BATCH):
            idx = every[at : at + BATCH].ravel()
            gold = word_lang[idx]
            size = tri_first[idx + 1] - tri_first[idx]
            k = np.repeat(np.arange(len(idx)), size)
            t = tri_ids[np.repeat(tri_first[idx] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())]
            emit = model.lexicon[lex[idx]] + sum(model.affix[a[idx]] for a in aff)
            for lang in range(n_lang):
                emit[:, lang] += np.bincount(k, weights=model.trigram[t, lang], minlength=len(idx))
            delta, dtrans, dstart = _gradient(emit.reshape(BATCH, LENGTH, n_lang), gold.reshape(BATCH, LENGTH), model.trans, model.start)
            delta = delta.reshape(-1, n_lang)
            glex, gaff, gtri = np.zeros_like(model.lexicon), np.zeros_like(model.affix), np.zeros_like(model.trigram)
            for lang in range(n_lang):
                glex[:, lang] = np.bincount(lex[idx], weights=delta[:, lang], minlength=len(glex))
                for a in aff:
                    gaff[:, lang] += np.bincount(a[idx], weights=delta[:, lang], minlength=AFFIX_ROWS)
                gtri[:, lang] = np.bincount(t, weights=delta[k, lang], minlength=TRIGRAM_ROWS)
            glex[0] = 0
            for name, g in (("lexicon", glex), ("affix", gaff), ("trigram", gtri), ("trans", dtrans), ("start", dstart)):
                step(name, g / BATCH)
    return model


def _gradient(emit: np.ndarray, gold: np.ndarray, trans: np.ndarray, start: np.ndarray):
    """Of the negative log-likelihood of equally long sequences: for emissions, transitions and starts."""
    n, length, n_lang = emit.shape
    e = np.exp(emit - emit.max(axis=2, keepdims=True))
    move = np.exp(trans - trans.max())
    alpha, beta = np.empty_like(e), np.ones_like(e)
    a = e[:, 0] * np.exp(start - start.max())
    alpha[:, 0] = a / a.sum(axis=1, keepdims=True)
    for t in range(1, length):
        a = (alpha[:, t - 1] @ move) * e[:, t]
        alpha[:, t] = a / a.sum(axis=1, keepdims=True)
    for t in range(length - 2, -1, -1):
        b = (beta[:, t + 1] * e[:, t + 1]) @ move.T
        beta[:, t] = b / b.sum(axis=1, keepdims=True)
    post = alpha * beta
    post /= post.sum(axis=2, keepdims=True)
    pair = alpha[:, :-1, :, None] * move[None, None] * (e[:, 1:] * beta[:, 1:])[:, :, None, :]
    pair /= pair.sum(axis=(2, 3), keepdims=True)
    dtrans = pair.sum(axis=(0, 1))
    np.subtract.at(dtrans, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
    hot = np.eye(n_lang, dtype=emit.dtype)[gold]
    return post - hot, dtrans, (post[:, 0] - hot[:, 0]).sum(axis=0)


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame) -> DataFrame:
    """(lang, text): the bounded sample of rows that aren't held out."""
    rows = docs.select(F.col("doc_id").alias("id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).filter("id is not null and lang is not null").filter(~held_out(F.col("id")))
    # At most PER_LANG ids of each language: as bounded as the model.
    chosen = shared.first_by_hash(rows.select("lang", "id"), "lang", "id", PER_LANG).select("lang", "id")
    one = rows.filter(F.octet_length("text") <= LONGEST).join(F.broadcast(chosen), ["lang", "id"]).groupBy("lang", "id").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("one"))
    so_far = F.sum(F.octet_length("one.text")).over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    return one.withColumn("bytes", so_far).filter(F.col("bytes") <= LANG_BYTES).select("lang", "one.text")


def fit(docs: DataFrame) -> Model | None:
    """Trains on the bounded sample of rows that aren't held out."""
    got = sorted((r["lang"], r["text"].encode("utf-8", "surrogatepass")) for r in sample(docs).collect())
    return train([x for _, x in got], [x for x, _ in got])


def label_words(model: Model, texts: pa.Array) -> tuple[np.ndarray, textvec.Words]:
    """Each word's probabilities."""
    buf, off = textvec.flat(texts)
    w = textvec.words(buf, off, textvec.LETTERS, AFFIXES)
    return posteriors(emissions(model, buf, w), w.first, model.trans, model.start), w


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, n_words, switches) of every row; switches: neighbouring words of different languages."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double,n_words:bigint,switches:bigint>")
    def label(texts: pa.Array) -> pa.Array:
        m, cols = held.value, ([], [], [], [])
        for part in textvec.slices(pa.RecordBatch.from_arrays([texts], names=["t"]), 0, SLICE):
            n = part.num_rows
            langs, score, count, switches = ["und"] * n, np.zeros(n), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
            if m is not None:
                p, w = label_words(m, part.column(0))
                count = np.diff(w.first)
                some = np.flatnonzero(count)
                if len(some):
                    mean = np.add.reduceat(p, w.first[some], axis=0, dtype=np.float64) / count[some, None]
                    best = mean.argmax(axis=1)
                    score[some] = np.clip(mean[np.arange(len(some)), best], 0, 1)
                    for i, k in zip(some.tolist(), best.tolist(), strict=True):
                        langs[i] = m.langs[k]
                    own = p.argmax(axis=1)
                    change = np.concatenate([[0], np.cumsum(own[1:] != own[:-1])])
                    switches[some] = change[w.first[some + 1] - 1] - change[w.first[some]]
            for c, x in zip(cols, (langs, score, count, switches), strict=True):
                c.extend(x)
        kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64())
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["lang_pred", "score", "n_words", "switches"])

    # Texts without a letter (in the sense of Unicode) have no language.
    text = F.col(text_col).cast("string")
    d = docs.select(F.col(id_col), label(F.when(text.rlike(r"\p{L}"), text)).alias("r"))
    return d.select(id_col, "r.*")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    out = identify(docs, fit(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "n_words", "switches")
