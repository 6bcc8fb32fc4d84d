"""Operator 6, toxicity: a convolutional text classifier trained in numpy.

Method. A word is the sum of embeddings found by hash: of the whole word and of its first 4, 5, 6 and 7 bytes, so that
inflected and compounded forms share what they have in common. Filters of widths 1, 2 and 3 run over the words of a
whole text; each filter's largest response is pooled, and a logistic layer gives the logit. The threshold on the logit
is calibrated for each language, which is guessed from the text alone by its letters; the score is the logistic function
of the logit's distance from that threshold, so that 0.5 is the threshold in every language.

Training. The embeddings' vocabulary, the filters and the thresholds are fitted on a bounded sample of labelled rows that
aren't held out: at most PER_CLASS ids of each label, those whose hashes come first, each with one whole text, and of these
as many as have SAMPLE_BYTES of text together; a text of more than LONGEST bytes isn't trained on. Hash keys are checked,
so that a word that was never seen has no embedding at all.

Defined results. Null and empty text: the score of a text without words, below 0.5. Repeated rows: equal scores; of rows that
repeat an id, the text of the least hash is trained on. An id labelled both ways counts as toxic. Without labels of both
kinds: score 0 for all. Null ids aren't held out and aren't trained on. Extra columns aren't read, whatever their names.

Scale: one scan for the sample, one for the scores, no shuffle of text but the sample's; what reaches the driver has a fixed
bound, as has the model.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared, textvec

PER_CLASS = {0: 1600, 1: 900}
SAMPLE_BYTES, LONGEST = 6_000_000, 200_000
AFFIXES = (4, 5, 6, 7)
WIDTHS = (1, 2, 3)
DIM, FILTERS = 8, 8
SLOTS = 1 << 18
VOCABULARY = 32_768
LEAST_Z = 3.5
EPOCHS, BATCH, RATE = 14, 64, 0.08


@dataclass
class Model:
    keys: np.ndarray  # (SLOTS,) hash of the feature in each slot
    ids: np.ndarray  # (SLOTS,) its row of the embeddings; 0: none
    emb: np.ndarray  # (features + 1, DIM); row 0 is zero
    conv: list[np.ndarray]  # for each width (width, DIM, FILTERS)
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    letters: np.ndarray  # (languages, 256) log-probabilities
    shift: np.ndarray  # threshold of each language


def features(w: textvec.Words) -> np.ndarray:
    """(words, 5) hashes of each word's features; 0: none."""
    return np.stack([w.hash, *(w.affix[k] for k in AFFIXES)], axis=1)


def look_up(model: Model, f: np.ndarray) -> np.ndarray:
    slot = (f >> np.uint64(46)).astype(np.int32)
    return np.where(model.keys[slot] == f, model.ids[slot], np.int32(0))


def embed(model: Model, ids: np.ndarray) -> np.ndarray:
    x = model.emb[ids[:, 0]]
    for k in range(1, ids.shape[1]):
        x += model.emb[ids[:, k]]
    return x


def responses(x: np.ndarray, conv: np.ndarray, bias: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rectified responses of the filters of a width at each word; 0 where the filter would reach into the next text."""
    width, n = len(conv), len(x)
    y = x @ conv[0]
    for k in range(1, width):
        y[: n - k] += x[k:] @ conv[k]
    y += bias
    np.maximum(y, 0, out=y)
    for k in range(1, width):
        last = first[1:] - k
        last = last[(last >= first[:-1]) & (last < n)]
        y[last] = 0
    return y


def pool(y: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = np.zeros((len(first) - 1, y.shape[1]), dtype=np.float32)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        out[some] = np.maximum.reduceat(y, first[some], axis=0)
    return out


def logits(model: Model, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    x = embed(model, ids)
    pooled = np.concatenate([pool(responses(x, c, b, first), first) for c, b in zip(model.conv, model.bias, strict=True)], axis=1)
    return pooled @ model.out + model.out_bias


def letter_counts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(texts, 256) counts of letter bytes, A-Z as a-z."""
    n = len(off) - 1
    out = np.zeros((n, 256), dtype=np.float32)
    low = textvec.LOWER[buf]
    for i in range(n):
        out[i] = np.bincount(low[off[i] : off[i + 1]], minlength=256)
    out[:, ~textvec.LETTERS] = 0
    return out


def _fit_vocabulary(docs: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features whose document frequency differs most between the labels, and how: (hashes, z)."""
    seen = [np.unique(d) for d in docs]
    f, n = np.unique(np.concatenate(seen), return_counts=True)
    pos = [s for s, t in zip(seen, y, strict=True) if t]
    g, m = np.unique(np.concatenate(pos), return_counts=True)
    hits = np.zeros(len(f))
    hits[np.searchsorted(f, g)] = m
    rate = y.mean()
    z = (hits - n * rate) / np.sqrt(n * rate * (1 - rate) + 1)
    keep = np.flatnonzero((np.abs(z) >= LEAST_Z) & (n >= 3) & (f != 0))
    keep = keep[np.argsort(-np.abs(z[keep]), kind="stable")][:VOCABULARY]
    return f[keep], z[keep]


def train(docs: list[np.ndarray], y: np.ndarray, counts: np.ndarray, langs: np.ndarray, seed: int = 7) -> Model:
    """docs: features of each text's words, emptied here; y: 0 or 1; counts: letters of each text; langs: a language number each, or -1."""
    rng = np.random.default_rng(seed)
    tune = rng.permutation(len(docs)) % 4 == 0  # the rest fits the weights, these the thresholds
    fit = np.flatnonzero(~tune)
    vocab, z = _fit_vocabulary([docs[i] for i in fit], y[fit])
    keys, ids = np.zeros(SLOTS, dtype=np.uint64), np.zeros(SLOTS, dtype=np.int32)
    slot = (vocab >> np.uint64(46)).astype(np.int64)
    for i in range(len(vocab) - 1, -1, -1):  # the strongest feature of a slot stays
        keys[slot[i]], ids[slot[i]] = vocab[i], i + 1
    emb = rng.normal(0, 0.02, (len(vocab) + 1, DIM)).astype(np.float32)
    emb[1:, 0] += np.clip(z / 10, -1.5, 1.5)
    emb[0] = 0
    conv = [rng.normal(0, 0.1, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for c in conv:
        c[0, 0, :] += np.linspace(0.3, 1.0, FILTERS)
    bias = [np.full(FILTERS, -0.1, dtype=np.float32) for _ in WIDTHS]
    model = Model(keys, ids, emb, conv, bias, rng.normal(0.3, 0.05, FILTERS * len(WIDTHS)).astype(np.float32), -1.0, np.zeros((1, 256)), np.zeros(1))

    found = [look_up(model, d) for d in docs]
    docs.clear()
    squares: dict[str, np.ndarray] = {}

    def step(name: str, value: np.ndarray, grad: np.ndarray) -> None:
        s = squares.setdefault(name, np.full(value.shape, 1e-3, dtype=np.float32))
        s += grad * grad
        value -= RATE * grad / np.sqrt(s)

    for _ in range(EPOCHS):
        order = rng.permutation(fit)
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            first = np.concatenate([[0], np.cumsum([len(found[i]) for i in rows])])
            idx = np.concatenate([found[i] for i in rows])
            x = embed(model, idx)
            acts = [responses(x, c, b, first) for c, b in zip(model.conv, model.bias, strict=True)]
            pooled = np.concatenate([pool(a, first) for a in acts], axis=1)
            p = 1 / (1 + np.exp(-(pooled @ model.out + model.out_bias)))
            d = ((p - y[rows]) / len(rows)).astype(np.float32)
            dpool = d[:, None] * model.out[None, :]
            step("out", model.out, pooled.T @ d + 1e-4 * model.out)
            model.out_bias -= RATE * float(d.sum())
            demb: dict[str, np.ndarray] = {"e": np.zeros_like(model.emb)}
            for k, (c, a) in enumerate(zip(model.conv, acts, strict=True)):
                dc, db = np.zeros_like(c), np.zeros(FILTERS, dtype=np.float32)
                for r in range(len(rows)):
                    if first[r] == first[r + 1]:
                        continue
                    best = a[first[r] : first[r + 1]].argmax(axis=0) + first[r]
                    for f in np.flatnonzero(pooled[r, k * FILTERS : (k + 1) * FILTERS] > 0):
                        g = dpool[r, k * FILTERS + f]
                        db[f] += g
                        for j in range(len(c)):
                            dc[j, :, f] += g * x[best[f] + j]
                            demb["e"][idx[best[f] + j]] += g * c[j, :, f]
                step(f"conv{k}", c, dc + 1e-4 * c)
                step(f"bias{k}", model.bias[k], db)
            demb["e"][0] = 0
            step("emb", model.emb, demb["e"])
    _calibrate(model, found, y, counts, langs, np.flatnonzero(tune))
    return model


def _best_threshold(score: np.ndarray, y: np.ndarray) -> float:
    """The logit between two neighbours at which F1 is largest."""
    order = np.argsort(-score, kind="stable")
    s, t = score[order], y[order]
    tp = np.cumsum(t)
    f1 = 2 * tp / (np.arange(1, len(s) + 1) + t.sum())
    k = int(np.argmax(f1))
    return float(s[k] if k + 1 == len(s) else (s[k] + s[k + 1]) / 2)


def _calibrate(model: Model, found, y, counts, langs, rows) -> None:
    names = np.unique(langs[langs >= 0])
    if len(names):
        sums = np.stack([counts[langs == n].sum(axis=0) for n in names]) + 1.0
        sums[:, ~textvec.LETTERS] = 1.0
        model.letters = np.log(sums / sums.sum(axis=1, keepdims=True))
    first = np.concatenate([[0], np.cumsum([len(found[i]) for i in rows])])
    score = logits(model, np.concatenate([found[i] for i in rows]), first)
    guess = (counts[rows] @ model.letters.T).argmax(axis=1)
    every = _best_threshold(score, y[rows]) if y[rows].any() else 0.0
    model.shift = np.full(len(model.letters), every)
    for n in range(len(model.letters)):
        own = guess == n
        if y[rows][own].sum() >= 8 and own.sum() >= 40:
            model.shift[n] = 0.5 * every + 0.5 * _best_threshold(score[own], y[rows][own])


def score_texts(model: Model, texts: pa.Array) -> np.ndarray:
    buf, off = textvec.flat(texts)
    w = textvec.words(buf, off, textvec.LETTERS, AFFIXES)
    z = logits(model, look_up(model, features(w)), w.first)
    guess = (letter_counts(buf, off) @ model.letters.T).argmax(axis=1)
    return 1 / (1 + np.exp(-np.clip(z - model.shift[guess], -30, 30)))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, toxic, lang, text): the bounded sample of labelled rows that aren't held out."""
    known = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic")).filter("id is not null and toxic in (0, 1)").filter(~held_out(F.col("id"))).groupBy("id").agg(F.max("toxic").alias("toxic"))
    chosen = shared.first_by_hash(known, "toxic", "id", max(PER_CLASS.values()))
    # At most the sum of PER_CLASS rows of two numbers: a proven bound.
    chosen = chosen.filter(F.col("n") <= F.when(F.col("toxic") == 1, PER_CLASS[1]).otherwise(PER_CLASS[0])).select("id", "toxic")
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").alias("id"), lang.alias("lang"), text.alias("text")).filter(F.octet_length("text") <= LONGEST).join(F.broadcast(chosen), "id")
    one = rows.groupBy("id").agg(F.max("toxic").alias("toxic"), F.min(F.struct(F.xxhash64("text").alias("hash"), "text", "lang")).alias("one"))
    so_far = F.sum(F.octet_length("one.text")).over(Window.orderBy(F.xxhash64("id"), "id"))
    return one.withColumn("bytes", so_far).filter(F.col("bytes") <= SAMPLE_BYTES).select("id", "toxic", "one.lang", "one.text")


def profiles(rows: DataFrame) -> DataFrame:
    """(id, toxic, lang, f, c): features of each text's words and its letters. Features are forty bytes a word, so they travel
    compressed: the driver's JVM holds several copies of what it collects."""

    def profile(batches):
        for batch in batches:
            for part in textvec.slices(batch, 3):
                buf, off = textvec.flat(part.column(3))
                w = textvec.words(buf, off, textvec.LETTERS, AFFIXES)
                f, c = features(w), letter_counts(buf, off)
                yield pa.RecordBatch.from_arrays(
                    [part.column(k) for k in range(3)] + [pa.array([zlib.compress(f[a:b].tobytes(), 1) for a, b in zip(w.first, w.first[1:], strict=False)], pa.binary()), pa.array([x.tobytes() for x in c], pa.binary())],
                    names=["id", "toxic", "lang", "f", "c"],
                )

    return rows.mapInArrow(profile, f"id {rows.schema[0].dataType.simpleString()}, toxic int, lang string, f binary, c binary")


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Trains on the bounded sample; None without rows of both labels."""
    got = sorted(profiles(sample(docs, labels)).collect(), key=lambda r: r["id"])
    y = np.array([r["toxic"] for r in got], dtype=np.float32)
    if not y.any() or y.all() or len(y) < 8:
        return None
    names = sorted({r["lang"] for r in got if r["lang"] is not None})
    langs = np.array([names.index(r["lang"]) if r["lang"] is not None else -1 for r in got])
    docs_f = [np.frombuffer(zlib.decompress(r["f"]), dtype=np.uint64).reshape(-1, 1 + len(AFFIXES)) for r in got]
    counts = np.stack([np.frombuffer(r["c"], dtype=np.float32) for r in got])
    got.clear()
    return train(docs_f, y, counts, langs)


def score_column(spark: SparkSession, model: Model | None, text) -> F.Column:
    """The score of a text column, in whole Arrow batches; other columns stay in the JVM."""
    held = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        out = [np.zeros(0)]
        for part in textvec.slices(pa.RecordBatch.from_arrays([texts], names=["t"]), 0):
            out.append(score_texts(held.value, part.column(0)) if held.value is not None else np.zeros(part.num_rows))
        return pa.array(np.concatenate(out), pa.float64())

    return score(text.cast("string"))


def classify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every row."""
    d = docs.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), score_column(docs.sparkSession, model, F.col(text_col)).alias("score"))
    return d.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    return classify(docs, fit(docs, shared.table(spark, sf_dir, "labels")))
