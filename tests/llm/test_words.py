"""Operators 11 to 13 against brute force and SQL, and on odd inputs."""

import glob
import hashlib
import os
import random
import re
from collections import Counter
from zlib import crc32

import duckdb
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import collocations, merkle, spelling

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"w{i % 977}" for i in range(60_000))
ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, "One two", "en", None, 7), (5, LONG, "en", "b", len(LONG)), (5, LONG, "en", "b", len(LONG)), (None, "text without an id", "en", "b", 18), (6, "é ß 漢字 \U0001f600", "de", "b", 8)]
CLASH = ["score", "n", "t", "k", "i", "h", "range", "tail", "word", "form", "chunk", "id", "rank", "phrase"]
SMALL = "/root/testdata/sf0.001"


def odd(spark):
    return spark.createDataFrame(ODD, DOCS).select("*", *[F.lit("x").alias(c) for c in CLASH])


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


def same_as_sql(df, sql):
    con = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    want = con.sql(sql)
    names = sorted(want.columns)
    rows = con.sql(f"select {', '.join(names)} from ({sql}) q").fetchall()
    assert sorted(df.columns) == names
    return Counter(tuple(r) for r in df.select(*names).collect()) == Counter(rows) and rows


# ---- 11


def phrases_of(docs, least, longest=4, subsumed=80, top=2000):
    """The contract, word for word."""
    out = []
    for lang in {g or "und" for _, g in docs}:
        f, n = Counter(), 0
        for text, g in docs:
            if (g or "und") == lang:
                for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text)):
                    w = re.findall("[^\x20\x09]+", piece)
                    n += len(w)
                    f.update(tuple(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
        candidates = [p for p, a in f.items() if len(p) > 1 and a >= least]
        inside = Counter()
        for p in candidates:
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], f[p])
        rows = []
        for p in candidates:
            if not (p in inside and 100 * inside[p] >= subsumed * f[p]):
                score, _, l, r = min((2000000 * f[p] // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -f[p], " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


@pytest.mark.parametrize("most", [1 << 20, 7])
def test_phrases_brute_force(spark, most):
    rng = random.Random(most)
    words = ["the", "The", "of", "É", "new", "york", "漢", "city", " ", "a|b"]
    docs = []
    for i in range(60):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", " ", ", ", ".", "\n", "!?"]) for _ in range(rng.randrange(60)))
        docs.append((rng.choice([text, text + "new york city of the new york city"]), rng.choice(["en", "de", None])))
    docs += [(None, "en"), ("", "en"), ("the", "xx")] + [docs[0]] * 3
    d = spark.createDataFrame(docs, "text string, lang string").repartition(3)
    got = collocations.mine_phrases(d, least=4, top=40, most=most)
    assert got.columns == collocations.RESULT
    assert sorted(tuple(r) for r in got.collect()) == phrases_of(docs, 4, top=40)


def test_phrases_odd(spark):
    d = odd(spark)
    got = sorted(tuple(r) for r in collocations.mine_phrases(d).collect())
    assert got == phrases_of([(r[1], r[2]) for r in ODD], 30) and len(got) == 977
    assert collocations.mine_phrases(d.limit(0)).count() == 0
    assert collocations.mine_phrases(d.filter("doc_id < 4 or doc_id is null")).count() == 0


def test_rare_pairs_are_not_shuffled_as_rows(spark):
    """A corpus of rare pairs shuffles fewer bytes than its texts have."""
    rng = random.Random(11)
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(5000)) for _ in range(40)]
    d = spark.createDataFrame([(t, "en") for t in texts], "text string, lang string")
    sent = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).head().totalShuffleWrite()
    before = sent()
    assert collocations.mine_phrases(d).count() == 0
    assert sent() - before < sum(map(len, texts))


@pytest.mark.skipif(not os.path.exists(SMALL), reason="without the driver's tables")
def test_phrases_sql(spark):
    assert same_as_sql(collocations.op11_phrases(spark, SMALL), collocations.ORACLE)


# ---- 12


def test_fingerprint_of_a_text():
    text = "First line, with clauses; and more.\nSecond line is here.\n\n" + "".join(f"Paragraph {i} tells of the number {i * i}, at length.\n" for i in range(200))
    print_ = merkle.fingerprint(text)
    assert print_ == merkle.fingerprint(text) and merkle.likeness(print_, print_) == 1.0 and merkle.differences(print_, print_) == []
    tree = [[p.split(".")[1:] for p in s.split(",")[1:]] for s in print_.split(" ")[1:]]
    paragraphs = re.findall(r"[^\n]*\n+|[^\n]+", text)
    assert len(tree) > 1 and sum(len(s) for s in tree) == len(paragraphs)
    leaves = [x for s in tree for p in s for x in p]
    at = 0
    for x in leaves:  # leaves are the text in order
        digest, n = x.split(":")
        assert hashlib.sha256(text[at : at + int(n)].encode()).hexdigest()[:8] == digest
        at += int(n)
    assert at == len(text)
    # An edit is found where it is, and what stands around it keeps its hashes.
    changed = text.replace("Paragraph 77 tells", "Paragraph 77 told")
    where = text.index("Paragraph 77")
    assert merkle.differences(print_, merkle.fingerprint(changed)) == [(where, where + len("Paragraph 77 tells of the number 5929, at length.\n"))]
    assert 0.99 < merkle.likeness(print_, merkle.fingerprint(changed)) < 1
    assert merkle.likeness(print_, merkle.fingerprint("Before all.\n" + text)) > 0.99
    assert merkle.likeness(print_, merkle.fingerprint("x" * 5000)) == 0.0
    empty = merkle.fingerprint("")
    assert merkle.likeness(empty, empty) == 1.0 and merkle.likeness(empty, print_) == 0.0
    roots = {merkle.fingerprint(t).split(" ")[0] for t in ("", " ", "a", "A", "a ", "a\n", "a\n\n", "ab", "a.b", "a. b")}
    assert len(roots) == 10


def neighbours(rows, ranges, spark):
    d = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    return [tuple(r)[:3] + tuple(r)[5:] for r in merkle.fingerprints(d, ranges=ranges).collect()]


def expected(rows):
    order = sorted(rows, key=lambda r: ((1 << 63) - 1 if r[0] is None else r[0], hashlib.sha256((r[1] or "").encode()).hexdigest()))
    out = []
    for n, (i, t) in enumerate(order):
        t, f = t or "", order[(n + 1) % len(order)][1] or ""
        new = t[: len(t) - len(t) // 2] + f[: len(t) // 2]
        a, b, c = merkle.fingerprint(t), merkle.fingerprint(new), merkle.fingerprint(f)
        out.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), merkle.likeness(a, b), merkle.likeness(a, c)))
    return Counter(out)


@pytest.mark.parametrize("ranges", [1, 4, 50])
def test_neighbours_in_every_dealing(spark, ranges):
    rng = random.Random(ranges)
    rows = [(rng.choice([None, 7, i, i, -i * 10**12]), rng.choice([None, "", "é" * 9, f"Text {i}, of some words. And more\nof them.", LONG[: i * 50]])) for i in range(120)]
    assert Counter(neighbours(rows, ranges, spark)) == expected(rows)
    for few in (rows[:1], rows[:2], [(None, None)], [(1, "same"), (1, "same")]):
        assert Counter(neighbours(few, ranges, spark)) == expected(few)


def test_fingerprints_odd(spark):
    d = odd(spark)
    got = merkle.fingerprints(d).collect()
    assert len(got) == 8 and {r["n_chars"] for r in got if r["doc_id"] == 5} == {len(LONG)}
    assert len({r["fingerprint"] for r in got if r["n_chars"] == 0}) == 1
    assert merkle.fingerprints(d.limit(0)).count() == 0
    text_ids = merkle.fingerprints(d.withColumn("doc_id", F.col("doc_id").cast("string")))
    assert dict(text_ids.dtypes)["doc_id"] == "string" and text_ids.count() == 8


@pytest.mark.skipif(not os.path.exists(SMALL), reason="without the driver's tables")
def test_fingerprints_sql(spark):
    rows = same_as_sql(merkle.op12_fingerprints(spark, SMALL), merkle.ORACLE)
    names = ["doc_id", "edited_fingerprint", "edited_sha256", "fingerprint", "n_chars", "near_edited", "near_next"]
    rows = [dict(zip(names, r, strict=True)) for r in rows]
    assert sum(r["near_edited"] > r["near_next"] for r in rows) > 0.95 * len(rows)


# ---- 13


def near(u, v):
    if len(u) > len(v):
        u, v = v, u
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v, strict=True)) == 1
    return len(u) + 1 == len(v) and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def variants_of(docs):
    """The contract, word for word, each pair of words compared."""
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = crc32(f"{'null' if i is None else i}:{run}".encode())
            n[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    form, count = {}, {}
    for w in n:
        by = [x for x in n if near(w, x)]
        best = min(by, key=lambda x: (-n[x], x), default=None)
        count[w], form[w] = len(by), best if best and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], count[w], n.get(form[w])))
    return sorted(out, key=str)


def mutated(rng, w):
    i = rng.randrange(len(w) + 1)
    return rng.choice([w[:i] + rng.choice("abÿé÷") + w[i:], w[:i] + w[i + 1 :], w[:i] + rng.choice("abß") + w[i + 1 :]])


@pytest.mark.parametrize("most", [1, 40, 1 << 15])
def test_variants_brute_force(spark, most):
    rng = random.Random(most)
    base = ["abcabc", "aaaaaa", "aaaaaaa", "abababab", "étéétéé", "colour", "colouring", "x" * 40, "zzzzzzb"]
    words = base * 8 + [mutated(rng, rng.choice(base)) for _ in range(150)]
    words += [mutated(rng, mutated(rng, rng.choice(base))) for _ in range(100)]
    docs = [(rng.choice([i, None]), " ".join(rng.choice([w, w.upper(), w.capitalize()]) + rng.choice(["", ",", "1", "漢"]) for w in rng.choices(words, k=120))) for i in range(60)]
    docs += [(1, None), (2, ""), (3, "short"), (1000, "chainword " * 200 + "chainwort " * 40 + "chainwart " * 8)] + [docs[0]] * 3
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    got = spelling.group_variants(d, most=most)
    assert got.columns == spelling.RESULT
    want = variants_of(docs)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert len(want) > 100 and any(w[1] and w[2] != w[1] for w in want)  # chains of forms too


def test_pairs_are_found_once(spark):
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.choice([6, 7, 8, 9]))) for _ in range(500)})
    d = spark.createDataFrame([(w, 5) for w in words], "word string, n bigint")
    want = sorted((u, v) for u in words for v in words if near(u, v))
    for most in (1, 200, 1 << 15):
        assert sorted((r["word"], r["near"]) for r in spelling.near_words(d, most).collect()) == want


def test_variants_odd(spark):
    d = odd(spark).unionByName(spark.createDataFrame([(9, " ".join(["y" * 50_000, "y" * 50_001, "y" * 49_999 + "z"] * 9), "en", "a", 0)], DOCS).select("*", *[F.lit("x").alias(c) for c in CLASH]))
    got = {r["word"]: r for r in spelling.group_variants(d, every=10**12).collect()}
    assert len(got) == 3 and {r["n_near"] for r in got.values()} == {1, 2} and got["y" * 50_000]["n_near"] == 2
    assert spelling.group_variants(d.limit(0)).count() == 0
    assert spelling.group_variants(d.filter("doc_id < 5")).count() == 0


@pytest.mark.skipif(not os.path.exists(SMALL), reason="without the driver's tables")
def test_variants_sql(spark):
    assert same_as_sql(spelling.op13_spelling(spark, SMALL), spelling.ORACLE)
