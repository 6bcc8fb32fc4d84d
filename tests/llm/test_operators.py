"""Every dealt operator against brute force, round trips or planted cases, and on odd inputs."""

import hashlib
import os
import random
import re
import time
import tracemalloc
import zipfile
from html.parser import HTMLParser

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import decontaminate, html_extract, jaccard_join, language_id, license_scan, line_dedup, mixing, nn_descent, shared, textvec, toxicity, warc_zip
from quillgraph.llm.components import connected_components

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"w{i % 977}" for i in range(60_000))
ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, "One two", "en", None, 7), (5, LONG, "en", "b", len(LONG)), (5, LONG, "en", "b", len(LONG)), (None, "text without an id", "en", "b", 18), (6, "é ß 漢字 \U0001f600", "de", "b", 8)]


@pytest.fixture(scope="module")
def odd(spark):
    # Columns whose names clash with those that the operators make.
    extra = ["score", "labels", "taken", "k_id", "gone", "n", "c", "root", "th", "lines_removed", "k_text"]
    return spark.createDataFrame(ODD, DOCS).select("*", *[F.lit("x").alias(c) for c in extra])


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def words_of(n, seed):
    rng = random.Random(seed)
    return [f"x{rng.randrange(10**6)}" for _ in range(n)]


# ---- text primitives


def test_words_and_hashes():
    texts = ["Ab cd", None, "", " x y  AB", "é-1", "a" * 3_000_000 + " b"]
    w = textvec.words(*textvec.flat(pa.array(texts)), textvec.NOT_SPACE)
    assert np.diff(w.first).tolist() == [len(re.findall("[^\x20\x09-\x0d]+", t or "")) for t in texts]
    assert w.hash[0] == w.hash[w.first[3] + 1] == textvec.word_hash("ab")


# ---- 1


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "ä" * 200
    rows = [(3, "u3", big), (1, "u 1", big), (2, None, big), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (None, "u", big), (1, "again", big), (7, "u", "x" * 70_000)]
    for zip64 in (False, True):
        made = warc_zip.write_archives(pages(spark, rows).select("*", *[F.lit("x").alias(c) for c in ("payload", "digest", "long", "original", "refers_to", "n")]), str(tmp_path / f"w{zip64}"), zip64=zip64, most=20_000)
        got = warc_zip.read_archives(made, payload=True).collect()
        assert len(got) == len(rows)
        for r in got:
            payload = next((h or "").encode() for i, _, h in rows if i == r["page_id"])
            assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), hashlib.sha256(payload).hexdigest())
            expected = 1 if payload == big.encode() and r["page_id"] != 1 else None
            assert r["refers_to"] == expected and r["record_type"] == ("revisit" if expected else "response")
            assert r["payload"] == (None if expected else payload)
        ids = [h["warc-record-id"] for p in made.collect() for h, _ in warc_zip.read_package(p["package"])]
        assert len(set(ids)) == len(rows)  # of repeated page ids too
        for p in made.collect():
            with zipfile.ZipFile(p["package"]) as z:
                assert z.testzip() is None and all(i.compress_type == 0 for i in z.infolist())
    assert warc_zip.read_archives(warc_zip.write_archives(pages(spark, []), str(tmp_path / "none"))).count() == 0


def test_zip_written_elsewhere(tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_STORED) as z:
        z.comment = b"PK\x05\x06 looks like an end"
        z.writestr("one", b"1" * 10)
        with z.open("two", "w", force_zip64=True) as f:
            f.write(b"2" * 20)
    with pa.OSFile(str(tmp_path / "a.zip")) as f:
        members = warc_zip.directory(f)
        assert [f.read_at(m.size, warc_zip.member_at(f, m)) for m in members] == [b"1" * 10, b"2" * 20]


# ---- 2


def test_line_dedup(spark):
    passage = [" ".join(words_of(20, k)) for k in range(3)]
    own = [[" ".join(words_of(12, 100 + 10 * d + k)) for k in range(3)] for d in range(6)]
    texts = [
        "\n".join([own[0][0], *passage, own[0][1]]),
        "\n".join([own[1][0], own[1][1], "", *passage, own[1][2]]),  # the passage goes
        "\n".join([own[2][0], passage[0], own[2][1]]),  # too short a block stays
        "\n".join([passage[2], passage[1], own[3][0], passage[0], passage[1]]),  # moved: a block of two
        "\n".join([own[0][0], *passage, own[0][1]]),  # a copy loses all
        "\n".join(own[5]),
    ]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(9, None), (10, "")], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs).collect()}
    assert got[0]["text"] == texts[0] and got[2]["text"] == texts[2] and got[5]["text"] == texts[5]
    assert got[1]["text"].split("\n") == [own[1][0], own[1][1], "", own[1][2]]
    assert passage[0] not in got[3]["text"] and got[4]["text"] == "" and got[9]["text"] is None and got[10]["text"] == ""


def test_patience_blocks_by_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.randrange(8) for _ in range(rng.randrange(12))] for _ in range(2))
        pairs = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))


def test_line_dedup_of_repeated_passages(spark):
    x, y, z, a, b, c, d, e, *p = (" ".join(words_of(20, 300 + k)) for k in range(11))
    rows = [(0, [x, *p, y, *p, z]), (1, [a, *p, b]), (2, [c, *p, d, *p, e])]
    docs = spark.createDataFrame([(i, "\n".join(t)) for i, t in rows], "doc_id bigint, text string")
    got = {r["doc_id"]: r["text"].split("\n") for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {0: rows[0][1], 1: [a, b], 2: [c, d, e]}


def test_common_lines_by_brute_force():
    rng = random.Random(5)
    for _ in range(400):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(14))] for _ in range(2))
        words = [(20, 3, 9, 30, 1, 24)[x] for x in b]
        want = set()
        for s in range(len(b)):
            for e in range(s + 1, len(b) + 1):
                if sum(words[s:e]) >= 25 and any(a[i : i + e - s] == b[s:e] for i in range(len(a))):
                    want |= set(range(s, e))
        assert line_dedup.common_lines(a, b, words) == want


def brute_line_dedup(rows, least=25):
    """rows: (id, text); the text that is left of each, by comparing each with every document before it, run by run."""

    def lines(text):
        return [(n, lower(x)) for n, x in enumerate((text or "").split("\n")) if re.search("[^\x20\x09-\x0d]", x)]

    def order(text_hash, row):
        return row[0] is None, row[0] or 0, text_hash

    out, ranked = {}, sorted(range(len(rows)), key=lambda i: order(rows[i][2], rows[i]))
    for at, i in enumerate(ranked):
        own, gone = lines(rows[i][1]), set()
        for j in ranked[:at]:
            other = [x for _, x in lines(rows[j][1])]
            for s in range(len(own)):
                for e in range(s + 1, len(own) + 1):
                    run = [x for _, x in own[s:e]]
                    if sum(len(re.findall("[^\x20\x09-\x0d]+", x)) for x in run) >= least and any(other[k : k + len(run)] == run for k in range(len(other))):
                        gone |= {n for n, _ in own[s:e]}
        text = rows[i][1]
        out[i] = None if text is None else "\n".join(x for n, x in enumerate(text.split("\n")) if n not in gone)
    return out


def test_line_dedup_by_brute_force(spark):
    rng = random.Random(31)
    a, b, own = " ".join(words_of(30, 1)), " ".join(words_of(12, 2)), " ".join(words_of(9, 3))
    pool = [" ".join(words_of(rng.choice((1, 3, 8, 13, 26, 40)), 700 + k)) for k in range(14)] + [""]
    rows = [(1, a), (2, f"{a}\n{b}"), (3, f"{a}\n{b}\n{own}")]
    rows += [(rng.choice([None, *range(10, 30)]), "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 9)))) for _ in range(60)]
    rows += [(None, "\n".join(words_of(30, 5)))] * 2 + [(40, a.upper()), (2**63 - 1, f"{own}\n{a}"), (5, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    hashed = [(d, t, h) for (d, t), h in zip(rows, [r[0] for r in docs.select(F.coalesce(F.xxhash64("text"), F.lit(0))).collect()], strict=True)]
    want = brute_line_dedup(hashed)
    assert want[2] == own
    got = line_dedup.dedup_lines(docs).collect()
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in got))) == sorted(map(repr, ((rows[i][0], t) for i, t in want.items())))


def test_line_dedup_of_a_hot_holder(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "PARTNERS", 4)
    passage = "\n".join(" ".join(words_of(20, 900 + k)) for k in range(3))
    docs = spark.createDataFrame([(i, f"{' '.join(words_of(30, 1000 + i))}\n{passage}") for i in range(40)] + [(7, f"{' '.join(words_of(30, 1007))}\n{passage}")] * 30, "doc_id bigint, text string")
    got = line_dedup.dedup_lines(docs).collect()
    assert sum("\n" in r["text"] for r in got) == 1 and sum(r["text"] == "" for r in got) == 30 and sum(r["doc_id"] == 7 and r["text"] != "" for r in got) == 1


def test_line_dedup_odd(odd, empty):
    got = line_dedup.dedup_lines(odd)
    assert got.count() == len(ODD) and got.columns[:-1] == odd.columns
    assert line_dedup.dedup_lines(empty).count() == 0


# ---- 3


def brute_phrases(text):
    ws = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text or ""))
    places = sorted((i, label) for p, label in license_scan.PHRASES.items() for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split())
    return len(ws), places


def test_license_scan(spark):
    texts = ["Under the MIT License. under the mit license", "cc-by-nc CC BY NC", "Apache License, Version 2.0", None, "", "the mit license under", "Licensed under the GNU General Public License, version 3.", "under the mit\nlicense 漢 apache license version 2 cc by nc", LONG + " cc by nc"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in license_scan.scan_licenses(docs).collect():
        n, places = brute_phrases(texts[r["doc_id"]])
        assert (r["n_words"], r["n_base"]) == (n, len(places))
        assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
        assert r["doc_id"] != 6 or r["labels"] == "gpl-3"


def test_license_scan_equals_its_sql(spark):
    texts = ["cc by-nc cc by nc CC BY NC", "Licensed under the GNU General Public License, version 3. gnu general public license version 2", "x " * 30 + "this work is licensed under a creative commons attribution 4 0 international license", "permission is hereby granted free of charge", None, "", "123 !", "under the mit license " * 3 + "apache license version 2", "Ünder THE MIT license under the mit license 漢"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = sorted(tuple(r) for r in license_scan.scan_licenses(docs).drop("places").collect())
    con = duckdb.connect()
    con.sql("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", list(enumerate(texts)))
    assert got == sorted(con.sql(license_scan.ORACLE).fetchall())


def test_license_scan_odd(odd, empty):
    assert license_scan.scan_licenses(odd).count() == len(ODD) and license_scan.scan_licenses(empty).count() == 0


# ---- 4


def test_mixing(spark, odd, empty):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 40)), "en", rng.choice(["a", "b", "c", "d"] + ["a"] * 6), 0) for i in range(600)]
    docs = spark.createDataFrame(rows, DOCS)
    quality = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id bigint, quality int")
    got = mixing.mix(docs, quality, ranges=16).collect()
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(docs, quality, ranges=16).collect()}
    assert {r["doc_id"]: r["taken"] for r in got} == again == {r["doc_id"]: r["taken"] for r in mixing.mix(docs, quality, ranges=1).collect()}
    assert all(r["taken"] % r["size"] == 0 and r["taken"] <= 3 * r["size"] for r in got)
    source = {i: s for i, _, _, s, _ in rows}
    total = sum(r["size"] for r in got)
    by = {}
    for r in got:
        x = by.setdefault(source[r["doc_id"]], [0, r["target"], r["source_size"]])
        x[0] += r["taken"]
    assert abs(sum(x[1] for x in by.values()) - total) < 1e-6
    # Water filling by hand: raise shares until none is above its cap.
    weight = dict(zip(sorted(by), (5, 2, 1, 5), strict=True))
    open_, left, want = dict(weight), float(total), {}
    while True:
        over = [s for s in open_ if left * open_[s] / sum(open_.values()) > 3 * by[s][2]]
        if not over:
            break
        for s in over:
            want[s] = 3.0 * by[s][2]
        left -= sum(want[s] for s in over)
        open_ = {s: w for s, w in open_.items() if s not in over}
    want |= {s: left * w / sum(open_.values()) for s, w in open_.items()}
    for s, (taken, target, _) in by.items():
        assert abs(target - want[s]) < 1e-6 and abs(taken - target) <= 40
    assert mixing.mix(odd).count() == len(ODD) and mixing.mix(empty).count() == 0


# ---- 5, 6


def synthetic(spark, n=240):
    rng = random.Random(9)
    parts = {"aa": ["ka", "lo", "mi"], "bb": ["schu", "ver", "zt"], "cc": ["ción", "ñe", "rra"]}
    rows = []
    for i in range(n):
        lang = sorted(parts)[i % 3]
        ws = ["".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(5, 60))]
        if i % 4 == 0:
            ws.insert(rng.randrange(len(ws)), {"aa": "vilething", "bb": "hasswort" + rng.choice(parts[lang]), "cc": "odioso"}[lang])
        rows.append((i, " ".join(ws), lang, "s", 0))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(n)], "doc_id bigint, quality int, toxic int")


def test_language_id(spark, odd, empty):
    docs, _ = synthetic(spark)
    model = language_id.fit(docs)
    got = language_id.identify(docs, model).join(docs.select("doc_id", "lang", language_id.held_out(F.col("doc_id")).alias("h")), "doc_id").filter("h").collect()
    assert got and sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got) and all(0 <= r["score"] <= 1 for r in got)
    mixed = pa.array(["kalomi lomika milo kaka schuver verzt schuzt verver ztschu"])
    p, w = language_id.label_words(model, mixed)
    assert [model.langs[k] for k in p.argmax(axis=1)] == ["aa"] * 4 + ["bb"] * 5
    r = {x["doc_id"]: x for x in language_id.identify(odd, model).collect()}
    assert [r[k]["lang_pred"] for k in (1, 2, 3)] == ["und"] * 3 and r[1]["score"] == 0
    assert language_id.identify(empty, language_id.fit(empty)).count() == 0
    assert {x["lang_pred"] for x in language_id.identify(odd, None).collect()} == {"und"}


def test_forward_backward_by_enumeration():
    rng = np.random.default_rng(0)
    first = np.array([0, 3, 3, 4, 6])
    emit, trans, start = rng.normal(size=(6, 2)).astype(np.float32), rng.normal(size=(2, 2)), rng.normal(size=2)
    got = language_id.posteriors(emit, first, trans, start)
    for a, b in zip(first, first[1:], strict=False):
        total = np.zeros((b - a, 2))
        for code in range(2 ** (b - a)):
            y = [code >> k & 1 for k in range(b - a)]
            s = np.exp((start[y[0]] if y else 0) + sum(emit[a + t, y[t]] for t in range(b - a)) + sum(trans[y[t], y[t + 1]] for t in range(b - a - 1)))
            for t in range(b - a):
                total[t, y[t]] += s
        if b > a:
            assert np.allclose(got[a:b], total / total.sum(axis=1, keepdims=True), atol=1e-5)


def test_toxicity_sends_the_driver_compressed_features(spark):
    rng = random.Random(3)
    common = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(400)]
    texts = [" ".join(rng.choices(common, k=500)) for _ in range(40)]
    rows = toxicity.profiles(spark.createDataFrame([(i, 0, "aa", t) for i, t in enumerate(texts)], "id bigint, toxic int, lang string, text string"))
    got = rows.select("id", F.octet_length("f").alias("n")).collect()
    assert len(got) == 40 and sum(r["n"] for r in got) < 0.6 * 40 * 40 * 500


def test_toxicity(spark, odd, empty):
    docs, labels = synthetic(spark, 600)
    model = toxicity.fit(docs, labels)
    got = toxicity.classify(docs, model).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r["toxic"] for r in got) >= 0.93 * len(got) and all((r["score"] >= 0.5) == (r["predicted"] == 1) for r in got)
    out = {r["doc_id"]: r for r in toxicity.classify(odd, model).collect()}
    assert out[1]["predicted"] == out[2]["predicted"] == 0
    assert toxicity.classify(odd, None).filter("score > 0").count() == 0
    assert toxicity.fit(empty, labels.limit(0)) is None and toxicity.classify(empty, None).count() == 0
    clash = docs.select("*", *[F.lit("x").alias(c) for c in ("id", "toxic", "one", "hash", "n", "bytes", "key_", "ids_")])
    again = toxicity.fit(clash.unionByName(clash), labels)  # repeated rows count once
    assert np.array_equal(again.emb, model.emb) and np.array_equal(again.shift, model.shift)
    long_ = docs.unionByName(spark.createDataFrame([(7, LONG, "en", "s", 0), (13, " ".join(["vile"] * 80_000), "en", "s", 0)], DOCS))
    assert toxicity.fit(long_, labels) is not None and language_id.fit(long_) is not None
    assert language_id.fit(clash.drop("toxic")).langs == ["aa", "bb", "cc"]


# ---- 7


def brute_components(rows, rule):
    sets = []
    for _, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", lower(t or ""))
        k = rule.shingle
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= rule.similar * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    names = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            names[find(i)] = min(d, names.get(find(i), d))
    return [(d, len(sets[i]), names.get(find(i))) for i, (d, _) in enumerate(rows)]


@pytest.mark.parametrize("rule", [jaccard_join.CONTRACT, jaccard_join.CORPUS])
def test_jaccard_components(spark, rule):
    rng = random.Random(11)
    texts = []
    for f in range(12):
        base = words_of(rng.randrange(20, 200), 50 + f)
        texts.append(" ".join(base))
        for _ in range(rng.randrange(8)):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 25)):
                w[rng.randrange(len(w))] = f"y{rng.randrange(10**6)}"
            texts.append(" ".join(w).upper() if rng.random() < 0.2 else "  ".join(w))
            base = w if rng.random() < 0.4 else base  # chains too
    texts += ["a b", "A  b", "a", "a b c", None, "", " \n", "b a", LONG, LONG, LONG + " tail"]
    rng.shuffle(texts)
    rows = [(i * 3 % 101, t) for i, t in enumerate(texts)] + [(7, texts[0]), (None, texts[1]), (None, "alone and without an id")]
    got = jaccard_join.similarity_components(spark.createDataFrame(rows, "doc_id bigint, text string"), rule=rule)
    assert sorted(map(repr, map(tuple, got.select("did", "n", "component_id").collect()))) == sorted(map(repr, brute_components(rows, rule)))


def test_long_lists_are_dealt_in_parts(spark):
    """A list in parts gives the pairs that it gives as a whole."""
    rng = random.Random(17)
    rows = [(1 + k // 60, c := 1000 + k, c, rng.randrange(3, 9), 0) for k in range(120)]
    held = spark.createDataFrame(rows, "token bigint, c bigint, root bigint, n bigint, pos int").drop("root")
    roots = spark.createDataFrame([(1000 + k, 1000 + k % 7) for k in range(0, 120, 2)], "node bigint, root bigint")
    whole, parts = ({tuple(r) for r in jaccard_join.second_round(held, roots, jaccard_join.CORPUS, most).collect()} for most in (4096, 8))
    assert whole == parts and len(whole) > 100


def test_one_of_each(spark, odd, empty):
    text = " ".join(words_of(80, 1))
    docs = spark.createDataFrame([(4, text), (2, text), (2, text), (9, text + " end"), (5, "other words that stand here alone"), (6, ""), (6, ""), (7, None)], "doc_id bigint, text string").withColumn("did", F.lit(1))
    got = jaccard_join.one_of_each(docs)
    assert sorted((r["doc_id"], r["text"] == text) for r in got.collect()) == [(2, True), (5, False), (6, False), (6, False), (7, False)] and got.columns == docs.columns
    assert jaccard_join.one_of_each(odd).count() == len(ODD) - 1 and jaccard_join.one_of_each(empty).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(500, 501), (501, 500), (7, 7)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(31)} | {i: 100 for i in range(100, 140)} | {500: 500, 501: 500}


def test_bitmap_bound_holds():
    rng = np.random.default_rng(2)
    for _ in range(200):
        x, y = (np.unique(rng.integers(0, 2**63, rng.integers(1, 400)).astype(np.uint64)) for _ in range(2))
        y = np.unique(np.concatenate([y, x[: rng.integers(0, len(x) + 1)]]))
        a, b = (np.frombuffer(jaccard_join.bitmap(s), np.uint8) for s in (x, y))
        assert jaccard_join.most_common(a, b, len(x), len(y)) >= len(np.intersect1d(x, y))


# ---- 8


def edit_distance_within(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p):
        new = [i + 1]
        for j, d in enumerate(t):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_decontamination(spark, odd, empty):
    rng = random.Random(4)
    items = [(k, " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(rng.choice((12, 30, 80))))) for k in range(6)] + [(50, "too short"), (51, None), (0, "and words of a second text under an id that was used before, long enough")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows, want = [], set()
    for d in range(40):
        filler = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(60))
        k = d % 6
        text = items[k][1]
        if d % 3 == 0:
            rows.append((d, filler))
            continue
        if d % 3 == 2:  # a few edits
            cs = list(text)
            for _ in range(len(cs) // 60):
                cs[rng.randrange(len(cs))] = rng.choice("abcxyz")
            text = "".join(cs).upper().replace(" ", ",\n")
        want.add((d, k))
        rows.append((d, f"{filler}! {text} {filler}"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs, bench).collect()}
    assert got == want
    assert {r["doc_id"] for r in decontaminate.clean(docs, bench).collect()} == {d for d, _ in rows} - {d for d, _ in want}
    small = [(i.item_id, decontaminate.normalise(np.frombuffer((i.text or "").encode(), np.uint8))[0].tobytes()) for i in bench.collect()]
    assert len(list(decontaminate.indexes(bench, block=100))) > 1 and small
    assert decontaminate.matches(odd, bench).count() == 0 and decontaminate.clean(odd, bench).count() == len(ODD)
    assert decontaminate.matches(empty, bench).count() == 0 and decontaminate.matches(odd, bench.limit(0)).count() == 0


def test_decontamination_of_excerpts_and_short_items(spark):
    rng = random.Random(12)
    letters = {k: "".join(rng.choice("abcdefgh") for _ in range(n)) for k, n in enumerate((70, 150, 186, 400))}
    bench = spark.createDataFrame([*letters.items(), (10, "Nine plus ten?"), (11, "..."), (12, "art")], "item_id bigint, text string")
    rows, want = [], set()
    for k, text in letters.items():
        for s in range(0, len(text) - 64, 7):
            rows.append((len(rows), f"{'z' * 90} {text[s : s + 64]} {'y' * 90}"))
            want.add((rows[-1][0], k))
    rows += [(900, "So, NINE plus\nten is"), (901, "nine plus tenths, canine plus ten, nineplus ten"), (902, "nine plus"), (903, "ten nine plus"), (904, "parts, art")]
    want |= {(900, 10), (904, 12)}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.matches(docs, bench).collect()}
    assert set(got) == want
    assert (got[900, 10]["start"], got[900, 10]["end"], got[900, 10]["edits"]) == (4, 17, 0)
    assert {r["doc_id"] for r in decontaminate.clean(docs, bench).collect()} == {901, 902, 903}


def test_decontamination_by_brute_force(spark, monkeypatch):
    """Each pattern of each item against all substrings of each text, over a benchmark of several blocks."""
    rng = random.Random(21)
    items = {k: "".join(rng.choice("abcdef") for _ in range(n)) for k, n in enumerate((40, 75, 110))}
    texts = []
    for d in range(24):
        body = list(items[d % 3] if d % 4 else "")
        at = rng.randrange(0, max(1, len(body) - 30))
        body = body[at // 3 : len(body) - rng.randrange(0, 12)]
        for _ in range(rng.randrange(0, 9)):
            k = rng.randrange(len(body)) if body else 0
            body[k : k + rng.randrange(2)] = [rng.choice("abcdef")] * rng.randrange(2)
        texts.append("".join(rng.choice("uvwxyz") for _ in range(40)) + "".join(body) + "".join(rng.choice("uvwxyz") for _ in range(30)))
    want = set()
    for k, item in items.items():
        patterns = {item} | {item[s : s + m] for m, stride in decontaminate.WINDOWS if len(item) > m for s in (*range(0, len(item) - m, stride), len(item) - m)}
        for d, text in enumerate(texts):
            if any(edit_distance_within(p, text) <= min(int(len(p) * decontaminate.EDITS), len(p) // decontaminate.Q - 1) for p in patterns):
                want.add((d, k))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").select("*", F.lit("x").alias("a"), F.lit("x").alias("text_key"))
    bench = spark.createDataFrame([*items.items(), (1, items[1])], "item_id bigint, text string")
    whole = decontaminate.indexes
    monkeypatch.setattr(decontaminate, "indexes", lambda b: whole(b, block=60))
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs, bench).collect()} == want and 4 < len(want) < 24
    left = decontaminate.clean(docs.unionByName(docs), bench)
    assert sorted(r["doc_id"] for r in left.collect()) == sorted([d for d in range(24) if d not in {x for x, _ in want}] * 2) and left.columns == docs.columns


def test_banded_alignment_by_brute_force():
    rng = random.Random(6)
    for _ in range(60):
        p = bytes(rng.choice(b"abc") for _ in range(rng.randrange(20, 60)))
        t = bytearray(p)
        for _ in range(rng.randrange(5)):
            k = rng.randrange(len(t))
            t[k : k + rng.randrange(2)] = bytes(rng.choice(b"abc") for _ in range(rng.randrange(2)))
        pad = rng.randrange(2 * decontaminate.BAND - 6)
        region = (b"z" * pad + bytes(t))[: len(p) + 2 * decontaminate.BAND]
        rows = np.zeros((1, len(p) + 2 * decontaminate.BAND), np.uint8)
        rows[0, : len(region)] = np.frombuffer(region, np.uint8)
        assert decontaminate.banded_distances([p], rows)[0][0] == edit_distance_within(p, region)


# ---- 9


def brute_nearest(rows, q, top=5):
    """(vec_id, score) of the nearest rows to row number q."""
    out = []
    for i, (vec_id, v) in enumerate(rows):
        if i != q and len(v) == len(rows[q][1]):
            a, b = np.array(v, float), np.array(rows[q][1], float)
            out.append((-round(float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)), 9), vec_id is None, vec_id or 0))
    return [(None if n else v, -s) for s, n, v in sorted(out)[:top]]


def test_nearest(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(700, 16)).astype(np.float32)
    x[200:260] = x[0]  # equal vectors
    good = [(i, v.tolist()) for i, v in enumerate(x)] + [(None, x[51].tolist()), (50, x[51].tolist()), (50, x[50].tolist()), (100, x[100].tolist()), (150, [1.0, 2.0]), (151, [2.0, 1.0])]
    bad = [(900, None), (950, [0.0] * 16), (1000, [None] + [1.0] * 15), (1050, [float("nan")] * 16), (1100, [float("inf")] * 16), (1150, [])]
    docs = spark.createDataFrame(good + bad, "vec_id bigint, embedding array<float>").withColumn("node", F.lit("x")).withColumn("score", F.lit(1)).withColumn("v", F.lit(2))
    got = nn_descent.nearest(docs).collect()
    want, hits = [], 0
    for q, (vec_id, _) in enumerate(good):
        if vec_id is not None and vec_id % 50 == 0:
            want += [(vec_id, k + 1, v, s) for k, (v, s) in enumerate(brute_nearest(good, q))]
    key = [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in got]
    assert sorted((a, b) for a, b, *_ in key) == sorted((a, b) for a, b, *_ in want)
    for t in want:
        if t in key:
            key.remove(t)
            hits += 1
    assert hits >= 0.9 * len(want)
    few = nn_descent.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id bigint, embedding array<float>")).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in few] == [(0, 1, 1)]
    wide = nn_descent.nearest(spark.createDataFrame([(0, [1e-200, 0.0]), (1, [1e200, 1e200])], "vec_id bigint, embedding array<double>")).collect()
    assert [(r["vec_id"], round(r["score"], 6)) for r in wide] == [(1, 0.707107)]
    assert nn_descent.nearest(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


def test_greedy_search_over_many_parts(spark, monkeypatch):
    """Several blocks, parts and groups; each query is compared with a share of the vectors only."""
    for name, value in {"PART": 256, "BLOCK": 128, "QUERIES": 8, "NEIGHBOURS": 16, "WIDTH": 8, "BEAM": 32}.items():
        monkeypatch.setattr(nn_descent, name, value)
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(60, 24))
    x = (centres[rng.integers(60, size=4000)] + 0.6 * rng.normal(size=(4000, 24))).astype(np.float32)
    got = nn_descent.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")).collect()
    d = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 4000, 50):
        s = d @ d[q]
        s[q] = -9
        hits += len(set(np.argsort(-s)[:5].tolist()) & {r["vec_id"] for r in got if r["query_id"] == q})
    assert len(got) == 400 and hits >= 0.9 * 400
    assert 0 < max(r["compared"] for r in got) < 0.25 * 4000


def test_nearest_goes_on_until_it_converges(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "ROUNDS", 1)
    shares, beams = [], []
    share, open_ = nn_descent.changed_share, nn_descent.open_beams
    monkeypatch.setattr(nn_descent, "changed_share", lambda a, b: shares.append(share(a, b)) or shares[-1])
    monkeypatch.setattr(nn_descent, "open_beams", lambda b: beams.append(open_(b)) or beams[-1])
    x = np.random.default_rng(9).normal(size=(3000, 16)).astype(np.float32)
    list(nn_descent.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")).toLocalIterator())
    assert len(shares) > 1 and shares[0] > shares[-1] and shares[-1] < nn_descent.CHANGED
    assert len(beams) > 1 and beams[0] > 0 and beams[-1] == 0


# ---- 10


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><header>Site, name</header><nav><ul><li><a href=x>Home</a></ul></nav>
<div class="cookie-notice">We use cookies, as all do, on every page of ours.</div><article><h1>Head &amp; line</h1><p><b>First, paragraph   of
the text, long enough to score.<br><p>Second &lt;p&gt; one, with <a href=y>a link</a> and more, quite long too.</p><form><input>Search here please</form>
<div class="ad">Buy, now, cheap things</div><script>var x="<p>no</p>";</script><ul><li>an item<li>another</ul></article><aside>Side, bar</aside>
<section id="comments"><p>A reader, says, something long about the article here.</p></section><footer>&copy; foot</footer>"""


def test_html(spark):
    want = "Head & line\nFirst, paragraph of the text, long enough to score.\nSecond <p> one, with a link and more, quite long too.\nan item\nanother"
    assert html_extract.extract(PAGE) == want
    assert html_extract.extract(PAGE.replace("article>", "div>").replace("<article", '<div class="post"')).startswith("Head & line")
    for bad in (None, "", "<", "<p", "plain text", "<div><p>x</div></p></b>", "<!-- open", "<script>never closed", "&am", "<a" * 50):
        assert isinstance(html_extract.extract(bad), str)
    assert html_extract.extract("plain &amp text") == "plain & text"
    deep = "<div>" * 20_000 + "deep text, that is long enough, to be scored here" + "</div>" * 20_000
    assert html_extract.extract(deep).startswith("deep text")
    d = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (None, "u", "")], "page_id bigint, url string, html string")
    clash = d.unionByName(d).select("*", *[F.lit("x").alias(c) for c in ("text", "n_chars", "__html")])
    assert html_extract.extract_pages(clash).count() == 6
    got = {r["page_id"]: r for r in html_extract.extract_pages(d).collect()}
    assert got[1]["text"] == want and got[1]["n_chars"] == len(want) and got[2]["text"] == "" and html_extract.extract_pages(d.limit(0)).count() == 0


def test_html_links_of_the_article():
    links = "<li><a href=a>Reference one</a><li><a href=b>Reference two</a><li><a href=c>Reference three</a>"
    table = "<table><tr><td><a href=a>Cell one</a><td><a href=b>Cell two</a><td><a href=c>Cell three</a></table>"
    line = "<p><a href=a>First link</a> <a href=b>second link</a> <a href=c>third link</a></p>"
    prose = "<p>A paragraph, long enough, that tells of things at some length.</p>" * 3
    menu = "<ul><li><a href=a>Home page</a><li><a href=b>News page</a><li><a href=c>About page</a></ul>"
    for tag, end in (("article", "article"), ("main", "main"), ('div class="post"', "div")):
        page = f"<body>{menu}<{tag}>{prose}<ul>{links}</ul>{table}{line}<ul class=pagination>{links.replace('Reference', 'Page')}</ul></{end}>{menu}</body>"
        want = ["A paragraph, long enough, that tells of things at some length."] * 3 + ["Reference one", "Reference two", "Reference three", "Cell one", "Cell two", "Cell three", "First link second link third link"]
        assert html_extract.extract(page).split("\n") == want


class Reader(HTMLParser):
    """An independent reading of pages whose article is an article element: its blocks, without what stands elsewhere."""

    BLOCKS = frozenset("p h1 h2 h3 h4 li ul ol div article section blockquote table tr td".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag in self.BLOCKS:
            self.blocks.append("")
        elif tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        if tag == "article":
            self.inside = False
        if tag in self.BLOCKS:
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="without the driver's tables")
def test_html_of_all_pages(spark):
    pages = shared.table(spark, "/root/testdata/sf0.01", "pages")
    got = {r["page_id"]: r["text"] for r in html_extract.extract_pages(pages).collect()}
    for r in pages.collect():
        reader = Reader()
        reader.feed(r["html"] or "")
        reader.close()
        assert got[r["page_id"]] == "\n".join(t for b in reader.blocks if (t := " ".join(b.split())))


def test_html_keeps_all_of_the_article():
    prose = "<p>A paragraph, long enough, that tells of things at some length.</p>" * 3
    parts = "<p>Let <math><mi>x</mi> + <mn>1</mn></math> be.<svg><text>Drawn words</text></svg><div class=legal>The law of the land.</div><div id=tags>A word on tags.</div><label>A label here.</label>"
    gone = "<div class='share related'><a href=a>Tell</a> <a href=b>others</a></div><div class=comments>Readers say, well, much.</div>"
    got = html_extract.extract(f"<nav><a href=x>Menu</a></nav><article>{prose}{parts}{gone}</article>").split("\n")
    assert got[3:] == ["Let x + 1 be.Drawn words", "The law of the land.", "A word on tags.", "A label here."]


def test_html_in_linear_time():
    n = 40_000
    text = "<p>At the end, a paragraph, that is long enough to score.</p>"
    for page in ("<div>" * n + "</span>" * n, "<span><table><tr><td>" + "<div>" * n + "</span>" * n, "<b>" * n + "<h1></h1>" * n, "<ul>" + "<b>" * n + "<li></li>" * n, "<" * n + ">", "<a 'x" * n + ">", "< a" * n + ">", "<p><b>" * n, "<table>" + "<tr><td>" * n, "<!" * n, "<!--" * n, "<script>" * n):
        began = time.process_time()
        assert isinstance(html_extract.extract(page + text), str)
        assert time.process_time() - began < 8


# ---- shared


def test_a_full_filter_is_no_list_of_objects(spark):
    """A filter of the largest size reaches the driver's JVM without an object for each of its words, and its table too."""
    packed = np.random.default_rng(5).integers(0, 256, shared.FILTER_BITS[1] // 8).astype(np.uint8)
    tracemalloc.start()
    some, rest = shared.split_by(spark.range(4000), "id", packed)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 2 * len(packed)
    assert 500 < some.count() < 1500 and some.unionByName(rest).distinct().count() == 4000


def test_what_the_jvm_has_freed_goes_back_to_the_system(spark):
    """Memory outside the heap that is freed between pieces in use."""
    jvm = spark.sparkContext._jvm
    folder = f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/smaps_rollup"

    def held():
        return int(re.search(r"\nPss_Anon:\s+(\d+)", open(folder).read())[1]) / 1024

    made = [jvm.java.util.zip.Deflater() for _ in range(600)]
    for k, x in enumerate(made):
        if k % 10:
            x.end()
    for _ in range(4):  # the heap's own free memory goes back in the background
        jvm.System.gc()
        time.sleep(1)
    before = held()
    shared.release(spark)
    assert held() < before - 40


def test_fingerprint_filter(spark):
    d = spark.range(1000).select((F.col("id") * 7 - 500).alias("x")).union(spark.sql("select cast(null as bigint)"))
    packed = shared.fingerprint_filter(d, "x", 1 << 16)
    assert shared.may_hold(d, "x", packed).count() == 1001
    assert shared.may_hold(spark.range(10**6, 10**6 + 1000), "id", packed).count() < 50
    some, rest = shared.split_by(d, "x", packed)
    assert some.count() == 1001 and rest.count() == 0


PARAGRAPH = "<p>A paragraph, long enough, that tells of things at some length.</p>"
TOLD = "A paragraph, long enough, that tells of things at some length."


def test_html_never_loses_a_page_to_names():
    body = f"<h1>Head line</h1>{PARAGRAPH * 3}"
    want = "\n".join(["Head line"] + [TOLD] * 3)
    for names in ("post comment-status-open", "post comments-open", "has-sidebar", "no-sidebar", "page cookies-set", "single ad-hoc newsletter-history", "theme-header-fixed", "social-studies"):
        assert html_extract.extract(f"<body><nav><a href=x>Menu</a></nav><div class='{names}'>{body}</div><footer>Foot</footer></body>") == want, names
    for form in ("<form id=aspnetForm method=post>", "<form class='page-form'>"):
        assert html_extract.extract(f"<body>{form}<input type=hidden value=x><div id=content>{body}</div></form></body>") == want
    inside = f"<p class='ad-hoc'>An ad hoc word, said here.</p><section id='comments-on-the-text'>{PARAGRAPH}</section><p class='newsletter-history'>Of letters, a history.</p>"
    got = html_extract.extract(f"<article>{body}{inside}<div class='comments-area'>{PARAGRAPH}</div><div class='ad-slot-300'>Buy, now.</div><div class=post-comments>{PARAGRAPH}</div></article>")
    assert got.split("\n") == ["Head line", *[TOLD] * 3, "An ad hoc word, said here.", TOLD, "Of letters, a history."]
    # A comments section goes, however long it is.
    got = html_extract.extract(f"<body><div class=post>{body}</div><div id=comments>{PARAGRAPH * 9}</div><div class='cookie-banner'>{PARAGRAPH * 9}</div></body>")
    assert got == want


def test_html_parts_of_equal_depth():
    for before, after in (("<section>", "</section>"), ("<section><div>", "</div></section>"), ("<div class=chapter><div><div>", "</div></div></div>")):
        parts = "".join(f"{before}<h2>Part {i}</h2>{PARAGRAPH * (3 if i < 4 else 1)}{after}" for i in range(5))
        got = html_extract.extract(f"<body><nav><a href=x>Menu</a></nav><div id=wrap>{parts}</div><aside>{PARAGRAPH}</aside><footer>Foot</footer></body>").split("\n")
        assert got == [x for i in range(5) for x in [f"Part {i}", *[TOLD] * (3 if i < 4 else 1)]], before


def test_html_odd_rows(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (2, None, ""), (3, "u", "<" * 1000)]
    d = spark.createDataFrame(rows, "page_id bigint, url string, html string").select("*", *[F.lit("x").alias(c) for c in ("text", "n_chars", "__html")])
    got = html_extract.extract_pages(d).collect()
    assert len(got) == 5 and sum(r["n_chars"] > 0 for r in got) == 3 and {r["n_chars"] for r in got if r["page_id"] in (None, 2)} == {0}


def test_gradient_of_the_language_model():
    """By finite differences of the likelihood, which is summed over all paths."""
    rng = np.random.default_rng(5)
    n, length, k = 3, 4, 3
    emit, trans, start = rng.normal(size=(n, length, k)), rng.normal(size=(k, k)), rng.normal(size=k)
    gold = rng.integers(k, size=(n, length))

    def loss(emit, trans, start):
        def score(r, path):
            return start[path[0]] + sum(emit[r, t, y] for t, y in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:], strict=False))

        paths = [[code // k**t % k for t in range(length)] for code in range(k**length)]
        return sum(np.log(sum(np.exp(score(r, p)) for p in paths)) - score(r, gold[r].tolist()) for r in range(n))

    got = language_id._gradient(emit, gold, trans, start)
    for place, (value, grad) in enumerate(zip((emit, trans, start), got, strict=True)):
        for at in np.ndindex(value.shape):
            moved = [v.copy() for v in (emit, trans, start)]
            ends = []
            for sign in (1, -1):
                moved[place][at] = value[at] + sign * 1e-5
                ends.append(loss(*moved))
            assert abs((ends[0] - ends[1]) / 2e-5 - grad[at]) < 1e-5
