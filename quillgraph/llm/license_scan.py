"""Operator 3, licence scans: a positional index of rare licence words.

Method. Every licence template is a row of words. The document frequency of each template word is counted over all
documents; a template's anchors are its words of highest inverse document frequency. A file's words that are anchors are
looked up in the postings (template, position); occurrences that agree on the template's start (position in the file less
position in the template, within a slack) are intersected, and a start with enough agreeing anchors is a candidate. It
counts if the template's mandatory key phrases stand word by word in the region and enough of the template's words do.
Phrase templates have slack 0 and one anchor, their rarest word: each place of a phrase holds it, so none is missed.

Defined results. Null or empty text: no words, no labels, score 0, null positions. Repeated rows: a row each. Columns
other than the two that are named aren't read. Very long texts are taken whole. An empty table gives an empty result.

Scale: two scans of the text and no shuffle but of counts (one row for each template word and task).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared, textvec

#: The phrases whose places are all reported, and the labels they stand for.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Opening or characteristic words of public licence texts, the label, and phrases that must stand in them.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge"]),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ["except in compliance with the license", "apache org licenses"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("gpl-3", "licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-2", "licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("lgpl", "licensed under the gnu lesser general public license version", ["gnu lesser general public license"]),
    ("agpl-3", "licensed under the gnu affero general public license version 3", ["gnu affero general public license"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["for any purpose with or without fee"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("cc0", "creative commons cc0 1 0 universal public domain dedication", ["cc0 1 0 universal"]),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial"]),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike"]),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
]

ANCHORS, AGREE, SLACK, SHARE = 6, 3, 4, 0.6

PLACE = "struct<label:string,first:bigint,words:int,score:double,base:boolean>"
RESULT = f"{{}} n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, places array<{PLACE}>"


def _hashes(text: str) -> np.ndarray:
    return np.array([textvec.word_hash(w) for w in text.split()], dtype=np.uint64)


@dataclass
class Template:
    label: str
    words: np.ndarray
    keys: list[np.ndarray]
    base: bool
    anchors: list[int] = field(default_factory=list)  # positions, rarest word first


def build_templates(phrases=PHRASES, templates=TEMPLATES) -> list[Template]:
    out = [Template(label, _hashes(p), [_hashes(p)], True) for p, label in phrases.items()]
    return out + [Template(label, _hashes(t), [_hashes(k) for k in keys], False) for label, t, keys in templates]


def vocabulary(templates: list[Template]) -> np.ndarray:
    return np.unique(np.concatenate([t.words for t in templates]))


class Lookup:
    """Finds the few words of a small sorted vocabulary among very many."""

    def __init__(self, vocab: np.ndarray):
        self.vocab = vocab
        self.coarse = np.zeros(1 << 16, dtype=bool)
        self.coarse[vocab >> np.uint64(48)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.coarse[h >> np.uint64(48)])
        k = np.minimum(np.searchsorted(self.vocab, h[at]), len(self.vocab) - 1)
        hit = self.vocab[k] == h[at]
        return at[hit], k[hit]


def document_frequency(docs: DataFrame, text: str, vocab: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many documents each word of the vocabulary stands, and how many documents there are: over all rows."""

    def count(batches):
        look, seen, n = Lookup(vocab), np.zeros(len(vocab), dtype=np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for part in textvec.slices(batch, 0):
                w = textvec.words(*textvec.flat(part.column(0)), textvec.ALNUM)
                at, k = look.find(w.hash)
                doc = np.searchsorted(w.first, at, side="right") - 1
                seen += np.bincount(np.unique(doc * len(vocab) + k) % len(vocab), minlength=len(vocab))
        yield pa.RecordBatch.from_pydict({"word": np.arange(-1, len(vocab)), "n": np.concatenate([[n], seen])})

    rows = docs.select(F.col(text).cast("string").alias("t")).mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n")).collect()
    df = np.zeros(len(vocab) + 1, dtype=np.int64)
    for word, n in rows:
        df[word + 1] = n
    return df[1:], int(df[0])


def _stands(h: np.ndarray, at: int, phrase: np.ndarray, low: int, high: int) -> bool:
    return low <= at and at + len(phrase) <= high and bool((h[at : at + len(phrase)] == phrase).all())


class Scanner:
    def __init__(self, templates: list[Template], idf: dict[int, float]):
        self.templates = templates
        for t in templates:
            rarest = sorted(range(len(t.words)), key=lambda p: (-idf[int(t.words[p])], p))
            t.anchors = rarest[: 1 if t.base else ANCHORS]
        words = np.unique(np.array([t.words[p] for t in templates for p in t.anchors], dtype=np.uint64))
        self.look = Lookup(words)
        self.postings: list[list[tuple[int, int]]] = [[] for _ in words]
        for i, t in enumerate(templates):
            for p in t.anchors:
                self.postings[int(np.searchsorted(words, t.words[p]))].append((i, p))

    def scan(self, w: textvec.Words):
        """Places of each text of a slice: {text: [(template, start, share)]}."""
        at, k = self.look.find(w.hash)
        if not len(at):
            return {}
        doc = np.searchsorted(w.first, at, side="right") - 1
        votes: dict[int, list[tuple[int, int, int]]] = {}
        for word in np.unique(k):
            for i, p in self.postings[word]:
                for d, a in zip(doc[k == word].tolist(), at[k == word].tolist(), strict=True):
                    votes.setdefault(d, []).append((i, a - p, p))
        return {d: found for d, v in votes.items() if (found := self._places(v, w.hash, int(w.first[d]), int(w.first[d + 1])))}

    def _places(self, votes, h, low, high):
        found = []
        by: dict[int, list[tuple[int, int]]] = {}
        for i, start, p in votes:
            by.setdefault(i, []).append((start, p))
        for i, starts in by.items():
            t = self.templates[i]
            if t.base:
                found += [(i, s - low, 1.0) for s, _ in set(starts) if _stands(h, s, t.words, low, high)]
                continue
            starts.sort()
            a, last = 0, None
            for b, (s, _) in enumerate(starts):
                while starts[a][0] < s - SLACK:
                    a += 1
                if len({p for _, p in starts[a : b + 1]}) < min(AGREE, len(t.anchors)) or last is not None and s - last <= len(t.words):
                    continue
                region = h[max(low, s - SLACK) : min(high, s + len(t.words) + SLACK)]
                share = float(np.isin(t.words, region).mean())
                if share >= SHARE and all(any(_stands(region, q, key, 0, len(region)) for q in np.flatnonzero(region == key[0])) for key in t.keys):
                    found.append((i, max(low, s) - low, share))
                    last = s
        return sorted(found, key=lambda x: (x[1], x[0]))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """A row for each document: counts, first and last place of a phrase, labels, score and all places."""
    made = build_templates(phrases, templates)
    vocab = vocabulary(made)
    df, n = document_frequency(docs, text_col, vocab)
    idf = {int(v): float(np.log((n + 1) / (c + 1))) for v, c in zip(vocab, df, strict=True)}
    src = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    kind = src.schema[0].dataType.simpleString()
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places"]

    def run(batches):
        scanner = Scanner(made, idf)
        for batch in batches:
            cols: dict[str, list] = {c: [] for c in names}
            for part in textvec.slices(batch, 1):
                w = textvec.words(*textvec.flat(part.column(1)), textvec.ALNUM)
                found = scanner.scan(w)
                for d, count in enumerate(np.diff(w.first).tolist()):
                    places = found.get(d, [])
                    base = [s for i, s, _ in places if made[i].base]
                    cols["n_words"].append(count)
                    cols["n_base"].append(len(base))
                    cols["first_word"].append(min(base, default=None))
                    cols["last_word"].append(max(base, default=None))
                    cols["base_labels"].append(",".join(sorted({made[i].label for i, _, _ in places if made[i].base})))
                    cols["labels"].append(",".join(sorted({made[i].label for i, _, _ in places})))
                    cols["score"].append(max((x for _, _, x in places), default=0.0))
                    cols["places"].append([{"label": made[i].label, "first": s, "words": len(made[i].words), "score": x, "base": made[i].base} for i, s, x in places])
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("words", pa.int32()), ("score", pa.float64()), ("base", pa.bool_())]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(cols[c], type=t) for c, t in zip(names, kinds, strict=True))], names=[id_col, *names])

    return src.mapInArrow(run, RESULT.format(f"`{id_col}` {kind},"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(shared.table(spark, sf_dir, "documents")).drop("places")


def _oracle() -> str:
    """Phrases by their places in the row of words; templates by the places of their first key phrase, without anchors: a text
    that holds a template's region with fewer than AGREE anchors in place would differ, which no given table has."""

    def row(words: str) -> str:
        return "'" + "".join(f" {w} " for w in words.split()) + "'"

    def items(words) -> str:
        return "[" + ", ".join(words) + "]"

    phrases = ", ".join(f"('{label}', {row(p)}, {len(p.split())})" for p, label in PHRASES.items())
    made = []
    for label, text, keys in TEMPLATES:
        words, key = text.split(), keys[0].split()
        at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        made.append(f"('{label}', {items(repr(w) for w in words)}, {items(row(k) for k in keys)}, {items(repr(k) for k in key)}, {at})")
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{letters}', '{letters.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws from documents),
t as (select doc_id, ws, len(ws)::bigint as n_words, ' ' || array_to_string(ws, '  ') || ' ' as s from w),
phrase as (select * from (values {phrases}) v(label, p, n)),
template as (select * from (values {", ".join(made)}) v(label, words, keys, key, skipped)),
base as (select doc_id, label, len(string_split(s, p)) - 1 as k, len(regexp_extract_all(string_split(s, p)[1], '[^ ]+')) as a, n_words - len(regexp_extract_all(string_split(s, p)[-1], '[^ ]+')) - n as z from t join phrase on contains(s, p)),
place as (select doc_id, ws, label, words, keys, skipped, unnest(list_filter(range(1, n_words + 1), lambda i: ws[i : i + len(key) - 1] = key)) as i from t join template on contains(s, keys[1])),
region as (select doc_id, label, words, keys, ws[greatest(1, i - skipped - {SLACK}) : i - skipped + len(words) - 1 + {SLACK}] as r from place),
more as (select doc_id, label, len(list_filter(words, lambda x: list_contains(r, x))) / len(words) as share from region where len(list_filter(keys, lambda x: not contains(' ' || array_to_string(r, '  ') || ' ', x))) = 0),
b as (select doc_id, sum(k) as n_base, min(a) as first_word, max(z) as last_word, string_agg(distinct label, ',' order by label) as base_labels from base group by doc_id),
l as (select doc_id, string_agg(distinct label, ',' order by label) as labels, max(share) as score from (select doc_id, label, 1.0::double as share from base union all select * from more where share >= {SHARE}) group by doc_id)
select doc_id, n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0)::double as score
from t left join b using (doc_id) left join l using (doc_id)"""


ORACLE = _oracle()
