"""Text functions as column expressions. Regular expressions match Unicode white space where the semantics ask for it."""

from __future__ import annotations

import html
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Source-name keys and their jurisdictions, in order; negation markers; predicates of each edge type.
JURISDICTION_KEYS = (("coppa", "US"), ("gdpr", "EU"), ("ccpa", "US-CA"), ("uk_aadc", "UK"), ("OHCHR", "United Nations"))
NEGATIONS = ("do not", "does not", "will not", "never", "no longer", "don't", "doesn't", "won't", "cannot", "can't", "shall not", "will never")
PREDICATES = {
    "grants": ("collect", "use", "using", "process", "consent"),
    "requires": ("require", "requiring", "must", "need"),
    "permits": ("permit", "allow", "may", "withdraw"),
    "sellsTo": ("sell", "sold", "sale", "share", "sharing", "rent", "disclos"),
    "hasDuration": ("retain", "keep", "kept", "store", "storing"),
}
#: Lengths in characters.
LEAST_SEGMENT, LEAST_PIECE, LONGEST_SPAN, STORED, PROMPTED = 60, 20, 5000, 2000, 800

SENTENCE_END = r"(?U)(?<=[.!?])\s+"
TAU = r"(?i)\b(?:under|below)\s+the\s+age\s+of\s+(\d{1,2})|\b(1[0-9])\s+years"


def any_of(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def strip_markup(text: Column) -> Column:
    """Tags become a space, runs of blanks one, runs of empty lines one."""
    bare = F.regexp_replace(text, "<[^>]+>", " ")
    return F.regexp_replace(F.regexp_replace(bare, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n")


def named_entities(text: Column) -> Column:
    """The five XML entities and the no-break space, without Python."""
    for name, x in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(x))
    return F.replace(F.replace(text, F.lit("﻿"), F.lit("")), F.lit(" "), F.lit(" "))


def all_entities(text: Column) -> Column:
    """Every character reference of HTML, in Arrow batches; byte-order marks go, no-break spaces become spaces."""

    @F.arrow_udf("string")
    def decode(texts: pa.Array) -> pa.Array:
        return pa.array([None if x is None else html.unescape(x).replace("﻿", "").replace(" ", " ") for x in texts.to_pylist()], pa.string())

    return decode(text)


def nfc(text: Column) -> Column:
    """Canonical composition, which Spark doesn't have, in Arrow batches."""

    @F.arrow_udf("string")
    def compose(texts: pa.Array) -> pa.Array:
        return pa.array([None if x is None else x if x.isascii() else unicodedata.normalize("NFC", x) for x in texts.to_pylist()], pa.string())

    return compose(text)


def jurisdiction_of(name: Column) -> Column:
    out = F.lit("UNKNOWN")
    for key, place in reversed(JURISDICTION_KEYS):
        out = F.when(name.contains(key), place).otherwise(out)
    return out


def find_tau(text: Column) -> Column:
    """The first age threshold that is stated, as an integer."""
    hit = F.regexp_substr(text, F.lit(TAU))
    return F.coalesce(*[F.nullif(F.regexp_extract(hit, TAU, k), F.lit("")) for k in (1, 2)]).cast("int")


def _kept(parts: Column, least: int) -> Column:
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: F.length(x) >= least)


def segments(text: Column, least: int = LEAST_SEGMENT) -> Column:
    """Pieces between blank lines, and before `Article N` and section signs at the start of a line."""
    return _kept(F.split(text, r"\n\s*\n|(?m)(?=^\s*Article\s+\d+)|(?m)(?=^\s*§)"), least)


def header_segments(text: Column, least: int = LEAST_SEGMENT) -> Column:
    """Pieces before statute section numbers."""
    return _kept(F.split(text, r"(?=\b1798\.\d+(?:\.\d+)?\.\s)"), least)


def article_slice(text: Column, begin: str, end: str) -> Column:
    """From one heading to the next; an error where either is absent."""
    a, b = F.locate(begin, text), F.locate(end, text)
    return F.when((a > 0) & (b > a), F.substring(text, a, b - a)).otherwise(F.raise_error(F.lit(f"no text between {begin!r} and {end!r}")))


def drop_page_lines(text: Column) -> Column:
    """Without page banners and lines that are a number of one to four digits."""
    lines = F.split(text, "\n")
    return F.array_join(F.filter(lines, lambda x: ~F.trim(x).rlike(r"(?i)^-+\s*Page\s+\d+\s*-+$|^\d{1,4}$")), "\n")


def dewrap(text: Column) -> Column:
    """Paragraphs: lines joined until one ends in terminal punctuation; blank lines are passed over."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    marked = F.transform(lines, lambda x: F.when(x.rlike(r"[.!?:]$"), F.concat(x, F.lit("\u001e"))).otherwise(F.concat(x, F.lit(" "))))
    return F.filter(F.transform(F.split(F.array_join(marked, ""), "\u001e"), lambda x: F.rtrim(x)), lambda x: x != "")


def split_long(span: Column, longest: int = LONGEST_SPAN, least: int = LEAST_PIECE) -> Column:
    """Spans over the limit in pieces that begin with markers such as (a); others whole."""
    pieces = _kept(F.split(span, r"(?=\(\w{1,3}\)\s)"), least)
    return F.when(F.length(span) > longest, pieces).otherwise(F.array(span))


def dedup_key(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"(?U)\s+", " "), "^ | $", "")


def unit_key(text: Column) -> Column:
    """SHA-256 of the composed text with single spaces and no space at its end."""
    return F.sha2(F.rtrim(F.regexp_replace(nfc(text), r"(?U)\s+", " ")), 256)


def provision_key(model, temperature, max_tokens, place: Column, tau: Column, text: Column) -> Column:
    """The cache key of an extraction; absent values are spelled None."""
    parts = [F.lit(str(model)), F.lit(repr(temperature)), F.lit(str(max_tokens)), F.coalesce(place, F.lit("None")), F.coalesce(tau.cast("string"), F.lit("None")), F.substring(text, 1, PROMPTED)]
    return F.sha2(F.concat_ws("|", *parts), 256)


def sentences(text: Column) -> Column:
    """Sentences end at . ! or ? before white space."""
    return F.filter(F.transform(F.split(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), SENTENCE_END), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")


def clauses(sentence: Column) -> Column:
    return F.filter(F.transform(F.split(sentence, r"(?i);|,|\band\b|\bbut\b"), lambda x: F.trim(x)), lambda x: x != "")


def negated(sentence: Column, edge_type: str) -> Column:
    """Whether a clause holds both a predicate of the edge type and a negation."""
    words = PREDICATES.get(edge_type)
    if words is None:
        return F.lit(False)
    return F.exists(clauses(F.lower(sentence)), lambda c: any_of(c, words) & any_of(c, NEGATIONS))


def json_object(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def json_array(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(?s)\[.*\]", 0), F.lit(""))


def after_marker(text: Column, marker: str = "REVISED:") -> Column:
    """What follows the last marker; all of it where there is none."""
    return F.trim(F.substring_index(text, marker, -1))


def confidence(text: Column) -> Column:
    """A number held within 0 and 1; null where it isn't one."""
    x = text.try_cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def chosen_codes(answer: Column, codes: Column) -> Column:
    """`1, 3` to the codes at these places; places out of range are passed over."""
    at = F.filter(F.transform(F.split(answer, "[,\\s]+"), lambda x: x.try_cast("int")), lambda k: k.isNotNull() & (k >= 1) & (k <= F.size(codes)))
    return F.transform(at, lambda k: F.element_at(codes, k))
