"""Licence scans: Aho-Corasick over each text's words finds notice phrases and identifier
tags; a shunting-yard parser evaluates the and/or/with expressions that tags carry.

The scanned form of a text is its words (letters, digits and everything beyond ASCII,
A-Z in lower case), one blank between, so that a phrase is found whatever white space or
marks stand between its words. One pass of the automaton finds all phrases, overlapping
ones included; a tag's expression is then read from the text itself, to the line's end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import cache
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens._compat import qcol
from spendlens.llm.common import map_arrow, slices

# The phrases that the base counts, and their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Notice phrases that the method adds.
PHRASES = {
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "released into the public domain": "public-domain",
    "creative commons attribution noncommercial": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "all rights reserved": "reserved",
}
# Words of a tag; the text behind it, to the end of its line, is an expression.
TAG = "spdx license identifier"
# How freely a text under a licence may be used: 1 without conditions, 0 not at all. The
# longest name that begins an identifier counts; other identifiers count as UNKNOWN.
FREEDOM = {
    "0bsd": 1.0, "agpl": 0.3, "apache": 0.9, "bsd": 0.9, "bsl": 0.9, "cc-by": 0.9, "cc-by-nc": 0.1, "cc-by-nd": 0.1,
    "cc-by-sa": 0.5, "cc0": 1.0, "epl": 0.6, "gpl": 0.4, "isc": 0.9, "lgpl": 0.5, "mit": 0.9, "mpl": 0.6,
    "none": 0.0, "public-domain": 1.0, "reserved": 0.0, "unlicense": 1.0, "zlib": 0.9,
}
UNKNOWN = 0.2
# Weaker operators first; an exception belongs to the identifier before it.
BINDS = {"or": 1, "and": 2, "with": 3}

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_TOKEN = re.compile(r"[()]|[0-9a-z.+:-]+")


class Hit(NamedTuple):
    """A phrase in a text: its number, and its first word."""

    phrase: int
    word: int


class Terms(NamedTuple):
    """What an expression comes to: the labels it names, and how free its user is."""

    labels: frozenset[str]
    freedom: float


class BadExpression(ValueError):
    pass


def label_of(identifier: str) -> str:
    """The label of a licence identifier (lower case): that of the base's licences and of
    families without their versions; any other identifier as it is."""
    name = identifier.rstrip("+")
    for family in ("mit", "apache-2", "cc-by-nc"):
        if name == family or re.fullmatch(re.escape(family) + r"[.-][0-9.]+", name):
            return family
    return name


def freedom_of(label: str) -> float:
    parts = [n for n in FREEDOM if label == n or label.startswith((n + "-", n + "."))]
    return FREEDOM[max(parts, key=len)] if parts else UNKNOWN


def postfix(expression: str) -> list[str]:
    """The expression's tokens in postfix order (shunting-yard). And binds more than or,
    with more than both; operators of one rank group from the left."""
    if set(expression) - set(" \t()") - set("0123456789abcdefghijklmnopqrstuvwxyz.+:-"):
        raise BadExpression("characters that no expression has")
    out, waiting, operand = [], [], True
    for token in _TOKEN.findall(expression):
        if token == "(" or token not in BINDS and token != ")":
            if not operand:
                raise BadExpression("operator missing")
            if token == "(":
                waiting.append(token)
            else:
                out.append(token)
                operand = False
            continue
        if operand:
            raise BadExpression("identifier missing")
        if token == ")":
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                raise BadExpression("parenthesis not opened")
            waiting.pop()
            continue
        while waiting and waiting[-1] != "(" and BINDS[waiting[-1]] >= BINDS[token]:
            out.append(waiting.pop())
        waiting.append(token)
        operand = True
    if operand or "(" in waiting:
        raise BadExpression("expression not ended")
    return out + waiting[::-1]


def evaluate(expression: str) -> Terms:
    """Labels and freedom of an expression in lower case. The user of ``a or b`` may choose
    (the freer counts), the user of ``a and b`` must keep both (the stricter counts), and
    an exception takes away half of what a licence keeps back."""
    stack: list[Terms] = []
    names: list[str] = []  # the identifier of each operand that is one; else empty
    for token in postfix(expression):
        if token not in BINDS:
            label = label_of(token)
            stack.append(Terms(frozenset([label]), freedom_of(label)))
            names.append(token)
            continue
        (b, y), (a, x) = (stack.pop(), names.pop()), (stack.pop(), names.pop())
        if token == "with":
            if not x or not y:
                raise BadExpression("an exception goes with one licence")
            stack.append(Terms(a.labels, (1 + a.freedom) / 2))
        else:
            stack.append(Terms(a.labels | b.labels, (min if token == "and" else max)(a.freedom, b.freedom)))
        names.append("")
    return stack[0]


@cache
def automaton(phrases: tuple[str, ...]) -> ahocorasick.Automaton:
    """Finds every phrase between word borders in words with one blank between."""
    found = ahocorasick.Automaton()
    for k, phrase in enumerate(phrases):
        found.add_word(f" {phrase} ", k)
    found.make_automaton()
    return found


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def places(words: Sequence[bytes], phrases: tuple[str, ...]) -> Iterator[Hit]:
    """All places of the phrases, by their last words. Word numbers are counted on from
    hit to hit, so that many hits in a long text cost one pass."""
    line = f" {b' '.join(words).decode()} "
    seen, word = 0, 0  # ``word`` blanks lie before character ``seen``
    lengths = [p.count(" ") + 1 for p in phrases]
    for end, k in automaton(phrases).iter(line):
        word += line.count(" ", seen, end)
        seen = end
        yield Hit(k, word - lengths[k])


def expressions_after(text: bytes, tags: Sequence[int]) -> Iterator[str]:
    """For each tag (its first word; ascending), the text behind it to the line's end, in
    lower case, without comment marks. One pass of the text for all tags."""
    wanted = iter(tags)
    want = next(wanted, None)
    width = len(TAG.split())
    for k, m in enumerate(_WORD.finditer(text.translate(_FOLD)) if want is not None else ()):
        if k != want + width - 1:
            continue
        stop = min((at for at in (text.find(b"\n", m.end()), text.find(b"\r", m.end())) if at >= 0), default=len(text))
        told = text[m.end() : stop].decode("utf-8", "replace").lower().strip().removeprefix(":")
        yield re.split(r"\*/|-->|#|//|\"|;", told)[0].strip(" \t*.,'`")
        want = next(wanted, None)
        if want is None:
            return


def scan(text: bytes) -> dict:
    """Counts, labels and freedom of one text (see ``license_scan``)."""
    phrases = (*BASE_PHRASES, *PHRASES, TAG)
    words = words_of(text)
    hits = list(places(words, phrases))
    base = [h for h in hits if h.phrase < len(BASE_PHRASES)]
    label = list(BASE_PHRASES.values()) + list(PHRASES.values())
    named = {label[h.phrase] for h in hits if h.phrase < len(label)}
    free = [freedom_of(x) for x in named]
    found, bad = [], 0
    for told in expressions_after(text, [h.word for h in hits if phrases[h.phrase] == TAG]):
        try:
            terms = evaluate(told)
        except BadExpression:
            bad += 1
            continue
        found.append(told)
        named |= terms.labels
        free.append(terms.freedom)
    return {
        "n_words": len(words),
        "n_base": len(base),
        "first_word": min((h.word for h in base), default=None),
        "last_word": max((h.word for h in base), default=None),
        "base_labels": sorted({label[h.phrase] for h in base}),
        "labels": sorted(named),
        "score": min(free, default=1.0),
        "expressions": found,
        "n_bad_tags": bad,
    }


SCHEMA = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels array<string>, labels array<string>, score double, expressions array<string>, n_bad_tags bigint"


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row: doc_id, n_words, the base phrases' places (``n_base``, ``first_word``,
    ``last_word``), ``base_labels`` and ``labels`` (distinct, sorted), ``score``, the
    ``expressions`` read from tags and ``n_bad_tags``, tags without a sound expression.

    ``score`` is how freely the text may be used by what it says: the strictest of its
    notices and expressions, 1 for a text that says nothing. A null or empty text says
    nothing and has no words. Phrases may overlap and every place counts. Rows are
    independent: repeated rows and repeated or null ids give a row each, an empty table
    none; columns of the input named like the results do no harm. Texts of any length are
    scanned whole, in memory of a few times their size.
    """

    def run(batches):
        fields = [f.split(" ")[0] for f in SCHEMA.split(", ")]
        strings = pa.list_(pa.string())
        kinds = {"base_labels": strings, "labels": strings, "expressions": strings, "score": pa.float64()}
        for b in slices(batches, "text"):
            found = [scan(t or b"") for t in b.column(1).cast(pa.binary()).to_pylist()]
            columns = [pa.array([x[f] for x in found], kinds.get(f, pa.int64())) for f in fields]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["doc_id", *fields])

    rows = df.select(qcol(id_col).cast("long").alias("doc_id"), qcol(text_col).cast("string").alias("text"))
    return map_arrow(rows, run, "doc_id bigint, " + SCHEMA)


def op13_license_scans(documents: DataFrame) -> DataFrame:
    """Places and labels of the licence notices of every document."""
    joined = {c: F.concat_ws(",", c).alias(c) for c in ("base_labels", "labels")}
    out = license_scan(documents)
    return out.select(*[joined.get(c, F.col(c)) for c in out.columns if c != "expressions"])
