"""Ranked search, word runs and licence scans against plain Python, and on nulls, empty and
long texts, ties, repeated rows, empty tables and clashing column names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from spendlens.llm import licenses, runs, search

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, score double, rank int, runs string, labels string, n_words string, item string"


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(5)
    words = [f"w{k}" for k in range(40)] + ["É", "straße", "漢字"]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 60)))) for i in range(400)]
    rows += [(7, rows[7][1]), (500, rows[3][1]), (None, rows[3][1]), (501, None), (502, ""), (503, " \n\t"), (504, "?!"), (505, "W1,w1;W2\tw3 " * 3000)]
    rows += [(506, "x " * 9), (507, "a b c " * 5 + "z"), (None, "k " * 7)]
    rows += [(508, "SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH x-y\nreleased Under\nthe MIT-License"), (509, "spdx license identifier: mit and"), (510, "cc by nc cc by nc 4.0 apache license, version 2 " * 40)]
    return spark.createDataFrame([(i, t, 0.5, 9, "x", "y", "z", "q") for i, t in rows], SCHEMA).repartition(5), rows


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def ranked(rows, items, k):
    """The k best rows of each item, by a full scan."""
    terms = lambda t: TERM.findall((t or "").translate(LOWER))
    known = [(i, terms(t)) for i, t in rows if terms(t)]
    n, total = len(known), sum(len(t) for _, t in known)
    df = Counter(w for _, t in known for w in set(t))
    weight = lambda w: math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1)))
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = set()
    for item, ws in asked.items():
        found = []
        for i, t in known:
            tf, m = Counter(t), 50 + 50 * len(t) * n // total
            s = sum(weight(w) * (10**9 * tf[w] // (1000 * tf[w] + 20 * m)) for w in ws if tf[w])
            if s > 0:
                found.append((-s, i is None, i))
        out |= {(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k])}
    return out


ITEMS = [(1, "w1 W2 w2, w3?"), (2, None), (3, ""), (4, "É straße 漢字 w5 w6 w7 w8"), (5, "nowhere"), (6, "w9"), (6, "w10 w11"), (7, " ".join(f"w{k}" for k in range(40)))]


@pytest.mark.parametrize("most", [search.TERMS, 5])
def test_ranked_search_is_the_full_scan(spark, docs, most, monkeypatch):
    df, rows = docs
    monkeypatch.setattr(search.item_blocks, "__defaults__", (most,))
    items = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id bigint, text string, rank int")
    for segment, block in ((4096, 64), (50, 4)):
        got = search.ranked_search(df, items, 10, segment=segment, block=block).collect()
        assert {tuple(r) for r in got} == ranked(rows, ITEMS, 10)
        assert len(got) == len({(r.item_id, r["rank"]) for r in got})


def test_ranked_search_of_nothing(spark, docs, nothing):
    none = spark.createDataFrame([], "item_id bigint, text string")
    some = spark.createDataFrame([(1, "w1")], "item_id bigint, text string")
    assert search.ranked_search(docs[0], none).collect() == [] and search.ranked_search(nothing, some).collect() == []
    assert search.ranked_search(docs[0], none).columns == ["item_id", "rank", "doc_id", "score"]


def test_summaries_bound_scores_and_blocks_are_skipped():
    r = np.random.default_rng(1)
    # groups of similar documents, each with words of its own
    share = np.zeros((600, 60), np.int32)
    for d in range(600):
        own = (d % 6) * 10 + r.choice(10, 6, replace=False)
        share[d, own] = r.integers(1, 10**6, 6)
        share[d, r.integers(0, 60)] = r.integers(1, 10**5)
    weight = r.integers(1, 9000, 60)
    index = search.Segment(np.arange(600), share, weight, 16)
    query = search.Query(0, np.array([3, 4, 5, 8]))
    full = share[:, query.terms].astype(np.int64) @ weight[query.terms]
    for t, posting in index.postings.items():
        assert sorted(posting.members) == list(np.flatnonzero(share[:, t]))
        assert (index.bounds(posting, query)[posting.block] >= full[posting.members]).all()
    top, tally = search.Top(5), [0, 0]
    index.search(query, top, tally)
    best = np.lexsort((np.arange(600), -full))[:5]
    assert list(top.ids) == list(best) and list(top.score) == list(full[best])
    assert 4 * tally[1] > tally[0]  # their documents are never scored from that list


def brute_runs(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(6, 4 * q) and not any(all(w[i + k] == w[i + k + d] for k in range(length - d)) for d in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out)


def test_runs_are_all_maximal_repeats():
    r, seen = random.Random(3), 0
    for _ in range(1500):
        k = r.choice([1, 2, 2, 3, 4, 6])
        w = [r.randrange(k) for _ in range(r.randint(0, 50))]
        for _ in range(r.randint(0, 3)):
            p, at = r.randint(1, 8), r.randint(0, len(w))
            w[at:at] = ([r.randrange(k) for _ in range(p)] * 9)[: r.randint(1, p * 7)]
        want = brute_runs(w)
        seen += len(want)
        assert runs.runs_of(w) == want
    assert seen > 1000


def test_segments_hold_no_rare_words():
    w = np.array([0, 1] * 6 + [9] + [0, 1, 2] * 3 + [8] + [3] * 7)
    assert sorted(runs.survivors(w)) == [(0, 12), (23, 30)]
    assert runs.runs_of(list(range(50000)) * 4) == [(0, 200000, 50000)]


def test_word_runs(docs, nothing):
    df, rows = docs
    got = sorted(runs.op12_word_runs(df).collect(), key=str)
    assert runs.op12_word_runs(nothing).collect() == []
    want = []
    for i, t in rows:
        w = [x.encode() for x in WORD.findall(t or "")]
        h = zlib.crc32(b"" if i is None else str(i).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        found = brute_runs(w) if n < 500 else [tuple(x) for x in runs.runs_of(w)]
        gone = {k for s, length, q in found for k in range(s + q, s + length)}
        best = min(found, key=lambda x: (-x[1], x[0], x[2])) if found else None
        text = "".join(f"{s},{length},{q}\n" for s, length, q in found)
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
    assert [tuple(r) for r in got] == sorted(want, key=lambda x: str(type(got[0])(**dict(zip(got[0].asDict(), x)))))


def test_word_runs_of_the_operator(docs):
    df, _ = docs
    by = {r.doc_id: r for r in runs.word_runs(df).collect()}
    assert by[506].runs == [(0, 9, 1)] and by[506].collapsed == "x"
    assert by[507].runs == [(0, 15, 3)] and by[507].collapsed == "a b c z"
    assert by[501].runs == [] and by[501].collapsed == ""
    assert by[505].runs == [(0, 6000, 2)]


def test_license_scans(docs, nothing):
    df, rows = docs
    got = licenses.op13_license_scans(df).collect()
    assert licenses.op13_license_scans(nothing).collect() == []
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    want = Counter()
    for i, t in rows:
        w = word.findall((t or "").translate(LOWER))
        hits = [(k, label) for phrase, label in licenses.BASE_PHRASES.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        at = [k for k, _ in hits]
        want[i, len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))] += 1
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == want
    for r in got:
        assert set(r.base_labels.split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r.score <= 1
        assert r["labels"] == ",".join(sorted(set(r["labels"].split(","))))
    by = {r.doc_id: r for r in got}
    assert by[508]["labels"] == "apache-2,gpl-2.0-only,mit" and by[508].score == 0.7 and by[508].n_base == 1
    assert by[509].n_bad_tags == 1 and by[509]["labels"] == "" and by[509].score == 1.0
    assert by[510].n_base == 120


@pytest.mark.parametrize(
    "told, want",
    [
        ("mit", "mit"),
        ("mit or isc and gpl-3.0", "mit isc gpl-3.0 and or"),
        ("(mit or isc) and gpl-3.0", "mit isc or gpl-3.0 and"),
        ("a or b or c", "a b or c or"),
        ("a with x and b", "a x with b and"),
        ("((a))", "a"),
    ],
)
def test_postfix(told, want):
    assert " ".join(licenses.postfix(told)) == want


@pytest.mark.parametrize("told", ["", "and", "mit and", "or mit", "(mit", "mit)", "()", "mit isc", "mit (isc)", "(mit or isc) with x", "mit & isc"])
def test_bad_expressions(told):
    with pytest.raises(licenses.BadExpression):
        licenses.evaluate(told)


def test_expressions_against_python():
    """Random expressions evaluated by Python's own operators of the same ranks."""
    r = random.Random(2)
    free = {"mit": 0.9, "gpl-2.0": 0.4, "cc0-1.0": 1.0, "cc-by-nc-4.0": 0.1}

    class V(float):
        __or__, __and__ = lambda a, b: V(max(a, b)), lambda a, b: V(min(a, b))

    def make(depth):
        if depth == 0 or r.random() < 0.3:
            return r.choice(list(free))
        text = f"{make(depth - 1)} {r.choice(['and', 'or'])} {make(depth - 1)}"
        return f"({text})" if r.random() < 0.5 else text

    for _ in range(300):
        told = make(4)
        plain = re.sub(r"[a-z][a-z0-9.-]+", lambda m: {"and": "&", "or": "|"}.get(m[0]) or f"V({free[m[0]]})", told)
        assert licenses.evaluate(told).freedom == eval(plain)  # noqa: S307 - made above
