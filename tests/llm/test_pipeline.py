"""The pipeline on a small corpus, stage by stage, against plain Python."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from spendlens.llm import classifier, common, minhash, packing, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _corpus():
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(160):
        good = i % 4 != 0
        words = [rng.choice(vocab) for _ in range(rng.randint(12, 200))]
        text = " ".join(words) if good else " ".join(w.upper() + "!!$$" for w in words)
        if i % 10 == 9:
            text = docs[-2][1]  # a copy
        docs.append((i, text, "en", f"s{i % 3}", len(text)))
        if i % 2 == 0:
            labels.append((i, int(good), 0))
    docs += [(1000, None, "en", "s", 0), (1001, "", None, "s", 0), (1002, "too short", "en", None, 9)]
    return docs, labels


def _hash(*words: str) -> int:
    seed = 42  # Spark's: each value seeds the next
    for w in words:
        seed = xxhash.xxh64(w.encode(), seed=seed).intdigest()
    signed = seed - (1 << 64) if seed >> 63 else seed
    return signed % quality_rules.BUCKETS


def _grams(text):
    w = WORD.findall(text or "")
    return [_hash(x) for x in w] + [_hash(a, b) for a, b in zip(w, w[1:])]


def plain_llr(docs: dict, trusted: set) -> dict:
    corpus, good = Counter(), Counter()
    for i, t in docs.items():
        corpus.update(_grams(t))
        if i in trusted:
            good.update(_grams(t))
    share, k = sum(good.values()) / sum(corpus.values()), quality_rules.PRIOR
    ratio = {g: math.log((good[g] + k * share) / (share * (n + k))) for g, n in corpus.items()}
    return {i: (sum(ratio[x] for x in g) / len(g) if (g := _grams(t)) else 0.0) for i, t in docs.items()}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("corpus"))
    docs, labels = _corpus()
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return root


def test_stages_against_plain_python(spark, folder):
    import corpus_pipeline as cp

    docs = common.table(spark, folder, "documents")
    text = {r.doc_id: r.text for r in docs.collect()}
    quality = {r.doc_id: r.quality for r in common.table(spark, folder, "labels").collect()}
    columns = docs.columns

    kept = common.staged(cp.keep_classified(spark, docs, folder), "t1")
    fold = {i: zlib.crc32(str(i).encode()) % 5 for i in text}
    rows = sorted(i for i in quality if fold[i])
    import pyarrow as pa

    bags = classifier.bags(*common.utf8(pa.array([text[i] or "" for i in rows] + [""])))
    bags = [(b, p.astype(np.float32)) for b, p in bags]
    order = sorted(range(len(rows)), key=lambda k: rows[k])
    w = classifier.train([bags[k] for k in order] + [bags[-1]], np.array([quality[rows[k]] for k in order] + [0]))
    ids, owner = classifier.feature_ids(*common.utf8(pa.array([t or "" for t in text.values()])))
    score = 1 / (1 + np.exp(-np.clip(np.bincount(owner, w[ids]) / np.bincount(owner), -60, 60)))
    want = {i for i, s in zip(text, score, strict=True) if s >= cp.MIN_SCORE}
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == want
    assert {i for i, q in quality.items() if q} <= want and not {1000, 1001} & want

    ruled = common.staged(cp.keep_by_rules(spark, kept, folder), "t2")
    left = {i: text[i] for i in want}
    llr = plain_llr(left, {i for i in left if quality.get(i) == 1})
    verdict = quality_rules.judge(kept, common.table(spark, folder, "labels")).collect()
    assert all(r.llr == pytest.approx(llr[r.doc_id], abs=1e-4) for r in verdict)
    want = {i for i, t in left.items() if len(WORD.findall(t or "")) >= 10 and llr[i] >= quality_rules.THRESHOLD}
    assert ruled.columns == columns and {r.doc_id for r in ruled.collect()} == want

    single = common.staged(cp.keep_one_of_near(spark, ruled, folder), "t3")
    first = {}
    for i in sorted(want):  # copies only: other texts are unlike each other
        first.setdefault(tuple(WORD.findall(text[i].lower())), i)
    assert single.columns == columns and {r.doc_id for r in single.collect()} == set(first.values())

    packed = cp.pack_sequences(spark, single, folder).collect()
    tool = packing.WordIds(cp.public_tokenizers.path("word_bpe_49k.json"))
    want = {i: len(tool.encode([text[i]])[0]) // 4 + 1 for i in first.values()}
    assert {r.doc_id: r.length for r in packed} == want
    load = Counter()
    for r in packed:
        load[r.sequence_id] += r.length
    assert max(load.values()) <= cp.SEQUENCE and len(load) <= math.ceil(sum(want.values()) / cp.SEQUENCE) + 1


def test_columns_that_clash_pass_through(spark, folder):
    import corpus_pipeline as cp

    docs = common.table(spark, folder, "documents").selectExpr("*", "1 as llr", "2 as kept", "3 as score", "4 as _n", "5 as component_id", "6 as `a.b`")
    for _, stage in cp.STAGES[:-1]:
        docs = common.staged(stage(spark, docs, folder), "clash")
        assert docs.columns[-6:] == ["llr", "kept", "score", "_n", "component_id", "a.b"] and docs.count()


def test_near_copies_from_080_on_go(spark):
    import corpus_pipeline as cp

    def changed(k, n):  # n of 200 words, far apart: each is in 5 of the 196 windows
        return " ".join(f"d{k}x{i}" + ("changed" if i in range(10, 10 + 20 * n, 20) else "") for i in range(200))

    near = {2 * k: (changed(k, 0), changed(k, 4)) for k in range(8)}  # 176 / 216 = 0.815
    far = {100 + 2 * k: (changed(100 + k, 0), changed(100 + k, 6)) for k in range(8)}  # 166 / 226 = 0.735
    rows = [(i + j, t) for i, pair in {**near, **far}.items() for j, t in enumerate(pair)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    left = {r.doc_id for r in cp.keep_one_of_near(spark, docs, "").collect()}
    assert left == {i for i, _ in rows} - {i + 1 for i in near}
    assert {r.doc_id for r in minhash.op5_near_duplicates(docs).collect() if r.kept} == {i for i, _ in rows}
    for s in (minhash.AT_80, minhash.AT_85):  # a pair at the threshold is found
        p = s.percent / 100
        assert (1 - p**s.rows) ** s.bands <= 1.1e-6 and s.estimate <= p - 6 * math.sqrt(p * (1 - p) / s.places)


def test_repeated_and_missing_ids(spark, tmp_path):
    import corpus_pipeline as cp

    text = " ".join(f"word{i}" for i in range(40))
    other = " ".join(f"other{i}" for i in range(40))
    rows = [(1, text), (1, text), (None, text), (None, text), (2, text), (3, other), (3, "third text of its own " * 3), (None, other + " end"), (None, "alone with no id " * 4), (None, None), (4, ""), (4, "")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, `a.b` string")
    left = [(r.doc_id, r.text) for r in cp.keep_one_of_near(spark, docs, "").collect()]
    assert Counter(t for _, t in left if t in (text, other, other + " end")) in (Counter([text, other]), Counter([text, other + " end"]))
    assert (2, text) in left  # the one id that one row has
    assert (3, "third text of its own " * 3) in left and (None, "alone with no id " * 4) in left
    assert sorted(left, key=str).count((4, "")) == 2 and (None, None) in left and len(left) == 7


def test_empty_table(spark, tmp_path):
    import corpus_pipeline as cp

    none = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    none.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = cp.run(spark, str(tmp_path))
    assert out.count() == 0 and "sequence_id" in out.columns


def test_scores_come_back_alone(spark):
    """The texts are not part of what Python returns, and odd columns pass through."""
    docs = spark.createDataFrame([(1, "some text", b"x", [1]), (2, None, None, None)], "doc_id bigint, text string, `b.c` binary, score array<int>")
    w = np.linspace(-1, 1, 1 << classifier.BITS).astype(np.float32)
    out = classifier.score(docs, w)
    assert out.columns == ["doc_id", "text", "b.c", "score"] and "MapInArrow" not in out._jdf.queryExecution().executedPlan().toString()
    assert all(0 <= r.score <= 1 for r in out.collect())
