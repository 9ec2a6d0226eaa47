"""Quality classifier: supervised subword embeddings.

Every word and every character n-gram (byte n-grams of the UTF-8 text) is hashed to a
learned vector; a document is the mean of its vectors, and a softmax over it gives the
classes. Vectors and output are trained by stochastic gradient descent in numpy, in one
task, on a bounded sample of labelled rows. The mean is linear, so scoring needs one
number a bucket: the vector's product with the output's difference of classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens._compat import qcol
from spendlens.llm.common import U64, _BYTE, _power_tables, crc_mod, id_text, lean, map_arrow, slices, utf8, word_hashes
from spendlens.session import ship_package

BITS = 17
DIM = 8
NGRAMS = (3, 4)
# Labelled rows of each class that the model is fitted on, at most.
FIT_ROWS = 2_000
EPOCHS = 6
RATE = 30.0
# Buckets of the features that are not hashed.
EMPTY, AGAIN = 0, 1
# Bytes of text that are worked on at a time: a worker holds some fifty times as many.
_SLICE = 1 << 19
_SPREAD = U64(0x9FB21C651E98DF25)


def feature_ids(starts: np.ndarray, ends: np.ndarray, raw: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of the texts, and the text of each: its words, a mark for
    each word that repeats the one before, and its n-grams. A text without features has
    one of its own, ``EMPTY``."""
    n = len(starts)
    cut = U64(64 - bits)
    words, counts = word_hashes(starts, ends, raw, lower=False)
    of_word = np.repeat(np.arange(n), counts)
    again = np.flatnonzero((words[1:] == words[:-1]) & (of_word[1:] == of_word[:-1])) + 1
    none = np.flatnonzero(ends - starts < min(NGRAMS))
    none = none[counts[none] == 0]
    ids = [np.full(len(none), EMPTY), (words >> cut).astype(np.int64), np.full(len(again), AGAIN)]
    owner = [none, of_word, of_word[again]]
    if len(raw):
        powers, inverse = _power_tables(len(raw) + 1)
        total = np.zeros(len(raw) + 1, U64)
        np.cumsum(_BYTE[raw] * powers[: len(raw)], out=total[1:])
        for width in NGRAMS:
            inside = np.ones(len(raw), bool)
            for k in range(1, width):
                at = ends - k
                inside[at[at >= starts]] = False
            at = np.flatnonzero(inside)
            h = (total[at + width] - total[at]) * inverse[at]
            h ^= h >> U64(29)
            ids.append(((h * _SPREAD) >> cut).astype(np.int64))
            here = np.searchsorted(at, ends) - np.searchsorted(at, starts)
            owner.append(np.repeat(np.arange(n), here))
    return np.concatenate(ids), np.concatenate(owner)


def bags(starts, ends, raw, bits: int = BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, shares) of each text: the shares of its features, summing to 1."""
    ids, owner = feature_ids(starts, ends, raw, bits)
    keys, n = np.unique(owner.astype(np.int64) << 32 | ids, return_counts=True)
    text, bucket = keys >> 32, keys & 0xFFFFFFFF
    edge = np.searchsorted(text, np.arange(len(starts) + 1))
    return [(bucket[a:b], n[a:b] / n[a:b].sum()) for a, b in zip(edge[:-1], edge[1:], strict=True)]


def train(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, bits: int = BITS, seed: int = 1) -> np.ndarray:
    """One weight a bucket: (class 1 minus class 0 of the output) times the vector.

    The order is fixed by the seed and classes weigh the same, so the result does not
    depend on how often each was sampled. With one class only, all weights are 0 (score 0.5).
    """
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << bits, DIM)).astype(np.float32)
    output = np.zeros((2, DIM), np.float32)
    share = np.bincount(labels, minlength=2)
    if not share.all():
        return np.zeros(1 << bits, np.float32)
    weight = (len(labels) / (2 * share)).astype(np.float32)
    steps, done = EPOCHS * len(docs), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(docs)):
            rate = RATE * (1 - done / steps)
            done += 1
            bucket, part = docs[k]
            part = part.astype(np.float32)
            mean = part @ vectors[bucket]
            odds = output @ mean
            p = np.exp(odds - odds.max())
            p /= p.sum()
            p[labels[k]] -= 1
            p *= weight[labels[k]]
            back = p @ output
            output -= rate * 0.01 * np.outer(p, mean)
            vectors[bucket] -= rate * np.outer(part, back)
    return vectors @ (output[1] - output[0])


def fit(df: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", folds: int = 5, most: int = FIT_ROWS) -> np.ndarray:
    """Weights learned from at most ``most`` labelled rows of each class, chosen by a
    hash of their ids, none of them from the held-out fold (crc32 of the id modulo
    ``folds`` = 0). Labels that are null, or two that disagree, teach nothing."""
    known = labels.select(qcol(id_col).cast("bigint").alias("label_id"), qcol(label_col).cast("int").alias("y")).filter("label_id is not null and y in (0, 1)")
    known = known.filter(crc_mod(F.col("label_id"), folds) != 0).groupBy("label_id").agg(F.min("y").alias("y"), F.max("y").alias("y2")).filter("y = y2").drop("y2")
    # a bounded number of ids a class: small enough to broadcast
    picked = [known.filter(F.col("y") == y).orderBy(F.xxhash64("label_id"), "label_id").limit(most) for y in (0, 1)]
    chosen = F.broadcast(picked[0].union(picked[1]))
    rows = id_text(df, id_col, text_col).join(chosen, F.col("doc_id") == F.col("label_id")).select("doc_id", "y", "text")

    def read(batches):
        for b in slices(batches, "text", _SLICE):
            found = bags(*utf8(b.column(2)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([x.astype("<i4").tobytes() for x, _ in found], pa.binary()), pa.array([x.astype("<f4").tobytes() for _, x in found], pa.binary())],
                names=["doc_id", "y", "bucket", "part"],
            )

    def learn(batches):
        rows = sorted((r["doc_id"], r["bucket"], r["part"], r["y"]) for b in batches for r in b.to_pylist())
        docs = [(np.frombuffer(x, "<i4").astype(np.int64), np.frombuffer(p, "<f4")) for _, x, p, _ in rows]
        docs.append((np.array([EMPTY]), np.ones(1, np.float32)))  # an empty text is of no quality
        w = train(docs, np.array([*(r[3] for r in rows), 0], np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([w.astype("<f4").tobytes()], pa.binary())], names=["w"])

    seen = map_arrow(rows, read, "doc_id bigint, y int, bucket binary, part binary")
    got = map_arrow(seen.repartition(1), learn, "w binary").collect()
    return np.frombuffer(got[0]["w"], "<f4") if got else np.zeros(1 << BITS, np.float32)


def score(df: DataFrame, weights: np.ndarray, text_col: str = "text", out: str = "score") -> DataFrame:
    """``df`` with ``out``: the probability of class 1 for every whole text.

    Null and empty texts have only the feature for that, taught as class 0. Rows are
    independent; a column of that name in the input is replaced, others pass through. Only
    the text goes to Python, and only the score comes back, whatever the other columns
    hold; very long texts are scored whole, a slice of a batch at a time.
    """
    ship_package(df.sparkSession)
    w = np.asarray(weights, np.float32)
    bits = int(len(w) - 1).bit_length()

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lean()
        for t in texts:
            parts = []
            for b in slices([pa.RecordBatch.from_arrays([t], names=["text"])], "text", _SLICE):
                ids, owner = feature_ids(*utf8(b.column(0)), bits)
                total = np.bincount(owner, w[ids], b.num_rows) / np.bincount(owner, minlength=b.num_rows)
                parts.append(1 / (1 + np.exp(-np.clip(total, -60, 60))))
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0))
        lean()

    run.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    scored = F.arrow_udf(run, "double")(F.coalesce(qcol(text_col), F.lit("")))
    return df.select(*[qcol(c) for c in df.columns if c != out], scored.alias(out))


def op6_quality_classifier(documents: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Score and verdict of every document; labels only from outside the held-out fold."""
    weights = fit(documents, labels)
    own = documents.select("doc_id", "text")
    return score(own, weights).select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
