"""Periodic runs of words inside a text: recursive frequency splitting, then lag scans.

A qualifying run of period q is at least ``EXPONENT`` periods long, so each of its words
occurs that often in every segment that holds the run. Words that are rarer in their
segment split it; the parts are looked at again until nothing splits. What survives is
scanned by lags, doubling: windows of b words are ranked exactly, and the distance from
a window to its next equal one is the lag. A run of period q, b/2 < q <= b, is a stretch
of equal lags q, since a window of at least one period comes again first after one period.
So a segment of m words takes about log2(m) sorts, not m / 4 comparisons of the whole.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spendlens._compat import qcol
from spendlens.llm.common import map_arrow, slices

# A run has at least so many words, and so many periods.
LEAST = 6
EXPONENT = 4


class Run(NamedTuple):
    start: int
    length: int
    period: int


def survivors(ids: np.ndarray) -> Iterator[tuple[int, int]]:
    """(begin, end) of the stable segments: each holds only words that occur at least
    ``EXPONENT`` times in it, and has at least ``LEAST`` words. Only segments that were
    split are looked at again."""
    at, segment = np.arange(len(ids)), np.zeros(len(ids), np.int64)
    width = int(ids.max()) + 1 if len(ids) else 1
    while len(at):
        _, back, count = np.unique(segment * width + ids[at], return_inverse=True, return_counts=True)
        keep = count[back] >= EXPONENT
        split = np.bincount(segment, ~keep) > 0
        edge = np.flatnonzero(np.diff(segment)) + 1
        for begin, end in zip([0, *edge], [*edge, len(at)], strict=True):
            if not split[segment[begin]]:
                yield int(at[begin]), int(at[end - 1]) + 1
        keep &= split[segment]
        at, segment = at[keep], segment[keep]
        # a gap in the places, or the border of a segment, begins a new one
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) > 1) | (np.diff(segment) > 0)
        segment = np.cumsum(new) - 1
        long = np.bincount(segment, minlength=1)[segment] >= LEAST
        at, segment = at[long], segment[long]
        segment = np.unique(segment, return_inverse=True)[1]


def lag_scan(ids: np.ndarray) -> Iterator[Run]:
    """The qualifying runs inside one segment."""
    m, b, rank = len(ids), 1, ids
    while b // 2 < m // EXPONENT:
        order = np.argsort(rank, kind="stable")
        again = np.flatnonzero(rank[order[1:]] == rank[order[:-1]])
        if not len(again):
            return  # no window comes twice: no longer one does
        lag = np.zeros(len(rank), np.int64)
        lag[order[again]] = order[again + 1] - order[again]
        lag[(lag <= b // 2) | (lag > b)] = 0
        edge = np.concatenate([[0], np.flatnonzero(np.diff(lag)) + 1, [len(lag)]])
        q, start, stop = lag[edge[:-1]], edge[:-1], edge[1:]
        length = stop - 1 + b + q - start
        for k in np.flatnonzero((q > 0) & (length >= np.maximum(LEAST, EXPONENT * q))):
            yield Run(int(start[k]), int(length[k]), int(q[k]))
        if len(rank) <= b:
            return
        # windows twice as long, by the ranks of their halves
        pair = rank[:-b].astype(np.int64) * (int(rank.max()) + 1) + rank[b:]
        rank = np.unique(pair, return_inverse=True)[1]
        b *= 2


def runs_of(words: list) -> list[Run]:
    """All qualifying runs of the words, by start, then period."""
    known: dict = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    if len(ids) < LEAST:
        return []
    return sorted(Run(begin + r.start, r.length, r.period) for begin, end in survivors(ids) for r in lag_scan(ids[begin:end]))


def collapse(words: list, runs: list[Run]) -> list:
    """The words without those that a run repeats, i.e. after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for r in runs:
        edge[r.start + r.period] += 1
        edge[r.start + r.length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def plant(words: list, doc_id: int | None) -> list:
    """The words, of every tenth document with a periodic tail: h is the crc32 of the id
    as decimal text (a null id: as empty text)."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail, times = words[a : a + p], -(-(n - a) // p)
    return words[:a] + (tail * times)[: n - a]


def word_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", planted: bool = False) -> DataFrame:
    """doc_id, ``runs`` (start, length, period; by start, then period) and ``collapsed``
    (the kept words joined by one blank) of every row, one row each.

    A null, empty or blank text has no words, no runs and an empty ``collapsed``. Rows are
    independent: repeated rows and repeated or null ids give a row each, an empty table
    none, and columns of the input named like the results do no harm. A text of any length
    is taken whole, in one task; its memory is a few hundred bytes a word.
    """
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches):
        for b in slices(batches, "text"):
            found, left = [], []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                words = text.split() if text else []
                if planted:
                    words = plant(words, doc_id)
                runs = runs_of(words)
                found.append([r._asdict() for r in runs])
                left.append(b" ".join(collapse(words, runs)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(kind)), pa.array(left, pa.binary())], names=["doc_id", "runs", "collapsed"])

    rows = df.select(qcol(id_col).cast("long").alias("doc_id"), qcol(text_col).cast("string").alias("text"))
    out = map_arrow(rows, run, "doc_id bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed binary")
    return out.selectExpr("doc_id", "runs", "cast(collapsed as string) collapsed")


def op12_word_runs(documents: DataFrame) -> DataFrame:
    """The longest run of every document and the digests of all its runs and kept words."""
    from pyspark.sql import functions as F

    found = word_runs(documents, planted=True)
    first = F.array_sort("runs", lambda x, y: F.when(x["length"] != y["length"], F.signum(y["length"] - x["length"])).when(x["start"] != y["start"], F.signum(x["start"] - y["start"])).otherwise(F.signum(x["period"] - y["period"])).cast("int"))
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n")))))
    top = found.withColumn("top", F.get(first, F.lit(0)))
    return top.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("top.start").alias("start"),
        F.col("top.length").alias("length"),
        F.col("top.period").alias("period"),
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
