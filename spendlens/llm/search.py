"""Ranked lexical search over per-term geometric blocks.

For a bounded block of items (queries) every document becomes a vector over the items'
terms (a forward index, written as a table). Tasks then take the vectors in segments of a
bounded size and build each segment's inverted index: a term's posting list is cut into
blocks of similar documents (one round of k-means on sketches of their vectors, with
members of the list as centres), and each block stores the coordinatewise maximum of its
vectors. An item's score in any document of a block is at most its product with that
summary, in the same integers as the score. A block is skipped only if that bound lies
below the item's least score so far; everything else is scored exactly, so results are
those of a full scan.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendlens._compat import qcol
from spendlens.llm.common import TERM_BYTE, U64, map_arrow, mix64, slices, staged, utf8, word_hashes

# Different terms, and items, of one block of items; more are another pass. A single item
# with more terms is a block of its own.
TERMS = 1 << 13
ITEMS = 1 << 12
# Cells (documents x terms) of one segment, and documents of it, at most.
CELLS = 1 << 24
SEGMENT = 2048
# Members of a posting list that share a summary, about.
BLOCK = 16
# Width of the sketches that posting lists are clustered by.
SKETCH = 32
# Groups that the tasks' rankings are merged in first, so that no task gets all of them.
MERGE = 256
NO_ID = np.iinfo(np.int64).max
TERM_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Query(NamedTuple):
    """An item of a block: its number there and the numbers of its terms."""

    item: int
    terms: np.ndarray


class Posting(NamedTuple):
    members: np.ndarray  # the list's documents, block after block
    block: np.ndarray  # the block of each
    terms: np.ndarray  # terms that occur in any of them
    summary: np.ndarray  # maximum over a block's documents, by block and term


def term_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes(*utf8(texts), lower=True, inside=TERM_BYTE)


# ------------------------------------------------------------------ items


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, terms): the different terms of each item, all rows of an id together. Only
    A-Z are folded; an item without terms has an empty list."""
    found = F.regexp_extract_all(F.translate(F.coalesce(qcol(text_col), F.lit("")), UPPER, LOWER), F.lit(TERM_PATTERN), F.lit(0))
    rows = items.select(qcol(id_col).alias("item_id"), F.array_distinct(found).alias("t"))
    return rows.groupBy("item_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("t")))).alias("terms"))


def item_blocks(terms: DataFrame, most: int = TERMS) -> Iterator[tuple[list, list[str], list[Query]]]:
    """Blocks of items, each with at most ``most`` different terms (one item at least):
    their ids, their terms, and the queries. The driver holds one block at a time."""
    ids, known, queries = [], {}, []
    for row in terms.filter(F.size("terms") > 0).orderBy("item_id").toLocalIterator():
        new = [t for t in row.terms if t not in known]
        if ids and (len(known) + len(new) > most or len(ids) >= ITEMS):
            yield ids, list(known), queries
            ids, known, queries = [], {}, []
        ids.append(row.item_id)
        queries.append(Query(len(ids) - 1, np.array([known.setdefault(t, len(known)) for t in row.terms], np.int64)))
    if ids:
        yield ids, list(known), queries


# ---------------------------------------------------------------- documents


def forward_index(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(doc_id, n, terms, counts) of every document with a term at all: how many terms it
    has with repeats, and which of the vocabulary how often (little-endian 32-bit)."""
    hashes = term_hashes(pa.array(vocabulary, pa.string()))[0]
    order = np.argsort(hashes)
    ordered = hashes[order]

    def run(batches):
        for b in slices(batches, "text"):
            h, n = term_hashes(b.column(1))
            owner = np.repeat(np.arange(b.num_rows), n)
            at = np.minimum(np.searchsorted(ordered, h), len(ordered) - 1) if len(ordered) else np.zeros(len(h), np.int64)
            hit = ordered[at] == h if len(ordered) else np.zeros(len(h), bool)
            key, count = np.unique(owner[hit] * np.int64(1 << 32) + order[at[hit]], return_counts=True)
            edge = np.searchsorted(key >> 32, np.arange(b.num_rows + 1))
            terms, counts = (key & 0xFFFFFFFF).astype("<u4"), count.astype("<u4")
            some = np.flatnonzero(n > 0)
            cut = [slice(edge[k], edge[k + 1]) for k in some]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(some)), pa.array(n[some].astype(np.int64)), pa.array([terms[c].tobytes() for c in cut], pa.binary()), pa.array([counts[c].tobytes() for c in cut], pa.binary())],
                names=["doc_id", "n", "terms", "counts"],
            )

    return map_arrow(docs, run, "doc_id bigint, n bigint, terms binary, counts binary")


def term_weights(forward: DataFrame, n_terms: int) -> tuple[np.ndarray, int, int]:
    """Each term's weight, and the documents and terms in all. Tasks send one row a term
    (and one for the totals); the driver gets as many rows, summed."""

    def run(batches):
        found, docs, total = np.zeros(n_terms, np.int64), 0, 0
        for b in batches:
            docs += b.num_rows
            total += int(np.sum(b.column(0).to_numpy(zero_copy_only=False)))
            for t in b.column(1).to_pylist():
                found[np.frombuffer(t, "<u4")] += 1
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([at, [-1, -2]])), pa.array(np.concatenate([found[at], [docs, total]]))], names=["term", "n"])

    sums = {r.term: r.n for r in map_arrow(forward.select("n", "terms"), run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    docs, total = sums.pop(-1, 0), sums.pop(-2, 0)
    return np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * sums.get(t, 0) + 1))) for t in range(n_terms)], np.int64), docs, total


# ------------------------------------------------------------------ segments


class Segment:
    """The inverted index of some documents: for every term its blocks and summaries.

    ``share``: by document and term, the part of a score that the term's weight multiplies.
    """

    def __init__(self, ids: np.ndarray, share: np.ndarray, weight: np.ndarray, block: int = BLOCK):
        self.ids, self.share, self.weight = ids, share, weight
        doc, term = np.nonzero(share)
        value = share[doc, term]
        edge = np.searchsorted(doc, np.arange(len(ids) + 1))
        self._rows = term, value, edge
        self.postings: dict[int, Posting] = {}
        if not len(doc):
            return
        sketch = self._sketches()
        by_term = np.argsort(term, kind="stable")
        cut = np.flatnonzero(np.diff(term[by_term])) + 1
        for begin, end in zip([0, *cut], [*cut, len(doc)], strict=True):
            self.postings[int(term[by_term[begin]])] = self._posting(doc[by_term[begin:end]], sketch, block)

    def _sketches(self) -> np.ndarray:
        """Unit vectors whose products estimate those of the documents' vectors: signed
        sums of the impacts, the signs drawn from the terms' numbers."""
        term, value, edge = self._rows
        bits = mix64(np.arange(1, len(self.weight) + 1, dtype=U64))
        signs = ((bits[:, None] >> np.arange(SKETCH, dtype=U64)) & U64(1)).astype(np.float32) * 2 - 1
        signs *= self.weight[:, None].astype(np.float32)
        out = np.zeros((len(self.ids), SKETCH), np.float32)
        full = np.flatnonzero(np.diff(edge))
        for begin in range(0, len(full), 256):  # the products of some documents at a time
            rows = full[begin : begin + 256]
            part = slice(edge[rows[0]], edge[rows[-1] + 1])
            out[rows] = np.add.reduceat(signs[term[part]] * value[part, None].astype(np.float32), edge[rows] - edge[rows[0]])
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-20)

    def _posting(self, members: np.ndarray, sketch: np.ndarray, block: int) -> Posting:
        term, value, edge = self._rows
        k = -(-len(members) // block)
        cut = np.zeros(0, np.int64)
        if k > 1:
            centres = members[np.arange(k) * len(members) // k]
            nearest = np.argmax(sketch[members] @ sketch[centres].T, axis=1)
            order = np.argsort(nearest, kind="stable")
            members, cut = members[order], np.flatnonzero(np.diff(nearest[order])) + 1
        size = edge[members + 1] - edge[members]
        at = np.repeat(edge[members] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        inside = np.zeros(len(self.weight), bool)
        inside[term[at]] = True
        terms = np.flatnonzero(inside)
        column = (np.cumsum(inside) - 1)[term[at]]
        of_block = np.zeros(len(members), np.int64)
        of_block[cut] = 1
        of_block = np.cumsum(of_block)
        summary = np.zeros((len(cut) + 1, len(terms)), self.share.dtype)
        np.maximum.at(summary.reshape(-1), np.repeat(of_block, size) * len(terms) + column, value[at])
        return Posting(members, of_block, terms, summary)

    def bounds(self, posting: Posting, query: Query) -> np.ndarray:
        """What the item can score in any document of each block, at most."""
        at = np.minimum(np.searchsorted(posting.terms, query.terms), len(posting.terms) - 1)
        there = posting.terms[at] == query.terms
        return posting.summary[:, at[there]].astype(np.int64) @ self.weight[query.terms[there]]

    def search(self, query: Query, top: Top, tally: list[int] | None = None) -> None:
        """Put the segment's documents that belong there into the item's ``top``. ``tally``
        counts blocks looked up and blocks skipped."""
        seen = np.zeros(len(self.ids), bool)
        weight = self.weight[query.terms]
        for t in query.terms[np.argsort(-weight, kind="stable")]:  # rare terms first: they raise the least score
            posting = self.postings.get(int(t))
            if posting is None:
                continue
            bound = self.bounds(posting, query)
            # the most promising block first, so that the others meet a higher least score
            first = np.arange(len(bound)) == np.argmax(bound)
            for part in (first, ~first):
                open_ = part & (bound >= top.least)
                if tally is not None:
                    tally[0] += int(part.sum())
                    tally[1] += int(part.sum() - open_.sum())
                docs = posting.members[open_[posting.block]]
                docs = docs[~seen[docs]]
                if len(docs):
                    seen[docs] = True
                    top.add(self.share[docs[:, None], query.terms].astype(np.int64) @ weight, self.ids[docs])


class Top:
    """The k best (score, id) of an item so far; equal scores by ascending id."""

    def __init__(self, k: int):
        self.k, self.score, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """Scores below this are of no use."""
        return max(1, int(self.score[-1])) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        good = score >= self.least
        if not good.any():
            return
        score, ids = np.concatenate([self.score, score[good]]), np.concatenate([self.ids, ids[good]])
        best = np.lexsort((ids, -score))[: self.k]
        self.score, self.ids = score[best], ids[best]


def shares(n: list[int], counts: np.ndarray, docs: int, total: int) -> np.ndarray:
    """The part of a score that a term's weight multiplies, by document and term: at most
    10^6. ``n``: terms of each document; ``counts``: occurrences."""
    m = np.array([50 + 50 * x * docs // max(total, 1) for x in n], np.int64)
    out = np.zeros(counts.shape, np.int32)
    doc, term = np.nonzero(counts)
    tf = counts[doc, term].astype(np.int64)
    out[doc, term] = 1_000_000_000 * tf // (1000 * tf + 20 * m[doc])
    return out


def search_segments(forward: DataFrame, queries: list[Query], weight: np.ndarray, docs: int, total: int, k: int, segment: int, block: int) -> DataFrame:
    """(item, doc_id, score): the k best of each task, its segments one after the other."""
    width = len(weight)
    most = max(1, min(segment, CELLS // max(width, 1)))

    def read(batches):
        ids, n, counts = [], [], np.zeros((most, width), np.uint32)
        for b in batches:
            for doc_id, size, terms, count in zip(*(c.to_pylist() for c in b.columns), strict=True):
                counts[len(ids), np.frombuffer(terms, "<u4")] = np.frombuffer(count, "<u4")
                ids.append(NO_ID if doc_id is None else doc_id)
                n.append(size)
                if len(ids) == most:
                    yield ids, n, counts
                    ids, n = [], []
                    counts[:] = 0
        if ids:
            yield ids, n, counts[: len(ids)]

    def run(batches):
        tops = [Top(k) for _ in queries]
        for ids, n, counts in read(batches):
            index = Segment(np.array(ids, np.int64), shares(n, counts, docs, total), weight, block)
            for query, top in zip(queries, tops, strict=True):
                index.search(query, top)
        for begin in range(0, len(queries), 256):
            part = range(begin, min(begin + 256, len(queries)))
            ids = np.concatenate([tops[q].ids for q in part])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat([queries[q].item for q in part], [len(tops[q].ids) for q in part]).astype(np.int32)),
                    pa.array(ids, mask=ids == NO_ID),
                    pa.array(np.concatenate([tops[q].score for q in part])),
                ],
                names=["item", "doc_id", "score"],
            )

    # documents without a term of any item are in no posting list
    some = forward.filter(F.octet_length("terms") > 0)
    return map_arrow(some, run, "item int, doc_id bigint, score bigint")


def best(found: DataFrame, k: int) -> DataFrame:
    """``found`` with the rank of each item's k best rows; merged in groups first, so that
    no task receives what all tasks found for an item."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    part = F.pmod(F.xxhash64("doc_id", "score"), F.lit(MERGE))
    some = found.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).filter(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k).drop("part")


def ranked_search(
    documents: DataFrame,
    items: DataFrame,
    k: int = 50,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    segment: int = SEGMENT,
    block: int = BLOCK,
) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` best documents with a score above 0.

    Every row of ``documents`` is ranked (repeated rows and ids too, each by itself); equal
    scores rank by ascending doc_id, a null doc_id last. Null and empty texts have no terms
    and count nowhere. Rows of one item_id are one item with all their terms; items without
    terms have no rows. Texts of any length are read whole. Empty tables give no rows.
    Other columns are not read.
    """
    spark = documents.sparkSession
    docs = documents.select(qcol(id_col).cast("long").alias("doc_id"), F.coalesce(qcol(text_col).cast("string"), F.lit("")).alias("text"))
    terms = item_terms(items, item_col, item_text)
    out = None
    for ids, vocabulary, queries in item_blocks(terms):
        forward = staged(forward_index(docs, vocabulary), "search-forward")
        weight, n, total = term_weights(forward, len(vocabulary))
        ranked = best(search_segments(forward, queries, weight, n, total, k, segment, block), k)
        # at most ITEMS names
        names = spark.createDataFrame(list(enumerate(ids)), "item int, item_id " + terms.schema["item_id"].dataType.simpleString())
        part = ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = part if out is None else out.union(part)
    return out if out is not None else terms.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("bigint").alias("doc_id"), F.lit(0).cast("bigint").alias("score")).filter("false")


def op11_ranked_search(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The 50 best documents of every item."""
    return ranked_search(documents, benchmark)
