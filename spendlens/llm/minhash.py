"""Near-duplicate groups by SuperMinHash.

An element's ranks are one random permutation of the signature's places: in round i it
bids i plus a random fraction for its i-th place, and a place keeps its least bid. Bids
of different places are correlated, which lowers the estimate's variance, and a text
stops as soon as every place is taken, since later rounds only bid more.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.llm.common import U64, id_text, map_arrow, mix64, shingle_hashes, slices, staged, utf8, word_hashes

WIDTH = 5
_STEP = 0x9E3779B97F4A7C15


class Search(NamedTuple):
    """What counts as near, and how it is looked for. Links: percent * union <= 100 *
    intersection. A pair at the threshold shares none of the bands with a chance of at most
    10^-6. Signatures that agree on a smaller share of places than ``estimate`` are not
    verified (six standard errors below the threshold)."""

    percent: int
    bands: int
    rows: int
    estimate: float

    @property
    def places(self) -> int:
        return self.bands * self.rows


AT_85 = Search(85, 36, 7, 0.70)
AT_80 = Search(80, 36, 5, 0.62)
# Members of a bucket that are compared in one group; larger buckets are compared block by block.
BLOCK = 1024
# A key with a share of all rows above 1 / HOT is joined by broadcast: fewer than HOT keys are.
HOT = 4096
# Hash values that a filter before a shuffle tells apart.
FILTER = 1 << 18


def distinct_elements(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's different hashes, ascending, and how many it has."""
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return h[new], np.bincount(o[new], minlength=len(counts))


def signatures(elements: np.ndarray, counts: np.ndarray, places: int = AT_85.places) -> np.ndarray:
    """One row of ``places`` bytes a text: eight random bits of each place's least bid.
    A text without elements has a row of zeros."""
    n = len(counts)
    none = U64(0xFFFFFFFFFFFFFFFF)
    least = np.full(n * places, none, U64)
    h, owner = elements, np.repeat(np.arange(n), counts)
    taken: np.ndarray | None = None  # each element's permutation so far
    for i in range(places):
        state = mix64(h + U64((_STEP * (i + 1)) & 0xFFFFFFFFFFFFFFFF))
        pick = (i + (((state & U64(0xFFFFFFFF)) * U64(places - i)) >> U64(32))).astype(np.int64)
        if i == 0:
            place = pick
        else:
            if taken is None:  # the first round swapped place 0 with its pick
                taken = np.tile(np.arange(places, dtype=np.uint8 if places <= 256 else np.uint16), (len(h), 1))
                row = np.arange(len(h))
                taken[row, first] = 0
                taken[row, 0] = first
            row = np.arange(len(h))
            place = taken[row, pick].astype(np.int64)
            taken[row, pick] = taken[row, i]
        bid = U64(i) << U64(48) | state >> U64(16)
        np.minimum.at(least, owner * places + place, bid)
        waiting = (least.reshape(n, places) == none).any(axis=1)
        keep = waiting[owner]
        if not keep.any():
            break
        if i == 0:
            first = pick[keep]
        h, owner = h[keep], owner[keep]
        if taken is not None and not keep.all():
            taken = taken[keep]
    out = (mix64(least) & U64(255)).astype(np.uint8).reshape(n, places)
    out[counts == 0] = 0
    return out


def shingle_sets(b: pa.RecordBatch, at: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The different shingles of each text of the batch, and how many it has."""
    return distinct_elements(*shingle_hashes(*word_hashes(*utf8(b.column(at)), lower=True), width))


def summaries(docs: DataFrame, width: int, places: int) -> DataFrame:
    """doc_id, n_shingles, set_key (128 bits that stand for the set), sig, one row a document."""

    def run(batches):
        # an element's permutation takes a byte a place: small slices
        for b in slices(batches, "text", 1 << 20):
            elements, counts = shingle_sets(b, 1, width)
            ends = np.cumsum(counts)
            keys = []
            for salt in (0x1234567, 0x89ABCDEF):
                total = np.concatenate([np.zeros(1, U64), np.cumsum(mix64(elements ^ U64(salt)), dtype=U64)])
                keys.append(total[ends] - total[ends - counts])
            pair = np.stack(keys, axis=1).astype("<u8")
            sig = signatures(elements, counts, places)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(counts.astype(np.int64)), pa.array([r.tobytes() for r in pair], pa.binary()), pa.array([r.tobytes() for r in sig], pa.binary())],
                names=["doc_id", "n_shingles", "set_key", "sig"],
            )

    return map_arrow(docs, run, "doc_id bigint, n_shingles bigint, set_key binary, sig binary")


def maybe_in(big: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """``big`` without most rows whose key is not in ``small``: a table of at most FILTER
    hash values of the keys is broadcast. Whatever the sizes, no row of a key in it goes."""
    part = F.pmod(F.xxhash64(key), F.lit(FILTER))
    return big.withColumn("_part", part).join(F.broadcast(small.select(part.alias("_part")).distinct()), "_part", "left_semi").drop("_part")


def sets_of(docs: DataFrame, ids: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, elements) for the documents in ``ids`` (doc_id), and maybe some others:
    texts that cannot be among them are left out before they are read whole."""
    near = maybe_in(docs, ids, "doc_id").select("doc_id", "text")

    def run(batches):
        for b in slices(batches, "text"):
            elements, counts = shingle_sets(b, 1, width)
            ends = np.cumsum(counts)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([elements[e - n : e].tobytes() for e, n in zip(ends, counts, strict=True)], pa.binary())], names=["doc_id", "elements"])

    return map_arrow(near, run, "doc_id bigint, elements binary")


def join_hot(big: DataFrame, small: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Inner join of ``big`` with ``small``, which has each key once and, in ``count``, how
    many rows of ``big`` have it. Keys above ``total / HOT`` rows, fewer than HOT, are
    broadcast, so that no task receives all rows of a frequent key."""
    hot = small.filter(F.col(count) * HOT > total)
    cold = small.filter(F.col(count) * HOT <= total)
    # the rows are a few numbers wide, so all others are dealt: the same plan at every size
    rest = big.join(F.broadcast(hot.select(key)), key, "left_anti")
    return big.join(F.broadcast(hot), key).unionByName(rest.join(cold, key))


def _band_keys(near: Search):
    return F.transform(F.sequence(F.lit(0), F.lit(near.bands - 1)), lambda b: F.xxhash64(b, F.substring(F.col("sig"), b * near.rows + 1, F.lit(near.rows))))


def banded(reps: DataFrame, near: Search, *columns: str) -> DataFrame:
    """One row for each band of each signature: key and the columns."""
    return reps.select(*columns, F.explode(_band_keys(near)).alias("key"))


def overlap(a: bytes, b: bytes, percent: int) -> bool:
    x, y = np.frombuffer(a, U64), np.frombuffer(b, U64)
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def star_links(docs: DataFrame, pairs: DataFrame, width: int, near: Search) -> DataFrame:
    """The pairs (hub, doc_id) whose full sets are similar enough.

    Members of a hub are dealt by a salt, and the hub's set goes to each salt in use:
    never more copies of it than pairs, and no task with all members of a large group.
    """
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(64)).cast("int"))
    roles = salted.select("hub", "salt", F.lit(1).alias("role"), "doc_id").union(salted.select("hub", "salt").distinct().select("hub", "salt", F.lit(0).alias("role"), F.col("hub").alias("doc_id")))
    roles = staged(roles, "near-roles")
    rows = roles.join(sets_of(docs, roles.select("doc_id"), width), "doc_id").select("hub", "salt", "role", "doc_id", "elements")
    rows = rows.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "role")

    def run(batches):
        group, hubs = None, []
        for b in batches:
            found = []
            for hub, salt, role, doc, elements in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (hub, salt) != group:
                    group, hubs = (hub, salt), []
                if role == 0:
                    hubs.append(elements)
                elif any(overlap(h, elements, near.percent) for h in hubs):
                    found.append((hub, doc))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return map_arrow(rows, run, "a bigint, b bigint")


def _groups(batches, n_keys: int):
    """Rows of sorted batches, group by group of equal first ``n_keys`` columns."""
    key, rows = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[:n_keys] != key:
                if rows:
                    yield rows
                key, rows = row[:n_keys], []
            rows.append(row)
    if rows:
        yield rows


def _compare(rows: list[tuple], near: Search) -> list[tuple[float, int, int]]:
    """Pairs of a group (key, i, j, block, comp, doc_id, n, sig, ...) worth verifying: of
    different components, similar by estimate and size, in their first shared band (so
    that each pair is looked at in one bucket), and not both of one block if i <> j."""
    i, j = rows[0][1], rows[0][2]
    sig = np.frombuffer(b"".join(r[7] for r in rows), np.uint8).reshape(len(rows), near.places)
    comp, n, block = (np.array([r[k] for r in rows]) for k in (4, 6, 3))
    band = rows[0][8]
    out = []
    for k in range(len(rows) - 1):
        rest = slice(k + 1, None)
        ok = comp[rest] != comp[k]
        if i != j:
            ok &= block[rest] != block[k]
        ok &= 100 * np.minimum(n[rest], n[k]) >= near.percent * np.maximum(n[rest], n[k])
        at = np.flatnonzero(ok) + k + 1
        if not len(at):
            continue
        same = sig[at] == sig[k]
        like = same.mean(axis=1)
        first = same.reshape(len(at), near.bands, near.rows).all(axis=2).argmax(axis=1)
        hit = (like >= near.estimate) & (first == band)
        out += [(-float(like[x]), k, int(at[x])) for x in np.flatnonzero(hit)]
    return sorted(out)


def cross_links(docs: DataFrame, reps: DataFrame, width: int, near: Search, block: int = BLOCK) -> DataFrame:
    """Links (a, b: component ids) between documents of different components that share
    a bucket. ``reps``: doc_id, n, sig, comp.

    Buckets of one component are done. In the others every pair of different components
    is looked at, in groups of at most two blocks of ``block`` members, first by
    signature; only members with such a partner are then fetched and verified on their
    full sets. Groups return links and members, never their pairs.
    """
    every = banded(reps, near, "doc_id", "comp")
    keys = staged(every.groupBy("key").agg(F.count("*").alias("c"), F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("key", "c"), "near-mixed")
    total = keys.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    if not total:
        return docs.sparkSession.createDataFrame([], "a bigint, b bigint")
    # signatures join the few rows of mixed buckets only
    narrow = reps.select("doc_id", F.posexplode(_band_keys(near)).alias("band", "key"))
    rows = join_hot(narrow, keys, "key", "c", total).join(reps, "doc_id").withColumn("blocks", F.ceil(F.col("c") / block).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "comp", "doc_id", "n", "sig", "band")
    order = ["key", "i", "j"]

    def members(batches):
        for group in _groups(batches, 3):
            hit = sorted({x for _, a, b in _compare(group, near) for x in (a, b)})
            if hit:
                yield pa.RecordBatch.from_arrays([pa.array([group[h][c] for h in hit], t) for c, t in zip(range(9), kinds, strict=True)], names=names)

    names = ["key", "i", "j", "block", "comp", "doc_id", "n", "sig", "band"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32()]
    schema = "key bigint, i int, j int, block int, comp bigint, doc_id bigint, n bigint, sig binary, band int"
    worth = staged(map_arrow(rows.repartition(*order).sortWithinPartitions(*order, "doc_id"), members, schema), "near-members")
    full = worth.join(sets_of(docs, worth.select("doc_id"), width), "doc_id").select(*names, "elements")

    def verify(batches):
        for group in _groups(batches, 3):
            root = {r[4]: r[4] for r in group}

            def find(x):
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            found = []
            for _, a, b in _compare(group, near):
                x, y = find(group[a][4]), find(group[b][4])
                if x != y and overlap(group[a][9], group[b][9], near.percent):
                    root[max(x, y)] = min(x, y)
                    found.append((group[a][4], group[b][4]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return map_arrow(full.repartition(*order).sortWithinPartitions(*order, "doc_id"), verify, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node of each component, for every node that is not its own
    root. Distributed union-find: nodes point to the least node that they or a neighbour
    know, larger neighbours and own pointers in turn, until no pointer moves. Each half
    step is a written table, and a node's links never meet in one group."""
    now = staged(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "near-links")
    mark = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = staged(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "near-least")
        larger = staged(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct(), "near-larger")
        least = staged(larger.groupBy("a").agg(F.min("b").alias("m")), "near-least")
        joined = larger.join(least, "a")
        now = staged(joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct(), "near-links")
        seen = now.agg(F.count("*"), F.coalesce(F.sum(F.hash("a", "b").cast("bigint")), F.lit(0))).first()
        if tuple(seen) == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = tuple(seen)


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, near: Search = AT_85) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id reachable by links) a row.

    Documents with equal sets are one class, stood for by its least id. A null, empty or
    blank text has no shingles and is linked with nothing. Rows of one id are one
    document: their links are pooled. A row without id is linked with nothing and has no
    component. An empty table gives an empty one.
    """
    docs = id_text(df, id_col, text_col)
    known = staged(summaries(docs, width, near.places), "near-summaries")
    linked = known.filter("n_shingles > 0 and doc_id is not null")
    classes = staged(linked.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")), "near-classes")
    # one row a class and, of documents with one id but several texts, one row a text
    stand = classes.select("set_key", F.col("rep").alias("doc_id"))
    reps = linked.join(stand, ["set_key", "doc_id"]).dropDuplicates(["set_key"]).select("doc_id", F.col("n_shingles").alias("n"), "sig")
    reps = staged(reps, "near-reps")

    rows = banded(reps, near, "doc_id")
    hubs = staged(rows.groupBy("key").agg(F.min("doc_id").alias("hub"), F.count("*").alias("c")).filter("c > 1"), "near-hubs")
    total = hubs.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    stars = staged(join_hot(rows, hubs, "key", "c", total).filter("doc_id <> hub").select("hub", "doc_id").distinct(), "near-stars")
    first = components(star_links(docs, stars, width, near))
    # links of documents that have one id join their classes by themselves
    marked = staged(reps.join(first.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("comp", F.coalesce("root", "doc_id")).drop("root"), "near-marked")
    second = components(cross_links(docs, marked, width, near))
    root = marked.select("doc_id", "comp").distinct().join(second.withColumnRenamed("node", "comp"), "comp", "left").select(F.col("doc_id").alias("rep"), F.coalesce("root", "comp").alias("component_id"))
    named = classes.join(root, "rep").select("set_key", "component_id", "c")
    total = linked.count()
    out = join_hot(linked.drop("sig"), named, "set_key", "c", total).select("doc_id", "n_shingles", "component_id")
    alone = known.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.union(alone)


def op5_near_duplicates(documents: DataFrame) -> DataFrame:
    """Component of every document; the least id of each stays."""
    out = near_groups(documents, near=AT_85)
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
