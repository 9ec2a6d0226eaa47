"""Best-fit packing by a linear grouping scheme.

Lengths are whole numbers from 1 to the sequence length, so the packing problem is its
histogram: at most ``capacity`` counts, however many documents there are. The histogram
is solved once (grouped large lengths, configurations of few sizes, small lengths by
best fit); every piece then takes the place that its rank among pieces of equal length
has in that solution. Texts and pieces stay on the executors.
"""

from __future__ import annotations

import os
import re
import zlib
from struct import pack

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendlens.llm.byte_bpe import byte_chars
from spendlens.llm.common import id_text, map_arrow, slices, staged, utf8, word_spans

# Words whose ids a worker keeps; beyond it the store starts anew.
KEPT_WORDS = 500_000
# Groups of equal cardinality that large lengths are rounded up in.
GROUPS = 96
# Lengths above this share of a sequence are large. Rounding wastes room that only small
# lengths can fill, so most lengths are left to best fit: on 8,000 pieces, whose bound is
# 2,538 sequences, a share of 1/6 takes 2,573, of 1/3 2,565, of 0.45 2,540.
LARGE = 0.45
# Parts that the pieces of one length are numbered in.
PARTS = 32
# Words that normalizer and pattern treat alike in any Unicode version: Latin letters up to
# U+024F (but U+0130, which lower-cases to two characters) and marks after them.
_PLAIN = re.compile(r"([A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u024f]+)([.,!?;:*$%&#]*)")
_SLICE = 6 << 20
_open: dict = {}


class WordIds:
    """Ids of whole texts, word by word: the tokenizer drops white space and neither
    its normalizer nor its merges reach across ASCII white space."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread for each Spark core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.bare = Tokenizer(self.library.model)  # for pre-tokens that are normalised and mapped already
        self.char_of = {b: c for b, c in enumerate(byte_chars()) if chr(b) != c and b != 10}
        self.kept: dict[int, bytes] = {}  # by the word's hash
        self.stems: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {"": b""}

    def _ids(self, words: list[str]) -> list[bytes]:
        """Ids of new words. A plain word is a run of letters and maybe a tail, a pre-token
        each; the run's ids are kept apart from the word, since it comes with many tails."""
        cut = [m.groups() if (m := _PLAIN.fullmatch(w)) else None for w in words]
        stems = list({p[0].lower() for p in cut if p}.difference(self.stems))
        if stems:
            shown = "\n".join(stems).encode().decode("latin-1").translate(self.char_of).split("\n")
            for stem, done in zip(stems, self.bare.encode_batch_fast(shown, add_special_tokens=False), strict=True):
                self.stems[stem] = pack("<%dI" % len(ids := done.ids), *ids)
        other = list({p[1] for p in cut if p}.difference(self.tails).union(w for w, p in zip(words, cut, strict=True) if not p))
        done = {}
        if other:
            for word, x in zip(other, self.library.encode_batch_fast(other, add_special_tokens=False), strict=True):
                done[word] = pack("<%dI" % len(x.ids), *x.ids)
            self.tails.update((p[1], done[p[1]]) for p in cut if p and p[1] in done)
        return [self.stems[p[0].lower()] + self.tails[p[1]] if p else done[w] for w, p in zip(words, cut, strict=True)]

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in order, and where each text's ids end."""
        if len(self.kept) > KEPT_WORDS:
            self.kept, self.stems, self.tails = {}, {}, {"": b""}
        starts, ends, raw = utf8(texts)
        hashes, counts, begin, stop = word_spans(starts, ends, raw, lower=True)
        own, first, at = np.unique(hashes, return_index=True, return_inverse=True)
        own = own.tolist()
        found = list(map(self.kept.get, own))
        new = [k for k, x in enumerate(found) if x is None]
        data = raw.tobytes() if new else b""
        spans = zip(begin[first[new]].tolist(), stop[first[new]].tolist(), strict=True)
        for k, ids in zip(new, self._ids([data[a:b].decode() for a, b in spans]), strict=True):
            found[k] = self.kept[own[k]] = ids
        n = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat, place = np.frombuffer(b"".join(found), "<u4"), np.cumsum(n) - n
        many = n[at]
        after = np.concatenate([np.zeros(1, np.int64), np.cumsum(many)])
        ids = flat[np.repeat(place[at] - after[:-1], many) + np.arange(after[-1])]
        return ids, after[np.cumsum(counts)]

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, ends = self.encode_array(pa.array(texts, pa.string()))
        return [x.tobytes() for x in np.split(ids, ends[:-1])] if texts else []


def _words(path: str) -> WordIds:
    if path not in _open:
        _open[path] = WordIds(path)
    return _open[path]


def pieces(df: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = _SLICE) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32.

    A document is its text's ids and ``end_id``, so a null or empty text has one piece
    of length 1. Only documents longer than ``capacity`` are cut, every ``capacity``
    ids. Repeated rows have pieces of their own. A worker takes ``slice_bytes`` of text at
    a time, and some sixty times as many of memory.
    """

    def run(batches):
        tool, end = _words(path), pack("<I", end_id)
        for b in slices(batches, "text", slice_bytes):
            ids, ends = tool.encode_array(b.column(1))
            rows: list[tuple] = []
            for doc, a, z in zip(b.column(0).to_pylist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                text = ids[a:z].tobytes() + end
                for k in range(0, len(text), 4 * capacity):
                    part = text[k : k + 4 * capacity]
                    rows.append((doc, k // (4 * capacity), k // 4, len(part) // 4, zlib.crc32(part)))
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return map_arrow(id_text(df, id_col, text_col), run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


# ------------------------------------------------------------- the histogram's packing


def group_up(counts: np.ndarray, large: int, groups: int) -> np.ndarray:
    """The rounded-up length of each length above ``large``: lengths in order are dealt
    into groups of (as near as whole lengths allow) equal cardinality, and a group's
    lengths round up to its longest."""
    up = np.zeros(len(counts), np.int64)
    lengths = np.flatnonzero(counts[large + 1 :]) + large + 1
    if not len(lengths):
        return up
    at = np.cumsum(counts[lengths])
    group = np.minimum((at - 1) * groups // at[-1], groups - 1)
    for g in np.unique(group):
        own = lengths[group == g]
        up[own] = own[-1]
    return up


def _best_pattern(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes within the capacity that is worth most (unbounded knapsack)."""
    value, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(int(sizes.min()), capacity + 1):
        value[c], choice[c] = value[c - 1], -1
        fits = sizes <= c
        got = value[c - sizes[fits]] + worth[fits]
        k = int(np.argmax(got))
        if got[k] > value[c] + 1e-12:
            value[c], choice[c] = got[k], int(np.flatnonzero(fits)[k])
    pattern, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            pattern[choice[c]] += 1
            c -= sizes[choice[c]]
    return float(value[capacity]), pattern


def configurations(sizes: np.ndarray, need: np.ndarray, capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """Configurations (how many of each size share a sequence) and how often each is used,
    covering ``need``: the fractional optimum by column generation, rounded down, and
    what is left filled pattern by pattern in the order of the sizes, longest first."""
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))  # a column a pattern; at first one size each
    use = need / np.diag(basis)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        worth = inverse.sum(axis=0)  # the dual prices: all patterns cost 1
        value, pattern = _best_pattern(sizes, worth, capacity)
        if value <= 1 + 1e-9:
            break
        step = inverse @ pattern
        ok = step > 1e-9
        ratio = np.full(k, np.inf)
        ratio[ok] = use[ok] / step[ok]
        out = int(np.argmin(ratio))
        use = np.maximum(use - ratio[out] * step, 0)
        use[out] = ratio[out]
        basis[:, out] = pattern
    left = need.astype(np.int64).copy()
    plan = []
    for j in np.argsort(-use):
        pattern = np.rint(basis[:, j]).astype(np.int64)
        times = int(use[j] + 1e-9)
        own = pattern > 0
        times = min(times, int((left[own] // pattern[own]).min())) if own.any() else 0
        if times > 0:
            plan.append((pattern, times))
            left -= pattern * times
    while left.any():  # at most a few sequences for each configuration
        pattern, room = np.zeros(k, np.int64), capacity
        for j in range(k - 1, -1, -1):  # sizes ascend
            n = min(int(left[j]), room // int(sizes[j]))
            pattern[j], room = n, room - n * int(sizes[j])
        own = pattern > 0
        times = max(1, int((left[own] // pattern[own]).min()))
        plan.append((pattern, times))
        left -= pattern * times
    return plan


def solve(counts: np.ndarray, capacity: int, groups: int = GROUPS, large_share: float = LARGE) -> pd.DataFrame:
    """Places for ``counts[length]`` pieces of each length: rows (length, first, count,
    sequence, each, offset). Piece number ``first + i`` of that length, 0 <= i < count,
    goes to sequence ``sequence + i // each`` at ``offset + length * (i % each)``.

    Large lengths are rounded up in groups and packed by configurations; the actual
    lengths, never longer, take the rounded places, longest first. Small lengths then go
    by best fit, longest first, into the sequence with the least room that takes them.
    Sequences that are alike are one class with a number of copies, so the work follows
    the different lengths, not the pieces. Full lengths need no packing and are left out.
    """
    counts = counts.astype(np.int64).copy()
    counts[capacity:] = 0
    large = int(capacity * large_share)
    rows: list[tuple[int, int, int, int, int, int]] = []
    taken = np.zeros(capacity + 1, np.int64)  # pieces of each length that have places
    by_room: dict[int, list[list[int]]] = {}  # room -> [first sequence, how many]
    used = 0

    def place(length: int, n: int, sequence: int, each: int, offset: int) -> None:
        rows.append((length, int(taken[length]), n, sequence, each, offset))
        taken[length] += n

    up = group_up(counts, large, groups)
    sizes = np.unique(up[up > 0])
    if len(sizes):
        need = np.array([counts[up == s].sum() for s in sizes])
        members = [np.flatnonzero(up == s)[::-1].tolist() for s in sizes]  # longest first
        left = {length: int(counts[length]) for own in members for length in own}
        for pattern, times in configurations(sizes, need, capacity):
            slots = [j for j in range(len(sizes) - 1, -1, -1) for _ in range(int(pattern[j]))]
            parts = [(used, times, 0)]  # sequences alike: (first, how many, filled)
            used += times
            for j in slots:  # substitute actual lengths for the rounded size
                done = []
                for first, n, filled in parts:
                    while n:
                        while not left[members[j][0]]:
                            members[j].pop(0)
                        length = members[j][0]
                        m = min(n, left[length])
                        place(length, m, first, 1, filled)
                        left[length] -= m
                        done.append((first, m, filled + length))
                        first, n = first + m, n - m
                parts = done
            for first, n, filled in parts:
                by_room.setdefault(capacity - filled, []).append([first, n])
    rooms = np.zeros(capacity + 1, bool)
    rooms[list(by_room)] = True
    for length in range(min(large, capacity - 1), 0, -1):
        n = int(counts[length])
        while n:
            fit = np.flatnonzero(rooms[length:])
            if not len(fit):  # open sequences, as full of this length as they get
                each = min(capacity // length, n)
                many = n // each
                place(length, many * each, used, each, 0)
                by_room.setdefault(capacity - each * length, []).append([used, many])
                rooms[capacity - each * length] = True
                used, n = used + many, n - many * each
                continue
            room = length + int(fit[0])
            first, many = by_room[room].pop()
            if not by_room[room]:
                rooms[room] = False
            each = min(room // length, n)
            m = min(many, n // each)
            place(length, m * each, first, each, capacity - room)
            n -= m * each
            rest = room - each * length
            by_room.setdefault(rest, []).append([first, m])
            rooms[rest] = True
            if many > m:
                by_room[room].append([first + m, many - m])
                rooms[room] = True
    return pd.DataFrame(rows, columns=["length", "first", "count", "sequence", "each", "offset"]).sort_values(["length", "first"], ignore_index=True)


def pack_pieces(cut: DataFrame, capacity: int = 2048, groups: int = GROUPS) -> DataFrame:
    """``cut`` (columns doc_id, piece, length and others; read three times, so written
    beforehand) with sequence_id and offset.

    Pieces of one length are numbered in parts, dealt by document, so a length that most
    pieces share (many copies) is many window groups; the offsets of the parts come from
    a table of at most ``capacity * PARTS`` counts. Equal rows get different places.
    """
    keyed = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(PARTS)))
    cells = keyed.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(F.col("length").alias("cell_length"), F.col("part").alias("cell_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"), "n")
    cells = staged(cells, "pack-cells")
    # at most ``capacity`` rows: the histogram
    histogram = cells.groupBy("cell_length").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(capacity + 1, np.int64)
    counts[histogram["cell_length"].to_numpy(np.int64)] = histogram["n"].to_numpy(np.int64)
    plan = solve(counts, capacity, groups)
    full_from = int((plan["sequence"] + (plan["count"] - 1) // plan["each"]).max()) + 1 if len(plan) else 0
    places = {c: plan[c].to_numpy(np.int64) for c in plan}

    own = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = keyed.withColumn("rank", F.row_number().over(own) - 1)
    ranked = ranked.join(cells, (F.col("length") == F.col("cell_length")) & (F.col("part") == F.col("cell_part"))).withColumn("rank", F.col("rank") + F.col("ahead"))
    names = [*cut.columns, "sequence_id", "offset"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema] + ["sequence_id bigint, offset bigint"])
    width = len(cut.columns)

    def run(batches):
        # plan rows by (length, first): a place is found by one binary search
        wide = np.int64(1) << np.int64(48)
        keys = places["length"] * wide + places["first"]
        for b in batches:
            length = b.column(width).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = b.column(width + 1).to_numpy(zero_copy_only=False).astype(np.int64)
            sequence, offset = full_from + rank, np.zeros(len(rank), np.int64)  # full pieces: one each
            short = np.flatnonzero(length < capacity)
            if len(short):
                k = np.searchsorted(keys, length[short] * wide + rank[short], side="right") - 1
                i = rank[short] - places["first"][k]
                sequence[short] = places["sequence"][k] + i // places["each"][k]
                offset[short] = places["offset"][k] + length[short] * (i % places["each"][k])
            yield pa.RecordBatch.from_arrays([*b.columns[:width], pa.array(sequence), pa.array(offset)], names=names)

    return map_arrow(ranked.select(*cut.columns, F.col("length").alias("_length"), F.col("rank").cast("bigint").alias("_rank")), run, schema)


def op4_packing(documents: DataFrame, path: str, capacity: int = 2048, slice_bytes: int = _SLICE) -> DataFrame:
    """All documents in sequences of at most ``capacity`` tokens: one row a piece.
    An empty table has no pieces and no sequences; equal documents are all packed."""
    return pack_pieces(staged(pieces(documents, path, capacity, slice_bytes=slice_bytes), "pack-pieces"), capacity)
