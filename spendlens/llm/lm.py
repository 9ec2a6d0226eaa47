"""Language-model scores by deleted interpolation.

A token's probability mixes three estimates: how often it follows the word before it
(bigram), how often it occurs (unigram), and one over the vocabulary. The weights depend
on how frequent the word before is (buckets by powers of two) and are learned by
expectation-maximisation on the counts of a held-out fold of the training documents,
against the counts of the others; the final estimates use all training documents.

Words are 64-bit hashes. Frequent words (a share of all tokens above 1 / SHARE: fewer
than SHARE of them) and hot pairs (above 1 / PAIR_SHARE) are broadcast and scored where
the text is. All other words and pairs are sent by key to the partition that counts
them, packed in arrays by slices of the texts, and only sums per text come back to the
slice: no key there has more than a small share of the rows. A rare word goes by its hash
with the words before and after it, so itself and its pairs with frequent words are counted
in one place; a rare word after a rare one then goes on, with the counts, to where it is
counted itself. Every context seen in training has a bigram estimate.

Texts are numbered within their slice, in two bytes, and slices by task and place in the
task. The weights and the scores are one query, whose exchanges are reused: what was sent
is on disk once and is read twice.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens._compat import qcol
from spendlens.llm.common import U64, crc_mod, map_arrow, mix64, slices, staged, utf8, word_hashes

# The token after the last word, and the context of the first.
END, START = (int(x) for x in mix64(np.array([0xE0D, 0x57A], U64)))
SHARE, TOP_SHARE, PAIR_SHARE = 1 << 18, 1 << 14, 1 << 17
# Folds of training documents (remainders of the id's crc32): not learned from, and the
# fold whose counts the weights are learned on.
FOLDS, UNSEEN, DELETED = 7, 2, 3
# Tokens that one counting partition gets, about.
PART_TOKENS = 1_500_000
STEPS = 60
_ID_BITS = 20
_SLICE = 3 << 20


class Model:
    """Counts of frequent words and hot pairs, the totals and the weights."""

    def __init__(self, words: np.ndarray, totals: dict):
        # columns: hash, training count, deleted count
        self.key, self.n, self.deleted = words
        self.totals = totals
        self.pair_key = np.zeros(0, np.int64)
        self.pair_n = self.pair_deleted = self.pair_key
        self.weights: np.ndarray | None = None

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        return _find(self.key, hashes)

    def base(self, n: np.ndarray) -> np.ndarray:
        return np.log10((n + 1) / (self.totals["n"] + self.totals["v"] + 1))

    def log10(self, n_context: np.ndarray, n_pair: np.ndarray, n_word: np.ndarray) -> np.ndarray:
        """Mixed log10 probability; a context never seen has no bigram estimate."""
        w = self.weights[bucket_of(n_context)]
        two = n_pair / np.maximum(n_context, 1)
        return np.log10(w[:, 0] * two + w[:, 1] * n_word / max(self.totals["n"], 1) + w[:, 2] / (self.totals["v"] + 1))


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The place of each key in the ascending table, -1 where it is not."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def bucket_of(n: np.ndarray) -> np.ndarray:
    """The context-frequency bucket: 1 + floor(log2 n); 0 is for contexts never seen."""
    return np.where(n > 0, np.frexp(np.maximum(n, 1))[1], 0)


def tokens(b: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of the texts in order (each ends with END), their contexts and texts."""
    words, counts = word_hashes(*utf8(b.column(at)), lower=True)
    ends = np.cumsum(counts)
    token = np.insert(words, ends, U64(END))
    context = np.empty_like(token)
    context[1:] = token[:-1]
    context[ends - counts + np.arange(len(counts))] = U64(START)
    return token, context, np.repeat(np.arange(len(counts)), counts + 1)


def _fit_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    key, text = qcol(id_col).cast("bigint"), F.coalesce(qcol(text_col), F.lit(""))
    return df.select(key.alias("doc_id"), crc_mod(key, FOLDS).cast("int").alias("fold"), text.alias("text"))


def _counted(keys: np.ndarray, fold: np.ndarray) -> pa.RecordBatch:
    """Different keys with their counts: all rows, training rows, deleted fold."""
    found, at = np.unique(keys, return_inverse=True)
    n = [np.bincount(at[m], minlength=len(found)) for m in (slice(None), fold != UNSEEN, fold == DELETED)]
    return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), *(pa.array(x.astype(np.int64)) for x in n)], names=["k", "every", "n", "deleted"])


def _sum_counts(df: DataFrame, fn) -> DataFrame:
    rows = map_arrow(df, fn, "k bigint, every bigint, n bigint, deleted bigint")
    return rows.groupBy("k").agg(F.sum("every").alias("every"), F.sum("n").alias("n"), F.sum("deleted").alias("deleted"))


def count_words(rows: DataFrame) -> tuple[Model, float]:
    """Totals over all training tokens and the counts of the frequent words."""

    def run(batches):
        for b in slices(batches, "text", _SLICE):
            token, _, owner = tokens(b, 2)
            yield _counted(token, b.column(1).to_numpy()[owner])

    words = staged(_sum_counts(rows, run), "lm-words")
    t = words.agg(F.coalesce(F.sum("every"), F.lit(0)).alias("every"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("deleted"), F.lit(0)).alias("deleted"), F.count(F.when(F.col("n") > 0, 1)).alias("v")).first()
    docs = rows.agg(F.count("*").alias("every"), F.count(F.when(F.col("fold") != UNSEEN, 1)).alias("n"), F.count(F.when(F.col("fold") == DELETED, 1)).alias("deleted")).first()
    frequent = words.filter(F.col("every") * SHARE > t["every"]).toPandas()  # fewer than SHARE rows
    table = np.concatenate([frequent[["k", "n", "deleted"]].to_numpy(np.int64), np.array([[np.array([START], U64).view(np.int64)[0], docs["n"], docs["deleted"]]])])
    order = np.argsort(table[:, 0].view(U64), kind="stable")
    table = table[order]
    every = frequent.set_index("k")["every"]
    top = np.array(sorted(every[every * TOP_SHARE > t["every"]].index), np.int64)
    model = Model((table[:, 0].copy().view(U64), table[:, 1], table[:, 2]), {"n": int(t["n"]), "v": int(t["v"]), "deleted": int(t["deleted"]), "every": int(t["every"])})
    model.top = model.ids(np.sort(np.append(top.view(U64), U64(START))))
    return model, t["every"]


def count_hot_pairs(rows: DataFrame, model: Model) -> None:
    """Adds the pairs with a share of all tokens above 1 / PAIR_SHARE. Both their words
    are at least as frequent, so only pairs of the top words are counted."""
    is_top = np.zeros(len(model.key) + 1, bool)
    is_top[model.top] = True
    is_top[-1] = False

    def run(batches):
        for b in slices(batches, "text", _SLICE):
            token, context, owner = tokens(b, 2)
            w, u = model.ids(token), model.ids(context)
            both = is_top[w] & is_top[u]
            yield _counted((u[both] << _ID_BITS | w[both]).astype(np.int64), b.column(1).to_numpy()[owner[both]])

    hot = _sum_counts(rows, run).filter(F.col("every") * PAIR_SHARE > model.totals["every"]).toPandas().sort_values("k")
    model.pair_key, model.pair_n, model.pair_deleted = (hot[c].to_numpy(np.int64) for c in ("k", "n", "deleted"))


# ------------------------------------------------------------ packed entries of a slice


def _pack(columns: list[np.ndarray]) -> bytes:
    """Columns as bytes, each after its length: the first as differences; all with their
    bytes side by side, which compresses."""
    first = columns[0].astype("<u8")
    first[1:] = first[1:] - first[:-1]
    parts = [np.ascontiguousarray(c.view(np.uint8).reshape(len(c), -1).T).tobytes() if len(c) else b"" for c in [first, *columns[1:]]]
    return np.array([len(c) for c in columns], "<u4").tobytes() + pa.compress(b"".join(parts), codec="zstd", asbytes=True)


def _unpack(data: bytes, kinds: list[str]) -> list[np.ndarray]:
    head = 4 * len(kinds)
    sizes, widths = np.frombuffer(data[:head], "<u4").astype(np.int64), [np.dtype(k).itemsize for k in kinds]
    raw = np.frombuffer(pa.decompress(data[head:], int(sizes @ widths), codec="zstd", asbytes=True), np.uint8)
    out, at = [], 0
    for k, n, w in zip(kinds, sizes, widths, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + n * w].reshape(w, n).T).view(k).reshape(n))
        at += n * w
    out[0] = np.cumsum(out[0], dtype=U64)
    return out


# What an entry is: a pair of frequent words that is not hot; a rare word with the words
# beside it; a rare word after a rare one whose context is counted; a rare word's counts;
# what is known of the slice's texts without other partitions.
MID, RARE, COUNTED, WORD, NEAR = range(5)
# Columns: key, text in the slice, then how often (MID), or the words before and after by
# their ids and the hashes of the rare ones after (RARE), or the slice (before the text), the
# text's group and the counts of context and pair, training and deleted (COUNTED). A word's
# own counts (WORD). Text, number and times of hot pairs, then for each text id, whether it is
# null, fold, tokens, known frequent words and their base score (NEAR).
KINDS = {
    MID: ["<u8", "<u2", "<u4"],
    RARE: ["<u8", "<u2", "<i4", "<i4", "<u8"],
    COUNTED: ["<u8", "<u8", "<u2", "u1", "<u4", "<u4", "<u4", "<u4"],
    WORD: ["<u8", "<u4", "<u4"],
    NEAR: ["<u8", "<u4", "<u4", "<i8", "u1", "u1", "<u4", "<u4", "<f8"],
}
# The texts of a slice are numbered by groups: learned from, the deleted fold from the first
# of ``cuts`` on, not learned from the second on.
ENTRIES = "part int, kind int, slice bigint, cut1 int, cut2 int, data binary"
LEARNED, HELD, NOT_LEARNED = range(3)
REORDERED = "rows came in another order when a lost task was run again: write the table first"
# Ids of the word after a rare one if it is rare or there is none.
_FAR, _NONE = -1, -2


def _batch(out: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kinds[f[1]]) for k, f in enumerate(fields)], names=[f[0] for f in fields])


def _dealt(kind: int, parts: int, cols: list[np.ndarray]):
    """Rows of the columns (the key first, ascending) by the partition of their key, packed."""
    part = (mix64(cols[0]) % U64(parts)).astype(np.int64)
    by = np.argsort(part, kind="stable")
    edge = np.searchsorted(part[by], np.arange(parts + 1))
    for p in np.flatnonzero(edge[1:] > edge[:-1]):
        own = by[edge[p] : edge[p + 1]]
        packed = [c[own].astype(k) for c, k in zip(cols, KINDS[kind], strict=False)]
        if kind == RARE:  # the last column has only the rare words after
            packed[4] = packed[4][packed[3] == _FAR]
        yield int(p), kind, _pack(packed)


def send_entries(rows: DataFrame, model: Model, parts: int) -> DataFrame:
    """The texts' entries of MID, RARE and NEAR for each slice and counting partition."""

    def run(batches):
        task = TaskContext.get().partitionId()
        for number, b in enumerate(slices(batches, "text", _SLICE)):
            token, context, owner = tokens(b, 2)
            ids, fold, size = b.column(0), b.column(1).to_numpy().astype(np.uint8), b.num_rows
            # A slice's number tells if a lost task found its rows in another order.
            name = task << 36 | number << 16 | zlib.crc32(utf8(b.column(2))[2]) & 0xFFFF
            group = np.where(fold == UNSEEN, NOT_LEARNED, np.where(fold == DELETED, HELD, LEARNED))
            order = np.argsort(group, kind="stable")
            cuts = [int(x) for x in np.searchsorted(group[order], [HELD, NOT_LEARNED])]
            place = np.empty(size, np.int64)
            place[order] = np.arange(size)
            text = place[owner]

            w, u = model.ids(token), model.ids(context)
            frequent = w >= 0
            both = np.flatnonzero(frequent & (u >= 0))
            pair = u[both] << _ID_BITS | w[both]
            hot = _find(model.pair_key, pair)
            mid = np.flatnonzero(hot < 0)
            key, owners, n = _times(pair[mid], text[both[mid]])
            out = list(_dealt(MID, parts, [key.astype(U64), owners, n]))

            rare = np.flatnonzero(~frequent)
            rare = rare[np.argsort(token[rare], kind="stable")]
            last = np.append(owner[1:] != owner[:-1], True)
            after, far = np.append(w[1:], 0), np.append(token[1:], U64(0))
            after = np.where(last, _NONE, after)[rare]
            out += _dealt(RARE, parts, [token[rare], text[rare], u[rare], after, far[rare]])

            at = np.flatnonzero(hot >= 0)
            owners, pairs, n = _times(text[both[at]], hot[at])
            known = model.n[w[frequent]]
            base = np.bincount(text[frequent], model.base(known), size).astype(float)
            seen = np.bincount(text[frequent], known > 0, size)
            null = np.asarray(ids.is_null())[order]
            doc = ids.fill_null(0).to_numpy()[order]
            count = np.bincount(text, minlength=size)
            near = [c.astype(k) for c, k in zip([owners, pairs, n, doc, null, fold[order], count, seen, base], KINDS[NEAR], strict=True)]
            out.append((int(mix64(np.array([name], U64))[0] % U64(parts)), NEAR, _pack(near)))
            yield _batch([(p, kind, name, *cuts, data) for p, kind, data in out], ENTRIES)

    return map_arrow(rows, run, ENTRIES)


def _times(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different pairs, ascending, and how often each is there."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    start = np.flatnonzero(new)
    return a[start], b[start], np.diff(np.append(start, len(a)))


def _parts(batches, kinds: tuple):
    """Entries of one counting partition after another, those that are counted together at
    a time, each NEAR block by itself: kind -> [slice, group, columns...] (WORD: columns)."""
    now, held = None, {}

    def joined():
        for together in ((MID,), (RARE,), (COUNTED, WORD)):
            own = {k: [np.concatenate(c) for c in zip(*(_block(k, *x) for x in held.pop(k)), strict=True)] for k in together if k in held}
            if own:
                yield own
        for x in held.pop(NEAR, ()):
            yield {NEAR: _block(NEAR, *x)}

    for b in batches:
        for part, kind, *rest in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if part != now:
                yield from joined()
            now = part
            if kind in kinds:
                held.setdefault(kind, []).append(rest)
    yield from joined()


def _block(kind: int, name: int, cut1: int, cut2: int, data: bytes) -> list[np.ndarray]:
    cols = _unpack(data, KINDS[kind])
    if kind == COUNTED:
        key, names, text, group, *counts = cols
        return [names.astype(np.int64), group, key, text, *counts]
    if kind == WORD:
        return cols
    text = cols[0 if kind == NEAR else 1]
    group = (text >= cut1).astype(np.uint8) + (text >= cut2)
    if kind == NEAR:
        return [name, group, *cols]
    if kind == RARE:  # each word's place among all rare words after
        far = np.zeros(len(cols[0]), U64)
        far[cols[3] == _FAR] = cols[4]
        cols[4] = far
    return [np.full(len(text), name, np.int64), group, *cols]


def _sums(at: np.ndarray, size: int, group: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """The training and the deleted count of each entry's group."""
    return [np.bincount(at, x, size).astype(np.int64)[at] for x in (n * (group != NOT_LEARNED), n * (group == HELD))]


def _pairs_of(at: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, int]:
    """Numbers of the different (at, more), and how many there are."""
    order = np.lexsort((more, at))
    new = np.ones(len(at), bool)
    new[1:] = (at[order][1:] != at[order][:-1]) | (more[order][1:] != more[order][:-1])
    out = np.empty(len(at), np.int64)
    out[order] = np.cumsum(new) - 1
    return out, int(new.sum())


def forward_entries(sent: DataFrame, model: Model, parts: int) -> DataFrame:
    """The COUNTED entries: rare words after rare words, with the counts of context and pair;
    and the counts of the words that such entries wait for, as WORD."""

    def run(batches):
        for own in _parts(batches, (RARE,)):
            name, group, key, text, before, after, far = own[RARE]
            found, at = np.unique(key, return_inverse=True)
            word = _sums(at, len(found), group, np.ones(len(at), np.int64))
            to = np.flatnonzero(after == _FAR)
            to = to[np.argsort(far[to], kind="stable")]
            pair = _sums(*_pairs_of(at[to], far[to]), group[to], np.ones(len(to), np.int64))
            out = list(_dealt(COUNTED, parts, [far[to], name[to], text[to], group[to], *(x[to] for x in word), *pair]))
            _, first = np.unique(np.where(before < 0, at, -1), return_index=True)
            first = first[before[first] < 0]
            out += _dealt(WORD, parts, [key[first], *(x[first] for x in word)])
            if out:
                yield _batch([(p, kind, 0, 0, 0, data) for p, kind, data in out], ENTRIES)

    return map_arrow(sent, run, ENTRIES)


def _counted_parts(model: Model, own: dict[int, list[np.ndarray]]):
    """What is scored here: which entries, how often, and the counts that go with each:
    context, pair, word, each as a pair of arrays (training, deleted). RARE also has the
    counts of each entry's own word."""

    def of(ids):
        return [model.n[ids], model.deleted[ids]]

    if NEAR in own:
        _, _, _, hot, n, *_ = own[NEAR]
        pair = model.pair_key[hot]
        return [(slice(None), n.astype(np.int64), of(pair >> _ID_BITS), [model.pair_n[hot], model.pair_deleted[hot]], of(pair & ((1 << _ID_BITS) - 1)))], None
    if MID in own:
        _, group, key, _, n = own[MID]
        found, at = np.unique(key, return_inverse=True)
        n = n.astype(np.int64)
        u, w = (found >> U64(_ID_BITS)).astype(np.int64)[at], (found & U64((1 << _ID_BITS) - 1)).astype(np.int64)[at]
        return [(slice(None), n, of(u), _sums(at, len(found), group, n), of(w))], None
    if RARE in own:
        _, group, key, _, before, after, _ = own[RARE]
        found, at = np.unique(key, return_inverse=True)
        one = np.ones(len(at), np.int64)
        word = _sums(at, len(found), group, one)
        out = []
        for ids, is_context in ((before, False), (after, True)):
            to = np.flatnonzero(ids >= 0)
            counts = [of(ids[to]), _sums(*_pairs_of(at[to], ids[to]), group[to], one[to]), [x[to] for x in word]]
            out.append((to, one[to], *(counts[::-1] if is_context else counts)))
        return out, word
    if COUNTED not in own:
        return [], None
    _, _, key, _, *counts = own[COUNTED]
    words, n, deleted = own[WORD]
    order = np.argsort(words, kind="stable")
    at = _find(words[order], key)
    if (at < 0).any():
        raise RuntimeError(REORDERED)
    at = order[at]
    counts = [x.astype(np.int64) for x in counts]
    return [(slice(None), np.ones(len(key), np.int64), counts[:2], counts[2:], [n[at].astype(np.int64), deleted[at].astype(np.int64)])], None


def _levels(p: np.ndarray) -> np.ndarray:
    """Eighths of a power of two; 1 (no level of a probability) stands for 0."""
    return np.where(p > 0, np.rint(8 * np.log2(np.where(p > 0, p, 1.0))), 1).astype(np.int32)


def _events(model: Model, context, pair, word, n) -> np.ndarray:
    """Held-out events as a bounded table: bucket, levels of the bigram and the unigram
    estimate, all from the counts without the deleted fold, how many."""
    t = model.totals
    kept_u, kept_p, kept_w = (x[0] - x[1] for x in (context, pair, word))
    two = kept_p / np.maximum(kept_u, 1)
    one = kept_w / max(t["n"] - t["deleted"], 1)
    cells = np.stack([bucket_of(kept_u), _levels(two), _levels(one)], axis=1)
    found, at = np.unique(cells, axis=0, return_inverse=True)
    return np.column_stack([found, np.bincount(at.reshape(-1), n, len(found)).astype(np.int64)])


def _event_batch(cells: np.ndarray) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(cells[:, k], kinds[k]) for k in range(4)], names=["bucket", "two", "one", "n"])


def learn_weights(events: np.ndarray, v: int) -> np.ndarray:
    """Weights (bigram, unigram, uniform) of each bucket by expectation-maximisation over
    the events (bucket, levels, count); buckets without events get the mean over all.
    Every weight of the uniform estimate stays positive."""

    def fit(cells: np.ndarray, bigram: bool) -> np.ndarray:
        p = np.column_stack([np.where(cells[:, k] <= 0, np.exp2(cells[:, k] / 8), 0.0) for k in (1, 2)] + [np.full(len(cells), 1 / (v + 1))])
        w = np.array([0.4, 0.5, 0.1]) if bigram else np.array([0.0, 0.9, 0.1])
        for _ in range(STEPS):
            share = p * w
            share /= share.sum(axis=1, keepdims=True)
            w = (share * cells[:, 3:4]).sum(axis=0) / cells[:, 3].sum()
            w[2] = max(w[2], 1e-6)
            w /= w.sum()
        return w

    out = np.tile([0.3, 0.6, 0.1], (66, 1))
    out[0] = [0.0, 0.9, 0.1]
    with_context = events[events[:, 0] > 0]
    if len(with_context):
        out[1:] = fit(with_context, True)
    for b in np.unique(events[:, 0]):
        out[b] = fit(events[events[:, 0] == b], b > 0)
    return out


# What the counting partitions send back to a slice: sums by its texts of the scores, of
# the rare words' base scores (both in parts of 1 / ONE) and of the rare words known; for
# NEAR what was sent, and the score of the hot pairs.
REPLIES = "slice bigint, kind int, data binary"
ONE = 1 << 32
SUMS, OWN = ["<u8", "<i8", "<i8", "<u4"], ["<u8", *KINDS[NEAR][4:], "<f8"]
SCORES = "doc_id bigint, fold int, n_tokens bigint, n_known bigint, base_score double, score double"


def _totals(batches):
    """The scores of each slice's texts, from all that was sent back to it."""
    now, near = None, None

    def scores():
        if near is None or any(x[len(near[0]) :].any() for x in sums):
            raise RuntimeError(REORDERED)
        doc, null, fold, count, known, base, lm = near
        size = len(doc)
        cols = [pa.array(doc.view(np.int64), mask=null > 0), fold.astype(np.int32), count.astype(np.int64), known + sums[2][:size], base + sums[1][:size] / ONE, lm + sums[0][:size] / ONE]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=[f.split()[0] for f in SCORES.split(", ")])

    for b in batches:
        for name, kind, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if name != now:
                if now is not None:
                    yield scores()
                now, near, sums = name, None, np.zeros((3, 1 << 16), np.int64)
            if kind == NEAR:
                near = _unpack(data, OWN)
            else:
                text, *parts = _unpack(data, SUMS)
                for total, part in zip(sums, parts, strict=True):
                    total[text.astype(np.int64)] += part
    if now is not None:
        yield scores()


def lm_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fold, n_tokens, n_known, train_tokens, base_score, score of every row.

    A null or empty text is one END. Documents of remainder UNSEEN are scored but not
    learned from. Repeated rows are all counted and all scored. With no training
    documents every token is unknown and both scores come from the uniform part. Texts
    of any length are read whole, a slice of a batch at a time. A lost task that finds its
    rows in another order (never so for files) ends the query with an error.
    """
    rows = _fit_rows(df, id_col, text_col)
    model, every = count_words(rows)
    count_hot_pairs(rows, model)
    parts = max(24, int(every // PART_TOKENS))

    def dealt(entries):
        return entries.repartition(parts, "part").sortWithinPartitions("part")

    # Read for the weights and for the scores in one query, which shuffles them once.
    sent = dealt(send_entries(rows, model, parts))
    sent = sent.unionAll(dealt(forward_entries(sent, model, parts)))

    def events(batches):
        for own in _parts(batches, (MID, RARE, COUNTED, WORD, NEAR)):
            group = next(iter(own.values()))[1]
            for which, n, *counts in _counted_parts(model, own)[0]:
                at = np.flatnonzero(group[which] == HELD)
                if len(at):
                    yield _event_batch(_events(model, *([x[at] for x in c] for c in counts), n[at]))

    def learned(batches):
        cells = np.concatenate([np.zeros((0, 4), np.int64), *(np.column_stack([c.to_numpy().astype(np.int64) for c in b.columns]) for b in batches)])
        cells = cells[cells[:, 3] > 0]
        weights = learn_weights(cells[np.lexsort(cells[:, 2::-1].T)], model.totals["v"])
        yield pa.RecordBatch.from_arrays([pa.array([weights.astype("<f8").tobytes()], pa.binary())], names=["weights"])

    seen = map_arrow(sent, events, "bucket int, two int, one int, n bigint")
    some = df.sparkSession.range(1).select(*[F.lit(0).cast(t).alias(c) for c, t in (("bucket", "int"), ("two", "int"), ("one", "int"), ("n", "bigint"))])
    cells = seen.unionAll(some).groupBy("bucket", "two", "one").agg(F.sum("n").alias("n"))
    weights = map_arrow(cells.coalesce(1), learned, "weights binary")
    first = F.monotonically_increasing_id() % F.lit(1 << 33) == 0  # of a partition's rows
    asked = sent.crossJoin(F.broadcast(weights)).select(*sent.columns, F.when(first, F.col("weights")).alias("weights"))

    def entries(batches):
        for k, b in enumerate(batches):
            if not k:
                model.weights = np.frombuffer(b.column(6)[0].as_py(), "<f8").reshape(-1, 3)
            yield b.select(range(6))

    def scored(batches):
        for own in _parts(entries(b for b in batches if b.num_rows), (MID, RARE, COUNTED, WORD, NEAR)):
            found, words = _counted_parts(model, own)
            if not found:
                continue
            kind = next(iter(own))
            name, text = own[kind][0], own[kind][2 if kind == NEAR else 3].astype(np.int64)
            lm = np.zeros(len(text))
            for which, n, context, pair, word in found:
                lm[which] += n * model.log10(context[0], pair[0], word[0])
            if kind == NEAR:
                own = own[NEAR][5:]
                lm = np.bincount(text, lm, len(own[0])).astype("<f8")
                yield _batch([(name, kind, _pack([*own, lm]))], REPLIES)
                continue
            base, seen = (model.base(words[0]), words[0] > 0) if words else (np.zeros(len(text)),) * 2
            names, at = np.unique(name, return_inverse=True)
            docs, at = np.unique(at << 16 | text, return_inverse=True)
            cols = [np.rint(np.bincount(at, x, len(docs)) * one).astype(t) for x, one, t in ((lm, ONE, "<i8"), (base, ONE, "<i8"), (seen, 1, "<u4"))]
            edge = np.searchsorted(docs >> 16, np.arange(len(names) + 1))
            yield _batch([(int(x), kind, _pack([docs[i:j] & 0xFFFF, *(c[i:j] for c in cols)])) for x, i, j in zip(names, edge, edge[1:], strict=False)], REPLIES)

    total = map_arrow(map_arrow(asked, scored, REPLIES).repartition(parts, "slice").sortWithinPartitions("slice"), _totals, SCORES)
    return staged(total, "lm-scores").select(
        "doc_id",
        "fold",
        "n_tokens",
        "n_known",
        F.lit(model.totals["n"]).cast("bigint").alias("train_tokens"),
        "base_score",
        "score",
    )


def op7_lm_scores(documents: DataFrame) -> DataFrame:
    """Base and model scores of every document, learned outside the held-out remainder."""
    return lm_scores(documents).select("doc_id", (F.col("fold") == UNSEEN).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
