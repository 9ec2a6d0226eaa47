"""Document fingerprints by a randomised embedding of edit distance.

A walk goes over a text's characters: at step j it emits the character under its pointer,
and a random bit shared by all texts, drawn for (j, character), says whether the pointer
moves on. Texts a few edits apart soon walk in step again, so edit distance turns into
Hamming distance between the emitted strings. A fingerprint is a sample of the emitted
characters at fixed steps: SAMPLES of them in each of the step ranges [0, 64), [64, 128),
[128, 256), ..., so texts of any length compare. Bands of sampled places find candidates
and the whole fingerprints verify them.
"""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens._compat import qcol
from spendlens.llm.common import U64, map_arrow, mix64, slices, staged
from spendlens.llm.minhash import components, join_hot

SAMPLES = 64
# Period of the shared random bits and the classes that characters fall in for them.
PERIOD, CLASSES = 1 << 16, 64
SYMBOLS = np.frombuffer(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz-_", np.uint8)
PAD = "."
# Bands for each of the two step ranges that are banded, and places in a band.
BANDS, PLACES = 18, 8
LIKE = 0.8
# Members of a bucket that are compared in one group; larger ones go block by block.
BLOCK = 256
SLICE_CHARS = 6_000_000
# Ranges of ids at most; of more than RANGES * 2000 rows, each range holds more.
RANGES = 1 << 16
# The least long: the place of a null id, and where the hashes begin.
NO_HASH = -(1 << 63)
_tables: dict = {}


def _gaps() -> np.ndarray:
    """gaps[j, c]: for how many steps from step j on the walk stays on a character of class c."""
    if "gaps" not in _tables:
        bits = np.unpackbits(np.random.default_rng(20).integers(0, 256, PERIOD * CLASSES // 8, np.uint8)).reshape(PERIOD, CLASSES)
        gaps = np.ones((PERIOD, CLASSES), np.uint8)
        after = gaps[0]
        for turn in range(2):  # the bits repeat: the end runs on into the start
            for j in range(PERIOD - 1, -1, -1):
                if turn and j < PERIOD - 256:
                    break
                after = np.where(bits[j] == 1, 1, np.minimum(after + 1, 255)).astype(np.uint8)
                gaps[j] = after
        _tables["gaps"] = gaps.reshape(-1)
    return _tables["gaps"]


def _characters() -> tuple[np.ndarray, np.ndarray]:
    """Class and sampled symbol of every code point."""
    if "characters" not in _tables:
        mixed = mix64(np.arange(0x110000, dtype=U64) + U64(1))
        _tables["characters"] = (mixed >> U64(58)).astype(np.uint8), SYMBOLS[(mixed >> U64(20)).astype(np.int64) & 63]
    return _tables["characters"]


def sample_steps(last: int) -> np.ndarray:
    """The sampled steps up to the range that ``last`` lies in, ascending."""
    ranges = 1 + max(0, int(last).bit_length() - 6)
    key = ("steps", ranges)
    if key not in _tables:
        steps = [np.arange(SAMPLES)]
        for r in range(1, ranges):
            low = SAMPLES << (r - 1)
            drawn = np.random.default_rng(1000 + r).permutation(low)[:SAMPLES] if low <= 1 << 20 else np.random.default_rng(1000 + r).integers(0, low, SAMPLES)
            steps.append(low + np.sort(drawn))
        _tables[key] = np.concatenate(steps)
    return _tables[key]


def fingerprints(texts: list[str]) -> list[str]:
    """The fingerprint of each text; empty for the empty text. Equal texts have equal ones."""
    gaps = _gaps()
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    sizes = np.array([len(texts[i]) for i in order], np.int64)
    begin = np.cumsum(sizes) - sizes
    code = np.frombuffer("".join(texts[i] for i in order).encode("utf-32-le", "surrogatepass"), "<u4")
    kinds, symbols = _characters()
    kind, symbol = kinds[code], symbols[code]
    at = np.empty(len(code), np.int32)  # the step at which each character is first emitted
    step = np.zeros(len(order), np.int64)
    active = np.searchsorted(-sizes, -np.arange(int(sizes[0]) if len(sizes) else 0), side="left")
    for i, k in enumerate(active.tolist()):  # character i of all texts that have one
        place, now = begin[:k] + i, step[:k]
        at[place] = now
        now += gaps[((now & (PERIOD - 1)) << 6) | kind[place]]
    out = [""] * len(texts)
    for k, i in enumerate(order):
        n = int(sizes[k])
        if n:
            steps = sample_steps(int(step[k]) - 1)
            steps = steps[steps < step[k]]
            own = slice(int(begin[k]), int(begin[k]) + n)
            out[i] = symbol[own][np.searchsorted(at[own], steps, side="right") - 1].tobytes().decode()
    return out


def likeness(a: str, b: str) -> float:
    """Share of steps on which two fingerprints agree, each sample weighing as many steps
    as it stands for; steps that only one text reaches disagree. Two empty ones are alike."""
    n = max(len(a), len(b))
    if not n:
        return 1.0
    if a == b:
        return 1.0
    x, y = (np.frombuffer(s.ljust(n, PAD).encode(), np.uint8) for s in (a, b))
    weight = 2.0 ** np.maximum(np.arange(n) // SAMPLES - 1, 0)
    return float(weight[x == y].sum() / weight.sum())


# ------------------------------------------------------------------- next documents


def _cuts(ids: DataFrame, n: int, k: int) -> list[tuple[int, int]]:
    """k - 1 ascending places (id, text hash) that cut the rows into about equal ranges. An
    id so frequent that several quantiles fall on it is cut by its texts' hashes."""
    found = sorted(int(c) for c in ids.approxQuantile("k", [i / k for i in range(1, k)], 0.2 / k)) if n and k > 1 else []
    cuts = []
    for c in sorted(set(found)):
        times = bisect_right(found, c) - bisect_left(found, c)
        cuts += [(c, NO_HASH + (i << 64) // times) for i in range(times)]
    return cuts


def with_next(df: DataFrame, buckets: int | None = None) -> DataFrame:
    """``df`` (doc_id, text) dealt into ranges of doc_id, each followed by a copy (ghost)
    of the row that comes next after it: columns bucket, ghost, k, h, doc_id, text, where
    (k, h) is the order of the rows: the id (a null id first), then a hash of the text.

    The ranges come from quantiles of the ids, RANGES at most; rows of one frequent id lie
    in several ranges. The last range is followed by the first row of all.
    """
    rows = df.select(F.coalesce("doc_id", F.lit(NO_HASH)).alias("k"), F.xxhash64("text").alias("h"), "doc_id", "text")
    n = rows.count()
    k = buckets or min(RANGES, 1 << max(0, (n // 2000).bit_length()))
    cuts = (_cuts(rows.select("k"), n, k) + [(-NO_HASH - 1, -NO_HASH - 1)] * k)[: k - 1]
    bucket = F.lit(0)
    if k > 1:  # binary search: how many cuts lie at or below the row
        steps = F.array(*[F.lit(k >> (i + 1)) for i in range(k.bit_length() - 1)])
        places = F.from_json(F.lit(json.dumps([{"k": c, "h": h} for c, h in cuts])), "array<struct<k: bigint, h: bigint>>")
        bucket = F.aggregate(steps, F.lit(0), lambda p, s: F.when(F.get(places, p + s - 1) <= F.struct("k", "h"), p + s).otherwise(p))
    rows = rows.withColumn("bucket", bucket)
    firsts = sorted((r["first"]["k"], r["first"]["h"], r["bucket"]) for r in rows.groupBy("bucket").agg(F.min(F.struct("k", "h")).alias("first")).collect())
    known: list[dict | None] = [None] * k
    for i, (first, h, own) in enumerate(firsts):
        known[own] = {"k": first, "h": h, "before": firsts[i - 1][2]}  # before the first is the last range
    first = F.get(F.from_json(F.lit(json.dumps(known)), "array<struct<k: bigint, h: bigint, before: int>>"), F.col("bucket"))
    begins = (first["k"] == F.col("k")) & (first["h"] == F.col("h"))
    places = F.array_compact(F.array(F.struct("bucket", F.lit(False).alias("ghost")), F.when(begins, F.struct(first["before"].alias("bucket"), F.lit(True).alias("ghost")))))
    return rows.select("k", "h", "doc_id", "text", F.explode(places).alias("at")).select("at.bucket", "at.ghost", "k", "h", "doc_id", "text")


def edited_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row: n_chars, edited (its text with the last quarter replaced by the
    start of the next document's), fingerprint, edited_fingerprint, near_edited, near_next.

    Null texts count as empty; the empty text has the empty fingerprint. Rows of one id
    go by a hash of their text, so the next document of a repeated row is the repetition. A single
    document is its own next one. Very long texts are walked whole.
    """
    d = df.select(qcol(id_col).cast("bigint").alias("doc_id"), F.coalesce(qcol(text_col), F.lit("")).alias("text"))
    dealt = with_next(d)
    rows = dealt.repartition("bucket").sortWithinPartitions("bucket", "ghost", "k", "h", "text").select("bucket", "ghost", "doc_id", "text")

    def told(block: list[tuple]) -> pa.RecordBatch:
        pairs = [(a, b) for a, b in zip(block[:-1], block[1:], strict=True) if not a[1] and a[0] == b[0]]
        edited = [a[3][: len(a[3]) - len(a[3]) // 4] + b[3][: len(a[3]) // 4] for a, b in pairs]
        texts = list(dict.fromkeys([x[3] for p in pairs for x in p] + edited))
        of = dict(zip(texts, fingerprints(texts), strict=True))
        cols = [
            [a[2] for a, _ in pairs],
            [len(a[3]) for a, _ in pairs],
            edited,
            [of[a[3]] for a, _ in pairs],
            [of[e] for e in edited],
            [likeness(of[a[3]], of[e]) for (a, _), e in zip(pairs, edited, strict=True)],
            [likeness(of[a[3]], of[b[3]]) for a, b in pairs],
        ]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        names = ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    def run(batches):
        block, chars = [], 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                block.append(row)
                chars += len(row[3])
                if chars > SLICE_CHARS and len(block) > 1:
                    yield told(block)
                    block, chars = block[-1:], len(row[3])  # the last is the next one of none so far
        if len(block) > 1:
            yield told(block)

    return map_arrow(rows, run, "doc_id bigint, n_chars bigint, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


# -------------------------------------------------------------- banding and verification


def fingerprint(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with ``fingerprint`` of the whole text (null: empty)."""
    keep = [c for c in df.columns if c != "fingerprint"]
    at = keep.index(text_col)
    d = df.select(*map(qcol, keep))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema), "fingerprint string"])

    def run(batches):
        for b in slices(batches, text_col):
            done = fingerprints([t or "" for t in b.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(done, pa.string())], names=[*keep, "fingerprint"])

    return map_arrow(d, run, schema)


def band_keys(prints: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The band keys of the fingerprints, in order, and how many each has: BANDS samples of
    PLACES places in each of the two highest step ranges that it has all samples of (a
    shorter text: of what it has). Texts of a likeness that counts share one of these
    ranges at least, since their walks are of about one length. A key is a bijective mix
    of the sampled symbols, to which the number of range and band is added."""
    rng = np.random.default_rng(8)
    places = np.array([np.sort(rng.permutation(SAMPLES)[:PLACES]) for _ in range(BANDS)])
    full = np.array([max(1, len(f) // SAMPLES) for f in prints], np.int64)
    ranges = np.minimum(full, 2)
    data = b"".join(f[(n - r) * SAMPLES : n * SAMPLES].ljust(r * SAMPLES, PAD).encode() for f, n, r in zip(prints, full.tolist(), ranges.tolist(), strict=True))
    symbols = np.frombuffer(data, np.uint8).reshape(-1, SAMPLES)
    level = np.repeat(full - ranges, ranges) + np.arange(len(symbols)) - np.repeat(np.cumsum(ranges) - ranges, ranges)
    sampled = np.ascontiguousarray(symbols[:, places]).view("<u8").reshape(len(symbols), BANDS)  # PLACES bytes each
    number = (level[:, None] * BANDS + np.arange(BANDS)).astype(U64)
    return mix64(sampled + mix64(number + U64(1))).reshape(-1), ranges * BANDS


def banded_rows(classes: DataFrame) -> DataFrame:
    """(rep, key): the band keys of each class, as a written table, since they are read by
    each of the following steps."""

    def run(batches):
        for b in slices(batches, "fingerprint"):
            keys, n = band_keys(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), n)), pa.array(keys.view(np.int64))], names=["rep", "key"])

    return staged(map_arrow(classes.select("rep", "fingerprint"), run, "rep bigint, key bigint").distinct(), "fingerprint-bands")


def _matrix(prints: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols by text and sample (0 where a text has none), and the samples' weights."""
    width = max(map(len, prints))
    out = np.zeros((len(prints), width), np.uint8)
    for k, f in enumerate(prints):
        out[k, : len(f)] = np.frombuffer(f.encode(), np.uint8)
    return out, 2.0 ** np.maximum(np.arange(width) // SAMPLES - 1, 0)


def like_one(one: str, others: list[str]) -> np.ndarray:
    """``likeness`` of one fingerprint to each of the others."""
    table, weight = _matrix([one, *others])
    either = (table[1:] > 0) | (table[0] > 0)
    return ((table[1:] == table[0]) & either) @ weight / np.maximum(either @ weight, 1e-300)


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


def _link_batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


def hub_pairs(classes: DataFrame, banded: DataFrame, like: float) -> DataFrame:
    """(doc_id, near_id, likeness): each class with the least class of its buckets, verified
    on the whole fingerprints. A bucket's members are never paired with each other here."""
    hubs = staged(banded.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("c")).filter("c > 1"), "fingerprint-hubs")
    total = hubs.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    pairs = join_hot(banded, hubs, "key", "c", total).filter("rep <> hub").select("rep", "hub").distinct()
    both = pairs.join(classes, "rep").join(classes.select(F.col("rep").alias("hub"), F.col("fingerprint").alias("near")), "hub")

    def verify(batches):
        for b in batches:
            rep, hub, x, y = (c.to_pylist() for c in b.columns)
            alike = [likeness(f, g) for f, g in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(rep, pa.int64()), pa.array(hub, pa.int64()), pa.array(alike, pa.float64())], names=["doc_id", "near_id", "likeness"])

    found = map_arrow(both.select("rep", "hub", "fingerprint", "near"), verify, "doc_id bigint, near_id bigint, likeness double")
    return found.filter(F.col("likeness") >= like)


def cross_links(classes: DataFrame, banded: DataFrame, roots: DataFrame, like: float, block: int = BLOCK) -> DataFrame:
    """Links between components (a, b: their ids) that still share a bucket. Every pair of
    different components in such a bucket is looked at, in groups of at most two blocks of
    about ``block`` members; a group returns links, never its pairs."""
    known = banded.join(roots, "rep")
    mixed = known.groupBy("key").agg(F.count("*").alias("c"), F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("key", "c")
    mixed = staged(mixed, "fingerprint-mixed")
    total = mixed.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    if not total:
        return classes.sparkSession.createDataFrame([], "a bigint, b bigint")
    rows = join_hot(known, mixed, "key", "c", total).withColumn("blocks", F.ceil(F.col("c") / block).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "comp", "rep")
    full = rows.join(classes, "rep").select("key", "i", "j", "own", "comp", "rep", "fingerprint")
    order = ["key", "i", "j"]

    def compare(batches):
        for group in _groups(batches, 3):
            found, root = [], {r[4]: r[4] for r in group}

            def find(x):
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for k, one in enumerate(group[:-1]):
                rest = [r for r in group[k + 1 :] if find(r[4]) != find(one[4]) and (one[1] == one[2] or r[3] != one[3])]
                if not rest:
                    continue
                for r, x in zip(rest, like_one(one[6], [r[6] for r in rest]), strict=True):
                    u, v = find(one[4]), find(r[4])
                    if x >= like and u != v:
                        root[max(u, v)] = min(u, v)
                        found.append((one[4], r[4]))
            if found:
                yield _link_batch(found)

    return map_arrow(full.repartition(*order).sortWithinPartitions(*order, "rep"), compare, "a bigint, b bigint")


def _classes(df: DataFrame, id_col: str, text_col: str):
    """Every row's fingerprint; the classes of equal ones (their 128-bit key, least id and
    size); their fingerprints; their band keys; and the key's columns."""
    rows = df.select(qcol(id_col).cast("bigint").alias("doc_id"), qcol(text_col).alias("text"))
    known = staged(fingerprint(rows).select("doc_id", "fingerprint"), "fingerprint-all")
    # classes by 128 bits of the fingerprint: which class a row is in moves no fingerprint
    key = [F.xxhash64("fingerprint").alias("h"), F.xxhash64(F.lit(1), "fingerprint").alias("g")]
    some = known.filter("fingerprint <> ''")
    least = staged(some.select("doc_id", *key).groupBy("h", "g").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")).filter("rep is not null"), "fingerprint-classes")
    stand = some.select("doc_id", "fingerprint", *key).join(least.select("h", "g", F.col("rep").alias("doc_id")), ["h", "g", "doc_id"])
    classes = staged(stand.dropDuplicates(["h", "g"]).select(F.col("doc_id").alias("rep"), "fingerprint"), "fingerprint-reps")
    return known, least, classes, banded_rows(classes), key


def near_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", like: float = LIKE) -> DataFrame:
    """Verified near pairs (doc_id, near_id, likeness) between different fingerprints: each
    class, stood for by its least id, with the least one of each of its buckets. Groups of
    all near texts, pairs of other members included, are ``near_groups``."""
    _, _, classes, banded, _ = _classes(df, id_col, text_col)
    return hub_pairs(classes, banded, like)


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", like: float = LIKE) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row: the least doc_id reachable by links
    between fingerprints of likeness ``like`` or more.

    Rows of equal fingerprints are one class, stood for by its least id. Candidates share a
    band; all are verified on the whole fingerprints. Two texts at the threshold, alike by
    ``like`` in one of their common step ranges, share a band there with a chance of
    1 - (1 - like^PLACES)^BANDS, 0.96 for 0.8; in both, 0.998. Null and empty texts are near
    to nothing; a row without id is a class like any other if a row with an id has its
    fingerprint, and otherwise has no component. Repeated rows give equal results, an empty
    table an empty one; texts of any length are walked whole.
    """
    known, least, classes, banded, key = _classes(df, id_col, text_col)
    first = components(hub_pairs(classes, banded, like).select(F.col("doc_id").alias("a"), F.col("near_id").alias("b")))
    roots = staged(classes.select("rep").distinct().join(first.withColumnRenamed("node", "rep"), "rep", "left").select("rep", F.coalesce("root", "rep").alias("comp")), "fingerprint-roots")
    second = components(cross_links(classes, banded, roots, like))
    merged = roots.join(second.withColumnRenamed("node", "comp"), "comp", "left").select("rep", F.coalesce("root", "comp").alias("component_id"))
    named = least.join(merged, "rep").select("h", "g", "c", "component_id")
    # a class may hold a large share of all rows: frequent ones join by broadcast
    total = named.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    whole = F.struct("h", "g")
    out = join_hot(known.withColumn("key", F.struct(*key)), named.select(whole.alias("key"), "c", "component_id"), "key", "c", total)
    alone = known.join(named.select("h", "g"), [F.xxhash64("fingerprint") == F.col("h"), F.xxhash64(F.lit(1), "fingerprint") == F.col("g")], "left_anti")
    return out.select("doc_id", "fingerprint", "component_id").unionByName(alone.select("doc_id", "fingerprint", F.col("doc_id").alias("component_id")))


def fingerprint_groups(documents: DataFrame) -> DataFrame:
    """The group of near texts of every document, by banding and verification."""
    return near_groups(documents).select("doc_id", F.sha2("fingerprint", 256).alias("fingerprint_sha256"), "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def op8_fingerprints(documents: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    return edited_fingerprints(documents).select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
