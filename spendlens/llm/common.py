"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens._compat import qcol
from spendlens.session import ship_package, work_path

# The white space that separates words: blank and \t \n \v \f \r.
WHITE = " \t\n\x0b\f\r"
WORD_BREAK = r"[ \t-\r]+"

U64 = np.uint64
_MASK = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder of ``spark.checkpoint.dir`` and
    read again: lineage ends there, and a lost executor costs only its running tasks."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lean() -> None:
    """Python workers outlive their tasks: freed arrays go back to the system at once,
    not into the worker's own store, where idle workers would hold them."""
    pa.default_memory_pool().release_unused()
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD: larger blocks are mapped one by one
        libc.malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def map_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` with the package made importable on the executors. Columns may have
    any names: they go there by place (``mapInArrow`` takes a dot for a field)."""
    ship_package(df.sparkSession)
    names = df.columns

    def run(batches):
        lean()
        yield from fn(pa.RecordBatch.from_arrays(b.columns, names=names) for b in batches)
        lean()

    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(run, schema)


def id_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id (long) and the text (null: empty), under fixed names: columns of
    the input that clash with an operator's own names are out of the way."""
    return df.select(qcol(id_col).cast("long").alias("doc_id"), F.coalesce(qcol(text_col), F.lit("")).alias("text"))


def crc_mod(id_col, m: int):
    """crc32 of the id as decimal text, modulo ``m``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % F.lit(m)


# ---------------------------------------------------------------- Arrow batches


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 2 << 20, max_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """The batches again in slices of at most ``max_rows`` rows and about ``max_bytes``
    of ``column`` (one row at least), so that memory does not follow the batch size."""
    for b in batches:
        if not b.num_rows:
            continue
        _, ends, _ = utf8(b.column(column))
        begin, n = 0, b.num_rows
        base = 0
        while begin < n:
            stop = int(np.searchsorted(ends, base + max_bytes, side="right"))
            stop = min(max(stop, begin + 1), begin + max_rows, n)
            yield b.slice(begin, stop - begin)
            base, begin = int(ends[stop - 1]), stop


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the array's texts in its byte buffer (from 0), and the bytes."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, offsets, data = arr.buffers()
    if len(arr) == 0 or offsets is None:
        z = np.zeros(len(arr), np.int64)
        return z, z, np.zeros(0, np.uint8)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    off = off - off[0]
    return off[:-1], off[1:], raw


# ---------------------------------------------------------------- 64-bit hashes


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit words (shift, multiply, shift)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = mix64(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_WORD_BYTE = np.ones(256, bool)
_WORD_BYTE[[9, 10, 11, 12, 13, 32]] = False
# Bytes of the terms of a lexical search: ASCII letters and digits, and all beyond ASCII.
TERM_BYTE = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64, at least ``n`` of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 16, 1 << int(n).bit_length())
        inverse = pow(_BASE, -1, 1 << 64)
        tables = []
        for base in (_BASE, inverse):
            t = np.ones(size, U64)
            have, step = 1, base
            while have < size:  # t[have:2*have] = t[:have] * base**have
                m = min(have, size - have)
                t[have : have + m] = t[:m] * U64(step)
                step = (step * step) & _MASK
                have += m
            tables.append(t)
        _powers[:] = tables
    return _powers[0], _powers[1]


def word_hashes(starts: np.ndarray, ends: np.ndarray, raw: np.ndarray, lower: bool, inside: np.ndarray = _WORD_BYTE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (runs of bytes that are not white space; else of the bytes
    that ``inside`` marks) of the texts in order, and the number of words of each text.
    ``lower`` folds A-Z. Equal words have equal hashes; different words differ up to the
    64-bit chance."""
    return word_spans(starts, ends, raw, lower, inside)[:2]


def word_spans(starts: np.ndarray, ends: np.ndarray, raw: np.ndarray, lower: bool, inside: np.ndarray = _WORD_BYTE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``word_hashes`` and each word's first and past-the-end byte in ``raw``."""
    n = len(raw)
    if n == 0:
        none = np.zeros(0, np.int64)
        return np.zeros(0, U64), np.zeros(len(starts), np.int64), none, none
    word = inside[raw]
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = starts[starts < n]
    first[inner] = word[inner]  # a text's first byte starts a word whatever is before it
    last = word.copy()
    last[:-1] &= ~word[1:]
    tail = ends[ends > 0] - 1
    last[tail] |= word[tail]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    powers, inverse = _power_tables(n + 1)
    total = np.empty(n + 1, U64)
    total[0] = 0
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[raw] * powers[:n], out=total[1:])
    h = (total[e] - total[s]) * inverse[s]
    counts = np.searchsorted(s, ends) - np.searchsorted(s, starts)
    return mix64(h + (e - s).astype(U64)), counts, s, e


def shingle_hashes(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``width`` words of each text in order (a text with
    fewer words, but at least one, has its whole sequence as one) and their counts."""
    ends = np.cumsum(counts)
    starts = ends - counts
    n_win = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    first = np.repeat(starts - (np.cumsum(n_win) - n_win), n_win) + np.arange(int(n_win.sum()))
    limit = np.repeat(ends, n_win)
    h = np.zeros(len(first), U64)
    for k in range(width):
        at = first + k
        ok = at < limit
        part = words[np.minimum(at, max(len(words) - 1, 0))] if len(words) else h
        h = np.where(ok, mix64(h * U64(3) + part), h)
    return h, n_win
