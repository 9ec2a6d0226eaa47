"""Byte-level BPE over Arrow batches: ids, offsets and the way back to bytes.

The ranks file lists the vocabulary in merge order. The `tokenizers` library gets the
merges that these ranks imply, over characters that stand for bytes. Texts are cut at
white space into chunks that no pre-token crosses; a worker encodes each different
chunk once and keeps the ids, bounded in number.
"""

from __future__ import annotations

import base64
import os
import re
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens._compat import qcol
from spendlens.llm.common import map_arrow, slices, utf8

# The code points with the Unicode property White_Space.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CHUNKS = re.compile(rf"[{SPACE}]+(?![^{SPACE}])| ?[^{SPACE}]+|[{SPACE}]+")
# Chunks that the pattern keeps whole in any Unicode version: Latin letters up to U+024F.
_LETTERS = re.compile(r" ?[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f]+")
# Chunks whose ids a worker keeps; beyond it the store starts anew.
KEPT_CHUNKS = 400_000
_open: dict = {}


def byte_chars() -> list[str]:
    """The character that stands for each byte: itself where it is printable, and
    otherwise the next code point from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    out = [""] * 256
    for b in shown:
        out[b] = chr(b)
    for k, b in enumerate(hidden):
        out[b] = chr(256 + k)
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def _halves(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts whose merge made the token: merge by lower ranks until two are left."""
    parts, limit = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        found = [(r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1], limit)) < limit]
        if not found:
            return None  # no merges lead to it: never made from a text
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts[0], parts[1]


class ByteBpe:
    """Encoder and decoder of one ranks file and split pattern (no special tokens)."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread for each Spark core
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks, chars = read_ranks(path), byte_chars()
        name = {t: "".join(chars[b] for b in t) for t in ranks}
        merges = [(name[h[0]], name[h[1]]) for t in sorted(ranks, key=ranks.get) if len(t) > 1 and (h := _halves(t, ranks))]
        # the longest run of white space and each chunk's own cuts come from the same pattern
        self.library = Tokenizer(models.BPE({name[t]: r for t, r in ranks.items()}, merges))
        self.library.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        back = {c: b for b, c in enumerate(chars)}
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in self.library.get_vocab().items():
            self.bytes_of[rank] = bytes(back[c] for c in token)  # the byte table, reversed
        self.length_of = np.array([len(b) for b in self.bytes_of], np.int64)
        self.char_of = {b: c for b, c in enumerate(chars) if chr(b) != c}
        self.kept: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        cut = [_CHUNKS.findall(t) for t in texts]
        if len(self.kept) > KEPT_CHUNKS:
            self.kept = {}
        kept = self.kept
        new = {c for chunks in cut for c in chunks if c not in kept}
        plain = [c for c in new if _LETTERS.fullmatch(c)]  # one pre-token each
        merge = self.library.model.tokenize
        for c in plain:
            kept[c] = pack("<%dI" % len(t := merge(c.encode().decode("latin-1").translate(self.char_of))), *[x.id for x in t])
        rest = list(new.difference(plain))
        for chunk, done in zip(rest, self.library.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            kept[chunk] = pack("<%dI" % len(done.ids), *done.ids)
        return [b"".join(map(kept.__getitem__, chunks)) for chunks in cut]

    def decode(self, ids: bytes) -> bytes:
        """The bytes of the ids. A character that several ids share is whole again only
        here; a lone id may be part of a character, so the result is bytes, not text."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def starts(self, ids: bytes) -> np.ndarray:
        """The byte at which each id begins in its text."""
        n = self.length_of[np.frombuffer(ids, "<u4")]
        return np.cumsum(n) - n


def codec(path: str, pattern: str) -> ByteBpe:
    """The worker's codec of a ranks file, built once in a worker."""
    if (path, pattern) not in _open:
        _open[path, pattern] = ByteBpe(path, pattern)
    return _open[path, pattern]


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", offsets: bool = False) -> DataFrame:
    """``df`` with ``ids`` (binary: little-endian unsigned 32-bit ids of the whole text),
    ``n_tokens`` and ``n_split`` (ids that begin inside a character); with ``offsets``
    also ``starts`` (array: the character in which each id begins).

    A null or empty text has no ids. Own columns of those names are replaced. Rows are
    independent: repeated rows, ties and empty tables need nothing special, and very
    long texts are encoded whole, one slice of a batch at a time.
    """
    own = ["ids", "n_tokens", "n_split", *(["starts"] if offsets else [])]
    keep = [c for c in df.columns if c not in own]
    at = keep.index(text_col)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*map(qcol, keep)).schema), "ids binary, n_tokens bigint, n_split bigint", *(["starts array<int>"] if offsets else [])])

    def run(batches):
        tool = codec(path, pattern)
        for b in slices(batches, text_col):
            texts = [t or "" for t in b.column(at).to_pylist()]
            ids = tool.encode(texts)
            begin, _, raw = utf8(b.column(at))
            inside = (raw & 0xC0) == 0x80
            splits, places = [], []
            for k, i in enumerate(ids):
                s = tool.starts(i)
                splits.append(int(inside[begin[k] + s].sum()) if len(s) else 0)
                if offsets:
                    lead = ~inside[begin[k] : begin[k] + (int(s[-1]) + 1 if len(s) else 0)]
                    places.append((np.cumsum(lead)[s] - 1).tolist() if len(s) else [])
            columns = [*b.columns, pa.array(ids, pa.binary()), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(splits, pa.int64())]
            if offsets:
                columns.append(pa.array(places, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *own])

    return map_arrow(df.select(*map(qcol, keep)), run, schema)


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """``df`` with ``decoded`` (binary): the bytes that the ids stand for. Null ids
    decode to no bytes. ``decode`` of ``encode`` is the text's UTF-8 bytes."""
    keep = [c for c in df.columns if c != "decoded"]
    at = keep.index(ids_col)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*map(qcol, keep)).schema), "decoded binary"])

    def run(batches):
        tool = codec(path, pattern)
        for b in slices(batches, ids_col):
            out = [tool.decode(i or b"") for i in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], names=[*keep, "decoded"])

    return map_arrow(df.select(*map(qcol, keep)), run, schema)


def op3_byte_bpe(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """Ids of every whole text and the digests of the ids and of the decoded bytes."""
    docs = documents.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    coded = encode(docs, path, pattern).select("doc_id", "ids", "n_tokens", "n_split")
    back = decode(coded, path, pattern)
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "n_split")
