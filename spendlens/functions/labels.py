"""Classifier responses as Columns: parse, validate against the vocabulary, multi-hot.

A response is ``struct<summary, reasoning, classifications: array<string>>``.
Parsing and validation run as ``from_json`` + array functions, so the model
call is the only Python in the labelling path.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens._compat import ColumnOrName, as_col

RESPONSE_TYPE = T.StructType(
    [
        T.StructField("summary", T.StringType()),
        T.StructField("reasoning", T.StringType()),
        T.StructField("classifications", T.ArrayType(T.StringType())),
    ]
)

OK = "ok"
MALFORMED = "malformed"
UNKNOWN_CLASS = "unknown_class"
FAILED = "failed"
STATUSES = (OK, MALFORMED, UNKNOWN_CLASS, FAILED)


def _vocab(vocab: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in vocab])


def response_status(parsed: ColumnOrName, vocab: Sequence[str], raw: ColumnOrName | None = None) -> Column:
    """``failed`` (no response), ``malformed`` (no class list), ``unknown_class`` (label
    outside the vocabulary) or ``ok``."""
    p = as_col(parsed)
    classes = p.getField("classifications")
    status = (
        F.when(classes.isNull(), F.lit(MALFORMED))
        .when(F.size(F.array_except(classes, _vocab(vocab))) > 0, F.lit(UNKNOWN_CLASS))
        .otherwise(F.lit(OK))
    )
    if raw is not None:
        status = F.when(as_col(raw).isNull(), F.lit(FAILED)).otherwise(status)
    return status


def parse_response(raw_json: ColumnOrName, vocab: Sequence[str]) -> Column:
    """JSON text → ``struct<summary, reasoning, classifications, status>``.

    Bad JSON and ``{}`` give ``malformed``; a class outside ``vocab`` rejects the
    whole response (``unknown_class``), as a schema-validated client would.
    """
    raw = as_col(raw_json)
    parsed = F.from_json(raw, RESPONSE_TYPE)
    return F.struct(
        parsed.getField("summary").alias("summary"),
        parsed.getField("reasoning").alias("reasoning"),
        parsed.getField("classifications").alias("classifications"),
        response_status(parsed, vocab, raw).alias("status"),
    )


def multi_hot(classifications: ColumnOrName, status: ColumnOrName, vocab: Sequence[str]) -> list[Column]:
    """One nullable boolean per class, named as the class; NULL unless status is ``ok``."""
    cl, st = as_col(classifications), as_col(status)
    return [F.when(st == OK, F.array_contains(cl, F.lit(c))).alias(c) for c in vocab]


def keyword_classes(text: ColumnOrName, keywords: Mapping[str, Sequence[str]]) -> Column:
    """Deterministic classifier as a native expression: the classes (in mapping order)
    whose keyword list has a case-insensitive substring hit in ``text``."""
    low = F.lower(as_col(text))
    hits = []
    for cls, words in keywords.items():
        words = [w.lower() for w in words if w]
        if not words:
            continue
        cond = low.contains(F.lit(words[0]))
        for w in words[1:]:
            cond = cond | low.contains(F.lit(w))
        hits.append(F.when(cond, F.lit(cls)))
    if not hits:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*hits))
