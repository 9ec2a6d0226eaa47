"""Marker logic over attached labels: sector flag, any-class flags, selection,
residual overwrite, false-negative review list.

Null semantics: class columns are three-valued (NULL = no label). OR/AND/NOT
are Kleene, a filter keeps TRUE only. The sector flag is never NULL: an absent
or NULL purpose code is "not in the set".
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens._compat import ColumnOrName, as_col, qcol
from spendlens.fields import DEFAULT, Fields
from spendlens.sources.ingest import to_boolean
from spendlens.taxonomy import Taxonomy


def sector_flag(code: ColumnOrName, codes: Sequence[str]) -> Column:
    """Purpose code (as trimmed text) in ``codes``; NULL code gives FALSE."""
    return F.coalesce(F.trim(as_col(code).cast("string")).isin(list(codes)), F.lit(False))


def kleene_or(cols: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, cols)


def kleene_and(cols: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, cols)


def _boolean_classes(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Class columns read from text files come as strings: convert them; add absent ones as NULL."""
    types = {f.name: f.dataType for f in df.schema.fields}
    out = df
    for c in names:
        if c not in types:
            out = out.withColumn(c, F.lit(None).cast("boolean"))
        elif not isinstance(types[c], T.BooleanType):
            out = out.withColumn(c, to_boolean(qcol(c)))
    return out


def mark(df: DataFrame, taxonomy: Taxonomy, fields: Fields = DEFAULT) -> DataFrame:
    """Add the sector flag, ``any_sans_sector`` (OR of the thematic classes as
    labelled) and ``any`` (the same OR the sector flag). Location classes do
    not count."""
    out = _boolean_classes(df, list(taxonomy.classes) + list(taxonomy.locations))
    classes = [qcol(c) for c in taxonomy.classes]
    sector = sector_flag(qcol(fields.purpose_code), taxonomy.sector_codes)
    return out.withColumns(
        {
            fields.sector_flag: sector,
            fields.any_sans_sector: kleene_or(classes),
            fields.any_flag: kleene_or(classes) | sector,
        }
    )


def residual(taxonomy: Taxonomy) -> Column:
    """Residual class recomputed as "none of the specific classes" (Kleene)."""
    return kleene_and([~qcol(c) for c in taxonomy.specific])


def select_marked(marked: DataFrame, taxonomy: Taxonomy, fields: Fields = DEFAULT) -> DataFrame:
    """Marked activities (``any`` TRUE; FALSE and NULL dropped), with the residual
    class overwritten by ``residual`` (after ``any`` was decided)."""
    return marked.where(qcol(fields.any_flag)).withColumn(taxonomy.residual, residual(taxonomy))


def false_negatives(marked: DataFrame, fields: Fields = DEFAULT) -> DataFrame:
    """Review list: sector-coded activities that were labelled and got no thematic class."""
    return marked.where(qcol(fields.sector_flag) & ~qcol(fields.any_sans_sector))
