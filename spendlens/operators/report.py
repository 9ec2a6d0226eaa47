"""Yearly reports over selected activities.

All wide reports come from one ``groupBy(year)`` with conditional sums
(``year_summary``): no row multiplication, no pivot shuffle, no join between
class sums and year totals. The group key is the year, so partial aggregation
leaves a handful of rows per map task whatever the skew. The long form
(``spend_long``) keeps the unpivot route for users who want the molten table.

Null rules (``strict_nulls=True``, default) follow the original reports: class,
total and location sums propagate a NULL amount; finance group sums skip NULLs.
A class with no TRUE row in a year is NULL in the wide tables; a year with no
TRUE class at all has no row in the class tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens._compat import qcol
from spendlens.fields import DEFAULT, Fields
from spendlens.session import checkpoint_root
from spendlens.sources.dimensions import GROUP_ORDER, UNMAPPED, category_group
from spendlens.taxonomy import Taxonomy


def strict_sum(c: Column) -> Column:
    """Aggregate: sum that is NULL as soon as one input is NULL (the reports' class
    and total sums); partial-aggregation friendly (two counts and a sum)."""
    return F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))


def lenient_sum(c: Column) -> Column:
    """Aggregate: sum skipping NULLs, 0 when every input is NULL (the finance-group sums)."""
    return F.coalesce(F.sum(c), F.lit(0).cast("double"))


def _agg_cols(prefix: str, flag: Column, amount: Column) -> list[Column]:
    return [
        F.count_if(flag).alias(f"n_{prefix}"),
        F.sum(F.when(flag, amount)).alias(f"s_{prefix}"),
        F.count(F.when(flag, amount)).alias(f"nn_{prefix}"),
    ]


def year_summary(sel: DataFrame, taxonomy: Taxonomy, fields: Fields = DEFAULT) -> DataFrame:
    """One row per year with counts and sums for every class, location, finance group and the total."""
    amount = qcol(fields.amount).cast("double")
    aggs: list[Column] = [
        F.count(F.lit(1)).alias("n_total"),
        F.sum(amount).alias("s_total"),
        F.count(amount).alias("nn_total"),
    ]
    for i, c in enumerate(taxonomy.classes):
        aggs += _agg_cols(f"c{i}", qcol(c), amount)
    for j, c in enumerate(taxonomy.locations):
        aggs += _agg_cols(f"l{j}", qcol(c), amount)
    # an absent category column counts as NULL category: all spend is unmapped
    cat = qcol(fields.category) if fields.category in sel.columns else F.lit(None).cast("string")
    grp = F.coalesce(category_group(cat), F.lit(UNMAPPED))
    for k, g in enumerate(list(GROUP_ORDER) + [UNMAPPED]):
        aggs += _agg_cols(f"g{k}", grp == g, amount)
    return sel.groupBy(qcol(fields.year).alias(fields.year)).agg(*aggs)


def _value(prefix: str, strict: bool) -> Column:
    n, s, nn = F.col(f"n_{prefix}"), F.col(f"s_{prefix}"), F.col(f"nn_{prefix}")
    if strict:
        return F.when((n > 0) & (nn == n), s)
    return F.when(n > 0, F.coalesce(s, F.lit(0.0)))


def _present(prefixes: Sequence[str]) -> Column:
    return F.greatest(*[F.col(f"n_{p}") > 0 for p in prefixes]) if len(prefixes) > 1 else F.col(f"n_{prefixes[0]}") > 0


def _total(strict: bool) -> Column:
    return _value("total", strict)


def _order(df: DataFrame, fields: Fields) -> DataFrame:
    """Year order for a report (one row per year): the finished rows meet in a single
    partition sorted in place, instead of a global sort's range shuffle and
    bound-sampling job; the aggregation below stays dealt by year."""
    return df.repartition(1).sortWithinPartitions(qcol(fields.year))


def spend_by_class(sel: DataFrame, taxonomy: Taxonomy, fields: Fields = DEFAULT, strict_nulls: bool = True, summary: DataFrame | None = None) -> DataFrame:
    """Year × class spend (wide, classes in report order)."""
    s = summary if summary is not None else year_summary(sel, taxonomy, fields)
    ps = [f"c{i}" for i in range(len(taxonomy.classes))]
    out = s.where(_present(ps)).select(
        qcol(fields.year), *[_value(p, strict_nulls).alias(c) for p, c in zip(ps, taxonomy.classes)]
    )
    return _order(out, fields)


def class_share(sel: DataFrame, taxonomy: Taxonomy, fields: Fields = DEFAULT, strict_nulls: bool = True, summary: DataFrame | None = None) -> DataFrame:
    """Year × class share of all selected spend of the year (classes overlap: shares need not sum to 1)."""
    s = summary if summary is not None else year_summary(sel, taxonomy, fields)
    ps = [f"c{i}" for i in range(len(taxonomy.classes))]
    total = _total(strict_nulls)
    out = s.where(_present(ps)).select(
        qcol(fields.year), *[F.try_divide(_value(p, strict_nulls), total).alias(c) for p, c in zip(ps, taxonomy.classes)]
    )
    return _order(out, fields)


def stack_total(sel: DataFrame, taxonomy: Taxonomy, fields: Fields = DEFAULT, strict_nulls: bool = True, summary: DataFrame | None = None) -> DataFrame:
    """Sum of the class shares present in each year (the height of the stacked share chart)."""
    s = summary if summary is not None else year_summary(sel, taxonomy, fields)
    ps = [f"c{i}" for i in range(len(taxonomy.classes))]
    total = _total(strict_nulls)
    terms = [F.when(F.col(f"n_{p}") > 0, F.try_divide(_value(p, strict_nulls), total)).otherwise(F.lit(0.0)) for p in ps]
    stacked = terms[0]
    for t in terms[1:]:
        stacked = stacked + t
    return _order(s.where(_present(ps)).select(qcol(fields.year), stacked.alias("stack_total")), fields)


def spend_by_group(sel: DataFrame, taxonomy: Taxonomy, fields: Fields = DEFAULT, summary: DataFrame | None = None, include_unmapped: bool = True) -> DataFrame:
    """Year × finance group (ODA, OOF, Private, and ``unmapped`` for other or NULL categories).
    NULL amounts are skipped; a group with no row in the year is NULL."""
    s = summary if summary is not None else year_summary(sel, taxonomy, fields)
    groups = list(GROUP_ORDER) + ([UNMAPPED] if include_unmapped else [])
    cols = [_value(f"g{k}", strict=False).alias(g) for k, g in enumerate(groups)]
    return _order(s.select(qcol(fields.year), *cols), fields)


def location_share(sel: DataFrame, taxonomy: Taxonomy, fields: Fields = DEFAULT, strict_nulls: bool = True, summary: DataFrame | None = None) -> DataFrame:
    """Year × location share of located spend; the denominator is the sum of the
    location sums, so an activity flagged both urban and rural counts twice."""
    s = summary if summary is not None else year_summary(sel, taxonomy, fields)
    ps = [f"l{j}" for j in range(len(taxonomy.locations))]
    vals = [_value(p, strict_nulls) for p in ps]
    terms = [F.when(F.col(f"n_{p}") > 0, v).otherwise(F.lit(0.0)) for p, v in zip(ps, vals)]
    located = terms[0]
    for t in terms[1:]:
        located = located + t
    out = s.where(_present(ps)).select(
        qcol(fields.year), *[F.try_divide(v, located).alias(c) for v, c in zip(vals, taxonomy.locations)]
    )
    return _order(out, fields)


def all_reports(sel: DataFrame, taxonomy: Taxonomy, fields: Fields = DEFAULT, strict_nulls: bool = True) -> dict[str, DataFrame]:
    """The four report tables and the stack total from a single aggregation of ``sel``.

    The per-year summary is tiny (one row per year) and is checkpointed, so the
    selected activities are scanned once for all reports.
    """
    checkpoint_root(sel.sparkSession)
    summary = year_summary(sel, taxonomy, fields).checkpoint(eager=True)
    return {
        "spend_by_class": spend_by_class(sel, taxonomy, fields, strict_nulls, summary),
        "class_share": class_share(sel, taxonomy, fields, strict_nulls, summary),
        "stack_total": stack_total(sel, taxonomy, fields, strict_nulls, summary),
        "spend_by_group": spend_by_group(sel, taxonomy, fields, summary),
        "location_share": location_share(sel, taxonomy, fields, strict_nulls, summary),
    }


def melt_flags(sel: DataFrame, flags: Sequence[str], fields: Fields = DEFAULT, variable: str = "variable", value: str = "flag") -> DataFrame:
    """Flags to long form: (year, amount, variable, flag) — one row per activity and flag."""
    return sel.select(qcol(fields.year), qcol(fields.amount), *[qcol(c) for c in flags]).unpivot(
        [fields.year, fields.amount], list(flags), variable, value
    )


def spend_long(sel: DataFrame, flags: Sequence[str], fields: Fields = DEFAULT, strict_nulls: bool = True) -> DataFrame:
    """Long table (year, variable, amount, total, share) of TRUE flags.

    One aggregation per year over ``sel`` gives every flag's sums and the year's total;
    only its few rows are unpivoted, not the activities.
    """
    amount = qcol(fields.amount).cast("double")
    aggs = [*_agg_cols("total", F.lit(True), amount)]
    for k, c in enumerate(flags):
        aggs += _agg_cols(f"f{k}", F.coalesce(qcol(c), F.lit(False)), amount)
    years = sel.groupBy(qcol(fields.year)).agg(*aggs)

    def value(prefix: str) -> Column:
        return _value(prefix, True) if strict_nulls else F.col(f"s_{prefix}")

    rows = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"n_f{k}").alias("n"), value(f"f{k}").alias("v")) for k, c in enumerate(flags)])
    out = years.select(qcol(fields.year), value("total").alias("total"), F.explode(rows).alias("r")).where(F.col("r.n") > 0)
    return out.select(qcol(fields.year), F.col("r.variable").alias("variable"), F.col("r.v").alias(fields.amount), F.col("total"), F.try_divide(F.col("r.v"), F.col("total")).alias("share"))


_TOTAL = "__total"


def spend_melted(sel: DataFrame, flags: Sequence[str], fields: Fields = DEFAULT, strict_nulls: bool = True) -> DataFrame:
    """The table of ``spend_long`` by the molten route: flags unpivoted (with one that is
    always TRUE, for the totals), TRUE rows summed by year and flag, and the sums joined
    with their year's total. The sums, a few rows a year, are checkpointed, so the
    activities are read once for both sides of the join."""
    checkpoint_root(sel.sparkSession)
    long = melt_flags(sel.withColumn(_TOTAL, F.lit(True)), [*flags, _TOTAL], fields).where(F.col("flag"))
    amount = qcol(fields.amount).cast("double")
    sums = long.groupBy(qcol(fields.year), F.col("variable")).agg((strict_sum(amount) if strict_nulls else F.sum(amount)).alias("__sum")).checkpoint(eager=True)
    totals = sums.where(F.col("variable") == _TOTAL).select(qcol(fields.year), F.col("__sum").alias("total"))
    joined = sums.where(F.col("variable") != _TOTAL).join(totals, on=fields.year)
    return joined.select(qcol(fields.year), "variable", F.col("__sum").alias(fields.amount), "total", F.try_divide("__sum", "total").alias("share"))


def pivot_long(long: DataFrame, values: Sequence[str], value_col: str, fields: Fields = DEFAULT, variable: str = "variable") -> DataFrame:
    """Long (year, variable, value) → one row per year, one column per value in the
    given order (explicit values: no extra job to discover them). ``(year, variable)``
    must be unique in ``long``, as ``spend_long`` gives."""
    wide = long.groupBy(qcol(fields.year)).pivot(variable, list(values)).agg(F.max(qcol(value_col)))
    return _order(wide, fields)


def _selection_aggs(fields: Fields) -> list[Column]:
    anyf, sector, sans = qcol(fields.any_flag), qcol(fields.sector_flag), qcol(fields.any_sans_sector)
    return [
        F.count(F.lit(1)).alias("n_all"),
        F.count_if(anyf).alias("n_selected"),
        F.sum(F.when(anyf, qcol(fields.amount).cast("double"))).alias("selected_amount"),
        F.count_if(anyf & sans.isNull()).alias("n_unlabelled_selected"),
        F.count_if(sector & ~sans).alias("n_false_negative"),
    ]


SELECTION_SCHEMA = "n_all long, n_selected long, selection_rate double, selected_amount double, n_unlabelled_selected long, n_false_negative long"
SELECTION_COLUMNS = ["n_all", "n_selected", "selection_rate", "selected_amount", "n_unlabelled_selected", "n_false_negative"]


def selection_summary(marked: DataFrame, fields: Fields = DEFAULT) -> DataFrame:
    """One row: activities, selected, selection rate, selected spend (NULL amounts skipped),
    selected but unlabelled, false-negative candidates."""
    agg = marked.agg(*_selection_aggs(fields))
    return agg.select(*[F.try_divide(F.col("n_selected"), F.col("n_all")).alias(c) if c == "selection_rate" else F.col(c) for c in SELECTION_COLUMNS])


class SelectionObservation:
    """The selection summary gathered while another action (e.g. writing the selected
    activities) scans the marked table: no extra pass."""

    def __init__(self, fields: Fields = DEFAULT, name: str = "selection"):
        from pyspark.sql import Observation

        self.fields = fields
        self.obs = Observation(name)

    def attach(self, marked: DataFrame) -> DataFrame:
        return marked.observe(self.obs, *_selection_aggs(self.fields))

    def get(self) -> dict:
        m = dict(self.obs.get)
        m["selection_rate"] = m["n_selected"] / m["n_all"] if m["n_all"] else None
        return {c: m[c] for c in SELECTION_COLUMNS}


def drop_unobserved(report: DataFrame, fields: Fields = DEFAULT) -> DataFrame:
    """Drop value columns that are NULL in every row (the original tables only have
    columns for observed classes). Reports have one row per year, so the check
    reads a handful of rows."""
    value_cols = [c for c in report.columns if c != fields.year]
    counts = report.agg(*[F.count(qcol(c)).alias(c) for c in value_cols]).first().asDict()
    return report.select(qcol(fields.year), *[qcol(c) for c in value_cols if counts[c] > 0])
