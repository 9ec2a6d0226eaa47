"""
plain-Python reference, and report identities on the fixture relations."""

import itertools

import pytest
from pyspark.sql import functions as F

from spendlens.fields import Fields
from spendlens.operators import report as rp
from spendlens.operators.marker import false_negatives, mark, select_marked
from spendlens.plans import fixtures as fx
from spendlens.plans.fixtures import FIX, FIXTURE_TAXONOMY as T
from spendlens.taxonomy import Taxonomy

from paths import SF_SMALL

T4 = Taxonomy(name="p", suffix="", classes=("A", "B", "G"), residual="G", locations=("Urban", "Rural"))
FX = Fields(year="Year", amount="amt", purpose_code="code")


def k_or(*v):
    if any(x is True for x in v):
        return True
    if any(x is None for x in v):
        return None
    return False


def k_and(*v):
    if any(x is False for x in v):
        return False
    if any(x is None for x in v):
        return None
    return True


def k_not(x):
    return None if x is None else not x


def test_marker_logic_exhaustive(spark):
    tri = [True, False, None]
    rows = [(i, code, a, b, g) for i, (code, a, b, g) in enumerate(itertools.product(["16030", "11110", None], tri, tri, tri))]
    df = spark.createDataFrame(rows, "id int, code string, A boolean, B boolean, G boolean")
    df = df.withColumn("Year", F.lit(2024)).withColumn("amt", F.lit(1.0))
    m = {r.id: r for r in mark(df, T4, FX).collect()}
    sel = {r.id: r for r in select_marked(mark(df, T4, FX), T4, FX).collect()}
    fn = {r.id for r in false_negatives(mark(df, T4, FX), FX).collect()}
    for i, code, a, b, g in rows:
        sector = code == "16030"
        sans = k_or(a, b, g)
        anyf = k_or(a, b, g, sector)
        assert m[i]["Sector code"] is sector and m[i].any_sans_sector == sans and m[i]["any"] == anyf
        assert (i in sel) == (anyf is True)
        if i in sel:
            assert sel[i].G == k_and(k_not(a), k_not(b))
        assert (i in fn) == (k_and(sector, k_not(sans)) is True)


@pytest.fixture(scope="module")
def sel_small(spark):
    return fx.selected(spark, SF_SMALL).cache()


def test_attach_keeps_row_count(spark):
    assert fx.marked(spark, SF_SMALL).count() == fx.activities(spark, SF_SMALL).count()


def test_report_identities(spark, sel_small):
    totals = {r.yr: r.t for r in sel_small.groupBy("yr").agg(F.sum("amount").alias("t")).collect()}
    spend = {r.yr: r.asDict() for r in rp.spend_by_class(sel_small, T, FIX).collect()}
    share = {r.yr: r.asDict() for r in rp.class_share(sel_small, T, FIX).collect()}
    stack = {r.yr: r.stack_total for r in rp.stack_total(sel_small, T, FIX).collect()}
    groups = {r.yr: r.asDict() for r in rp.spend_by_group(sel_small, T, FIX).collect()}
    pivot = {r.yr: r.asDict() for r in rp.pivot_long(rp.spend_long(sel_small, list(T.classes), FIX), list(T.classes), "amount", FIX).collect()}
    assert set(spend) == set(share) == set(stack) == set(pivot)
    for y, row in spend.items():
        present = [row[c] for c in T.classes if row[c] is not None]
        assert all(v <= totals[y] + 1e-6 for v in present)  # class sum <= total
        for c in T.classes:
            if row[c] is None:
                assert share[y][c] is None and pivot[y][c] is None
            else:
                assert share[y][c] == pytest.approx(row[c] / totals[y])  # Q2 = Q1 / A5
                assert pivot[y][c] == pytest.approx(row[c])  # unpivot route = conditional sums
        assert stack[y] == pytest.approx(sum(share[y][c] for c in T.classes if share[y][c] is not None))
    for y, row in groups.items():
        assert sum(v for k, v in row.items() if k != "yr" and v is not None) == pytest.approx(totals[y])


def test_fixture_counts_match_fixtures_md(spark, sel_small):
    # FIXTURES.md §2 table, sf0.001 row
    m = fx.marked(spark, SF_SMALL)
    assert fx.activities(spark, SF_SMALL).count() == 1500
    assert fx.lab(spark, SF_SMALL).count() == 86
    assert sel_small.count() == 841
    assert sel_small.where(F.col("c1").isNull()).count() == 222
    assert false_negatives(m, FIX).count() == 0
    assert m.where("c1 AND c2").count() == 73
    assert m.where("any_flag AND NOT c1 AND NOT c2").count() == 7


def _strict_sum(vals):
    return None if any(v is None for v in vals) else sum(vals)


def _reference_reports(rows, classes, locations):
    """Plain-Python statement of the report rules (rows: Year, amt, Category, flags...)."""
    groups = {"10": "ODA", "21": "OOF", "30": "Private", "60": "Private"}
    years = sorted({r["Year"] for r in rows})
    spend, share, stack, group, loc = {}, {}, {}, {}, {}
    for y in years:
        yr = [r for r in rows if r["Year"] == y]
        total = _strict_sum([r["amt"] for r in yr])
        present = {c: [r["amt"] for r in yr if r[c] is True] for c in classes}
        present = {c: v for c, v in present.items() if v}
        if present:
            spend[y] = {c: (_strict_sum(present[c]) if c in present else None) for c in classes}
            share[y] = {c: (None if spend[y][c] is None or total is None else spend[y][c] / total) for c in classes}
            shares = [share[y][c] for c in present]
            stack[y] = None if any(s is None for s in shares) else sum(shares)
        g = {}
        for r in yr:
            g.setdefault(groups.get(r["Category"], "unmapped"), []).append(r["amt"])
        group[y] = {k: sum(v for v in vals if v is not None) for k, vals in g.items()}
        lp = {c: [r["amt"] for r in yr if r[c] is True] for c in locations}
        lp = {c: v for c, v in lp.items() if v}
        if lp:
            vals = {c: _strict_sum(v) for c, v in lp.items()}
            located = _strict_sum(list(vals.values()))
            loc[y] = {c: (None if c not in vals or vals[c] is None or located is None else vals[c] / located) for c in locations}
    return spend, share, stack, group, loc


def test_report_null_rules_randomized(spark):
    import random

    rnd = random.Random(3)
    tri = [True, False, None]
    classes, locations = ("A", "B", "G"), ("Urban", "Rural")
    rows = []
    for i in range(400):
        r = {"Year": rnd.choice([2021, 2022, 2023]), "amt": None if rnd.random() < 0.03 else round(rnd.uniform(0.5, 9.5), 3),
             "Category": rnd.choice(["10", "21", "30", "60", "40", None])}
        for c in classes + locations:
            r[c] = rnd.choice(tri) if rnd.random() < 0.8 else False
        if r["Year"] == 2023:  # a year where nothing but G and Urban is ever true
            r["A"] = r["B"] = None
        rows.append(r)
    t = Taxonomy(name="r", suffix="", classes=classes, residual="G", locations=locations)
    fx_ = Fields(year="Year", amount="amt", category="Category")
    schema = "Year int, amt double, Category string, A boolean, B boolean, G boolean, Urban boolean, Rural boolean"
    sel = spark.createDataFrame([tuple(r[k] for k in ["Year", "amt", "Category", *classes, *locations]) for r in rows], schema)
    spend, share, stack, group, loc = _reference_reports(rows, classes, locations)

    def rows_of(df):
        return {r["Year"]: r.asDict() for r in df.collect()}

    def close(a, b):
        return (a is None and b is None) or (a is not None and b is not None and a == pytest.approx(b))

    got = rows_of(rp.spend_by_class(sel, t, fx_))
    assert set(got) == set(spend) and all(close(got[y][c], spend[y][c]) for y in spend for c in classes)
    got = rows_of(rp.class_share(sel, t, fx_))
    assert set(got) == set(share) and all(close(got[y][c], share[y][c]) for y in share for c in classes)
    got = rows_of(rp.stack_total(sel, t, fx_))
    assert set(got) == set(stack) and all(close(got[y]["stack_total"], stack[y]) for y in stack)
    got = rows_of(rp.spend_by_group(sel, t, fx_))
    assert set(got) == set(group)
    for y in group:
        for k in ("ODA", "OOF", "Private", "unmapped"):
            assert close(got[y][k], group[y].get(k)), (y, k)
    got = rows_of(rp.location_share(sel, t, fx_))
    assert set(got) == set(loc) and all(close(got[y][c], loc[y][c]) for y in loc for c in locations)
