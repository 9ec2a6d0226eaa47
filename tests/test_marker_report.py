import pytest
from pyspark.sql import functions as F

from spendlens.fields import Fields
from spendlens.operators import report as rp
from spendlens.operators.marker import false_negatives, mark, select_marked
from spendlens.sources.dimensions import category_group
from spendlens.taxonomy import CONTINUUM, Taxonomy

T3 = Taxonomy(name="t", suffix="_t", classes=("k", "g"), residual="g", locations=("Urban", "Rural"), sector_codes=("16030", "16040"))
FX = Fields(year="Year", amount="amt", purpose_code="code", category="Category")


def test_selection_truth_table(spark):
    # FIXTURES §3.3: s, k, g -> any, any_sans_sector, selected, residual after overwrite, false negative
    rows = [
        (1, "16030", None, None, True, None, True, None, False),
        (2, "11110", None, None, None, None, False, None, False),
        (3, "16040", False, False, True, False, True, True, True),
        (4, "11110", False, False, False, False, False, None, False),
        (5, "11110", False, True, True, True, True, True, False),
        (6, "11110", True, True, True, True, True, False, False),
        (7, "16030", True, False, True, True, True, False, False),
        (8, None, False, False, False, False, False, None, False),
    ]
    df = spark.createDataFrame(
        rows,
        "id int, code string, k boolean, g boolean, e_any boolean, e_sans boolean, e_sel boolean, e_resid boolean, e_fn boolean",
    ).withColumn("Urban", F.lit(None).cast("boolean")).withColumn("Rural", F.lit(None).cast("boolean"))
    m = mark(df, T3, FX)
    for r in m.collect():
        assert r["any"] == r.e_any, r
        assert r.any_sans_sector == r.e_sans, r
        assert r["Sector code"] is (r.code in ("16030", "16040")), r  # never NULL
    sel = {r.id: r.g for r in select_marked(m, T3, FX).collect()}
    assert set(sel) == {r[0] for r in rows if r[6]}
    for r in rows:
        if r[6]:
            assert sel[r[0]] == r[7], r
    assert {r.id for r in false_negatives(m, FX).collect()} == {r[0] for r in rows if r[8]}


def test_string_class_columns_are_converted(spark):
    df = spark.createDataFrame([("16030", "True", "False", "")], "code string, k string, g string, Urban string")
    r = mark(df, T3, FX).first()
    assert r.k is True and r.g is False and r.Urban is None and r.Rural is None


def test_category_map(spark):
    # FIXTURES §3.4
    codes = ["10", "21", "30", "60", "22", "36", "37", "40", "50", "99", None, " 10 "]
    df = spark.createDataFrame([(c,) for c in codes], "c string")
    got = [r.g for r in df.select(category_group("c").alias("g")).collect()]
    assert got == ["ODA", "OOF", "Private", "Private", None, None, None, None, None, None, None, "ODA"]


def _overlap_sel(spark):
    # FIXTURES §3.6: amounts 10 (A and B, Urban), 20 (A, Urban and Rural), 70 (unlabelled, sector)
    t = Taxonomy(name="o", suffix="", classes=("A", "B", "G"), residual="G", locations=("Urban", "Rural"))
    rows = [
        (2024, 10.0, "10", "11110", True, True, False, True, False),
        (2024, 20.0, "21", "11110", True, False, False, True, True),
        (2024, 70.0, "30", "16030", None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "Year int, amt double, Category string, code string, A boolean, B boolean, G boolean, Urban boolean, Rural boolean")
    return t, select_marked(mark(df, t, FX), t, FX)


def test_overlap_arithmetic(spark):
    t, sel = _overlap_sel(spark)
    share = rp.class_share(sel, t, FX).first()
    assert share.A == pytest.approx(0.30) and share.B == pytest.approx(0.10) and share.G is None
    assert rp.stack_total(sel, t, FX).first().stack_total == pytest.approx(0.40)
    loc = rp.location_share(sel, t, FX).first()
    assert loc.Urban == pytest.approx(0.6) and loc.Rural == pytest.approx(0.4)
    grp = rp.spend_by_group(sel, t, FX).first()
    assert (grp.ODA, grp.OOF, grp.Private, grp.unmapped) == (10.0, 20.0, 70.0, None)
    spend = rp.spend_by_class(sel, t, FX).first()
    assert (spend.A, spend.B, spend.G) == (30.0, 10.0, None)


def test_unpivot_route_equals_conditional_sums(spark):
    t, sel = _overlap_sel(spark)
    long = {(r.variable): (r.amt, r.share) for r in rp.spend_long(sel, list(t.classes), FX).collect()}
    wide = rp.spend_by_class(sel, t, FX).first().asDict()
    shares = rp.class_share(sel, t, FX).first().asDict()
    for c in t.classes:
        if c in long:
            assert long[c][0] == pytest.approx(wide[c]) and long[c][1] == pytest.approx(shares[c])
        else:
            assert wide[c] is None


def test_strict_nulls(spark):
    t = Taxonomy(name="s", suffix="", classes=("A", "G"), residual="G", locations=("Urban", "Rural"))
    rows = [(2024, None, "16030", True, None), (2024, 5.0, "16030", True, None), (2025, 3.0, "16030", True, None)]
    df = spark.createDataFrame(rows, "Year int, amt double, code string, A boolean, G boolean")
    df = df.withColumn("Urban", F.lit(None).cast("boolean")).withColumn("Rural", F.lit(None).cast("boolean"))
    sel = select_marked(mark(df, t, FX), t, FX)
    strict = {r.Year: r.A for r in rp.spend_by_class(sel, t, FX).collect()}
    lenient = {r.Year: r.A for r in rp.spend_by_class(sel, t, FX, strict_nulls=False).collect()}
    assert strict == {2024: None, 2025: 3.0}
    assert lenient == {2024: 5.0, 2025: 3.0}


def test_year_without_true_class_has_no_row(spark):
    t = Taxonomy(name="y", suffix="", classes=("A", "G"), residual="G", locations=("Urban", "Rural"))
    rows = [(2023, 1.0, "16030", None, None), (2024, 2.0, "11110", True, False)]
    df = spark.createDataFrame(rows, "Year int, amt double, code string, A boolean, G boolean")
    df = df.withColumn("Urban", F.lit(None).cast("boolean")).withColumn("Rural", F.lit(None).cast("boolean"))
    sel = select_marked(mark(df, t, FX), t, FX)
    assert [r.Year for r in rp.class_share(sel, t, FX).collect()] == [2024]
    assert [r.Year for r in rp.spend_by_group(sel, t, FX).collect()] == [2023, 2024]
    assert rp.location_share(sel, t, FX).count() == 0


def test_all_reports_and_drop_unobserved(spark):
    t, sel = _overlap_sel(spark)
    reps = rp.all_reports(sel, t, FX)
    assert set(reps) == {"spend_by_class", "class_share", "stack_total", "spend_by_group", "location_share"}
    assert rp.drop_unobserved(reps["spend_by_class"], FX).columns == ["Year", "A", "B"]


def test_selection_summary(spark):
    t, sel = _overlap_sel(spark)
    s = rp.selection_summary(mark(sel.drop("Sector code", "any", "any_sans_sector"), t, FX), FX).first()
    assert (s.n_all, s.n_selected, s.selection_rate, s.selected_amount, s.n_unlabelled_selected) == (3, 3, 1.0, 100.0, 1)


def test_continuum_taxonomy_shape():
    assert CONTINUUM.residual == "Housing in general" and len(CONTINUUM.classes) == 6 and CONTINUUM.locations == ("Urban", "Rural")
    assert CONTINUUM.specific == ("Homelessness", "Transitional housing", "Incremental housing", "Social housing", "Market housing")
    p = CONTINUUM.system_prompt()
    assert "- Housing in general: when the text explicitly describes" in p and p.endswith("}")


def test_taxonomy_from_json(tmp_path):
    import json

    p = tmp_path / "t.json"
    p.write_text(json.dumps({"name": "water", "classes": ["Pipes", "Other"], "residual": "Other", "sector_codes": [14020],
                             "definitions": {"Pipes": "mentions pipes", "Other": "is about water", "Urban": "u", "Rural": "r"}}))
    t = Taxonomy.from_json(str(p))
    assert t.suffix == "_water" and t.specific == ("Pipes",) and t.sector_codes == ("14020",)
    assert t.vocabulary == ("Pipes", "Other", "Urban", "Rural")
    assert "- Pipes: when the text mentions pipes" in t.system_prompt()
