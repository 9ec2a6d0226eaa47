"""Landing: years with different columns, CSV records cut in parallel, file order, rejected
rows, derived tables replaced whole."""

import csv
import io
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens.fields import Fields
from spendlens.plans import stages as pl
from spendlens.sources import csv_records, ingest, sinks
from spendlens.sources.evolve import collate, common_type, drop_partitions, read_landed

FLD = Fields()
AMOUNT = FLD.amount


@pytest.fixture()
def small_splits(spark):
    """Splits of 200 bytes: records span several of them."""
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize(
    "a, b, want",
    [
        (T.IntegerType(), T.LongType(), T.LongType()),
        (T.IntegerType(), T.DoubleType(), T.DoubleType()),
        (T.DecimalType(10, 2), T.LongType(), T.DoubleType()),
        (T.StringType(), T.BooleanType(), T.StringType()),
        (T.NullType(), T.DateType(), T.DateType()),
        (T.DateType(), T.TimestampNTZType(), T.TimestampNTZType()),
        (T.DateType(), T.TimestampType(), T.TimestampType()),
        (T.ArrayType(T.LongType()), T.ArrayType(T.LongType()), T.ArrayType(T.LongType())),
    ],
)
def test_common_type(a, b, want):
    assert common_type(a, b) == common_type(b, a) == want


def test_types_without_a_common_one():
    with pytest.raises(ValueError):
        common_type(T.ArrayType(T.LongType()), T.StringType())


def test_collate_reconciles_types(spark):
    a = spark.createDataFrame([(1, "x")], "n int, c string")
    b = spark.createDataFrame([(2.5, 7)], "N double, extra bigint")
    out = collate([a, b])
    assert out.columns == ["n", "c", "extra"]
    assert sorted(map(tuple, out.collect()), key=str) == [(1.0, "x", None), (2.5, None, 7)]
    with pytest.raises(ValueError):
        collate([])


@pytest.mark.parametrize("first", [2023, 2024])
def test_columns_of_any_landed_year_are_read(spark, tmp_root, first):
    layout = pl.Layout(tmp_root)
    drops = {
        2023: spark.createDataFrame([(2023, 1.0, 5, "t")], f"Year int, {AMOUNT} double, code int, text string"),
        2024: spark.createDataFrame([(2024, 2.0, "A1", "u", "e")], f"Year int, {AMOUNT} double, code string, text string, extra string"),
    }
    for y in (first, 4047 - first):
        pl.land(drops[y], layout)
    got = {r.Year: (r.code, r.extra) for r in ingest.read_years(spark, layout.landed, None).collect()}
    assert got == {2023: ("5", None), 2024: ("A1", "e")}
    one = ingest.read_years(spark, layout.landed, [2023])
    assert "extra" not in one.columns and one.count() == 1 and dict(one.dtypes)["code"] == "int"
    assert read_landed(spark, layout.landed, [1900]).count() == 0
    drop_partitions(spark, layout.landed, "Year", [2023, 1900])
    assert [r.Year for r in read_landed(spark, layout.landed).collect()] == [2024]


def test_each_schema_is_one_scan(spark, tmp_root):
    for y in range(2000, 2006):
        extra = {"a": F.lit(1)} if y > 2003 else {}
        sinks.write_by_year(spark.range(3).select(F.lit(y).alias("Year"), "id").withColumns(extra), tmp_root)
    df = read_landed(spark, tmp_root)
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan") == 2
    assert df.count() == 18 and df.where("a = 1").count() == 6


def _csv(rows, end="\r\n"):
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows(rows)
    return out.getvalue()


def test_records_are_those_of_a_csv_parser(spark, tmp_root, small_splits):
    r = random.Random(4)
    bits = ["a", "b ", '"', "\n", ",", "é", "\r\n", "xyz" * 30, "''", " "]
    files = {}
    for k, end in enumerate(["\n", "\r\n", "\n"]):
        rows = [["id", "text", "more"]]
        rows += [[f"{k}-{i}", "".join(r.choice(bits) for _ in range(r.choice([0, 3, 8, 40]))), r.choice(["", "m", "q\nq"])] for i in range(120)]
        path = os.path.join(tmp_root, f"f{k}.csv")
        with open(path, "w", encoding="utf-8", newline="") as f:
            f.write(_csv(rows, end))
        files[path] = rows[1:]
    parsed = ingest.read_csv_records(spark, os.path.join(tmp_root, "f*.csv"))
    tasks = csv_records._lines(spark, list(files)).rdd.getNumPartitions()
    assert tasks > 60  # many tasks a file
    rows = parsed.orderBy(f"{csv_records.RECORD}.ordinal").collect()
    want = [tuple(c or None for c in x) for name in sorted(files) for x in files[name]]
    assert [(x.id, x.text, x.more) for x in rows] == want  # in file order, too
    strings = ingest.read_csv_strings(spark, os.path.join(tmp_root, "f*.csv"))
    assert strings.columns == ["id", "text", "more"] and strings.count() == 360


def test_one_record_over_many_splits(spark, tmp_root, small_splits):
    path = os.path.join(tmp_root, "long.csv")
    text = "line of text\n" * 200
    with open(path, "w", newline="") as f:
        f.write(_csv([["id", "text"], ["1", text], ["2", "x"], ["3", text]], "\n"))
    got = {r.id: r.text for r in ingest.read_csv_strings(spark, path).collect()}
    assert got == {"1": text, "2": "x", "3": text}


def test_a_quote_that_is_never_closed_is_an_error(spark, tmp_root):
    path = os.path.join(tmp_root, "open.csv")
    with open(path, "w") as f:
        f.write('id,text\n1,"a\n2,b\n')
    with pytest.raises(Exception, match="never closed"):
        ingest.read_csv_strings(spark, path).collect()


def test_surplus_cells(spark, tmp_root):
    raw = os.path.join(tmp_root, "raw")
    os.makedirs(raw)
    with open(os.path.join(raw, "crs_2020.csv"), "w") as f:
        f.write(f'{AMOUNT},LongDescription\n1,"a, b"\n2,x,"y, ""z"""\n3\n\n4,d\n')
    layout = pl.Layout(os.path.join(tmp_root, "out"))
    assert pl.land_yearly_csv(spark, os.path.join(raw, "crs_{year}.csv"), [2020], layout) == 1
    landed = ingest.read_years(spark, layout.landed, None).orderBy("ord").collect()
    assert [(r.LongDescription, r[AMOUNT], r.Year) for r in landed] == [("a, b", 1.0, 2020), (None, 3.0, 2020), ("d", 4.0, 2020)]  # a short row is filled up
    bad = spark.read.parquet(layout.rejected).collect()
    assert [(r.record, r.n_cells, r.Year) for r in bad] == [('2,x,"y, ""z"""', 3, 2020)]
    with pytest.raises(Exception, match="more cells"):
        ingest.read_csv_strings(spark, os.path.join(raw, "crs_2020.csv")).collect()
    with open(os.path.join(raw, "crs_2020.csv"), "w") as f:
        f.write(f"{AMOUNT},LongDescription\n1,a\n")
    assert pl.land_yearly_csv(spark, os.path.join(raw, "crs_{year}.csv"), [2020], layout) == 0
    from spendlens.sources.evolve import partition_folders

    assert partition_folders(spark, layout.rejected, "Year") == {}  # sound now


def test_first_activity_is_that_of_the_first_file(spark, tmp_root):
    for name, n in (("2024_a.csv", 3), ("2024_b.csv", 300)):
        with open(os.path.join(tmp_root, name), "w") as f:
            f.write(f"{AMOUNT},LongDescription,PurposeCode\n" + "".join(f"1,text {i},{name[5]}{i}\n" for i in range(n)))
    layout = pl.Layout(os.path.join(tmp_root, "out"))
    pl.land_yearly_csv(spark, os.path.join(tmp_root, "{year}_*.csv"), [2024], layout)
    pl.prepare(spark, layout)
    codes = {r.PurposeCode for r in spark.read.parquet(layout.prepared).where("text in ('text 0', 'text 2', 'text 7')").collect()}
    assert codes == {"a0", "a2", "b7"}


def test_paths_with_blanks_and_signs(spark, tmp_root):
    folder = os.path.join(tmp_root, "a b%20c")
    os.makedirs(folder)
    with open(os.path.join(folder, "x +1.csv"), "w") as f:
        f.write("a\n1\n")
    assert [r.a for r in ingest.read_csv_strings(spark, folder).collect()] == ["1"]


def test_the_text_key_is_stored_and_empty_texts_are_built_again(spark, tmp_root):
    layout = pl.Layout(tmp_root)
    acts = spark.createDataFrame([(2024, 1.0, "title", "long", None), (2024, 1.0, "title", "long", "own")], f"Year int, {AMOUNT} double, ProjectTitle string, LongDescription string, text string")
    pl.land(acts, layout)
    landed = ingest.read_years(spark, layout.landed, None)
    assert "text_key" in landed.columns
    pl.prepare(spark, layout)
    assert {r.text for r in spark.read.parquet(layout.prepared).collect()} == {"title long", "own"}


def test_replacing_drops_years_without_rows(spark, tmp_root):
    rows = spark.range(4).select((F.col("id") % 2 + 2000).cast("int").alias("Year"), "id")
    sinks.write_by_year(rows, tmp_root, replace=True)
    sinks.write_by_year(rows.where("Year = 2001"), tmp_root)
    assert spark.read.parquet(tmp_root).count() == 4
    sinks.write_by_year(rows.where("Year = 2001"), tmp_root, replace=True)
    assert {r.Year for r in spark.read.parquet(tmp_root).collect()} == {2001}


def test_texts_are_landed_once_and_come_back(spark, tmp_root):
    from spendlens.operators import label as lb
    from spendlens.operators.prepare import with_texts
    from spendlens.taxonomy import CONTINUUM

    f = Fields(year="yr", amount="amount", ordinal="ord", text="txt", purpose_code="code")
    # a key that two texts share, a NULL and an empty text, a row without key
    rows = [(2000 + i % 3, 1.0, i, f"text {i % 4}", "k" if i % 4 < 2 else f"k{i % 4}", "16030") for i in range(40)]
    rows += [(2000, 1.0, 40, None, "", "1"), (2000, 1.0, 41, "", "", "1"), (2001, 1.0, 42, "no key", None, "1")]
    acts = spark.createDataFrame(rows, "yr int, amount double, ord long, txt string, text_key string, code string")
    layout = pl.Layout(tmp_root)
    pl.land(acts, layout, f)
    pl.land(acts.where("yr = 2001"), layout, f)  # its texts are there already
    assert spark.read.parquet(layout.texts).count() == 6
    landed = ingest.read_years(spark, layout.landed, None, fields=f)
    assert "txt" not in landed.columns
    want = {r[2]: (r[3], r[4]) for r in rows}
    back = with_texts(landed, spark.read.parquet(layout.texts), f)
    assert back.count() == 43 and {r.ord: (r.txt, r.text_key) for r in back.collect()} == want
    funnel = pl.prepare(spark, layout, f, estimate_cost=False)
    prepared = {r.text_key: (r.txt, r.ord, r.n_activities) for r in spark.read.parquet(layout.prepared).collect()}
    assert prepared == {"k": ("text 0", 0, 20), "k2": ("text 2", 6, 10), "k3": ("text 3", 3, 10)}
    assert funnel == {"n_start": 42, "n_duplicates": 38, "n_blank": 1, "n_end": 3}
    pl.label(spark, layout, CONTINUUM, lambda: lb.KeywordClassifier({"Urban": ["text 2"]}), f, system_prompt="p", num_partitions=1)
    pl.merge(spark, layout, CONTINUUM, f)
    pl.report(spark, layout, CONTINUUM, f)
    out = ingest.read_csv_strings(spark, pl.export_csv(spark, layout, CONTINUUM, fields=f))
    assert {int(r.ord): (r.txt or None) for r in out.collect()} == {o: t or None for o, (t, _) in want.items()}
    assert {r.txt for r in spark.read.parquet(layout.report(CONTINUUM, "false_negatives")).collect()} <= {t for t, _ in want.values()}


def test_no_line_is_shuffled_and_odd_bytes_stay(spark, tmp_root, small_splits):
    path = os.path.join(tmp_root, "y.csv")
    rows = [["id", "text"]] + [[str(k), f"line {k}\nsays \"{k}\"" if k % 3 else "x"] for k in range(100)]
    last = b'100,"caf\xe9\nbar"'
    with open(path, "wb") as f:
        f.write(_csv(rows, "\n").encode() + last + b"\n")
    parsed = ingest.read_csv_records(spark, path)
    plan = parsed._jdf.queryExecution().executedPlan().toString()
    # from the files to the records, and from there on
    behind, before = plan.split("MapInArrow", 1)
    assert "Exchange" not in behind and "Exchange" not in before[: before.index("FileScan")]
    r = F.col(csv_records.RECORD)
    kept = parsed.select("id", "text", F.hex(r["record"]).alias("record")).orderBy(r["ordinal"]).collect()
    assert [[k.id, k.text] for k in kept[:-1]] == rows[1:]
    assert bytes.fromhex(kept[-1].record).decode() == last.decode(errors="replace")


def test_splits_that_change_between_two_reads_are_an_error():
    import pyarrow as pa

    def cut(n_lines, of=0):
        b = pa.RecordBatch.from_pydict({"of": pa.array([of] * 3, pa.int64()), "split": [0] * 3, "open": [False] * 3, "n_lines": [n_lines] * 3, "line": [b"a", b'"b', b'c"']})
        return [x for out in csv_records._cut(iter([b.slice(0, 2), b.slice(2)])) for x in out.to_pylist()]

    assert [(x["row"], x["last"], x["record"]) for x in cut(3)] == [(1, False, b"a"), (2, True, b'"b\nc"')]
    for bad in ((2,), (4,), (3, None)):
        with pytest.raises(ValueError, match="changed"):
            cut(*bad)
