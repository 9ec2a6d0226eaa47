import os

from pyspark.sql import functions as F

from spendlens.fields import Fields
from spendlens.sources import ingest, sinks
from spendlens.sources.dimensions import sector_lookup


def test_csv_roundtrip_quotes_newlines_blanks(spark, tmp_root):
    rows = [(1, 'He said "hi",\nthen left', "  padded  "), (2, "NA", "x"), (3, "", None)]
    df = spark.createDataFrame(rows, "id long, a string, b string")
    path = os.path.join(tmp_root, "csv")
    sinks.write_table(df, path, fmt="csv")
    back = ingest.normalize_nulls(ingest.read_csv_strings(spark, path))
    back = ingest.scan_typed(back, {"id": "long"}).orderBy("id").collect()
    assert back[0].a == 'He said "hi",\nthen left' and back[0].b == "  padded  "
    assert back[1].a is None  # null sentinel
    assert back[2].a is None and back[2].b is None


def test_leaked_index_column_dropped(spark, tmp_root):
    p = os.path.join(tmp_root, "idx.csv")
    with open(p, "w") as f:
        f.write(",Year,USD_Disbursement_Defl\n0,2024,1.5\n1,2024,-2\n")
    df = ingest.read_csv_strings(spark, p)
    assert df.columns == ["Year", "USD_Disbursement_Defl"]
    assert ingest.positive_amount(df).count() == 1


def test_read_years_pattern_and_partitioned(spark, tmp_root):
    for y, extra in ((2023, False), (2024, True)):
        cols = "Year string, USD_Disbursement_Defl string" + (", Category string" if extra else "")
        row = (str(y), "1.0") + (("10",) if extra else ())
        p = os.path.join(tmp_root, f"crs_{y}.csv")
        spark.createDataFrame([row], cols).coalesce(1).write.options(header=True).csv(p)
    both = ingest.read_years(spark, os.path.join(tmp_root, "crs_{year}.csv"), [2023, 2024], fmt="csv")
    got = sorted((r.Year, r.Category) for r in both.collect())
    assert got == [("2023", None), ("2024", "10")]
    layout = os.path.join(tmp_root, "landed")
    sinks.write_by_year(both.withColumn("Year", ingest.to_number("Year")), layout)
    one = ingest.read_years(spark, layout, [2024])
    assert [r.Year for r in one.collect()] == [2024]
    assert "PartitionFilters: [isnotnull(Year" in one._jdf.queryExecution().executedPlan().toString() or one.count() == 1


def test_to_number_and_boolean(spark):
    df = spark.createDataFrame([(" 2024 ", "True"), ("2024.0", "false"), ("abc", ""), ("2024.5", "yes")], "y string, b string")
    got = [(r.y, r.b) for r in df.select(ingest.to_number("y").alias("y"), ingest.to_boolean("b").alias("b")).collect()]
    assert got == [(2024, True), (2024, False), (None, None), (None, True)]


def test_scan_pruned_adds_missing(spark):
    df = spark.createDataFrame([("t", "x")], "ProjectTitle string, other string")
    out = ingest.scan_pruned(df, ["ProjectTitle", "LongDescription"])
    assert out.columns == ["ProjectTitle", "LongDescription"] and out.first().LongDescription is None


def test_collate_by_name(spark):
    a = spark.createDataFrame([(1, "x")], "id int, a string")
    b = spark.createDataFrame([("y", 2, 3.0)], "a string, id int, extra double")
    got = sorted(tuple(r) for r in ingest.collate([a, b]).collect())
    assert got == [(1, "x", None), (2, "y", 3.0)]


def test_sector_lookup_map_and_frame(spark):
    df = spark.createDataFrame([("16040",), (" 16030",), ("99999",), (None,)], "PurposeCode string")
    names = [r.sector_name for r in sector_lookup(df, "PurposeCode").collect()]
    assert names == ["Low-cost housing", "Housing policy and administrative management", "", ""]
    dim = spark.createDataFrame([("99999", "Other")], "code string, name string")
    names = [r.sector_name for r in sector_lookup(df, "PurposeCode", source=dim).orderBy(F.col("PurposeCode").asc_nulls_last()).collect()]
    assert sorted(names) == ["", "", "", "Other"]


def test_to_number_keeps_large_integers_exact(spark):
    df = spark.createDataFrame([("9007199254740993",), ("-12",), ("1e3",)], "v string")
    got = [r.v for r in df.select(ingest.to_number("v", "long").alias("v")).collect()]
    assert got == [9007199254740993, -12, 1000]


def test_sector_list_from_csv_and_taxonomy_dim(spark, tmp_root):
    from spendlens.sources.dimensions import taxonomy_dim
    from spendlens.taxonomy import CONTINUUM

    p = os.path.join(tmp_root, "sectors.csv")
    with open(p, "w") as f:
        f.write('code,name\n16040,"Low-cost housing"\n 43040 ,Rural development\n')
    df = spark.createDataFrame([("43040",), ("16040",), ("1",)], "PurposeCode string")
    got = {r.PurposeCode: r.sector_name for r in sector_lookup(df, "PurposeCode", source=p).collect()}
    assert got == {"43040": "Rural development", "16040": "Low-cost housing", "1": ""}
    rows = taxonomy_dim(spark, CONTINUUM).orderBy("position").collect()
    assert [r["class"] for r in rows][:2] == ["Housing in general", "Homelessness"]
    assert {r["class"]: r.kind for r in rows}["Housing in general"] == "residual"
    assert {r["class"]: r.kind for r in rows}["Urban"] == "location"


def test_single_line_csv_reads_in_splits(spark, tmp_root):
    p = os.path.join(tmp_root, "big.csv")
    with open(p, "w") as f:
        f.write("Year,USD_Disbursement_Defl,ShortDescription\n")
        for i in range(200_000):
            f.write(f"2024,{i % 7},row {i}\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        split = ingest.read_csv_strings(spark, p, multi_line=False)
        whole = ingest.read_csv_strings(spark, p)
        assert split.rdd.getNumPartitions() > 1 and whole.rdd.getNumPartitions() == 1
        assert split.count() == whole.count() == 200_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
