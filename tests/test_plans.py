"""Plan-shape checks for the properties the scale notes rely on."""

import os

from pyspark.sql import functions as F

from spendlens.fields import Fields
from spendlens.operators import report as rp
from spendlens.operators.label import unprocessed
from spendlens.operators.attach import attach_labels
from spendlens.operators.prepare import keep_first, prepare_texts, with_text_key
from spendlens.plans import fixtures as fx
from spendlens.plans.catalog import QUERIES
from spendlens.sources import ingest, sinks

from paths import SF_SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_keep_first_limits_before_the_shuffle(spark):
    p = plan(keep_first(fx.table(spark, SF_SMALL, "documents").select("doc_id", "text"), "text", "doc_id"))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_prepare_aggregates_partially_before_the_shuffle(spark):
    p = plan(prepare_texts(fx.activities(spark, SF_SMALL), fx.FIX, order=["activity_id"]))
    assert "WindowGroupLimit" in p and "Partial" in p and "partial_count" in p
    assert "SortAggregate" not in p  # texts are not sorted to be counted


def test_no_size_switch_and_no_forced_broadcast_of_labels(spark):
    d = fx.table(spark, SF_SMALL, "documents").select("doc_id", "text")
    p = plan(unprocessed(d, d.where("doc_id < 5"), "doc_id"))
    assert "LeftAnti" in p and "Limit" not in p


def test_filters_reach_the_parquet_scan(spark, tmp_root):
    p = plan(ingest.positive_amount(fx.table(spark, SF_SMALL, "customer"), "c_acctbal").select("c_custkey"))
    assert "PushedFilters: [IsNotNull(c_acctbal), GreaterThan(c_acctbal,0.0)]" in p
    assert "ReadSchema: struct<c_custkey:bigint,c_acctbal:double>" in p
    path = os.path.join(tmp_root, "landed")
    df = spark.createDataFrame([(2023, 1.0), (2024, 2.0)], "Year int, USD_Disbursement_Defl double")
    sinks.write_by_year(df, path)
    p = plan(ingest.read_years(spark, path, [2024]))
    assert "PartitionFilters: [isnotnull(Year" in p and "(Year" in p


def test_reports_are_one_aggregation_without_unpivot_or_joins_on_top(spark):
    sel = fx.selected(spark, SF_SMALL)
    for df in (rp.class_share(sel, fx.FIXTURE_TAXONOMY, fx.FIX), rp.spend_by_group(sel, fx.FIXTURE_TAXONOMY, fx.FIX)):
        p = plan(df)
        assert "Expand" not in p  # no row multiplication
        assert p.count("HashAggregate(keys=[yr") == 2  # partial + final, once
        assert "rangepartitioning" not in p  # no global sort for a handful of rows


def test_text_key_is_hashed_once_per_side(spark):
    o = optimized(QUERIES["class_share"](spark, SF_SMALL))
    assert "isnotnull(coalesce(sha2" not in o and "isnotnull(sha2" not in o


def test_label_join_moves_keys_not_texts(spark):
    p = plan(QUERIES["class_share"](spark, SF_SMALL))
    exchanges = [l for l in p.splitlines() if "Exchange hashpartitioning(text_key" in l]
    assert exchanges  # the join shuffles on the key ...
    assert "txt" not in optimized(QUERIES["class_share"](spark, SF_SMALL))  # ... the text is read only to be hashed


def test_attach_reads_the_activities_once(spark):
    p = plan(QUERIES["attach_labels"](spark, SF_SMALL))
    assert p.count("/orders.parquet") == 1 and "Union" not in p
    hot = spark.createDataFrame([("k", 3)], "text_key string, buckets int")
    salted = attach_labels(fx.activities(spark, SF_SMALL), fx.lab(spark, SF_SMALL), fx.FIX, fx.LABEL_COLUMNS, dedupe=False, hot_keys=hot)
    assert plan(salted).count("/orders.parquet") == 1


def test_stored_keys_are_counted_without_the_texts(spark, tmp_root):
    df = spark.createDataFrame([(1, 2024, "a text")], "ord long, Year int, LongDescription string")
    sinks.write_by_year(with_text_key(df), tmp_root)
    o = optimized(prepare_texts(ingest.read_years(spark, tmp_root, None)))
    assert "sha2" not in o  # no text is hashed again
    counted = [l for l in plan(prepare_texts(ingest.read_years(spark, tmp_root, None))).splitlines() if "ReadSchema: struct<text_key:string>" in l]
    assert counted
