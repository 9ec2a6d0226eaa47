import json
import os

import pytest
from pyspark.sql import functions as F

from spendlens.fields import Fields
from spendlens.operators import label as lb
from spendlens.plans import stages as pl
from spendlens.streaming.incremental import start_incremental_labelling
from spendlens.taxonomy import CONTINUUM, SUBSECTORS

FLD = Fields()

KEYWORDS = {
    "continuum": {"Homelessness": ["homeless"], "Incremental housing": ["slum"], "Social housing": ["social housing"], "Housing in general": ["housing"], "Urban": ["city"], "Rural": ["village"]},
    "subsectors": {"Resilience and Reconstruction": ["reconstruction"], "Incremental and Improved Housing": ["slum"], "Housing Supply": ["housing"], "Urban": ["city"]},
}


def _activities(spark):
    rows = [
        ("2023", "Slum upgrade", "slum upgrading", "Slum upgrading in the city", "16030", "10", "1.5"),
        ("2023", "Shelter", None, "Homeless shelter in a village", "16040", "21", "2.0"),
        ("2024", "Schools", None, "Education for all", "11110", "10", "4.0"),
        ("2024", "Housing", "Social housing", None, "16040", "30", "3.0"),
        ("2024", "Housing", "Social housing", None, "16040", "60", "5.0"),  # same text: labelled once
        ("2024", "Roads", None, "Rural roads", "16030", "10", "0"),  # dropped: amount not positive
        ("2024", "Post-quake reconstruction", None, "housing reconstruction", "43030", "40", "7.0"),
        ("2024", None, None, None, "16030", "10", "1.0"),  # blank text, sector code: selected, unlabelled
    ]
    return spark.createDataFrame(rows, "Year string, ProjectTitle string, ShortDescription string, LongDescription string, PurposeCode string, Category string, USD_Disbursement_Defl string")


def test_staged_run_end_to_end_both_taxonomies(spark, tmp_root):
    out = pl.run_all(
        spark, _activities(spark), tmp_root, [CONTINUUM, SUBSECTORS],
        lambda t: (lambda kw=KEYWORDS[t.name]: lb.KeywordClassifier(kw)),
        num_partitions=2, system_prompt="test prompt",
    )
    funnel = dict(out["funnel"])
    n_tokens = funnel.pop("input_tokens")
    assert funnel.pop("output_tokens") == n_tokens and funnel.pop("est_cost") == pytest.approx(n_tokens * 0.225 / 1e6)
    assert funnel == {"n_start": 7, "n_duplicates": 1, "n_blank": 1, "n_end": 5}
    # token proxy over the five prepared texts
    texts = [r.text for r in spark.read.parquet(pl.Layout(tmp_root).prepared).collect()]
    import regex
    assert n_tokens == sum(len(regex.findall(r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+", t)) for t in texts)
    assert out["continuum"]["labelled"] == 5 and out["subsectors"]["labelled"] == 5
    rep = {k: [r.asDict() for r in v.collect()] for k, v in out["continuum"]["reports"].items()}
    spend = {r["Year"]: r for r in rep["spend_by_class"]}
    share = {r["Year"]: r for r in rep["class_share"]}
    groups = {r["Year"]: r for r in rep["spend_by_group"]}
    # 2024 selected: social housing x2 (3+5), reconstruction text (housing: 7), blank sector row (1) = 16
    total_2024 = sum(v for k, v in groups[2024].items() if k != "Year" and v is not None)
    assert total_2024 == pytest.approx(16.0)
    assert spend[2024]["Social housing"] == pytest.approx(8.0)
    for c in CONTINUUM.classes:
        if spend[2024][c] is not None:
            assert share[2024][c] == pytest.approx(spend[2024][c] / total_2024)
    # residual overwritten: the reconstruction text is only "Housing in general"
    assert spend[2024]["Housing in general"] == pytest.approx(7.0)
    assert groups[2024]["unmapped"] == pytest.approx(7.0)
    summary = rep["selection_summary"][0]
    assert summary["n_all"] == 7 and summary["n_unlabelled_selected"] == 1
    merged = spark.read.parquet(pl.Layout(tmp_root).merged(CONTINUUM))
    assert merged.count() == 7 and "PurposeCode_label" in merged.columns
    assert os.path.exists(pl.Layout(tmp_root).report(CONTINUUM, "class_share"))
    # resume: nothing new to label
    assert pl.label(spark, pl.Layout(tmp_root), CONTINUUM, lambda: lb.KeywordClassifier({}), system_prompt="p") == 0


def test_incremental_stream_resumes(spark, tmp_root):
    src, out, ckpt = (os.path.join(tmp_root, n) for n in ("landing", "labels", "ckpt"))
    acts = _activities(spark).withColumn("ord", F.monotonically_increasing_id())
    schema = acts.schema
    kw = KEYWORDS["continuum"]

    def label(texts):
        return lb.keyword_labels(texts, CONTINUUM, kw, FLD)

    acts.limit(3).write.mode("append").parquet(src)
    start_incremental_labelling(spark, src, schema, out, ckpt, label, FLD, order=["ord"]).awaitTermination()
    n1 = spark.read.parquet(out).count()
    acts.write.mode("append").parquet(src)  # all rows again plus the rest
    start_incremental_labelling(spark, src, schema, out, ckpt, label, FLD, order=["ord"]).awaitTermination()
    labels = spark.read.parquet(out)
    assert n1 == 3
    assert labels.count() == labels.select("text_key").distinct().count() == 6
    start_incremental_labelling(spark, src, schema, out, ckpt, label, FLD, order=["ord"]).awaitTermination()
    assert spark.read.parquet(out).count() == 6


def test_cli_stages_and_report_csv_header(spark, tmp_root):
    import glob

    from spendlens import cli

    raw = os.path.join(tmp_root, "raw")
    acts = _activities(spark)
    for y in ("2023", "2024"):
        acts.where(F.col("Year") == y).coalesce(1).write.options(header=True, quote='"', escape='"').csv(os.path.join(raw, f"crs_{y}.csv"))
    root = os.path.join(tmp_root, "out")
    cli.main(["land", "--root", root, "--csv", os.path.join(raw, "crs_{year}.csv"), "--years", "2023", "2024"])
    assert cli.main(["prepare", "--root", root])["funnel"]["n_end"] == 5
    rules = os.path.join(tmp_root, "rules.json")
    with open(rules, "w") as f:
        json.dump(KEYWORDS["continuum"], f)
    assert cli.main(["label", "--root", root, "--keywords", rules])["labelled"] == 5
    cli.main(["merge", "--root", root])
    reps = cli.main(["report", "--root", root])["reports"]
    assert reps["selection_summary"][0]["n_all"] == 7
    header = open(glob.glob(os.path.join(root, "reports_continuum", "spend_by_class", "*.csv"))[0]).readline().strip()
    assert header == "Year," + ",".join(CONTINUUM.classes)
    header = open(glob.glob(os.path.join(root, "reports_continuum", "spend_by_group", "*.csv"))[0]).readline().strip()
    assert header == "Year,ODA,OOF,Private,unmapped"
    path = cli.main(["export", "--root", root, "--table", "selected"])["path"]
    from spendlens.sources import ingest

    back = ingest.read_csv_strings(spark, path)
    assert back.count() == spark.read.parquet(pl.Layout(root).selected(CONTINUUM)).count()


def test_label_stream_runs_the_labelling_job(spark, tmp_root):
    from spendlens.operators.prepare import with_activity_text

    layout = pl.Layout(os.path.join(tmp_root, "root"))
    landing = os.path.join(tmp_root, "landing")
    acts = with_activity_text(_activities(spark), FLD).drop("text", "text_key").withColumn("ord", F.monotonically_increasing_id())
    kw = KEYWORDS["continuum"]
    acts.limit(4).write.mode("append").parquet(landing)
    q = pl.label_stream(spark, layout, CONTINUUM, lambda: lb.KeywordClassifier(kw), landing, acts.schema, system_prompt="p", num_partitions=2)
    q.awaitTermination()
    acts.write.mode("append").parquet(landing)
    pl.label_stream(spark, layout, CONTINUUM, lambda: lb.KeywordClassifier(kw), landing, acts.schema, system_prompt="p", num_partitions=2).awaitTermination()
    labels = spark.read.parquet(layout.labels(CONTINUUM))
    # six distinct non-blank texts land (no amount filter on this path), each labelled once
    assert labels.count() == labels.select("text_key").distinct().count() == 6
    assert set(labels.select("status").distinct().toPandas()["status"]) == {"ok"}


def test_replayed_batch_adds_nothing(spark, tmp_root):
    from spendlens.streaming.incremental import label_batch_fn

    out = os.path.join(tmp_root, "labels")
    acts = _activities(spark).withColumn("ord", F.monotonically_increasing_id())
    run = label_batch_fn(out, lambda texts: lb.keyword_labels(texts, CONTINUUM, KEYWORDS["continuum"], FLD), FLD, order=["ord"])
    run(acts, 0)
    first = spark.read.parquet(out).count()
    run(acts, 0)  # the same batch again, as after a crash before the stream committed it
    assert spark.read.parquet(out).count() == first == 6
