"""A text carried by a third of all activities: the salted join equals the plain
join and spreads that text's rows over several join tasks."""

from pyspark.sql import functions as F

from spendlens.fields import Fields
from spendlens.operators.attach import attach_labels
from spendlens.operators.prepare import hot_keys, prepare_texts

FX = Fields()


def _data(spark, n=30_000):
    acts = spark.range(n).select(
        F.col("id").alias("ord"),
        F.when(F.col("id") % 3 == 0, F.lit("boilerplate text")).otherwise(F.concat(F.lit("text "), (F.col("id") % 1000).cast("string"))).alias("LongDescription"),
        F.lit(1.0).alias("USD_Disbursement_Defl"),
    )
    prepared = prepare_texts(acts, FX, order=["ord"])
    labels = prepared.select("text_key", (F.col("ord") % 2 == 0).alias("flag"))
    return acts, prepared, labels


def test_hot_keys_are_all_keys_above_the_rows_of_a_task(spark):
    acts, prepared, _ = _data(spark)
    hot = hot_keys(prepared, FX, rows_per_task=3000).collect()
    assert [r.buckets for r in hot] == [4]  # only the boilerplate text: 10,000 rows
    assert hot_keys(prepared, FX, rows_per_task=5).count() == prepared.where("n_activities > 5").count() > 600


def test_salted_join_equals_plain_and_spreads(spark):
    from spendlens.operators.prepare import with_activity_text

    acts, prepared, labels = _data(spark)
    keyed = with_activity_text(acts, FX)
    hot = hot_keys(prepared, FX, rows_per_task=1250)
    plain = keyed.join(labels, "text_key", "left").select("ord", "flag")
    salted = attach_labels(keyed, labels, FX, label_columns=["flag"], dedupe=False, hot_keys=hot).select("ord", "flag")
    assert salted.count() == keyed.count()
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, salted.collect()))
    # the hot text's rows land in several shuffle partitions of the join
    spread = (
        keyed.join(hot, "text_key")
        .withColumn("salt", F.pmod(F.xxhash64("ord"), F.col("buckets")))
        .repartition(16, "text_key", "salt")
        .select(F.spark_partition_id().alias("p"))
        .distinct()
        .count()
    )
    assert spread > 4


def test_blank_texts_take_no_part_in_the_join(spark):
    from spendlens.functions.text import text_key
    from spendlens.operators.attach import BLANK_KEY

    assert spark.range(1).select(text_key(F.lit("")).alias("k")).first().k == BLANK_KEY
    acts = spark.range(3000).select(F.col("id").alias("ord"), F.when(F.col("id") % 3 == 0, F.lit("")).otherwise(F.lit("x")).alias("text"))
    labels = spark.createDataFrame([("x",)], "text string").select(text_key("text").alias("text_key"), F.lit(True).alias("flag"))
    out = attach_labels(acts, labels, FX, label_columns=["flag"], dedupe=False)
    counts = {r.flag: r["count"] for r in out.groupBy("flag").count().collect()}
    assert counts == {None: 1000, True: 2000}
