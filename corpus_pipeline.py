"""Corpus pipeline: what the classifier and the rules reject goes, one document of each
near-duplicate group stays, and the rest is packed into training sequences.

Each stage works on all rows that the one before kept, as written Parquet. All but the
last return the columns of ``documents`` as they came, extra ones included. Rows with
null texts are judged as empty texts. Repeated rows and ties are judged alike, very long
texts are read whole, and an empty table gives an empty one at every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.llm import classifier, minhash, packing, quality_rules
from spendlens.llm.common import staged, table

# Classifier score from which a document is kept, as in its own query.
MIN_SCORE = 0.3
SEQUENCE = 2048
# Text that a packing worker takes at a time; smaller than in its own query, since the
# earlier stages have grown the executors.
SLICE_BYTES = 1 << 19


def _rows(docs: DataFrame) -> DataFrame:
    """The id and text an operator reads, and the whole row beside them: nothing that an
    operator adds can clash with a column of the input."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))


def keep_classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones, accepts."""
    weights = classifier.fit(docs, table(spark, sf_dir, "labels"))
    return classifier.score(docs, weights, out="_quality_score").filter(F.col("_quality_score") >= MIN_SCORE).select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the n-gram ratio."""
    return quality_rules.judge(_rows(docs), table(spark, sf_dir, "labels"), carry=["_row"]).filter("kept").select("_row.*")


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group (similarity from 0.80 on): that of its least id.

    Rows without id, and rows that share one, take part each by itself: of copies of one
    text under one id, or under none, one row stays. They get numbers above all ids, so in a
    group of such rows and others the least id of the others stays; in a group of such rows
    alone, any of them. Empty and blank texts are linked with nothing and all stay; very
    long texts are compared whole. An empty table stays empty.
    """
    rows = docs.withColumn("_row", F.col("doc_id").cast("bigint"))
    odd = staged(docs.groupBy(F.col("doc_id").alias("_odd")).agg(F.count("*").alias("_n")).filter("_n > 1 or _odd is null").select("_odd"), "pipeline-odd-ids")
    if not odd.isEmpty():
        above = max(docs.agg(F.max("doc_id")).first()[0] or 0, 0) + 1
        same = F.col("doc_id").eqNullSafe(F.col("_odd"))
        again = docs.join(odd, same, "left_semi").withColumn("_row", F.lit(above) + F.monotonically_increasing_id())
        # numbered once and written, so that they are the same wherever they are read
        rows = rows.join(odd, same, "left_anti").unionByName(staged(again, "pipeline-odd-rows"))
    groups = minhash.near_groups(rows, id_col="_row", near=minhash.AT_80)
    gone = groups.filter("doc_id <> component_id").select(F.col("doc_id").alias("_row"))
    return rows.join(gone, "_row", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that stay, in sequences of at most SEQUENCE tokens."""
    return packing.op4_packing(docs, public_tokenizers.path("word_bpe_49k.json"), SEQUENCE, SLICE_BYTES)


STAGES = [
    ("quality classifier", keep_classified),
    ("quality rules", keep_by_rules),
    ("near duplicates", keep_one_of_near),
    ("best-fit packing", pack_sequences),
]

# SQL cannot express the first stage (a trained classifier); tests hold it against a plain run.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{k}-{name.replace(' ', '-')}")
    return docs
