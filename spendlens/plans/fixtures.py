"""Fixture relations over the generated test tables, built with the library's operators.

The test tables are a generic star schema; these relations give them the shape
of activity records (year, amount, finance category, purpose code, text) and
of a label table (three thematic classes ``c1 c2 g`` with ``g`` the residual,
two location flags), so every operator runs on whole tables at every scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.fields import Fields
from spendlens.functions.text import text_key
from spendlens.operators.attach import attach_labels, labels_unique
from spendlens.operators.label import KeywordClassifier
from spendlens.operators.marker import mark, select_marked
from spendlens.taxonomy import Taxonomy

FIX = Fields(
    year="yr",
    amount="amount",
    purpose_code="purpose_code",
    category="category",
    text="txt",
    key="text_key",
    ordinal="activity_id",
    sector_flag="sector",
    any_flag="any_flag",
    any_sans_sector="any_sans_sector",
)

FIXTURE_TAXONOMY = Taxonomy(
    name="fixture",
    suffix="_fx",
    classes=("c1", "c2", "g"),
    residual="g",
    locations=("urban", "rural"),
    sector_codes=("16030", "16040"),
)

LABEL_COLUMNS = ["c1", "c2", "g", "urban", "rural"]


class FlakyClassifier:
    """Test rule: the keyword classifier, but it names an unknown class on the first try
    of a text whose length is a multiple of 5, and while ``down`` it fails for lengths
    that are multiples of 7 (of the whole message)."""

    def __init__(self, keywords, down: bool):
        self.model, self.down, self.seen = KeywordClassifier(keywords), down, set()

    def classify(self, system_prompt: str, message: str) -> str:
        if self.down and len(message) % 7 == 0:
            raise RuntimeError("no answer")
        if len(message) % 5 == 0 and message not in self.seen:
            self.seen.add(message)
            return '{"summary":"","reasoning":"","classifications":["zz"]}'
        return self.model.classify(system_prompt, message)


# Declared schemas of the test tables the fixtures read: no schema-inference job
# per read, and a changed file fails loudly instead of silently changing types.
TABLE_SCHEMAS = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    schema = TABLE_SCHEMAS.get(name)
    return spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)


def document_count(spark: SparkSession, sf_dir: str):
    """Row count of ``documents`` as a scalar-subquery Column: evaluated once inside
    the query that uses it (reused across the plan), never a driver round trip."""
    return table(spark, sf_dir, "documents").select(F.count(F.lit(1))).scalar()


def activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as activities, each carrying the text of document ``orderkey mod #documents``.

    The text key is computed on the documents side, so consumers that only
    need the key never move texts through the join shuffle.
    """
    nd = document_count(spark, sf_dir)
    o = table(spark, sf_dir, "orders")
    d = table(spark, sf_dir, "documents")
    prio = F.substring("o_orderpriority", 1, 1)
    acts = o.select(
        F.col("o_orderkey").alias("activity_id"),
        F.year("o_orderdate").cast("int").alias("yr"),
        F.col("o_totalprice").alias("amount"),
        F.when(prio == "1", "10").when(prio == "2", "21").when(prio == "3", "30").when(prio == "4", "40")
        .otherwise("60").alias("category"),
        (F.col("o_orderkey") % nd).alias("doc_id"),
    )
    docs = d.select(
        F.col("doc_id"),
        F.when(F.col("lang") == "fr", "16030").when(F.col("lang") == "es", "16040")
        .when(F.col("lang") == "de", "43030").otherwise("11110").alias("purpose_code"),
        F.col("text").alias("txt"),
        text_key(F.col("text")).alias("text_key"),
    )
    # both sides grow with the data: sort-merge join, never a broadcast of either
    return acts.hint("merge").join(docs, on="doc_id", how="inner").drop("doc_id")


def raw_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label rows (one per labelled document, texts may repeat) with the fixture classes."""
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels")
    return d.join(lab, on="doc_id", how="inner").select(
        F.col("doc_id"),
        text_key(F.col("text")).alias("text_key"),
        (F.col("quality") == 1).alias("c1"),
        (F.col("toxic") == 1).alias("c2"),
        (F.col("doc_id") % 5 == 0).alias("g"),
        (F.col("doc_id") % 3 == 0).alias("urban"),
        (F.col("doc_id") % 4 == 0).alias("rural"),
    )


def lab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First label per text (by document id)."""
    return labels_unique(raw_labels(spark, sf_dir), FIX, order="doc_id")


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every activity with its labels (NULL when unlabelled) and the marker flags."""
    attached = attach_labels(activities(spark, sf_dir), lab(spark, sf_dir), FIX, label_columns=LABEL_COLUMNS, dedupe=False)
    return mark(attached, FIXTURE_TAXONOMY, FIX)


def selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marked activities with the residual class overwritten."""
    return select_marked(marked(spark, sf_dir), FIXTURE_TAXONOMY, FIX)
