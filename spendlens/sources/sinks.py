"""Sinks: landed yearly table, prepared texts, label appends, merged table, report CSVs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.fields import DEFAULT, Fields

# the writer trims values unless told not to; texts must round-trip byte for byte
CSV_WRITE_OPTIONS = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "encoding": "UTF-8",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def write_by_year(df: DataFrame, path: str, fields: Fields = DEFAULT, fmt: str = "parquet", mode: str = "overwrite", replace: bool = False) -> None:
    """Write partitioned by year (per-year files and the collated table in one write).
    Overwriting replaces the years in ``df`` and keeps all others; with ``replace`` the
    whole table is replaced, so that years without rows in ``df`` go (derived tables).

    The ``rebalance`` hint lets AQE size the write tasks by year: small
    partitions are coalesced and a year holding a large share of all rows is
    split over several tasks, so neither one task per year nor one file per
    (task, year) pair.
    """
    df.hint("rebalance", fields.year).write.mode(mode).option("partitionOverwriteMode", "static" if replace else "dynamic").partitionBy(fields.year).format(fmt).save(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.options(**CSV_WRITE_OPTIONS)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def append_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append with the table's fixed schema; the rows are published when the job commits."""
    df.write.mode("append").format(fmt).save(path)


# Label rows by outcome: labels that count, and the quarantine of texts to be offered again.
OUTCOME = "outcome"
LABELLED, QUARANTINE = "ok", "quarantine"


def append_labels(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append a batch of label rows in one commit, partitioned by outcome: only rows with
    status ``ok`` are labels, all others are quarantined."""
    outcome = F.when(F.col("status") == "ok", F.lit(LABELLED)).otherwise(F.lit(QUARANTINE))
    df.withColumn(OUTCOME, outcome).write.mode("append").partitionBy(OUTCOME).format(fmt).save(path)


def labelled_rows(labels: DataFrame) -> DataFrame:
    """The rows of a label table that count as done (older tables: by status)."""
    if OUTCOME in labels.columns:
        return labels.where(F.col(OUTCOME) == LABELLED).drop(OUTCOME)
    return labels.where(F.col("status") == "ok") if "status" in labels.columns else labels


def write_report_csv(df: DataFrame, path: str) -> None:
    """A report has one row per year: a single CSV file, header first, rows in year order."""
    df.coalesce(1).write.mode("overwrite").options(**CSV_WRITE_OPTIONS).csv(path)
