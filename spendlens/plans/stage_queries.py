"""Queries over written stages: landings of several forms, refreshed reports, file order,
rejected rows, report files read back. Each with its DuckDB SQL beside it (``ORACLE``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.fields import DEFAULT, Fields
from spendlens.operators import label as lb
from spendlens.operators import report as rp
from spendlens.plans import fixtures as fx
from spendlens.plans import stages as pl
from spendlens.plans.fixtures import FIX, FIXTURE_TAXONOMY, LABEL_COLUMNS, table
from spendlens.session import work_path
from spendlens.sources import ingest, sinks
from spendlens.sources.dimensions import DEFAULT_SECTOR_NAMES
from spendlens.taxonomy import CONTINUUM

ORDER_FIELDS = Fields(year="Year", amount="o_totalprice", ordinal="ord")
# The year that a second landing changes.
CHANGED_YEAR = 1995
# Every so manieth document's row has a surplus cell.
SURPLUS_EVERY = 25
SURPLUS_CELL = ',"surplus, ""cell"""'


def _r2(c):
    return F.round(c, 2)


def q_land_evolving(spark: SparkSession, sf: str) -> DataFrame:
    """Orders landed in three calls whose columns differ: the first years lack two columns
    and hold the customer as int, later ones as bigint, the last as text. The landed table
    has all columns of all years, and the customer as text."""
    o = table(spark, sf, "orders").withColumn("Year", F.year("o_orderdate").cast("int"))
    layout = pl.Layout(work_path(spark, "evolving"))
    cust, y = F.col("o_custkey"), F.col("Year")
    base = ["o_orderkey", "Year", "o_totalprice"]
    drops = [
        o.where(y < 1994).select(*base, cust.cast("int").alias("cust")),
        o.where(y.between(1994, 1995)).select(*base, cust.cast("bigint").alias("cust"), "o_orderpriority"),
        o.where(y > 1995).select(*base, F.concat(F.lit("C"), cust.cast("string")).alias("cust"), "o_orderstatus", "o_orderpriority"),
    ]
    for drop in drops:
        pl.land(drop, layout, ORDER_FIELDS)
    landed = ingest.read_years(spark, layout.landed, None, fields=ORDER_FIELDS)
    return landed.select(*base, "cust", "o_orderpriority", "o_orderstatus")


def _labelled_layout(spark: SparkSession, sf: str, name: str) -> pl.Layout:
    """Fixture activities landed and prepared, fixture labels as label table."""
    layout = pl.Layout(work_path(spark, name))
    pl.land(fx.activities(spark, sf), layout, FIX)
    pl.prepare(spark, layout, FIX, estimate_cost=False)
    labels = fx.lab(spark, sf).select("text_key", F.lit("").alias("summary"), F.lit("").alias("reasoning"), *LABEL_COLUMNS, F.lit("11110").alias("purpose_code"), F.lit("ok").alias("status"))
    sinks.append_labels(labels, layout.labels(FIXTURE_TAXONOMY))
    return layout


def q_report_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """Two reports, between which one year is landed again with other texts and purpose
    codes: nothing of it is selected any more, and it is in no table of the second report."""
    layout = _labelled_layout(spark, sf, "refresh")
    pl.merge(spark, layout, FIXTURE_TAXONOMY, FIX)
    pl.report(spark, layout, FIXTURE_TAXONOMY, FIX)
    acts = fx.activities(spark, sf).where(F.col("yr") == CHANGED_YEAR)
    void = F.concat(F.lit("void "), F.col("activity_id").cast("string"))
    pl.land(acts.withColumn("txt", void).drop("text_key").withColumn("purpose_code", F.lit("11110")), layout, FIX)
    pl.merge(spark, layout, FIXTURE_TAXONOMY, FIX)
    pl.report(spark, layout, FIXTURE_TAXONOMY, FIX)
    sel = ingest.read_years(spark, layout.selected(FIXTURE_TAXONOMY), None, fields=FIX)
    r = rp.spend_by_class(sel, FIXTURE_TAXONOMY, FIX)
    return r.select(F.col("yr").cast("int").alias("yr"), *[_r2(c).alias(c) for c in FIXTURE_TAXONOMY.classes])


def q_merge_years(spark: SparkSession, sf: str) -> DataFrame:
    """All years merged, one landed again with doubled amounts and merged alone: its rows
    are new, those of the other years stay."""
    layout = _labelled_layout(spark, sf, "merge-years")
    pl.merge(spark, layout, FIXTURE_TAXONOMY, FIX)
    acts = fx.activities(spark, sf).where(F.col("yr") == CHANGED_YEAR)
    pl.land(acts.withColumn("amount", F.col("amount") * 2), layout, FIX)
    pl.merge(spark, layout, FIXTURE_TAXONOMY, FIX, years=[CHANGED_YEAR])
    merged = ingest.read_years(spark, layout.merged(FIXTURE_TAXONOMY), None, fields=FIX)
    return merged.select("activity_id", F.col("yr").cast("int").alias("yr"), _r2("amount").alias("amount"), *LABEL_COLUMNS)


def _documents_by_year(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as activities of three years, with the id as purpose code."""
    d = table(spark, sf, "documents")
    return d.select(
        "doc_id",
        (F.lit(2000) + F.col("doc_id") % 3).cast("int").alias(DEFAULT.year),
        F.col("n_chars").alias(DEFAULT.amount),
        F.col("doc_id").alias(DEFAULT.purpose_code),
        F.col("text").alias(DEFAULT.long_description),
    )


def q_land_file_order(spark: SparkSession, sf: str) -> DataFrame:
    """Yearly CSV files of unequal size: of each year a tenth of the documents in files that
    come first by name, the rest in larger ones behind, both by falling id. The first
    activity of each text is the first one in file order."""
    root = work_path(spark, "file-order")
    d = _documents_by_year(spark, sf)
    for year in (2000, 2001, 2002):
        for part, small in (("a", True), ("b", False)):
            rows = d.where((F.col(DEFAULT.year) == year) & ((F.col("doc_id") % 10 == 0) == F.lit(small)))
            sinks.write_table(rows.orderBy(F.desc("doc_id")), f"{root}/raw/crs_{year}/{part}", fmt="csv")
    layout = pl.Layout(f"{root}/out")
    pl.land_yearly_csv(spark, f"{root}/raw/crs_{{year}}", range(2000, 2003), layout)
    pl.prepare(spark, layout, estimate_cost=False)
    first = spark.read.parquet(layout.prepared)
    return first.select("text_key", F.col(DEFAULT.purpose_code).cast("bigint").alias("doc_id"), F.col(DEFAULT.year).cast("int").alias("yr"), "n_activities")


def _quoted(c) -> F.Column:
    return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))


def q_csv_rejected(spark: SparkSession, sf: str) -> DataFrame:
    """Yearly CSV files in which some rows have a surplus cell: sound rows are landed, the
    others kept aside as they stand in the file. One year is landed again, sound."""
    root = work_path(spark, "rejected")
    d = _documents_by_year(spark, sf)
    names = [DEFAULT.year, DEFAULT.amount, DEFAULT.purpose_code, DEFAULT.long_description]
    cells = F.concat_ws(",", *[F.col(c).cast("string") for c in names[:3]], _quoted(F.col(names[3])))
    # a file begins with the row that its task writes first
    first = F.monotonically_increasing_id() % (1 << 33) == 0

    def write(year: int, surplus, path: str) -> None:
        line = F.concat(cells, F.when(surplus, F.lit(SURPLUS_CELL)).otherwise(F.lit("")))
        rows = d.where(F.col(DEFAULT.year) == year).repartition(3, "doc_id")
        rows.select(F.concat(F.when(first, F.lit(",".join(names) + "\n")).otherwise(F.lit("")), line).alias("value")).write.text(path)

    layout = pl.Layout(f"{root}/out")
    bad = F.col("doc_id") % SURPLUS_EVERY == 0
    for year in (2000, 2001, 2002):
        write(year, bad, f"{root}/one/crs_{year}")
    pl.land_yearly_csv(spark, f"{root}/one/crs_{{year}}", range(2000, 2003), layout)
    write(2001, F.lit(False), f"{root}/two/crs_2001")
    pl.land_yearly_csv(spark, f"{root}/two/crs_{{year}}", [2001], layout)
    landed = ingest.read_years(spark, layout.landed, None)
    rejected = spark.read.parquet(layout.rejected)
    text = F.col(DEFAULT.long_description)
    sound = landed.select(F.col(DEFAULT.year).cast("int").alias("yr"), F.lit("landed").alias("outcome"), F.col(DEFAULT.purpose_code).cast("bigint").alias("doc_id"), text.alias("content"), F.lit(None).cast("int").alias("n_cells"))
    aside = rejected.select(F.col(DEFAULT.year).cast("int").alias("yr"), F.lit("rejected").alias("outcome"), F.split("record", ",")[2].cast("bigint").alias("doc_id"), F.col("record").alias("content"), F.col("n_cells").cast("int").alias("n_cells"))
    return sound.unionByName(aside)


def q_typed_scan(spark: SparkSession, sf: str) -> DataFrame:
    """A CSV file of strings with sentinels for missing values, years as '1994.0' and flags
    of several spellings: nulls, pruned columns (one the file lacks) and types."""
    d = table(spark, sf, "documents")
    k = F.col("doc_id")
    raw = d.select(
        k.cast("string").alias("doc_id"),
        F.concat((F.lit(1990) + k % 10).cast("string"), F.when(k % 2 == 0, ".0").otherwise(" ")).alias("year"),
        F.when(k % 7 == 0, "NA").when(k % 7 == 1, "nan").when(k % 7 == 2, "").otherwise(F.col("source")).alias("source"),
        F.when(k % 4 == 0, "True").when(k % 4 == 1, "0").when(k % 4 == 2, "N/A").otherwise("maybe").alias("flag"),
        "text",
    )
    path = work_path(spark, "typed")
    sinks.write_table(raw, path, fmt="csv")
    back = ingest.normalize_nulls(ingest.read_csv_strings(spark, path), ["source", "flag"])
    pruned = ingest.scan_pruned(back, ["doc_id", "year", "source", "flag", "absent"])
    return ingest.scan_typed(pruned, {"doc_id": "long", "year": "int", "flag": "boolean"})


def q_request_rows_listed(spark: SparkSession, sf: str) -> DataFrame:
    """Requests with sector names from a code list read from a CSV file that names one code
    twice and another with blanks around it: the least name of a code counts."""
    path = work_path(spark, "codes")
    d = table(spark, sf, "documents")
    code = F.when(F.col("lang") == "fr", " 16030 ").when(F.col("lang") == "es", "16040").otherwise("43030")
    codes = d.select(code.alias("code"), F.concat(F.lit("Sector, "), F.col("lang")).alias("name")).distinct()
    sinks.write_table(codes, path, fmt="csv")
    texts = pl.prepare_texts(fx.activities(spark, sf), FIX, order=["activity_id"])
    return lb.request_frame(texts, FIX, path).select("activity_id", "purpose_code", "sector_name", F.sha2("user_message", 256).alias("message_sha256"))


def q_budget_payload(spark: SparkSession, sf: str) -> DataFrame:
    """Estimated tokens of the requests as they are sent: JSON of both messages."""
    texts = pl.prepare_texts(fx.activities(spark, sf), FIX, order=["activity_id"])
    b = lb.budget(lb.request_frame(texts, FIX), CONTINUUM.system_prompt(), as_json=True)
    return b.select("n_requests", "input_tokens", "output_tokens", F.round("est_cost", 6).alias("est_cost"))


def q_spend_melted(spark: SparkSession, sf: str) -> DataFrame:
    """Shares by the molten route: flags unpivoted, summed, joined with the year totals."""
    r = rp.spend_melted(fx.selected(spark, sf), list(FIXTURE_TAXONOMY.classes), FIX)
    return r.select("yr", "variable", _r2("amount").alias("amount"), _r2("total").alias("total"), F.round("share", 9).alias("share"))


def q_report_file(spark: SparkSession, sf: str) -> DataFrame:
    """The class report of activities without any of class c2, written as a report file with
    the observed classes only, and read back."""
    sel = fx.selected(spark, sf).withColumn("c2", F.lit(False))
    path = work_path(spark, "report-file")
    sinks.write_report_csv(rp.drop_unobserved(rp.spend_by_class(sel, FIXTURE_TAXONOMY, FIX), FIX), path)
    back = ingest.read_csv_strings(spark, path)
    typed = ingest.scan_typed(back, {c: "int" if c == "yr" else "double" for c in back.columns})
    return typed.select("yr", *[_r2(c).alias(c) for c in typed.columns if c != "yr"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "land_evolving": q_land_evolving,
    "report_refresh": q_report_refresh,
    "merge_years": q_merge_years,
    "land_file_order": q_land_file_order,
    "csv_rejected": q_csv_rejected,
    "typed_scan": q_typed_scan,
    "request_rows_listed": q_request_rows_listed,
    "budget_payload": q_budget_payload,
    "spend_melted": q_spend_melted,
    "report_file": q_report_file,
}


def oracle(base: str, activities: str, lab: str, token: str, cost: Callable[[str], str]) -> dict[str, str]:
    """The SQL of the queries; ``base`` (relations up to the selected activities),
    ``activities`` and ``lab`` come from ``plans.oracle``."""
    prompt = CONTINUUM.system_prompt().replace("'", "''")
    any_class = "count(CASE WHEN c1 THEN 1 END) + count(CASE WHEN c2 THEN 1 END) + count(CASE WHEN g THEN 1 END) > 0"
    record = """yr || ',' || amount || ',' || doc_id || ',"' || replace(text, '"', '""') || '"'"""
    years = """y AS (SELECT doc_id, CAST(2000 + doc_id % 3 AS INT) AS yr, n_chars AS amount, text FROM documents WHERE n_chars > 0)"""
    firsts = f"""firsts AS (
  SELECT activity_id, purpose_code, txt FROM (
    SELECT activity_id, purpose_code, txt, row_number() OVER (PARTITION BY txt ORDER BY activity_id) AS rn
    FROM activities) x
  WHERE rn = 1 AND length(trim(txt)) > 0)"""
    names = ", ".join(f"('{k}', '{v}')" for k, v in DEFAULT_SECTOR_NAMES.items())
    return {
        "land_evolving": """
SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS "Year", o_totalprice,
       CASE WHEN year(o_orderdate) > 1995 THEN 'C' ELSE '' END || CAST(o_custkey AS VARCHAR) AS cust,
       CASE WHEN year(o_orderdate) >= 1994 THEN o_orderpriority END AS o_orderpriority,
       CASE WHEN year(o_orderdate) > 1995 THEN o_orderstatus END AS o_orderstatus
FROM orders WHERE o_totalprice > 0""",
        "report_refresh": base + f"""
SELECT yr, round(sum(CASE WHEN c1 THEN amount END), 2) AS c1, round(sum(CASE WHEN c2 THEN amount END), 2) AS c2,
       round(sum(CASE WHEN g THEN amount END), 2) AS g
FROM sel WHERE yr <> {CHANGED_YEAR} AND amount > 0 GROUP BY yr HAVING {any_class}""",
        "merge_years": f"""
WITH {activities},
{lab}
SELECT a.activity_id, a.yr, round(CASE WHEN a.yr = {CHANGED_YEAR} THEN 2 * a.amount ELSE a.amount END, 2) AS amount,
       l.c1, l.c2, l.g, l.urban, l.rural
FROM activities a LEFT JOIN lab l ON a.txt = l.txt WHERE a.amount > 0""",
        "land_file_order": f"""
WITH {years},
r AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY yr, doc_id % 10 <> 0, doc_id DESC) AS rn,
             count(*) OVER (PARTITION BY text) AS n FROM y)
SELECT sha256(text) AS text_key, doc_id, yr, n AS n_activities FROM r WHERE rn = 1 AND length(trim(text)) > 0""",
        "csv_rejected": f"""
WITH {years}
SELECT yr, CASE WHEN bad THEN 'rejected' ELSE 'landed' END AS outcome, doc_id,
       CASE WHEN bad THEN {record} || '{SURPLUS_CELL}' ELSE text END AS content,
       CASE WHEN bad THEN 5 END AS n_cells
FROM (SELECT *, doc_id % {SURPLUS_EVERY} = 0 AND yr <> 2001 AS bad FROM y) x""",
        "typed_scan": """
SELECT doc_id, CAST(1990 + doc_id % 10 AS INT) AS year,
       CASE WHEN doc_id % 7 > 2 THEN source END AS source,
       CASE doc_id % 4 WHEN 0 THEN true WHEN 1 THEN false END AS flag,
       CAST(NULL AS VARCHAR) AS absent
FROM documents""",
        "request_rows_listed": f"""
WITH {activities},
{firsts},
codes AS (
  SELECT code, min(name) AS name FROM (
    SELECT CASE lang WHEN 'fr' THEN '16030' WHEN 'es' THEN '16040' ELSE '43030' END AS code, 'Sector, ' || lang AS name
    FROM documents) x
  GROUP BY code)
SELECT f.activity_id, f.purpose_code, coalesce(c.name, '') AS sector_name,
       sha256(f.txt || chr(10) || 'Sector: ' || coalesce(c.name, '')) AS message_sha256
FROM firsts f LEFT JOIN codes c ON c.code = f.purpose_code""",
        "budget_payload": f"""
WITH {activities},
{firsts},
sectors(code, name) AS (VALUES {names}),
req AS (
  SELECT CAST(to_json([{{'role': 'system', 'content': '{prompt}'}},
                       {{'role': 'user', 'content': f.txt || chr(10) || 'Sector: ' || coalesce(s.name, '')}}]) AS VARCHAR) AS body
  FROM firsts f LEFT JOIN sectors s ON s.code = f.purpose_code),
t AS (SELECT count(*) AS n_requests, CAST(coalesce(sum(len(regexp_extract_all(body, '{token}'))), 0) AS BIGINT) AS input_tokens FROM req)
SELECT n_requests, input_tokens, input_tokens AS output_tokens, round({cost('input_tokens')}, 6) AS est_cost FROM t""",
        "report_file": base + """
SELECT yr, round(sum(CASE WHEN c1 THEN amount END), 2) AS c1, round(sum(CASE WHEN g THEN amount END), 2) AS g
FROM sel GROUP BY yr HAVING count(CASE WHEN c1 THEN 1 END) + count(CASE WHEN g THEN 1 END) > 0""",
    }
