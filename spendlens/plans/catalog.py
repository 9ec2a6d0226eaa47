"""Query catalogue: one Spark query per operator group, over the whole test tables.

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame whose columns are
aliased exactly as the matching SQL in ``plans.oracle``. Doubles are rounded
(sums to 2 places, shares to 9) on both sides, since sums of doubles depend on
addition order.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.fields import Fields
from spendlens.functions.labels import multi_hot, parse_response
from spendlens.functions.text import activity_text, cost, text_key, token_count, ustrip
from spendlens.operators import label as lb
from spendlens.operators import report as rp
from spendlens.operators.attach import attach_labels
from spendlens.operators.marker import false_negatives, residual
from spendlens.operators.prepare import keep_first, prepare_texts, text_funnel
from spendlens.plans import fixtures as fx
from spendlens.plans import stage_queries
from spendlens.plans.fixtures import FIX, FIXTURE_TAXONOMY, LABEL_COLUMNS, table
from spendlens.session import work_path
from spendlens.sources import ingest, sinks
from spendlens.taxonomy import CONTINUUM, SUBSECTORS

# Test rules (chosen here, not taken from anywhere): keyword rule of the fixture
# classifier, fragments with moderate hit rates in the generated test prose.
FIXTURE_KEYWORDS = {
    "c1": ["tion"],
    "c2": ["ment", "eau"],
    "g": ["ing"],
    "urban": ["the "],
    "rural": ["ein"],
}
# Test rules: keyword stand-ins for the model on the two shipped taxonomies.
TAXONOMY_KEYWORDS = {
    "continuum": {
        "Homelessness": ["oir"],
        "Transitional housing": ["ado"],
        "Incremental housing": ["sch", "ung"],
        "Social housing": ["aux"],
        "Market housing": ["ara"],
        "Housing in general": ["lle"],
        "Urban": ["ich"],
        "Rural": ["que"],
    },
    "subsectors": {
        "Transitional and Temporary Housing": ["oir"],
        "Resilience and Reconstruction": ["ón"],
        "Incremental and Improved Housing": ["sch"],
        "Social Housing": ["aux", "ara"],
        "Market Enabling": ["ier"],
        "Housing Supply": ["lle"],
        "Urban": ["ich"],
        "Rural": ["que"],
    },
}
SAMPLE_CODES = ["16030", "16040"]
ABSENT_CODES = ["99999"]
SAMPLE_SIZE = 10
SALT_ROWS = 20
RESUME_BATCH = 4_000
COLLATE_SPLIT_YEAR = 1998
MAX_COST = 5.0


def _r2(c):
    return F.round(c, 2)


def _r9(c):
    return F.round(c, 9)


# --- sources ---------------------------------------------------------------

def q_positive_amount(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.positive_amount(table(spark, sf, "customer"), "c_acctbal")


def q_collate_years(spark: SparkSession, sf: str) -> DataFrame:
    """Land orders as two year-partitioned drops (the older one lacks a column), read
    both back by year and collate by name."""
    o = ingest.positive_amount(table(spark, sf, "orders"), "o_totalprice")
    o = o.withColumn("Year", F.year("o_orderdate").cast("int"))
    root = work_path(spark, "collate")
    old, new = f"{root}/old", f"{root}/new"
    sinks.write_by_year(o.where(F.col("Year") < COLLATE_SPLIT_YEAR).drop("o_orderpriority"), old)
    sinks.write_by_year(o.where(F.col("Year") >= COLLATE_SPLIT_YEAR), new)
    parts = [ingest.read_years(spark, p, None) for p in (old, new)]
    return ingest.collate(parts).withColumn("Year", F.col("Year").cast("int"))


def q_land_yearly(spark: SparkSession, sf: str) -> DataFrame:
    """Orders landed in separate calls, even years, odd years and one year again: each
    call replaces its own years and keeps the others."""
    from spendlens.plans import stages as pl

    f = Fields(year="Year", amount="o_totalprice", ordinal="ord")
    o = table(spark, sf, "orders").withColumn("Year", F.year("o_orderdate").cast("int"))
    layout = pl.Layout(work_path(spark, "yearly"))
    for part in (F.col("Year") % 2 == 0, F.col("Year") % 2 == 1, F.col("Year") == 1995):
        pl.land(o.where(part), layout, f)
    return ingest.read_years(spark, layout.landed, None, fields=f).select("o_orderkey", F.col("Year").cast("int").alias("Year"), "o_totalprice")


def q_csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Documents through the CSV exchange format: write, read all-string, null
    sentinels, typed columns."""
    d = table(spark, sf, "documents")
    path = work_path(spark, "csv")
    sinks.write_table(d, path, fmt="csv")
    back = ingest.read_csv_strings(spark, path)
    back = ingest.normalize_nulls(back, ["lang", "source"])
    return ingest.scan_typed(back, {"doc_id": "long", "n_chars": "long"}).select("doc_id", "text", "lang", "source", "n_chars")


# --- text functions and preparation ---------------------------------------

def _text_parts(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select(
        F.col("p_partkey").alias("id"),
        F.col("p_brand").alias("title"),
        F.when(F.col("p_size") % 5 == 0, F.lit(None)).otherwise(F.col("p_type")).alias("short_text"),
        F.when(F.col("p_size") % 7 == 0, F.lit(None)).otherwise(F.col("p_name")).alias("long_text"),
    )


def q_activity_text(spark: SparkSession, sf: str) -> DataFrame:
    tp = _text_parts(spark, sf)
    return tp.select("id", activity_text("title", "short_text", "long_text").alias("text"))


# blanks of several kinds around each text: no-break space, em space, ideographic
# space, newline, unit separator
_PAD_LEFT = "\u00a0\u2003 \t"
_PAD_RIGHT = "\u3000\n\u001f "


def q_unicode_strip(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    padded = F.concat(F.lit(_PAD_LEFT), F.col("text"), F.lit(_PAD_RIGHT))
    s = ustrip(padded)
    return d.select("doc_id", s.alias("text"), F.length(s).alias("n_len"))


def q_keep_first_text(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "lang", text_key(F.col("text")).alias("text_key"))
    return keep_first(d, "text_key", "doc_id")


def _docs_as_activities(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as activities with only a long description; every 50th is blank."""
    d = table(spark, sf, "documents")
    long = F.when(F.col("doc_id") % 50 == 0, F.lit("  ")).otherwise(F.col("text"))
    return d.select(
        F.col("doc_id").alias("activity_id"),
        activity_text(F.lit(None).cast("string"), F.lit(None).cast("string"), long).alias("txt"),
    ).withColumn("text_key", text_key(F.col("txt")))


def q_prepare_funnel(spark: SparkSession, sf: str) -> DataFrame:
    return text_funnel(_docs_as_activities(spark, sf), "text_key", "txt")


def _unique_doc_texts(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(
        F.col("doc_id").alias("activity_id"),
        F.col("text").alias("txt"),
        text_key(F.col("text")).alias("text_key"),
        F.lit(None).cast("string").alias("purpose_code"),
    )
    return prepare_texts(d, FIX, order=["activity_id"])


def q_token_cost(spark: SparkSession, sf: str) -> DataFrame:
    u = _unique_doc_texts(spark, sf)
    agg = u.agg(F.count(F.lit(1)).alias("n_texts"), F.sum(token_count("txt")).cast("long").alias("n_tokens"))
    return agg.select(
        "n_texts",
        "n_tokens",
        F.col("n_tokens").alias("input_tokens"),
        F.col("n_tokens").alias("output_tokens"),
        F.round(cost(F.col("n_tokens")), 6).alias("est_cost"),
    )


def q_bpe_token_count(spark: SparkSession, sf: str) -> DataFrame:
    """Upper bound of any byte-level token count of every unique text: its bytes, which
    is the count before the first merge."""
    u = _unique_doc_texts(spark, sf)
    return u.select(F.col("activity_id").alias("doc_id"), F.octet_length("txt").cast("bigint").alias("n_tokens"))


def _unique_activity_texts(spark: SparkSession, sf: str) -> DataFrame:
    return prepare_texts(fx.activities(spark, sf), FIX, order=["activity_id"])


def q_request_rows(spark: SparkSession, sf: str) -> DataFrame:
    req = lb.request_frame(_unique_activity_texts(spark, sf), FIX)
    return req.select("activity_id", "purpose_code", "sector_name", "user_message")


def q_budget_gate(spark: SparkSession, sf: str) -> DataFrame:
    req = lb.request_frame(_unique_activity_texts(spark, sf), FIX)
    b = lb.budget(req, CONTINUUM.system_prompt(), max_cost=MAX_COST)
    return b.select("n_requests", "input_tokens", "output_tokens", F.round("est_cost", 6).alias("est_cost"), "within_budget")


def q_code_sample(spark: SparkSession, sf: str) -> DataFrame:
    acts = fx.activities(spark, sf).select("activity_id", "purpose_code")
    hit = lb.sample_by_code(acts, "purpose_code", SAMPLE_CODES, SAMPLE_SIZE, "activity_id")
    fallback = lb.sample_by_code(acts, "purpose_code", ABSENT_CODES, SAMPLE_SIZE, "activity_id")
    return hit.select(F.lit("hit").alias("sample_case"), "activity_id", "purpose_code").unionByName(
        fallback.select(F.lit("fallback").alias("sample_case"), "activity_id", "purpose_code")
    )


# --- responses and labelling ----------------------------------------------

def _responses(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id")
    lab = table(spark, sf, "labels")
    q, t = F.col("quality") == 1, F.col("toxic") == 1

    def resp(classes: str):
        return F.lit('{"summary":"s","reasoning":"r","classifications":[' + classes + "]}")

    r = (
        F.when(F.col("doc_id") % 17 == 0, F.lit("not json"))
        .when(F.col("doc_id") % 10 == 0, resp('"zz"'))
        .when(q & t, resp('"c1","c2"'))
        .when(q, resp('"c1"'))
        .when(t, resp('"c2"'))
        .otherwise(resp(""))
    )
    return d.join(lab, on="doc_id").select("doc_id", r.alias("response"))


def q_parse_labels(spark: SparkSession, sf: str) -> DataFrame:
    vocab = list(FIXTURE_TAXONOMY.vocabulary)
    p = _responses(spark, sf).withColumn("p", parse_response("response", vocab))
    return p.select(
        "doc_id",
        F.col("p.status").alias("status"),
        F.col("p.summary").alias("summary"),
        F.when(F.col("p.status") == "ok", F.size("p.classifications")).alias("n_classes"),
    )


def q_multi_hot(spark: SparkSession, sf: str) -> DataFrame:
    vocab = list(FIXTURE_TAXONOMY.vocabulary)
    p = _responses(spark, sf).withColumn("p", parse_response("response", vocab))
    return p.select("doc_id", *multi_hot(F.col("p.classifications"), F.col("p.status"), vocab))


def q_keyword_label(spark: SparkSession, sf: str) -> DataFrame:
    u = _unique_doc_texts(spark, sf)
    out = lb.keyword_labels(u, FIXTURE_TAXONOMY, FIXTURE_KEYWORDS, FIX)
    return out.select(F.col("activity_id").alias("doc_id"), *LABEL_COLUMNS)


def q_label_job(spark: SparkSession, sf: str) -> DataFrame:
    """The distributed labelling job (mapInPandas, retry, parse, multi-hot) with the
    keyword classifier, written once and read back."""
    u = _unique_doc_texts(spark, sf)
    kw = FIXTURE_KEYWORDS
    labelled = lb.label_texts(u, FIXTURE_TAXONOMY, lambda: lb.KeywordClassifier(kw), FIX, num_partitions=8, system_prompt="")
    path = work_path(spark, "labels")
    sinks.write_table(labelled, path)
    return spark.read.parquet(path).select(F.col("activity_id").alias("doc_id"), *LABEL_COLUMNS, "status")


def q_label_resume(spark: SparkSession, sf: str) -> DataFrame:
    """Two labelling runs over all unique documents, in committed batches. On run 1 the
    model fails for some texts until their tries are exhausted (quarantined), and for
    others names an unknown class on the first try (tried again); run 2 labels the rest."""
    from spendlens.plans import stages as pl

    layout = pl.Layout(work_path(spark, "resume"))
    sinks.write_table(_unique_doc_texts(spark, sf), layout.prepared)
    for down in (True, False):
        pl.label(
            spark, layout, FIXTURE_TAXONOMY, partial(fx.FlakyClassifier, FIXTURE_KEYWORDS, down), FIX,
            system_prompt="", max_tries=2, base_backoff=0.0, jitter=0.0, num_partitions=4, texts_per_batch=RESUME_BATCH,
        )
    rows = spark.read.parquet(layout.labels(FIXTURE_TAXONOMY))
    tried = rows.where(F.col(sinks.OUTCOME) == sinks.QUARANTINE).groupBy("text_key").agg(F.count(F.lit(1)).alias("n"))
    done = sinks.labelled_rows(rows).join(tried, on="text_key", how="left")
    return done.select(F.col("activity_id").alias("doc_id"), *LABEL_COLUMNS, "tries", F.coalesce("n", F.lit(0)).alias("n_quarantined"))


def q_unprocessed(spark: SparkSession, sf: str) -> DataFrame:
    u = _unique_doc_texts(spark, sf)
    done = fx.raw_labels(spark, sf).select("text_key")
    return lb.unprocessed(u, done, "text_key").select(F.col("activity_id").alias("doc_id"), "text_key")


def q_incremental_label(spark: SparkSession, sf: str) -> DataFrame:
    from spendlens.streaming.incremental import run_incremental_fixture

    return run_incremental_fixture(spark, sf, FIXTURE_KEYWORDS)


# --- labels attached, marker, reports -------------------------------------

def q_labels_unique(spark: SparkSession, sf: str) -> DataFrame:
    return fx.lab(spark, sf).select("text_key", *LABEL_COLUMNS)


def q_attach_labels(spark: SparkSession, sf: str) -> DataFrame:
    a = attach_labels(fx.activities(spark, sf), fx.lab(spark, sf), FIX, label_columns=LABEL_COLUMNS, dedupe=False)
    return a.select("activity_id", *LABEL_COLUMNS)


def q_attach_labels_salted(spark: SparkSession, sf: str) -> DataFrame:
    """The label join with every text on more than SALT_ROWS activities salted (counts
    from the prepared texts); must equal the plain join."""
    from spendlens.operators.prepare import hot_keys

    acts = fx.activities(spark, sf)
    hot = hot_keys(prepare_texts(acts, FIX, order=["activity_id"]), FIX, rows_per_task=SALT_ROWS)
    a = attach_labels(acts, fx.lab(spark, sf), FIX, label_columns=LABEL_COLUMNS, dedupe=False, hot_keys=hot)
    return a.select("activity_id", *LABEL_COLUMNS)


def q_marker_flags(spark: SparkSession, sf: str) -> DataFrame:
    m = fx.marked(spark, sf)
    return m.select("activity_id", "sector", "any_sans_sector", "any_flag", residual(FIXTURE_TAXONOMY).alias("resid"))


def q_false_negatives(spark: SparkSession, sf: str) -> DataFrame:
    return false_negatives(fx.marked(spark, sf), FIX).select("activity_id", "yr", "amount", "purpose_code")


def q_selection_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = rp.selection_summary(fx.marked(spark, sf), FIX)
    return s.select(
        "n_all", "n_selected", _r9("selection_rate").alias("selection_rate"), _r2("selected_amount").alias("selected_amount"),
        "n_unlabelled_selected", "n_false_negative",
    )


def q_spend_by_class(spark: SparkSession, sf: str) -> DataFrame:
    r = rp.spend_by_class(fx.selected(spark, sf), FIXTURE_TAXONOMY, FIX)
    return r.select("yr", *[_r2(c).alias(c) for c in FIXTURE_TAXONOMY.classes])


def q_class_share(spark: SparkSession, sf: str) -> DataFrame:
    r = rp.class_share(fx.selected(spark, sf), FIXTURE_TAXONOMY, FIX)
    return r.select("yr", *[_r9(c).alias(c) for c in FIXTURE_TAXONOMY.classes])


def q_stack_total(spark: SparkSession, sf: str) -> DataFrame:
    r = rp.stack_total(fx.selected(spark, sf), FIXTURE_TAXONOMY, FIX)
    return r.select("yr", _r9("stack_total").alias("stack_total"))


def q_spend_long(spark: SparkSession, sf: str) -> DataFrame:
    r = rp.spend_long(fx.selected(spark, sf), list(FIXTURE_TAXONOMY.classes), FIX)
    return r.select("yr", "variable", _r2("amount").alias("amount"), _r2("total").alias("total"), _r9("share").alias("share"))


def q_spend_by_group(spark: SparkSession, sf: str) -> DataFrame:
    r = rp.spend_by_group(fx.selected(spark, sf), FIXTURE_TAXONOMY, FIX)
    return r.select("yr", *[_r2(c).alias(c) for c in ("ODA", "OOF", "Private", "unmapped")])


def q_location_share(spark: SparkSession, sf: str) -> DataFrame:
    r = rp.location_share(fx.selected(spark, sf), FIXTURE_TAXONOMY, FIX)
    return r.select("yr", *[_r9(c).alias(c) for c in FIXTURE_TAXONOMY.locations])


def q_spend_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """The long table (conditional sums) pivoted back to one column a class."""
    long = rp.spend_long(fx.selected(spark, sf), list(FIXTURE_TAXONOMY.classes), FIX)
    wide = rp.pivot_long(long, list(FIXTURE_TAXONOMY.classes), "amount", FIX)
    return wide.select("yr", *[_r2(c).alias(c) for c in FIXTURE_TAXONOMY.classes])


def _taxonomy_selected(spark: SparkSession, sf: str, taxonomy):
    """Activities labelled per unique text with a shipped taxonomy (keyword stand-in),
    attached back, marked and selected."""
    from spendlens.operators.marker import mark, select_marked

    acts = fx.activities(spark, sf)
    texts = prepare_texts(acts, FIX, order=["activity_id"])
    labels = lb.keyword_labels(texts, taxonomy, TAXONOMY_KEYWORDS[taxonomy.name], FIX)
    attached = attach_labels(acts, labels, FIX, label_columns=list(taxonomy.vocabulary), dedupe=False)
    return select_marked(mark(attached, taxonomy, FIX), taxonomy, FIX)


def q_continuum_class_spend(spark: SparkSession, sf: str) -> DataFrame:
    r = rp.spend_by_class(_taxonomy_selected(spark, sf, CONTINUUM), CONTINUUM, FIX)
    return r.select("yr", *[_r2(F.col(f"`{c}`")).alias(c) for c in CONTINUUM.classes])


def q_subsector_class_share(spark: SparkSession, sf: str) -> DataFrame:
    r = rp.class_share(_taxonomy_selected(spark, sf, SUBSECTORS), SUBSECTORS, FIX)
    return r.select("yr", *[_r9(F.col(f"`{c}`")).alias(c) for c in SUBSECTORS.classes])


def q_subsector_location_share(spark: SparkSession, sf: str) -> DataFrame:
    r = rp.location_share(_taxonomy_selected(spark, sf, SUBSECTORS), SUBSECTORS, FIX)
    return r.select("yr", *[_r9(F.col(f"`{c}`")).alias(c) for c in SUBSECTORS.locations])


def q_staged_continuum_share(spark: SparkSession, sf: str) -> DataFrame:
    """The staged run end to end on written tables: land (year-partitioned),
    prepare (observed funnel), label (distributed job, keyword classifier),
    merge (hot keys salted), report; the class shares are read from the written
    selected activities."""
    from spendlens.plans import stages as pl

    layout = pl.Layout(work_path(spark, "staged"))
    kw = TAXONOMY_KEYWORDS["continuum"]
    pl.land(fx.activities(spark, sf), layout, FIX)
    pl.prepare(spark, layout, FIX)
    pl.label(spark, layout, CONTINUUM, lambda: lb.KeywordClassifier(kw), FIX, num_partitions=8)
    pl.merge(spark, layout, CONTINUUM, FIX)
    pl.report(spark, layout, CONTINUUM, FIX)
    r = rp.class_share(spark.read.parquet(layout.selected(CONTINUUM)), CONTINUUM, FIX)
    return r.select(F.col("yr").cast("int").alias("yr"), *[_r9(F.col(f"`{c}`")).alias(c) for c in CONTINUUM.classes])


def q_sum_strict(spark: SparkSession, sf: str) -> DataFrame:
    """Strict (NULL-propagating) and NULL-skipping sums per year on orders with some NULL amounts."""
    o = table(spark, sf, "orders")
    yr = F.year("o_orderdate").cast("int")
    amt = F.when((F.col("o_orderkey") % 97 == 0) & (yr % 2 == 0), F.lit(None)).otherwise(F.col("o_totalprice"))
    df = o.select(yr.alias("yr"), amt.alias("amount"))
    return df.groupBy("yr").agg(
        _r2(rp.strict_sum(F.col("amount"))).alias("strict_sum"),
        _r2(rp.lenient_sum(F.col("amount"))).alias("lenient_sum"),
        (F.count(F.lit(1)) - F.count("amount")).alias("n_null"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "positive_amount": q_positive_amount,
    "collate_years": q_collate_years,
    "land_yearly": q_land_yearly,
    "csv_roundtrip": q_csv_roundtrip,
    "activity_text": q_activity_text,
    "unicode_strip": q_unicode_strip,
    "keep_first_text": q_keep_first_text,
    "prepare_funnel": q_prepare_funnel,
    "token_cost": q_token_cost,
    "bpe_token_count": q_bpe_token_count,
    "request_rows": q_request_rows,
    "budget_gate": q_budget_gate,
    "code_sample": q_code_sample,
    "parse_labels": q_parse_labels,
    "multi_hot": q_multi_hot,
    "keyword_label": q_keyword_label,
    "label_job": q_label_job,
    "label_resume": q_label_resume,
    "unprocessed": q_unprocessed,
    "incremental_label": q_incremental_label,
    "labels_unique": q_labels_unique,
    "attach_labels": q_attach_labels,
    "attach_labels_salted": q_attach_labels_salted,
    "marker_flags": q_marker_flags,
    "false_negatives": q_false_negatives,
    "selection_summary": q_selection_summary,
    "spend_by_class": q_spend_by_class,
    "class_share": q_class_share,
    "stack_total": q_stack_total,
    "spend_long": q_spend_long,
    "spend_by_group": q_spend_by_group,
    "location_share": q_location_share,
    "sum_strict": q_sum_strict,
    "spend_pivot": q_spend_pivot,
    "continuum_class_spend": q_continuum_class_spend,
    "staged_continuum_share": q_staged_continuum_share,
    "subsector_class_share": q_subsector_class_share,
    "subsector_location_share": q_subsector_location_share,
    **stage_queries.QUERIES,
}
