"""Staged run: land → prepare → label (resumable) → merge → report.

Every stage reads and writes tables under one output root, so each stage can
be re-run alone and a lost executor only costs the tasks of the running stage.
The taxonomy is a parameter; stage outputs carry its suffix.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from spendlens._compat import qcol
from spendlens.fields import DEFAULT, Fields
from spendlens.operators import label as lb
from spendlens.operators import report as rp
from spendlens.operators.attach import attach_labels
from spendlens.operators.marker import false_negatives, mark, select_marked
from spendlens.operators.prepare import TEXT_HASH, PrepareObservation, ensure_text_key, hot_keys, prepare_texts, text_hash, with_text_key, with_texts
from spendlens.session import configure
from spendlens.sources import csv_records, ingest, sinks
from spendlens.sources.evolve import drop_partitions
from spendlens.streaming.incremental import MAX_FILES_PER_TRIGGER, read_if_exists
from spendlens.taxonomy import Taxonomy


@dataclass(frozen=True)
class Layout:
    """Table locations under one root."""

    root: str

    @property
    def landed(self) -> str:
        return f"{self.root}/activities"

    @property
    def texts(self) -> str:
        return f"{self.root}/texts"

    @property
    def rejected(self) -> str:
        return f"{self.root}/rows_rejected"

    @property
    def prepared(self) -> str:
        return f"{self.root}/texts_prepared"

    def labels(self, t: Taxonomy) -> str:
        return f"{self.root}/texts_labeled{t.suffix}"

    def merged(self, t: Taxonomy) -> str:
        return f"{self.root}/activities_labeled{t.suffix}"

    def selected(self, t: Taxonomy) -> str:
        return f"{self.root}/activities_selected{t.suffix}"

    def report(self, t: Taxonomy, name: str) -> str:
        return f"{self.root}/reports{t.suffix}/{name}"


def land(activities: DataFrame, layout: Layout, fields: Fields = DEFAULT) -> None:
    """Keep positive amounts, attach the ingest ordinal and the text key, write partitioned
    by year.

    The amount is stored as a number (text that is none counts as NULL, so the row is
    dropped like other non-positive ones). Landing some years replaces them alone. The key
    of the activity text is stored, so later counts and joins need not read the texts. A
    text column is kept aside: each text once, in ``texts``, however many activities carry
    it; the landed, merged and selected tables name it (``prepare.with_texts``).
    """
    df = activities.withColumn(fields.amount, ingest.to_number(qcol(fields.amount), "double"))
    df = ingest.positive_amount(df, fields=fields)
    df = ingest.add_ordinal(df, fields)
    if fields.year in df.columns:
        df = df.withColumn(fields.year, ingest.to_number(qcol(fields.year)))
    df = with_text_key(df, fields)
    if fields.text in df.columns and not {fields.title, fields.short_description, fields.long_description} & set(df.columns):
        df = df.withColumn(TEXT_HASH, text_hash(qcol(fields.text)))
        _keep_texts(df, layout, fields)
        df = df.drop(fields.text)
    sinks.write_by_year(df, layout.landed, fields)


def _keep_texts(df: DataFrame, layout: Layout, fields: Fields) -> None:
    """Append the texts of ``df`` that ``layout.texts`` does not have."""
    names = [F.col(TEXT_HASH), qcol(fields.key)]
    new = df.where(F.col(TEXT_HASH).isNotNull()).select(qcol(fields.key), F.col(TEXT_HASH), qcol(fields.text)).distinct()
    have = read_if_exists(df.sparkSession, layout.texts)
    if have is not None:
        have = have.select(*[c.alias(n) for c, n in zip(names, ("__hash", "__key"), strict=True)])
        new = new.join(have, qcol(fields.key).eqNullSafe(F.col("__key")) & (F.col(TEXT_HASH) == F.col("__hash")), "left_anti")
    sinks.append_table(new, layout.texts)


def land_yearly_csv(spark: SparkSession, pattern: str, years: Iterable[int], layout: Layout, fields: Fields = DEFAULT, multi_line: bool = True, reject: bool = True) -> int:
    """Yearly CSV downloads (``pattern`` with a ``{year}`` slot) → landed table (Parquet,
    splittable; everything downstream reads it in parallel). Returns the rows put aside.

    Rows keep file order (the ordinal: files by name, then the place in the file). A row with
    more cells than its header does not end the landing: it goes, as it stands in the file,
    to the ``rejected`` table of its year (``reject=False``: it is an error). Files without
    quoted line breaks can be read with ``multi_line=False``: then such a row is an error, too,
    and the ordinal is the order of Spark's partitions.
    """
    years = sorted({int(y) for y in years})
    if not multi_line or not reject:
        raw = ingest.read_years(spark, pattern, years, fmt="csv", fields=fields, multi_line=multi_line)
        land(ingest.normalize_nulls(raw), layout, fields)
        return 0
    record = csv_records.RECORD
    frames = []
    for y in years:
        part = ingest.read_csv_records(spark, pattern.format(year=y))
        year = F.coalesce(ingest.to_number(qcol(fields.year)), F.lit(y)) if fields.year in part.columns else F.lit(y)
        frames.append(part.withColumn(fields.year, year.cast("int")).withColumn("__file_year", F.lit(y)))
    parsed = ingest.collate(frames)
    seen = Observation("rejected")
    rows = parsed.observe(seen, F.count_if(F.col(f"{record}.surplus")).alias("n"))
    rows = rows.withColumn(fields.ordinal, F.col(f"{record}.ordinal")).where(~F.col(f"{record}.surplus")).drop(record, "__file_year")
    land(ingest.normalize_nulls(rows), layout, fields)
    n = seen.get["n"]
    # rejected rows of these years from an earlier landing go; only if there are new ones
    # the files are read again
    drop_partitions(spark, layout.rejected, fields.year, years)
    if n:
        bad = csv_records.rejected(parsed, ["__file_year"]).withColumnRenamed("__file_year", fields.year)
        bad.write.mode("append").partitionBy(fields.year).parquet(layout.rejected)
    return n


def prepare(spark: SparkSession, layout: Layout, fields: Fields = DEFAULT, estimate_cost: bool = True) -> dict:
    """Unique non-blank texts of all landed years → ``prepared``; returns the funnel counts
    and (by default) the token proxy total and estimated price, all observed during the
    write. The texts of some years alone would lose those of the others."""
    landed = ingest.read_years(spark, layout.landed, None, fields=fields)
    obs = PrepareObservation(with_tokens=estimate_cost)
    texts = prepare_texts(landed, fields, observation=obs, texts=read_if_exists(spark, layout.texts))
    sinks.write_table(texts, layout.prepared)
    return obs.get()


def label(
    spark: SparkSession,
    layout: Layout,
    taxonomy: Taxonomy,
    make_classifier: Callable[[], lb.Classifier],
    fields: Fields = DEFAULT,
    max_cost: float | None = None,
    sample_codes: Sequence[str] | None = None,
    sample_size: int | None = None,
    sectors=None,
    **label_kw,
) -> int:
    """Label the prepared texts without a label and append them, batch by batch (each a
    commit of its own, see ``label_batches``); returns how many have a label now that had
    none. Texts whose tries are exhausted are quarantined and offered again next time.

    ``sample_codes``/``sample_size`` restrict a trial run to the first matching
    texts (falling back to the first texts). ``max_cost`` gates the run on the
    estimated price of the requests still to send.
    """
    texts = spark.read.parquet(layout.prepared)
    if sample_size:
        texts = lb.sample_by_code(texts, fields.purpose_code, sample_codes or taxonomy.sector_codes, sample_size, [fields.ordinal])
    done = read_if_exists(spark, layout.labels(taxonomy))
    known = sinks.labelled_rows(done) if done is not None else None
    before = known.count() if known is not None else 0
    todo = lb.unprocessed(texts, known, fields.key) if known is not None else texts
    if max_cost is not None:
        lb.check_budget(lb.request_frame(todo, fields, sectors), taxonomy.system_prompt(), max_cost)
    # batches are sized by the texts still to label: counted by their keys, or in the prepared table's footers
    left = texts.count() if known is None else lb.unprocessed(texts.select(qcol(fields.key)), known, fields.key).count()
    lb.label_batches(todo, taxonomy, make_classifier, partial(sinks.append_labels, path=layout.labels(taxonomy)), fields, expected=left, sectors=sectors, **label_kw)
    now = read_if_exists(spark, layout.labels(taxonomy))
    return (sinks.labelled_rows(now).count() if now is not None else 0) - before


def merge(spark: SparkSession, layout: Layout, taxonomy: Taxonomy, fields: Fields = DEFAULT, years: Iterable[int] | None = None) -> None:
    """Every landed activity with its labels (NULL where unlabelled) → ``merged``; merging
    some years replaces them alone, merging all replaces the table. A text that was built
    from the descriptions does not pass through the join: it is built again behind it. One
    that is kept aside stays there."""
    landed = ingest.read_years(spark, layout.landed, years, fields=fields)
    aside = TEXT_HASH in landed.columns
    built = fields.text not in landed.columns and not aside
    acts = with_text_key(landed, fields) if built or aside else ensure_text_key(landed, fields)
    labels = sinks.labelled_rows(spark.read.parquet(layout.labels(taxonomy)))
    keep = ["summary", "reasoning", *taxonomy.vocabulary, fields.purpose_code]
    # texts shared by a large share of activities are salted in the join
    hot = hot_keys(spark.read.parquet(layout.prepared), fields)
    merged = attach_labels(acts, labels, fields, label_columns=keep, hot_keys=hot)
    if built:
        merged = ensure_text_key(merged, fields)
    sinks.write_by_year(merged, layout.merged(taxonomy), fields, replace=years is None)


def report(spark: SparkSession, layout: Layout, taxonomy: Taxonomy, fields: Fields = DEFAULT, strict_nulls: bool = True) -> dict[str, DataFrame]:
    """Selected activities, review list and the yearly report tables (CSV, one row per
    year), each replaced as a whole: a year without selected activities is in none of them,
    whatever an earlier report found. Returns the report DataFrames (backed by the checkpointed per-year summary)."""
    merged = ingest.read_years(spark, layout.merged(taxonomy), None, fields=fields)
    marked = mark(merged, taxonomy, fields)
    summary = rp.SelectionObservation(fields, f"selection{taxonomy.suffix}")
    # one scan of the merged table writes the selected activities and gathers the summary
    sinks.write_by_year(select_marked(summary.attach(marked), taxonomy, fields), layout.selected(taxonomy), fields, replace=True)
    sel = spark.read.parquet(layout.selected(taxonomy))
    # the review list is part of the selected activities
    sinks.write_table(with_texts(false_negatives(sel, fields), read_if_exists(spark, layout.texts), fields), layout.report(taxonomy, "false_negatives"))
    tables = rp.all_reports(sel, taxonomy, fields, strict_nulls)
    tables["selection_summary"] = spark.createDataFrame([summary.get()], rp.SELECTION_SCHEMA)
    for name, df in tables.items():
        sinks.write_report_csv(df, layout.report(taxonomy, name))
    return tables


def label_stream(
    spark: SparkSession,
    layout: Layout,
    taxonomy: Taxonomy,
    make_classifier: Callable[[], lb.Classifier],
    landing: str,
    schema,
    fields: Fields = DEFAULT,
    available_now: bool = True,
    max_files_per_trigger: int | None = MAX_FILES_PER_TRIGGER,
    **label_kw,
):
    """Label activity files as they land in ``landing`` (Structured Streaming):
    each micro-batch is deduplicated, skips texts already in the label table and
    runs the distributed labelling job; results go to the same label table the
    batch stages use. Returns the running query (``availableNow`` stops when the
    landed files are done)."""
    from spendlens.streaming.incremental import start_incremental_labelling

    def label_parts(texts: DataFrame, commit) -> None:
        lb.label_batches(texts, taxonomy, make_classifier, commit, fields, **label_kw)

    checkpoint = f"{layout.root}/_streams/labels{taxonomy.suffix}"
    return start_incremental_labelling(
        spark, landing, schema, layout.labels(taxonomy), checkpoint, None, fields,
        available_now=available_now, max_files_per_trigger=max_files_per_trigger, batches=label_parts,
    )


def export_csv(spark: SparkSession, layout: Layout, taxonomy: Taxonomy, table: str = "merged", out: str | None = None, fields: Fields = DEFAULT) -> str:
    """Export the merged or selected activities as CSV with a header (quotes doubled,
    texts kept byte for byte), written in parallel as part files."""
    src = {"merged": layout.merged(taxonomy), "selected": layout.selected(taxonomy)}[table]
    target = out or f"{layout.root}/export/{table}{taxonomy.suffix}_csv"
    rows = with_texts(spark.read.parquet(src), read_if_exists(spark, layout.texts), fields)
    sinks.write_table(rows, target, fmt="csv")
    return target


def run_all(
    spark: SparkSession,
    activities: DataFrame,
    root: str,
    taxonomies: Sequence[Taxonomy],
    make_classifier: Callable[[Taxonomy], Callable[[], lb.Classifier]],
    fields: Fields = DEFAULT,
    **label_kw,
) -> dict:
    """Land once, prepare once, then label, merge and report per taxonomy."""
    configure(spark)
    layout = Layout(root)
    land(activities, layout, fields)
    out = {"funnel": prepare(spark, layout, fields)}
    for t in taxonomies:
        out[t.name] = {
            "labelled": label(spark, layout, t, make_classifier(t), fields, **label_kw),
        }
        merge(spark, layout, t, fields)
        out[t.name]["reports"] = report(spark, layout, t, fields)
    return out
