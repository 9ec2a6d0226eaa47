"""Incremental, resumable labelling as a Structured Streaming query.

New activity files landing in a folder are picked up by a file stream. A state store keeps
every text key seen, in buckets: a key's first row (by the order, within a micro-batch) goes on to be
labelled, and no later row of it ever does. The state starts with the keys that the label
table has when the stream first runs, and lives with the stream's checkpoint, so a restart
goes on where it stopped and no micro-batch reads the label table. Each micro-batch leaves
a mark before it labels; one that finds its mark was cut off before the stream committed
it, and only then the texts it had already labelled are looked up. ``availableNow`` drains
what has landed and stops, which is how a scheduled resume run works.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence
from functools import partial

import pandas as pd
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.types import StructType

from spendlens._compat import qcol
from spendlens.fields import DEFAULT, Fields
from spendlens.operators.label import unprocessed
from spendlens.operators.prepare import drop_blank, ensure_text_key, prepare_texts
from spendlens.session import ship_package, work_path
from spendlens.sources import sinks

# Files of one micro-batch: a first run over a full landing folder is many batches.
MAX_FILES_PER_TRIGGER = 64
# Buckets of keys in the state, fixed for a checkpoint's life.
BUCKETS, BUCKET = 1 << 11, "__bucket"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _path_exists(spark: SparkSession, path: str) -> bool | None:
    """Hadoop FileSystem existence check (None where the JVM gateway is not available)."""
    try:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        return bool(p.getFileSystem(conf).exists(p))
    except Exception:  # noqa: BLE001 - e.g. a Connect session
        return None


def read_if_exists(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame | None:
    """The table at ``path``, or None when nothing was committed there yet: no such
    path, or a folder without data files. Any other error (no access, damaged files)
    is raised, since an unread label table would have everything labelled again."""
    if _path_exists(spark, path) is False:
        return None
    try:
        return spark.read.format(fmt).load(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


class FirstSeen(StatefulProcessor):
    """Per bucket of keys: the first row, by ``order``, of every key in the first micro-batch
    that has it. The state is a list that grows by one element, the new keys, a micro-batch."""

    def __init__(self, key: str, order: Sequence[str], columns: Sequence[str]):
        self.key, self.order, self.columns = key, list(order), list(columns)

    def init(self, handle) -> None:
        self.seen = handle.getListState("seen", "keys array<string>")

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N803 - Spark's names
        self.seen.appendValue((list(initialState[self.key]),))

    def handleInputRows(self, key, rows, timerValues):  # noqa: N803 - Spark's names
        seen = {k for (keys,) in self.seen.get() for k in keys}
        best = None
        for part in rows:  # a bucket's rows come in parts: one row of a new key is kept
            part = part[~part[self.key].isin(seen)]
            if len(part):
                part = part if best is None else pd.concat([best, part])
                best = part.sort_values(self.order, kind="stable").drop_duplicates(self.key)
        if best is not None:
            self.seen.appendValue((list(best[self.key]),))
            yield best[self.columns]

    def close(self) -> None:
        pass


def first_seen(texts: DataFrame, known: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first row of every key of a stream, except the keys in ``known`` (key).

    Before the rows are dealt by key, each Arrow batch keeps one row of a key, so a text
    on a large share of all rows leaves its tasks as few rows. The state is asked once for
    a bucket of keys (``BUCKETS``), not once or twice for each key.
    """
    ship_package(texts.sparkSession)
    columns, order = texts.columns, list(order)

    def bucketed(df: DataFrame) -> DataFrame:
        return df.withColumn(BUCKET, F.pmod(F.xxhash64(qcol(key)), F.lit(BUCKETS)).cast("int"))

    def thin(parts):
        for part in parts:
            yield part.sort_values(order, kind="stable").drop_duplicates(key)

    thinned = texts.mapInPandas(thin, texts.schema)
    # Spark also starts a Python process beside the driver for this operator, which does not
    # get shipped files: the processor goes there whole
    here = sys.modules[__name__]
    cloudpickle.register_pickle_by_value(here)
    try:
        return bucketed(thinned).groupBy(BUCKET).transformWithStateInPandas(
            FirstSeen(key, order, columns), texts.schema, outputMode="append", timeMode="none", initialState=bucketed(known.select(key).distinct()).groupBy(BUCKET)
        )
    finally:
        cloudpickle.unregister_pickle_by_value(here)


def label_batch_fn(
    out_path: str,
    label: Callable[[DataFrame], DataFrame] | None,
    fields: Fields = DEFAULT,
    order: Sequence[str] | None = None,
    batches: Callable[[DataFrame, Callable[[DataFrame], None]], None] | None = None,
    marks: str | None = None,
) -> Callable[[DataFrame, int], None]:
    """foreachBatch body: label → append. ``batches(texts, commit)`` labels in parts that are
    committed one by one; ``label`` in one.

    With ``marks`` (a folder) the rows are new texts, and the label table is read only for
    a batch that was begun before. Without, the rows are activities as they landed: they
    are prepared, and the texts that the label table has are skipped.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        texts, again = batch, True
        if marks is None:
            texts = prepare_texts(batch, fields, order=order)
        else:
            mark = f"{marks}/{batch_id}"
            again = read_if_exists(spark, mark) is not None
            if not again:
                spark.range(1).write.mode("overwrite").parquet(mark)
        done = read_if_exists(spark, out_path) if again else None
        if done is not None:
            texts = unprocessed(texts, sinks.labelled_rows(done), fields.key)
        commit = partial(sinks.append_labels, path=out_path)
        if batches is not None:
            batches(texts, commit)
        else:
            commit(label(texts))

    return run


def start_incremental_labelling(
    spark: SparkSession,
    source_path: str,
    source_schema: StructType,
    out_path: str,
    checkpoint_path: str,
    label: Callable[[DataFrame], DataFrame] | None,
    fields: Fields = DEFAULT,
    order: Sequence[str] | None = None,
    fmt: str = "parquet",
    available_now: bool = True,
    max_files_per_trigger: int | None = MAX_FILES_PER_TRIGGER,
    batches: Callable[[DataFrame, Callable[[DataFrame], None]], None] | None = None,
) -> StreamingQuery:
    """Start the stream; with ``available_now`` it processes everything landed, in
    micro-batches of at most ``max_files_per_trigger`` files, and stops.

    Texts whose tries are exhausted are quarantined; the stream does not offer them again,
    the batch stage (``plans.stages.label``) does.
    """
    reader = spark.readStream.schema(source_schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    acts = reader.load(source_path)
    if fields.purpose_code not in acts.columns:
        acts = acts.withColumn(fields.purpose_code, F.lit(None).cast("string"))
    order = list(order) if order is not None else [c for c in (fields.year, fields.ordinal) if c in acts.columns]
    if not order:
        raise ValueError("first-wins dedup needs an ordinal column (see sources.ingest.add_ordinal)")
    names = [fields.key, fields.text, fields.purpose_code]
    texts = drop_blank(ensure_text_key(acts, fields), fields.text)
    texts = texts.select(*[qcol(c) for c in (*names, *[o for o in order if o not in names])])
    # the state begins with the labelled texts; Spark asks for them in the first micro-batch only
    done = None if _path_exists(spark, f"{checkpoint_path}/commits") else read_if_exists(spark, out_path)
    known = sinks.labelled_rows(done).select(qcol(fields.key)) if done is not None else spark.createDataFrame([], f"`{fields.key}` string")
    new = first_seen(texts, known, fields.key, order)
    body = label_batch_fn(out_path, label, fields, order, batches, marks=f"{checkpoint_path.rstrip('/')}-begun")
    writer = new.writeStream.outputMode("append").foreachBatch(body).option("checkpointLocation", checkpoint_path)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)  # state on disk: it grows with the texts
    try:
        return writer.start()  # the query keeps the settings it was started with
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)


def run_incremental_fixture(spark: SparkSession, sf_dir: str, keywords: dict) -> DataFrame:
    """Documents land in three drops (even ids, the rest, and all of them again); the
    stream is started anew after each with one checkpoint. Result: the label table, one row
    per distinct text."""
    from spendlens.operators.label import keyword_labels
    from spendlens.plans.fixtures import FIX, FIXTURE_TAXONOMY, LABEL_COLUMNS, table

    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("activity_id"),
        F.col("text").alias("txt"),
        F.lit(None).cast("string").alias("purpose_code"),
    )
    root = work_path(spark, "stream")
    src, out, ckpt = f"{root}/landing", f"{root}/labels", f"{root}/checkpoint"
    drops = [docs.where(F.col("activity_id") % 2 == 0), docs.where(F.col("activity_id") % 2 == 1), docs]
    schema = docs.schema

    def label(texts: DataFrame) -> DataFrame:
        return keyword_labels(texts, FIXTURE_TAXONOMY, keywords, FIX)

    for drop in drops:
        drop.write.mode("append").parquet(src)
        q = start_incremental_labelling(spark, src, schema, out, ckpt, label, FIX, order=["activity_id"])
        q.awaitTermination()
        if q.exception() is not None:
            raise RuntimeError(str(q.exception()))
    return sinks.labelled_rows(spark.read.parquet(out)).select("text_key", *LABEL_COLUMNS)
