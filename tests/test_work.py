"""Batches of the labelling job, its call rate, and the stream's state of seen texts."""

import os

import pytest
from pyspark.sql import functions as F

from spendlens.fields import Fields
from spendlens.functions.text import text_key
from spendlens.operators import label as lb
from spendlens.sources import sinks
from spendlens.sources.evolve import partition_folders
from spendlens.streaming.incremental import label_batch_fn, start_incremental_labelling
from spendlens.taxonomy import CONTINUUM

FLD = Fields()


def _texts(spark, n):
    return spark.range(n).select(F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.lit(None).cast("string").alias("PurposeCode"), F.col("id").alias("ord")).withColumn("text_key", text_key("text"))


@pytest.mark.parametrize("expected", [None, 1000])
def test_work_table_is_one_pass_and_loses_nothing(spark, expected):
    read = spark.sparkContext.accumulator(0)

    def count(parts):
        for p in parts:
            read.add(len(p))
            yield p

    texts = _texts(spark, 1000)
    parts = lb.work_table(texts.mapInPandas(count, texts.schema), FLD, 300, expected)
    assert read.value == 1000  # evaluated once
    assert len(parts) == 4 and sum(n for _, n in parts) == 1000
    assert all(p.count() == n and 150 < n < 400 for p, n in parts)
    rows = [r.ord for p, _ in parts for r in p.collect()]
    assert sorted(rows) == list(range(1000))
    assert lb.work_table(texts.limit(0), FLD, 300, expected) == []


def test_batches_are_committed_one_by_one(spark):
    sizes = []
    lb.label_batches(_texts(spark, 50), CONTINUUM, lambda: lb.KeywordClassifier({}), lambda df: sizes.append(df.count()), FLD, texts_per_batch=20, system_prompt="p")
    assert len(sizes) == 3 and sum(sizes) == 50


class Clock:
    def __init__(self):
        self.now = 0.0

    def __call__(self):
        return self.now

    def sleep(self, s):
        self.now += s


def test_rate_limit():
    c = Clock()
    limit = lb.RateLimit(4.0, clock=c, sleep=c.sleep)
    at = []
    for _ in range(9):
        limit.take()
        at.append(c.now)
    assert at == pytest.approx([k / 4 for k in range(9)])
    c.now += 100  # a pause earns no more than the burst
    for _ in range(3):
        limit.take()
    assert c.now == pytest.approx(at[-1] + 100 + 2 / 4)
    burst = lb.RateLimit(1.0, burst=3, clock=c, sleep=c.sleep)
    start = c.now
    for _ in range(4):
        burst.take()
    assert c.now - start == pytest.approx(1.0)
    with pytest.raises(ValueError):
        lb.RateLimit(0)


def test_shares_of_the_job_wide_rate():
    assert lb.rate_shares(10, 4) == (4, 2.5)
    assert lb.rate_shares(3.5, 100) == (3, 3.5 / 3)
    assert lb.rate_shares(0.5, 100) == (1, 0.5)
    with pytest.raises(ValueError):
        lb.rate_shares(0, 1)


def test_the_job_keeps_to_its_rate(spark):
    import time

    t = time.monotonic()
    out = lb.label_texts(_texts(spark, 24), CONTINUUM, lambda: lb.KeywordClassifier({}), FLD, system_prompt="p", num_partitions=50, max_rate=4.0)
    rows = out.collect()
    assert len(rows) == 24 and time.monotonic() - t >= 4  # 24 calls, 4 a second, one each at once
    assert {r.tries for r in rows} == {1}


def _stream(spark, root, rows, order=("ord",)):
    rows.write.mode("append").parquet(f"{root}/in")
    label = lambda texts: lb.keyword_labels(texts, CONTINUUM, {}, FLD)
    q = start_incremental_labelling(spark, f"{root}/in", rows.schema, f"{root}/labels", f"{root}/ck", label, FLD, order=list(order))
    q.awaitTermination()
    return {(r.text, r.PurposeCode) for r in sinks.labelled_rows(spark.read.parquet(f"{root}/labels")).collect()}, spark.read.parquet(f"{root}/labels").count()


def test_the_stream_keeps_the_first_row_and_knows_labelled_texts(spark, tmp_root):
    schema = "text string, PurposeCode string, ord long"
    known = spark.createDataFrame([("old", "0", 0)], schema).withColumn("text_key", text_key("text"))
    sinks.append_labels(lb.keyword_labels(known, CONTINUUM, {}, FLD), f"{tmp_root}/labels")
    one = spark.createDataFrame([("old", "9", 1), ("a", "late", 7), ("a", "first", 2), (" ", "x", 3), ("b", "b", 4)], schema).repartition(4)
    got, n = _stream(spark, tmp_root, one)
    assert got == {("old", "0"), ("a", "first"), ("b", "b")} and n == 3
    two = spark.createDataFrame([("a", "again", 0), ("c", "c", 9), ("old", "9", 0)], schema)
    got, n = _stream(spark, tmp_root, two)  # started anew, on the same checkpoint
    assert got == {("old", "0"), ("a", "first"), ("b", "b"), ("c", "c")} and n == 4


def test_a_batch_that_was_cut_off_is_not_labelled_twice(spark, tmp_root):
    texts = _texts(spark, 6)
    out, marks = os.path.join(tmp_root, "labels"), os.path.join(tmp_root, "marks")
    label = lambda t: lb.keyword_labels(t, CONTINUUM, {}, FLD)
    run = label_batch_fn(out, label, FLD, marks=marks)
    run(texts.limit(3), 0)
    run(texts, 0)  # begun, partly labelled, never committed by the stream
    assert spark.read.parquet(out).count() == 6
    assert partition_folders(spark, out, sinks.OUTCOME).keys() == {"ok"}


def test_a_new_batch_does_not_read_the_label_table(spark, tmp_root, monkeypatch):
    from spendlens.streaming import incremental as inc

    asked, read = [], inc.read_if_exists
    monkeypatch.setattr(inc, "read_if_exists", lambda s, p, *a: asked.append(p) or read(s, p, *a))
    out, marks = os.path.join(tmp_root, "labels"), os.path.join(tmp_root, "marks")
    run = label_batch_fn(out, lambda t: lb.keyword_labels(t, CONTINUUM, {}, FLD), FLD, marks=marks)
    run(_texts(spark, 3), 0)
    run(_texts(spark, 5).where("ord > 2"), 1)
    assert out not in asked and spark.read.parquet(out).count() == 5


def test_a_resumed_run_sizes_its_batches_by_what_is_left(spark, tmp_root, monkeypatch):
    from spendlens.plans import stages as pl

    layout, seen = pl.Layout(tmp_root), []
    work = lb.work_table
    monkeypatch.setattr(lb, "work_table", lambda texts, fields, size, expected=None: seen.append(expected) or work(texts, fields, size, expected))
    _texts(spark, 40).write.parquet(layout.prepared)
    kw = {"system_prompt": "p", "num_partitions": 1}
    assert pl.label(spark, layout, CONTINUUM, lambda: lb.KeywordClassifier({}), FLD, **kw) == 40
    _texts(spark, 45).write.mode("overwrite").parquet(layout.prepared)
    assert pl.label(spark, layout, CONTINUUM, lambda: lb.KeywordClassifier({}), FLD, **kw) == 5
    assert seen == [40, 5]


def test_the_state_of_seen_texts_is_asked_once_a_bucket():
    import pandas as pd

    from spendlens.streaming import incremental as inc

    class Kept:
        def __init__(self):
            self.rows, self.asked = [], 0

        def get(self):
            self.asked += 1
            return iter(list(self.rows))

        def appendValue(self, row):  # noqa: N802 - Spark's name
            self.asked += 1
            self.rows.append(row)

    class Handle:
        kept = Kept()

        def getListState(self, name, schema):  # noqa: N802 - Spark's name
            return self.kept

    p = inc.FirstSeen("text_key", ["ord"], ["text_key", "ord"])
    p.init(Handle())
    p.handleInitialState((0,), pd.DataFrame({"text_key": ["k0"], "ord": [0]}), None)
    before = Handle.kept.asked

    def frame(keys, at):
        return pd.DataFrame({"text_key": keys, "ord": range(at, at + len(keys))})

    keys = [f"k{i}" for i in range(500)]
    out = pd.concat(p.handleInputRows((0,), iter([frame(keys, 500), frame([*keys, None], 0)]), None))
    assert dict(zip(out.text_key, out.ord, strict=True)) == {**{f"k{i}": i for i in range(1, 500)}, None: 500}
    assert Handle.kept.asked - before == 2
    assert list(p.handleInputRows((0,), iter([frame([*keys, None], 0)]), None)) == []


def test_a_task_holds_one_slice_of_an_arrow_batch_at_a_time():
    import pyarrow as pa

    calls = []

    class Model:
        def classify(self, prompt, message):
            calls.append(message)
            return '{"classifications":[]}'

    n, long = 2 * lb.SLICE_ROWS + 10, "x" * (lb.SLICE_BYTES // 2 + 1)
    texts = [None, "", *["short"] * (n - 5), long, long, long * 3]
    batch = pa.RecordBatch.from_pydict({"k": list(range(n)), "text": texts, "sector": [None, "s"] * (n // 2)})
    run = lb._partition_labeller(Model, "p", "text", "sector", "raise", 1, 0.0, 1, [], 0.0)
    sizes, kept = [], []
    for out in run(iter([batch.slice(0, 0), batch.slice(0, 7), batch.slice(7)])):
        assert out.schema.names == ["k", "text", "response", "error", "tries"]
        sizes.append(out.num_rows)
        kept += zip(out.column("k").to_pylist(), out.column("text").to_pylist(), strict=True)
        assert len(calls) == sum(sizes)  # nothing behind the slice was asked yet
    assert sizes == [7, 1000, 1000, 1, 1, 1] and kept == list(enumerate(texts))
    assert calls == [(t or "") + "\nSector: " + ("s" if k % 2 else "") for k, t in enumerate(texts)]
