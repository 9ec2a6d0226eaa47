"""Labelling job: one structured classification per unique text.

Plan: unique texts → skip keys already labelled (anti-join) → sector name and
user message (native expressions) → ``repartition(n, key)`` → ``mapInArrow``
calling the classifier (client opened once per partition, calls retried with
exponential backoff, optionally concurrent) → ``from_json`` parse + vocabulary
check + multi-hot (native) → written before anything reads it, so a re-planned
query can never call the model twice for a committed row.

The classifier is pluggable: anything with ``classify(system_prompt, message)
-> JSON text``. ``KeywordClassifier`` is a deterministic stand-in for tests;
``keyword_labels`` is the same rule as a pure native expression.
"""

from __future__ import annotations

import json
import random
import threading
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens._compat import qcol
from spendlens.fields import DEFAULT, Fields
from spendlens.session import ship_package, work_path
from spendlens.functions.arrow import slices
from spendlens.functions.labels import keyword_classes, multi_hot, parse_response
from spendlens.functions.text import SECTOR_SEPARATOR, cost, request_payload, token_count, user_message
from spendlens.sources.dimensions import sector_lookup
from spendlens.taxonomy import Taxonomy

# Texts per labelling task: a lost executor re-sends no more than its tasks' texts.
TEXTS_PER_TASK = 500
# Texts that are labelled and committed together: a job that fails loses no more.
TEXTS_PER_BATCH = 50_000
# Texts, and their bytes, that a task holds as messages at a time.
SLICE_ROWS, SLICE_BYTES = 1000, 2 << 20

# Retry policy defaults (tries, base wait s, cap s).
MAX_TRIES = 5
BASE_BACKOFF = 1.0
MAX_BACKOFF = 60.0


class Classifier(Protocol):
    def classify(self, system_prompt: str, message: str) -> str:  # JSON response text
        ...


def backoff_wait(attempt: int, base: float = BASE_BACKOFF, cap: float = MAX_BACKOFF, jitter: float = 1.0, rng: Callable[[], float] = random.random) -> float:
    """Wait after failed try ``attempt`` (1-based): ``min(cap, base * 2^(attempt-1)) + U(0, jitter)``."""
    return min(cap, base * (2 ** (attempt - 1))) + rng() * jitter


def call_with_retry(
    fn: Callable[[], str],
    max_tries: int = MAX_TRIES,
    base: float = BASE_BACKOFF,
    cap: float = MAX_BACKOFF,
    jitter: float = 1.0,
    sleep: Callable[[float], None] = time.sleep,
    rng: Callable[[], float] = random.random,
) -> tuple[str, int]:
    """Run ``fn`` up to ``max_tries`` times; returns (result, tries). The last error
    is re-raised once tries are exhausted (no wait after the last try)."""
    last: BaseException | None = None
    for attempt in range(1, max_tries + 1):
        try:
            return fn(), attempt
        except Exception as e:  # noqa: BLE001 - any client error is retried
            last = e
            if attempt < max_tries:
                sleep(backoff_wait(attempt, base, cap, jitter, rng))
    assert last is not None
    raise last


class RateLimit:
    """Token bucket: ``rate`` calls a second on the average, and at most ``burst`` at once.
    Threads that share it wait their turn."""

    def __init__(self, rate: float, burst: float = 1.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        if rate <= 0 or burst < 1:
            raise ValueError("rate must be positive and burst at least 1")
        self.rate, self.burst, self.clock, self.sleep = rate, burst, clock, sleep
        self.tokens, self.seen, self.lock = burst, clock(), threading.Lock()

    def take(self) -> None:
        """Wait for a token and take it. The token is taken before the wait, so whoever
        comes next waits for the one after it."""
        with self.lock:
            now = self.clock()
            self.tokens = min(self.burst, self.tokens + (now - self.seen) * self.rate)
            self.seen = now
            self.tokens -= 1
            wait = max(0.0, -self.tokens / self.rate)
        if wait:
            self.sleep(wait)


def rate_shares(max_rate: float, tasks: int) -> tuple[int, float]:
    """(tasks, calls a second of each): all tasks together, even if all run at once, stay
    within ``max_rate``, and no task gets less than one call a second (below one call a
    second in all there is one task)."""
    if max_rate <= 0:
        raise ValueError("max_rate must be positive")
    tasks = max(1, min(tasks, int(max_rate)))
    return tasks, max_rate / tasks


class KeywordClassifier:
    """Deterministic classifier: a class matches when one of its keywords occurs
    (case-insensitive substring). Returns the same JSON a model would."""

    def __init__(self, keywords: Mapping[str, Sequence[str]]):
        self.keywords = {c: [w.lower() for w in ws if w] for c, ws in keywords.items()}

    def classify(self, system_prompt: str, message: str) -> str:
        text = message.lower()
        hits = [c for c, ws in self.keywords.items() if any(w in text for w in ws)]
        return json.dumps({"summary": "", "reasoning": "keyword match", "classifications": hits})


def check_response(response: str | None, vocab: Sequence[str]) -> str:
    """The response if it is a JSON object with a list of class names of the vocabulary,
    as ``parse_response`` accepts; raises otherwise, so that the call is tried again."""
    parsed = json.loads(response) if response is not None else None
    classes = parsed.get("classifications") if isinstance(parsed, dict) else None
    if not isinstance(classes, list):
        raise ValueError("response without a class list")
    unknown = [c for c in classes if c not in vocab]
    if unknown:
        raise ValueError(f"classes outside the vocabulary: {unknown}")
    return response


def _partition_labeller(
    make_classifier: Callable[[], Classifier],
    system_prompt: str,
    text: str,
    sector: str,
    on_error: str,
    max_tries: int,
    base: float,
    concurrency: int,
    vocab: Sequence[str],
    jitter: float,
    rate: float | None = None,
):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clf = make_classifier()  # one client per partition
        pool = ThreadPoolExecutor(max_workers=concurrency) if concurrency > 1 else None
        limit = RateLimit(rate) if rate is not None else None

        def call(msg: str) -> str:
            if limit is not None:
                limit.take()
            # an answer that does not parse or names an unknown class is a failed try
            return check_response(clf.classify(system_prompt, msg), vocab)

        def one(msg: str):
            try:
                resp, tries = call_with_retry(lambda: call(msg), max_tries, base, jitter=jitter)
                return resp, None, tries
            except Exception as e:  # noqa: BLE001
                if on_error == "raise":
                    raise
                return None, f"{type(e).__name__}: {e}", max_tries

        try:
            for batch in slices(batches, text, SLICE_ROWS, SLICE_BYTES):  # messages and answers of one slice at a time
                # same message as functions.text.user_message; built here so the
                # text crosses to Python once instead of twice
                pairs = zip(batch.column(text).to_pylist(), batch.column(sector).to_pylist(), strict=True)
                msgs = [(t or "") + SECTOR_SEPARATOR + (s or "") for t, s in pairs]
                results = list(pool.map(one, msgs)) if pool else [one(m) for m in msgs]
                kept = [c for c in batch.schema.names if c != sector]
                answers = [pa.array([r[k] for r in results], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int32()))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *answers], names=[*kept, "response", "error", "tries"])
        finally:
            if pool:
                pool.shutdown()

    return run


def request_frame(texts: DataFrame, fields: Fields = DEFAULT, sectors=None) -> DataFrame:
    """Unique texts → rows with the user message (text + sector line)."""
    df = sector_lookup(texts, fields.purpose_code, "sector_name", sectors)
    return df.withColumn("user_message", user_message(qcol(fields.text), F.col("sector_name")))


def label_texts(
    texts: DataFrame,
    taxonomy: Taxonomy,
    make_classifier: Callable[[], Classifier],
    fields: Fields = DEFAULT,
    sectors=None,
    num_partitions: int | None = None,
    on_error: str = "raise",
    max_tries: int = MAX_TRIES,
    base_backoff: float = BASE_BACKOFF,
    jitter: float = 1.0,
    concurrency: int = 1,
    system_prompt: str | None = None,
    texts_per_task: int | None = TEXTS_PER_TASK,
    n_texts: int | None = None,
    max_rate: float | None = None,
) -> DataFrame:
    """Label every row of ``texts`` (key, text, purpose code, ordinal) with ``taxonomy``.

    Tasks are sized by texts, not bytes: without ``num_partitions`` the texts (``n_texts``;
    counted if not given) are spread over ``ceil(n / texts_per_task)`` tasks. With
    ``max_rate``, calls a second of the whole job, there are no more tasks than the rate has
    calls, each with its share of it (see ``RateLimit``); tries count, too. Output is published when the job commits, so give it bounded batches (``label_batches``).
    Every answer is validated inside the retry: bad JSON or a class outside the
    vocabulary is tried again.
    ``make_classifier`` is called once per partition on the executor.
    ``on_error='raise'`` fails the task once retries are exhausted;
    ``'quarantine'`` keeps the row with status ``failed`` and the last error.
    Output: key, text, purpose code, [ordinal], summary, reasoning, one boolean
    per class of the vocabulary, status, error, tries.
    """
    if on_error not in ("raise", "quarantine"):
        raise ValueError("on_error must be 'raise' or 'quarantine'")
    prompt = system_prompt if system_prompt is not None else taxonomy.system_prompt()
    ship_package(texts.sparkSession)
    req = sector_lookup(texts, fields.purpose_code, "sector_name", sectors)
    keep = [c for c in (fields.key, fields.text, fields.purpose_code, fields.ordinal) if c in req.columns]
    req = req.select(*[qcol(c) for c in keep], F.col("sector_name"))
    if not num_partitions and texts_per_task:
        num_partitions = max(1, -(-(texts.count() if n_texts is None else n_texts) // texts_per_task))
    rate = None
    if max_rate is not None:
        num_partitions, rate = rate_shares(max_rate, num_partitions or 1)
    if num_partitions:
        req = req.repartition(num_partitions, qcol(fields.key))
    schema_in = req.select(*[qcol(c) for c in keep]).schema
    out_schema = T.StructType(list(schema_in.fields) + [
        T.StructField("response", T.StringType()), T.StructField("error", T.StringType()), T.StructField("tries", T.IntegerType())
    ])
    fn = _partition_labeller(make_classifier, prompt, fields.text, "sector_name", on_error, max_tries, base_backoff, concurrency, list(taxonomy.vocabulary), jitter, rate)
    raw = req.mapInArrow(fn, out_schema)
    return parse_labels(raw, taxonomy, keep)


BATCH = "__batch"


def work_table(texts: DataFrame, fields: Fields, texts_per_batch: int, expected: int | None = None) -> list[tuple[DataFrame, int]]:
    """``texts`` written once, partitioned into batches of about ``texts_per_batch`` by a
    hash of the key: (rows, number of rows) of each batch that is not empty. A batch reads
    its own partition only, and the numbers come from the files' footers.

    ``expected`` is how many texts there are at most; if not given, the texts are written
    before they are counted, and once more if they are more than one batch.
    """
    spark = texts.sparkSession
    path = work_path(spark, "label-work")
    if expected is None:
        texts.write.parquet(f"{path}/all")
        texts = spark.read.schema(texts.schema).parquet(f"{path}/all")
        expected = texts.count()
    batches = max(1, -(-expected // texts_per_batch))
    batch = F.pmod(F.xxhash64(qcol(fields.key)), F.lit(batches)).cast("int")
    texts.withColumn(BATCH, batch).hint("rebalance", BATCH).write.partitionBy(BATCH).parquet(f"{path}/batches")
    whole = spark.read.schema(T.StructType([*texts.schema.fields, T.StructField(BATCH, T.IntegerType())])).parquet(f"{path}/batches")
    sizes = sorted((r[BATCH], r["count"]) for r in whole.groupBy(BATCH).count().collect())
    return [(spark.read.schema(texts.schema).parquet(f"{path}/batches/{BATCH}={b}"), n) for b, n in sizes]


def label_batches(
    texts: DataFrame,
    taxonomy: Taxonomy,
    make_classifier: Callable[[], Classifier],
    commit: Callable[[DataFrame], None],
    fields: Fields = DEFAULT,
    texts_per_batch: int = TEXTS_PER_BATCH,
    expected: int | None = None,
    **label_kw,
) -> None:
    """Label ``texts`` in batches of about ``texts_per_batch`` (see ``work_table``) and
    ``commit`` each on its own: what was paid for before a failure stays, and a re-run
    skips it. ``texts`` is evaluated once, however many batches there are. Texts whose
    tries are exhausted come with status ``failed``."""
    for part, n in work_table(texts, fields, texts_per_batch, expected):
        commit(label_texts(part, taxonomy, make_classifier, fields, **{"on_error": "quarantine", "n_texts": n, **label_kw}))


def parse_labels(raw: DataFrame, taxonomy: Taxonomy, keep: Sequence[str], response: str = "response") -> DataFrame:
    """Raw JSON responses → summary, reasoning, multi-hot classes, status."""
    vocab = list(taxonomy.vocabulary)
    p = raw.withColumn("__p", parse_response(qcol(response), vocab))
    extra = [c for c in ("error", "tries") if c in raw.columns]
    return p.select(
        *[qcol(c) for c in keep],
        F.col("__p.summary").alias("summary"),
        F.col("__p.reasoning").alias("reasoning"),
        *multi_hot(F.col("__p.classifications"), F.col("__p.status"), vocab),
        F.col("__p.status").alias("status"),
        *[qcol(c) for c in extra],
    )


def keyword_labels(texts: DataFrame, taxonomy: Taxonomy, keywords: Mapping[str, Sequence[str]], fields: Fields = DEFAULT) -> DataFrame:
    """The keyword rule as a native expression (no Python): same output columns as ``label_texts``."""
    vocab = list(taxonomy.vocabulary)
    classes = keyword_classes(qcol(fields.text), keywords)
    keep = [c for c in (fields.key, fields.text, fields.purpose_code, fields.ordinal) if c in texts.columns]
    return texts.select(
        *[qcol(c) for c in keep],
        F.lit("").alias("summary"),
        F.lit("keyword match").alias("reasoning"),
        *multi_hot(classes, F.lit("ok"), vocab),
        F.lit("ok").alias("status"),
    )


def unprocessed(texts: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of ``texts`` whose key is not in ``done``: one anti-join at every size (AQE
    broadcasts the keys of ``done`` only while they measure small)."""
    return texts.join(done.select(qcol(key)), on=key, how="left_anti")


def sample_by_code(df: DataFrame, code_col: str, codes: Sequence[str], n: int, order: str | Sequence[str]) -> DataFrame:
    """First ``n`` rows (by ``order``) whose trimmed code is in ``codes``; when no row
    matches, the first ``n`` rows of all. A debug/sampling operator: the limit
    is the feature. The emptiness test reads at most one row."""
    orders = [order] if isinstance(order, str) else list(order)
    hits = df.where(F.trim(qcol(code_col).cast("string")).isin(list(codes)))
    base = df if hits.isEmpty() else hits
    return base.orderBy(*[qcol(o) for o in orders]).limit(n)


def budget(
    requests: DataFrame,
    system_prompt: str,
    message: str = "user_message",
    input_rate: float | None = None,
    output_rate: float | None = None,
    max_cost: float | None = None,
    as_json: bool = False,
) -> DataFrame:
    """One row: requests, input tokens (prompt + message per request; ``as_json``: the JSON
    of both, as it is sent), output tokens (assumed equal), estimated cost and whether it
    is within ``max_cost``."""
    from spendlens.functions import text as tx

    ir = tx.INPUT_RATE if input_rate is None else input_rate
    orr = tx.OUTPUT_RATE if output_rate is None else output_rate
    if as_json:
        per_row = token_count(request_payload(system_prompt, qcol(message)))
    else:
        prompt_tokens = token_count(F.lit(system_prompt))  # folded to a constant by the optimizer
        per_row = prompt_tokens + token_count(qcol(message))
    agg = requests.agg(F.count(F.lit(1)).alias("n_requests"), F.coalesce(F.sum(per_row), F.lit(0)).cast("long").alias("input_tokens"))
    agg = agg.withColumn("output_tokens", F.col("input_tokens"))
    agg = agg.withColumn("est_cost", cost(F.col("input_tokens"), ir, orr))
    within = F.lit(True) if max_cost is None else (F.col("est_cost") <= F.lit(float(max_cost)))
    return agg.withColumn("within_budget", within)


class BudgetExceeded(RuntimeError):
    pass


def check_budget(requests: DataFrame, system_prompt: str, max_cost: float, **kw) -> dict:
    """Gate: raise ``BudgetExceeded`` when the estimate is above ``max_cost`` (reads one row)."""
    row = budget(requests, system_prompt, max_cost=max_cost, **kw).first().asDict()
    if not row["within_budget"]:
        raise BudgetExceeded(f"estimated cost {row['est_cost']:.2f} exceeds {max_cost:.2f}")
    return row
