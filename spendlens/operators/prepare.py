"""Text preparation: one text per activity, first-wins dedup by content, blank removal, funnel.

Dedup is keyed by ``sha2(text)``. ``keep_first`` (J1/J2 in general form) is
``row_number() = 1``, planned as a partial ``WindowGroupLimit`` before the
exchange; ``prepare_texts`` adds how many activities carry each text, counted
over the keys alone. Both reduce a text repeated in millions of rows to one row
per map task before anything is shuffled. The limit sorts its rows, so texts are
first reduced in a hash table (``_least_of_equal``): repeats are never sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens._compat import ColumnOrName, as_col, qcol
from spendlens.fields import DEFAULT, Fields
from spendlens.functions.text import INPUT_RATE, OUTPUT_RATE, TOKENS_PER_PRICE_UNIT, activity_text, is_blank, text_key, token_count


def keep_first(df: DataFrame, key: str | Sequence[str], order: ColumnOrName | Sequence[ColumnOrName]) -> DataFrame:
    """One row per key: the first by ``order`` (deterministic survivor, unlike dropDuplicates)."""
    keys = [key] if isinstance(key, str) else list(key)
    orders = [order] if isinstance(order, (str,)) or not isinstance(order, Sequence) else list(order)
    w = Window.partitionBy(*[qcol(k) for k in keys]).orderBy(*[as_col(o).asc_nulls_last() for o in orders])
    rn = "__rn"
    return df.withColumn(rn, F.row_number().over(w)).where(F.col(rn) == 1).drop(rn)


# Types that a hash aggregation keeps in place; an aggregate of others sorts its input.
_IN_PLACE = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _least_of_equal(df: DataFrame, order: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """``df`` with one row, the least by the last order column, for rows that are equal in
    all others: none that ``keep_first`` would choose goes. The texts are grouping keys of a
    hash aggregation, so a map task holds each of its texts once, however often repeated."""
    last = order[-1]
    if last in payload or last in order[:-1] or not isinstance(df.schema[last].dataType, _IN_PLACE):
        return df
    least = df.groupBy(*[qcol(c) for c in df.columns if c != last]).agg(F.min(qcol(last)).alias(last))
    return least.select(*[qcol(c) for c in df.columns])


def drop_blank(df: DataFrame, text: str) -> DataFrame:
    """Keep rows whose text is non-empty after a Unicode strip."""
    return df.where(~is_blank(qcol(text)))


def _built_text(df: DataFrame, fields: Fields) -> Column:
    """Title and descriptions composed; a missing column counts as all-NULL."""
    parts = [qcol(p) if p in df.columns else F.lit(None).cast("string") for p in (fields.title, fields.short_description, fields.long_description)]
    return activity_text(*parts)


def _text(df: DataFrame, fields: Fields) -> Column:
    """The text column if there is one, else the composed text. In a row whose text is NULL
    the text is composed again, so an empty column counts as none."""
    if fields.text not in df.columns:
        return _built_text(df, fields)
    if not {fields.title, fields.short_description, fields.long_description} & set(df.columns):
        return qcol(fields.text)
    return F.coalesce(qcol(fields.text), _built_text(df, fields))


def with_text_key(df: DataFrame, fields: Fields = DEFAULT) -> DataFrame:
    """Add the content key of the activity text (unless there); the text itself is not added."""
    return df if fields.key in df.columns else df.withColumn(fields.key, text_key(_text(df, fields)))


def ensure_text_key(df: DataFrame, fields: Fields = DEFAULT) -> DataFrame:
    """``df`` with the activity text and its key. A key that is there is kept and not
    worked out again, so a plan that reads only the key need not read the texts."""
    return with_text_key(df, fields).withColumn(fields.text, _text(df, fields))


def with_activity_text(df: DataFrame, fields: Fields = DEFAULT) -> DataFrame:
    """Add ``text`` (title/short/long composition) and its content key, over what the
    columns of these names hold.

    A missing description column counts as all-NULL instead of failing.
    """
    return ensure_text_key(df.drop(fields.text, fields.key), fields)


# A text kept aside is named by its key and a second, short hash: rows whose key came with
# them, and does not tell all texts apart, still get their own text back.
TEXT_HASH = "text_hash"


def text_hash(text: Column) -> Column:
    return F.when(text.isNotNull(), F.xxhash64(text))


def with_texts(df: DataFrame, texts: DataFrame | None, fields: Fields = DEFAULT) -> DataFrame:
    """``df`` with the texts that were kept aside (``texts``: key, ``TEXT_HASH``, text; each
    pair once). Rows that carry their text themselves keep it."""
    if texts is None or TEXT_HASH not in df.columns:
        return df
    t = texts.select(qcol(fields.key).alias("__key"), F.col(TEXT_HASH).alias("__hash"), qcol(fields.text).alias("__text"))
    found = df.join(t, qcol(fields.key).eqNullSafe(F.col("__key")) & (F.col(TEXT_HASH) == F.col("__hash")), "left")
    text = F.coalesce(qcol(fields.text), F.col("__text")) if fields.text in df.columns else F.col("__text")
    return found.withColumn(fields.text, text).drop("__key", "__hash", "__text", TEXT_HASH)


N_ACTIVITIES = "n_activities"


def prepare_texts(
    df: DataFrame,
    fields: Fields = DEFAULT,
    order: Sequence[str] | None = None,
    observation: "PrepareObservation | None" = None,
    texts: DataFrame | None = None,
) -> DataFrame:
    """Unique, non-blank texts with the purpose code of their first activity and the
    number of activities carrying the text (``n_activities``).

    Output columns: key, text, purpose code, ordinal column(s), n_activities.
    ``order`` defaults to (year, ordinal), i.e. collated file order. The first
    row comes from ``keep_first`` over the least rows of equal texts, the count from
    an aggregation of keys alone; both are limited or summed in the map tasks, so a
    text repeated in a large share of rows leaves each of them as one row, and both
    are dealt by key, so joining them moves nothing again. The counts give the key histogram that
    ``hot_keys`` reads to split skewed keys in the label join.
    Pass a ``PrepareObservation`` to collect the funnel during the write. With ``texts``
    (see ``with_texts``) ``df`` names its texts, and only those of first rows are fetched.
    """
    src = df
    if fields.purpose_code not in src.columns:
        src = src.withColumn(fields.purpose_code, F.lit(None).cast("string"))
    aside = texts is not None and TEXT_HASH in src.columns
    src = src if aside else ensure_text_key(src, fields)
    order = list(order) if order is not None else [c for c in (fields.year, fields.ordinal) if c in src.columns]
    if not order:
        raise ValueError("first-wins dedup needs an ordinal column (see sources.ingest.add_ordinal)")
    text = [c for c in (fields.text, TEXT_HASH) if c in src.columns] if aside else [fields.text]
    rest = [fields.purpose_code] + [c for c in order if c not in (fields.key, *text, fields.purpose_code)]
    payload = [*text, *rest]
    src = src.select(qcol(fields.key), *[qcol(c) for c in payload])
    counts = src.groupBy(qcol(fields.key)).agg(F.count(F.lit(1)).alias(N_ACTIVITIES))
    few = src if aside else _least_of_equal(src, order, (fields.key, fields.text, fields.purpose_code))
    unique = keep_first(few, fields.key, order).join(counts, on=fields.key)  # both dealt by key already
    if aside:
        unique = with_texts(unique, texts, fields).select(*[qcol(c) for c in (fields.key, fields.text, *rest, N_ACTIVITIES)])
    if observation is not None:
        # observed behind the shuffle, in the stage that writes: no task counts twice
        metrics = [F.coalesce(F.sum(N_ACTIVITIES), F.lit(0)).alias("n_start"), F.count(F.lit(1)).alias("n_unique"), F.count_if(is_blank(qcol(fields.text))).alias("n_blank")]
        if observation.with_tokens:
            # blank texts have no tokens, so the sum equals that of the kept texts
            metrics.append(F.coalesce(F.sum(token_count(qcol(fields.text))), F.lit(0)).alias("n_tokens"))
        unique = unique.observe(observation.unique, *metrics)
    return drop_blank(unique, fields.text)


# Rows of one key that one join task may receive.
ROWS_PER_TASK = 1_000_000


def hot_keys(prepared: DataFrame, fields: Fields = DEFAULT, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Text keys that more than ``rows_per_task`` activities carry, and into how many
    parts (``buckets``) their rows have to be dealt so that none is larger.

    At most (all activities / ``rows_per_task``) keys, small enough to broadcast. Reads
    only the prepared table (one row per text).
    """
    n = F.col(N_ACTIVITIES)
    return prepared.where(n > rows_per_task).select(qcol(fields.key), F.ceil(n / F.lit(rows_per_task)).cast("int").alias("buckets"))


class PrepareObservation:
    """Funnel counts (and, with ``with_tokens``, the token proxy total and its
    estimated price) gathered by ``Observation`` while the prepared texts are
    written: no extra pass over the data."""

    def __init__(self, name: str = "prepare", with_tokens: bool = False):
        self.unique = Observation(f"{name}_unique")
        self.with_tokens = with_tokens

    def get(self) -> dict:
        u = self.unique.get
        n_start, n_unique, n_blank = u["n_start"], u["n_unique"], u["n_blank"]
        out = {
            "n_start": n_start,
            "n_duplicates": n_start - n_unique,
            "n_blank": n_blank,
            "n_end": n_unique - n_blank,
        }
        if self.with_tokens:
            n = u["n_tokens"]
            out.update(input_tokens=n, output_tokens=n, est_cost=n / TOKENS_PER_PRICE_UNIT * INPUT_RATE + n / TOKENS_PER_PRICE_UNIT * OUTPUT_RATE)
        return out


def text_funnel(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row: rows in, removed as duplicates, removed as blank (after dedup), rows out.

    Two aggregations: per key (partial aggregation collapses repeats map-side),
    then a global one over the keys.
    """
    per_key = df.groupBy(qcol(key)).agg(
        F.count(F.lit(1)).alias("n"),
        F.max(is_blank(qcol(text)).cast("int")).alias("blank"),
    )
    return per_key.agg(
        F.sum("n").cast("long").alias("n_start"),
        (F.sum("n") - F.count(F.lit(1))).cast("long").alias("n_duplicates"),
        F.coalesce(F.sum("blank"), F.lit(0)).cast("long").alias("n_blank"),
        (F.count(F.lit(1)) - F.coalesce(F.sum("blank"), F.lit(0))).cast("long").alias("n_end"),
    )
