"""Quality rules in DataFrame functions only: base counts of every whole text, and the
log-likelihood ratio of its hashed n-grams between trusted texts and the whole corpus.

Words and pairs of neighbouring words are hashed into ``buckets`` counts. The ratio of
a text is the mean over its n-grams of ln(p_trusted / p_corpus), so long and short texts
compare; every text is kept or dropped by one threshold, with nothing random in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens._compat import qcol
from spendlens.llm.common import WHITE, WORD_BREAK, staged

BUCKETS = 1 << 16  # a power of two
# Mean ln ratio from which a text is kept: a little under 0 (as likely among trusted texts as
# in the corpus), since clean texts with rare words lie just below it and junk far below.
THRESHOLD = -0.15
# Counts that each bucket gets beforehand, on both sides in the proportion of the totals.
PRIOR = 20.0
WINDOW = 5
SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    """Words (runs without white space) in order; none for a blank text."""
    body = F.btrim(text, F.lit(WHITE))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, WORD_BREAK))


def _indexes(n: Column) -> Column:
    """0 .. n-1; empty where n is not positive."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _chars(text: Column) -> Column:
    return F.char_length(text).cast("bigint")


def _with_words(df: DataFrame, text_col: str) -> DataFrame:
    text = F.coalesce(qcol(text_col), F.lit(""))
    words = df.withColumn("_text", text).withColumn("_words", words_of(F.col("_text"))).withColumn("_n", F.size("_words"))
    return words.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))  # once for all that follows


def _one(word_hash: Column, buckets: int) -> Column:
    return word_hash.bitwiseAND(F.lit(buckets - 1)).cast("int")


def _two(a: Column, b: Column, buckets: int) -> Column:
    return F.xxhash64(a, b).bitwiseAND(F.lit(buckets - 1)).cast("int")


def base_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    A null or blank text has all counts 0 (symbols of a blank text: 0 too) and fails.
    Equal 5-word windows are found by 64-bit hashes of their words' hashes; texts of any
    length are taken whole, in one row, without a shuffle.
    """
    d = _with_words(df, text_col)
    at = lambda i: F.get(F.col("_hashes"), i)
    d = d.withColumn("_win", F.transform(_indexes(F.col("_n") - (WINDOW - 1)), lambda i: F.xxhash64(*[at(i + k) for k in range(WINDOW)])))
    repeated = F.size(F.array_distinct("_win")) < F.size("_win")
    # windows in the order of their hashes, so that equal ones are neighbours
    d = d.withColumn("_sorted", F.when(repeated, F.sort_array(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda k, x: F.coalesce(F.get(F.col("_sorted"), k)["h"] == x["h"], F.lit(False))
    d = d.withColumn("_places", F.sort_array(F.filter(F.transform("_sorted", lambda x, k: F.when(same(k - 1, x) | same(k + 1, x), x["i"])), lambda p: p.isNotNull())))
    covered = F.aggregate(
        "_places",
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    # a line counts if it has a word
    d = d.withColumn("_lines", F.filter(F.split(F.col("_text"), "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != ""))
    return (
        d.withColumn("n_words", F.col("_n").cast("bigint"))
        .withColumn("word_chars", _chars(F.translate("_text", WHITE, "")))
        .withColumn("n_symbols", _chars(F.col("_text")) - _chars(F.regexp_replace("_text", f"[{SYMBOLS}]+", "")))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"))
        .withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("bigint"))
        .withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
        .drop("_text", "_win", "_sorted", "_places", "_lines")
    )


def gram_counts(df: DataFrame, trusted_flag: str, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(gram, corpus, trusted) counts over all rows: at most ``buckets`` rows, summed in
    each task before the shuffle."""
    d = _with_words(df, text_col)
    word = F.col("_words")
    singles = F.transform("_hashes", lambda h: _one(h, buckets))
    pairs = F.transform(_indexes(F.col("_n") - 1), lambda i: _two(F.get(word, i), F.get(word, i + 1), buckets))
    grams = d.select(F.col(trusted_flag).cast("int").alias("_t"), F.explode(F.concat(singles, pairs)).alias("gram"))
    return grams.groupBy("gram").agg(F.count("*").alias("corpus"), F.sum("_t").alias("trusted"))


def gram_ratios(counts: DataFrame, buckets: int = BUCKETS, prior: float = PRIOR) -> DataFrame:
    """One row: ``ratio``, ln(p_trusted / p_corpus) of each bucket. Both sides get ``prior``
    counts in the proportion of the totals, so a bucket seen a few times says little: a
    clean text is not dropped because its words are rare. Without trusted or corpus
    counts all ratios are 0."""
    every = counts.sparkSession.range(buckets).select(F.col("id").cast("int").alias("gram"), F.lit(0).cast("bigint").alias("corpus"), F.lit(0).cast("bigint").alias("trusted"))
    full = counts.select("gram", "corpus", "trusted").union(every).groupBy("gram").agg(F.sum("corpus").alias("corpus"), F.sum("trusted").alias("trusted"))
    cells = full.agg(F.array_sort(F.collect_list(F.struct("gram", "corpus", "trusted"))).alias("cells"), F.sum("corpus").alias("c"), F.sum("trusted").alias("t"))
    share = F.col("t") / F.col("c")
    return cells.select(F.transform("cells", lambda x: F.when(F.col("t") == 0, F.lit(0.0)).otherwise(F.log((x["trusted"] + prior * share) / (share * (x["corpus"] + prior))))).alias("ratio"))


def mean_ratio(df: DataFrame, ratios: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``df`` (with _words, _hashes and _n) with ``llr``: the mean ln ratio of the text's n-grams,
    0 for a text without words. ``ratios`` is one row of ``buckets`` numbers, put in as a
    constant array."""
    known = ratios.select(F.to_json(F.transform("ratio", lambda r: F.round(r, 5)))).first()[0]
    word, ratio = F.col("_words"), F.from_json(F.lit(known), "array<double>")
    singles = F.aggregate("_hashes", F.lit(0.0), lambda a, h: a + F.get(ratio, _one(h, buckets)))
    pairs = F.aggregate(_indexes(F.col("_n") - 1), F.lit(0.0), lambda a, i: a + F.get(ratio, _two(F.get(word, i), F.get(word, i + 1), buckets)))
    total = singles + pairs
    return df.withColumn("llr", F.when(F.col("_n") == 0, 0.0).otherwise(total / (2 * F.col("_n") - 1)))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """The trusted set: the different ids of all documents labelled good."""
    return labels.filter(F.col("quality") == 1).select(F.col("doc_id").cast("bigint").alias("_id")).filter("_id is not null").distinct()


def flag_trusted(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """text and _trusted of every row. The join is by id and moves the texts once, at every
    size alike; rows without id are dealt by a salt that no trusted id has, so that they
    do not meet in one task."""
    own = qcol(id_col).cast("bigint")
    rows = df.select(own.alias("_id0"), qcol(text_col).alias("text"))
    rows = rows.withColumn("_salt", F.when(F.col("_id0").isNull(), F.pmod(F.xxhash64("text"), F.lit(1 << 20))).otherwise(F.lit(-1).cast("bigint")))
    rows = rows.withColumn("_id0", F.coalesce("_id0", "_salt"))
    ids = trusted_ids(labels).withColumn("_good", F.lit(-1).cast("bigint"))
    return rows.join(ids.hint("shuffle_hash"), (F.col("_id0") == F.col("_id")) & (F.col("_salt") == F.col("_good")), "left").select("text", F.col("_id").isNotNull().alias("_trusted"))


def judge(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, carry: list[str] | None = None) -> DataFrame:
    """``df`` (its columns ``carry``; all by default) with the base counts, ``llr`` and
    ``kept``, as a written table: a filter on the verdict that Spark pushed down into the
    counts would work each of them out again for every word.

    The n-gram counts cover all rows of ``df`` and, as trusted, all labelled good; nulls count as empty texts. Repeated rows
    are judged alike. Without trusted documents every ratio is 0 and only the base rules
    decide. Columns of the input named like the results are replaced.
    """
    ratios = gram_ratios(staged(gram_counts(flag_trusted(df, labels, id_col, text_col), "_trusted"), "quality-grams"))
    own = {"_words", "_hashes", "_n", "llr", "kept", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"}
    scored = mean_ratio(base_counts(df.select(*[qcol(c) for c in df.columns if c not in own]), text_col), ratios)
    scored = scored.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
    own -= {"_words", "_hashes", "_n"}
    return staged(scored.select(*[qcol(c) for c in (df.columns if carry is None else carry) if c not in own], *sorted(own)), "quality-verdicts")


def op2_quality_rules(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Base counts and verdict of every document."""
    return judge(documents.select("doc_id", "text"), labels, carry=["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")
