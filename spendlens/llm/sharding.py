"""Minimax contiguous sharding, in DataFrame and SQL functions only.

Rows of equal text stay together. The ordered atomic groups are hash buckets of the
text (equal texts share one), a bounded number however many rows there are, so that
the search for the smallest shard capacity works on one bounded array.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendlens._compat import qcol
from spendlens.llm.common import staged

# Atomic groups: enough that one is a small part of a shard.
BUCKETS = 1 << 14
# Parts that the rows of a shard are numbered in, side by side.
PARTS = 256


def size_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row a document: doc_id, size (UTF-8 bytes, null none, plus 1),
    text_crc32 (unsigned; null text: 0, as of no bytes) and its bucket. A null text is
    a text of its own, apart from the empty one."""
    text = qcol(text_col)
    return df.select(
        qcol(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1).alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0).cast("bigint")).alias("text_crc32"),
        F.pmod(F.xxhash64(text, text.isNull()), F.lit(BUCKETS)).cast("int").alias("bucket"),
    )


def cut_buckets(sized: DataFrame, shards: int) -> DataFrame:
    """(bucket, shard) for the buckets in use: at most ``BUCKETS`` rows.

    A bucket that holds an even share of what is left or more (fewer than ``shards`` of
    them exist) is a shard of its own. The others, in bucket order, are cut into as many
    contiguous runs as shards are left: binary search finds the smallest capacity for
    which filling shard after shard needs no more of them, and the cuts are made there.
    """
    totals = sized.groupBy("bucket").agg(F.sum("size").alias("bytes"))
    one = totals.agg(F.array_sort(F.collect_list(F.struct("bucket", "bytes"))).alias("cells"))
    # largest first; (alone, rest, open) after each of the first ``shards``
    one = one.selectExpr(
        "cells",
        f"""aggregate(
              slice(reverse(array_sort(transform(cells, c -> struct(c.bytes, c.bucket)))), 1, {shards}),
              named_struct('alone', cast(array() as array<int>),
                           'rest', aggregate(cells, 0L, (t, c) -> t + c.bytes), 'open', true),
              (a, c) -> if(a.open and size(a.alone) < {shards - 1} and c.bytes * ({shards} - size(a.alone)) >= a.rest,
                           named_struct('alone', array_append(a.alone, c.bucket), 'rest', a.rest - c.bytes, 'open', true),
                           named_struct('alone', a.alone, 'rest', a.rest, 'open', false))) as top""",
    )
    # the written one-row tables keep each step from being worked out again inside the next
    one = staged(one, "shard-top").selectExpr(
        "top.alone as alone",
        "filter(cells, c -> not array_contains(top.alone, c.bucket)) as cells",
        f"{shards} - size(top.alone) as runs",
        "top.rest as rest",
    )
    one = staged(one, "shard-rest").selectExpr(
        "*",
        "transform(cells, c -> c.bytes) as sizes",
        "ceil(rest / runs) as even",
        "coalesce(array_max(transform(cells, c -> c.bytes)), 0L) as most",
    )
    one = staged(one, "shard-bounds")
    needed = "aggregate(sizes, named_struct('n', 1, 'fill', 0L), (b, s) -> if(b.fill + s <= {c}, named_struct('n', b.n, 'fill', b.fill + s), named_struct('n', b.n + 1, 'fill', s)), b -> b.n)"
    middle = "(r.low + (r.high - r.low) div 2)"
    one = one.selectExpr(
        "*",
        f"""aggregate(
              sequence(0, cast(ceil(log2(most + 2)) as int) + 1),
              named_struct('low', cast(greatest(even, most) as bigint), 'high', cast(even + most as bigint)),
              (r, i) -> if(r.low >= r.high, r,
                           if({needed.format(c=middle)} <= runs,
                              named_struct('low', r.low, 'high', {middle}),
                              named_struct('low', {middle} + 1L, 'high', r.high))),
              r -> r.high) as capacity""",
    )
    one = staged(one, "shard-capacity").selectExpr(
        "*",
        """aggregate(sizes, named_struct('at', 0, 'fill', 0L, 'cuts', cast(array() as array<int>)),
              (b, s) -> if(b.fill + s <= capacity,
                           named_struct('at', b.at + 1, 'fill', b.fill + s, 'cuts', b.cuts),
                           named_struct('at', b.at + 1, 'fill', s, 'cuts', array_append(b.cuts, b.at))),
              b -> b.cuts) as cuts""",
    )
    one = staged(one, "shard-cuts")
    runs = one.selectExpr("alone", "cuts", "posexplode(cells) as (at, cell)").selectExpr("cell.bucket as bucket", "size(alone) + size(filter(cuts, k -> k <= at)) as shard")
    return runs.union(one.selectExpr("posexplode(alone) as (shard, bucket)").select("bucket", "shard"))


def assign(sized: DataFrame, shards: int) -> DataFrame:
    """``sized`` (doc_id, size, text_crc32, bucket) with shard and slot.

    Slots count from 0 without gaps in each shard. Rows are numbered in parts dealt by
    document, so that a group of copies, however large, is many window groups; the
    parts' offsets are at most ``shards * PARTS`` rows. Repeated rows have slots of
    their own; an empty table has no shards in use.
    """
    # both small tables have a proven bound: BUCKETS and shards * PARTS rows
    placed = sized.join(F.broadcast(cut_buckets(sized, shards)), "bucket").drop("bucket")
    placed = staged(placed.withColumn("part", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(PARTS)).cast("int")), "shard-rows")
    ahead = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "part").agg(F.count("*").alias("n")).select("shard", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    own = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    return placed.withColumn("at", F.row_number().over(own) - 1).join(F.broadcast(offsets), ["shard", "part"]).withColumn("slot", F.col("at") + F.col("ahead")).drop("part", "at", "ahead")


def op1_sharding(documents: DataFrame, shards: int = 8) -> DataFrame:
    """Every document's shard under the law of near-equal bytes."""
    out = assign(staged(size_rows(documents), "shard-sizes"), shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
