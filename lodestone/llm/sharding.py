"""Proportional stratified interleaving of documents into shards, with DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import checkpointed

#: Rows that one bucket of a rank computation holds on average, at most.
ROWS_PER_BUCKET = 32_768
#: Bits of the shuffling hash.
HASH_BITS = 60


def shuffled(key: Column, seed: int) -> Column:
    """A seeded hash of the key in [0, 2**60); plain SQL engines can compute it too."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def assign_shards(docs: DataFrame, shards: int = 8, seed: int = 42, stratum: str = "source") -> DataFrame:
    """One row for each row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Rows are shuffled by seed within their stratum and get the fractional rank (r + 1/2) / n there. In the order of
    fractional ranks every stretch holds each stratum in the mixture's proportion; cut into equal stretches, every shard
    does. The law is `rows`: the shards' counts are at most one apart, and slots run from 0 without gaps.

    No rank needs a whole stratum, or the whole table, in one task: rows are counted by (stratum, hash bucket) first, and a
    row's rank is its bucket's running total plus its place in the bucket; the same again for the interleaved order. The
    buckets follow the number of rows. Null strata form a stratum of their own, a null text has size 1 and CRC 0, equal
    rows take adjacent places, an empty table gives an empty one. Groups of equal texts are no strata: the law balances
    rows, and a group kept whole could outgrow a shard, so rows of one text may lie in different shards.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.octet_length(text).cast("long") + 1
    named = docs.select(F.col("doc_id"), size.alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.col(f"`{stratum}`").cast("string").alias("stratum"))
    # all of a row: those that share or lack a doc_id don't fall into one bucket
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("text_crc32"), F.col("size"))
    rows = checkpointed(named.withColumn("h", shuffled(key, seed)))
    bits = max(8, math.ceil(math.log2(max(rows.count(), 1) / ROWS_PER_BUCKET)))
    order = ["h", "doc_id", "text_crc32", "size"]

    rows = rows.withColumn("bucket", F.shiftright("h", HASH_BITS - bits))
    counts = rows.groupBy("stratum", "bucket").agg(F.count("*").alias("n"))
    by_stratum = Window.partitionBy("stratum")
    running = F.coalesce(F.sum("n").over(by_stratum.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = counts.select(F.col("stratum").alias("s"), F.col("bucket").alias("b"), running.alias("before"), F.sum("n").over(by_stratum).alias("of"))
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy("stratum", "bucket").orderBy(*order)))
    rank = F.col("before") + F.col("place") - 1
    ranked = checkpointed(
        placed.join(totals, F.col("stratum").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
        .select("doc_id", "size", "text_crc32", "stratum", "h", ((2 * rank + 1).cast("double") / (2 * F.col("of")).cast("double")).alias("fraction"))
        .withColumn("bucket", F.floor(F.col("fraction") * (1 << bits)))
    )

    stretches = ranked.groupBy("bucket").agg(F.count("*").alias("n"))
    everything = Window.orderBy("bucket")  # one row for each bucket
    before = F.coalesce(F.sum("n").over(everything.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = F.sum("n").over(everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    starts = stretches.select(F.col("bucket").alias("b"), before.alias("before"), whole.alias("total"))
    placed = ranked.withColumn("place", F.row_number().over(Window.partitionBy("bucket").orderBy("fraction", "stratum", *order)))
    at = F.col("before") + F.col("place") - 1
    shard = F.expr(f"(before + place - 1) * {shards} div total")
    first = F.expr(f"((before + place - 1) * {shards} div total * total + {shards - 1}) div {shards}")
    return placed.join(starts, placed.bucket == starts.b).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.cast("int").alias("shard"), (at - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("stratum").alias("source")
    )
