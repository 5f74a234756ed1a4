"""Sharding by proportional stratified interleaving.

Rows of each source are shuffled by a seeded hash and ranked; all rows are then sorted by their fractional rank
(rank + 1/2) / (rows of the source), and the sorted rows are cut into shards whose counts differ by one at most. Every
stretch of the sorted rows holds each source in proportion, so every shard matches the mixture.

No source and no shard is ranked in one task: ranks are counted within hash buckets of a bounded share of the rows, and
only the counts of the buckets meet.

Null sources are a source of their own, null ids and texts are allowed (a null text has no bytes), repeated rows are
separate rows, an empty table gives an empty result; further columns are kept, but for the text and for those with the name of
a result, which the result replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of each ranking: a bucket is ranked in one task, and one task sums up the counts of all buckets.
BUCKETS = 1 << 14


def _crc(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def sharded(docs: DataFrame, shards: int, seed: int = 7, key: str = "doc_id", stratum: str = "source", text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """docs with size, text_crc32, shard and slot (position in the shard)."""
    unit = buckets / float(1 << 32)
    rows = docs.withColumns({
        "size": F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8,
        "text_crc32": _crc(F.col(text)),
        "__q_h": F.xxhash64(F.lit(seed), F.col(key), F.col(text)),
        "__q_g": F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit("")),
    })
    narrow = rows.drop(text)
    # The bucket is a monotone function of the hash; rows of equal hash are ordered by what is known of them.
    narrow = narrow.withColumn("__q_b", F.floor((F.shiftrightunsigned(F.col("__q_h"), 32)) * F.lit(unit)).cast("long"))
    counts = narrow.groupBy("__q_g", "__q_b").agg(F.count("*").alias("__q_n"))
    run = Window.partitionBy("__q_g").orderBy("__q_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumns({"__q_before": F.coalesce(F.sum("__q_n").over(run), F.lit(0)), "__q_of": F.sum("__q_n").over(Window.partitionBy("__q_g"))}).drop("__q_n")
    inside = Window.partitionBy("__q_g", "__q_b").orderBy(F.shiftrightunsigned(F.col("__q_h"), 0), F.col("__q_h"), key, "text_crc32", "size")
    ranked = narrow.withColumn("__q_r", F.row_number().over(inside) - 1).join(starts, ["__q_g", "__q_b"])
    ranked = ranked.withColumn("__q_f", (F.col("__q_before") + F.col("__q_r") + 0.5) / F.col("__q_of"))
    # Second ranking: by the fraction, ties by the name of the source (a source has each fraction once).
    ranked = ranked.withColumn("__q_c", F.floor(F.col("__q_f") * buckets).cast("long"))
    tally = ranked.groupBy("__q_c").agg(F.count("*").alias("__q_m"))
    # The running sum has one row for each bucket, BUCKETS at most.
    tally = tally.withColumns({"__q_start": F.coalesce(F.sum("__q_m").over(Window.orderBy("__q_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "__q_all": F.sum("__q_m").over(Window.partitionBy())}).drop("__q_m")
    placed = ranked.withColumn("__q_q", F.row_number().over(Window.partitionBy("__q_c").orderBy("__q_f", "__q_g")) - 1).join(tally, "__q_c")
    at = F.col("__q_start") + F.col("__q_q")
    # shard k holds the positions from ceil(k n / shards): counts differ by one at most.
    shard = F.expr(f"((__q_start + __q_q) * {shards}) div __q_all")
    first = F.expr(f"(shard * __q_all + {shards} - 1) div {shards}")
    return placed.withColumn("shard", shard.cast("int")).withColumn("slot", (at - first).cast("long")).drop("__q_g", "__q_b", "__q_h", "__q_before", "__q_of", "__q_r", "__q_f", "__q_c", "__q_q", "__q_start", "__q_all")


def query(spark, sf_dir: str) -> DataFrame:
    from quarry.llm.common import documents

    out = sharded(documents(spark, sf_dir).select("doc_id", "source", "text"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")
