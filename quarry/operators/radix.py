"""Radix partitioning as expressions: buckets, histograms, offsets, positions, and placement by bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows numbered in one task by positions(); only their counts meet.
CHUNK = 1 << 16


def bucket(key: Column, bits: int, shift: int = 0) -> Column:
    return F.shiftright(key, shift).bitwiseAND(F.lit((1 << bits) - 1)).cast("long")


def two_levels(df: DataFrame, bits1: int, bits2: int, key: str = "key") -> DataFrame:
    """b1: the low bits, b2: the next ones."""
    return df.withColumns({"b1": bucket(F.col(key), bits1), "b2": bucket(F.col(key), bits2, bits1)})


def histogram(df: DataFrame, bits: int, key: str = "key") -> DataFrame:
    return df.groupBy(bucket(F.col(key), bits).alias("bucket")).agg(F.count("*").alias("n"))


def histogram2(df: DataFrame, bits1: int, bits2: int, key: str = "key") -> DataFrame:
    return two_levels(df, bits1, bits2, key).groupBy("b1", "b2").agg(F.count("*").alias("n"))


def offsets(hist: DataFrame, order: tuple[str, ...] = ("bucket",)) -> DataFrame:
    """Exclusive prefix sum over a histogram, which has 2^bits rows at most."""
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return hist.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long"))


def task_offsets(df: DataFrame, bits: int, key: str, rid: str, chunk: int = CHUNK) -> DataFrame:
    """(bucket, chunk, n, start): where the rows of a chunk of rids start in the partitioned relation, by bucket.

    One task sums up by bucket, the buckets' own starts come from their 2^bits totals.
    """
    hist = df.groupBy(bucket(F.col(key), bits).alias("bucket"), F.floor(F.col(rid) / chunk).cast("long").alias("chunk")).agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("bucket").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    starts = offsets(hist.groupBy("bucket").agg(F.sum("n").alias("n"))).select("bucket", F.col("start").alias("_first"))
    out = hist.withColumn("_in", F.coalesce(earlier, F.lit(0))).join(F.broadcast(starts), "bucket")  # 2^bits rows
    return out.select("bucket", "chunk", "n", (F.col("_first") + F.col("_in")).cast("long").alias("start"))


def positions(df: DataFrame, bits: int, key: str, rid: str, chunk: int = CHUNK) -> DataFrame:
    """The place of every row in the partitioned relation, stable in rid within a bucket.

    As parallel partitioning does: a histogram for each (bucket, chunk of rids), prefix sums over them, and numbers
    within each.
    """
    rows = df.withColumns({"bucket": bucket(F.col(key), bits), "chunk": F.floor(F.col(rid) / chunk).cast("long")})
    local = F.row_number().over(Window.partitionBy("bucket", "chunk").orderBy(rid)) - 1
    out = rows.withColumn("_local", local).join(task_offsets(df, bits, key, rid, chunk), ["bucket", "chunk"])
    return out.select(rid, "bucket", (F.col("start") + F.col("_local")).cast("long").alias("pos"))


def placed(df: DataFrame, bits: int, key: str = "key") -> DataFrame:
    """df with every row in the partition whose number is its bucket."""
    return df.withColumn("bucket", bucket(F.col(key), bits).cast("int")).repartitionById(1 << bits, "bucket")


def misplaced(df: DataFrame, bits: int, key: str = "key") -> DataFrame:
    """By bucket: its rows, and those that are not in its partition."""
    there = placed(df, bits, key).select(F.col("bucket").cast("long").alias("bucket"), F.spark_partition_id().alias("_at"))
    return there.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if(F.col("_at") != F.col("bucket")).alias("astray"))
