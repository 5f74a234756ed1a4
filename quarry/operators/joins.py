"""Match counts of an equi-join.

The reference count is that of a left semi join: each probe row counts once if its key occurs on the build side. The
inner-join count is a query of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import radix

#: Bytes up to which a build side may be broadcast.
BROADCAST_BYTES = 64 << 20


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size of df (from the files' sizes, the columns read and the statistics)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def keys_of(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key).alias("key")).filter(F.col("key").isNotNull())


def semi_count(r: DataFrame, s: DataFrame, strategy: str = "aggregated", bits: tuple[int, ...] = (4,), broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Rows of s (column key) whose key occurs in r (column key), as one row `n`.

    aggregated: s is counted by key before the exchange, so a hot key moves one row for each task; r's keys are made
    distinct in the same exchange. broadcast: r's distinct keys go to every task if their estimated size allows it, else
    as aggregated. radix: one exchange on the key's radix partition of 2^bits, or two levels. merge: sorted on both sides.
    """
    if strategy == "broadcast" and estimated_bytes(r) <= broadcast_bytes:
        return s.join(F.broadcast(r.distinct()), "key", "left_semi").agg(F.count("*").alias("n"))
    if strategy == "merge":
        return s.join(r.hint("merge"), "key", "left_semi").agg(F.count("*").alias("n"))
    if strategy == "radix":
        if len(bits) == 1:
            parts = 1 << bits[0]
            left, right = s.repartition(parts, "key"), r.repartition(parts, "key")
            return left.join(right.hint("shuffle_hash"), "key", "left_semi").agg(F.count("*").alias("n"))
        left, right = radix.two_levels(s, *bits), radix.two_levels(r, *bits)
        on = ["b1", "b2", "key"]
        parts = 1 << sum(bits)
        return left.repartition(parts, *on).join(right.repartition(parts, *on).hint("shuffle_hash"), on, "left_semi").agg(F.count("*").alias("n"))
    counted = s.groupBy("key").agg(F.count("*").alias("c"))
    return counted.join(r.distinct(), "key", "left_semi").agg(F.coalesce(F.sum("c"), F.lit(0)).cast("long").alias("n"))


def inner_count(r: DataFrame, s: DataFrame) -> DataFrame:
    """Pairs of rows with equal keys: products of the counts by key, so no pair is ever made."""
    a, b = (x.groupBy("key").agg(F.count("*").alias(n)) for x, n in ((r, "a"), (s, "b")))
    return a.join(b, "key").agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).cast("long").alias("n"))


def key_intersection(r: DataFrame, s: DataFrame) -> DataFrame:
    """Distinct keys on both sides."""
    return r.select("key").intersect(s.select("key"))
