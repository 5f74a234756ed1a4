"""An ordered set of integer keys under lookups, insertions and removals.

All locking protocols of the reference give the result of one thread that works through the operations in order; that
order is the definition here. A key's state before an operation is what the last insertion or removal of the key before
it left, which needs no loop: it is found within blocks of the log, and between blocks from one row for each block and
key, so that neither a hot key nor a long log ends in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Operations in a block.
BLOCK = 1 << 16


def contains_count(initial: DataFrame, probes: DataFrame) -> DataFrame:
    """Probes (column key) that are in the set (column key); probes are counted by key before they move."""
    counted = probes.groupBy("key").agg(F.count("*").alias("c"))
    return counted.join(initial.select("key").distinct(), "key", "left_semi").agg(F.coalesce(F.sum("c"), F.lit(0)).cast("long").alias("n"))


def insert(initial: DataFrame, keys: DataFrame) -> DataFrame:
    return initial.select("key").unionByName(keys.select("key")).distinct()


def remove(initial: DataFrame, keys: DataFrame) -> DataFrame:
    return initial.select("key").distinct().join(keys.select("key").distinct(), "key", "left_anti")


def ordered(keys: DataFrame) -> DataFrame:
    return keys.select("key").distinct().orderBy("key")


def replay(log: DataFrame, initial: Column, block: int = BLOCK) -> DataFrame:
    """log (i, key, op) with `present` (in the set just before) and `result` (what the operation returns).

    initial: whether the set starts with the key. contains returns presence; insert and remove return whether they
    changed the set.
    """
    left = F.when(F.col("op") == "insert", True).when(F.col("op") == "remove", False)
    rows = log.withColumns({"_block": F.floor(F.col("i") / block).cast("long"), "_left": left})
    lasts = rows.filter(F.col("_left").isNotNull()).groupBy("key", "_block").agg(F.max_by("_left", "i").alias("_last"))
    blocks = rows.select("key", "_block").distinct().join(lasts, ["key", "_block"], "left")
    earlier = Window.partitionBy("key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("key", "_block", F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
    inside = Window.partitionBy("key", "_block").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    seen = rows.withColumn("_seen", F.last("_left", ignorenulls=True).over(inside)).join(carried, ["key", "_block"])
    present = F.coalesce(F.col("_seen"), F.col("_carried"), initial)
    result = F.when(F.col("op") == "contains", F.col("present")).when(F.col("op") == "insert", ~F.col("present")).otherwise(F.col("present"))
    return seen.withColumn("present", present).withColumn("result", result).select("i", "key", "op", "present", "result")


def final_state(log: DataFrame, initial_keys: DataFrame) -> DataFrame:
    """Keys in the set after the whole log."""
    changes = log.filter(F.col("op").isin("insert", "remove")).groupBy("key").agg((F.max_by("op", "i") == "insert").alias("_in"))
    both = initial_keys.select("key").distinct().withColumn("_start", F.lit(True)).join(changes, "key", "full_outer")
    return both.filter(F.coalesce("_in", "_start")).select("key")
