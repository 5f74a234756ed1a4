"""Access patterns: permutations of 0..n-1 that form one cycle, and their traversal.

Strided and reverse cycles have a closed form, so each row knows its successor without an exchange. The random cycle
follows the order of a digest of the ids. Traversal composes the permutation with itself: about 2 log2(n) joins instead
of n steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.sources.kept import written


def _sized(ids: DataFrame) -> DataFrame:
    """ids with their number n, a scalar subquery."""
    return ids.withColumn("n", ids.select(F.count("*")).scalar())


def strided(ids: DataFrame, stride: int) -> DataFrame:
    """Visits o, o + s, o + 2 s, ... for each offset o below the stride, then starts again."""
    step = F.col("id") + stride
    offset = F.col("id") % stride + 1
    wrap = F.when(offset < F.least(F.lit(stride).cast("long"), F.col("n")), offset).otherwise(F.lit(0))
    return _sized(ids).select("id", F.when(step < F.col("n"), step).otherwise(wrap).cast("long").alias("next"))


def strided_back(ids: DataFrame, stride: int) -> DataFrame:
    """The same from the last element downwards."""
    back = _sized(ids).withColumn("id", F.col("n") - 1 - F.col("id")).select("id")
    last = F.col("n") - 1
    return _sized(strided(back, stride)).select((last - F.col("id")).cast("long").alias("id"), (last - F.col("next")).cast("long").alias("next"))


def shuffled(ids: DataFrame, seed: str = "42", prefix: int = 3) -> DataFrame:
    """One cycle through all ids in the order of md5(seed-id).

    Successors are found within the groups of equal leading digits; the first ids of the 16^prefix groups close the gaps.
    """
    rows = ids.withColumn("h", F.md5(F.concat(F.lit(f"{seed}-"), F.col("id").cast("string")).cast("binary"))).withColumn("g", F.substring("h", 1, prefix))
    firsts = rows.groupBy("g").agg(F.min_by("id", "h").alias("f"))
    after = F.lead("f").over(Window.orderBy("g"))
    start = F.first("f").over(Window.orderBy("g").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    firsts = firsts.select("g", F.coalesce(after, start).alias("then"))
    inside = F.lead("id").over(Window.partitionBy("g").orderBy("h"))
    return rows.withColumn("_in", inside).join(firsts, "g").select("id", F.coalesce("_in", "then").alias("next"))


def hops(cycle: DataFrame, n: int) -> DataFrame:
    """(id, at): where each id is after n steps. Each power is written once, so plans stay short."""
    power, reached = written(cycle.select("id", "next"), "power"), None
    while n:
        if n & 1:
            if reached is None:
                reached = power.select("id", F.col("next").alias("at"))
            else:
                reached = written(reached.join(power.withColumnRenamed("id", "at"), "at").select("id", F.col("next").alias("at")), "hops")
        n >>= 1
        if n:
            again = power.select(F.col("id").alias("next"), F.col("next").alias("then"))
            power = written(power.join(again, "next").select("id", F.col("then").alias("next")), "power")
    return reached if reached is not None else cycle.select("id", F.col("id").alias("at"))


def traversed(cycle: DataFrame, n: int) -> DataFrame:
    """One row: cells, cells that n steps bring back, and cells reached as a successor (all equal n for one cycle)."""
    whole = hops(cycle, n).agg(F.count("*").alias("cells"), F.count_if(F.col("id") == F.col("at")).alias("returned"))
    return whole.withColumn("successors", cycle.select(F.count_distinct("next")).scalar())


def members(ids: DataFrame, wanted: DataFrame) -> DataFrame:
    """Which of the wanted ids there are."""
    return wanted.join(ids, "id", "left_semi")
