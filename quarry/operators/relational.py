"""Scan, selection and aggregation over one integer column, under three execution models.

The models differ in how the plan is executed, never in its rows: each runs in a session of its own, whose settings do
not touch the caller's.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Comparison of a column with a constant by name.
PREDICATES = {"=": lambda c, v: c == v, "<>": lambda c, v: c != v, "<": lambda c, v: c < v}

#: Settings by execution model.
MODELS: dict[str, dict[str, str]] = {
    "tuple": {"spark.sql.codegen.wholeStage": "false", "spark.sql.parquet.enableVectorizedReader": "false"},
    "vector": {"spark.sql.codegen.wholeStage": "true", "spark.sql.parquet.enableVectorizedReader": "true", "spark.sql.parquet.columnarReaderBatchSize": "1024"},
    "materialized": {},
}


def modelled(spark: SparkSession, model: str) -> SparkSession:
    """A session with the caller's settings and those of the model on top."""
    own = spark.newSession()
    for key, value in {**spark.conf.getAll, **MODELS[model]}.items():
        if own.conf.isModifiable(key):
            own.conf.set(key, value)
    return own


def scan(df: DataFrame, x: Column, name: str = "x") -> DataFrame:
    """The relation of one column: all that the file has to give."""
    return df.select(x.cast("long").alias(name))


def select(df: DataFrame, predicates: Iterable[tuple[str, int]], name: str = "x") -> DataFrame:
    """A conjunction, one selection on top of another, which Catalyst merges into one filter."""
    for op, value in predicates:
        df = df.filter(PREDICATES[op](F.col(name), F.lit(value)))
    return df


def total_materialized(df: DataFrame, predicates: Iterable[tuple[str, int]], name: str = "x", out: str = "s") -> DataFrame:
    """The sum of a conjunction, an operator at a time: each selection's result is there as a whole before the next one starts,
    and is let go when the next one is there. Runs at once."""
    held = None
    for op, value in predicates:
        df = df.filter(PREDICATES[op](F.col(name), F.lit(value))).persist(StorageLevel.MEMORY_AND_DISK)
        df.write.format("noop").mode("overwrite").save()
        if held is not None:
            held.unpersist()
        held = df
    found = total(df, name, out).first()[0]
    if held is not None:
        held.unpersist()
    return df.sparkSession.range(1).select(F.lit(found).cast("long").alias(out))


def total(df: DataFrame, name: str = "x", out: str = "s") -> DataFrame:
    """One row; 0 for no rows."""
    return df.agg(F.coalesce(F.sum(name), F.lit(0)).cast("long").alias(out))


def count(df: DataFrame, out: str = "n") -> DataFrame:
    return df.agg(F.count("*").alias(out))


def count_below(df: DataFrame, column: Column, threshold: int, branch_free: bool, out: str = "n") -> DataFrame:
    """Rows whose value is below the threshold: behind a filter, or as a sum of comparisons without one."""
    if branch_free:
        return df.agg(F.count_if(column < threshold).alias(out))
    return df.filter(column < threshold).agg(F.count("*").alias(out))


def count_below_each(df: DataFrame, column: Column, thresholds: Iterable[int], name: str = "sel", out: str = "n") -> DataFrame:
    """The counts for several thresholds in one pass: a conditional count each, turned into rows afterwards."""
    thresholds = list(thresholds)
    wide = df.agg(*[F.count_if(column < t).alias(f"c{t}") for t in thresholds])
    pairs = ", ".join(f"{t}, c{t}" for t in thresholds)
    return wide.select(F.expr(f"stack({len(thresholds)}, {pairs}) AS ({name}, {out})"))


def count_below_chunks(df: DataFrame, rid: Column, column: Column, thresholds: Iterable[int], chunk: int) -> DataFrame:
    """The counts for several thresholds by chunk of row numbers: (chunk, sel, n)."""
    thresholds = list(thresholds)
    wide = df.groupBy(F.floor(rid / chunk).cast("long").alias("chunk")).agg(*[F.count_if(column < t).alias(f"c{t}") for t in thresholds])
    pairs = ", ".join(f"{t}, c{t}" for t in thresholds)
    return wide.select("chunk", F.expr(f"stack({len(thresholds)}, {pairs}) AS (sel, n)"))


#: Ranges of a step of the median, and values that are sorted in one task.
RANGES, SORTED = 4096, 1 << 16


def median_of(df: DataFrame, column: str, out: str = "m") -> DataFrame:
    """The exact median of a measurement column, null for no values. Each step counts the values of RANGES ranges and goes on
    with the one that has the median, until that has few values or a single one; so no task holds all of them. Runs at once."""
    x = df.select(F.col(column).cast("double").alias("x")).filter("x IS NOT NULL AND NOT isnan(x)")
    n, low, high = x.agg(F.count("*"), F.min("x"), F.max("x")).first()

    def at(rank: int) -> float:
        """The value of that rank, from 0."""
        lo, hi, here = low, high, n
        while here > SORTED and lo < hi:
            place = F.least(F.floor((F.col("x") - lo) / ((hi - lo) / RANGES)), F.lit(RANGES - 1))
            ranges = x.filter(F.col("x").between(lo, hi)).groupBy(place.alias("b")).agg(F.count("*").alias("c"), F.min("x").alias("lo"), F.max("x").alias("hi"))
            for r in sorted(ranges.collect(), key=lambda r: r["b"]):  # RANGES rows at most
                if rank < r["c"]:
                    break
                rank -= r["c"]
            if (r["lo"], r["hi"]) == (lo, hi):  # too close to be divided
                return x.filter(F.col("x").between(lo, hi)).agg(F.percentile("x", F.lit(rank / max(here - 1, 1)))).first()[0]
            lo, hi, here = r["lo"], r["hi"], r["c"]
        if lo == hi:
            return lo
        return x.filter(F.col("x").between(lo, hi)).agg(F.sort_array(F.collect_list("x"))[rank]).first()[0]

    middle = None if not n else (at((n - 1) // 2) + at(n // 2)) / 2 if n % 2 == 0 else at(n // 2)
    return df.sparkSession.range(1).select(F.lit(middle).cast("double").alias(out))
