"""Sources and sinks: Parquet tables with a checked row count, seeded generators, result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load_checked(spark: SparkSession, path: str, rows: int) -> DataFrame | None:
    """The table at path, or None if it is missing or has another number of rows (the footers tell, no data is read)."""
    from pyspark.errors import AnalysisException

    try:
        df = spark.read.parquet(path)
    except AnalysisException:
        return None
    return df if df.count() == rows else None


def store(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def load_or_generate(spark: SparkSession, path: str, rows: int, seed: int = 42) -> DataFrame:
    """The stored relation of that many rows; where there is none, it is generated and stored."""
    found = load_checked(spark, path, rows)
    if found is None:
        store(uniform(spark, rows, seed=seed), path)
        found = spark.read.parquet(path)
    return found


def uniform(spark: SparkSession, rows: int, domain: int = 100, seed: int = 42, name: str = "x") -> DataFrame:
    """Values from 0 to domain - 1; a row's value depends on its number and the seed alone, so lost tasks give it again."""
    return spark.range(rows).select(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(domain)).alias(name))


def unique_keys(spark: SparkSession, rows: int, spread: int = 16, seed: int = 42) -> DataFrame:
    """rows distinct keys, a seeded sample of [0, rows * spread) with chance clusters and gaps.

    A number is a pair (number // spread, number % spread); each round moves one half by a hash of the other, around the
    end of its range, which gives every pair once.
    """
    left, right = F.floor(F.col("id") / spread).cast("long"), F.col("id") % spread
    for k in range(3):
        left = F.pmod(left + F.pmod(F.xxhash64(F.lit(seed + 2 * k), right), F.lit(rows)), F.lit(rows))
        right = F.pmod(right + F.pmod(F.xxhash64(F.lit(seed + 2 * k + 1), left), F.lit(spread)), F.lit(spread))
    return spark.range(rows).select((left * spread + right).alias("key"))


def repeated_keys(spark: SparkSession, rows: int, domain: int = 1 << 16, seed: int = 42) -> DataFrame:
    return uniform(spark, rows, domain, seed, "key").withColumn("value", F.lit(0).cast("long"))


def wide_rows(keys: DataFrame, payload: int = 7) -> DataFrame:
    """Row-store shape: a key and zeroed payload columns (pruned where a query reads only the key)."""
    return keys.withColumns({f"v{i}": F.lit(0).cast("long") for i in range(payload)})


def packed_bytes(spark: SparkSession, rows: int, seed: int = 42) -> DataFrame:
    return spark.range(rows).select(F.col("id").alias("pos"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(256)).cast("int").alias("b"))


def twin_columns(spark: SparkSession, rows: int, domain: int = 100, seed: int = 42) -> DataFrame:
    """The same values in a column of one byte and in one of eight, with the row's number."""
    x = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(domain))
    return spark.range(rows).select("id", x.cast("tinyint").alias("in8"), x.cast("long").alias("in64"))


def operation_log(spark: SparkSession, rows: int, domain: int = 16, seed: int = 42) -> DataFrame:
    """Six lookups, two inserts and two removals in every ten operations."""
    return spark.range(rows).select(
        F.col("id").alias("i"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(domain)).alias("key"), operation(F.col("id")).alias("op")
    )


def operation(i):
    """The operation at position i of a mixed workload."""
    return F.when(i % 10 < 6, "contains").when(i % 10 < 8, "insert").otherwise("remove")


def write_results(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def result_sink(df: DataFrame, order: list[str], n: int = 10) -> DataFrame:
    """What a result sink shows: the first n rows, each with the number of all rows (`total`, a scalar subquery)."""
    return preview(df, order, n).withColumn("total", df.select(F.count("*")).scalar())


def preview(df: DataFrame, order: list[str], n: int = 10) -> DataFrame:
    """The first n rows in a total order (each task keeps n rows)."""
    return df.orderBy(*order).limit(n)
