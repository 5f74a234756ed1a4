"""Decoding of packed 4-bit dictionary codes, two to a byte, the high half first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The dictionary, by code.
NIBBLES = (100, 101, 102, 103, 200, 201, 202, 203, 300, 301, 302, 303, 400, 401, 402, 403)


def _high(b: Column) -> Column:
    return F.shiftright(b, 4).bitwiseAND(F.lit(15))


def _low(b: Column) -> Column:
    return b.bitwiseAND(F.lit(15))


def _halves(df: DataFrame, pair: Column) -> DataFrame:
    """(pos, pair of values) to (out_pos, value): outputs 2 pos and 2 pos + 1."""
    return df.select(F.col("pos"), F.posexplode(pair).alias("half", "value")).select((F.col("pos") * 2 + F.col("half")).alias("out_pos"), F.col("value").cast("int").alias("value"))


def nibble_table(spark: SparkSession, values=NIBBLES) -> DataFrame:
    return spark.range(len(values)).select(F.col("id").cast("int").alias("code"), F.element_at(F.array(*map(F.lit, values)), F.col("id").cast("int") + 1).alias("value"))


def byte_table(spark: SparkSession, values=NIBBLES) -> DataFrame:
    """All 256 bytes with both values, built from the 16 codes."""
    lookup = F.array(*map(F.lit, values))
    b = F.col("id").cast("int")
    return spark.range(256).select(b.alias("b"), F.element_at(lookup, _high(b) + 1).alias("first"), F.element_at(lookup, _low(b) + 1).alias("second"))


def decode_scalar(df: DataFrame, values=NIBBLES) -> DataFrame:
    """Two lookups in a literal array for each byte."""
    lookup, b = F.array(*map(F.lit, values)), F.col("b")
    return _halves(df, F.array(F.element_at(lookup, _high(b) + 1), F.element_at(lookup, _low(b) + 1)))


def decode_table(df: DataFrame, values=NIBBLES) -> DataFrame:
    """One join with the table of 256 bytes (a fixed size, so it is broadcast)."""
    return _halves(df.join(F.broadcast(byte_table(df.sparkSession, values)), "b"), F.array("first", "second"))


def decode_array(df: DataFrame, values=NIBBLES) -> DataFrame:
    """One place in a literal array of 256 pairs."""
    flat = F.expr(f"array({', '.join(str(values[h]) for i in range(256) for h in (i >> 4, i & 15))})")
    return _halves(df, F.array(F.element_at(flat, 2 * F.col("b") + 1), F.element_at(flat, 2 * F.col("b") + 2)))


def decode_map(df: DataFrame, values=NIBBLES) -> DataFrame:
    """Two lookups in a literal map."""
    lookup, b = F.create_map(*[F.lit(x) for i, v in enumerate(values) for x in (i, v)]), F.col("b")
    return _halves(df, F.array(lookup[_high(b)], lookup[_low(b)]))
