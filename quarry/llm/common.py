"""Pieces that several operators share: tables, words, and tables kept in the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.sources.kept import settled, shared_dir, temporary, written

__all__ = ["SPACES", "WORD", "bound", "documents", "hot_joined", "islands", "named", "removed", "salted_joined", "settled", "shared_dir", "table", "temporary", "written"]

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The characters that end a word.
SPACES = " \t\n\x0b\x0c\r"
#: Keys that are treated apart because many rows have them; any other key has less than 1 / HOT of the rows.
HOT = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def removed(text: Column, characters: str) -> Column:
    """text without any of the characters (one pass each, no pattern)."""
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def bound(value: Column, use) -> Column:
    """use(value), with value computed once for a row although use may name it many times or inside a lambda."""
    return F.transform(F.array(value), lambda x: use(x))[0]


def hot_joined(many: DataFrame, one: DataFrame, on: list[str], count: str) -> DataFrame:
    """many joined with one, which has a narrow row for each key, stored, with the number of its rows in many as `count`.

    The HOT most frequent keys are broadcast, so that no task gets all rows of one of them.
    """
    hot = F.broadcast(one.orderBy(F.desc(count), *on).limit(HOT))
    return many.join(hot, on).unionByName(many.join(hot.select(*on), on, "left_anti").join(one.join(hot.select(*on), on, "left_anti"), on))


def salted_joined(many: DataFrame, one: DataFrame, on: str, by: Column | str, counted: DataFrame, how: str = "inner") -> DataFrame:
    """many joined with one, whose rows may be wide: those of the HOT most frequent keys of `counted` (stored rows with the
    keys of many) are copied, and the rows of many dealt out among the copies by `by`. HOT further copies at most are made of
    the rows of one. how: inner or left."""
    share = counted.select((F.floor(F.count("*") / HOT) + 1).alias("n")).scalar()
    hot = counted.groupBy(on).agg(F.count("*").alias("_c")).orderBy(F.desc("_c"), on).limit(HOT)
    hot = F.broadcast(written(hot.select(on, (F.floor(F.col("_c") / share) + 1).cast("int").alias("__q_salts")).filter("__q_salts > 1"), "hot"))
    left = many.join(hot, on, "left").withColumn("__q_salt", F.pmod(F.xxhash64(by), F.coalesce("__q_salts", F.lit(1))).cast("int")).drop("__q_salts")
    right = one.join(hot, on, "left").withColumn("__q_salt", F.explode(F.sequence(F.lit(0), F.coalesce("__q_salts", F.lit(1)) - 1))).drop("__q_salts")
    return left.join(right, [on, "__q_salt"], how).drop("__q_salt")


def named(key: str, text: str) -> Column:
    """What names a text, in the order of texts: its id (null last), and its hash, as an id may stand for several."""
    return F.struct(F.col(key).isNull().alias("x"), F.col(key).alias("d"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"))


def islands(found: DataFrame, gap: int) -> DataFrame:
    """o and runs: the spans (o, s, e) of each text as disjoint runs (start, end) in order; spans less than gap apart are one."""
    by = Window.partitionBy("o").orderBy("s", "e")
    reach = F.max("e").over(by.rowsBetween(Window.unboundedPreceding, -1))
    numbered = found.distinct().withColumn("_new", F.when(reach >= F.col("s") - gap, 0).otherwise(1)).withColumn("_i", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    merged = numbered.groupBy("o", "_i").agg(F.min("s").alias("start"), F.max("e").alias("end"))
    return merged.groupBy("o").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("runs"))
