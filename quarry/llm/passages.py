"""Repeated passages below the sentence: winnowing over word runs.

A window is LEAST words in a row wherever they start; its fingerprint is the least hash of the GRAM-word runs in it, so that equal
windows always share one. Of each text the fingerprints are kept first; only windows whose fingerprint occurs again are hashed whole
and matched with their first occurrence (least text, then place). A word is deleted if and only if it lies in a window that has
occurred before. (Where a text repeats itself and the occurrences overlap, the first one stays whole.)

Words are runs of anything but ASCII white space; the blank after a deleted run goes with it, line ends stay. The order of texts is
that of their ids (null last), then of their hashes: texts are told apart by both. Nulls stay null; texts of fewer words are left
alone; rows of equal id (or none) and text are one text and deleted from alike; an empty table gives no rows; other columns are kept
(one named n_cut is replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import SPACES, bound, hot_joined, islands, named, salted_joined, written

#: Words of a window (a passage of over 50 words has one), and of the runs that give its fingerprint.
LEAST, GRAM = 51, 25
#: Between two words, before the second.
BETWEEN = r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])"


def _pieces(text: Column) -> Column:
    """The text in pieces that joined give it again: white space that starts it, and each word with what follows it."""
    return F.split(text, BETWEEN)


def _solid(piece: Column) -> Column:
    return F.rtrim(piece, F.lit(SPACES))


def _words(text: Column) -> Column:
    """A hash of each word."""
    return F.transform(F.filter(F.transform(_pieces(text), _solid), lambda w: w != ""), lambda w: F.xxhash64(w))


def _rows(hashes: Column, size: int) -> Column:
    """A hash of the `size` items from each one on, as far as there are so many."""

    def of(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(x) - size + 1), lambda i: F.xxhash64(F.slice(x, i, size)))

    return bound(hashes, lambda x: F.when(F.size(x) >= size, of(x)).otherwise(F.array().cast("array<bigint>")))


def _runs(text: Column, least: int, gram: int) -> Column:
    """Windows in runs of equal fingerprint: array of (f, p, n, again): the fingerprint, first word and number of windows, and
    whether the fingerprint is met twice in the run."""
    width = least - gram + 1

    def of(g: Column) -> Column:
        return bound(F.transform(F.sequence(F.lit(1), F.size(g) - width + 1), lambda i: F.array_min(F.slice(g, i, width))), lambda f: runs(g, f))

    def runs(g: Column, f: Column) -> Column:
        new = F.filter(F.sequence(F.lit(1), F.size(f)), lambda i: (i == 1) | (F.get(f, i - 1) != F.get(f, F.greatest(i - 2, F.lit(0)))))
        return bound(new, lambda s: F.transform(s, lambda i, k: run(g, F.get(f, i - 1), i, F.coalesce(F.get(s, k + 1), F.size(f) + 1) - i)))

    def run(g: Column, own: Column, i: Column, n: Column) -> Column:
        again = F.size(F.filter(F.slice(g, i, n + width - 1), lambda x: x == own)) > 1
        return F.struct(own.alias("f"), (i - 1).alias("p"), n.alias("n"), again.alias("again"))

    return bound(_rows(_words(text), gram), lambda g: F.when(F.size(g) >= width, of(g)))


def _spans(marked: DataFrame, least: int) -> DataFrame:
    """o, f, h, s and e of the windows of the runs (f, p, n): where they start and end in `_atoms`, and a hash of their words."""

    def window(words: Column, run: Column, p: Column) -> Column:
        return F.struct(run["f"].alias("f"), F.xxhash64(F.slice(words, p + 1, least)).alias("h"), (2 * p).cast("long").alias("s"), (2 * (p + least) - 1).cast("long").alias("e"))

    def of(words: Column) -> Column:
        return F.flatten(F.transform("runs", lambda r: F.transform(F.sequence(r["p"], r["p"] + r["n"] - 1), lambda p: window(words, r, p))))

    return marked.select("o", F.explode(bound(_words(F.col("t")), of)).alias("w")).select("o", "w.*")


def _repeats(some: DataFrame, least: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """o and runs: the runs (start, end) of `_atoms` to delete; and the stored runs of windows."""
    kept = written(some.select("o", F.explode(_runs(F.col("t"), least, gram)).alias("r")).select("o", "r.*"), "fingerprints")
    common = kept.groupBy("f").agg(F.count("*").alias("_c"), F.max("again").alias("_again")).filter((F.col("_c") > 1) | F.col("_again")).select("f", "_c")
    marks = hot_joined(kept, written(common, "common"), ["f"], "_c").groupBy("o").agg(F.collect_list(F.struct("f", "p", "n")).alias("runs"))
    spans = written(_spans(salted_joined(some, marks, "o", F.monotonically_increasing_id(), counted=kept), least), "spans")
    firsts = spans.groupBy("f", "h").agg(F.min(F.struct("o", "s", "e")).alias("_one"), F.count("*").alias("_c")).filter("_c > 1")
    later = hot_joined(spans, written(firsts, "firsts"), ["f", "h"], "_c").filter((F.col("o") != F.col("_one.o")) | (F.col("s") != F.col("_one.s")))
    start = F.when(F.col("o") == F.col("_one.o"), F.greatest("s", "_one.e")).otherwise(F.col("s"))
    return islands(later.select("o", start.alias("s"), "e").filter("s < e"), 0), kept


def _atoms(text: Column) -> tuple[Column, Column]:
    """White space that starts the text; and for each word two pieces: it with the blank after it, and what else follows."""

    def of(piece: Column) -> Column:
        size = F.length(_solid(piece)) + 1
        end = size + F.when(F.substring(piece, size, F.lit(1)) == " ", 1).otherwise(0)
        return F.array(F.substring(piece, F.lit(1), end - 1), F.substring(piece, end, F.length(piece)))

    pieces = F.filter(_pieces(text), lambda x: _solid(x) != "")
    return F.regexp_extract(text, r"^[\x20\x09-\x0D]*", 0), F.flatten(F.transform(pieces, of))


def without(text: Column, cut: Column) -> Column:
    """text without the runs of atoms."""
    lead, atoms = _atoms(text)

    def of(u: Column) -> Column:
        def kept(k: Column) -> Column:
            low = F.when(k == 0, F.lit(0)).otherwise(F.try_element_at(cut, F.greatest(k, F.lit(1)))["end"]).cast("int")
            high = F.coalesce(F.try_element_at(cut, k + 1)["start"], F.size(u)).cast("int")
            return bound(low, lambda a: F.slice(u, a + 1, F.greatest(high - a, F.lit(0))))

        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(cut)), kept)), "")

    return F.when(cut.isNull(), text).otherwise(F.concat(lead, bound(atoms, of)))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", length: str | None = None, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """docs with later occurrences of passages deleted from the text, and `n_cut` runs deleted. length: a column with the number of
    characters, kept true. docs is read twice; best a stored table."""
    some = docs.filter(F.col(text).isNotNull()).select(named(key, text).alias("o"), F.col(text).alias("t"))
    cut, kept = _repeats(some, least, gram)
    rows = docs.withColumn("__q_o", named(key, text))
    out = salted_joined(rows, cut.toDF("__q_o", "__q_cut"), "__q_o", F.monotonically_increasing_id(), kept.withColumnRenamed("o", "__q_o"), "left").drop("__q_o")
    out = out.withColumn("__q_cut", F.when(F.col(text).isNotNull(), F.col("__q_cut")))
    count = F.when(F.col("__q_cut").isNull(), F.lit(0)).otherwise(F.size("__q_cut")).cast("long")
    out = out.withColumns({text: without(F.col(text), F.col("__q_cut")), "n_cut": count}).drop("__q_cut")
    if length:
        out = out.withColumn(length, F.when(F.col("n_cut") > 0, F.length(text)).otherwise(F.col(length)).cast(docs.schema[length].dataType))
    return out.select(*[c for c in docs.columns if c != "n_cut"], "n_cut")
