"""Line dedup by winnowing over line hashes.

Units are the lines of a text, and the sentences of a line. A window is the shortest run of units from a unit on that
has MIN_WORDS words, or the shortest such run that ends the text; its fingerprint is the least unit hash in it, so that equal
runs of so many words always share a fingerprint. Windows are kept by runs of equal fingerprint; those whose fingerprint occurs
once go no further. Of the others, equal windows are matched with their first occurrence, and adjoining matches extend each
other both ways into maximal runs, which are deleted wherever they are not the first.

So a unit is deleted if and only if it lies in a window that has occurred before; what follows the last whole window of a
repeated run, less than MIN_WORDS words, stays if other text follows it. (Where a text repeats itself and the
occurrences overlap, the first one stays whole.) Words are counted by spaces, a unit counts one at least.

The order of texts is that of their ids (null last), then of their hashes: texts are told apart by both, so one id may stand
for several. Nulls stay null; texts without a window are left alone; rows of equal id (or none) and text are one text and
deleted from alike; an empty table gives no rows; other columns are kept (one named n_gone is replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bound, hot_joined, islands, named, salted_joined, written

#: A passage of over 50 words in the midst of a line loses its first sentence to what stands before it there; the rest of it
#: has to be enough.
MIN_WORDS = 20
#: Marks the cuts; texts that have it are cut by a pattern instead.
CUT = "\x01"
ENDS = ("\n", ". ", "! ", "? ")
BLANK = " \t\n\r"


def units(text: Column) -> Column:
    """The text in pieces that joined give it again."""
    marked = text
    for end in ENDS:
        marked = F.replace(marked, F.lit(end), F.lit(end + CUT))
    slow = F.split(text, r"(?<=\n)|(?<=[.!?] )")
    return F.when(F.instr(text, CUT) > 0, slow).otherwise(F.split(marked, CUT))


def _reach(counts: Column, i: Column, least: int) -> Column:
    """Units of the shortest run from i (1-based) with that many words; 0 if the text ends before."""
    run = F.aggregate(
        F.slice(counts, i, F.lit(least)), F.lit(0).cast("long"),  # every unit has a word, so no run is longer
        lambda a, x: F.when(F.shiftright(a, 20) >= least, a).otherwise(a + x * (1 << 20) + 1),
    )
    found = bound(run, lambda a: F.when(F.shiftright(a, 20) >= least, a.bitwiseAND(F.lit((1 << 20) - 1))).otherwise(F.lit(0))).cast("int")
    total, cases = F.get(counts, i - 1), []
    for k in range(1, 5):  # most runs are as short as this
        cases.append((total >= least, k))
        total = total + F.get(counts, i - 1 + k)
    for held, k in reversed(cases):
        found = F.when(held, F.lit(k)).otherwise(found)
    return found


def _windows(text: Column, least: int) -> Column:
    """Array of (p, n, f, h): place, units, fingerprint and content hash of each window."""

    def solid(u: Column) -> Column:
        return F.trim(u, F.lit(BLANK))

    def window(hashes: Column, i: Column, n: Column) -> Column:
        return bound(F.slice(hashes, i, n), lambda own: F.struct((i - 1).alias("p"), n.alias("n"), F.array_min(own).alias("f"), F.xxhash64(own).alias("h")))

    def of(x: Column) -> Column:
        size = F.size(x["w"])
        each = F.transform(F.sequence(F.lit(1), size), lambda i: bound(_reach(x["w"], i, least), lambda n: F.when(n > 0, window(x["h"], i, n))))

        def ended(found: Column) -> Column:
            """With the shortest run that ends the text, where no window does."""
            last = F.try_element_at(found, F.lit(-1))
            back = F.reverse(F.slice(x["w"], F.greatest(size - least + 1, F.lit(1)), F.lit(least)))
            final = bound(_reach(back, F.lit(1), least), lambda n: F.array(window(x["h"], size - n + 1, n)))
            return F.when(last.isNull() | (last["p"] + last["n"] == size), found).otherwise(F.concat(found, final))

        return bound(F.filter(each, lambda y: y.isNotNull()), ended)

    def counted(u: Column) -> Column:
        return F.octet_length(u) - F.octet_length(F.replace(u, F.lit(" "), F.lit(""))) + 1

    cut = bound(F.transform(units(text), solid), lambda u: F.struct(F.transform(u, lambda x: F.xxhash64(x)).alias("h"), F.transform(u, lambda x: counted(x).cast("long")).alias("w")))
    return bound(cut, of)


def _runs(windows: Column) -> Column:
    """Windows in runs of equal fingerprint: array of (f, ws)."""

    def of(w: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(w)), lambda i: (i == 1) | (F.try_element_at(w, i)["f"] != F.try_element_at(w, F.greatest(i - 1, F.lit(1)))["f"]))
        return bound(
            starts,
            lambda s: F.transform(
                s,
                lambda i, k: F.struct(
                    F.element_at(w, i)["f"].alias("f"),
                    F.transform(F.slice(w, i, F.coalesce(F.try_element_at(s, k + 2), F.size(w) + 1) - i), lambda x: F.struct(x["p"].alias("p"), x["n"].alias("n"), x["h"].alias("h"))).alias("ws"),
                ),
            ),
        )

    return bound(windows, lambda w: F.when(F.size(w) > 0, of(w)))


def _repeats(texts: DataFrame, min_words: int) -> tuple[DataFrame, DataFrame]:
    """o and runs: the runs (start, end) of units to delete; and the stored windows (o, f, ws)."""
    runs = written(texts.select("o", F.explode(_runs(_windows(F.col("t"), min_words))).alias("r")).select("o", "r.f", "r.ws"), "winnowed")
    again = F.max(F.size(F.array_distinct(F.transform("ws", lambda x: x["h"]))) < F.size("ws"))
    common = runs.groupBy("f").agg(F.count("*").alias("_c"), again.alias("_again")).filter((F.col("_c") > 1) | F.col("_again")).select("f", "_c")
    some = hot_joined(runs, written(common, "common"), ["f"], "_c")
    spans = written(some.select("f", "o", F.explode("ws").alias("w")).select("f", "o", "w.h", "w.p", "w.n"), "spans")
    firsts = spans.groupBy("f", "h").agg(F.min(F.struct("o", "p", "n")).alias("_one"), F.count("*").alias("_c")).filter("_c > 1")
    later = hot_joined(spans, written(firsts, "firsts"), ["f", "h"], "_c").filter((F.col("o") != F.col("_one.o")) | (F.col("p") != F.col("_one.p")))
    start = F.when(F.col("o") == F.col("_one.o"), F.greatest("p", F.col("_one.p") + F.col("_one.n"))).otherwise(F.col("p"))
    found = later.select("o", start.alias("s"), (F.col("p") + F.col("n") - 1).alias("e")).filter("s <= e")
    return islands(found, 1), runs


def without(text: Column, gone: Column) -> Column:
    """text without the runs of units."""

    def of(u: Column) -> Column:
        def kept(k: Column) -> Column:
            low = F.when(k == 0, F.lit(0)).otherwise(F.try_element_at(gone, F.greatest(k, F.lit(1)))["end"] + 1)
            high = F.coalesce(F.try_element_at(gone, k + 1)["start"], F.size(u))
            return bound(low, lambda a: F.slice(u, a + 1, F.greatest(high - a, F.lit(0))))

        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), kept)), "")

    return F.when(gone.isNull(), text).otherwise(bound(units(text), of))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, length: str | None = None) -> DataFrame:
    """docs with later repeated runs deleted from the text, and `n_gone` units deleted. length: a column with the number of characters, kept true."""
    texts = docs.filter(F.col(text).isNotNull()).select(named(key, text).alias("o"), F.col(text).alias("t"))
    gone, runs = _repeats(texts, min_words)
    rows = docs.withColumn("__q_o", named(key, text))
    counted = runs.select(F.col("o").alias("__q_o"))
    out = salted_joined(rows, gone.toDF("__q_o", "__q_gone"), "__q_o", F.monotonically_increasing_id(), counted, "left").drop("__q_o")
    out = out.withColumn("__q_gone", F.when(F.col(text).isNotNull(), F.col("__q_gone")))
    count = F.coalesce(F.aggregate("__q_gone", F.lit(0), lambda a, x: a + x["end"] - x["start"] + 1), F.lit(0)).cast("long")
    out = out.withColumns({text: without(F.col(text), F.col("__q_gone")), "n_gone": count}).drop("__q_gone")
    if length:
        out = out.withColumn(length, F.when(F.col("n_gone") > 0, F.length(text)).otherwise(F.col(length)).cast(docs.schema[length].dataType))
    return out.select(*[c for c in docs.columns if c != "n_gone"], "n_gone")


def query(spark, sf_dir: str) -> DataFrame:
    from quarry.llm.common import documents

    out = deduplicated(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_gone", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def oracle_sql() -> str:
    """Every window by its words; deleted is what a window covers that has occurred before."""
    marked = "text"
    for end in ENDS:
        e = "chr(10)" if end == "\n" else f"'{end}'"
        marked = f"replace({marked}, {e}, {e} || chr(1))"
    return f"""
WITH c AS (SELECT doc_id, string_split({marked}, chr(1)) AS us FROM documents),
u AS (SELECT doc_id, unnest(us) AS u, generate_subscripts(us, 1) - 1 AS p FROM c),
t AS (SELECT *, trim(u, ' ' || chr(9) || chr(10) || chr(13)) AS s FROM u),
n AS (SELECT *, SUM(strlen(s) - strlen(replace(s, ' ', '')) + 1) OVER (PARTITION BY doc_id ORDER BY p) AS upto,
        strlen(s) - strlen(replace(s, ' ', '')) + 1 AS own FROM t),
w AS (SELECT a.doc_id, a.p, MIN(b.p) AS e FROM n a JOIN n b ON a.doc_id = b.doc_id AND b.p BETWEEN a.p AND a.p + {MIN_WORDS - 1}
        AND b.upto - a.upto + a.own >= {MIN_WORDS} GROUP BY 1, 2
      UNION SELECT a.doc_id, MAX(a.p), b.p FROM n a JOIN n b ON a.doc_id = b.doc_id AND a.p BETWEEN b.p - {MIN_WORDS - 1} AND b.p
        JOIN (SELECT doc_id, MAX(p) AS p FROM n GROUP BY doc_id) z ON z.doc_id = b.doc_id AND z.p = b.p
        WHERE b.upto - a.upto + a.own >= {MIN_WORDS} GROUP BY a.doc_id, b.p),
x AS (SELECT w.doc_id, w.p, w.e, string_agg(t.s, chr(1) ORDER BY t.p) AS body FROM w JOIN t ON t.doc_id = w.doc_id AND t.p BETWEEN w.p AND w.e GROUP BY 1, 2, 3),
f AS (SELECT body, MIN(ROW(doc_id, p, e)) AS one FROM x GROUP BY body HAVING COUNT(*) > 1),
r AS (SELECT x.doc_id, CASE WHEN x.doc_id = one[1] THEN GREATEST(x.p, one[3] + 1) ELSE x.p END AS s, x.e FROM x JOIN f USING (body)
        WHERE x.doc_id <> one[1] OR x.p <> one[2]),
g AS (SELECT DISTINCT u.doc_id, u.p FROM u JOIN r ON u.doc_id = r.doc_id AND u.p BETWEEN r.s AND r.e),
k AS (SELECT u.doc_id, COUNT(g.p) AS n_gone, COALESCE(string_agg(u.u, '' ORDER BY u.p) FILTER (WHERE g.p IS NULL), '') AS text
        FROM u LEFT JOIN g ON g.doc_id = u.doc_id AND g.p = u.p GROUP BY u.doc_id)
SELECT doc_id, n_gone, length(text) AS n_chars, md5(text) AS text_md5 FROM k
"""
