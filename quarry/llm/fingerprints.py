"""Document fingerprints as invertible Bloom lookup sketches, built and peeled by built-in functions alone.

A text is a set of paragraph digests (64 bits). A paragraph is a line; a long one is cut where its own words say (after a word
with one of a few last letters), so that what is put in or taken out moves no other cut. Short texts are cut finer: LEVELS has
the lengths of pieces by the length of the text, and two texts are compared as the longer one is cut.

Each digest goes to one cell in each of three parts of a table; a cell holds a count, the xor of its digests and the xor of
their checksums. Tables of two versions are subtracted cell by cell; peeling takes a digest from each pure cell out of its
other cells until nothing is left, and so recovers just the digests that differ. The tables that are the fingerprints are
subtracted first: their counts say about how many digests differ, and so which size peeling starts with, these tables or larger
ones; if peeling stops early, both texts are sketched again with four times the cells, and what SIZES sizes could not tell apart
is compared digest by digest.

The likeness of two texts is 1 - differing / all digests of both, with the digests that peeling recovered.

Tables are lists of cells that are not empty, so building, subtracting and peeling take time in proportion to the digests.

A null text counts as an empty one, whose fingerprint has no cells; equal texts have equal fingerprints, two empty texts have
likeness 1; rows of one id and text are one document and each get its result; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import bound, written

#: For texts of up to so many characters: the least and the most characters before the cut of a piece.
LEVELS = ((256, 4, 32), (4096, 40, 200), (1 << 31, 160, 640))
#: Last letters of the words that a piece ends with: about half of all words.
ENDS = "adensr"
#: Cells of the smallest table; factor and number of sizes tried.
CELLS, GROWTH, SIZES = 24, 4, 9
PARTS, ROUNDS = 3, 60
#: Cells for each digest that differs, by estimate, in the first size tried; with less than 1.22 peeling of a large table stops early.
ROOM = 1.5
_CELL = "struct<c:bigint,n:bigint,k:bigint,x:bigint>"
_TABLE = f"array<{_CELL}>"


def pattern(level: int) -> str:
    """What a piece is: up to the first cut after the least length, or to the end of the line or the most length."""
    _, least, most = LEVELS[level]
    return rf"[^\n]{{{least},{most}}}?[{ENDS}] |[^\n]{{1,{most}}}"


def level(length: Column) -> Column:
    """The place in LEVELS of a text of that many characters."""
    return sum((F.when(length > most, 1).otherwise(0) for most, _, _ in LEVELS[:-1]), F.lit(0))


def digests(text: Column, at: Column) -> Column:
    """The distinct digests of the paragraphs of a text, cut as `level` says."""
    pieces = F.regexp_extract_all(text, F.lit(pattern(len(LEVELS) - 1)), F.lit(0))
    for k in range(len(LEVELS) - 1):
        pieces = F.when(at == k, F.regexp_extract_all(text, F.lit(pattern(k)), F.lit(0))).otherwise(pieces)
    return F.array_distinct(F.transform(pieces, lambda p: F.xxhash64(p)))


def _let(value: Column, use) -> Column:
    """As `bound`, without the copy of the result that `transform` makes."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda x, _: x, use)


def _check(k: Column) -> Column:
    return F.xxhash64(k, F.lit(99)).bitwiseAND(F.lit(0xFFFFFFFF))


def _items(ks: Column, n: int) -> Column:
    """Digests as they go into cells, n times each."""
    return F.transform(ks, lambda k: F.struct(F.lit(-1).cast("bigint").alias("c"), F.lit(n).cast("bigint").alias("n"), k.alias("k"), _check(k).alias("x")))


def _place(c: Column, i: Column) -> Column:
    """A cell, and the place of what goes there, in one number; in order of cells."""
    return F.shiftleft(c.cast("bigint"), 32) + i


def _places(ks: Column, part: Column, before: Column) -> Column:
    """A cell in each part for each digest; before: what stands before the digests."""
    return F.flatten(F.transform(ks, lambda k, i: F.array(*[_place(F.pmod(F.xxhash64(k, F.lit(j)), part) + part * j, before + i) for j in range(PARTS)])))


def _gathered(items: Column, places: Column) -> Column:
    """The cells of those items, in order: counts added, the rest combined by xor; empty cells go."""

    def at(p: Column) -> Column:
        return p.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")

    def cell(s: Column, i: Column, end: Column) -> Column:
        c, zero = F.shiftright(s[i], 32).alias("c"), F.lit(0).cast("bigint")

        def summed(own: Column) -> Column:
            n, k, x = F.aggregate(own, zero, lambda a, e: a + items[e]["n"]), F.aggregate(own, zero, lambda a, e: a.bitwiseXOR(items[e]["k"])), F.aggregate(own, zero, lambda a, e: a.bitwiseXOR(items[e]["x"]))
            return F.struct(c, n.alias("n"), k.alias("k"), x.alias("x"))

        alone = _let(items[at(s[i])], lambda e: F.struct(c, e["n"].alias("n"), e["k"].alias("k"), e["x"].alias("x")))
        return F.when(end - i == 1, alone).otherwise(_let(F.transform(F.sequence(i, end - 1), lambda j: at(s[j])), summed))  # `slice` would copy all of s

    def of(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.when(i == 0, True).otherwise(F.shiftright(s[i], 32) != F.shiftright(s[i - 1], 32)))
        cells = _let(starts, lambda b: F.transform(b, lambda i, j: cell(s, i, F.coalesce(F.get(b, j + 1), F.size(s)))))
        return F.filter(cells, lambda e: (e["n"] != 0) | (e["k"] != 0) | (e["x"] != 0))

    return _let(F.sort_array(places), lambda s: F.when(F.size(s) > 0, of(s)).otherwise(F.array().cast(_TABLE)))


def _part(cells: Column) -> Column:
    return (cells / PARTS).cast("bigint")


def sketch(ds: Column, cells: Column) -> Column:
    """The table of a set of digests."""
    return _let(_items(ds, 1), lambda items: _gathered(items, _let(_part(cells), lambda part: _places(ds, part, F.lit(0)))))


def subtracted(a: Column, b: Column) -> Column:
    """Cell by cell, a minus b."""
    minus = F.transform(b, lambda e: F.struct(e["c"].alias("c"), (-e["n"]).alias("n"), e["k"].alias("k"), e["x"].alias("x")))
    return _let(F.concat(a, minus), lambda both: _gathered(both, F.transform(both, lambda e, i: _place(e["c"], i))))


def apart(a: Column, b: Column, cells: Column) -> Column:
    """What `subtracted` gives for the tables of two sets, which are sums of their digests' cells, without making both."""
    items = F.concat(_items(a, 1), _items(b, -1))
    return _let(items, lambda own: _gathered(own, _let(_part(cells), lambda part: F.concat(_places(a, part, F.lit(0)), _places(b, part, F.size(a))))))


def estimate(table: Column, gap: Column) -> Column:
    """About how many digests differ, from a subtracted table of CELLS cells and the gap between the sets' numbers.

    In a part of p cells the squares of counts add up to d + (gap ** 2 - d) / p on average, as signs of two digests in one cell
    meet at random but for the gap.
    """
    p = CELLS // PARTS
    squares = F.aggregate(table, F.lit(0.0), lambda s, e: s + e["n"].cast("double") * e["n"]) / PARTS
    return F.greatest((squares - gap.cast("double") * gap / p) / (1 - 1 / p), gap.cast("double"))


def peeled(table: Column, cells: Column) -> Column:
    """Struct of `added` and `removed` digests (of the first and the second table) and `rest`, the cells that peeling left."""
    longs = F.array().cast("array<bigint>")

    def state(t: Column, plus: Column, minus: Column, stuck: Column) -> Column:
        return F.struct(t.alias("rest"), plus.alias("added"), minus.alias("removed"), stuck.alias("stuck"))

    def step(s: Column, part: Column) -> Column:
        pure = F.filter(s["rest"], lambda e: (F.abs(e["n"]) == 1) & (e["x"] == _check(e["k"])))

        def of(own: Column, sign: int) -> Column:
            return F.array_distinct(F.transform(F.filter(own, lambda e: e["n"] == sign), lambda e: e["k"]))

        def take(found: Column) -> Column:
            plus, minus, rest = found["plus"], found["minus"], s["rest"]
            items = F.concat(rest, _items(plus, -1), _items(minus, 1))
            places = F.concat(F.transform(rest, lambda e, i: _place(e["c"], i)), _places(plus, part, F.size(rest)), _places(minus, part, F.size(rest) + F.size(plus)))
            return F.when(F.size(plus) + F.size(minus) == 0, state(rest, s["added"], s["removed"], F.lit(True))).otherwise(
                state(_let(items, lambda own: _gathered(own, places)), F.concat(s["added"], plus), F.concat(s["removed"], minus), F.lit(False))
            )

        return _let(_let(pure, lambda own: F.struct(of(own, 1).alias("plus"), of(own, -1).alias("minus"))), take)

    start = state(table, longs, longs, F.lit(False))
    return _let(_part(cells), lambda part: F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda s, _: F.when((F.size(s["rest"]) == 0) | s["stuck"], s).otherwise(step(s, part))))


def differing(a: Column, b: Column, first: Column | None = None, second: Column | None = None) -> Column:
    """Digests that are in one of two sets, as peeling recovers them: struct of added, removed and the number of cells it took
    (0 where no size was enough and the digests were compared).

    first, second: the sets' smallest tables, if they are there. Cells grow on failure. Sizes that both sets' numbers rule out, or
    that hold less than ROOM cells for each digest that differs by the smallest tables' estimate, are passed over.
    """
    gap = F.abs(F.size(a) - F.size(b))
    none = F.lit(None).cast("struct<added:array<bigint>,removed:array<bigint>,cells:bigint>")
    smallest_apart = apart(a, b, F.lit(CELLS).cast("bigint")) if first is None else subtracted(first, second)

    def of(least: Column) -> Column:
        def tried(cells: Column) -> Column:
            table = F.when(cells == CELLS, least["table"]).otherwise(apart(a, b, cells))
            return _let(peeled(table, cells), lambda s: F.when(F.size(s["rest"]) == 0, F.struct(s["added"].alias("added"), s["removed"].alias("removed"), cells.alias("cells"))))

        def attempt(found: Column, i: Column) -> Column:
            cells = (F.lit(CELLS) * F.pow(F.lit(GROWTH), i).cast("bigint")).cast("bigint")
            return F.when(found.isNotNull() | (cells < gap) | ((cells < least["need"]) & (i < SIZES - 1)), found).otherwise(_let(cells, tried))

        return F.aggregate(F.sequence(F.lit(0), F.lit(SIZES - 1)), none, attempt)

    whole = F.struct(F.array_except(a, b).alias("added"), F.array_except(b, a).alias("removed"), F.lit(0).cast("bigint").alias("cells"))
    need = _let(smallest_apart, lambda t: F.struct(t.alias("table"), (ROOM * estimate(t, gap)).alias("need")))
    return F.coalesce(_let(need, of), whole)


def likeness(a: Column, b: Column, first: Column | None = None, second: Column | None = None) -> Column:
    """1 - differing / all, of two sets of digests."""
    total = F.size(a) + F.size(b)
    number = bound(differing(a, b, first, second), lambda d: F.size(d["added"]) + F.size(d["removed"]))
    return F.when(total == 0, F.lit(1.0)).otherwise(1 - number / total)


def rendered(table: Column) -> Column:
    """A table as text: cell, count, digest and checksum in hex."""
    return F.array_join(F.transform(table, lambda e: F.concat_ws(":", F.hex(e["c"]), e["n"].cast("string"), F.hex(e["k"]), F.hex(e["x"]))), ",")


def smallest(ds: Column) -> Column:
    """The table that, rendered, is the fingerprint."""
    return sketch(ds, F.lit(CELLS).cast("bigint"))


def followers(ids: DataFrame) -> DataFrame:
    """(d, u, nu): each document, named by u, and the next one in descending order of d; after the last comes the first.

    ids: d, and u that names the document and settles ties. The distinct ids are dealt out by range and numbered within;
    only the ends of the ranges meet.
    """
    order = [F.col("d").desc_nulls_last(), F.col("u")]
    dealt = written(ids.select("d", "u").distinct().repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "followers")
    rank = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    inside = dealt.withColumns({"_in": F.lead("u").over(Window.partitionBy("part").orderBy(*order)), "_r": rank})
    whole = Window.orderBy("part")  # a row for each range
    first = F.first("one").over(whole.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ends = inside.filter("_r = 1").select("part", F.col("u").alias("one")).select("part", F.coalesce(F.lead("one").over(whole), first).alias("then"))
    return inside.join(ends, "part").select("d", "u", F.coalesce("_in", "then").alias("nu"))


def compared(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document against its edited text (the last third replaced by the start of the next document) and the next one."""
    rows = docs.select(F.col(key).alias("d"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    named = F.concat(F.when(F.col("d").isNull(), "n").otherwise(F.concat(F.lit("v"), F.col("d").cast("string"))), F.lit(":"), F.xxhash64("t").cast("string"))
    rows = rows.withColumn("u", named)
    sizes = rows.select("u", F.length("t").alias("n")).distinct()
    asked = followers(rows).join(sizes, "u").select("d", F.col("u").alias("a"), F.col("nu").alias("u"), "n")
    # One exchange of the texts by name serves both joins (so both read just u and t); between them starts and digests move.
    texts = rows.select("u", "t")
    third, far = F.floor(F.col("n") / 3).cast("int"), F.greatest(level(F.col("n")), level(F.length("t")))
    given = texts.join(asked, "u").select("d", F.col("a").alias("u"), F.substring("t", F.lit(1), third).alias("head"), digests(F.col("t"), far).alias("next_ds"), third.alias("k"), far.alias("far"))
    given = given.groupBy("u").agg(*[F.first(c).alias(c) for c in ("d", "head", "next_ds", "k", "far")])  # repeated rows give the same
    both = texts.join(given, "u")
    both = both.select("d", "t", F.length("t").alias("n"), F.concat(F.substring("t", F.lit(1), F.length("t") - F.col("k")), F.col("head")).alias("e"), "next_ds", "far")
    both = both.withColumns({"own": level(F.col("n")), "other": level(F.length("e"))})
    both = both.withColumns({"ds": digests(F.col("t"), F.col("own")), "edited_ds": digests(F.col("e"), F.col("other"))})
    # As the longer text is cut, where that is another level than its own.
    both = both.withColumns({"far_ds": F.when(F.col("far") == F.col("own"), F.col("ds")).otherwise(digests(F.col("t"), F.col("far"))), "near_ds": F.when(F.col("other") == F.col("own"), F.col("edited_ds")).otherwise(digests(F.col("e"), F.col("own")))})
    both = both.withColumns({"table": smallest(F.col("ds")), "edited_table": smallest(F.col("edited_ds"))})
    far_table = F.when(F.col("far") == F.col("own"), F.col("table")).otherwise(smallest(F.col("far_ds")))
    both = both.withColumn("next_table", smallest(F.col("next_ds")))
    near_table = F.when(F.col("other") == F.col("own"), F.col("edited_table")).otherwise(smallest(F.col("near_ds")))
    return both.select(
        F.col("d").alias(key), F.col("n").cast("long").alias("n_chars"), F.sha2(F.col("e").cast("binary"), 256).alias("edited_sha256"),
        rendered(F.col("table")).alias("fingerprint"), rendered(F.col("edited_table")).alias("edited_fingerprint"),
        likeness(F.col("ds"), F.col("near_ds"), F.col("table"), near_table).alias("near_edited"), likeness(F.col("far_ds"), F.col("next_ds"), far_table, F.col("next_table")).alias("near_next"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    from quarry.llm.common import documents

    return compared(documents(spark, sf_dir))
