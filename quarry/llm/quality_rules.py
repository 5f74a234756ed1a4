"""Quality rules: one table of thresholds, compiled into one projection of built-in expressions.

Nulls and empty texts have no words and fail the length rule; repeated rows are judged one by one; other columns are kept
as they are, and a column of the input with the name of a result is replaced by the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import SPACES, WORD, bound, removed

#: Very frequent words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in a is that for on are with as was be by this from it or an at have not "
    "de la le les des et en un une est que qui dans pour pas du au sur avec "
    "der die und das den von zu mit sich des auf ist im dem nicht ein eine für "
    "el los las y por con para una su del al se lo no como"
).split()


@dataclass(frozen=True)
class Rule:
    """A measure times `scale` has to lie in [low, high], both given as multiples of `per` (another measure, or 1)."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None
    per: str | None = None


#: Every rule must hold. Ratios are written without a division: an empty text breaks none of them but the length rule.
RULES: tuple[Rule, ...] = (
    Rule("length", "n_words", low=50, high=200_000),
    Rule("repeated words", "n_repeat_words", high=0.5, per="n_words"),
    Rule("word length", "word_chars", low=2, high=16, per="n_words"),
    Rule("symbols", "n_symbols", high=0.1, per="n_words"),
    Rule("stop words", "n_stop_words", low=0.02, per="n_words"),
    Rule("capitals", "n_upper", high=0.5, per="word_chars"),
    Rule("bars", "n_bars", high=0.2, per="n_words"),
    Rule("repeated lines", "n_dup_lines", high=0.6, per="n_lines"),
)


def _repeat_words(words: Column) -> Column:
    """Words that lie in a window of three words found at least twice in the text.

    Window hashes are sorted as plain longs; positions are looked at only in texts that have a repeated window.
    """

    def positions(hashes: Column) -> Column:
        tagged = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        again = bound(
            tagged,
            lambda s: F.filter(
                F.transform(s, lambda x, j: F.when((F.try_element_at(s, j + 2)["h"] == x["h"]) | ((j > 0) & (F.try_element_at(s, F.greatest(j, F.lit(1)))["h"] == x["h"])), x["i"])),
                lambda i: i.isNotNull(),
            ),
        )
        return bound(
            F.sort_array(again),
            lambda p: F.aggregate(F.transform(p, lambda x, j: F.coalesce(F.least(F.lit(3), F.try_element_at(p, j + 2) - x), F.lit(3))), F.lit(0).cast("long"), lambda a, x: a + x),
        )

    def repeated(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), positions(hashes)).otherwise(F.lit(0).cast("long"))

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)))

    return bound(words, lambda w: F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(bound(windows(w), repeated)))


def measures(text: Column) -> dict[str, Column]:
    """The measured quantities by name; all are bigint and take a null as an empty text."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(removed(x, SPACES)) > 0)
    solid = removed(text, SPACES)
    stops = F.array(*[F.lit(w) for w in sorted(set(STOP_WORDS))])
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(solid).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": _repeat_words(words),
        "n_lines": F.size(lines).cast("long"),
        "n_stop_words": F.size(F.filter(F.transform(words, lambda w: F.lower(w)), lambda w: w.isin(*sorted(set(STOP_WORDS))))).cast("long"),
        "n_upper": F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long"),
        "n_bars": F.regexp_count(text, F.lit(r"[|!]")).cast("long"),
    }


def compiled(rules: Iterable[Rule]) -> list[tuple[str, Callable[[dict[str, Column]], Column]]]:
    """Each rule as a function from columns to the condition that it holds."""

    def condition(rule: Rule) -> Callable[[dict[str, Column]], Column]:
        def holds(m: dict[str, Column]) -> Column:
            value, unit = m[rule.measure].cast("double"), m[rule.per].cast("double") if rule.per else F.lit(1.0)
            held = F.lit(True)
            if rule.low is not None:
                held = held & (value >= unit * F.lit(float(rule.low)))
            if rule.high is not None:
                held = held & (value <= unit * F.lit(float(rule.high)))
            return held

        return holds

    return [(rule.name, condition(rule)) for rule in rules]


def judged(docs: DataFrame, text: str = "text", rules: Iterable[Rule] = RULES) -> DataFrame:
    """docs with the measures, `failed` (names of the rules that do not hold) and `kept` (none failed)."""
    m = measures(F.col(text))
    out = docs.withColumn("__q_m", F.struct(*[c.alias(n) for n, c in m.items()]))
    got = {n: F.col("__q_m")[n] for n in m}
    failed = F.array_compact(F.array(*[F.when(~hold(got), F.lit(name)) for name, hold in compiled(rules)]))
    return out.withColumns({**got, "failed": failed}).withColumn("kept", F.size("failed") == 0).drop("__q_m")


def query(spark, sf_dir: str) -> DataFrame:
    """The measures of every document, what the fixed base rules say and what the whole table says."""
    from quarry.llm.common import documents

    docs = documents(spark, sf_dir).select("doc_id", "text")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & F.col("kept")).alias("kept"), F.array_join("failed", ",").alias("failed"),
    )


def oracle_sql() -> str:
    """The same rows in SQL: words are unnested once, the rest are counts over them."""
    stops = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    tests = []
    for rule in RULES:
        unit = rule.per or "1"
        part = [f"CAST({rule.measure} AS DOUBLE) >= {unit} * CAST({float(rule.low)!r} AS DOUBLE)"] if rule.low is not None else []
        part += [f"CAST({rule.measure} AS DOUBLE) <= {unit} * CAST({float(rule.high)!r} AS DOUBLE)"] if rule.high is not None else []
        tests.append(f"CASE WHEN NOT ({' AND '.join(part)}) THEN '{rule.name}' END")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM s),
g AS (SELECT doc_id, i, word || chr(10) || lead(word, 1) OVER p || chr(10) || lead(word, 2) OVER p AS gram FROM w
      WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g WHERE gram IS NOT NULL) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS i FROM r) GROUP BY doc_id),
st AS (SELECT doc_id, count(*) AS n_stop_words FROM w WHERE lower(word) IN ({stops}) GROUP BY doc_id),
m AS (SELECT s.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
        CAST(len(ls) AS BIGINT) AS n_lines, coalesce(n_stop_words, 0) AS n_stop_words,
        length(regexp_replace(text, '[^\\p{{Lu}}]+', '', 'g')) AS n_upper,
        length(regexp_replace(text, '[^|!]+', '', 'g')) AS n_bars
      FROM s LEFT JOIN rep USING (doc_id) LEFT JOIN st USING (doc_id)),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        list_filter([{", ".join(tests)}], lambda x: x IS NOT NULL) AS bad FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND len(bad) = 0 AS kept, array_to_string(bad, ',') AS failed FROM j
"""
