"""Passages inside a line that share no run of whole sentences, and a brute-force version of the windows."""

from __future__ import annotations

import random
import re

import corpus_pipeline

from quarry.llm import passages

SCHEMA = "doc_id bigint, text string, n_chars bigint"


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("etaoinshrdlué") for _ in range(rng.randrange(3, 9))) for _ in range(n))


def test_passages_in_the_midst_of_a_line(spark):
    rng = random.Random(3)
    one, two = prose(rng, 51), prose(rng, 26) + ". " + prose(rng, 25)
    short = prose(rng, 50)
    texts = [f"{prose(rng, 9)} {p} {prose(rng, 9)}\n{prose(rng, 30)}" for p in (one, two, short) for _ in range(2)]
    df = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r for r in corpus_pipeline.lines(spark, df, "").collect()}
    assert [p in got[i].text for i, p in enumerate((one, one, two, two, short, short))] == [True, False, True, False, True, True]
    assert got[1].text == texts[1].replace(one + " ", "") and got[3].text == texts[3].replace(two + " ", "")
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_equals_brute_force(spark):
    rng = random.Random(4)
    pool = [prose(rng, rng.choice([5, 20, 60])) for _ in range(12)]
    texts = [rng.choice([" ", "\n", "  "]).join(rng.choice(pool) for _ in range(rng.randrange(12))) for _ in range(40)] + ["word " * 300, "", None, "ab\n" * 70 + "z"]
    rows = [(i, t, None) for i, t in enumerate(texts)] + [(0, texts[0], None), (None, texts[1], None)]
    got = passages.deduplicated(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    first: dict = {}
    want = {}
    for i, t in [*enumerate(texts), (None, texts[1])]:  # no id comes last
        gone = set()
        at = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")]
        for p in range(len(at) - 50):
            s, e = at[p][0], at[p + 50][1]
            e += t[e : e + 1] == " "
            d, q, end = first.setdefault(tuple(t[a:b] for a, b in at[p : p + 51]), (i, s, e))
            if (d, q) != (i, s):
                gone |= set(range(max(s, end) if d == i else s, e))
        want[i] = t if t is None else "".join(c for k, c in enumerate(t) if k not in gone)
    for r in got:
        assert r.text == want[r.doc_id], r.doc_id
        assert (r.n_cut > 0) == (r.text != texts[1 if r.doc_id is None else r.doc_id])


def test_empty_table(spark):
    assert passages.deduplicated(spark.createDataFrame([], SCHEMA)).count() == 0


def test_line_dedup_runs_no_python_on_executors(spark, monkeypatch):
    rng = random.Random(5)
    passage = prose(rng, 60)
    df = spark.createDataFrame([(i, f"{prose(rng, 8)} {passage} {prose(rng, 8)}", None) for i in range(3)], SCHEMA)

    def refused(*_, **__):
        raise AssertionError("Python on the executors")

    for name in ("mapInArrow", "mapInPandas"):
        monkeypatch.setattr(type(df), name, refused)
    got = {r.doc_id: r.text for r in passages.deduplicated(df).collect()}
    assert [passage in got[i] for i in range(3)] == [True, False, False]


def test_blanks_around_repeats(spark):
    """Tabs, several blanks, white space at either end, and a text that repeats itself across them."""
    rng = random.Random(6)
    run = prose(rng, 30).split(" ")
    texts = ["\t  " + "  ".join(run * 3) + " \n", " \n" + "\t".join(run * 3), "\x0b".join(run * 2) + "  ", "  ".join(run * 2) + "   tail"]
    rows = [(i, t, None) for i, t in enumerate(texts)]
    got = {r.doc_id: r.text for r in passages.deduplicated(spark.createDataFrame(rows, SCHEMA)).collect()}
    one = "  ".join(run)
    assert got[0] == "\t  " + one + "  " + "  ".join(run[:21]) + " \n"
    assert got[1] == " \n" and got[2] == " " and got[3] == "  tail"
