"""The stages one after another: each works on all that the one before kept, and its decisions take effect."""

from __future__ import annotations

import os
import random
import re
import string
import time

import corpus_pipeline
import pytest
from helpers import stored
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quarry.sources import kept


def test_stages(spark, tmp_path):
    where = stored(spark, tmp_path)
    docs = spark.read.parquet(f"{where}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, where)
        assert docs.columns == columns, name
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r.doc_id: r for r in docs.collect() if r.doc_id is not None}
    lines, near, masked = seen["line dedup"], seen["n-gram Jaccard join"], seen["secret scans"]
    assert 0 in lines and 12 not in lines and 13 not in lines  # exact copies lose all of their lines
    assert set(near) <= set(lines) and set(masked) == set(near)
    assert any("[SECRET]" in (r.text or "") for r in masked.values()) and all(r.text is None or r.n_chars == len(r.text) for r in masked.values())
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, where)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} >= set(masked)


def test_run_on_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, stored(spark, tmp_path, which=[])).count() == 0


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and out.columns[0] == "doc_id"


def test_near_stage_without_ids_and_with_one_id_on_two_texts(spark):
    own, other, third = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(1, other), (2, other + " end"), (None, own), (None, own), (None, own + " end of another"), (None, other), (None, None), (None, " "), (5, third), (5, "some words of its own"), (9, third)]
    got = corpus_pipeline.near(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "").collect()
    named = sorted((r.doc_id, r.text) for r in got if r.doc_id is not None)
    assert named == sorted([(1, other), (5, third), (5, "some words of its own")])
    unnamed = [r.text for r in got if r.doc_id is None]
    assert len(unnamed) == 3 and None in unnamed and " " in unnamed and len({own, own + " end of another"} & set(unnamed)) == 1


def prose(rng, n):
    return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(3, 9))) for _ in range(n))


def test_no_scraps_of_near_copies(spark):
    rng = random.Random(12)
    sentences = [prose(rng, 12) + "." for _ in range(30)]
    whole = " ".join(sentences)
    copy = " ".join([*sentences[:10], prose(rng, 15) + ".", *sentences[11:]])
    own = prose(rng, 80) + ". " + whole  # more than a scrap is left of it
    rows = [(1, whole, 1), (2, copy, 1), (3, own, 1), (4, "short text", 1), (None, whole, 1), (5, None, None), (6, "", 0)]
    got = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint"), "").collect()}
    assert set(got) == {1, 3, 4, 5, 6} and got[1] == whole and 80 <= len(got[3].split()) < 100


def test_filters_by_brute_force(spark, sf):
    """Line dedup and the near-duplicate stage over the whole table: no window of 51 words and no near copy is there twice."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lines = corpus_pipeline.lines(spark, docs, sf).collect()
    seen: dict = {}
    for r in sorted(lines, key=lambda r: r.doc_id):
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text)
        for k in range(len(w) - 50):
            assert seen.setdefault(tuple(w[k : k + 51]), r.doc_id) == r.doc_id
    near = corpus_pipeline.near(spark, docs, sf).collect()
    sets = {}
    for r in docs.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))
        sets[r.doc_id] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 5 * len(x & y) >= 4 * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    assert sorted(r.doc_id for r in near) == sorted(i for i in ids if find(i) == i)


def test_stages_let_go_of_their_tables(spark, edge):
    """At most one stored table is left of a stage's work, and its result can still be read."""
    docs = spark.read.parquet(f"{edge}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        before = len(kept._paths.get(spark.sparkContext.applicationId, []))
        out = stage(spark, docs, edge)
        assert len(kept._paths.get(spark.sparkContext.applicationId, [])) <= before + 1, name
        assert out.count() > 0, name


def shuffled(spark):
    """The shuffle files that Spark keeps now."""
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f"{d}/{f}" for top in dirs for d, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}


def gone(spark, before):
    """Whether nothing has come to `before`; files are deleted in the background."""
    for _ in range(100):
        if not shuffled(spark) - before:
            return True
        time.sleep(0.1)
    return False


def test_no_shuffle_files_are_left_of_a_stored_table(spark):
    before = shuffled(spark)
    counts = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    out = kept.written(counts.join(counts.withColumnRenamed("count", "n"), "k"), "counts")
    assert gone(spark, before)
    assert out.agg(F.sum("count"), F.sum("n")).first() == (1000, 1000)
    assert sorted(r["count"] for r in counts.collect()) == [142, *[143] * 6]  # what was stored can be computed again


def test_no_shuffle_files_are_left_of_line_dedup(spark):
    """Neither while its second half runs nor at its end: all that is left is the stored result."""
    rng = random.Random(7)
    shared = prose(rng, 60)
    docs = spark.createDataFrame([(i, f"{prose(rng, 70)}. {shared}. {prose(rng, 9)}", None) for i in range(20)], "doc_id bigint, text string, n_chars bigint").coalesce(2)
    docs = kept.written(docs, "docs")
    before, at = shuffled(spark), []

    def watched(some, *args, f=corpus_pipeline.passages.deduplicated, **more):
        at.append(gone(spark, before))
        return f(some, *args, **more)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(corpus_pipeline.passages, "deduplicated", watched)
        out = corpus_pipeline.lines(spark, docs, "")
    assert at == [True] and gone(spark, before)
    assert sum(shared in r.text for r in out.collect()) == 1


@pytest.mark.parametrize("own", [None, "true", "false"])
def test_storing_leaves_the_sessions_settings(spark, own):
    def now():
        return spark.conf.get(kept.SWEEP, None)

    if own:
        spark.conf.set(kept.SWEEP, own)
    try:
        before = now()
        kept.written(spark.range(3), "three")
        assert now() == before
        with pytest.raises(PySparkException):
            kept.written(spark.range(3).select(F.raise_error(F.lit("no"))), "none")
        assert now() == before and not kept._sweeping
    finally:
        spark.conf.unset(kept.SWEEP)
