"""Operators called directly on a table with nulls, repeated rows, one id on several texts and columns named like results."""

from __future__ import annotations

import public_tokenizers as P
import pytest
from helpers import rows, table

from quarry.llm import licenses, line_dedup, ngram_join, packing, passages, quality_rules, secrets, sentencepieces, sharding, toxicity

BIG = 2**60 + 1


@pytest.fixture(scope="module")
def odd(spark):
    """The edge table, with two further texts of ids that it has and two more rows without an id."""
    more = [(i, t, "en", None, 1, 1, 0.5, True, 9, 2, 3, "t", "h", "d") for i, t in ((3, "another text of the same id"), (BIG, rows()[2][1]), (BIG, "one"), (None, "text of its own"), (None, None))]
    return table(spark, rows() + more).withColumnsRenamed({"tokens": "_salt", "d": "_k", "h": "o"}).cache()


def ids(df):
    return sorted(str(r.doc_id) for r in df.select("doc_id").collect())


def test_every_row_has_a_result(spark, odd):
    model = toxicity.Model(*(lambda k: (k, k.astype(float), 0.0))(toxicity._public()))
    everything = [
        sharding.sharded(odd, 5), quality_rules.judged(odd), toxicity.scored(odd, model), licenses.by_document(odd), ngram_join.joined(odd),
        secrets.scanned(odd, P.path("byte_bpe_50k.tiktoken"), P.PATTERN), sentencepieces.coded(odd, P.path("piece_bpe_32k.model")),
        packing.packed(odd, P.path("word_bpe_49k.json")).filter("start = 0"),
    ]
    for out in everything:
        assert ids(out) == ids(odd)


def test_columns_are_kept(spark, odd):
    for out in (line_dedup.deduplicated(odd), passages.deduplicated(odd)):
        assert set(odd.columns) <= set(out.columns) and ids(out) == ids(odd)
        assert {r._salt for r in out.select("_salt").collect()} == {r._salt for r in odd.select("_salt").collect()}
    assert ngram_join.deduplicated(odd).columns == odd.columns


def test_one_id_on_two_texts_keeps_what_occurs_once(spark):
    own, shared = ("\n".join(" ".join(f"{x}{k}{j}" for j in range(25)) + "." for k in range(4)) for x in "ab")
    for dedup in (line_dedup.deduplicated, passages.deduplicated):
        df = spark.createDataFrame([(1, shared), (5, own), (5, shared + "\nwords"), (None, own), (BIG, shared)], "doc_id bigint, text string")
        got = sorted((str(r.doc_id), len((r.text or "").split())) for r in dedup(df).collect())
        kept = dict([("1", 100)]) | {str(BIG): 0, "None": 0}
        assert [g for g in got if g[0] in kept] == sorted(kept.items())
        assert sorted(n for d, n in got if d == "5") == [1, 100]
