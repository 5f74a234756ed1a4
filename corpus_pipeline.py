"""The corpus pipeline: toxicity, line dedup, near-duplicate join, secret scans, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as Parquet and read again as the
next stage's docs. All stages but the last return the columns of documents.

In every stage a row is told apart by its id and its text's hash, so one id, or none, may stand for several texts; further
columns are kept whatever their names (the last stage leaves them out); an empty table gives no rows; texts are worked on
whole, however long. What else holds for nulls, empty texts, ties and repeated rows is said at each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import line_dedup, ngram_join, packing, passages, secrets, toxicity
from quarry.llm.common import WORD, settled, table, written


#: A document that lost text stays if it has so many words left, or at least a quarter of its characters.
LEAST_WORDS = 50


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model accepts. It learns from the labelled rows among docs.

    Null and empty texts have the score of a text without any toxic word and stay; repeated rows stay or go together; without
    labels of both kinds the public list alone decides.
    """
    return toxicity.accepted(docs, toxicity.trained(docs, table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of lines, and passages of over 50 words inside them, stay where they come first.

    A document goes of which only a scrap is left: fewer than LEAST_WORDS words and less than a quarter of its characters; it was a
    copy or near copy, or made of others' passages. All that lost nothing stay, null and empty texts among them. First is the
    least id, null last, of one id the least hash of the text; repeated rows of one id and text are one text.
    """
    before = docs.withColumn("__q_length", F.length("text"))

    def left() -> DataFrame:
        some = settled(spark, lambda: line_dedup.deduplicated(before, length="n_chars"), "lines")
        out = passages.deduplicated(some, length="n_chars")
        whole = (F.col("n_gone") + F.col("n_cut") == 0) | (4 * F.length("text") >= F.col("__q_length"))
        return out.filter(whole | (F.regexp_count("text", F.lit(WORD)) >= LEAST_WORDS)).select(*docs.columns)

    return settled(spark, left, "left")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of five-word shingles, similarity 0.8 and more, connect: the one of the least id
    (null last; of one id the one of the least hash of the text). Rows without words, and with null texts, are in no group and
    all stay; of repeated rows one stays."""
    return ngram_join.deduplicated(docs, width=5, similarity=0.8).select(*docs.columns)


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked and n_chars kept true. Null texts stay null; repeated rows are masked alike."""
    return secrets.redacted(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, length="n_chars").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens. Null and empty texts have the end id alone; repeated rows are packed one by one."""
    out = packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"), digests=True)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("toxicity", toxic), ("line dedup", lines), ("n-gram Jaccard join", near), ("secret scans", masked), ("packing", packed)]

#: SQL can't express the model, the merges and the token test.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
