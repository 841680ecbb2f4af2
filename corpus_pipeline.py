"""A training-data pipeline of five stages over ``documents``.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; ``run``
writes each stage's rows as Parquet in the shared folder and reads them back for the next. All
stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casefile.llm import language_id, mixing, near_duplicates, sentencepiece_bpe, substring_dedup
from casefile.llm.common import written
from casefile.llm.queries import PIECES
from casefile.session import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near-duplicates: sets of five-word shingles, a similarity of 80 % or more.
NEAR = {"shingle": 5, "percent": 80}

#: Words in a block of the mix: long enough to keep most documents whole.
MIX_BLOCK = 512


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a margin; lang becomes the prediction. Null and empty
    texts, and texts without a letter, are rejected. Repeated rows are judged alike."""
    ship(spark)
    model = language_id.fit(docs.filter(~language_id.held_out("doc_id")))
    out = language_id.identify_language(docs.select(*COLUMNS), model).filter(~F.col("rejected"))
    return out.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id. Pairs that
    SimHash anchors link, and pairs that share a MinHash key, are verified by their whole sets of
    five-word shingles. Null, empty and blank texts are one group. Rows are told apart by all of their
    columns, so that none goes for want of a doc_id; equal rows are copies."""
    ship(spark)
    return near_duplicates.one_of_each(docs.select(*COLUMNS), **NEAR)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that a repeated window of 35 covers are removed; a text left without words goes. Null and
    empty texts have no words to lose and stay; repeated rows lose all that their windows cover."""
    ship(spark)
    out = substring_dedup.substring_dedup(docs.select(*COLUMNS), carry=["lang", "source"])
    left = out.filter("n_words = 0 or n_removed < n_words").withColumnRenamed("kept_text", "text")
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document: a row for each of its epochs that take any; a
    document that an epoch takes whole keeps its text as it is. Texts without words, null ones too, have
    nothing to take and go; equal rows are one document."""
    ship(spark)
    return mixing.mix_texts(docs.select(*COLUMNS), block=MIX_BLOCK)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and the text that they decode to; null and empty texts have the end id only."""
    ship(spark)
    return sentencepiece_bpe.sentencepiece_encode(docs.select(*COLUMNS), PIECES, decoded="decoded")


STAGES = [("language", language), ("near_dedup", near_dedup), ("repeats", repeats), ("mixture", mixture), ("pieces", pieces)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs, f"stage-{name}")
    return docs


#: Fingerprints, compression and pseudorandom permutations have no counterpart in SQL.
ORACLE_SQL = None
