"""A training-data pipeline of five operators: toxicity, near-duplicates, benchmark leaks, personal data, token ids."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cellforge.llm import common, decontaminate, pieces, pii, simhash, toxicity

def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs but those that the toxicity grammar, learned from the labels, scores 0.7 or more.

    Rows are scored alone: repeated rows stay or go together, null and empty texts stay, no rows give none.
    """
    common.few_rows(spark)
    lexicon = toxicity.fit_tables(spark, sf_dir)
    return toxicity.score(docs, lexicon, column="toxic_score").where("toxic_score < 0.7").drop("toxic_score")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest doc_id, null ones last; rows are told apart by doc_id and text.

    Of rows that repeat both, one stays; texts without a word, null ones too, are one group; no rows give none.
    """
    common.few_rows(spark)
    return simhash.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs but those that hold four fifths of the five-word shingles of a benchmark item.

    Rows are judged alone: repeated rows stay or go together; null and empty texts stay, as all do without a benchmark.
    """
    common.few_rows(spark)
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with personal data replaced by its kind; all rows stay, repeated ones alike, null and empty texts as they are."""
    common.few_rows(spark)
    return pii.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of each text as piece ids, with their inclusion scores.

    One row where a text has one segmentation, as null and empty texts do; repeated rows repeat their samples; no rows give none.
    """
    common.few_rows(spark)
    return pieces.sample(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("decontaminate", drop_leaks),
    ("pii", redact_personal_data),
    ("pieces", encode),
]

#: No SQL: neither the learned grammar nor sampled segmentations are expressible; a test holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
