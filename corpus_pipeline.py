"""The corpus pipeline: five stages from raw documents to packed training sequences.

Each stage works on all documents that its predecessor kept; all but the last return the columns of ``documents``.  Decisions
are taken row by row and on whole texts: null keys and very long texts are rows like others, repeated rows are decided alike,
columns beyond those of ``documents`` are carried along, and empty tables give empty tables.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import bpe, jaccard, langid, packing, pii, queries, toxicity
from tidemill.llm.cut import cut
from tidemill.session import ship, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Five words a shingle, and a similarity of 0.8 or more.
NEAR = jaccard.Rule(words=5, num=80, den=100)
#: The id behind each document: above all ranks of the vocabulary.
END = 0xFFFF
#: Rows that Spark hands to a Python worker at once: whole texts are long, and both sides hold such a batch more than once.
ROWS = 2_000


def few_at_once(stage: Stage) -> Stage:
    """The stage, with batches of ``ROWS`` rows wherever it hands rows to Python."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS)
        return stage(spark, docs, sf_dir)

    return run


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, fitted on the labels, doesn't find toxic; a null or empty text has the base rate and stays."""
    chain = toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.production_categories())
    return toxicity.keep_clean(docs, chain)


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the random field can tell; a text without letters, null and empty ones too, goes."""
    return langid.keep_identified(docs, langid.fit(docs))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the first row by id and text, once; rows without words or id stay."""
    return jaccard.keep_first(docs, NEAR)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked and terms that give it away generalised or removed; null texts stay null, empty ones empty."""
    return pii.sanitise(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, encoded, in training sequences: a row for each with its ids and where they come from; a null text counts as empty."""
    encoded = cut(bpe.encode(docs, queries.rank_file, public_tokenizers.PATTERN))
    return packing.pack(encoded, F.col("ids"), end=END)


STAGES = [
    ("toxicity", few_at_once(keep_clean)),
    ("language", few_at_once(keep_identified)),
    ("near_duplicates", few_at_once(keep_one_of_each_group)),
    ("pii", few_at_once(mask_personal_data)),
    ("packing", few_at_once(pack_sequences)),
]

#: SQL expresses neither the classifiers nor best-fit packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again as the next one's input."""
    docs = table(ship(spark), sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
