"""A training-text pipeline of five stages, each one of the text operators.

A stage takes the rows that its predecessor kept, and its result is written as Parquet and read again
before the next one. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweft.llm.chosen_path import keep_one
from pixelweft.llm.common import table
from pixelweft.llm.fertility import keep_good
from pixelweft.llm.gumbel_pieces import encode_samples
from pixelweft.llm.line_dedup import drop_boilerplate
from pixelweft.llm.phrase_index import drop_contaminated
from pixelweft.runtime import discard, materialize, scratch, workspace

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the fertility bands reject go."""
    return keep_good(docs, PIECES, workspace(spark, "quality"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of each source go; a document with most of its words in such lines stays as it is. n_chars follows the text."""
    done = drop_boilerplate(docs, workspace(spark, "lines"), host_col="source", keep_whole=True)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("pw_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return done.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, that with the smallest id."""
    return keep_one(docs, workspace(spark, "near")).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a phrase of the benchmark go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"), workspace(spark, "phrases")).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of each document, ids as 16-bit numbers, with inclusion scores."""
    return encode_samples(docs, PIECES, k=2, packed=True)


STAGES = [
    ("quality rules", quality),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding", encoding),
]

#: Fertility, near copies and sampled segmentations have no SQL form; tests hold the rows against a brute-force run.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = workspace(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with scratch(spark):
            docs = materialize(stage(spark, docs, sf_dir), f"{out}/{k}")
        if k:
            discard(spark, f"{out}/{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
