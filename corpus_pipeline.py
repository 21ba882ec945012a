"""From raw documents to packed training sequences.

Each stage takes all that its predecessor kept: documents of low quality go, repeated lines are taken
out, one document of each group of near duplicates stays, the rest is mixed to target shares of its
sources in training order, and packed into sequences of tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm import lines, mixing, packing, quality, shingles
from skyloom.llm.common import load, materialize
from skyloom.llm.queries import tokenizer_path


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model, fitted on the labels, does not reject."""
    model = quality.learn(docs, load(spark, sf_dir, "labels"), F.lit(True))
    return quality.keep_good(docs, model)


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat or nearly repeat others."""
    return lines.dedup_lines(docs, **lines.WHOLE)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: SimHash fingerprints at three bits or fewer, as in op2, or sets of shingles of five words at a similarity of 0.8."""
    return shingles.drop_near_copies(docs, fingerprints=True)


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, as often as the mix takes them."""
    return mixing.curriculum_mix(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the training sequences."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality", good_documents),
    ("line dedup", distinct_lines),
    ("near duplicates", distinct_documents),
    ("mixing", mixed_documents),
    ("packing", packed_sequences),
]
#: SQL can express neither the classifier nor the fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each one keeps is written to the shared folder before the next one reads it."""
    docs = load(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name.replace(' ', '-')}")
    return docs
