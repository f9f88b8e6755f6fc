"""Documents to a token corpus: quality, near-duplicates, benchmark leaks, mixture and token files, in this order."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quayside.llm.common import Scratch, table
from quayside.llm.decontaminate import drop_contaminated
from quayside.llm.mixing import sample_mix
from quayside.llm.near_dedup import keep_one
from quayside.llm.quality import keep_good
from quayside.llm.queries import MIX_TARGETS
from quayside.llm.token_files import token_output

#: Share of the tokens that the mixture keeps.
MIX_BUDGET = 0.8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five words, similarity of 0.8 or more."""
    return keep_one(docs, percent=80, width=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item, or a whole shorter one, go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens approach the target weights."""
    return sample_mix(docs, MIX_TARGETS, MIX_BUDGET)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in ascending doc_id order; each document's place in them, as read back."""
    return token_output(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token files", token_files),
]

#: No SQL states a fitted classifier, MinHash groups or a tokenizer; tests/llm/test_pipeline.py compares by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each on what the one before it kept; the last one's rows.

    Each stage is written as Parquet and read again, and the stage before it is then dropped. What a stage does with
    nulls in any column, empty and very long texts, ties, repeated rows, empty tables and clashing column names is the
    rule of the operator that it calls; all but the last return the columns of documents. An empty table gives no rows.
    """
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            scratch.drop(f"stage-{k - 1}")
    return docs
