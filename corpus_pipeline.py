"""A training corpus pipeline in five stages.

Each stage takes (spark, docs, sf_dir), where docs has the columns of documents, and returns
a DataFrame that is written as Parquet and read again as the docs of the next. All stages but
the last return the columns of documents.

Nulls and empty texts: the classifier scores them by their statistics; near_dups keeps them
(they have no shingles); secrets leaves them; mixing keeps texts without words, which weigh
nothing; encoding gives them no pieces. Extra columns pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from soundings.llm import minhash, mixing, pieces, rules, secrets
from soundings.llm._shared import remove, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rule ensemble, fitted on the labelled ones among docs, does not reject."""
    return rules.accept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group linked by similarity 0.8 of five-word shingles."""
    return minhash.keep_first(docs, n=5)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each reported secret replaced by [SECRET] and n_chars counted anew where present."""
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes the whole of it (to the nearest whole number); documents without words once."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids, round_trip of each document."""
    return pieces.encode(docs)


STAGES = [("quality", quality), ("near_dups", near_dups), ("secret_scan", secret_scan), ("mix", mix), ("encode", encode)]

#: The stages learn a model, compare sets and search shortest paths, which SQL cannot state; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        kept = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        remove(docs)  # the table of the stage before; the input is none of ours
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
