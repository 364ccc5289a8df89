"""The corpus pipeline: quality, line dedup, near-duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of ``documents``.
Every stage works on all that the one before kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmart.llm import decontamination, lines, packing, quality, simhash
from quillmart.llm.common import free_name, stored


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold; null and empty texts are scored like any other.

    The machine learns from the labelled rows of the whole ``documents`` table that aren't held out. Repeated rows and
    null doc_ids are decided row by row; columns may have any names and are kept.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    machine = quality.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels)
    score = free_name("_quality_score", docs.columns)
    return quality.score(docs, machine, score).where(F.col(score) >= quality.THRESHOLD).select(*docs.columns)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand earlier; those left without any go.

    Null and empty texts and rows with a null doc_id stay; rows of a repeated doc_id are documents of their own.
    """
    return lines.without_repeats(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: five-word shingles, a similarity of 0.8.

    The smallest doc_id stays, with all its rows. Null and empty texts are alike, so one of them stays; rows with a
    null doc_id stay.
    """
    return simhash.keep_one(docs, simhash.WIDE)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage; null and empty texts hold none, and each row is decided by itself."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining documents in sequences of at most 1024 tokens, ids included."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality classifier", good), ("line dedup", fresh_lines), ("near-dedup", one_of_each), ("decontamination", uncontaminated), ("packing", packed)]

#: A trained classifier, fuzzy links and a tokenizer's ids are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; each one's result is written in the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
