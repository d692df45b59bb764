"""From raw documents to sampled token ids: quality, toxicity, near-duplicates, mix, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftline.llm import mixing, quality_rules, sampled_pieces, simhash, toxicity
from driftline.llm.queries import table, vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.keep(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic."""
    return toxicity.filter_toxic(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.deduplicate(docs, shingle=3, max_bits=2)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents mixed to the sources' weights; a row for each copy taken."""
    return mixing.take(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a sampled segmentation."""
    return sampled_pieces.encode(docs, vocabulary("piece_bpe_32k.model"))


STAGES = [("quality rules", quality), ("toxicity", clean), ("simhash near-dedup", distinct), ("mixing sources", mixed),
          ("sentencepiece encoding", encoded)]
#: Hashes and sampled pieces are beyond SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents, each stage's rows written as a table for the next."""
    from driftline.llm.common import staged

    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs, name.replace(" ", "-"))
    return docs
