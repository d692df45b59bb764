"""Parquet table scans with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftline.schemas import TABLES


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan; Catalyst prunes columns and pushes filters into it."""
    return spark.read.schema(TABLES[name]).parquet(table_path(sf_dir, name))


class Tables:
    """Lazy accessor: ``t.lineitem`` reads ``<sf_dir>/lineitem.parquet``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return read_table(self.spark, self.sf_dir, name)
        raise AttributeError(name)
