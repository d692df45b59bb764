"""Tables of the session catalog: replace loads and estimated counts (K2, K3, A2).

Managed tables live in a database whose location lies below the shared
checkpoint folder, so every machine sees their files.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.session import scratch_path

DATABASE = "driftline"


def table_name(spark: SparkSession, base: str) -> str:
    """A fresh qualified name; the database is made on first use."""
    if not spark.catalog.databaseExists(DATABASE):
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {DATABASE} LOCATION '{scratch_path(spark, 'catalog')}'")
    return f"{DATABASE}.{base}_{uuid.uuid4().hex[:12]}"


def replace_table(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """K2: load ``df`` as table ``name``, replacing what it held, and read it back."""
    writer = df.write.mode("overwrite").format("parquet")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def drop_and_replace(df: DataFrame, name: str) -> DataFrame:
    """K3: drop the table if it exists, then create it from ``df``; the schema may change between loads."""
    df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    return replace_table(df, name)


def analyze(spark: SparkSession, name: str) -> None:
    """Let the catalog keep the table's row count."""
    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS")


def estimated_count(spark: SparkSession, name: str) -> tuple[int, bool]:
    """A2: (row count of the catalog's statistics, True), or (exact count, False) without a positive one."""
    stats = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").filter(F.col("col_name") == "Statistics").first()
    rows = re.search(r"(\d+) rows", stats["data_type"]) if stats else None
    if rows and int(rows.group(1)) > 0:
        return int(rows.group(1)), True
    return spark.table(name).count(), False
