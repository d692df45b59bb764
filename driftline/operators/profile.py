"""Descriptive dashboard operators: counts, shares, top-N, class distribution.

Every aggregate is a plain ``groupBy`` (partial aggregation before the
shuffle).  Totals that every group row needs are taken over the already
aggregated rows, whose number is the number of groups, never the input.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.session import cut_lineage


def count_where(df: DataFrame, predicate: Column | None = None, name: str = "n") -> DataFrame:
    """A1: exact ``COUNT(*)`` under an optional predicate (one row)."""
    if predicate is not None:
        df = df.filter(predicate)
    return df.agg(F.count(F.lit(1)).alias(name))


def year_equals(col: str | Column, year: int) -> Column:
    """``CAST(an AS INTEGER) = year`` that tolerates junk text (try_cast)."""
    c = F.col(col) if isinstance(col, str) else col
    return c.cast("string").try_cast("int") == F.lit(year)


def in_year(col: str | Column, year: int) -> Column:
    """P7 on a date or timestamp: a half-open range, which reaches the parquet scan as a pushed filter."""
    c = F.col(col) if isinstance(col, str) else col
    return (c >= F.lit(f"{year:04d}-01-01").cast("timestamp")) & (c < F.lit(f"{year + 1:04d}-01-01").cast("timestamp"))


def group_count(df: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    """A3: ``SELECT k, COUNT(*) GROUP BY k``."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def case_label(col: str | Column, labels: Mapping[str, str], default: str) -> Column:
    """``CASE WHEN c = code THEN label ... ELSE default END``."""
    c = F.col(col) if isinstance(col, str) else col
    expr = None
    for code, label in labels.items():
        expr = (F.when(c == F.lit(code), F.lit(label)) if expr is None
                else expr.when(c == F.lit(code), F.lit(label)))
    return F.lit(default) if expr is None else expr.otherwise(F.lit(default))


def share_of_total(grouped: DataFrame, count_col: str = "n", name: str = "pct",
                   scale: int | None = None) -> DataFrame:
    """``count * 100.0 / total`` where total is the sum over all groups.

    The aggregated rows are written once (``checkpoint``, one row per
    group) and the total is a one-row scalar subquery over them (the
    one-row cross join of the SQL form): the input is read once and the
    group rows stay spread over their partitions however many there are.
    """
    grouped = cut_lineage(grouped)
    total = grouped.agg(F.sum(F.col(count_col))).scalar()
    pct = F.col(count_col) * F.lit(100.0) / total
    if scale is not None:
        pct = F.round(pct, scale)
    return grouped.withColumn(name, pct)


def share_by_condition(df: DataFrame, label: Column, predicate: Column | None = None,
                       scale: int = 4) -> DataFrame:
    """Dashboard 'share of rows per condition' (filter -> label -> count -> share)."""
    if predicate is not None:
        df = df.filter(predicate)
    grouped = df.groupBy(label.alias("condition")).agg(F.count(F.lit(1)).alias("n"))
    return share_of_total(grouped, "n", "pct", scale)


def top_groups(df: DataFrame, key: str, n: int = 10, name: str = "n") -> DataFrame:
    """Top ``n`` groups by count, ties broken by key (TakeOrderedAndProject)."""
    return (df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
              .orderBy(F.col(name).desc(), F.col(key).asc()).limit(n))


def binary_distribution(df: DataFrame, target: str, positive: list, labels=("severe", "other"),
                        scale: int = 2) -> DataFrame:
    """A4: positive vs. rest counts and percentages (empty when there are no rows).

    One pass of conditional sums, then ``stack`` into two rows.
    """
    in_pos = F.col(target).isin(*positive)
    agg = df.agg(F.sum(F.when(in_pos, 1).otherwise(0)).cast("bigint").alias("_pos"),
                 F.sum(F.when(in_pos, 0).otherwise(1)).cast("bigint").alias("_neg"),
                 F.count(F.lit(1)).alias("_total"))
    rows = agg.filter(F.col("_total") > 0).select(
        F.expr(f"stack(2, '{labels[0]}', _pos, '{labels[1]}', _neg) AS (class, n)"),
        F.col("_total"))
    return rows.select("class", F.col("n").cast("bigint").alias("n"),
                       F.round(F.col("n") * F.lit(100.0) / F.col("_total"), scale).alias("pct"))


def null_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null count per column, one pass, returned long (column, n_null, n_rows)."""
    aggs = [F.count_if(F.col(c).isNull()).alias(f"_n{i}") for i, c in enumerate(columns)]
    one = df.agg(F.count(F.lit(1)).alias("_rows"), *aggs)
    pairs = ", ".join(f"'{c}', _n{i}" for i, c in enumerate(columns))
    return one.select(F.expr(f"stack({len(columns)}, {pairs}) AS (column_name, n_null)"),
                      F.col("_rows").alias("n_rows"))
