"""Imputation, target binarisation, standardisation and dummy encoding.

Statistics (modes, means, deviations, levels) are computed with
distributed aggregates and only their one-row / #columns-row result
reaches the driver, where it becomes literals in the next projection.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_LEVELS = 10_000


def _stack(cols: Sequence[str], cast: str) -> str:
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS {cast})" for c in cols)
    return f"stack({len(cols)}, {pairs}) AS (column_name, value)"


def column_modes(df: DataFrame, cols: Sequence[str]) -> dict:
    """Most frequent non-null value per column, smallest on ties.

    One pass for all columns of a type, which is kept: unpivot -> ``groupBy(column, value).count``
    (map-side partial counts) -> per column ``min_by(value, (-count, value))``.
    The hash aggregate never holds a whole column in one task. NaN counts as missing.
    """
    types = dict(df.dtypes)
    out: dict = {}
    groups: dict[str, list[str]] = {}
    for c in cols:
        groups.setdefault(types[c], []).append(c)
    for kind, cs in groups.items():
        number = kind in ("float", "double")
        present = F.col("value").isNotNull() & (~F.isnan("value") if number else F.lit(True))
        counts = (df.select(F.expr(_stack(cs, kind))).filter(present)
                    .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n")))
        modes = counts.groupBy("column_name").agg(
            F.min_by("value", F.struct((-F.col("n")).alias("nn"), F.col("value").alias("v"))).alias("mode"))
        for r in modes.collect():  # <= #columns rows
            out[r["column_name"]] = r["mode"]
    return out


def impute_mode(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """M1: ``fillna(mode)`` for every listed column (the target too, as the reference does)."""
    modes = column_modes(df, cols)
    types = dict(df.dtypes)
    return df.withColumns({
        c: F.coalesce(F.nanvl(F.col(c), F.lit(None).cast(types[c])) if types[c] in ("float", "double") else F.col(c),
                      F.lit(v).cast(types[c]))
        for c, v in modes.items() if v is not None})


def binarize(col: str | Column, positive: Sequence, name: str | None = None) -> Column:
    """1 when the code is in ``positive``, else 0."""
    c = F.col(col) if isinstance(col, str) else col
    out = F.when(c.isin(*positive), F.lit(1)).otherwise(F.lit(0))
    return out.alias(name) if name else out


def fit_standard(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Population mean and std (ddof = 0) per column in one aggregate."""
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.avg(c).alias(f"m{i}"), F.stddev_pop(c).alias(f"s{i}")]
    r = df.agg(*aggs).first()
    return {c: (r[f"m{i}"], r[f"s{i}"]) for i, c in enumerate(cols)}


def apply_standard(df: DataFrame, stats: dict[str, tuple[float, float]], digits: int | None = None,
                   suffix: str = "") -> DataFrame:
    """(x - mean) / std with std = 0 replaced by 1."""
    cols = {}
    for c, (m, s) in stats.items():
        scale = 1.0 if (s is None or s == 0) else float(s)
        z = (F.col(c) - F.lit(float(m))) / F.lit(scale)
        cols[c + suffix] = F.round(z, digits) if digits is not None else z
    return df.withColumns(cols)


def standardize(df: DataFrame, cols: Sequence[str], digits: int | None = None) -> DataFrame:
    return apply_standard(df, fit_standard(df, cols), digits)


def dummy_levels(df: DataFrame, col: str, max_levels: int = MAX_LEVELS) -> list:
    """Sorted non-null levels; an error when there are more than ``max_levels``."""
    levels = [r[0] for r in df.select(col).distinct().filter(F.col(col).isNotNull())
              .limit(max_levels + 1).collect()]
    if len(levels) > max_levels:
        raise ValueError(f"{col} has over {max_levels} levels: use layout='vector'")
    return sorted(levels)


def one_hot(df: DataFrame, col: str, levels: Sequence | None = None, drop_first: bool = True,
            max_levels: int = MAX_LEVELS, layout: str = "columns") -> DataFrame:
    """M2: the levels of a text column as 0/1 figures, first level dropped; numeric columns pass through.

    ``layout="columns"`` gives int columns ``<col>_<level>`` and refuses more than ``max_levels`` of them;
    ``layout="vector"`` gives the same encoding as one sparse vector ``<col>_vec`` at any number of levels.
    The schema follows from the layout asked for, never from the size of the data.
    """
    if not isinstance(df.schema[col].dataType, T.StringType):
        return df
    if layout == "vector":
        return _one_hot_vector(df, col, drop_first)
    if layout != "columns":
        raise ValueError(f"unknown layout {layout!r}")
    levels = sorted(levels) if levels is not None else dummy_levels(df, col, max_levels)
    keep = levels[1:] if drop_first else levels
    dummies = {f"{col}_{lv}": (F.col(col) == F.lit(lv)).cast("int") for lv in keep}
    return df.withColumns(dummies).drop(col)


def _one_hot_vector(df: DataFrame, col: str, drop_first: bool) -> DataFrame:
    """Exact ``get_dummies`` semantics as one sparse vector: NULL (and, with
    ``drop_first``, the alphabetically first level) encode as all zeros.

    Levels are indexed alphabetically; the excluded values are mapped to
    one sentinel index placed last, which ``dropLast`` removes.
    """
    from pyspark.ml.feature import OneHotEncoder, StringIndexer
    idx = StringIndexer(inputCol=col, outputCol="_lvl", stringOrderType="alphabetAsc",
                        handleInvalid="keep").fit(df)
    n = len(idx.labels)                      # NULL / unseen -> index n
    i = F.col("_lvl")
    if drop_first:                           # levels 1..n-1 -> 0..n-2, sentinel n-1
        code = F.when((i >= 1) & (i < n), i - 1).otherwise(F.lit(float(n - 1)))
    else:                                    # levels 0..n-1 kept, sentinel n
        code = F.when(i < n, i).otherwise(F.lit(float(n)))
    x = idx.transform(df).withColumn("_code", code)
    enc = OneHotEncoder(inputCols=["_code"], outputCols=[f"{col}_vec"], dropLast=True).fit(x)
    return enc.transform(x).drop(col, "_lvl", "_code")
