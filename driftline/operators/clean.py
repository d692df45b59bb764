"""Schema alignment, null handling, domain validation, defaults and lookups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.coerce import clean_header


class DomainError(ValueError):
    """Raised by strict validation when any row breaks the domain."""


def align_columns(df: DataFrame, wanted: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Clean headers, keep wanted columns that exist (in wanted order).

    Returns the projected frame and the sorted list of missing names.
    Metadata-only: nothing but the final projection reaches the plan.
    """
    df = df.toDF(*clean_header(df.columns))
    present = [c for c in wanted if c in df.columns]
    missing = sorted(set(wanted) - set(df.columns))
    return df.select(*present), missing


def require_columns(df: DataFrame, required: Sequence[str]) -> None:
    """P5: raise listing the missing required columns."""
    if absent := sorted(set(required) - set(df.columns)):
        raise ValueError("required columns are absent: " + ", ".join(absent))


def drop_null_rows(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """Drop rows with a NULL in any of ``subset``."""
    return df.na.drop(how="any", subset=list(subset))


def _violation(col: str, rule) -> Column:
    c = F.col(col)
    if isinstance(rule, tuple):  # inclusive range (lo, hi)
        ok = c.between(F.lit(rule[0]), F.lit(rule[1]))
    else:
        ok = c.isin(*rule)
    # an explicit NULL is a violation too (it is not an absent field)
    return F.when(ok.isNull() | ~ok, F.lit(col))


def domain_violations(df: DataFrame, domain: Mapping[str, object]) -> Column:
    """``ARRAY<STRING>`` of the columns whose value lies outside its domain.

    ``domain`` maps a column to a closed list of values or an inclusive
    ``(lo, hi)`` range.
    """
    checks = [_violation(c, rule) for c, rule in domain.items() if c in df.columns]
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def validate(df: DataFrame, domain: Mapping[str, object], mode: str = "lenient") -> DataFrame:
    """Add ``violations``; strict mode fails the whole batch if any row breaks.

    Lenient mode returns all rows with the array so callers can quarantine
    (``size(violations) > 0``) or keep the clean rows.
    """
    out = df.withColumn("violations", domain_violations(df, domain))
    if mode == "strict":
        bad = out.filter(F.size("violations") > 0).limit(1).collect()
        if bad:
            raise DomainError(f"row outside its domain: {bad[0].asDict()}")
    return out


def fill_absent(df: DataFrame, fields: Sequence[str], default=1) -> DataFrame:
    """Add absent fields with a default; present NULLs stay NULL (invalid)."""
    missing = [f for f in fields if f not in df.columns]
    return df.withColumns({f: F.lit(default) for f in missing}).select(*fields) if missing \
        else df.select(*fields)


def encode_lookup(df: DataFrame, col: str, dictionary: Mapping, out: str, default=1) -> DataFrame:
    """code/label lookup with a default.

    The dictionary is a literal map of bounded, known size, so it is
    broadcast; larger dictionaries should be passed as a DataFrame to
    :func:`lookup_join` and left to AQE.
    """
    spark = df.sparkSession
    dict_df = spark.createDataFrame([(k, v) for k, v in dictionary.items()], ["_code", "_value"])
    return lookup_join(df, col, F.broadcast(dict_df), "_code", "_value", out, default)


def lookup_join(df: DataFrame, col: str, dict_df: DataFrame, key: str, value: str, out: str,
                default=1) -> DataFrame:
    joined = df.join(dict_df, df[col] == dict_df[key], "left")
    return joined.withColumn(out, F.coalesce(F.col(value), F.lit(default))).drop(key, value)
