"""Value -> label / band / display expressions (all built-in Catalyst functions)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def pct_normalize(col: str | Column, digits: int = 1) -> Column:
    """a ratio in [0, 1] becomes a percentage; other values are only rounded."""
    c = _c(col).try_cast("double")
    return F.when(c.between(0, 1), F.round(c * 100, digits)).otherwise(F.round(c, digits))


def band(col: str | Column, thresholds: Sequence[float], names: Sequence[str]) -> Column:
    """generic band: ``names[i]`` for the first ``value <= thresholds[i]``...

    ``thresholds`` ascending; value above the last threshold -> ``names[-1]``.
    Comparison is strict ``>`` as in the reference panels (``> t`` moves up).
    """
    c = _c(col)
    if len(names) != len(thresholds) + 1:
        raise ValueError("need one more name than thresholds")
    expr = None
    for t, name in zip(reversed(thresholds), reversed(names[1:])):
        expr = (F.when(c > F.lit(t), F.lit(name)) if expr is None
                else expr.when(c > F.lit(t), F.lit(name)))
    return F.when(c.isNull(), F.lit(None).cast("string")) if expr is None else \
        F.when(c.isNull(), F.lit(None).cast("string")).otherwise(expr.otherwise(F.lit(names[0])))


def drift_severity(col: str | Column) -> Column:
    """> 0.3 high, > 0.1 medium, else low."""
    return band(col, [0.1, 0.3], ["low", "medium", "high"])


def severity_label(col: str | Column, positive: int = 1) -> Column:
    """class text label."""
    return F.when(_c(col) == positive, F.lit("Grave")).otherwise(F.lit("Pas Grave"))


def log_level(label: Column, message: Column) -> Column:
    """the stream's level label, else 'error' if the message mentions it, else 'warning'."""
    inferred = F.when(F.lower(message).contains("error"), F.lit("error")).otherwise(F.lit("warning"))
    return F.coalesce(F.nullif(label, F.lit("")), inferred)


def iso_utc(ts: str | Column) -> Column:
    """ISO-8601 UTC text with microseconds and a trailing Z."""
    return F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def mib_text(col: str | Column, digits: int = 1) -> Column:
    """a byte count as text in MiB."""
    return F.format_string(f"%.{digits}f MiB", _c(col) / F.lit(1024.0 * 1024.0))


def thousands(col: str | Column) -> Column:
    """an integer with a space as the thousands separator ("1 234 567")."""
    return F.translate(F.format_number(_c(col).cast("long"), 0), ",", " ")
