"""Reproducible pseudo-random draws from row keys (same numbers in any SQL engine).

``draw(key, salt)`` = the first 15 hex digits of ``md5(key|salt)`` as a
BIGINT, i.e. a uniform integer in [0, 2^60).  The same expression in DuckDB
is ``('0x' || substr(md5(concat_ws('|', key, salt)), 1, 15))::BIGINT``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DRAW_BITS = 60


def draw(*parts: str | Column) -> Column:
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    text = F.concat_ws("|", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def draw_sql(*parts: str) -> str:
    """DuckDB text of :func:`draw` (parts are SQL expressions)."""
    inner = ", ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"('0x' || substr(md5(concat_ws('|', {inner})), 1, 15))::BIGINT"


def draw_fast(*parts: str | Column) -> Column:
    """Spark-only draw in [0, 2^60): ``xxhash64`` of the typed values (no text casts).

    As reproducible across reruns and task retries as :func:`draw`, but
    other engines cannot recompute it; use it where no SQL twin is needed.
    """
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.shiftrightunsigned(F.xxhash64(*cols), 64 - DRAW_BITS)
