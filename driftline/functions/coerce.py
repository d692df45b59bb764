"""Text -> typed coercions (all JVM-side, ANSI-safe via try_cast)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip_quotes_to_number(col: str | Column) -> Column:
    """strip surrounding double quotes, then coerce to double (junk -> NULL)."""
    return F.btrim(_c(col).cast("string"), F.lit('"')).try_cast("double")


def _finite(number: Column) -> Column:
    """The number, or NULL for NaN and the infinities; names its argument once, so that it is computed once."""
    inf = float("inf")
    return F.nullif(F.nullif(F.nanvl(number, F.lit(inf)), F.lit(inf)), F.lit(-inf))


def coerce_int(col: str | Column, kind: str = "int") -> Column:
    """F2: empty, junk, NaN and infinite -> 0, else truncated to ``kind`` ('7.0' -> 7).

    Whole numbers are read as they are, so identifiers keep all digits; a value beyond ``kind`` is 0, and so are NaN and
    the infinities, which no whole number holds.
    """
    txt = F.nullif(F.trim(_c(col).cast("string")), F.lit(""))  # an empty text costs no failed parse
    # a text like '7.0' is no whole number; finding that out by a failed parse would cost an exception a row
    whole = F.when(F.translate(txt, "0123456789+-", "") == "", txt)
    return F.coalesce(whole.try_cast(kind), txt.try_cast("double").try_cast(kind), F.lit(0).cast(kind))


def decimal_comma(col: str | Column) -> Column:
    """'12,5' -> 12.5; empty, junk, NaN and infinite -> 0.0."""
    txt = F.nullif(F.replace(_c(col).cast("string"), F.lit(","), F.lit(".")), F.lit(""))
    return F.coalesce(_finite(txt.try_cast("double")), F.lit(0.0))


def clean_text(col: str | Column) -> Column:
    """trim; empty -> NULL (missing text stays NULL, never the text 'nan')."""
    return F.nullif(F.trim(_c(col).cast("string")), F.lit(""))


def normalize_name(col: str | Column) -> Column:
    """Lower-case, spaces and dashes -> underscores."""
    return F.translate(F.lower(_c(col)), " -", "__")


def clean_header(names: list[str]) -> list[str]:
    """Strip surrounding blanks from header names."""
    return [n.strip() for n in names]
