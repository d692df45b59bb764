"""Delimited text sources and sinks (S1-S3, K1) and JSON-lines events.

Reads always take an explicit schema (no inference pass over the data).
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.session import cut_lineage

TIMESTAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def write_delimited(df: DataFrame, path: str, sep: str = ";", header: bool = True,
                    mode: str = "overwrite", encoding: str = "UTF-8") -> None:
    """K1: delimited text with a header line per file."""
    (df.write.mode(mode).option("sep", sep).option("header", header).option("encoding", encoding)
       .option("timestampFormat", TIMESTAMP_FORMAT).csv(path))


def read_delimited(spark: SparkSession, path: str, schema: T.StructType, sep: str = ";",
                   header: bool = True, encoding: str = "UTF-8") -> DataFrame:
    """Delimited scan with a declared schema."""
    return (spark.read.schema(schema).option("sep", sep).option("header", header)
            .option("encoding", encoding).option("timestampFormat", TIMESTAMP_FORMAT).csv(path))


#: A record longer than this (a quote that is never closed swallows what follows) is malformed and skipped.
MAX_RECORD_CHARS = 1 << 20


def placed_lines(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Text lines with their place: ``file``, ``block`` (start of the split in the file) and ``at``, which grows along a block."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"))
    if encoding.upper() not in ("UTF-8", "UTF8"):
        lines = lines.withColumn("value", F.decode(F.col("value").cast("binary"), encoding))
    return lines


def quoted_records(lines: DataFrame) -> DataFrame:
    """Put lines together again that a line break inside quotes has split: one row per record (file, block, at, value).

    A line begins a record if the quotes before it in its file are even in number. Each block counts its own
    quotes; a running sum over the blocks of a file (a row for each) tells a block how it begins, so blocks are
    read in parallel and no task sees a whole file. Lines that are records by themselves, nearly all of them,
    are not grouped. Line breaks inside a record come out as ``\\n``.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    lines = lines.withColumn("quotes", quotes)
    lines = cut_lineage(lines)  # read several times below; places must not differ between the reads
    blocks = lines.groupBy("file", "block").agg((F.sum("quotes") % 2).alias("odd"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("open", F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2).drop("odd")
    along = Window.partitionBy("file", "block").orderBy("at")
    before = F.coalesce(F.sum("quotes").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = (lines.join(blocks, ["file", "block"]).withColumn("begins", (F.col("open") + before) % 2 == 0)
         .withColumn("record", F.max(F.when(F.col("begins"), F.struct("block", "at"))).over(along.rowsBetween(Window.unboundedPreceding, 0))))
    alone = F.col("begins") & (F.col("quotes") % 2 == 0)
    single = x.filter(alone).select("file", "block", "at", "value")
    # lines before the first beginning of their block belong to the last record of the blocks before
    last = x.groupBy("file", "block").agg(F.max(F.when(F.col("begins"), F.struct("block", "at"))).alias("last"))
    last = last.select("file", "block", F.max("last").over(earlier).alias("carried"))
    parts = (x.filter(~alone).join(last, ["file", "block"])
             .select("file", F.coalesce("record", "carried").alias("record"), "block", "at", "value").filter(F.col("record").isNotNull()))
    fits = (parts.groupBy("file", "record").agg(F.sum(F.length("value") + 1).alias("chars")).filter(F.col("chars") <= MAX_RECORD_CHARS).drop("chars"))
    whole = (parts.join(fits, ["file", "record"]).groupBy("file", "record")
             .agg(F.array_sort(F.collect_list(F.struct("block", "at", "value"))).alias("held"))
             .select("file", F.col("record.block").alias("block"), F.col("record.at").alias("at"), F.array_join(F.col("held.value"), "\n").alias("value")))
    return single.unionByName(whole)


def read_skip_long_lines(spark: SparkSession, path: str, names: Sequence[str] | None = None, sep: str = ";",
                         header: bool = False, encoding: str = "UTF-8", breaks: bool = False) -> DataFrame:
    """All-text scan that drops records with *too many* fields and null-pads short ones.

    Not ``DROPMALFORMED`` (which also drops short lines and depends on the
    selected columns), and not a surplus schema column (an empty trailing
    field reads as NULL and would hide the surplus).  Fields are counted on
    the raw record as separators left when quoted spans are taken out (one
    linear pass); the kept ones are parsed with ``from_csv``.  Empty fields become NULL.

    ``header``: the first line of every file holds the names and is left out; later lines that look
    like it are data.  ``breaks``: quoted fields may hold line breaks and doubled quotes.
    """
    lines = placed_lines(spark, path, encoding)
    if breaks:
        lines = quoted_records(lines)
    if header:
        if names is None:
            top = lines.filter("block = 0").orderBy("file", "at").first()
            names = [n.strip().strip('"') for n in (top["value"] if top else "").split(sep)]
        # one row per file: where its first line is
        tops = lines.filter("block = 0").groupBy(F.col("file").alias("top_file")).agg(F.min("at").alias("top_at"))
        lines = lines.join(tops, (F.col("file") == F.col("top_file")) & (F.col("at") == F.col("top_at")), "left_anti")
    if names is None:
        raise ValueError("names are needed where the file has no header")
    schema = ", ".join(f"`{n}` STRING" for n in names)
    bare = F.regexp_replace(F.col("value"), '"[^"]*"', "")
    n_seps = (F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit("")))) / len(sep)
    kept = lines.filter(n_seps < len(names))
    options = {"sep": sep, "escape": '"', "multiLine": "true"} if breaks else {"sep": sep}
    parsed = kept.select(F.from_csv(F.col("value"), schema, options).alias("_r")).select("_r.*")
    return parsed.select(*[F.nullif(F.col(n), F.lit("")).alias(n) for n in names])


def read_with_encoding_fallback(spark: SparkSession, path: str, schema: T.StructType, sep: str = ";",
                                header: bool = True, fallback: str = "ISO-8859-1") -> DataFrame:
    """S3: read as UTF-8; when any line's bytes are not valid UTF-8, read as ``fallback``.

    The check looks at the bytes, so a replacement character that is really in the text is no error, and it
    stops at the first bad line.
    """
    bad = spark.read.text(path).filter(~F.is_valid_utf8("value")).limit(1).count()
    return read_delimited(spark, path, schema, sep, header, fallback if bad else "UTF-8")


def year_family(spark: SparkSession, template: str, years: Sequence[int], schema: T.StructType,
                sep: str = ";") -> DataFrame:
    """``{year}``-parametrised files read as one table with a ``year`` column."""
    paths = [template.format(year=y) for y in years]
    df = read_delimited(spark, paths[0], schema, sep) if len(paths) == 1 else \
        spark.read.schema(schema).option("sep", sep).option("header", True) \
             .option("timestampFormat", TIMESTAMP_FORMAT).csv(paths)
    # the year is read from the name the template produces (a file, or a folder of part files), never from its parents
    base = template.rsplit("/", 1)[-1]
    pattern = "/" + re.escape(base).replace(re.escape("{year}"), r"(\d{4})") + "(?:/[^/]*)?$"
    return df.withColumn("year", F.regexp_extract(F.input_file_name(), pattern, 1).cast("int"))
