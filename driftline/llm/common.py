"""Helpers that several of the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.session import scratch_path

#: The six ASCII blanks that separate words; everything else belongs to a word.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_CLASS = r"[\x20\x09-\x0D]"

#: A side of a join is broadcast only if a count has shown at most this many (narrow) rows.
BROADCAST_ROWS = 50_000

#: Bytes of one Arrow batch on the way to a Python task; long documents make a batch shorter, not larger.
ARROW_BATCH_BYTES = 8 << 20
ARROW_BATCH_ROWS = 2_000


def named(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, *bases: str) -> list[str]:
    """Names for working columns that clash with no column of ``df``, whatever its columns are called."""
    taken = {c.lower() for c in df.columns}
    out = []
    for base in bases:
        name = base
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` as a bound variable.

    Catalyst may inline a column into the lambdas that use it, which would recompute an array for each
    of its elements; a lambda argument is computed once.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Words of a text in order; null or blank texts have none."""
    core = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, BLANK_CLASS + "+"))


def join_checked(left: DataFrame, right: DataFrame, on: Column, how: str = "left",
                 rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a side that is usually small: broadcast it if a count shows that it is, else shuffle.

    The count stops at ``rows + 1`` rows. Beyond it the plain equi-join stands, which AQE may split
    where a key is hot.
    """
    small = right.limit(rows + 1).count() <= rows
    return left.join(F.broadcast(right) if small else right, on, how)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table below the shared checkpoint folder and read it again.

    Cuts the lineage for data that several steps read; survives lost executors.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
              schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` for columns of any name (dots included) and batches of bounded size."""
    bounded_batches(df.sparkSession)
    names = df.columns

    def named_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(pa.RecordBatch.from_arrays(b.columns, names=names) for b in batches)

    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(named_batches, schema)


def bounded_batches(spark: SparkSession, size: int = ARROW_BATCH_BYTES, rows: int = ARROW_BATCH_ROWS) -> None:
    """Keep Arrow batches small in bytes, so that long documents cannot fill a Python worker."""
    for key, value in (("spark.sql.execution.arrow.maxBytesPerBatch", size),
                       ("spark.sql.execution.arrow.maxRecordsPerBatch", rows)):
        spark.conf.set(key, str(value))
