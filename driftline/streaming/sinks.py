"""Sinks of foreachBatch streams that a replayed micro-batch does not change.

A batch's rows go to a folder named by its number, which a rerun replaces. In update mode a row is the newest
state of its key, so readers take each key's row of the greatest batch number; from time to time the batches
are merged into one table, and a manifest names the merged table and the last batch in it in one step.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.session import scratch_path
from driftline.sources.versions import VersionedTable

BATCH = "_batch"


def _start(stream: DataFrame, name: str, checkpoint: str, mode: str, run: Callable[[DataFrame, int], None]) -> None:
    q = (stream.writeStream.outputMode(mode).foreachBatch(run).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).queryName(f"{name}_{checkpoint[-8:]}").start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def run_ranked(stream: DataFrame, name: str, rank: Callable[[DataFrame], DataFrame], sink: str | None = None,
               checkpoint: str | None = None) -> DataFrame:
    """Append mode: all groups of a window leave the state in one micro-batch, so ``rank`` sees each window whole."""
    spark = stream.sparkSession
    sink, checkpoint = sink or scratch_path(spark, f"{name}-sink"), checkpoint or scratch_path(spark, f"{name}-ckpt")
    schema = rank(spark.createDataFrame([], stream.schema)).schema
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{sink}/batch=none")

    def run(batch: DataFrame, number: int) -> None:
        rank(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    _start(stream, name, checkpoint, "append", run)
    return spark.read.schema(schema).parquet(f"{sink}/batch=*")


def run_updates(stream: DataFrame, table: str, keys: Sequence[str], checkpoint: str, name: str = "updates", compact_after: int = 20) -> None:
    """Update mode into ``table``: one folder per micro-batch, merged once ``compact_after`` of them have piled up."""
    spark = stream.sparkSession
    versions = VersionedTable(spark, f"{table}/merged")
    if versions.manifest().schema is None:
        schema = T.StructType([*stream.schema.fields, T.StructField(BATCH, T.LongType())])
        versions.replace(spark.createDataFrame([], schema), {"upto": -1})

    def run(batch: DataFrame, number: int) -> None:
        write_update(batch, table, number)
        compact(spark, table, keys, compact_after)

    _start(stream, name, checkpoint, "update", run)


def write_update(batch: DataFrame, table: str, number: int) -> None:
    batch.withColumn(BATCH, F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{table}/batches/{number}")


def _pending(spark: SparkSession, table: str, upto: int) -> list[int]:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/batches")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return sorted(int(n) for n in names if n.isdigit() and int(n) > upto
                  and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{table}/batches/{n}/_SUCCESS")))


def _newest(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(BATCH)).alias("_row")).select(
        *[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in rows.columns])


def _all(spark: SparkSession, table: str, keys: Sequence[str], pending: Sequence[int], versions: VersionedTable, manifest) -> DataFrame:
    merged = versions.read(manifest)
    if not pending:
        return merged
    return _newest(merged.unionByName(spark.read.schema(merged.schema).parquet(*[f"{table}/batches/{n}" for n in pending])), keys)


def current(spark: SparkSession, table: str, keys: Sequence[str]) -> DataFrame:
    """The newest state of every key."""
    versions = VersionedTable(spark, f"{table}/merged")
    manifest = versions.manifest()
    return _all(spark, table, keys, _pending(spark, table, manifest.properties["upto"]), versions, manifest).drop(BATCH)


def compact(spark: SparkSession, table: str, keys: Sequence[str], after: int) -> None:
    """Merge the finished batches but the last, which a rerun may replace, into one table."""
    versions = VersionedTable(spark, f"{table}/merged")
    manifest = versions.manifest()
    pending = _pending(spark, table, manifest.properties["upto"])
    if len(pending) <= after:
        return
    versions.replace(_all(spark, table, keys, pending[:-1], versions, manifest), {"upto": pending[-2]})


class _Stopped(Exception):
    """The driver is lost between a poll's table change and the stream's own commit."""


def run_polls(stream: DataFrame, table: str, checkpoint: str, ts: str, name: str = "polls", stop_after: int | None = None) -> int:
    """T1 + A20: append every micro-batch to a versioned table, with its number and the newest time so far, in one step.

    A batch that is run again finds its number in the table and changes nothing. ``stop_after`` ends the
    run after so many polls as a lost driver would, before the stream has noted the last one; returns the polls made.
    """
    versions = VersionedTable(stream.sparkSession, table)
    made = 0

    def run(batch: DataFrame, number: int) -> None:
        nonlocal made
        base = versions.manifest()
        if number > base.properties.get("batch", -1):
            newest = batch.agg(F.unix_micros(F.max(ts)).alias("us")).first()["us"]
            times = [t for t in (newest, base.properties.get("newest_us")) if t is not None]
            versions.commit(base, {"": [*base.folders.get("", []), versions.write(batch)]},
                            {"batch": number, "newest_us": max(times) if times else None}, stream.schema.json())
            made += 1
        if stop_after is not None and made >= stop_after:
            raise _Stopped

    try:
        _start(stream, name, checkpoint, "append", run)
    except Exception:
        if stop_after is None or made < stop_after:
            raise
    return made


def polled(spark: SparkSession, table: str) -> tuple[DataFrame, int | None]:
    """The polled rows and the newest time (microseconds) among them."""
    versions = VersionedTable(spark, table)
    manifest = versions.manifest()
    return versions.read(manifest), manifest.properties.get("newest_us")
