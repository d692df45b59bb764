"""Structured Streaming wiring: file sources, sinks in the shared folder, bounded runs.

Every stream keeps its offsets and state in a checkpoint folder below the
session's ``spark.checkpoint.dir`` (never a machine-local path), so a
restarted driver or a lost executor resumes exactly where it stopped.
``run_available_now`` drains what is there and stops, which is how the
queries here are checked against their batch twins.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.session import scratch_path

ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "parquet",
                glob: str | None = None, max_files: int | None = None) -> DataFrame:
    """Stream over the files of ``folder`` (optionally only those matching ``glob``)."""
    r = spark.readStream.schema(schema).format(fmt)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(folder)


def landed(rows: DataFrame, name: str, ts: str = "ts") -> str:
    """Write ``rows`` to a fresh folder for a stream to read, and a last row with nothing but a time one day later.

    A source that has gone idle moves the watermark on with such a row, so that what waits in the state is folded.
    """
    spark = rows.sparkSession
    folder = scratch_path(spark, name)
    rows.write.parquet(folder)
    last = spark.read.schema(rows.schema).parquet(folder).agg((F.max(ts) + F.expr("INTERVAL 1 DAY")).alias(ts)).first()[0]
    if last is not None:
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])
        spark.createDataFrame([tuple(last if f.name == ts else None for f in schema)], schema).write.mode("append").parquet(folder)
    return folder


def arrivals(rows: DataFrame, folder: str, parts: int, arrival: Column) -> Iterator[int]:
    """Write ``rows`` to ``folder`` in ``parts`` that follow each other in ``arrival``; yields after each part."""
    held = rows.withColumn("_arrival", arrival)
    cuts = held.approxQuantile("_arrival", [k / parts for k in range(1, parts)], 0.001)
    for k, (low, high) in enumerate(zip([None, *cuts], [*cuts, None])):
        part = held.filter((F.lit(True) if low is None else F.col("_arrival") >= low) & (F.lit(True) if high is None else F.col("_arrival") < high))
        part.drop("_arrival").write.mode("append").parquet(folder)
        yield k


def use_rocksdb_state(spark: SparkSession) -> None:
    """State store for ``transformWithState`` (set before the query starts); a commit uploads what changed, not the whole state."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def run_available_now(stream: DataFrame, name: str, output_mode: str = "append", fmt: str = "parquet",
                      spark: SparkSession | None = None, sink: str | None = None,
                      checkpoint: str | None = None) -> DataFrame:
    """Drain what the source holds into the sink and return the sink as a batch DataFrame.

    Fresh sink and checkpoint folders by default; passing the same
    ``checkpoint`` again resumes from the committed offsets and state, so a
    rerun (or a restarted driver) processes only new input, exactly once.
    """
    spark = spark or stream.sparkSession
    sink = sink or scratch_path(spark, f"{name}-sink")
    ckpt = checkpoint or scratch_path(spark, f"{name}-ckpt")
    q = (stream.writeStream.format(fmt).option("path", sink).option("checkpointLocation", ckpt)
         .outputMode(output_mode).trigger(availableNow=True).queryName(f"{name}_{ckpt[-8:]}").start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return spark.read.schema(stream.schema).format(fmt).load(sink)


def run_complete_available_now(stream: DataFrame, name: str, spark: SparkSession | None = None) -> DataFrame:
    """Complete-mode aggregate (state: one row per group) drained once; every
    micro-batch overwrites the result table, which is returned as a batch DataFrame."""
    spark = spark or stream.sparkSession
    table = scratch_path(spark, f"{name}-table")
    ckpt = scratch_path(spark, f"{name}-ckpt")

    def publish(batch: DataFrame, _epoch: int) -> None:
        batch.write.mode("overwrite").parquet(table)

    q = (stream.writeStream.outputMode("complete").foreachBatch(publish).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).queryName(f"{name}_{ckpt[-8:]}").start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return spark.read.schema(stream.schema).parquet(table)
