"""Token ids in training order, as binary shards with records of one length.

Documents are encoded and cut into sequences of ``LENGTH`` ids, the last one of a document padded. A keyed
Feistel permutation with cycle walking sends each sequence's number to a place of its own in the same range of
numbers; ranges of places are the shards. A record is the place, the document's id, the sequence's number in
it, the ids in use (8, 8, 4 and 4 bytes), then the ids (2 bytes each) and a newline; all little-endian and of one
length, so the k-th record of a shard starts at k times that length. Records stand in the order of places, so a
sequence's slot is the number of records in earlier shards plus its place in its own: a reader starts anywhere.

Each input partition numbers its own sequences from a start that leaves room for any partition (there are no
more sequences than bytes and documents allow), so texts are encoded once and no count of tokens is needed
first. Files go through Spark's writer: a task that is lost leaves nothing behind and is run again.

Defined cases: null and empty texts are one sequence without ids; null ids are written as the least 64-bit
number and read as null; repeated rows are sequences of their own; an empty table gives shards without
records; further columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.llm.common import bounded_batches, join_checked, named
from driftline.session import scratch_path

LENGTH = 256
#: Rows of (shard, first slot) that are broadcast at most.
SHARD_ROWS = 500_000
PAD = 0xFFFF
ROUNDS = 6
KEY = 0x5EED
#: Rows and bytes of text that a Python task is handed at once: ids and records take several times as much.
BATCH_ROWS = 200
BATCH_BYTES = 512 << 10
#: Bytes of a shard, about.
SHARD_BYTES = 16 << 20
HEAD = np.dtype([("place", "<i8"), ("doc_id", "<i8"), ("part", "<i4"), ("used", "<i4")])
NO_ID = -(1 << 63)


def record_type(length: int = LENGTH) -> np.dtype:
    return np.dtype([*HEAD.descr, ("ids", "<u2", (length,)), ("end", "u1")])


def feistel(numbers: np.ndarray, size: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """A permutation of 0 .. size - 1: a balanced Feistel network, walked on while it leads outside.

    Its range is the least power of four that holds ``size``, so a walk takes less than four steps on average.
    """
    half = np.uint64(max(1, ((size - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = np.array(numbers, np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> half, x & mask
        for r in range(rounds):
            left, right = right, left ^ (_round(right, key, r) & mask)
        x = left << half | right
        out[todo] = x
        todo = todo[x >= np.uint64(size)]
    return out.astype(np.int64)


def _round(x: np.ndarray, key: int, r: int) -> np.ndarray:
    x = (x + np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) % (1 << 64)))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    """A function from text to ids for a ``.tiktoken`` file of ranks; one for each worker."""
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        if own.max_token_value >= PAD:
            raise ValueError("ids need more than two bytes")
        _ENCODERS[path] = own
    return _ENCODERS[path]


def room(docs: DataFrame, text: str, length: int) -> tuple[int, int]:
    """(input partitions, sequences that the fullest of them can have)."""
    at = docs.select(F.spark_partition_id().alias("p"), F.octet_length(named(text)).alias("n"))
    most = at.groupBy("p").agg(F.sum(F.floor(F.coalesce("n", F.lit(0)) / length) + 1).alias("s")).agg(
        F.max("p").alias("p"), F.max("s").alias("s")).first()
    return (most["p"] + 1, int(most["s"])) if most["s"] else (1, 1)


def write(docs: DataFrame, path: str, out: str, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH,
          key: int = KEY, shard_bytes: int = SHARD_BYTES) -> int:
    """Write the shards below ``out``; returns their number. ``path``: the vocabulary file on every machine."""
    slim = docs.select(named(doc_id).cast("bigint").alias("doc_id"), named(text).alias("text"))
    partitions, most = room(slim, "text", length)
    size = partitions * most
    record = record_type(length)
    total = docs.select(F.sum(F.octet_length(named(text))).alias("n")).first()["n"] or 0
    shards = max(1, -(-int(total) // shard_bytes))
    width = -(-size // shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = encoder(path)
        number = TaskContext.get().partitionId() * most
        limit = number + most
        for b in batches:
            keys = [NO_ID if k is None else k for k in b.column(0).to_pylist()]
            ids = [own.encode_to_numpy(t or "", allowed_special=set(), disallowed_special=()) for t in b.column(1).to_pylist()]
            sizes = np.array([len(x) for x in ids], np.int64)
            counts = np.maximum(1, -(-sizes // length))
            n = int(counts.sum())
            if number + n > limit:
                raise RuntimeError("an input partition has more sequences than its bytes allow")
            rows = np.zeros(n, record)
            rows["part"] = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)
            rows["doc_id"] = np.repeat(np.array(keys, np.int64), counts)
            rows["used"] = np.clip(np.repeat(sizes, counts) - rows["part"] * length, 0, length)
            flat = np.full(n * length, PAD, np.uint16)
            begin = (np.cumsum(counts) - counts) * length
            for x, at in zip(ids, begin.tolist()):
                flat[at:at + len(x)] = x
            rows["ids"] = flat.reshape(n, length)
            rows["end"] = 10
            rows["place"] = feistel(np.arange(number, number + n, dtype=np.uint64), size, key)
            number += n
            values = pa.FixedSizeBinaryArray.from_buffers(
                pa.binary(record.itemsize - 1), n, [None, pa.py_buffer(rows.view("u1").reshape(n, -1)[:, :-1].tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(rows["place"] // width), pa.array(rows["place"]), values.cast(pa.binary())],
                                             names=["shard", "place", "record"])

    bounded_batches(docs.sparkSession, BATCH_BYTES, BATCH_ROWS)
    try:
        records = slim.mapInArrow(run, "shard long, place long, record binary")
        (records.repartition(shards, "shard").sortWithinPartitions("shard", "place")
         .select("shard", F.col("record").cast("string").alias("record"))  # its bytes as they are
         .write.partitionBy("shard").option("lineSep", "\n").text(out))
    finally:
        bounded_batches(docs.sparkSession)
    return shards


def read(spark: SparkSession, out: str, length: int = LENGTH, start: int = 0) -> DataFrame:
    """The records of the shards with their slots, from slot ``start`` on: slot, shard, doc_id, part, used, ids.

    A shard's first slot follows from the lengths of the files before it, which Spark lists: a running sum over
    them is joined to the files (a row for each file, nothing goes through the driver), and files before the start
    are not read.
    """
    record = record_type(length)
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(out)
             .withColumn("n", F.floor(F.col("length") / record.itemsize)))
    listed = files.select(F.col("shard").alias("l_shard"), "n")  # a shard is one file
    # running sums by thousands of shards, then within: no window holds the whole listing of a large table
    listed = listed.withColumn("block", F.floor(F.col("l_shard") / 1000))
    blocks = listed.groupBy("block").agg(F.sum("n").alias("rows"))
    blocks = blocks.withColumn("base", F.coalesce(F.sum("rows").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = Window.partitionBy("block").orderBy("l_shard").rowsBetween(Window.unboundedPreceding, -1)
    firsts = (listed.join(blocks.drop("rows"), "block").withColumn("first", F.col("base") + F.coalesce(F.sum("n").over(within), F.lit(0)))
              .where(F.col("first") + F.col("n") > start).select("l_shard", "first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, first, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                rows = np.frombuffer(content.as_buffer(), record)
                slots = np.arange(len(rows), dtype=np.int64) + first
                for k in range(0, len(rows), 4096):
                    part, slot = rows[k:k + 4096], slots[k:k + 4096]
                    part, slot = part[slot >= start], slot[slot >= start]
                    used = np.ascontiguousarray(part["used"])
                    flat = part["ids"][np.arange(length) < used[:, None]].astype(np.int32)
                    offsets = np.concatenate([[0], np.cumsum(used)]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(slot), pa.array(np.full(len(slot), shard, np.int64)), pa.array(np.ascontiguousarray(part["place"])),
                        pa.array(np.ascontiguousarray(part["doc_id"]), mask=part["doc_id"] == NO_ID),
                        pa.array(np.ascontiguousarray(part["part"])), pa.array(used),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                        names=["slot", "shard", "place", "doc_id", "part", "used", "ids"])

    # two numbers a shard: broadcast up to SHARD_ROWS of them, so that the contents are not shuffled
    found = join_checked(files, firsts, F.col("shard") == F.col("l_shard"), "inner", SHARD_ROWS)
    return found.select(F.col("shard").cast("bigint"), F.col("first").cast("bigint"), "content").mapInArrow(
        run, "slot long, shard long, place long, doc_id long, part int, used int, ids array<int>")


def materialised(docs: DataFrame, path: str, **options) -> DataFrame:
    """Write the shards below the shared checkpoint folder and read them back."""
    spark = docs.sparkSession
    out = scratch_path(spark, "shards")
    write(docs, path, out, **options)
    return read(spark, out, options.get("length", LENGTH))
