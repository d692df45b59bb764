"""Audit of how filters interact: what each removes first, in vain or alone, in every order.

Each document gets a mask of the filters it fails. Four filters look at its own text; the fifth asks whether
any document with a smaller id has the same text, which radix tries answer: texts are dealt to ranges cut at
adaptive prefixes, every range inserts its full texts into a compressed trie that holds the smallest id at
the end of each text, and walking the trie tells which rows are copies. Masks are then counted by part and
label, and a literal table of all orders turns these few counts into the report.

Rows are pre-aggregated by the same trie before the shuffle: a task sends on only the rows with the smallest
id it has met for a text; the others are decided on the spot. So a text that a third of all rows share is
sent about once by each task. Tries are cleared whenever they hold ``CHUNK_BYTES``, and ranges are
sized (and, on large inputs, sliced by a checksum of the text) to hold about as much. Cut points come from
a bounded sample of different texts; they decide where a text goes, never the result.

Defined cases: a null text is empty; a null part is the empty string; a row with a null id is never a copy
and makes none; rows with the same id and text share their fate; an id counts as labelled 1 if any of its
label rows says so; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator, Mapping
from itertools import permutations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.llm.common import join_checked, map_arrow, named, staged
from driftline.llm.radix import RadixTrie, cut_points, range_of

_LETTERS = bytes(range(65, 91))
_MARKS = re.compile(rb"[#$%&*|]")

#: The filters on a text alone: given its bytes, words and number of code points, does it fail?
TEXT_FILTERS: Mapping[str, Callable[[bytes, list[bytes], int], bool]] = {
    "A": lambda data, words, chars: len(words) < 100,
    "B": lambda data, words, chars: 100 * len(set(words)) < 80 * len(words),
    "C": lambda data, words, chars: 100 * (len(data) - len(data.translate(None, _LETTERS))) > 10 * chars,
    "D": lambda data, words, chars: _MARKS.search(data) is not None,
}
#: The filter on copies.
COPY_FILTER = "E"

#: Text a trie may hold, and text of a range or slice.
CHUNK_BYTES = 64 << 20
#: Repeated texts a task remembers after its trie was cleared.
HOT_BYTES = 4 << 20
#: Different texts (at most so many characters of each) that the cut points are taken from; four for each range.
SAMPLE_TEXTS = 1 << 13
SAMPLE_CHARS = 1 << 14
#: Partitions a range is dealt to at most; further slices follow each other in a task.
SLICES_AT_ONCE = 32
FLUSH_ROWS = 10_000


def adaptive_cuts(texts: DataFrame, text: str = "text", ranges: int | None = None) -> tuple[list[bytes], int]:
    """(cut points, slices of each range) for the different texts of a table."""
    rows = texts.count()
    share = min(1.0, SAMPLE_TEXTS / max(rows, 1))
    value = F.coalesce(named(text), F.lit(""))
    chosen = texts.where(F.pmod(F.xxhash64(value, F.lit("cuts")), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = chosen.select(F.substring(value, 1, SAMPLE_CHARS).alias("t"), F.octet_length(value).alias("b")).groupBy("t").agg(F.max("b").alias("b"))
    found = sorted((r["t"].encode(), r["b"] + 1) for r in sample.limit(2 * SAMPLE_TEXTS).collect())
    size = sum(b for _, b in found) / share
    least = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = min(SAMPLE_TEXTS // 4, max(ranges or least, math.ceil(size / CHUNK_BYTES)))
    return cut_points(found, wanted), max(1, math.ceil(size / wanted / CHUNK_BYTES))


def _text_mask(data: bytes, chars: int) -> int:
    words = data.split()  # bytes know the six ASCII blanks only
    return sum(1 << i for i, fails in enumerate(TEXT_FILTERS.values()) if fails(data, words, chars))


def masks(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(id, part, mask, n): rows counted by id, part and the filters they fail (bit i: the i-th; last: copies)."""
    slim = docs.select(named(doc_id).alias("id"), F.coalesce(named(part).cast("string"), F.lit("")).alias("part"),
                       F.coalesce(named(text).cast("string"), F.lit("")).alias("text"))
    cuts, slices = adaptive_cuts(slim)
    at_once = min(slices, SLICES_AT_ONCE)
    partitions = (len(cuts) + 1) * at_once
    kind = slim.schema["id"].dataType
    narrow = [T.StructField("id", kind), T.StructField("part", T.StringType()), T.StructField("mask", T.IntegerType()), T.StructField("n", T.LongType())]
    sent = T.StructType([*narrow, T.StructField("text", T.BinaryType()), T.StructField("at", T.IntegerType()), T.StructField("slice", T.IntegerType())])
    copy_bit = 1 << len(TEXT_FILTERS)

    def batch_of(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    def first_look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = None
        trie, out, n_out = RadixTrie(), [], 0

        def decided(rows, bit):
            nonlocal n_out
            for i, (p, mask), n in rows:
                n_out += 1  # spread over all partitions
                out.append((i, p, mask | bit, n, None, n_out % partitions, -1))

        def undecided():
            for data, end in trie.ends():
                cut = zlib.crc32(data) % slices
                for (p, mask), n in end.holders.items():
                    yield end.smallest, p, mask, n, data, range_of(cuts, data) * at_once + cut % at_once, cut

        for batch in batches:
            if types is None:
                types = [batch.schema.types[0], pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int32()]
            ids, parts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts, chars = batch.column(2).cast(pa.binary()).to_pylist(), pc.utf8_length(batch.column(2)).to_pylist()
            for i, p, data, c in zip(ids, parts, texts, chars):
                group = (p, _text_mask(data, c))
                if i is None:
                    decided([(i, group, 1)], 0)
                else:
                    decided(trie.offer(data, i, group), copy_bit)
                if trie.bytes >= CHUNK_BYTES:
                    yield from _batches(undecided(), types, sent.names, batch_of)
                    trie = trie.renewed(HOT_BYTES)
            if len(out) >= FLUSH_ROWS:
                yield batch_of(out, types, sent.names)
                out = []
        if types is not None:
            yield from _batches(undecided(), types, sent.names, batch_of)
            yield batch_of(out, types, sent.names)

    def in_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, trie, out, current = None, RadixTrie(), [], None

        def smallest():
            return ((end.smallest, p, mask, n) for _, end in trie.ends() for (p, mask), n in end.holders.items())

        for batch in batches:
            types = batch.schema.types[:4]
            for i, p, mask, n, data, _, cut in zip(*(c.to_pylist() for c in batch.columns)):
                if data is None:
                    out.append((i, p, mask, n))
                    continue
                if cut != current and current is not None and slices > at_once:  # sorted by slice: the last one is complete
                    yield from _batches(smallest(), types, sent.names[:4], batch_of)
                    trie = RadixTrie()
                current = cut
                out.extend((j, q, m | copy_bit, k) for j, (q, m), k in trie.offer(data, i, (p, mask), n))
            if len(out) >= FLUSH_ROWS:
                yield batch_of(out, types, sent.names[:4])
                out = []
        if types is not None:
            yield from _batches(smallest(), types, sent.names[:4], batch_of)
            yield batch_of(out, types, sent.names[:4])

    looked = map_arrow(slim, first_look, sent).repartitionById(partitions, F.col("at"))
    if slices > at_once:
        looked = looked.sortWithinPartitions("slice")
    return map_arrow(looked, in_range, T.StructType(narrow))


def _batches(rows: Iterator[tuple], types: list[pa.DataType], names: list[str], batch_of) -> Iterator[pa.RecordBatch]:
    """Rows in batches of bounded size, in rows and in bytes of text."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 100 + (len(row[4]) if len(row) > 4 else 0)
        if size >= 8 << 20:
            yield batch_of(held, types, names)
            held, size = [], 0
    if held:
        yield batch_of(held, types, names)


def orders() -> list[tuple[str, int, int, int]]:
    """(order, step, filters before as a mask, filter of the step as a bit) of every step of every order."""
    letters = [*TEXT_FILTERS, COPY_FILTER]
    out = []
    for order in permutations(letters):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << letters.index(letter)
            out.append(("".join(order), step, before, bit))
            before |= bit
    return out


def audit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", part: str = "lang",
          quality: str = "quality", toxic: str = "toxic") -> DataFrame:
    """One row per part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    flagged = masks(docs, doc_id=doc_id, text=text, part=part).groupBy("id", "part", "mask").agg(F.sum("n").alias("n"))
    says = (labels.where(named(doc_id).isNotNull() & ((named(quality) == 1) | (named(toxic) == 1))).groupBy(named(doc_id).alias("label_id"))
            .agg(F.coalesce(F.bool_or(named(quality) == 1), F.lit(False)).alias("good"),
                 F.coalesce(F.bool_or(named(toxic) == 1), F.lit(False)).alias("bad")))
    joined = join_checked(flagged, says, F.col("id") == F.col("label_id"))
    no = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    counts = staged(joined.groupBy("part", "mask", no("good"), no("bad")).agg(F.sum("n").alias("n")), "mask-counts")

    n_filters = len(TEXT_FILTERS) + 1
    steps = orders()
    every = counts.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(steps) - 1))).alias("k"))
    for i, name in enumerate(("filter_order", "step", "before", "bit")):
        every = every.withColumn(name, F.get(F.lit([s[i] for s in steps]), F.col("k")))
    fails = F.col("mask").bitwiseAND(F.col("bit")) != 0
    reached = F.col("mask").bitwiseAND(F.col("before")) == 0

    def rows_where(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    # of all orders, a failing filter comes first among the k that a document fails in one of k
    share = F.lit(math.factorial(n_filters)) / F.bit_count("mask")
    return (every.groupBy("part", "filter_order", "step", "bit").agg(
        rows_where(reached & ~fails).alias("kept"), rows_where(reached & fails).alias("removed"), rows_where(~reached & fails).alias("redundant"),
        rows_where(F.col("mask") == F.col("bit")).alias("unique_fails"), rows_where(reached & fails & F.col("good")).alias("good_lost"),
        rows_where(reached & fails & F.col("bad")).alias("toxic_lost"),
        F.sum(F.when(fails, F.col("n") * share.cast("long")).otherwise(0)).alias("shapley")).drop("bit"))
