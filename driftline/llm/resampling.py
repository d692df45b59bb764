"""Importance resampling towards a target distribution over hashed word runs.

Texts are lower-cased in A-Z only and cut by an untrained ``tokenizers`` pre-tokeniser: a regex ``Split``
that returns words with their offsets. Windows of consecutive offset pairs are the features; a feature's
bucket is the CRC-32 of its words joined by one space, modulo the number of buckets. Histograms of all
documents and of the target texts give each bucket a gain, 1000 times the log of the smoothed ratio of
shares; a document's weight is the floored mean gain of its features. Adding Gumbel noise from a hash of the
id to the weight and taking the highest scores draws without replacement in proportion to exp(weight/1000).

Texts go through Python once: the first pass keeps two bytes for each feature, and histograms and sums are
taken of those. A gain table has one entry for each bucket, whatever the input. Texts are cut into pieces
at characters that belong to no word, so a huge text fills no worker. Ranks come from one range-partitioned
sort of narrow rows with a running row number as last key, so equal scores and repeated ids are split too.

Defined cases: null, blank and wordless texts have no features and weight 0; without target texts or
documents the counts are 0 and the formula stands; a null id is hashed as the empty text and ranks after
the others of its score; rows that are equal in score and id rank in any order, once each; an empty table
gives an empty result; columns named in ``carry`` keep their names, result names that clash get a prefix.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.llm.common import fresh, map_arrow, named, staged

#: What is not a word: ASCII without digits and lower-case letters. Everything above ASCII belongs to words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

BUCKETS = 10_000
MAX_N = 2
SALT = 7
MIN_WORDS = 20
PERCENT = 25

#: Characters that go through the pre-tokeniser at once.
PIECE = 1 << 16
#: Two bytes hold a bucket's number.
MAX_BUCKETS = 1 << 16

Span = tuple[int, int]
_GAP = re.compile(GAP)


@lru_cache(maxsize=1)
def _splitter():
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(WORD), behavior="removed", invert=True)


def ascii_lower(text: str) -> str:
    return text.encode("utf-8").lower().decode("utf-8")  # bytes know no letters but the ASCII ones


def _pieces(low: str) -> Iterator[tuple[int, str]]:
    """(offset, piece): no word runs over the end of a piece."""
    start = 0
    while len(low) - start > PIECE:
        gap = _GAP.search(low, start + PIECE)
        if gap is None:
            break
        yield start, low[start:gap.start()]
        start = gap.start()
    yield start, low[start:]


def split_words(text: str | None) -> Iterator[tuple[str, Span]]:
    """The words of a text with their offsets in it."""
    for start, piece in _pieces(ascii_lower(text or "")):
        for word, (a, b) in _splitter().pre_tokenize_str(piece):
            yield word, (start + a, start + b)


def features(text: str | None, max_n: int = MAX_N, buckets: int = BUCKETS) -> Iterator[tuple[Span, int]]:
    """Every window of 1 to ``max_n`` words: its span, from the first word's start to the last one's end, and its bucket."""
    words = list(split_words(text))
    for n in range(1, max_n + 1):
        for i in range(len(words) - n + 1):
            run = words[i:i + n]
            yield (run[0][1][0], run[-1][1][1]), zlib.crc32(" ".join(w for w, _ in run).encode()) % buckets


def bucket_ids(text: str | None, max_n: int = MAX_N, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """Words of a text and the buckets of all its features, piece by piece.

    A CRC goes on from the CRC of what came before, so a window of n words costs two steps more than the
    window of n - 1 words with the same start.
    """
    crc, n_words, held, out = zlib.crc32, 0, [], []
    for _, piece in _pieces(ascii_lower(text or "")):
        new = [w.encode() for w, _ in _splitter().pre_tokenize_str(piece)]
        n_words += len(new)
        run = held + new
        state = [crc(w) for w in run]
        out.append(np.array(state[len(held):], dtype=np.int64))
        for n in range(2, max_n + 1):
            state = [crc(w, crc(b" ", s)) for s, w in zip(state, run[n - 1:])]
            out.append(np.array(state[max(0, len(held) - n + 1):], dtype=np.int64))
        held = run[len(run) - max_n + 1:] if 1 < max_n <= len(run) else run if max_n > 1 else []
    return n_words, (np.concatenate(out) % buckets).astype("<u2")


def hashed(texts: DataFrame, text: str = "text", carry: Sequence[str] = (), max_n: int = MAX_N,
           buckets: int = BUCKETS) -> tuple[DataFrame, list[str]]:
    """``carry`` with each text's word count and feature buckets, and the two names they have."""
    if not 0 < buckets <= MAX_BUCKETS:
        raise ValueError(f"buckets must be 1 to {MAX_BUCKETS}")
    kept = texts.select(*[named(c) for c in carry])
    extra = fresh(kept, "n_words", "buckets")
    schema = T.StructType([*kept.schema.fields, T.StructField(extra[0], T.LongType()), T.StructField(extra[1], T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [bucket_ids(t, max_n, buckets) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([n for n, _ in pairs], pa.int64()), pa.array([b.tobytes() for _, b in pairs], pa.binary())],
                names=schema.names)

    source, = fresh(kept, "text")
    return map_arrow(texts.select(*[named(c) for c in carry], F.coalesce(named(text), F.lit("")).alias(source)), run, schema), extra


def histogram(table: DataFrame, column: str, buckets: int = BUCKETS) -> DataFrame:
    """Features in each bucket (bucket, n); each task adds up its own before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for data in batch.column(0):
                total += np.bincount(np.frombuffer(data.as_buffer(), dtype="<u2"), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["bucket", "n"])

    return map_arrow(table.select(named(column)), run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket from two histograms: floor(1000 ln of the smoothed ratio of shares)."""
    spark = corpus.sparkSession
    both = (spark.range(buckets).select(F.col("id").alias("bucket"))
            .join(corpus.select("bucket", F.col("n").alias("s")), "bucket", "left")
            .join(target.select("bucket", F.col("n").alias("t")), "bucket", "left").na.fill(0, ["s", "t"]))
    whole = Window.partitionBy()  # one row for each bucket
    one = lambda c: F.col(c).cast("double")
    ratio = ((one("t") + 1) * (F.sum("s").over(whole).cast("double") + buckets)
             / ((one("s") + 1) * (F.sum("t").over(whole).cast("double") + buckets)))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))


def noise(doc_id: Column, salt: int = SALT) -> Column:
    """Gumbel noise times 1000, floored, from the first 32 bits of a digest of salt and id."""
    text = F.concat(F.lit(f"{salt}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def scored(docs: DataFrame, target: DataFrame, *, doc_id: str = "doc_id", text: str = "text", carry: Sequence[str] = (),
           max_n: int = MAX_N, buckets: int = BUCKETS, salt: int = SALT) -> tuple[DataFrame, list[str]]:
    """``carry`` with n_words, n_features, weight, score and a row number, written once; and the five names they have."""
    carried = [doc_id, *[c for c in carry if c != doc_id]]
    table, (n_words, ids) = hashed(docs, text, carried, max_n, buckets)
    table = staged(table, "features")
    aim, (_, aim_ids) = hashed(target, text, (), max_n, buckets)
    found = {r["bucket"]: r["gain"] for r in gains(histogram(table, ids, buckets), histogram(aim, aim_ids, buckets), buckets).collect()}
    gain = np.array([found[b] for b in range(buckets)], dtype=np.int64)  # bounded by the number of buckets
    kept = table.drop(ids)
    extra = fresh(kept, "n_features", "weight", "score", "row")
    schema = T.StructType([*kept.schema.fields, *[T.StructField(c, T.LongType()) for c in extra[:2]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []
            for data in batch.column(batch.num_columns - 1):
                b = np.frombuffer(data.as_buffer(), dtype="<u2")
                sums.append((len(b), int(gain[b].sum()) // len(b) if len(b) else 0))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array([s[k] for s in sums], pa.int64()) for k in (0, 1)]],
                                             names=schema.names)

    weighed = map_arrow(table.select(*[named(c) for c in kept.columns], named(ids)), run, schema)
    out = (weighed.withColumn(extra[2], named(extra[1]) + noise(named(doc_id), salt))
           .withColumn(extra[3], F.monotonically_increasing_id()))
    return staged(out, "scores"), [n_words, *extra]


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with their number in a global order, ``place`` from 1, by one range-partitioned sort.

    The order must end in a column that tells all rows apart, so that a group of equal rows can be split.
    A row's number in its partition is the low part of Spark's running id; the partitions' sizes (one row
    for each) give the starts.
    """
    place, part, start = fresh(rows, "place", "part", "start")
    low = (1 << 33) - 1
    ordered = staged(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(place, F.monotonically_increasing_id()), "ranks")
    part_of = F.shiftright(named(place), 33)
    sizes = ordered.groupBy(part_of.alias(part)).agg(F.count(F.lit(1)).alias(start))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(part, F.coalesce(F.sum(start).over(before), F.lit(0)).alias(start))
    return (ordered.join(F.broadcast(starts), part_of == named(part))
            .withColumn(place, named(start) + named(place).bitwiseAND(F.lit(low)) + 1).drop(part, start))


def _drawn(rows: DataFrame, names: Sequence[str], doc_id: str, min_words: int, percent: int) -> DataFrame:
    """(id, score, row, place) of the drawn rows."""
    n_words, _, _, score, row = names
    able = rows.where(named(n_words) >= min_words).select(named(doc_id), named(score), named(row))
    draws = able.count() * percent // 100
    ordered = ranked(able, named(score).desc(), named(doc_id).asc_nulls_last(), named(row).asc())
    place = ordered.columns[-1]
    return ordered.where(named(place) <= draws).toDF("id", "score", "row", "place")


def score(docs: DataFrame, target: DataFrame, *, doc_id: str = "doc_id", min_words: int = MIN_WORDS, percent: int = PERCENT,
          **options) -> DataFrame:
    """Every document's n_words, n_features, weight, score and rank among the drawn (null if not drawn), with ``carry``."""
    rows, names = scored(docs, target, doc_id=doc_id, **options)
    drawn = _drawn(rows, names, doc_id, min_words, percent).select(F.col("row").alias(names[4]), "place")
    joined = rows.join(drawn.withColumnRenamed("place", fresh(rows, "rank")[0]), names[4], "left")
    return joined.drop(names[4])


def resample(docs: DataFrame, target: DataFrame, *, doc_id: str = "doc_id", min_words: int = MIN_WORDS, percent: int = PERCENT,
             **options) -> DataFrame:
    """The drawn documents with their own columns: all rows up to the last one drawn, without a join."""
    rows, names = scored(docs, target, doc_id=doc_id, **(options | {"carry": docs.columns}))
    last = _drawn(rows, names, doc_id, min_words, percent).orderBy(F.col("place").desc()).limit(1)
    cut = last.first()
    own = [named(c) for c in docs.columns]
    if cut is None:
        return rows.limit(0).select(*own)

    def key(s: Column, i: Column, r: Column) -> Column:
        return F.struct((-s).alias("s"), i.isNull().alias("n"), i.alias("i"), r.alias("r"))

    kind = rows.schema[doc_id].dataType
    bound = key(F.lit(cut["score"]).cast("long"), F.lit(cut["id"]).cast(kind), F.lit(cut["row"]).cast("long"))
    at = key(named(names[3]), named(doc_id), named(names[4]))
    return rows.where((named(names[0]) >= min_words) & (at <= bound)).select(*own)
