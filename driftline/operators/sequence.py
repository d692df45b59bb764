"""Exact ordered-window building blocks that do not funnel a key into one task.

A plain ``Window.partitionBy(key).orderBy(t)`` sends every row of a key to
one task; with one key holding a third of the data that task is the job.
The helpers here split each key into ordered *chunks* (a monotone function
of the order column: a day, or an approximate-quantile bucket), run the
window per ``(key, chunk)``, and repair the chunk boundaries from a small
per-chunk summary (``#keys x #chunks`` rows):

* :func:`running_sum` - exact cumulative sums (two-level prefix sum);
* :func:`lag_exact`   - the previous row's values, also across chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.session import cut_lineage

DEFAULT_BUCKETS = 64
SUB_BUCKETS = 1024
CHUNK_ROWS = 100_000   # target rows per (key, chunk) for value-ordered chunks
# Time-ordered helpers window per (key, minute): with one key holding a third
# of the rows, a task still only sees that key's rows of one minute.
TIME_CHUNK = "minute"


def time_chunk(ts: str | Column) -> Column:
    """Chunk column for time-ordered helpers (monotone in ``ts``)."""
    return F.date_trunc(TIME_CHUNK, F.col(ts) if isinstance(ts, str) else ts)


def quantile_chunk(df: DataFrame, keys: Sequence[str], order_col: str,
                   buckets: int = DEFAULT_BUCKETS, accuracy: int = 10_000,
                   sub_buckets: int = SUB_BUCKETS, few_keys: bool = False) -> DataFrame:
    """Add ``_chunk``: an ordered, value-range chunk id per key (monotone in ``order_col``).

    ``buckets`` approximate per-key quantile cuts give coarse ranges
    ``(c_i, c_i+1]``; for numeric columns each is split into equal-width
    sub-ranges, as many as needed for about ``CHUNK_ROWS`` rows per chunk
    (at most ``sub_buckets``), so a key gets up to ``buckets * sub_buckets``
    chunks for O(``buckets``) work per row.
    Equal values always share a chunk.  The cut table has ``#keys`` rows; with ``few_keys`` (keys that are
    column names, say) it is broadcast, so a table is not shuffled on a handful of keys.
    """
    probs = [i / buckets for i in range(1, buckets)]
    v = F.col(order_col)
    cuts = df.groupBy(*keys).agg(F.percentile_approx(order_col, probs, accuracy).alias("_cuts"),
                                 F.min(order_col).alias("_lo"), F.max(order_col).alias("_hi"),
                                 F.count(F.lit(1)).alias("_n"))
    # sub-ranges per key: enough for about CHUNK_ROWS rows per chunk, at most sub_buckets
    cuts = cuts.withColumn("_sb", F.least(F.lit(sub_buckets), F.greatest(F.lit(1), F.ceil(
        F.col("_n") / F.lit(float(buckets * CHUNK_ROWS))))).cast("int"))
    x = df.join(F.broadcast(cuts) if few_keys else cuts, list(keys), "left").withColumn("_i", F.size(F.filter("_cuts", lambda c: c < v)))
    numeric = isinstance(df.schema[order_col].dataType, T.NumericType)
    if not numeric or sub_buckets <= 1:
        return x.withColumn("_chunk", F.col("_i")).drop("_cuts", "_lo", "_hi", "_i", "_n", "_sb")
    edges = F.concat(F.array(F.col("_lo")), F.col("_cuts"), F.array(F.col("_hi"))).cast("array<double>")
    lo, hi = F.get(edges, F.col("_i")), F.get(edges, F.col("_i") + 1)
    frac = F.when(hi > lo, (v.cast("double") - lo) / (hi - lo)).otherwise(F.lit(0.0))
    sb = F.col("_sb")
    sub = F.least(sb - 1, F.greatest(F.lit(0), F.floor(frac * sb).cast("int")))
    return (x.withColumn("_chunk", F.col("_i").cast("bigint") * sub_buckets + sub)
             .drop("_cuts", "_lo", "_hi", "_i", "_n", "_sb"))


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Sequence[str],
                chunk: Column | None = None, buckets: int = DEFAULT_BUCKETS,
                suffix: str = "_cum", few_keys: bool = False) -> DataFrame:
    """Exact ``sum(c) OVER (PARTITION BY keys ORDER BY order ROWS UNBOUNDED PRECEDING)``.

    ``order`` must be a total order within a key.  ``chunk`` is a Column
    monotone in ``order[0]`` (e.g. a minute of event time); when omitted
    :func:`quantile_chunk` ranges of ``order[0]`` are used.  ``df`` is read
    by several branches (cuts, chunk windows, chunk totals): when it is an
    expensive aggregate, cut its lineage first.
    """
    keys = list(keys)
    if chunk is None:
        # chunk ids come from a percentile aggregate joined back; the windows and
        # the chunk totals both read them, so they are written once
        x = cut_lineage(quantile_chunk(df, keys, order[0], buckets, few_keys=few_keys))
    else:
        x = df.withColumn("_chunk", chunk)
    w = (Window.partitionBy(*keys, "_chunk").orderBy(*order)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    x = x.withColumns({f"_loc{i}": F.sum(c).over(w) for i, c in enumerate(sums)})
    tot = x.groupBy(*keys, "_chunk").agg(*[F.sum(c).alias(f"_tot{i}") for i, c in enumerate(sums)])
    wo = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(*keys, "_chunk", *[F.coalesce(F.sum(f"_tot{i}").over(wo), F.lit(0)).alias(f"_off{i}")
                                        for i in range(len(sums))])
    x = x.join(off, keys + ["_chunk"], "left")
    out = x.withColumns({f"{c}{suffix}": F.col(f"_loc{i}") + F.col(f"_off{i}") for i, c in enumerate(sums)})
    return out.drop("_chunk", *[f"_loc{i}" for i in range(len(sums))],
                    *[f"_off{i}" for i in range(len(sums))])


def lag_exact(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str],
              chunk: Column, prefix: str = "prev_") -> DataFrame:
    """Exact ``lag(v) OVER (PARTITION BY keys ORDER BY order)`` for each value column.

    Rows are windowed per ``(key, chunk)``; the first row of a chunk takes
    the last row of the nearest earlier non-empty chunk of the same key,
    found in the per-chunk summary.
    """
    keys = list(keys)
    x = df.withColumn("_chunk", chunk)
    w = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    x = x.withColumn("_rn", F.row_number().over(w))
    x = x.withColumns({f"{prefix}{v}": F.lag(v).over(w) for v in values})
    last = x.groupBy(*keys, "_chunk").agg(
        F.max_by(F.struct(*[F.col(v) for v in values]), F.struct(*[F.col(o) for o in order])).alias("_last"))
    wc = Window.partitionBy(*keys).orderBy("_chunk")
    carry = last.select(*keys, "_chunk", F.lag("_last").over(wc).alias("_carry"))
    x = x.join(carry, keys + ["_chunk"], "left")
    x = x.withColumns({f"{prefix}{v}": F.when(F.col("_rn") == 1, F.col("_carry")[v])
                       .otherwise(F.col(f"{prefix}{v}")) for v in values})
    return x.drop("_chunk", "_rn", "_carry")


def number_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str,
                starts: Callable[[Column, Column], Column], chunk: Column, out: str) -> DataFrame:
    """Number the runs of each key: a row starts a new run when it is the
    key's first row or ``starts(previous value, value)`` holds.

    Exact ``sum(start) OVER (PARTITION BY keys ORDER BY order)`` without a
    whole key in one task: one window pass per (key, chunk) decides the
    rows after each chunk's first; a per-chunk summary (first value, last
    value, local starts) decides each chunk's first row and the number of
    runs before the chunk.
    """
    keys = list(keys)
    v = F.col(value)
    x = df.withColumn("_chunk", chunk)
    w = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    prev = F.lag(v).over(w)
    x = x.withColumn("_ls", F.when(F.row_number().over(w) > 1, starts(prev, v).cast("bigint")).otherwise(0))
    x = x.withColumn("_lc", F.sum("_ls").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    o = F.struct(*[F.col(c) for c in order])
    summ = x.groupBy(*keys, "_chunk").agg(F.min_by(v, o).alias("_fv"), F.max_by(v, o).alias("_lv"),
                                           F.sum("_ls").alias("_ns"))
    wc = Window.partitionBy(*keys).orderBy("_chunk")
    carry = F.lag("_lv").over(wc)
    first_starts = F.when(F.row_number().over(wc) == 1, F.lit(True)).otherwise(starts(carry, F.col("_fv")))
    summ = summ.withColumn("_fs", first_starts.cast("bigint"))
    summ = summ.withColumn("_off", F.coalesce(
        F.sum(F.col("_ns") + F.col("_fs")).over(wc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    x = x.join(summ.select(*keys, "_chunk", "_off", "_fs"), keys + ["_chunk"], "left")
    return x.withColumn(out, F.col("_off") + F.col("_fs") + F.col("_lc")).drop("_chunk", "_ls", "_lc", "_off", "_fs")


def gap_episodes(df: DataFrame, keys: Sequence[str], order: Sequence[str], gap: Column,
                 chunk: Column, out: str = "episode") -> DataFrame:
    """Number the episodes of each key: a new episode starts at a key's first
    row and after every pause of at least ``gap`` (an interval) between
    consecutive rows (``order[0]`` is the time column)."""
    return number_runs(df, keys, order, order[0], lambda p, c: c - p >= gap, chunk, out)
