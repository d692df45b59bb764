"""Time-series metric operators: counter increase/rate, histogram quantile, zero fill, latest.

Series are long rows ``(labels..., ts, value)``.  Ordered steps (the
previous sample of a counter) use :func:`driftline.operators.sequence.lag_exact`,
which windows per (series, time chunk) and repairs chunk edges, so a hot
series is spread over many tasks.  Per-step results are plain ``groupBy``
aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.operators.sequence import lag_exact, time_chunk


def counter_increase(df: DataFrame, series: Sequence[str], order: Sequence[str], value: str,
                     step: str, chunk: Column | None = None, name: str = "increase") -> DataFrame:
    """W1 numerator: per (series, step) sum of counter increases.

    A sample adds ``v - prev``; a drop (``v < prev``) is a counter reset and
    adds ``v``; the first sample of a series adds 0.  No extrapolation to
    the step edges (documented difference from PromQL ``increase``).
    """
    series = list(series)
    chunk = chunk if chunk is not None else time_chunk(order[0])
    x = lag_exact(df, series, order, [value], chunk, prefix="_prev_")
    v, p = F.col(value), F.col(f"_prev_{value}")
    inc = F.when(p.isNull(), F.lit(0)).when(v >= p, v - p).otherwise(v)
    return x.groupBy(*series, step).agg(F.sum(inc).alias(name))


def sliding_increase(df: DataFrame, series: Sequence[str], order: Sequence[str], value: str, step: str,
                     range_steps: int, interval: str = "1 hour", chunk: Column | None = None,
                     name: str = "increase") -> DataFrame:
    """W1 with a range wider than the step: the increase over ``[eval_at - range, eval_at)`` at every step ``eval_at``.

    Only pairs of samples that both lie in the range count, and a range with
    fewer than two samples has no row.  The samples are summed per step
    first; a range is then the sum of its steps less the increase into its
    first sample, so only step rows are spread over the ranges they lie in.
    """
    series = list(series)
    x = lag_exact(df, series, order, [value], chunk if chunk is not None else time_chunk(order[0]), prefix="_prev_")
    v, p = F.col(value), F.col(f"_prev_{value}")
    inc = F.when(p.isNull(), F.lit(0)).when(v >= p, v - p).otherwise(v)
    per = x.groupBy(*series, step).agg(F.sum(inc).alias("_inc"), F.count(F.lit(1)).alias("_n"),
                                       F.min_by(inc, F.struct(*[F.col(c) for c in order])).alias("_into"))
    one = F.expr(f"INTERVAL {interval}")
    spread = per.withColumn("eval_at", F.explode(F.sequence(F.col(step) + one, F.col(step) + one * range_steps, one)))
    return (spread.groupBy(*series, "eval_at")
            .agg((F.sum("_inc") - F.min_by("_into", step)).alias(name), F.sum("_n").alias("_n"))
            .filter(F.col("_n") >= 2).drop("_n"))


EXTRAPOLATION_LIMIT = 1.1


def range_rate(df: DataFrame, series: Sequence[str], order: Sequence[str], value: str, step: str, range_steps: int, step_seconds: int,
               chunk: Column | None = None) -> DataFrame:
    """W1 with the edge rule of ``rate()``: per second over ``[eval_at - range, eval_at)`` at every step ``eval_at``.

    The increase between the first and last sample of a range is carried on to the range's edges: to an edge
    that is nearer than 1.1 mean gaps between the samples, else by half a mean gap; before the first
    sample no further than to where the counter would have been zero. ``increase`` is the sampled increase, ``rate``
    the extrapolated one per second. Ranges with fewer than two samples or no time between them have no row.
    Samples are summed per step first, so only step rows are spread over ranges.
    """
    series = list(series)
    x = lag_exact(df, series, order, [value], chunk if chunk is not None else time_chunk(order[0]), prefix="_prev_")
    v, p = F.col(value), F.col(f"_prev_{value}")
    inc = F.when(p.isNull(), F.lit(0)).when(v >= p, v - p).otherwise(v)
    place = F.struct(*[F.col(c) for c in order])
    per = x.groupBy(*series, step).agg(
        F.sum(inc).alias("_inc"), F.count(F.lit(1)).alias("_n"), F.max(order[0]).alias("_last"),
        F.min_by(F.struct(inc.alias("into"), F.col(order[0]).alias("ts"), v.cast("double").alias("v")), place).alias("_first"))
    one = F.make_dt_interval(secs=F.lit(step_seconds))
    spread = per.withColumn("eval_at", F.explode(F.sequence(F.col(step) + one, F.col(step) + one * range_steps, one)))
    r = (spread.groupBy(*series, "eval_at")
         .agg((F.sum("_inc") - F.min_by("_first.into", step)).alias("increase"), F.sum("_n").alias("_n"), F.max("_last").alias("_last"),
              F.min_by("_first", step).alias("_first")).filter(F.col("_n") >= 2))

    def seconds(ts: Column) -> Column:
        return F.unix_micros(ts) / F.lit(1e6)

    width = float(range_steps * step_seconds)
    sampled = seconds(F.col("_last")) - seconds(F.col("_first.ts"))
    r = r.withColumn("_sampled", sampled).filter(F.col("_sampled") > 0).withColumn("_gap", F.col("_sampled") / (F.col("_n") - 1))
    limit = F.col("_gap") * EXTRAPOLATION_LIMIT

    def carried(distance: Column) -> Column:
        return F.when(distance < limit, distance).otherwise(F.col("_gap") / 2)

    start = carried(seconds(F.col("_first.ts")) - (seconds(F.col("eval_at")) - F.lit(width)))
    to_zero = F.when((F.col("increase") > 0) & (F.col("_first.v") >= 0), F.col("_sampled") * F.col("_first.v") / F.col("increase"))
    end = carried(seconds(F.col("eval_at")) - seconds(F.col("_last")))
    total = F.col("_sampled") + F.least(start, F.coalesce(to_zero, start)) + end
    return r.select(*series, "eval_at", "increase", (F.col("increase") * (total / F.col("_sampled")) / F.lit(width)).alias("rate"))


def per_second(increase: str | Column, seconds: int, digits: int = 9) -> Column:
    """Increase over the range / range seconds."""
    c = F.col(increase) if isinstance(increase, str) else increase
    return F.round(c / F.lit(float(seconds)), digits)


def time_spine(df: DataFrame, step: str, interval: str = "1 hour") -> DataFrame:
    """All steps between the first and last step of ``df`` (one row per step)."""
    bounds = df.agg(F.min(step).alias("_lo"), F.max(step).alias("_hi"))
    return bounds.select(F.explode(F.sequence("_lo", "_hi", F.expr(f"INTERVAL {interval}"))).alias(step))


def zero_fill(values: DataFrame, spine: DataFrame, step: str, columns: Sequence[str]) -> DataFrame:
    """``... or vector(0)``: every spine step, missing values as 0."""
    j = spine.join(values, step, "left")
    return j.select(step, *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in columns])


def cumulative_buckets(value: str | Column, bounds: Sequence[float]) -> Column:
    """Cumulative bucket counts ``[count(v <= b_1), ..., count(v <= b_k), count(*)]``
    as one aggregate expression (the last element is the +Inf bucket)."""
    v = F.col(value) if isinstance(value, str) else value
    return F.array(*[F.count_if(v <= F.lit(float(b))) for b in bounds], F.count(F.lit(1))).cast("array<double>")


def histogram_quantile(q: float, bounds: Sequence[float], cum: str | Column) -> Column:
    """PromQL ``histogram_quantile`` over cumulative buckets (last = +Inf).

    First bucket whose cumulative count reaches ``q * total``; linear
    interpolation inside it from the previous bound (0 for the first
    bucket); the +Inf bucket answers the highest finite bound; an empty
    histogram answers NULL.
    """
    c = F.col(cum) if isinstance(cum, str) else cum
    k = len(bounds)
    ub = F.array(*[F.lit(float(b)) for b in bounds])
    total = F.element_at(c, -1)
    rank = F.lit(float(q)) * total
    b = F.size(F.filter(c, lambda x: x < rank))          # 0-based index of the bucket
    prev_cum = F.when(b > 0, F.get(c, b - 1)).otherwise(F.lit(0.0))
    start = F.when(b > 0, F.get(ub, b - 1)).otherwise(F.lit(0.0))
    end = F.get(ub, b)
    inside = start + (end - start) * (rank - prev_cum) / (F.get(c, b) - prev_cum)
    return (F.when(total <= 0, F.lit(None).cast("double"))
             .when(b >= k, F.lit(float(bounds[-1])))
             .when((b == 0) & (F.lit(float(bounds[0])) <= 0), F.lit(float(bounds[0])))
             .otherwise(inside))


def latest(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str],
           name: str | None = None) -> DataFrame:
    """The value of the newest sample per key (``max_by``, no sort)."""
    o = F.struct(*[F.col(c) for c in order])
    return df.groupBy(*keys).agg(F.max_by(F.col(value), o).alias(name or value),
                                 F.max(order[0]).alias(f"{order[0]}_latest"))


def uptime_seconds(as_of: Column, start: Column) -> Column:
    """``time() - process_start_time_seconds``."""
    return (F.unix_micros(as_of) - F.unix_micros(start)) / F.lit(1e6)


def ratio(num: Column, den: Column, scale: float = 1.0) -> Column:
    """Guarded ratio of two aggregates (NULL when the denominator is 0)."""
    return F.try_divide(num * F.lit(scale), den)
