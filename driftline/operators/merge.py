"""Full outer merges on a shared key and the ordered row cap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.session import cut_lineage


HOT_KEY_ROWS = 5_000_000


def full_outer_salted(left: DataFrame, right: DataFrame, key: str, hot_rows: int = HOT_KEY_ROWS,
                      hot: DataFrame | None = None) -> DataFrame:
    """J1 step: ``left FULL OUTER JOIN right USING (key)`` that splits hot keys.

    AQE's skew splitting does not apply to full outer joins, so a key with
    more than ``hot_rows`` rows on either side is handled apart: every row
    of such a key matches every row of the other side, so its full outer
    result is the inner product (or the rows of the one non-empty side).
    The larger side is spread over ``ceil(max(n_l, n_r) / hot_rows)`` salts
    and the smaller side is replicated once per salt, so each (key, salt)
    task holds at most about ``hot_rows`` rows of the large side.  The hot
    key table has at most (rows / ``hot_rows``) entries, which bounds its
    broadcast.  All other keys take the plain full outer join.
    """
    if hot is None:
        hot = _hot_steps(_counts_by_input([left, right], key), key, hot_rows)[0]
    hot = F.broadcast(hot.withColumn("_s", F.ceil(F.greatest("_nl", "_nr") / F.lit(hot_rows)).cast("int")))
    # (the hot table has <= (rows of both sides) / hot_rows entries)
    lt = left.join(hot, key, "left")
    rt = right.join(hot, key, "left")
    cold = lt.filter(F.col("_s").isNull()).drop("_nl", "_nr", "_s") \
             .join(rt.filter(F.col("_s").isNull()).drop("_nl", "_nr", "_s"), key, "full_outer")
    lh, rh = lt.filter(F.col("_s").isNotNull()), rt.filter(F.col("_s").isNotNull())
    lcols = [c for c in left.columns if c != key]
    rcols = [c for c in right.columns if c != key]
    salted_left = F.col("_nl") >= F.col("_nr")
    every_salt = F.sequence(F.lit(0), F.col("_s") - 1)

    def row_salt(cols):
        return F.array(F.pmod(F.xxhash64(*[F.col(c) for c in cols]), F.col("_s")))

    lh = lh.withColumn("_salt", F.explode(F.when(salted_left, row_salt([key, *lcols])).otherwise(every_salt)))
    rh = rh.withColumn("_salt", F.explode(F.when(~salted_left, row_salt([key, *rcols])).otherwise(every_salt)))
    both = (lh.filter(F.col("_nr") > 0).drop("_nl", "_nr", "_s")
              .join(rh.filter(F.col("_nl") > 0).drop("_nl", "_nr", "_s"), [key, "_salt"]).drop("_salt"))
    only_left = lh.filter(F.col("_nr") == 0).drop("_nl", "_nr", "_s", "_salt")
    only_right = rh.filter(F.col("_nl") == 0).drop("_nl", "_nr", "_s", "_salt")
    return cold.unionByName(both).unionByName(only_left, allowMissingColumns=True) \
               .unionByName(only_right, allowMissingColumns=True)


def _counts_by_input(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """(key, _n0, _n1, ..): the rows of each non-null key in every input; one shuffle of counts (doubles: their products are large)."""
    every = None
    for i, f in enumerate(frames):
        own = f.filter(F.col(key).isNotNull()).select(key, *[F.lit(float(i == j)).alias(f"_n{j}") for j in range(len(frames))])
        every = own if every is None else every.unionByName(own)
    return every.groupBy(key).agg(*[F.sum(f"_n{j}").alias(f"_n{j}") for j in range(len(frames))])


def _hot_steps(counts: DataFrame, key: str, hot_rows: int) -> list[DataFrame]:
    """For each step of the chain its keys with more than ``hot_rows`` rows on a side: (key, _nl, _nr)."""
    steps, held = [], F.col("_n0")
    for j in range(1, len(counts.columns) - 1):
        own = F.col(f"_n{j}")
        steps.append(counts.filter(F.greatest(held, own) > hot_rows).select(key, held.alias("_nl"), own.alias("_nr")))
        held = F.when(held == 0, own).when(own == 0, held).otherwise(held * own)
    return steps


def merge_outer(frames: Sequence[DataFrame], key: str, hot_rows: int = HOT_KEY_ROWS,
                counts: DataFrame | None = None) -> DataFrame:
    """Chained full outer equi-joins on ``key`` (SQL NULL semantics).

    Hot keys are found before any join: per-key row counts of every input
    (one table, kept until the plan is chosen, or ``counts`` where the caller has it) give the per-key size of each intermediate result
    without computing it (a full outer join of n and m rows of one key has
    n*m rows, or the non-empty side).  The product of the inputs' largest
    per-key counts bounds them all; when that bound, or else the exact
    per-step check, finds no key above ``hot_rows`` rows, the plan is the plain
    chain of sort-merge full outer joins; otherwise every step is
    :func:`full_outer_salted` and the intermediate results are cut from the
    lineage.  The key is coalesced as in a ``USING`` join.  NULL keys never
    match (pairing NULL keys with each other would be an all-pairs product
    over the NULL group and is deliberately not reproduced).
    """
    frames = list(frames)
    seen = set(frames[0].columns)
    for i in range(1, len(frames)):
        dup = (seen & set(frames[i].columns)) - {key}
        if dup:
            frames[i] = frames[i].drop(*dup)  # P2: drop overlapping columns from the right side
        seen |= set(frames[i].columns)
    keyless = [f.filter(F.col(key).isNull()) for f in frames]
    frames = [f.filter(F.col(key).isNotNull()) for f in frames]
    own = counts is None
    if own:  # read once for each question below, then let go; a lost executor's part is counted again
        counts = _counts_by_input(frames, key).persist()
    # Upper bound first: the largest key of any intermediate result has at most
    # prod(max rows per key of each input) rows.
    bound = 1.0
    for most in counts.agg(*[F.max(f"_n{j}") for j in range(len(frames))]).first():
        bound *= max(1.0, most or 0.0)
    any_hot = False
    if bound > hot_rows:                 # exact per-step hot keys only when they can exist
        hots = _hot_steps(counts, key, hot_rows)
        any_hot = any(not h.isEmpty() for h in hots)
    out = frames[0]
    for i, f in enumerate(frames[1:]):
        if any_hot:
            out = cut_lineage(full_outer_salted(out, f, key, hot_rows, hots[i]))
        else:
            out = out.join(f, on=key, how="full_outer")
    if own:  # hot steps are written by now, the plain chain does not read the counts
        counts.unpersist()
    for rows in keyless:
        out = out.unionByName(rows, allowMissingColumns=True)
    return out


def cut_key(frames: Sequence[DataFrame], key: str, limit: int, slack: float = 4.0, counts: DataFrame | None = None):
    """A key up to which the outer merge has at least ``limit`` rows, or None where it has no more than that in all.

    Reads the per-key row counts (:func:`_counts_by_input`) only.  Each round looks at halving shares of the keys that are left and
    takes the least that still holds ``limit`` rows; it ends when that is within ``slack`` times the limit,
    or when a round gains nothing (a hot key, or the accuracy of the quantiles).
    """
    if counts is None:
        counts = cut_lineage(_counts_by_input(frames, key))
    n = F.lit(1.0)
    for c in counts.columns:
        n = n if c == key else n * F.greatest(F.col(c), F.lit(1.0))
    left = counts.select(key, n.alias("_n"))
    held, cut = left.agg(F.sum("_n").alias("n")).first()["n"] or 0.0, None
    if held <= limit:
        return None
    while held > slack * limit:
        shares = [2.0 ** -j for j in range(13, 0, -1)]
        cuts = left.agg(F.percentile_approx(key, shares, 10_000).alias("c")).first()["c"]
        sums = left.agg(*[F.sum(F.when(F.col(key) <= F.lit(c), F.col("_n"))).alias(f"s{i}") for i, c in enumerate(cuts)]).first()
        enough = [i for i in range(len(cuts)) if (sums[f"s{i}"] or 0.0) >= limit]
        if not enough or sums[f"s{enough[0]}"] >= held:
            break
        cut, held = cuts[enough[0]], sums[f"s{enough[0]}"]
        left = left.filter(F.col(key) <= F.lit(cut))
    return cut


def merge_cap(frames: Sequence[DataFrame], key: str, order: Sequence[str], limit: int,
              hot_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """J1 + L1: the first ``limit`` rows of the outer merge in a total order that begins with the key (nulls last).

    The cut is made before the merge: per-key counts tell up to which key the answer reaches, and every
    input is filtered to it, so the merge itself has about ``limit`` rows.  Keys without a numeric or time
    order, and merges of at most ``limit`` rows, are merged whole.
    """
    if order[0] != key:
        raise ValueError(f"the order must begin with {key}")
    counts = cut_lineage(_counts_by_input(frames, key))
    if isinstance(frames[0].schema[key].dataType, (T.NumericType, T.DateType, T.TimestampType)):
        cut = cut_key(frames, key, limit, counts=counts)
        if cut is not None:
            frames = [f.filter(F.col(key) <= F.lit(cut)) for f in frames]
            counts = counts.filter(F.col(key) <= F.lit(cut))
    return merge_outer(frames, key, hot_rows, counts).orderBy(*[F.col(c).asc_nulls_last() for c in order]).limit(limit)


def cap_rows(df: DataFrame, order: Sequence[str], limit: int, slack: float = 1.1) -> DataFrame:
    """L1: keep the first ``limit`` rows in a total key order (nulls last).

    A plain top-k sends every partition's best ``limit`` rows to one final
    task (#partitions x limit rows).  When the leading order column is
    orderable by ``percentile_approx`` (numbers, dates, timestamps), a
    threshold on it is found first (one approximate-quantile aggregate,
    checked by an exact count) and only rows at or below it enter the
    top-k, so the final task sees about ``limit * slack`` rows.  Ties and
    NULL keys are still ordered exactly by the top-k.
    """
    ordered = [F.col(c).asc_nulls_last() for c in order]
    lead = order[0]
    if not isinstance(df.schema[lead].dataType, (T.NumericType, T.DateType, T.TimestampType)):
        return df.orderBy(*ordered).limit(limit)
    stats = df.agg(F.count(F.lit(1)).alias("n"), F.count(lead).alias("nk")).first()
    if stats["nk"] <= limit:
        # every non-null key is in the answer; the top-k only has to pick among NULL keys
        return df.orderBy(*ordered).limit(limit)
    q = min(1.0, slack * limit / stats["nk"])
    cut = df.agg(F.percentile_approx(lead, q, 10_000).alias("t")).first()["t"]
    kept = df.filter(F.col(lead) <= F.lit(cut))
    if kept.count() < limit:  # the approximation undershot: fall back to the exact top-k
        kept = df
    return kept.orderBy(*ordered).limit(limit)
