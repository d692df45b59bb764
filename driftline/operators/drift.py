"""Two-sample drift: KS statistic, p-value, forced offset, summary, histograms.

Plan shape (both samples, all features at once):
unpivot -> ``groupBy(feature, value)`` side counts (partial aggregation, so
the shuffle carries distinct values, not rows) -> exact running sums per
feature via the chunked prefix sum -> ``max(|F_ref - F_cur|)`` per feature.
Everything after that has at most ``#features`` rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.operators.sequence import running_sum
from driftline.session import cut_lineage

P_THRESHOLD = 0.05
DATASET_SHARE = 0.3
KS_TERMS = 100
#: The exact p-value is used up to this size of the larger sample.
EXACT_SAMPLES = 10_000


def common_numeric_features(ref: DataFrame, cur: DataFrame, min_count: int = 10) -> list[str]:
    """Columns in both frames, numeric in both, >= ``min_count`` values each (NULL and NaN do not count)."""
    rt = {f.name: f.dataType for f in ref.schema.fields}
    ct = {f.name: f.dataType for f in cur.schema.fields}
    cands = sorted(c for c in set(rt) & set(ct)
                   if isinstance(rt[c], T.NumericType) and isinstance(ct[c], T.NumericType))
    if not cands:
        return []
    present = [F.count_if(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))).alias(c) for c in cands]
    counts = ref.agg(*present).unionByName(cur.agg(*present)).collect()  # one job, 2 rows
    return [c for c in cands if all(r[c] >= min_count for r in counts)]


def _long(df: DataFrame, features: Sequence[str], side: int) -> DataFrame:
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in features)
    return (df.select(F.expr(f"stack({len(features)}, {pairs}) AS (feature, value)"))
              .filter(F.col("value").isNotNull() & ~F.isnan("value"))
              .withColumn("side", F.lit(side)))


def value_counts(ref: DataFrame, cur: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, value, n_ref, n_cur): one row per distinct value per feature."""
    both = _long(ref, features, 0).unionByName(_long(cur, features, 1))
    return both.groupBy("feature", "value").agg(
        F.count_if(F.col("side") == 0).alias("n_ref"),
        F.count_if(F.col("side") == 1).alias("n_cur"))


def ks_statistic(ref: DataFrame, cur: DataFrame, features: Sequence[str] | None = None,
                 buckets: int = 64) -> DataFrame:
    """Per feature ``D = max_x |F_ref(x) - F_cur(x)|`` with the sample sizes."""
    if features is None:
        features = common_numeric_features(ref, cur)
    return ks_of_counts(value_counts(ref, cur, features), buckets)


def ks_of_counts(counts: DataFrame, buckets: int = 64) -> DataFrame:
    """A13 from (feature, value, n_ref, n_cur), one row per distinct value; a feature with an empty side has no score."""
    # distinct (feature, value) counts feed four consumers; written once to the
    # shared checkpoint folder instead of re-aggregating the input for each
    counts = cut_lineage(counts)
    cum = running_sum(counts, ["feature"], ["value"], ["n_ref", "n_cur"], buckets=buckets, few_keys=True)
    tot = counts.groupBy("feature").agg(F.sum("n_ref").alias("tot_ref"), F.sum("n_cur").alias("tot_cur"))
    gap = cum.join(F.broadcast(tot), "feature").select(  # a row for each feature
        "feature", "tot_ref", "tot_cur",
        F.abs(F.col("n_ref_cum") / F.col("tot_ref") - F.col("n_cur_cum") / F.col("tot_cur")).alias("gap"))
    return gap.groupBy("feature").agg(F.max("gap").alias("drift_score"),
                                      F.first("tot_ref").alias("n_ref"), F.first("tot_cur").alias("n_cur"))


def ks_pvalue_expr(d: str = "drift_score", n: str = "n_ref", m: str = "n_cur"):
    """Asymptotic Kolmogorov p-value, effective size n*m/(n+m).

    ``p = 2 * sum_{k>=1} (-1)^(k-1) exp(-2 k^2 lambda^2)``, lambda = sqrt(en) * D,
    clamped to [0, 1]; 1 for lambda < 0.2 where the series is not usable.
    """
    lam = F.sqrt(F.col(n) * F.col(m) / (F.col(n) + F.col(m))) * F.col(d)
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(KS_TERMS)), F.lit(0.0),
        lambda acc, k: acc + F.pow(F.lit(-1.0), k - 1) * F.exp(F.lit(-2.0) * k * k * lam * lam))
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(2.0) * series))
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(p)


def _share_of_paths(n: int, m: int, h: int) -> float:
    """Share of the lattice paths from (0, 0) to (n, m) with a point (i, j) where |i*m - j*n| >= h.

    A random path is followed diagonal by diagonal: ``at[i]`` is the chance to be at (i, k - i) without having
    touched such a point. What steps onto one is added up, so small shares come without cancellation and no
    number leaves the range of doubles.
    """
    if h <= 0:
        return 1.0
    i = np.arange(n + 1)
    at = np.zeros(n + 1)
    at[0], touched = 1.0, 0.0
    for k in range(n + m):
        left = n + m - k
        right = at * np.maximum(m - (k - i), 0) / left  # to (i, j + 1)
        up = at * (n - i) / left  # to (i + 1, j)
        at = right
        at[1:] += up[:-1]
        outside = np.abs(i * m - (k + 1 - i) * n) >= h
        touched += at[outside].sum()
        at[outside] = 0.0
    return float(min(1.0, touched))


def ks_pvalue_exact(d: Column, n: Column, m: Column) -> Column:
    """A14 for small samples: the chance of a gap of at least ``d`` under equal distributions, by counting lattice paths.

    Takes n*m steps a row, so it belongs on result rows (one per feature) with bounded n and m; null gives null.
    """
    @F.pandas_udf("double")
    def share(gap: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(g) or pd.isna(x) or pd.isna(y) or not x or not y
                          else _share_of_paths(min(int(x), int(y)), max(int(x), int(y)), round(g * x * y))
                          for g, x, y in zip(gap, a, b)], dtype="float64")

    return share(d, n, m)


def with_pvalue(ks: DataFrame, exact_samples: int = EXACT_SAMPLES) -> DataFrame:
    """``p_value`` exact where neither sample is larger than ``exact_samples``, else by the limiting series."""
    small = F.greatest("n_ref", "n_cur") <= exact_samples
    exact = ks_pvalue_exact(F.when(small, F.col("drift_score")), F.col("n_ref").cast("double"), F.col("n_cur").cast("double"))
    return ks.withColumn("_exact", exact).withColumn("p_value", F.when(small, F.col("_exact")).otherwise(ks_pvalue_expr())).drop("_exact")


def feature_drift(ref: DataFrame, cur: DataFrame, features: Sequence[str] | None = None,
                  forced_pct: float | None = None) -> DataFrame:
    """Per feature score, p-value and flag (forced offset moves the score only)."""
    ks = ks_statistic(ref, cur, features)
    out = ks.withColumn("p_value", ks_pvalue_expr())
    out = out.withColumn("drift_detected", F.col("p_value") < F.lit(P_THRESHOLD))
    if forced_pct:
        out = out.withColumn("drift_score", F.least(F.lit(1.0), F.col("drift_score") + F.lit(forced_pct)))
    return out


def drift_summary(per_feature: DataFrame) -> DataFrame:
    """Mean score, #drifted, #analysed; dataset drift when share > 0.3 (false when none)."""
    agg = per_feature.agg(F.avg("drift_score").alias("drift_score"),
                          F.count_if("drift_detected").alias("drifted_features_count"),
                          F.count(F.lit(1)).alias("total_features_analyzed"))
    return agg.select(
        F.coalesce(F.col("drift_score"), F.lit(0.0)).alias("drift_score"),
        F.when(F.col("total_features_analyzed") > 0,
               F.col("drifted_features_count") / F.col("total_features_analyzed") > DATASET_SHARE)
         .otherwise(F.lit(False)).alias("drift_detected"),
        "drifted_features_count", "total_features_analyzed")


def top_drifted(per_feature: DataFrame, n: int = 5) -> DataFrame:
    """L2: top ``n`` features by score (ties by name)."""
    return per_feature.orderBy(F.col("drift_score").desc(), F.col("feature").asc()).limit(n)


def shared_histogram(ref: DataFrame, cur: DataFrame, features: Sequence[str], bins: int = 15) -> DataFrame:
    """``bins`` equal-width bins on the reference min..max, same edges for current.

    A value belongs to the last bin whose lower edge it reaches, compared with the edges themselves (a
    quotient alone misplaces values that lie on one).  Last bin closed; out-of-range values dropped; a
    constant column gets the range v +/- 0.5.  All bins are returned, empty ones with 0.
    """
    long = _long(ref, features, 0).unionByName(_long(cur, features, 1))
    rng = (long.filter(F.col("side") == 0).groupBy("feature")
               .agg(F.min("value").alias("lo"), F.max("value").alias("hi")))
    rng = rng.select("feature",
                     F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
                     F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    v, lo, hi = F.col("value"), F.col("lo"), F.col("hi")
    rng = F.broadcast(rng)  # a row for each feature
    step = (hi - lo) / bins
    guess = F.least(F.lit(bins - 1), F.floor((v - lo) / (hi - lo) * bins).cast("int"))
    at = F.when(v < lo + guess * step, guess - 1).when(
        (guess < bins - 1) & (v >= lo + (guess + 1) * step), guess + 1).otherwise(guess)
    b = at + 1
    counts = (long.join(rng, "feature").filter((v >= lo) & (v <= hi))
                  .groupBy("feature", b.alias("bin"))
                  .agg(F.count_if(F.col("side") == 0).alias("ref_count"),
                       F.count_if(F.col("side") == 1).alias("cur_count")))
    grid = rng.select("feature", "lo", "hi", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    width = (hi - lo) / bins
    return (grid.join(counts, ["feature", "bin"], "left")
                .select("feature", "bin",
                        (lo + (F.col("bin") - 1) * width).alias("edge_lo"),
                        (lo + F.col("bin") * width).alias("edge_hi"),
                        F.coalesce("ref_count", F.lit(0)).alias("ref_count"),
                        F.coalesce("cur_count", F.lit(0)).alias("cur_count")))
