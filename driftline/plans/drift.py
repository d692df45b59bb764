"""Drift queries: reference = lines with quantity <= 30, current = quantity > 20.

Quantity and price therefore drift, discount / tax / line number do not.
``l_returnflag`` (text) and the one-sided key columns are skipped by the
common-numeric-column rule.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.functions import labels
from driftline.operators import drift
from driftline.plans.registry import query
from driftline.session import cut_lineage, scratch_path
from driftline.sources.tables import Tables
from driftline.sources.versions import VersionedTable

FEATURES = ["l_discount", "l_extendedprice", "l_linenumber", "l_quantity", "l_tax"]
FORCED_PCT = 0.25
#: Property of the reference table that holds a forced drift.
FORCED = "forced_drift"


def samples(spark, sf):
    li = Tables(spark, sf).lineitem
    ref = li.filter(F.col("l_quantity") <= 30).select(*FEATURES, "l_returnflag", "l_partkey")
    cur = li.filter(F.col("l_quantity") > 20).select(*FEATURES, "l_returnflag", "l_suppkey")
    return ref, cur


def per_feature(spark, sf, forced=None):
    ref, cur = samples(spark, sf)
    return drift.feature_drift(ref, cur, drift.common_numeric_features(ref, cur), forced)


def _long_sql(side, table):
    return "\n  UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value, {side} AS side FROM {table}" for c in FEATURES)


_KS_SQL = f"""
WITH ref AS (SELECT * FROM lineitem WHERE l_quantity <= 30),
cur AS (SELECT * FROM lineitem WHERE l_quantity > 20),
long AS ({_long_sql(0, 'ref')}
  UNION ALL {_long_sql(1, 'cur')}),
vc AS (SELECT feature, value, COUNT(*) FILTER (WHERE side = 0) AS n_ref, COUNT(*) FILTER (WHERE side = 1) AS n_cur
       FROM long WHERE value IS NOT NULL GROUP BY feature, value),
cum AS (SELECT feature,
          sum(n_ref) OVER (PARTITION BY feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cr,
          sum(n_cur) OVER (PARTITION BY feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cc,
          sum(n_ref) OVER (PARTITION BY feature) AS nr, sum(n_cur) OVER (PARTITION BY feature) AS nc
        FROM vc),
ks AS (SELECT feature, max(abs(cr / nr - cc / nc)) AS d, CAST(any_value(nr) AS BIGINT) AS n_ref,
              CAST(any_value(nc) AS BIGINT) AS n_cur FROM cum GROUP BY feature),
pv AS (SELECT feature, d, n_ref, n_cur,
         CASE WHEN sqrt(n_ref * n_cur / (n_ref + n_cur)) * d < 0.2 THEN 1.0
              ELSE least(1.0, greatest(0.0, 2.0 * list_sum(list_transform(range(1, {drift.KS_TERMS + 1}),
                     lambda k: pow(-1.0, k - 1) * exp(-2.0 * k * k * pow(sqrt(n_ref * n_cur / (n_ref + n_cur)) * d, 2))))))
         END AS p FROM ks)
"""


def _round(df, *cols, digits=9):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query("drift_ks", _KS_SQL + """
SELECT feature, ROUND(d, 9) AS drift_score, n_ref, n_cur FROM pv
""")
def drift_ks(spark, sf):
    ref, cur = samples(spark, sf)
    ks = drift.ks_statistic(ref, cur, drift.common_numeric_features(ref, cur))
    return _round(ks, "drift_score")


@query("drift_pvalue", _KS_SQL + """
SELECT feature, ROUND(d, 9) AS drift_score, ROUND(p, 6) AS p_value, p < 0.05 AS drift_detected FROM pv
""")
def drift_pvalue(spark, sf):
    d = per_feature(spark, sf)
    return d.select("feature", F.round("drift_score", 9).alias("drift_score"),
                    F.round("p_value", 6).alias("p_value"), "drift_detected")


@query("drift_forced", _KS_SQL + f"""
SELECT feature, ROUND(least(1.0, d + {FORCED_PCT}), 9) AS drift_score, p < 0.05 AS drift_detected FROM pv
""")
def drift_forced(spark, sf):
    d = per_feature(spark, sf, FORCED_PCT)
    return d.select("feature", F.round("drift_score", 9).alias("drift_score"), "drift_detected")


@query("drift_summary", _KS_SQL + """
SELECT ROUND(COALESCE(avg(d), 0.0), 9) AS drift_score,
       CASE WHEN COUNT(*) > 0 THEN COUNT(*) FILTER (WHERE p < 0.05) / COUNT(*) > 0.3 ELSE false END AS drift_detected,
       COUNT(*) FILTER (WHERE p < 0.05) AS drifted_features_count, COUNT(*) AS total_features_analyzed
FROM pv
""")
def drift_summary(spark, sf):
    s = drift.drift_summary(per_feature(spark, sf))
    return s.withColumn("drift_score", F.round("drift_score", 9))


@query("drift_top5", _KS_SQL + """
SELECT feature, ROUND(d, 9) AS drift_score FROM pv ORDER BY d DESC, feature ASC LIMIT 5
""")
def drift_top5(spark, sf):
    top = drift.top_drifted(per_feature(spark, sf), 5)
    return top.select("feature", F.round("drift_score", 9).alias("drift_score"))


@query("drift_bands", _KS_SQL + """
SELECT feature, ROUND(d, 9) AS drift_score,
       CASE WHEN d > 0.3 THEN 'high' WHEN d > 0.1 THEN 'medium' ELSE 'low' END AS severity FROM pv
""")
def drift_bands(spark, sf):
    d = per_feature(spark, sf)
    return d.select("feature", F.round("drift_score", 9).alias("drift_score"),
                    labels.drift_severity("drift_score").alias("severity"))


@query("drift_histogram", f"""
WITH ref AS (SELECT * FROM lineitem WHERE l_quantity <= 30),
cur AS (SELECT * FROM lineitem WHERE l_quantity > 20),
long AS ({_long_sql(0, 'ref')}
  UNION ALL {_long_sql(1, 'cur')}),
r0 AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM long WHERE side = 0 AND value IS NOT NULL GROUP BY feature),
rng AS (SELECT feature, CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS lo,
               CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS hi FROM r0),
c AS (SELECT l.feature, CAST(len(list_filter(range(0, 15), lambda i: lo + i * ((hi - lo) / 15) <= value)) AS INTEGER) AS bin,
             COUNT(*) FILTER (WHERE side = 0) AS ref_count, COUNT(*) FILTER (WHERE side = 1) AS cur_count
      FROM long l JOIN rng USING (feature) WHERE value >= lo AND value <= hi GROUP BY 1, 2),
g AS (SELECT feature, lo, hi, CAST(b AS INTEGER) AS bin FROM rng, range(1, 16) t(b))
SELECT g.feature, g.bin, lo + (g.bin - 1) * ((hi - lo) / 15) AS edge_lo, lo + g.bin * ((hi - lo) / 15) AS edge_hi,
       COALESCE(ref_count, 0) AS ref_count, COALESCE(cur_count, 0) AS cur_count
FROM g LEFT JOIN c ON g.feature = c.feature AND g.bin = c.bin
""")
def drift_histogram(spark, sf):
    ref, cur = samples(spark, sf)
    return drift.shared_histogram(ref, cur, FEATURES, 15)


@query("drift_reset", """
SELECT l_discount, l_extendedprice, l_linenumber, l_quantity, l_tax FROM lineitem WHERE l_quantity > 20
""")
def drift_reset(spark, sf):
    """K6 + K7: the reference table holds the old sample; the current one is written beside it, becomes the table in one
    step and is read back."""
    ref, cur = samples(spark, sf)
    table = VersionedTable(spark, scratch_path(spark, "drift_reference"))
    table.replace(ref.select(*FEATURES))
    return table.read(table.replace(cur.select(*FEATURES)))


@query("drift_forced_reset", _KS_SQL + f"""
SELECT 'before' AS stage, feature, ROUND(least(1.0, d + {FORCED_PCT}), 9) AS drift_score FROM pv
UNION ALL SELECT 'after', feature, 0.0 FROM pv
""")
def drift_forced_reset(spark, sf):
    """A15 + K7: a forced drift is kept with the reference table and ends when the current sample is promoted."""
    ref, cur = samples(spark, sf)
    table = VersionedTable(spark, scratch_path(spark, "drift_reference"))
    table.replace(ref.select(*FEATURES))
    table.set_property(FORCED, FORCED_PCT)

    def scores(stage: str):
        d = drift.feature_drift(table.read(), cur, FEATURES, table.manifest().properties.get(FORCED))
        return d.select(F.lit(stage).alias("stage"), "feature", F.round("drift_score", 9).alias("drift_score"))

    before = cut_lineage(scores("before"))  # a row for each feature, read before the table changes
    table.replace(cur.select(*FEATURES))  # one step: the new sample, without the forced drift
    return before.unionByName(scores("after"))


EXACT_GROUPS = 60

# An independent count: whole numbers of paths that stay inside the band, row by row, over all paths.
_EXACT_SQL = f"""
WITH RECURSIVE e AS (SELECT CAST(user_id % {EXACT_GROUPS} AS VARCHAR) AS feature, value, day(ts) > 15 AS is_cur FROM events WHERE value IS NOT NULL),
c AS (SELECT feature, value, count(*) FILTER (NOT is_cur) AS r, count(*) FILTER (is_cur) AS q FROM e GROUP BY feature, value),
a AS (SELECT feature, sum(r) OVER w AS r, sum(q) OVER w AS q, sum(r) OVER (PARTITION BY feature) AS n, sum(q) OVER (PARTITION BY feature) AS m
      FROM c WINDOW w AS (PARTITION BY feature ORDER BY value)),
s AS (SELECT feature, CAST(n AS BIGINT) AS n, CAST(m AS BIGINT) AS m, CAST(max(abs(r * m - q * n)) AS BIGINT) AS h FROM a WHERE n > 0 AND m > 0 GROUP BY feature, n, m),
p AS (
  SELECT feature, n, m, h, CAST(0 AS BIGINT) AS i, list_transform(range(m + 1), lambda j: CASE WHEN j * n < h THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS u FROM s
  UNION ALL
  SELECT feature, n, m, h, i + 1,
         list_transform(range(m + 1), lambda j: CASE WHEN abs((i + 1) * m - j * n) < h THEN
           list_sum(list_transform(range(j + 1), lambda l: CASE WHEN abs((i + 1) * m - l * n) < h THEN u[l + 1] ELSE 0.0::DOUBLE END)) ELSE 0.0::DOUBLE END)
  FROM p WHERE i < n)
SELECT feature, n AS n_ref, m AS n_cur, round(h / (n * m), 9) AS drift_score,
       round(1 - u[m + 1] / exp(lgamma(n + m + 1) - lgamma(n + 1) - lgamma(m + 1)), 6) AS p_value
FROM p WHERE i = n"""


@query("drift_pvalue_exact", _EXACT_SQL)
def drift_pvalue_exact(spark, sf):
    """A14 on small samples: the values of user groups before and after the middle of the month, exact p-values."""
    ev = Tables(spark, sf).events.filter(F.col("value").isNotNull())
    late = F.dayofmonth("ts") > 15
    counts = ev.groupBy((F.col("user_id") % EXACT_GROUPS).cast("string").alias("feature"), "value").agg(
        F.count_if(~late).alias("n_ref"), F.count_if(late).alias("n_cur"))
    ks = drift.with_pvalue(drift.ks_of_counts(counts).filter((F.col("n_ref") > 0) & (F.col("n_cur") > 0)))
    return ks.select("feature", "n_ref", "n_cur", F.round("drift_score", 9).alias("drift_score"), F.round("p_value", 6).alias("p_value"))
