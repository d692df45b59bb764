"""Dashboard queries (counts, shares, top-N, class distribution)."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.operators import profile
from driftline.plans.registry import query
from driftline.sources.tables import Tables

# Return-flag labels used by the condition-share panel.
RETURNFLAG_LABELS = {"A": "Accepted", "N": "Not returned", "R": "Returned"}
SHARE_YEAR = 1998


@query("share_by_condition", f"""
WITH conditions AS (
  SELECT CASE WHEN l_returnflag = 'A' THEN 'Accepted'
              WHEN l_returnflag = 'N' THEN 'Not returned'
              WHEN l_returnflag = 'R' THEN 'Returned'
              ELSE 'Unspecified' END AS condition,
         COUNT(*) AS n
  FROM lineitem
  WHERE TRY_CAST(CAST(year(l_shipdate) AS VARCHAR) AS INTEGER) = {SHARE_YEAR}
    AND l_returnflag IS NOT NULL
  GROUP BY 1
), total AS (SELECT SUM(n) AS t FROM conditions)
SELECT condition, n, ROUND(n * 100.0 / t, 4) AS pct
FROM conditions, total
ORDER BY pct DESC
""")
def share_by_condition(spark, sf):
    li = Tables(spark, sf).lineitem
    pred = profile.in_year("l_shipdate", SHARE_YEAR) & F.col("l_returnflag").isNotNull()
    label = profile.case_label("l_returnflag", RETURNFLAG_LABELS, "Unspecified")
    return profile.share_by_condition(li, label, pred, scale=4).orderBy(F.col("pct").desc())


@query("top_groups", """
SELECT o_custkey, COUNT(*) AS n
FROM orders GROUP BY o_custkey
ORDER BY n DESC, o_custkey ASC LIMIT 10
""")
def top_groups(spark, sf):
    return profile.top_groups(Tables(spark, sf).orders, "o_custkey", 10)


@query("count_by_year", f"""
SELECT COUNT(*) AS n FROM lineitem
WHERE TRY_CAST(CAST(year(l_shipdate) AS VARCHAR) AS INTEGER) = {SHARE_YEAR}
""")
def count_by_year(spark, sf):
    li = Tables(spark, sf).lineitem
    return profile.count_where(li, profile.in_year("l_shipdate", SHARE_YEAR))


@query("class_counts", """
SELECT l_returnflag, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag
""")
def class_counts(spark, sf):
    return profile.group_count(Tables(spark, sf).lineitem, ["l_returnflag"])


@query("class_distribution", """
WITH c AS (
  SELECT CAST(SUM(CASE WHEN quality IN (1) THEN 1 ELSE 0 END) AS BIGINT) AS pos,
         CAST(SUM(CASE WHEN quality IN (1) THEN 0 ELSE 1 END) AS BIGINT) AS neg,
         COUNT(*) AS total
  FROM labels)
SELECT 'severe' AS class, pos AS n, ROUND(pos * 100.0 / total, 2) AS pct FROM c WHERE total > 0
UNION ALL
SELECT 'other' AS class, neg AS n, ROUND(neg * 100.0 / total, 2) AS pct FROM c WHERE total > 0
""")
def class_distribution(spark, sf):
    return profile.binary_distribution(Tables(spark, sf).labels, "quality", [1])


@query("null_profile", """
WITH x AS (
  SELECT NULLIF(l_discount, 0.0) AS l_discount, NULLIF(l_tax, 0.0) AS l_tax,
         NULLIF(l_returnflag, 'N') AS l_returnflag, l_quantity
  FROM lineitem)
SELECT 'l_discount' AS column_name, COUNT(*) FILTER (WHERE l_discount IS NULL) AS n_null, COUNT(*) AS n_rows FROM x
UNION ALL SELECT 'l_tax', COUNT(*) FILTER (WHERE l_tax IS NULL), COUNT(*) FROM x
UNION ALL SELECT 'l_returnflag', COUNT(*) FILTER (WHERE l_returnflag IS NULL), COUNT(*) FROM x
UNION ALL SELECT 'l_quantity', COUNT(*) FILTER (WHERE l_quantity IS NULL), COUNT(*) FROM x
""")
def null_profile(spark, sf):
    li = Tables(spark, sf).lineitem.select(
        F.nullif("l_discount", F.lit(0.0)).alias("l_discount"),
        F.nullif("l_tax", F.lit(0.0)).alias("l_tax"),
        F.nullif("l_returnflag", F.lit("N")).alias("l_returnflag"),
        "l_quantity")
    return profile.null_profile(li, ["l_discount", "l_tax", "l_returnflag", "l_quantity"])


@query("preview", """
SELECT * FROM orders ORDER BY o_orderkey LIMIT 10
""")
def preview(spark, sf):
    """Ordered preview (the limit is the feature)."""
    return Tables(spark, sf).orders.orderBy("o_orderkey").limit(10)
