"""Prepare / evaluate queries on lineitem (exact oracles)."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.functions import labels
from driftline.operators import evaluate, prepare
from driftline.plans.registry import query
from driftline.sources.tables import Tables


def _with_nulls(li):
    """Zero discounts/taxes and the 'N' flag stand for missing values."""
    return li.select("l_orderkey", "l_linenumber",
                     F.nullif("l_discount", F.lit(0.0)).alias("d"),
                     F.nullif("l_tax", F.lit(0.0)).alias("t"),
                     F.nullif("l_returnflag", F.lit("N")).alias("f"),
                     F.col("l_quantity").alias("q"))


_NULLS_SQL = """SELECT l_orderkey, l_linenumber, NULLIF(l_discount, 0.0) AS d, NULLIF(l_tax, 0.0) AS t,
       NULLIF(l_returnflag, 'N') AS f, l_quantity AS q FROM lineitem"""


def _mode_sql(c):
    return f"(SELECT {c} FROM x WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY COUNT(*) DESC, {c} ASC LIMIT 1)"


@query("impute_mode", f"""
WITH x AS ({_NULLS_SQL})
SELECT l_orderkey, l_linenumber, COALESCE(d, {_mode_sql('d')}) AS d, COALESCE(t, {_mode_sql('t')}) AS t,
       COALESCE(f, {_mode_sql('f')}) AS f, COALESCE(q, {_mode_sql('q')}) AS q
FROM x
""")
def impute_mode(spark, sf):
    return prepare.impute_mode(_with_nulls(Tables(spark, sf).lineitem), ["d", "t", "f", "q"])


@query("binarize", """
SELECT l_orderkey, l_linenumber,
       CASE WHEN l_linenumber IN (2, 3) THEN 1 ELSE 0 END AS severe_train,
       CASE WHEN l_linenumber IN (3, 4) THEN 0 ELSE 1 END AS severe_score
FROM lineitem
""")
def binarize(spark, sf):
    li = Tables(spark, sf).lineitem
    return li.select("l_orderkey", "l_linenumber",
                     prepare.binarize("l_linenumber", [2, 3], "severe_train"),
                     (1 - prepare.binarize("l_linenumber", [3, 4])).alias("severe_score"))


_Z = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("standardize", """
WITH s AS (SELECT avg(l_quantity) mq, stddev_pop(l_quantity) sq, avg(l_extendedprice) mp,
                  stddev_pop(l_extendedprice) sp, avg(l_discount) md, stddev_pop(l_discount) sd,
                  avg(l_tax) mt, stddev_pop(l_tax) st FROM lineitem)
SELECT l_orderkey, l_linenumber,
       ROUND((l_quantity - mq) / CASE WHEN sq = 0 THEN 1 ELSE sq END, 6) AS l_quantity,
       ROUND((l_extendedprice - mp) / CASE WHEN sp = 0 THEN 1 ELSE sp END, 6) AS l_extendedprice,
       ROUND((l_discount - md) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 6) AS l_discount,
       ROUND((l_tax - mt) / CASE WHEN st = 0 THEN 1 ELSE st END, 6) AS l_tax
FROM lineitem, s
""")
def standardize(spark, sf):
    li = Tables(spark, sf).lineitem.select("l_orderkey", "l_linenumber", *_Z)
    return prepare.standardize(li, _Z, digits=6)


@query("one_hot", """
SELECT p_partkey, p_size,
       CAST(p_type = 'LARGE' AS INTEGER) AS p_type_LARGE, CAST(p_type = 'MEDIUM' AS INTEGER) AS p_type_MEDIUM,
       CAST(p_type = 'PROMO' AS INTEGER) AS p_type_PROMO, CAST(p_type = 'SMALL' AS INTEGER) AS p_type_SMALL,
       CAST(p_type = 'STANDARD' AS INTEGER) AS p_type_STANDARD
FROM part
""")
def one_hot(spark, sf):
    part = Tables(spark, sf).part.select("p_partkey", "p_size", "p_type")
    return prepare.one_hot(part, "p_type")


def scored_lineitem(spark, sf):
    """Truth: the line was returned; prediction: a fixed rule on quantity and discount."""
    li = Tables(spark, sf).lineitem
    return li.select((F.col("l_returnflag") == "R").cast("int").alias("y"),
                     ((F.col("l_quantity") > 25) & (F.col("l_discount") < 0.05)).cast("int").alias("yhat"))


_SCORED_SQL = """SELECT CAST(l_returnflag = 'R' AS INTEGER) AS y,
       CAST(l_quantity > 25 AND l_discount < 0.05 AS INTEGER) AS yhat FROM lineitem"""


@query("confusion", f"""
WITH s AS ({_SCORED_SQL}), acc AS (SELECT avg(CAST(y = yhat AS DOUBLE)) AS accuracy FROM s)
SELECT y AS actual, COUNT(*) FILTER (WHERE yhat = 0) AS pred_0, COUNT(*) FILTER (WHERE yhat = 1) AS pred_1,
       ROUND(any_value(accuracy), 6) AS accuracy
FROM s, acc GROUP BY y
""")
def confusion(spark, sf):
    s = scored_lineitem(spark, sf)
    return evaluate.with_accuracy(evaluate.confusion(s, "y", "yhat"))


def _report_sql():
    parts = []
    for c in (0, 1):
        parts.append(f"""SELECT '{c}' AS label, p AS precision, r AS recall,
          CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END AS f1_score, sup AS support FROM (
          SELECT CASE WHEN pred{c} = 0 THEN 0.0 ELSE tp{c} / pred{c} END AS p,
                 CASE WHEN sup{c} = 0 THEN 0.0 ELSE tp{c} / sup{c} END AS r, CAST(sup{c} AS DOUBLE) AS sup FROM c)""")
    return "\nUNION ALL\n".join(parts)


_REPORT_SQL = f"""
WITH s AS ({_SCORED_SQL}),
c AS (SELECT COUNT(*) AS total,
        CAST(COUNT(*) FILTER (WHERE y = 0 AND yhat = 0) AS DOUBLE) AS tp0, COUNT(*) FILTER (WHERE yhat = 0) AS pred0,
        COUNT(*) FILTER (WHERE y = 0) AS sup0,
        CAST(COUNT(*) FILTER (WHERE y = 1 AND yhat = 1) AS DOUBLE) AS tp1, COUNT(*) FILTER (WHERE yhat = 1) AS pred1,
        COUNT(*) FILTER (WHERE y = 1) AS sup1 FROM s),
per AS ({_report_sql()}),
rep AS (
  SELECT * FROM per
  UNION ALL SELECT 'accuracy', (tp0 + tp1) / total, (tp0 + tp1) / total, (tp0 + tp1) / total, CAST(total AS DOUBLE) FROM c
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1_score), sum(support) FROM per
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                   sum(f1_score * support) / sum(support), sum(support) FROM per)
"""


@query("classification_report", _REPORT_SQL + """
SELECT label, ROUND(precision, 6) AS precision, ROUND(recall, 6) AS recall, ROUND(f1_score, 6) AS f1_score,
       ROUND(support, 6) AS support FROM rep
""")
def classification_report(spark, sf):
    return evaluate.classification_report(scored_lineitem(spark, sf), "y", "yhat")


def _wide_sql():
    cols = []
    for lv, name in (("0", "0"), ("1", "1"), ("macro avg", "macro_avg"), ("weighted avg", "weighted_avg")):
        for m in ("precision", "recall", "f1_score", "support"):
            cols.append(f"max(CASE WHEN label = '{lv}' THEN ROUND({m}, 6) END) AS \"{name}_{m}\"")
    cols.append("max(CASE WHEN label = 'accuracy' THEN ROUND(precision, 6) END) AS accuracy")
    return ",\n  ".join(cols)


@query("metrics_wide", _REPORT_SQL + f"""
SELECT {_wide_sql()} FROM rep
""")
def metrics_wide(spark, sf):
    return evaluate.metrics_wide(evaluate.classification_report(scored_lineitem(spark, sf), "y", "yhat"))


@query("per_class_prf", f"""
WITH s AS ({_SCORED_SQL}),
m AS (SELECT COUNT(*) FILTER (WHERE y = 0 AND yhat = 0) AS tn, COUNT(*) FILTER (WHERE y = 0 AND yhat = 1) AS fp,
             COUNT(*) FILTER (WHERE y = 1 AND yhat = 0) AS fn, COUNT(*) FILTER (WHERE y = 1 AND yhat = 1) AS tp FROM s),
k AS (SELECT 0 AS class, tn AS a, fn AS b, fp AS c FROM m UNION ALL SELECT 1, tp, fp, fn FROM m),
pr AS (SELECT class, CASE WHEN a + b = 0 THEN 0.0 ELSE a / (a + b) END AS p,
              CASE WHEN a + c = 0 THEN 0.0 ELSE a / (a + c) END AS r FROM k)
SELECT class, ROUND(p * 100, 1) AS precision_pct, ROUND(r * 100, 1) AS recall_pct,
       ROUND(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END * 100, 1) AS f1_pct FROM pr
""")
def per_class_prf(spark, sf):
    m = evaluate.confusion(scored_lineitem(spark, sf), "y", "yhat")
    return evaluate.per_class_prf(m)


@query("pct_normalize", """
SELECT l_orderkey, l_linenumber,
       CASE WHEN l_discount BETWEEN 0 AND 1 THEN ROUND(l_discount * 100, 1) ELSE ROUND(l_discount, 1) END AS discount_pct,
       CASE WHEN l_quantity / 10 BETWEEN 0 AND 1 THEN ROUND(l_quantity / 10 * 100, 1)
            ELSE ROUND(l_quantity / 10, 1) END AS qty_pct
FROM lineitem
""")
def pct_normalize(spark, sf):
    li = Tables(spark, sf).lineitem
    return li.select("l_orderkey", "l_linenumber",
                     labels.pct_normalize("l_discount").alias("discount_pct"),
                     labels.pct_normalize(F.col("l_quantity") / 10).alias("qty_pct"))
