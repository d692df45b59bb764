"""Classifier evaluation: confusion matrix, report, per-class P/R/F1, accuracy.

All metrics come from one aggregate of conditional sums over
(truth, prediction); the arithmetic then runs on that single row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

REPORT_METRICS = ("precision", "recall", "f1_score", "support")


def confusion(df: DataFrame, y: str, yhat: str, labels: Sequence[int] = (0, 1)) -> DataFrame:
    """A10: rows = truth, columns ``pred_<label>`` = predicted counts (0 when absent)."""
    m = df.groupBy(F.col(y).alias("actual")).pivot(yhat, list(labels)).count()
    m = m.select("actual", *[F.coalesce(F.col(str(lv)), F.lit(0)).cast("bigint").alias(f"pred_{lv}")
                             for lv in labels])
    return m


def accuracy(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """Share of rows with truth == prediction."""
    return df.agg(F.avg((F.col(y) == F.col(yhat)).cast("double")).alias("accuracy"))


def with_accuracy(matrix: DataFrame, digits: int = 6) -> DataFrame:
    """A21 on a 2x2 matrix: diagonal / total, attached to each of its (two) rows."""
    w = Window.partitionBy()
    diag = F.when(F.col("actual") == 0, F.col("pred_0")).otherwise(F.col("pred_1"))
    acc = F.sum(diag).over(w) / F.sum(F.col("pred_0") + F.col("pred_1")).over(w)
    return matrix.withColumn("accuracy", F.round(acc, digits))


def _counts(df: DataFrame, y: str, yhat: str, labels: Sequence[int]) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("total")]
    for lv in labels:
        aggs += [
            F.count_if((F.col(y) == lv) & (F.col(yhat) == lv)).alias(f"tp{lv}"),
            F.count_if(F.col(yhat) == lv).alias(f"pred{lv}"),
            F.count_if(F.col(y) == lv).alias(f"sup{lv}"),
        ]
    return df.agg(*aggs)


def _safe_div(a, b):
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def classification_report(df: DataFrame, y: str, yhat: str, labels: Sequence[int] = (0, 1),
                          digits: int = 6) -> DataFrame:
    """Per class, macro and weighted precision / recall / f1 / support, plus accuracy.

    ``zero_division = 0``.  One row per label (``0``, ``1``, ``accuracy``,
    ``macro avg``, ``weighted avg``), like the transposed report file.
    """
    c = _counts(df, y, yhat, labels)
    per = {}
    for lv in labels:
        p = _safe_div(F.col(f"tp{lv}"), F.col(f"pred{lv}"))
        r = _safe_div(F.col(f"tp{lv}"), F.col(f"sup{lv}"))
        f1 = F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))
        per[lv] = (p, r, f1, F.col(f"sup{lv}").cast("double"))
    k = float(len(labels))
    total = F.col("total").cast("double")
    acc = _safe_div(sum((F.col(f"tp{lv}") for lv in labels), F.lit(0)), F.col("total"))
    macro = tuple(sum((per[lv][i] for lv in labels), F.lit(0.0)) / F.lit(k) for i in range(3)) + (total,)
    weighted = tuple(_safe_div(sum((per[lv][i] * per[lv][3] for lv in labels), F.lit(0.0)), total)
                     for i in range(3)) + (total,)
    rows = [(str(lv), *per[lv]) for lv in labels]
    rows += [("accuracy", acc, acc, acc, total), ("macro avg", *macro), ("weighted avg", *weighted)]
    structs = [F.struct(F.lit(name).alias("label"),
                        *[F.round(v, digits).alias(m) for v, m in zip(vals, REPORT_METRICS)])
               for name, *vals in rows]
    return c.select(F.inline(F.array(*structs)))


def metrics_wide(report: DataFrame) -> DataFrame:
    """M6: one row, one column per ``<label>_<metric>`` (snake case)."""
    long = report.select(
        F.regexp_replace("label", " ", "_").alias("label"),
        F.expr("stack(4, 'precision', precision, 'recall', recall, 'f1_score', f1_score, "
               "'support', support) AS (metric, value)"))
    keyed = long.select(F.concat_ws("_", "label", "metric").alias("key"), "value")
    labels = ["0", "1", "macro_avg", "weighted_avg"]
    keys = [f"{lv}_{m}" for lv in labels for m in REPORT_METRICS] + ["accuracy_precision"]
    wide = keyed.groupBy().pivot("key", keys).agg(F.first("value"))
    return wide.withColumnRenamed("accuracy_precision", "accuracy")


def per_class_prf(matrix: DataFrame, digits: int = 1) -> DataFrame:
    """Per-class precision / recall / F1 in % from a 2x2 confusion matrix.

    ``matrix`` has rows ``actual`` in {0, 1} and columns ``pred_0``/``pred_1``.
    0 on an empty denominator.
    """
    m = matrix.agg(
        F.sum(F.when(F.col("actual") == 0, F.col("pred_0"))).alias("tn"),
        F.sum(F.when(F.col("actual") == 0, F.col("pred_1"))).alias("fp"),
        F.sum(F.when(F.col("actual") == 1, F.col("pred_0"))).alias("fn"),
        F.sum(F.when(F.col("actual") == 1, F.col("pred_1"))).alias("tp"),
        F.count(F.lit(1)).alias("n_rows"))
    m = m.filter(F.col("n_rows") == 2)  # only a 2x2 matrix has this report

    def prf(tp, fp, fn):
        p = _safe_div(tp, tp + fp)
        r = _safe_div(tp, tp + fn)
        f = F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))
        return [F.round(x * 100, digits) for x in (p, r, f)]

    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    structs = []
    for cls, (a, b, c) in ((0, (tn, fn, fp)), (1, (tp, fp, fn))):
        p, r, f = prf(a, b, c)
        structs.append(F.struct(F.lit(cls).alias("class"), p.alias("precision_pct"),
                                r.alias("recall_pct"), f.alias("f1_pct")))
    return m.select(F.inline(F.array(*structs)))
