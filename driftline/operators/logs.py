"""Log operators: flatten nested responses, infer levels, filter, problems, retention.

All per-row work is built-in expressions (``from_json``, ``explode``,
``rlike``, ``get_json_object``); the only shuffle is the ``groupBy`` of
:func:`recent_problems`, which aggregates map-side first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions.labels import log_level
from driftline.session import cut_lineage

# The ingest filter, the message cap and the problem-report settings.
PROBLEM_PATTERN = "(?i)(error|warning)"
MESSAGE_CAP = 1000
SUMMARY_CAP = 120
TOP_PROBLEMS = 20
URGENT_COUNT = 3

# Nested query_range response: data.result[] = {stream: labels, values: [[ts_ns, line]]}
RESPONSE_SCHEMA = T.StructType([
    T.StructField("data", T.StructType([
        T.StructField("result", T.ArrayType(T.StructType([
            T.StructField("stream", T.MapType(T.StringType(), T.StringType())),
            T.StructField("values", T.ArrayType(T.ArrayType(T.StringType()))),
        ]))),
    ])),
])

DOCKER_LINE_SCHEMA = "log STRING, stream STRING, time STRING"


infer_level = log_level  # F12


def ns_to_timestamp(ns_text: Column) -> Column:
    """epoch nanoseconds (text or number) -> TIMESTAMP (microsecond precision)."""
    return F.timestamp_micros(F.floor(ns_text.cast("decimal(24,0)") / 1000).cast("bigint"))


def problem_filter(message: Column, pattern: str = PROBLEM_PATTERN) -> Column:
    """P10: case-insensitive regex match of the log line."""
    return message.rlike(pattern)


def flatten_response(df: DataFrame, text_col: str, keep: list[str] | None = None) -> DataFrame:
    """S7 + P12 + F12-F15: one row per log line of a nested JSON response.

    Output: ``ts, level, container_name, service_name, message`` (+ ``keep``);
    lines whose stream has no service label are dropped (relabel/keep).
    """
    keep = keep or []
    parsed = df.select(*keep, F.from_json(F.col(text_col), RESPONSE_SCHEMA).alias("_r"))
    streams = parsed.select(*keep, F.explode(F.col("_r.data.result")).alias("_s"))
    lines = streams.select(*keep, F.col("_s.stream").alias("_labels"),
                           F.explode(F.col("_s.values")).alias("_v"))
    labels = F.col("_labels")
    msg = F.col("_v")[1]
    out = lines.select(
        *keep,
        ns_to_timestamp(F.col("_v")[0]).alias("ts"),
        infer_level(labels["level"], msg).alias("level"),
        F.coalesce(labels["container"], labels["container_name"]).alias("container_name"),
        labels["service"].alias("service_name"),
        F.left(msg, F.lit(MESSAGE_CAP)).alias("message"),
    )
    return out.filter(F.col("service_name").rlike(".+"))


def parse_docker_line(df: DataFrame, line_col: str) -> DataFrame:
    """Docker json-file line -> (log, stream, time) + level/msg of the inner JSON log."""
    p = F.from_json(F.col(line_col), DOCKER_LINE_SCHEMA)
    x = df.withColumn("_d", p)
    return x.select(
        "*",
        F.col("_d.stream").alias("stream"),
        F.to_timestamp(F.col("_d.time"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("time"),
        F.get_json_object(F.col("_d.log"), "$.level").alias("level"),
        F.get_json_object(F.col("_d.log"), "$.msg").alias("msg"),
    ).drop("_d")


def recent_problems(logs: DataFrame, as_of: Column, hours: int = 24,
                    message: str = "message", ts: str = "ts") -> DataFrame:
    """Top messages of the trailing ``hours`` before ``as_of``.

    ``total_top`` sums only the returned groups (as the original report
    does); ``total_all`` counts every matching line.  Ties on the count
    are broken by the message so the top list is deterministic.
    """
    recent = logs.filter(F.col(ts) >= as_of - F.make_dt_interval(hours=F.lit(hours)))
    # one row per message, written once: the top list and the total both read it
    groups = cut_lineage(recent.groupBy(message).agg(F.count(F.lit(1)).alias("cnt")))
    top = groups.orderBy(F.col("cnt").desc(), F.col(message)).limit(TOP_PROBLEMS)
    # one-row scalar subquery, evaluated once and shipped as a value
    total_all = groups.agg(F.sum("cnt")).scalar()
    return top.select(
        F.left(F.col(message), F.lit(SUMMARY_CAP)).alias("message"),
        F.col("cnt").cast("bigint").alias("cnt"),
        (F.col("cnt") >= URGENT_COUNT).alias("is_urgent"),
        F.sum("cnt").over(Window.partitionBy()).cast("bigint").alias("total_top"),
        total_all.cast("bigint").alias("total_all"),
    )


def top_of_window(counts: DataFrame, window: str = "window_start", message: str = "message", cnt: str = "cnt") -> DataFrame:
    """A7 per window: the ``TOP_PROBLEMS`` most frequent messages of each, with the total of those.

    The rank filter keeps at most that many rows of a window in each partition before they are shuffled.
    """
    by = Window.partitionBy(window)
    top = (counts.withColumn("_place", F.row_number().over(by.orderBy(F.col(cnt).desc(), F.col(message)))).filter(F.col("_place") <= TOP_PROBLEMS))
    return top.select(window, F.left(F.col(message), F.lit(SUMMARY_CAP)).alias(message), F.col(cnt).cast("bigint").alias(cnt),
                      (F.col(cnt) >= URGENT_COUNT).alias("is_urgent"), F.sum(cnt).over(by).cast("bigint").alias("total_top"))


def retain(logs: DataFrame, as_of: Column, days: int, ts: str = "ts") -> DataFrame:
    """K8: keep the lines not older than ``days`` before ``as_of``.

    On a table partitioned by date this predicate prunes whole partitions;
    the purge itself is an overwrite of the kept rows to a new location.
    """
    return logs.filter(F.col(ts) >= as_of - F.make_dt_interval(days=F.lit(days)))
