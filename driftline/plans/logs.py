"""Log queries on ``events`` rendered as container log lines.

Each event becomes one log line of container ``api-<user_id>`` and service
``<event_type>``; the line text and the optional level label are fixed
functions of the event, so every query reads the whole events table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.labels import iso_utc
from driftline.operators import logs
from driftline.plans.registry import query
from driftline.sources.tables import Tables

PROBLEM_HOURS = 24
RETENTION_DAYS = 7

# DuckDB text of the same rendering (used by every oracle below).
LINES_SQL = """
lines AS (
  SELECT event_id, ts, user_id, event_type, value, props,
         'api-' || CAST(user_id AS VARCHAR) AS container_name,
         event_type AS service_name,
         CASE event_type WHEN 'signup' THEN 'info' WHEN 'view' THEN '' WHEN 'click' THEN 'debug' END AS label,
         CASE event_type
           WHEN 'error' THEN 'ERROR request failed code=' || CAST(k % 7 AS VARCHAR)
           WHEN 'purchase' THEN CASE WHEN value > 200 THEN 'Warning: slow purchase'
                                     ELSE 'purchase ok k=' || CAST(k AS VARCHAR) END
           WHEN 'click' THEN CASE WHEN k > 95 THEN 'click warning: slow handler'
                                  ELSE 'click on item ' || CAST(k AS VARCHAR) END
           WHEN 'signup' THEN CASE WHEN k > 90 THEN 'signup error: duplicate account'
                                   ELSE 'signup from ref ' || CAST(k AS VARCHAR) END
           ELSE 'view page ' || CAST(k AS VARCHAR) END AS message
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""

LEVEL_SQL = ("COALESCE(NULLIF(label, ''), CASE WHEN contains(lower({m}), 'error') THEN 'error' "
             "ELSE 'warning' END)")


def log_lines(events: DataFrame) -> DataFrame:
    """event_id, ts, container_name, service_name, label, message (Spark twin of LINES_SQL)."""
    k = F.get_json_object("props", "$.k").cast("int")
    et = F.col("event_type")
    label = (F.when(et == "signup", "info").when(et == "view", "").when(et == "click", "debug"))
    message = (
        F.when(et == "error", F.concat(F.lit("ERROR request failed code="), (k % 7).cast("string")))
         .when(et == "purchase", F.when(F.col("value") > 200, F.lit("Warning: slow purchase"))
               .otherwise(F.concat(F.lit("purchase ok k="), k.cast("string"))))
         .when(et == "click", F.when(k > 95, F.lit("click warning: slow handler"))
               .otherwise(F.concat(F.lit("click on item "), k.cast("string"))))
         .when(et == "signup", F.when(k > 90, F.lit("signup error: duplicate account"))
               .otherwise(F.concat(F.lit("signup from ref "), k.cast("string"))))
         .otherwise(F.concat(F.lit("view page "), k.cast("string"))))
    return events.select("event_id", "ts", "user_id", "event_type", "value", "props",
                         F.concat(F.lit("api-"), F.col("user_id").cast("string")).alias("container_name"),
                         et.alias("service_name"), label.alias("label"), message.alias("message"))


def as_of(events: DataFrame):
    """Report time = the newest event, as a literal, so that a time range after it reaches the scan."""
    return F.lit(events.agg(F.max("ts").alias("ts")).first()["ts"]).cast("timestamp")


@query("log_filter", f"""
WITH {LINES_SQL}
SELECT event_id, container_name, message FROM lines
WHERE regexp_matches(message, '(?i)(error|warning)')
""")
def log_filter(spark, sf):
    ln = log_lines(Tables(spark, sf).events)
    return ln.filter(logs.problem_filter(F.col("message"))).select("event_id", "container_name", "message")


@query("log_level", f"""
WITH {LINES_SQL}
SELECT event_id, {LEVEL_SQL.format(m='message')} AS level FROM lines
""")
def log_level(spark, sf):
    ln = log_lines(Tables(spark, sf).events)
    return ln.select("event_id", logs.infer_level(F.col("label"), F.col("message")).alias("level"))


def docker_lines(events: DataFrame) -> DataFrame:
    """One docker json-file line per event; the inner log is JSON with level/msg/id."""
    ln = log_lines(events)
    inner = F.to_json(F.struct(F.col("label").alias("level"), F.col("message").alias("msg"),
                               F.col("event_id").alias("id")))
    stream = F.when(F.col("event_type") == "error", "stderr").otherwise("stdout")
    return ln.select(F.to_json(F.struct(inner.alias("log"), stream.alias("stream"),
                                        iso_utc("ts").alias("time"))).alias("line"))


@query("log_level_json", f"""
WITH {LINES_SQL}
SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 'stderr' ELSE 'stdout' END AS stream,
       ts AS time, label AS level, message AS msg
FROM lines
""")
def log_level_json(spark, sf):
    d = logs.parse_docker_line(docker_lines(Tables(spark, sf).events), "line")
    return d.select(F.get_json_object("line", "$.log").alias("_log"), "stream", "time", "level", "msg") \
            .select(F.get_json_object("_log", "$.id").cast("bigint").alias("id"), "stream", "time", "level", "msg")


def responses(events: DataFrame) -> DataFrame:
    """One nested query_range response per event: one stream, two values (line, props)."""
    ln = log_lines(events)
    et = F.col("event_type")
    ckey = F.when(et.isin("click", "view"), F.lit("container")).otherwise(F.lit("container_name"))
    labels = F.create_map(ckey, F.col("container_name"),
                          F.lit("service"), F.when(et != "view", F.col("service_name")),
                          F.lit("level"), F.col("label"))
    ns = F.unix_micros("ts") * 1000
    values = F.array(F.array(ns.cast("string"), F.col("message")),
                     F.array((ns + 1000).cast("string"), F.col("props")))
    resp = F.struct(F.struct(F.array(F.struct(labels.alias("stream"), values.alias("values"))).alias("result"))
                    .alias("data"))
    return ln.select("event_id", F.to_json(resp).alias("body"))


@query("log_flatten", f"""
WITH {LINES_SQL},
v AS (
  SELECT event_id, ts, label, container_name, service_name, message AS line, event_type FROM lines
  UNION ALL
  SELECT event_id, ts + INTERVAL 1 MICROSECOND, label, container_name, service_name, props, event_type FROM lines)
SELECT event_id, ts, {LEVEL_SQL.format(m='line')} AS level, container_name, service_name, left(line, 1000) AS message
FROM v WHERE event_type <> 'view'
""")
def log_flatten(spark, sf):
    return logs.flatten_response(responses(Tables(spark, sf).events), "body", keep=["event_id"])


@query("recent_problems", f"""
WITH {LINES_SQL},
p AS (SELECT * FROM lines WHERE regexp_matches(message, '(?i)(error|warning)')
        AND ts >= (SELECT max(ts) FROM events) - INTERVAL {PROBLEM_HOURS} HOUR),
g AS (SELECT message, COUNT(*) AS cnt FROM p GROUP BY message ORDER BY cnt DESC, message LIMIT 20)
SELECT left(message, 120) AS message, CAST(cnt AS BIGINT) AS cnt, cnt >= 3 AS is_urgent,
       CAST(sum(cnt) OVER () AS BIGINT) AS total_top, (SELECT COUNT(*) FROM p) AS total_all
FROM g
""")
def recent_problems(spark, sf):
    ev = Tables(spark, sf).events
    ln = log_lines(ev).filter(logs.problem_filter(F.col("message")))
    return logs.recent_problems(ln, as_of(ev), PROBLEM_HOURS)


@query("log_retention", f"""
WITH {LINES_SQL}
SELECT event_id, ts, container_name, message FROM lines
WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL {RETENTION_DAYS} DAY
""")
def log_retention(spark, sf):
    ev = Tables(spark, sf).events
    return logs.retain(log_lines(ev), as_of(ev), RETENTION_DAYS).select("event_id", "ts", "container_name", "message")
