"""Structured Streaming queries, each checked against its batch twin in SQL.

Sources are file streams over the driver tables (or over incidents that a
batch job derived from them); runs use ``availableNow`` and write to fresh
sink folders below the checkpoint folder.  Append-mode window aggregates
emit a window once the watermark (max event time minus the delay) has
passed its end, so the twins keep exactly the windows with
``end <= max(ts) - delay``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.hashing import draw_fast
from driftline.functions.labels import iso_utc
from driftline.operators import incidents as inc
from driftline.operators import logs, metrics
from driftline.plans.incidents import LIMITER_CTE, SAMPLES_SQL, SUSTAINED_SECONDS, classified, samples
from driftline.plans.logs import LEVEL_SQL, LINES_SQL, log_lines
from driftline.plans.metrics import LATENCY_BOUNDS, QUANTILE, quantile_sql
from driftline.plans.registry import query
from driftline.schemas import TABLES
from driftline.session import scratch_path
from driftline.sources.tables import Tables
from driftline.streaming import processors, sinks
from driftline.streaming.runner import arrivals, file_stream, landed, run_available_now, use_rocksdb_state

LOG_DELAY = "10 minutes"
MONITOR_DELAY_MINUTES = 10
WINDOW_DELAY_HOURS = 1
TRIGGER_SCORE_SCALE = 500.0


def _events_stream(spark, sf) -> DataFrame:
    return file_stream(spark, sf, TABLES["events"], glob="events.parquet")


def _hourly_problems(spark, sf, *keys: str) -> DataFrame:
    """Problem lines per hour and ``keys``, emitted when the hour closes."""
    p = log_lines(_events_stream(spark, sf)).filter(logs.problem_filter(F.col("message")))
    return (p.withWatermark("ts", f"{WINDOW_DELAY_HOURS} hour")
             .groupBy(F.window("ts", "1 hour").alias("hour"), *keys).agg(F.count(F.lit(1)).alias("n")))


@query("log_stream", f"""
WITH {LINES_SQL}
SELECT event_id, ts, {LEVEL_SQL.format(m='message')} AS level, container_name, service_name, message
FROM lines WHERE regexp_matches(message, '(?i)(error|warning)')
""")
def log_stream(spark, sf):
    """T1 + K4: incremental ingest of problem lines; a re-delivered range
    (the second reader of the same files) is removed by the watermark dedup."""
    lines = log_lines(_events_stream(spark, sf)).unionByName(log_lines(_events_stream(spark, sf)))
    problems = lines.filter(logs.problem_filter(F.col("message")))
    dedup = (problems.withWatermark("ts", LOG_DELAY)
                     .dropDuplicatesWithinWatermark(["ts", "container_name", "message"]))
    out = dedup.select("event_id", "ts", logs.infer_level(F.col("label"), F.col("message")).alias("level"),
                       "container_name", "service_name", "message")
    return run_available_now(out, "log_stream")


@query("problem_windows", f"""
WITH {LINES_SQL},
p AS (SELECT ts FROM lines WHERE regexp_matches(message, '(?i)(error|warning)')),
w AS (SELECT date_trunc('hour', ts) - to_hours(i) AS window_start FROM p, range(0, 24) t(i))
SELECT window_start, window_start + INTERVAL 24 HOUR AS window_end, COUNT(*) AS n FROM w
GROUP BY window_start
HAVING window_start + INTERVAL 24 HOUR <= (SELECT max(ts) FROM p) - INTERVAL {WINDOW_DELAY_HOURS} HOUR
""")
def problem_windows(spark, sf):
    """Problem lines per sliding 24-hour window, one-hour slide."""
    # counted per hour first: only hour rows are spread over the 24 windows they lie in
    agg = _hourly_problems(spark, sf).groupBy(F.window("hour", "24 hours", "1 hour")).agg(F.sum("n").alias("n"))
    out = agg.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "n")
    return run_available_now(out, "problem_windows")


@query("problem_report_stream", f"""
WITH {LINES_SQL},
p AS (SELECT ts, message FROM lines WHERE regexp_matches(message, '(?i)(error|warning)')),
w AS (SELECT message, date_trunc('hour', ts) - to_hours(CAST(i AS INTEGER)) AS window_start FROM p, range(0, 24) t(i))
SELECT window_start, message, COUNT(*) AS n FROM w
GROUP BY window_start, message
HAVING window_start + INTERVAL 24 HOUR <= (SELECT max(ts) FROM p) - INTERVAL {WINDOW_DELAY_HOURS} HOUR
""")
def problem_report_stream(spark, sf):
    """T2 per message: lines are counted per hour first, so only hour rows are spread over the 24-hour windows."""
    agg = _hourly_problems(spark, sf, "message").groupBy(F.window("hour", "24 hours", "1 hour"), "message").agg(F.sum("n").alias("n"))
    out = agg.select(F.col("window.start").alias("window_start"), "message", "n")
    return run_available_now(out, "problem_report")


@query("problem_top_stream", f"""
WITH {LINES_SQL},
p AS (SELECT ts, message FROM lines WHERE regexp_matches(message, '(?i)(error|warning)')),
w AS (SELECT message, date_trunc('hour', ts) - to_hours(CAST(i AS INTEGER)) AS window_start FROM p, range(0, 24) t(i)),
g AS (SELECT window_start, message, COUNT(*) AS cnt FROM w GROUP BY window_start, message
      HAVING window_start + INTERVAL 24 HOUR <= (SELECT max(ts) FROM p) - INTERVAL {WINDOW_DELAY_HOURS} HOUR),
k AS (SELECT *, row_number() OVER (PARTITION BY window_start ORDER BY cnt DESC, message) AS place FROM g)
SELECT window_start, left(message, {logs.SUMMARY_CAP}) AS message, cnt, cnt >= {logs.URGENT_COUNT} AS is_urgent,
       CAST(sum(cnt) OVER (PARTITION BY window_start) AS BIGINT) AS total_top
FROM k WHERE place <= {logs.TOP_PROBLEMS}
""")
def problem_top_stream(spark, sf):
    """T2 + A7: the top 20 problems of every closed 24-hour window, with the total of the 20."""
    agg = _hourly_problems(spark, sf, "message").groupBy(F.window("hour", "24 hours", "1 hour"), "message").agg(F.sum("n").alias("cnt"))
    out = agg.select(F.col("window.start").alias("window_start"), "message", "cnt")
    return sinks.run_ranked(out, "problem_top", logs.top_of_window)


@query("metric_stream", f"""
WITH r AS (SELECT ts, value, CASE WHEN event_type IN ('click', 'view') THEN 'api' ELSE 'predict_api_service' END AS job
           FROM events)
SELECT date_trunc('hour', ts) AS window_start, job, COUNT(*) AS n, round(avg(value), 6) AS avg_latency_ms
FROM r GROUP BY 1, 2
HAVING window_start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL {WINDOW_DELAY_HOURS} HOUR
""")
def metric_stream(spark, sf):
    """T5: requests and mean latency per job and hour, emitted when the hour closes."""
    ev = _events_stream(spark, sf)
    job = F.when(F.col("event_type").isin("click", "view"), "api").otherwise("predict_api_service")
    agg = (ev.withColumn("job", job).withWatermark("ts", f"{WINDOW_DELAY_HOURS} hour")
             .groupBy(F.window("ts", "1 hour"), "job")
             .agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("avg_latency_ms")))
    out = agg.select(F.col("window.start").alias("window_start"), "job", "n", "avg_latency_ms")
    return run_available_now(out, "metric_stream")


@query("incident_stream", f"""
WITH RECURSIVE {SAMPLES_SQL}, {LIMITER_CTE}
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS timestamp, container, action, status, message
FROM acted
""")
def incident_stream(spark, sf):
    """T3 + K5: incidents -> restart limiter in event time -> JSON-lines events."""
    found = (classified(spark, sf).filter(F.col("incident").isNotNull())
             .select("ts", "container", "event_id", F.col("incident").alias("text"), "status"))
    landing = landed(found, "incidents")
    use_rocksdb_state(spark)
    stream = (file_stream(spark, landing, found.schema).withWatermark("ts", f"{MONITOR_DELAY_MINUTES} minutes")
              .filter(F.when(F.col("ts").isNotNull(), F.col("text")).isNotNull()))  # names the time, so the last row reaches the watermark
    acted = limited(stream)
    records = acted.select("event_id", iso_utc(F.timestamp_micros("us")).alias("timestamp"), "container", "action", "status", "message")
    return run_available_now(records, "incident_stream", fmt="json")


@query("drift_trigger", f"""
WITH s AS (SELECT user_id, event_id, ts, event_type = 'signup' AS finished, value / {TRIGGER_SCORE_SCALE} AS score,
                  sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END)
                    OVER (PARTITION BY user_id ORDER BY ts, event_id) AS segment
           FROM events)
SELECT user_id, arg_min(event_id, ts) AS event_id, min(ts) AS ts FROM s
WHERE NOT finished AND score > 0.5 GROUP BY user_id, segment
""")
def drift_trigger(spark, sf):
    """T4: per model, a retrain trigger on the first score above 0.5 after each finished run."""
    ev = Tables(spark, sf).events.select("ts", "user_id", "event_id", "event_type", "value")
    use_rocksdb_state(spark)
    stream = file_stream(spark, landed(ev, "scores"), ev.schema)
    return run_available_now(triggered(stream), "drift_trigger").select("user_id", "event_id", F.timestamp_micros("us").alias("ts"))


def monitored(stream: DataFrame) -> DataFrame:
    """T3 as one stream: raw container samples -> percentages -> incidents -> restart limiter in event time.

    A sample carries the previous reading of its counters beside the present one, so detection needs no
    state; only incidents reach the limiter.  Samples without a time are no incidents; as that test names the
    time, the filter stays above the watermark, which every sample moves on.
    """
    cpu = inc.cpu_pct(F.col("cpu_total"), F.col("precpu_total"), F.col("system_total"), F.col("presystem_total"), F.col("online_cpus"))
    mem = inc.mem_pct(F.col("mem_usage"), F.col("mem_limit"))
    incident = inc.classify(F.col("always_on"), F.col("status"), F.col("exit_code"), F.col("health"), cpu, mem)
    found = (stream.withWatermark("ts", f"{MONITOR_DELAY_MINUTES} minutes")
             .withColumn("text", F.when(F.col("ts").isNotNull(), incident)).filter(F.col("text").isNotNull()))
    return limited(found)


def limited(found: DataFrame) -> DataFrame:
    """W9 + F17: the restart limiter over a watermarked stream of incidents (``text``)."""
    return processors.grouped(found, "ts", F.col("container"), processors.RestartLimiter(), processors.LIMITER_OUT)


def triggered(events: DataFrame) -> DataFrame:
    """T4: triggers of a stream of scores and finished runs, in event time."""
    ev = events.withWatermark("ts", f"{MONITOR_DELAY_MINUTES} minutes").filter(F.when(F.col("ts").isNotNull(), F.col("event_id")).isNotNull()).select(
        "ts", "user_id", "event_id", F.when(F.col("event_type") != "signup", F.col("value") / TRIGGER_SCORE_SCALE).alias("number"))
    return processors.grouped(ev, "ts", F.col("user_id"), processors.DriftTrigger(), processors.TRIGGER_OUT)


@query("monitor_stream", f"""
WITH RECURSIVE {SAMPLES_SQL}, {LIMITER_CTE}
SELECT event_id, ts, container, status, action, message FROM acted
WHERE epoch_us(ts) <= (SELECT epoch_ms(max(ts)) FROM events) * 1000 - {MONITOR_DELAY_MINUTES} * 60000000
""")
def monitor_stream(spark, sf):
    """T3 + W6 + W7 + F16 + W9: incidents up to the watermark, detected and limited in the stream."""
    landing = scratch_path(spark, "samples")
    raw = samples(spark, sf).select("event_id", "ts", "container", "always_on", "status", "exit_code", "health", "cpu_total", "precpu_total",
                                    "system_total", "presystem_total", "online_cpus", "mem_usage", "mem_limit")
    raw.write.parquet(landing)
    use_rocksdb_state(spark)
    out = monitored(file_stream(spark, landing, raw.schema))
    return run_available_now(out, "monitor_stream").select("event_id", F.timestamp_micros("us").alias("ts"), "container", "status", "action", "message")


@query("drift_trigger_ordered", f"""
WITH s AS (SELECT user_id, event_id, ts, event_type = 'signup' AS finished, value / {TRIGGER_SCORE_SCALE} AS score,
                  sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END)
                    OVER (PARTITION BY user_id ORDER BY ts, event_id) AS segment
           FROM events)
SELECT user_id, arg_min(event_id, ts) AS event_id, min(ts) AS ts FROM s
WHERE NOT finished AND score > 0.5 GROUP BY user_id, segment
HAVING epoch_us(min(ts)) <= (SELECT epoch_ms(max(ts)) FROM events) * 1000 - {MONITOR_DELAY_MINUTES} * 60000000
""")
def drift_trigger_ordered(spark, sf):
    """T4 in event time: triggers up to the watermark, whatever order the files come in within the delay."""
    use_rocksdb_state(spark)
    return run_available_now(triggered(_events_stream(spark, sf)), "drift_trigger_ordered").select(
        "user_id", "event_id", F.timestamp_micros("us").alias("ts"))


ARRIVAL_PARTS = 3
ALERT_SALT = "alert-arrival"


def alerts(stream: DataFrame, threshold: float, for_seconds: float) -> DataFrame:
    """W8 as a stream: the transitions of every series (series, ts, event_id, value) in event time, up to the watermark."""
    rows = (stream.withWatermark("ts", f"{MONITOR_DELAY_MINUTES} minutes").filter(F.when(F.col("ts").isNotNull(), F.col("series")).isNotNull())
            .select("ts", "series", "event_id", F.col("value").alias("number")))
    return processors.grouped(rows, "ts", F.col("series"), processors.SustainedAlert(threshold, for_seconds), processors.ALERT_OUT)


@query("alert_stream", f"""
WITH {SAMPLES_SQL},
a AS (SELECT container, ts, event_id, CASE WHEN cpu_pct > 90.0 THEN 1 ELSE 0 END AS above FROM samples),
b AS (SELECT *, CASE WHEN lag(above) OVER w IS NULL OR lag(above) OVER w <> above THEN 1 ELSE 0 END AS chg
      FROM a WINDOW w AS (PARTITION BY container ORDER BY ts, event_id)),
c AS (SELECT *, sum(chg) OVER (PARTITION BY container ORDER BY ts, event_id) AS island FROM b),
d AS (SELECT *, row_number() OVER (PARTITION BY container, island ORDER BY ts, event_id) AS k, min(ts) OVER (PARTITION BY container, island) AS start FROM c),
i AS (SELECT container, island, min(ts) AS start, COUNT(*) AS n FROM d WHERE above = 1 GROUP BY container, island),
t AS (SELECT container AS series, 'pending' AS state, ts AS event_time, start, 1 AS n_samples FROM d WHERE above = 1 AND k = 1
      UNION ALL
      SELECT container, 'firing', min(ts), start, min(k) FROM d
      WHERE above = 1 AND (epoch_us(ts) - epoch_us(start)) / 1e6 >= {SUSTAINED_SECONDS} GROUP BY container, island, start
      UNION ALL
      SELECT d.container, 'resolved', d.ts, i.start, i.n FROM d JOIN i ON d.container = i.container AND d.island = i.island + 1 WHERE d.k = 1)
SELECT * FROM t WHERE epoch_us(event_time) <= (SELECT epoch_ms(max(ts)) FROM events) * 1000 - {MONITOR_DELAY_MINUTES} * 60000000
""")
def alert_stream(spark, sf):
    """W8 as a stream: pending, firing and resolved per container; samples arrive in parts, up to eight minutes out of order."""
    rows = samples(spark, sf).select("ts", F.col("container").alias("series"), "event_id", F.col("cpu_pct").alias("value"))
    late = F.pmod(draw_fast("event_id", F.lit(ALERT_SALT)), F.lit(480))
    held, landing, sink, checkpoint = (scratch_path(spark, f"alert-{d}") for d in ("held", "samples", "sink", "ckpt"))
    rows.write.parquet(held)  # the parts and their cuts read them again
    rows = spark.read.schema(rows.schema).parquet(held)
    use_rocksdb_state(spark)
    for _ in arrivals(rows, landing, ARRIVAL_PARTS, F.unix_seconds("ts") + late):  # the stream stops and goes on after each part
        stream = alerts(file_stream(spark, landing, rows.schema), inc.CPU_THRESHOLD, SUSTAINED_SECONDS)
        out = run_available_now(stream, "alert_stream", sink=sink, checkpoint=checkpoint)
    return out.select(
        "series", "state", F.timestamp_micros("us").alias("event_time"), F.timestamp_micros("start_us").alias("start"), "n_samples")


@query("quantile_stream", f"""
WITH {quantile_sql()}
SELECT job, step AS window_start, p95_ms, total AS n, round(total / 3600.0, 9) AS rate FROM quantiles
WHERE step + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL {WINDOW_DELAY_HOURS} HOUR
""")
def quantile_stream(spark, sf):
    """T5 + W2: requests a second and the 95th percentile of latency from histogram buckets, per job and closed hour."""
    ev = _events_stream(spark, sf)
    job = F.when(F.col("event_type").isin("click", "view"), "api").otherwise("predict_api_service")
    agg = (ev.withColumn("job", job).withWatermark("ts", f"{WINDOW_DELAY_HOURS} hour").groupBy(F.window("ts", "1 hour"), "job")
             .agg(metrics.cumulative_buckets("value", LATENCY_BOUNDS).alias("cum"), F.count(F.lit(1)).alias("n")))
    out = agg.select("job", F.col("window.start").alias("window_start"), "n", metrics.per_second("n", 3600).alias("rate"),
                     F.round(metrics.histogram_quantile(QUANTILE, LATENCY_BOUNDS, "cum"), 6).alias("p95_ms"))
    return run_available_now(out, "quantile_stream")


_REQUESTS_SQL = """
WITH r AS (SELECT ts, value, CASE WHEN event_type IN ('click', 'view') THEN 'api' ELSE 'predict_api_service' END AS job
           FROM events)"""


def open_windows(stream: DataFrame) -> DataFrame:
    """T5: requests and mean latency per job and hour, open hours included."""
    job = F.when(F.col("event_type").isin("click", "view"), "api").otherwise("predict_api_service")
    agg = (stream.withColumn("job", job).withWatermark("ts", f"{WINDOW_DELAY_HOURS} hour").groupBy(F.window("ts", "1 hour"), "job")
           .agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("avg_latency_ms")))
    return agg.select(F.col("window.start").alias("window_start"), "job", "n", "avg_latency_ms")


@query("metric_refresh_stream", f"""
{_REQUESTS_SQL}
SELECT date_trunc('hour', ts) AS window_start, job, COUNT(*) AS n, round(avg(value), 6) AS avg_latency_ms FROM r GROUP BY 1, 2
""")
def metric_refresh_stream(spark, sf):
    """T5 in update mode: every micro-batch refreshes the hours it touched, and the table always shows the newest state of each."""
    ev = Tables(spark, sf).events.select("ts", "event_type", "value", "event_id")
    landing, table, checkpoint = (scratch_path(spark, f"metric-refresh-{d}") for d in ("landing", "table", "ckpt"))
    for _ in arrivals(ev, landing, ARRIVAL_PARTS, F.unix_seconds("ts")):
        sinks.run_updates(open_windows(file_stream(spark, landing, ev.schema)), table, ["window_start", "job"], checkpoint, compact_after=1)
    return sinks.current(spark, table, ["window_start", "job"])


POLL_FILES = 6
POLLS_BEFORE_RESTART = 2


@query("log_poll_stream", f"""
WITH {LINES_SQL}
SELECT event_id, ts, {LEVEL_SQL.format(m='message')} AS level, container_name, message, max(ts) OVER () AS high_watermark
FROM lines WHERE regexp_matches(message, '(?i)(error|warning)')
""")
def log_poll_stream(spark, sf):
    """S11 + T1 + A20: polls of one file each, lost after two and resumed; rows, batch number and the newest time change in one step."""
    lines = log_lines(Tables(spark, sf).events)
    lines = lines.filter(logs.problem_filter(F.col("message"))).select(
        "event_id", "ts", logs.infer_level(F.col("label"), F.col("message")).alias("level"), "container_name", "message")
    landing, table, checkpoint = (scratch_path(spark, f"log-poll-{d}") for d in ("landing", "table", "ckpt"))
    lines.repartition(POLL_FILES).write.parquet(landing)
    for polls in (POLLS_BEFORE_RESTART, None):
        sinks.run_polls(file_stream(spark, landing, lines.schema, max_files=1), table, checkpoint, "ts", stop_after=polls)
    rows, newest = sinks.polled(spark, table)
    return rows.withColumn("high_watermark", F.timestamp_micros(F.lit(newest).cast("long")))
