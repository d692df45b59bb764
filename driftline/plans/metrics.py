"""Metric-series queries on ``events`` read as an API request log.

Every event is one request: job ``api`` (click/view) or
``predict_api_service`` (others), HTTP status ``500`` (error), ``201``
(signup) or ``200``, latency ``value`` ms.  Counters are running per
(series, day), so every day starts with a counter reset; steps are hours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.labels import band
from driftline.operators import metrics
from driftline.operators.sequence import running_sum, time_chunk
from driftline.plans.registry import query
from driftline.sources.tables import Tables

STEP_SECONDS = 3600
RANGE_STEPS = 4
# Latency histogram bucket bounds (ms), quantile, panel thresholds.
LATENCY_BOUNDS = [5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0]
QUANTILE = 0.95
UPTIME_BANDS = ([300, 3600], ["red", "yellow", "green"])
LATENCY_BANDS = ([25, 50], ["ok", "warn", "critical"])
SCORE_BANDS = ([0.3, 0.7], ["low", "medium", "high"])

REQ_SQL = """
req AS (
  SELECT event_id, ts, user_id, event_type,
         CASE WHEN event_type IN ('click', 'view') THEN 'api' ELSE 'predict_api_service' END AS job,
         CASE event_type WHEN 'error' THEN '500' WHEN 'signup' THEN '201' ELSE '200' END AS status,
         value AS latency_ms, CAST(round(value * 100) AS BIGINT) AS latency_cents,
         date_trunc('hour', ts) AS step, date_trunc('day', ts) AS day
  FROM events),
ctr AS (
  SELECT *, row_number() OVER (PARTITION BY job, status, day ORDER BY ts, event_id) AS requests_total,
            sum(latency_cents) OVER (PARTITION BY job, day ORDER BY ts, event_id) AS latency_sum,
            row_number() OVER (PARTITION BY job, day ORDER BY ts, event_id) AS latency_count
  FROM req)"""


def _inc_sql(series: str, value: str, name: str) -> str:
    return f"""
{name} AS (
  SELECT {series}, step, CAST(sum(CASE WHEN p IS NULL THEN 0 WHEN v >= p THEN v - p ELSE v END) AS BIGINT)
         AS increase
  FROM (SELECT {series}, step, {value} AS v,
               lag({value}) OVER (PARTITION BY {series} ORDER BY ts, event_id) AS p FROM ctr)
  GROUP BY ALL)"""


def requests(spark, sf) -> DataFrame:
    ev = Tables(spark, sf).events
    et = F.col("event_type")
    return ev.select(
        "event_id", "ts", "user_id", "event_type",
        F.when(et.isin("click", "view"), "api").otherwise("predict_api_service").alias("job"),
        F.when(et == "error", "500").when(et == "signup", "201").otherwise("200").alias("status"),
        F.col("value").alias("latency_ms"),
        F.round(F.col("value") * 100).cast("bigint").alias("latency_cents"),
        F.date_trunc("hour", "ts").alias("step"), F.date_trunc("day", "ts").alias("day"))


def request_counter(req: DataFrame) -> DataFrame:
    """requests_total{job, status}: running count per (series, day)."""
    x = req.withColumn("_one", F.lit(1).cast("bigint"))
    x = running_sum(x, ["job", "status", "day"], ["ts", "event_id"], ["_one"], chunk=time_chunk("ts"))
    return x.withColumnRenamed("_one_cum", "requests_total").drop("_one")


def request_increase(spark, sf) -> DataFrame:
    ctr = request_counter(requests(spark, sf))
    return metrics.counter_increase(ctr, ["job", "status"], ["ts", "event_id"], "requests_total", "step")


@query("counter_rate", f"""
WITH {REQ_SQL}, {_inc_sql("job, status", "requests_total", "inc")}
SELECT job, status, step, increase, round(increase / {STEP_SECONDS}.0, 9) AS rate FROM inc
""")
def counter_rate(spark, sf):
    inc = request_increase(spark, sf)
    return inc.select("job", "status", "step", "increase", metrics.per_second("increase", STEP_SECONDS).alias("rate"))


@query("counter_rate_range", f"""
WITH {REQ_SQL},
steps AS (SELECT DISTINCT job, status, step + to_hours(CAST(i AS INTEGER)) AS eval_at FROM ctr, range(1, {RANGE_STEPS} + 1) t(i)),
w AS (
  SELECT s.job, s.status, s.eval_at, requests_total AS v,
         lag(requests_total) OVER (PARTITION BY s.job, s.status, s.eval_at ORDER BY ts, event_id) AS p
  FROM steps s JOIN ctr c ON s.job = c.job AND s.status = c.status
   AND c.ts >= s.eval_at - INTERVAL {RANGE_STEPS} HOUR AND c.ts < s.eval_at)
SELECT job, status, eval_at, CAST(sum(CASE WHEN p IS NULL THEN 0 WHEN v >= p THEN v - p ELSE v END) AS BIGINT) AS increase,
       round(sum(CASE WHEN p IS NULL THEN 0 WHEN v >= p THEN v - p ELSE v END) / ({RANGE_STEPS * STEP_SECONDS}.0), 9) AS rate
FROM w GROUP BY job, status, eval_at HAVING count(*) >= 2
""")
def counter_rate_range(spark, sf):
    """Rate over the last four hours, at every hour."""
    inc = metrics.sliding_increase(request_counter(requests(spark, sf)), ["job", "status"], ["ts", "event_id"],
                                   "requests_total", "step", RANGE_STEPS)
    return inc.select("job", "status", "eval_at", F.col("increase").cast("bigint").alias("increase"),
                      metrics.per_second("increase", RANGE_STEPS * STEP_SECONDS).alias("rate"))


@query("counter_rate_edges", f"""
WITH {REQ_SQL},
steps AS (SELECT DISTINCT job, status, step + to_hours(CAST(i AS INTEGER)) AS eval_at FROM ctr, range(1, {RANGE_STEPS} + 1) t(i)),
w AS (
  SELECT s.job, s.status, s.eval_at, requests_total AS v, epoch_us(ts) / 1e6 AS t, epoch_us(s.eval_at) / 1e6 AS t_end,
         lag(requests_total) OVER (PARTITION BY s.job, s.status, s.eval_at ORDER BY ts, event_id) AS p,
         first_value(requests_total) OVER (PARTITION BY s.job, s.status, s.eval_at ORDER BY ts, event_id) AS v0
  FROM steps s JOIN ctr c ON s.job = c.job AND s.status = c.status
   AND c.ts >= s.eval_at - INTERVAL {RANGE_STEPS} HOUR AND c.ts < s.eval_at),
g AS (SELECT job, status, eval_at, t_end, any_value(v0) AS v0, count(*) AS n, min(t) AS a, max(t) AS b,
             sum(CASE WHEN p IS NULL THEN 0 WHEN v >= p THEN v - p ELSE v END) AS increase
      FROM w GROUP BY job, status, eval_at, t_end HAVING count(*) >= 2 AND max(t) > min(t)),
h AS (SELECT *, (b - a) / (n - 1) AS gap, a - (t_end - {RANGE_STEPS * STEP_SECONDS}) AS to_start, t_end - b AS to_end FROM g),
k AS (SELECT *, CASE WHEN to_start >= 1.1::DOUBLE * gap THEN gap / 2 ELSE to_start END AS s0, CASE WHEN to_end >= 1.1::DOUBLE * gap THEN gap / 2 ELSE to_end END AS s1 FROM h)
SELECT job, status, eval_at, CAST(increase AS BIGINT) AS increase,
       round(increase * ((b - a) + CASE WHEN increase > 0 AND v0 >= 0 AND (b - a) * v0 / increase < s0 THEN (b - a) * v0 / increase ELSE s0 END + s1)
             / (b - a) / {RANGE_STEPS * STEP_SECONDS}, 9) AS rate
FROM k
""")
def counter_rate_edges(spark, sf):
    """W1 with extrapolation to the range's edges: rate over the last four hours, at every hour."""
    r = metrics.range_rate(request_counter(requests(spark, sf)), ["job", "status"], ["ts", "event_id"], "requests_total", "step",
                           RANGE_STEPS, STEP_SECONDS)
    return r.select("job", "status", "eval_at", F.col("increase").cast("bigint").alias("increase"), F.round("rate", 9).alias("rate"))


@query("rps_by_status", f"""
WITH {REQ_SQL}, {_inc_sql("job, status", "requests_total", "inc")}
SELECT step, status, round(sum(increase) / {STEP_SECONDS}.0, 9) AS rps FROM inc GROUP BY step, status
""")
def rps_by_status(spark, sf):
    inc = request_increase(spark, sf)
    return inc.groupBy("step", "status").agg(metrics.per_second(F.sum("increase"), STEP_SECONDS).alias("rps"))


@query("rate_5xx", f"""
WITH {REQ_SQL}, {_inc_sql("job, status", "requests_total", "inc")},
spine AS (SELECT unnest(generate_series(min(step), max(step), INTERVAL 1 HOUR)) AS step FROM req),
e AS (SELECT step, sum(increase) AS inc5 FROM inc WHERE regexp_full_match(status, '5..') GROUP BY step)
SELECT spine.step, CAST(COALESCE(inc5, 0) AS BIGINT) AS increase_5xx,
       round(COALESCE(inc5, 0) / {STEP_SECONDS}.0, 9) AS rate_5xx
FROM spine LEFT JOIN e USING (step)
""")
def rate_5xx(spark, sf):
    req = requests(spark, sf)
    inc = metrics.counter_increase(request_counter(req), ["job", "status"], ["ts", "event_id"],
                                   "requests_total", "step")
    # PromQL regexes are anchored
    e = inc.filter(F.col("status").rlike("^(5..)$")).groupBy("step").agg(F.sum("increase").alias("increase_5xx"))
    filled = metrics.zero_fill(e, metrics.time_spine(req, "step"), "step", ["increase_5xx"])
    return filled.select("step", F.col("increase_5xx").cast("bigint").alias("increase_5xx"),
                         metrics.per_second("increase_5xx", STEP_SECONDS).alias("rate_5xx"))


@query("avg_latency", f"""
WITH {REQ_SQL}, {_inc_sql("job", "latency_sum", "s")}, {_inc_sql("job", "latency_count", "c")}
SELECT job, step, round(s.increase / 100.0 / NULLIF(c.increase, 0), 6) AS avg_latency_ms
FROM s JOIN c USING (job, step)
""")
def avg_latency(spark, sf):
    req = requests(spark, sf).withColumn("_one", F.lit(1).cast("bigint"))
    ctr = running_sum(req, ["job", "day"], ["ts", "event_id"], ["latency_cents", "_one"], chunk=time_chunk("ts"))
    order = ["ts", "event_id"]
    s = metrics.counter_increase(ctr, ["job"], order, "latency_cents_cum", "step", name="inc_sum")
    c = metrics.counter_increase(ctr, ["job"], order, "_one_cum", "step", name="inc_cnt")
    j = s.join(c, ["job", "step"])
    return j.select("job", "step", F.round(metrics.ratio(F.col("inc_sum") / 100.0, F.col("inc_cnt")), 6)
                    .alias("avg_latency_ms"))


def _bucket_values() -> str:
    return ", ".join(f"({i + 1}, {b})" for i, b in enumerate(LATENCY_BOUNDS))


def quantile_sql() -> str:
    """Common table expressions up to ``quantiles`` (job, step, total, p95_ms)."""
    return f"""{REQ_SQL},
b AS (SELECT * FROM (VALUES {_bucket_values()}) t(i, ub)),
g AS (SELECT job, step, COUNT(*) AS total, {QUANTILE} * COUNT(*) AS rnk FROM req GROUP BY ALL),
cb AS (SELECT job, step, i, ub, sum(CASE WHEN latency_ms <= ub THEN 1 ELSE 0 END) AS cum
       FROM req, b GROUP BY ALL),
hit AS (SELECT g.job, g.step, g.total, g.rnk, min(cb.i) AS bi FROM g LEFT JOIN cb
          ON cb.job = g.job AND cb.step = g.step AND cb.cum >= g.rnk GROUP BY ALL),
x AS (SELECT hit.*, cur.ub AS end_ub, cur.cum AS cur_cum,
             COALESCE(prv.ub, 0) AS start_ub, COALESCE(prv.cum, 0) AS prev_cum
      FROM hit LEFT JOIN cb cur ON cur.job = hit.job AND cur.step = hit.step AND cur.i = hit.bi
               LEFT JOIN cb prv ON prv.job = hit.job AND prv.step = hit.step AND prv.i = hit.bi - 1),
quantiles AS (
  SELECT job, step, total,
         round(CASE WHEN bi IS NULL THEN {LATENCY_BOUNDS[-1]}
                    ELSE start_ub + (end_ub - start_ub) * (rnk - prev_cum) / (cur_cum - prev_cum) END, 6) AS p95_ms
  FROM x)"""


@query("p95_latency", f"""
WITH {quantile_sql()}
SELECT job, step, p95_ms FROM quantiles
""")
def p95_latency(spark, sf):
    req = requests(spark, sf)
    h = req.groupBy("job", "step").agg(metrics.cumulative_buckets("latency_ms", LATENCY_BOUNDS).alias("cum"))
    return h.select("job", "step", F.round(metrics.histogram_quantile(QUANTILE, LATENCY_BOUNDS, "cum"), 6)
                    .alias("p95_ms"))


@query("uptime", f"""
WITH s AS (SELECT 'api-' || CAST(user_id AS VARCHAR) AS container, max(ts) AS started
           FROM events WHERE event_type = 'signup' GROUP BY user_id),
u AS (SELECT container, round((epoch_us((SELECT max(ts) FROM events)) - epoch_us(started)) / 1e6, 3) AS uptime_s
      FROM s)
SELECT container, uptime_s,
       CASE WHEN uptime_s > {UPTIME_BANDS[0][1]} THEN 'green' WHEN uptime_s > {UPTIME_BANDS[0][0]} THEN 'yellow'
            ELSE 'red' END AS band
FROM u
""")
def uptime(spark, sf):
    ev = Tables(spark, sf).events
    as_of = ev.agg(F.max("ts")).scalar()
    s = (ev.filter(F.col("event_type") == "signup")
           .groupBy(F.concat(F.lit("api-"), F.col("user_id").cast("string")).alias("container"))
           .agg(F.max("ts").alias("started")))
    u = s.select("container", F.round(metrics.uptime_seconds(as_of, F.col("started")), 3).alias("uptime_s"))
    return u.withColumn("band", band("uptime_s", *UPTIME_BANDS))


@query("metric_latest", """
SELECT event_type AS series, arg_max(value, ts) AS value, max(ts) AS ts_latest,
       round(arg_max(value, ts) * 1e6 / 1024 / 1024, 6) AS value_mib
FROM events GROUP BY event_type
""")
def metric_latest(spark, sf):
    ev = Tables(spark, sf).events.withColumnRenamed("event_type", "series")
    lt = metrics.latest(ev, ["series"], "value", ["ts", "event_id"])
    return lt.select("series", "value", "ts_latest", F.round(F.col("value") * 1e6 / 1024 / 1024, 6).alias("value_mib"))


@query("metric_series", """
SELECT event_type AS series, date_trunc('hour', ts) AS step, arg_max(value, (ts, event_id)) AS value, max(ts) AS ts_latest,
       round(arg_max(value, (ts, event_id)) * 1e6 / 1024 / 1024, 6) AS value_mib
FROM events WHERE ts IS NOT NULL GROUP BY event_type, date_trunc('hour', ts)
""")
def metric_series(spark, sf):
    """The gauge's newest value of each step."""
    ev = (Tables(spark, sf).events.withColumnRenamed("event_type", "series").filter(F.col("ts").isNotNull())
          .withColumn("step", F.date_trunc("hour", "ts")))
    lt = metrics.latest(ev, ["series", "step"], "value", ["ts", "event_id"])
    return lt.select("series", "step", "value", "ts_latest", F.round(F.col("value") * 1e6 / 1024 / 1024, 6).alias("value_mib"))


@query("threshold_bands", f"""
WITH a AS (SELECT event_type, round(avg(value), 6) AS avg_ms, round(max(value) / 500.0, 6) AS score
           FROM events GROUP BY event_type)
SELECT event_type, avg_ms,
       CASE WHEN avg_ms > {LATENCY_BANDS[0][1]} THEN 'critical' WHEN avg_ms > {LATENCY_BANDS[0][0]} THEN 'warn'
            ELSE 'ok' END AS avg_band,
       score,
       CASE WHEN score > {SCORE_BANDS[0][1]} THEN 'high' WHEN score > {SCORE_BANDS[0][0]} THEN 'medium'
            ELSE 'low' END AS score_band
FROM a
""")
def threshold_bands(spark, sf):
    ev = Tables(spark, sf).events
    a = ev.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("avg_ms"),
                                     F.round(F.max("value") / 500.0, 6).alias("score"))
    return a.select("event_type", "avg_ms", band("avg_ms", *LATENCY_BANDS).alias("avg_band"),
                    "score", band("score", *SCORE_BANDS).alias("score_band"))
