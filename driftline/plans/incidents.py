"""Incident queries on ``events`` read as container stats samples.

Each event is one sample of container ``api-<user_id>``: CPU and system
counters are running sums per container (so the percentage needs the
previous sample), memory usage and limit come from the value, status /
exit code / health from the event type and the JSON ``k``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions.labels import iso_utc
from driftline.operators import incidents as inc
from driftline.operators.sequence import running_sum, time_chunk
from driftline.plans.registry import query
from driftline.session import cut_lineage, scratch_path
from driftline.sources.tables import Tables
from driftline.streaming.runner import file_stream, run_complete_available_now

SUSTAINED_SECONDS = 3600

SAMPLES_SQL = """
s0 AS (
  SELECT event_id, ts, user_id, 'api-' || CAST(user_id AS VARCHAR) AS container,
         user_id % 4 <> 0 AS always_on,
         CASE WHEN event_type = 'error' THEN 'exited' ELSE 'running' END AS status,
         CASE WHEN event_type = 'error' THEN k % 3 ELSE 0 END AS exit_code,
         CASE WHEN event_type = 'signup' AND k < 20 THEN 'unhealthy' ELSE 'healthy' END AS health,
         CAST(round(value * 100) AS BIGINT) * 10000 AS cpu_units,
         CAST(round(value * 100) AS BIGINT) * 100000 AS mem_usage,
         CASE WHEN user_id % 7 = 0 THEN 0 ELSE 250000000 END AS mem_limit,
         2 AS online_cpus
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)),
s1 AS (
  SELECT *, sum(cpu_units) OVER w AS cpu_total, 100000000 * row_number() OVER w AS system_total
  FROM s0 WINDOW w AS (PARTITION BY container ORDER BY ts, event_id)),
s2 AS (
  SELECT *, lag(cpu_total) OVER w AS precpu_total, lag(system_total) OVER w AS presystem_total
  FROM s1 WINDOW w AS (PARTITION BY container ORDER BY ts, event_id)),
samples AS (
  SELECT *,
    CASE WHEN system_total - COALESCE(presystem_total, 0) > 0
         THEN (cpu_total - COALESCE(precpu_total, 0)) / (system_total - COALESCE(presystem_total, 0))
              * online_cpus * 100.0 ELSE 0.0 END AS cpu_pct,
    CASE WHEN mem_limit <> 0 THEN mem_usage / mem_limit * 100.0 ELSE 0.0 END AS mem_pct
  FROM s2),
classified AS (
  SELECT *, CASE WHEN always_on THEN COALESCE(
      CASE WHEN status = 'running' THEN
        CASE WHEN cpu_pct > 90.0 THEN printf('CPU %.1f%%>Thresh', cpu_pct)
             WHEN mem_pct > 90.0 THEN printf('MEM %.1f%%>Thresh', mem_pct) END END,
      CASE WHEN status <> 'running' THEN
             CASE WHEN exit_code <> 0 THEN printf('Exited with code %d', exit_code) ELSE 'Exited unexpectedly' END
           WHEN health = 'unhealthy' THEN 'Healthcheck failed' END) END AS incident
  FROM samples)"""

# Exact oracle of the greedy limiter: a fold over each container's incidents
# carrying the last three granted times (g1 oldest).  Granted iff fewer than
# three grants lie in the trailing 10 minutes, i.e. unless g1 is inside it.
LIMITER_CTE = """
inc AS (SELECT event_id, ts, container, status, incident,
               row_number() OVER (PARTITION BY container ORDER BY ts, event_id) AS rn
        FROM classified WHERE incident IS NOT NULL),
r AS (
  SELECT container, rn, event_id, ts, status, incident, true AS granted,
         CAST(NULL AS TIMESTAMP) AS g1, CAST(NULL AS TIMESTAMP) AS g2, ts AS g3
  FROM inc WHERE rn = 1
  UNION ALL
  SELECT i.container, i.rn, i.event_id, i.ts, i.status, i.incident,
         NOT (r.g1 IS NOT NULL AND r.g1 > i.ts - INTERVAL 10 MINUTE),
         CASE WHEN NOT (r.g1 IS NOT NULL AND r.g1 > i.ts - INTERVAL 10 MINUTE) THEN r.g2 ELSE r.g1 END,
         CASE WHEN NOT (r.g1 IS NOT NULL AND r.g1 > i.ts - INTERVAL 10 MINUTE) THEN r.g3 ELSE r.g2 END,
         CASE WHEN NOT (r.g1 IS NOT NULL AND r.g1 > i.ts - INTERVAL 10 MINUTE) THEN i.ts ELSE r.g3 END
  FROM r JOIN inc i ON i.container = r.container AND i.rn = r.rn + 1),
acted AS (
  SELECT event_id, ts, container, status,
         CASE WHEN granted THEN 'restart' ELSE 'alert' END AS action,
         incident || CASE WHEN granted THEN '; restarted' ELSE '; restart limit reached' END AS message
  FROM r)"""


def samples(spark, sf) -> DataFrame:
    ev = Tables(spark, sf).events
    k = F.get_json_object("props", "$.k").cast("int")
    et = F.col("event_type")
    cents = F.round(F.col("value") * 100).cast("bigint")
    s = ev.select(
        "event_id", "ts", "user_id",
        F.concat(F.lit("api-"), F.col("user_id").cast("string")).alias("container"),
        (F.col("user_id") % 4 != 0).alias("always_on"),
        F.when(et == "error", "exited").otherwise("running").alias("status"),
        F.when(et == "error", k % 3).otherwise(0).alias("exit_code"),
        F.when((et == "signup") & (k < 20), "unhealthy").otherwise("healthy").alias("health"),
        (cents * 10000).alias("cpu_units"),
        F.lit(100000000).cast("bigint").alias("system_units"),
        (cents * 100000).alias("mem_usage"),
        F.when(F.col("user_id") % 7 == 0, 0).otherwise(250000000).cast("bigint").alias("mem_limit"),
        F.lit(2).alias("online_cpus"))
    order = ["ts", "event_id"]
    s = running_sum(s, ["container"], order, ["cpu_units", "system_units"], chunk=time_chunk("ts"))
    s = s.withColumnsRenamed({"cpu_units_cum": "cpu_total", "system_units_cum": "system_total"})
    # the previous sample's counter is the running total before this sample's increment
    s = s.withColumns({"precpu_total": F.col("cpu_total") - F.col("cpu_units"),
                       "presystem_total": F.col("system_total") - F.col("system_units")})
    return s.withColumns({
        "cpu_pct": inc.cpu_pct(F.col("cpu_total"), F.col("precpu_total"), F.col("system_total"),
                               F.col("presystem_total"), F.col("online_cpus")),
        "mem_pct": inc.mem_pct(F.col("mem_usage"), F.col("mem_limit")),
    })


def classified(spark, sf) -> DataFrame:
    s = samples(spark, sf)
    return s.withColumn("incident", inc.classify(F.col("always_on"), F.col("status"), F.col("exit_code"),
                                                 F.col("health"), F.col("cpu_pct"), F.col("mem_pct")))


@query("cpu_mem_pct", f"""
WITH {SAMPLES_SQL}
SELECT event_id, container, round(cpu_pct, 6) AS cpu_pct, round(mem_pct, 6) AS mem_pct FROM samples
""")
def cpu_mem_pct(spark, sf):
    s = samples(spark, sf)
    return s.select("event_id", "container", F.round("cpu_pct", 6).alias("cpu_pct"),
                    F.round("mem_pct", 6).alias("mem_pct"))


@query("incident_classify", f"""
WITH {SAMPLES_SQL}
SELECT event_id, container, status, incident FROM classified
""")
def incident_classify(spark, sf):
    return classified(spark, sf).select("event_id", "container", "status", "incident")


def acted(spark, sf) -> DataFrame:
    # the incidents (a small part of the samples) are written once: the episode
    # numbering reads them twice and must not re-derive the counters each time
    c = cut_lineage(classified(spark, sf).filter(F.col("incident").isNotNull())
                    .select("event_id", "ts", "container", "status", "incident", "always_on"))
    g = inc.restart_limiter(c.select("event_id", "ts", "container", "status", "incident", "always_on"),
                            "container", "ts", "event_id")
    act, msg = inc.action(F.col("always_on"), F.col("granted"), F.col("incident"))
    return g.select("event_id", "ts", "container", "status", act.alias("action"), msg.alias("message"))


@query("restart_limiter", f"""
WITH RECURSIVE {SAMPLES_SQL}, {LIMITER_CTE}
SELECT event_id, ts, container, status, action, message FROM acted
""")
def restart_limiter(spark, sf):
    return acted(spark, sf)


@query("agent_event_summary", f"""
WITH RECURSIVE {SAMPLES_SQL}, {LIMITER_CTE}
SELECT container, action, COUNT(*) AS n,
       strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%fZ') AS last_timestamp
FROM acted GROUP BY container, action
""")
def agent_event_summary(spark, sf):
    """K5 + S9 + T6: incidents appended as JSON lines; the dashboard tails the
    event files as a stream and keeps per-(container, action) counts."""
    a = acted(spark, sf)
    rec = inc.event_records(a, "ts", "container", "action", "status", "message", iso_utc("ts"))
    path = scratch_path(spark, "agent_events")
    rec.write.mode("append").json(path)
    tail = file_stream(spark, path, T.StructType.fromDDL(inc.AGENT_EVENT_SCHEMA), fmt="json")
    return run_complete_available_now(inc.agent_event_summary(tail), "agent_event_summary")


@query("sustained_alert", f"""
WITH {SAMPLES_SQL},
a AS (SELECT container, ts, event_id, CASE WHEN cpu_pct > 90.0 THEN 1 ELSE 0 END AS above FROM samples),
b AS (SELECT *, CASE WHEN lag(above) OVER w IS NULL OR lag(above) OVER w <> above THEN 1 ELSE 0 END AS chg
      FROM a WINDOW w AS (PARTITION BY container ORDER BY ts, event_id)),
c AS (SELECT *, sum(chg) OVER (PARTITION BY container ORDER BY ts, event_id) AS island FROM b)
SELECT container, min(ts) AS start, max(ts) AS "end", COUNT(*) AS n_samples,
       (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 >= {SUSTAINED_SECONDS} AS firing
FROM c WHERE above = 1 GROUP BY container, island
""")
def sustained_alert(spark, sf):
    s = samples(spark, sf)
    r = inc.sustained_islands(s, "container", "ts", "event_id", F.col("cpu_pct") > inc.CPU_THRESHOLD,
                              SUSTAINED_SECONDS)
    return r.select("container", "start", "end", "n_samples", "firing")
