"""Container incidents: CPU/memory %, classification, restart limiter, sustained alerts.

The restart limiter (W9) is greedy: an incident is granted a restart when
fewer than ``max_restarts`` *granted* restarts of the same container lie
in the trailing window; refusals do not use quota.  The decision depends
on every earlier decision, so it has no prefix-sum form (two runs that
start from different states can stay out of phase forever).  What does
hold exactly: after a pause of at least one window no earlier grant is
still inside it, so the state is empty.  The plan therefore

1. finds those reset points and numbers the episodes between them with
   :func:`~driftline.operators.sequence.gap_episodes` (exact, chunked: no
   task holds a whole container), and
2. folds each (container, episode) in time order with O(max_restarts) state:
   episodes are hash-partitioned, sorted by Spark's spilling sort and
   streamed through ``mapInPandas`` batch by batch, from grant to grant.

Episodes of different containers and of the same container run in
parallel; only an episode (a run of incidents without one quiet window)
is sequential, which is the definition of the rule.  The streaming twin
keeps the same O(max_restarts) state per container in a state store.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.operators.sequence import gap_episodes, number_runs, time_chunk

# Thresholds and limiter settings of the incident monitor.
CPU_THRESHOLD = 90.0
MEM_THRESHOLD = 90.0
MAX_RESTARTS = 3
RESTART_WINDOW_MINUTES = 10


def cpu_pct(cpu: Column, precpu: Column, system: Column, presystem: Column, online: Column) -> Column:
    """Delta cpu / delta system x online cpus x 100; 0 when the system delta is not positive."""
    sys_delta = system - F.coalesce(presystem, F.lit(0))
    cpu_delta = cpu - F.coalesce(precpu, F.lit(0))
    return F.when(sys_delta > 0, cpu_delta / sys_delta * F.coalesce(online, F.lit(1)) * 100.0) \
            .otherwise(F.lit(0.0))


def mem_pct(usage: Column, limit: Column) -> Column:
    """Usage / limit x 100; 0 when the limit is 0."""
    lim = F.coalesce(limit, F.lit(1))
    return F.when(lim != 0, F.coalesce(usage, F.lit(0)) / lim * 100.0).otherwise(F.lit(0.0))


def classify(always_on: Column, status: Column, exit_code: Column, health: Column,
             cpu: Column, mem: Column) -> Column:
    """F16: incident text or NULL.  Only always-on containers are checked;
    a CPU/MEM breach of a running container replaces a health failure."""
    # The incident texts.
    down = F.when(status != "running",
                  F.when(exit_code != 0, F.format_string("Exited with code %d", exit_code))
                   .otherwise(F.lit("Exited unexpectedly"))) \
            .when(health == "unhealthy", F.lit("Healthcheck failed"))
    usage = F.when(status == "running",
                   F.when(cpu > CPU_THRESHOLD, F.format_string("CPU %.1f%%>Thresh", cpu))
                    .when(mem > MEM_THRESHOLD, F.format_string("MEM %.1f%%>Thresh", mem)))
    return F.when(always_on, F.coalesce(usage, down))


def _grant(times: np.ndarray, granted: deque, max_restarts: int, window: int) -> np.ndarray:
    """Flags of sorted times (microseconds); ``granted`` holds the episode's newest grants and is carried on.

    With the quota used up, nothing is granted until the oldest of the newest ``max_restarts`` grants leaves
    the window: the search jumps there, so the loop runs once for each grant and not for each incident.
    """
    flags = np.zeros(len(times), dtype=bool)
    i = 0
    while max_restarts > 0 and i < len(times):
        if len(granted) == max_restarts:
            free = granted[0] + window
            if times[i] < free:
                i += int(np.searchsorted(times[i:], free))
                if i == len(times):
                    break
            granted.popleft()
        flags[i] = True
        granted.append(int(times[i]))
        i += 1
    return flags


def _limiter_fold(key: str, max_restarts: int, window_minutes: int):
    """Stream through sorted Arrow batches; the state (<= max_restarts times) resets per
    (key, episode) and is carried across batch boundaries.  Rows without a time are granted and use no quota."""
    window = window_minutes * 60_000_000

    def fold(batches):
        granted: deque = deque()
        last = None
        for pdf in batches:
            times = pdf["ts"].to_numpy().astype("datetime64[us]").astype("int64")
            timed = pdf["ts"].notna().to_numpy()
            run = pdf.groupby([key, "_episode"], sort=False, dropna=False).ngroup().to_numpy()
            starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]]) if len(pdf) else np.zeros(0, dtype="int64")
            flags = ~timed
            for lo, hi in zip(starts, np.r_[starts[1:], len(pdf)]):
                k, e = pdf[key].iat[lo], pdf["_episode"].iat[lo]
                own = (None if pd.isna(k) else k, None if pd.isna(e) else e)
                if own != last:
                    granted.clear()
                    last = own
                rows = np.arange(lo, hi)[timed[lo:hi]]
                flags[rows] = _grant(times[rows], granted, max_restarts, window)
            yield pdf.assign(granted=flags)
    return fold


def restart_limiter(incidents: DataFrame, key: str, ts: str, tie: str,
                    max_restarts: int = MAX_RESTARTS, window_minutes: int = RESTART_WINDOW_MINUTES) -> DataFrame:
    """Add ``granted`` to each incident row (see the module notes).

    Episodes are hash-partitioned, sorted inside their partition by Spark's
    external (spilling) sort and folded by ``mapInPandas`` one Arrow batch
    at a time, so no episode is ever held in memory as a whole.
    """
    chunk = time_chunk(ts)
    x = gap_episodes(incidents, [key], [ts, tie], F.make_dt_interval(mins=F.lit(window_minutes)), chunk,
                     out="_episode")
    x = x.withColumnRenamed(tie, "_tie")
    if ts != "ts":
        x = x.withColumnRenamed(ts, "ts")
    schema = T.StructType(list(x.schema.fields) + [T.StructField("granted", T.BooleanType())])
    parts = int(x.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ordered = x.repartition(parts, key, "_episode").sortWithinPartitions(key, "_episode", "ts", "_tie")
    out = ordered.mapInPandas(_limiter_fold(key, max_restarts, window_minutes), schema)
    out = out.withColumnRenamed("_tie", tie).drop("_episode")
    return out.withColumnRenamed("ts", ts) if ts != "ts" else out


def action(always_on: Column, granted: Column, incident: Column) -> tuple[Column, Column]:
    """(action, message) for an incident."""
    # The actions and the texts that follow an incident.
    act = F.when(always_on & granted, F.lit("restart")).otherwise(F.lit("alert"))
    msg = F.when(always_on & granted, F.concat(incident, F.lit("; restarted"))) \
           .when(always_on, F.concat(incident, F.lit("; restart limit reached"))) \
           .otherwise(incident)
    return act, msg


def sustained_islands(df: DataFrame, key: str, ts: str, tie: str, above: Column,
                      for_seconds: int) -> DataFrame:
    """Runs of consecutive samples above a threshold; ``firing`` when a
    run lasts at least ``for_seconds`` (gaps-and-islands, exact, chunked)."""
    chunk = time_chunk(ts)
    x = df.withColumn("_above", above.cast("int"))
    x = number_runs(x, [key], [ts, tie], "_above", lambda p, c: p != c, chunk, out="island")
    runs = (x.filter(F.col("_above") == 1).groupBy(key, "island")
              .agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count(F.lit(1)).alias("n_samples")))
    dur = (F.unix_micros("end") - F.unix_micros("start")) / F.lit(1e6)
    return runs.select(key, "start", "end", F.col("n_samples").cast("bigint").alias("n_samples"),
                       (dur >= F.lit(for_seconds)).alias("firing"))


def event_records(df: DataFrame, ts: str, container: str, act: str, status: str, message: str,
                  iso: Column) -> DataFrame:
    """K5 row shape: timestamp (ISO text), container, action, status, message."""
    return df.select(iso.alias("timestamp"), F.col(container).alias("container"), F.col(act).alias("action"),
                     F.col(status).alias("status"), F.col(message).alias("message"))


AGENT_EVENT_SCHEMA = "timestamp STRING, container STRING, action STRING, status STRING, message STRING"


def agent_event_summary(events: DataFrame) -> DataFrame:
    """Actions per container with the latest event time."""
    return events.groupBy("container", "action").agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                                                      F.max("timestamp").alias("last_timestamp"))
