"""Operator semantics on hand-made frames: the traps, golden fixtures and invariants."""

from __future__ import annotations

import datetime as dt
import os
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions import labels
from driftline.operators import clean, drift, evaluate, incidents, logs, metrics, prepare, registry, sampling
from driftline.operators.sequence import gap_episodes, lag_exact, running_sum
from driftline.sources import delimited

# The recorded agent event log (container, time, action) used as a golden
# limiter fixture: restarts, three refusals inside the 10-minute window, restarts again.
AGENT_EVENTS = [
    ("streamlit", "2025-07-11T06:52:08.562444", "restart"),
    ("grafana_service", "2025-07-11T06:52:08.912024", "restart"),
    ("streamlit", "2025-07-11T06:52:52.891398", "restart"),
    ("grafana_service", "2025-07-11T07:06:49.441580", "restart"),
    ("grafana_service", "2025-07-11T07:09:31.727234", "restart"),
    ("grafana_service", "2025-07-11T07:10:10.794485", "restart"),
    ("grafana_service", "2025-07-11T07:14:55.268781", "alert"),
    ("grafana_service", "2025-07-11T07:15:34.338502", "alert"),
    ("grafana_service", "2025-07-11T07:16:13.414004", "alert"),
    ("grafana_service", "2025-07-11T07:16:52.816097", "restart"),
    ("grafana_service", "2025-07-11T07:26:02.845497", "restart"),
    ("grafana_service", "2025-07-11T07:28:06.248099", "restart"),
]


def _ts(s):
    return dt.datetime.fromisoformat(s)


def _scratch(spark, name):
    return f"{spark.sparkContext.getConf().get('spark.checkpoint.dir')}/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- limiter / incidents

def test_restart_limiter_reproduces_recorded_events(spark):
    rows = [(i, c, _ts(t)) for i, (c, t, _) in enumerate(AGENT_EVENTS)]
    df = spark.createDataFrame(rows, "event_id long, container string, ts timestamp")
    out = incidents.restart_limiter(df, "container", "ts", "event_id").orderBy("event_id").collect()
    got = ["restart" if r["granted"] else "alert" for r in out]
    assert got == [a for _, _, a in AGENT_EVENTS]


def test_restart_limiter_stream_processor_matches_batch(spark):
    from driftline.plans.streams import limited
    from driftline.streaming.runner import file_stream, landed, run_available_now, use_rocksdb_state
    rows = [(i, c, _ts(t), "exited", "Exited unexpectedly") for i, (c, t, _) in enumerate(AGENT_EVENTS)]
    df = spark.createDataFrame(rows, "event_id long, container string, ts timestamp, status string, text string")
    landing = landed(df, "limiter-landing")
    use_rocksdb_state(spark)
    stream = file_stream(spark, landing, df.schema).withWatermark("ts", "10 minutes")
    stream = stream.filter(F.when(F.col("ts").isNotNull(), F.col("text")).isNotNull())
    out = run_available_now(limited(stream), "limiter_test").orderBy("event_id").collect()
    assert [r["action"] for r in out] == [a for _, _, a in AGENT_EVENTS]
    assert out[6]["message"] == "Exited unexpectedly; restart limit reached"


def test_monitor_stream_equals_batch_with_files_out_of_order(spark):
    import random

    from driftline.plans.streams import monitored
    from driftline.streaming.runner import file_stream, run_available_now, use_rocksdb_state
    rng = random.Random(5)
    t0 = dt.datetime(2024, 1, 1, 10)
    rows = [(i, t0 + dt.timedelta(seconds=rng.randrange(2 * 3600), microseconds=rng.randrange(10**6)), f"c{rng.randrange(2)}", True,
             "exited", 1, "healthy", 0, 0, 0, 0, 1, 0, 1) for i in range(240)]
    rows.append((999, t0 + dt.timedelta(hours=9), "c0", True, "running", 0, "healthy", 0, 0, 0, 0, 1, 0, 1))  # moves the watermark on
    rows.append((1000, None, "c0", True, "exited", 1, "healthy", 0, 0, 0, 0, 1, 0, 1))
    schema = ("event_id long, ts timestamp, container string, always_on boolean, status string, exit_code int, health string, cpu_total long, "
              "precpu_total long, system_total long, presystem_total long, online_cpus int, mem_usage long, mem_limit long")
    arrival = sorted(rows, key=lambda r: (r[1] or t0) + dt.timedelta(seconds=rng.randrange(240)))
    landing = _scratch(spark, "monitor-landing")
    for k in range(0, len(arrival), 61):
        spark.createDataFrame(arrival[k:k + 61], schema).coalesce(1).write.mode("append").parquet(landing)
    use_rocksdb_state(spark)
    stream = file_stream(spark, landing, spark.read.parquet(landing).schema, max_files=1)
    got = {r["event_id"]: r["action"] for r in run_available_now(monitored(stream), "monitor_test").collect()}
    batch = incidents.restart_limiter(spark.createDataFrame(rows[:240], schema).select("event_id", "ts", "container"), "container", "ts", "event_id")
    assert got == {r["event_id"]: "restart" if r["granted"] else "alert" for r in batch.collect()}


def test_episodes_split_at_quiet_windows(spark):
    t0 = dt.datetime(2024, 1, 1, 23, 50)
    mins = [0, 5, 14, 30, 39, 49, 60, 61]   # gaps >= 10 start episodes; crosses midnight
    df = spark.createDataFrame([(i, "c", t0 + dt.timedelta(minutes=m)) for i, m in enumerate(mins)],
                               "id long, k string, ts timestamp")
    day = F.date_trunc("day", "ts")
    out = gap_episodes(df, ["k"], ["ts", "id"], F.make_dt_interval(mins=F.lit(10)), day).orderBy("id").collect()
    assert [r["episode"] for r in out] == [1, 1, 1, 2, 2, 3, 4, 4]


def test_cpu_and_memory_guards(spark):
    df = spark.createDataFrame([(200, 100, 1000, 500, 2, 50, 0), (100, 100, 500, 500, 2, 50, 100)],
                               "c long, pc long, s long, ps long, n int, mu long, ml long")
    r = df.select(incidents.cpu_pct(*[F.col(c) for c in ("c", "pc", "s", "ps", "n")]).alias("cpu"),
                  incidents.mem_pct(F.col("mu"), F.col("ml")).alias("mem")).collect()
    assert r[0]["cpu"] == pytest.approx(40.0) and r[0]["mem"] == 0.0
    assert r[1]["cpu"] == 0.0 and r[1]["mem"] == pytest.approx(50.0)


def test_incident_priority(spark):
    rows = [(True, "exited", 137, None, 0.0, 0.0), (True, "exited", 0, None, 0.0, 0.0),
            (True, "running", 0, "unhealthy", 95.04, 0.0), (True, "running", 0, "unhealthy", 10.0, 0.0),
            (False, "exited", 1, None, 99.0, 99.0), (True, "running", 0, "healthy", 10.0, 91.25)]
    df = spark.createDataFrame(rows, "a boolean, st string, ec int, h string, cpu double, mem double")
    got = [r[0] for r in df.select(incidents.classify(*[F.col(c) for c in df.columns])).collect()]
    assert got == ["Exited with code 137", "Exited unexpectedly", "CPU 95.0%>Thresh", "Healthcheck failed",
                   None, "MEM 91.3%>Thresh"]


def test_sustained_islands(spark):
    t0 = dt.datetime(2024, 1, 1)
    vals = [95, 96, 97, 10, 99, 10]
    df = spark.createDataFrame([(i, "c", t0 + dt.timedelta(minutes=30 * i), float(v)) for i, v in enumerate(vals)],
                               "id long, k string, ts timestamp, v double")
    out = incidents.sustained_islands(df, "k", "ts", "id", F.col("v") > 90, 3600).orderBy("start").collect()
    assert [(r["n_samples"], r["firing"]) for r in out] == [(3, True), (1, False)]


# ---------------------------------------------------------------- ordered helpers

def test_running_sum_and_lag_exact_match_plain_windows(spark):
    from pyspark.sql import Window
    rows = [(k, i, float((i * 7) % 11)) for k in ("a", "b") for i in range(200)]
    df = spark.createDataFrame(rows, "k string, t long, v double")
    w = Window.partitionBy("k").orderBy("t")
    ref = df.select("k", "t", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("c"),
                    F.lag("v").over(w).alias("p"))
    got = running_sum(df, ["k"], ["t"], ["v"], buckets=7)
    got = lag_exact(got, ["k"], ["t"], ["v"], F.floor(F.col("t") / 13))
    a = {(r["k"], r["t"]): (r["c"], r["p"]) for r in ref.collect()}
    b = {(r["k"], r["t"]): (r["v_cum"], r["prev_v"]) for r in got.collect()}
    assert a == b


# ---------------------------------------------------------------- sampling

@pytest.mark.parametrize("n,expected", [(1, 0), (3, 2), (5, 2), (4, 2), (7, 4)])
def test_sample_size_rounds_half_even(spark, n, expected):
    df = spark.range(n).withColumnRenamed("id", "k")
    assert sampling.sample_exact(df, ["k"], 0.5, "s").count() == expected


def test_splits_are_exact_and_disjoint(spark):
    df = spark.range(1003).select(F.col("id").alias("k"), (F.col("id") % 3).alias("y"))
    r = sampling.split_random(df, ["k"], 0.2, "s")
    assert r.filter("split = 'test'").count() == 201
    assert r.select("k").distinct().count() == 1003
    s = sampling.split_stratified(df, ["k"], "y", 0.2, "s")
    per = {row["y"]: row["n"] for row in s.filter("split = 'test'").groupBy("y").agg(F.count("*").alias("n")).collect()}
    assert sum(per.values()) == 201 and max(per.values()) - min(per.values()) <= 1


def test_bootstrap_draws_only_observed_values(spark):
    from driftline.operators import bootstrap
    src = spark.createDataFrame([(i, float(i % 4) if i % 5 else None, None) for i in range(50)],
                                "k long, x double, z string")
    out = bootstrap.bootstrap_columns(src.select("k"), src, ["k"], ["x"], "s")
    vals = {r["x"] for r in out.collect()}
    assert out.count() == 50 and vals <= {0.0, 1.0, 2.0, 3.0} and None not in vals


# ---------------------------------------------------------------- prepare / evaluate

def test_mode_takes_smallest_on_ties_and_ignores_nulls(spark):
    df = spark.createDataFrame([(2,), (1,), (2,), (1,), (None,), (None,), (None,)], "a int")
    assert prepare.column_modes(df, ["a"]) == {"a": 1}


def test_zscore_population_std_and_constant_column(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, c double")
    r = prepare.standardize(df, ["x", "c"]).collect()
    assert [row["x"] for row in r] == [-1.0, 1.0] and [row["c"] for row in r] == [0.0, 0.0]


def test_report_zero_division_is_zero(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0)], "y int, p int")
    rep = {r["label"]: r for r in evaluate.classification_report(df, "y", "p").collect()}
    assert rep["1"]["precision"] == 0.0 and rep["1"]["recall"] == 0.0
    assert rep["accuracy"]["precision"] == pytest.approx(0.666667)


# ---------------------------------------------------------------- drift

def test_ks_identical_samples_is_zero_and_bounded(spark):
    df = spark.createDataFrame([(float(i % 17), float(i)) for i in range(300)], "a double, b double")
    shifted = df.select((F.col("a") + 100).alias("a"), "b")
    same = drift.ks_statistic(df, df, ["a", "b"]).collect()
    assert all(r["drift_score"] == 0.0 for r in same)
    moved = {r["feature"]: r["drift_score"] for r in drift.ks_statistic(df, shifted, ["a", "b"]).collect()}
    assert moved["a"] == 1.0 and moved["b"] == 0.0


def test_histogram_folds_max_into_last_bin_and_widens_constants(spark):
    ref = spark.createDataFrame([(0.0, 7.0), (15.0, 7.0)], "v double, c double")
    cur = spark.createDataFrame([(15.0, 7.0), (16.0, 7.0)], "v double, c double")
    h = drift.shared_histogram(ref, cur, ["v", "c"], bins=15)
    v = {r["bin"]: (r["ref_count"], r["cur_count"]) for r in h.filter("feature = 'v'").collect()}
    assert v[1] == (1, 0) and v[15] == (1, 1) and sum(c for _, c in v.values()) == 1
    c = h.filter("feature = 'c'").agg(F.min("edge_lo"), F.max("edge_hi")).first()
    assert (c[0], c[1]) == (6.5, 7.5)


def test_forced_drift_moves_score_not_flag(spark):
    df = spark.createDataFrame([(float(i),) for i in range(100)], "a double")
    f = drift.feature_drift(df, df, ["a"], forced_pct=0.4).first()
    assert f["drift_score"] == pytest.approx(0.4) and f["drift_detected"] is False


# ---------------------------------------------------------------- metrics

def test_histogram_quantile_interpolates_and_caps_at_inf(spark):
    df = spark.createDataFrame([([2.0, 6.0, 10.0],), ([0.0, 0.0, 10.0],), ([0.0, 0.0, 0.0],)], "cum array<double>")
    got = [r[0] for r in df.select(metrics.histogram_quantile(0.5, [1.0, 2.0], "cum")).collect()]
    assert got == [pytest.approx(1.75), 2.0, None]


def test_counter_reset_adds_the_new_value(spark):
    t0 = dt.datetime(2024, 1, 1)
    vals = [5, 8, 2, 4]
    df = spark.createDataFrame([(i, "s", t0 + dt.timedelta(minutes=i), v) for i, v in enumerate(vals)],
                               "id long, k string, ts timestamp, v long")
    df = df.withColumn("step", F.date_trunc("hour", "ts"))
    r = metrics.counter_increase(df, ["k"], ["ts", "id"], "v", "step").first()
    assert r["increase"] == 0 + 3 + 2 + 2


# ---------------------------------------------------------------- cleaning / registry / logs

def test_domain_validation_and_defaults(spark):
    df = spark.createDataFrame([(1, 1), (8, 1), (None, 2)], "trajet int, catu int")
    dom = {"trajet": [-1, 0, 1, 2, 3, 4, 5, 9], "catu": (1, 3)}
    v = [r["violations"] for r in clean.validate(df, dom).collect()]
    assert v == [[], ["trajet"], ["trajet"]]
    with pytest.raises(clean.DomainError):
        clean.validate(df, dom, mode="strict")
    filled = clean.fill_absent(df, ["trajet", "catu", "sexe"])
    assert filled.first()["sexe"] == 1


def test_versions_order_as_integers(spark):
    df = spark.createDataFrame([("m", "99", "None", "r1", {"best_model": "0.9"}),
                                ("m", "746", "None", "r2", {"best_model": "bad"}),
                                ("m", "100", "Production", "r3", {})],
                               "model_name string, model_version string, stage string, run_id string, "
                               "tags map<string,string>")
    assert registry.latest_version(df).first()["model_version"] == "100"
    assert registry.latest_version(df.filter("stage <> 'Production'")).first()["model_version"] == "746"
    assert registry.best_version(df).first()["best_version"] == "99"


def test_log_level_label_wins_then_text(spark):
    df = spark.createDataFrame([("info", "an error"), ("", "An ERROR"), (None, "slow")], "l string, m string")
    assert [r[0] for r in df.select(logs.infer_level(F.col("l"), F.col("m"))).collect()] == \
        ["info", "error", "warning"]


def test_recent_problems_total_counts_only_top(spark):
    t = dt.datetime(2024, 1, 2)
    rows = [(t, f"m{i:02d}") for i in range(25) for _ in range(1 + (i % 3))]
    df = spark.createDataFrame(rows, "ts timestamp, message string")
    out = logs.recent_problems(df, F.lit(t), 24).collect()
    assert len(out) == 20 and out[0]["total_all"] == len(rows)
    assert out[0]["total_top"] == sum(r["cnt"] for r in out)


# ---------------------------------------------------------------- files

def test_too_many_fields_dropped_short_lines_padded(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text("a;b;c\nd;e\nf;g;h;\ni;j;k;l\n\"m;n\";o;p\n")
    out = delimited.read_skip_long_lines(spark, str(p), ["x", "y", "z"]).collect()
    assert [tuple(r) for r in out] == [("a", "b", "c"), ("d", "e", None), ("m;n", "o", "p")]


def test_encoding_fallback_reads_latin1(spark, tmp_path):
    p = tmp_path / "l.csv"
    p.write_bytes("name;n\ncaf\xe9;1\n".encode("latin-1"))
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("n", T.IntegerType())])
    assert delimited.read_with_encoding_fallback(spark, str(p), schema).first()["name"] == "café"


def test_pct_normalize_and_bands(spark):
    df = spark.createDataFrame([(0.842,), (84.25,), (None,)], "x double")
    assert [r[0] for r in df.select(labels.pct_normalize("x")).collect()] == [84.2, 84.3, None]
    b = spark.createDataFrame([(0.05,), (0.2,), (0.31,)], "s double").select(labels.drift_severity("s"))
    assert [r[0] for r in b.collect()] == ["low", "medium", "high"]


def test_scratch_paths_live_under_the_checkpoint_dir(spark):
    from driftline.session import checkpoint_dir, scratch_path
    assert scratch_path(spark, "x").startswith(checkpoint_dir(spark) + "/")
    assert os.path.isdir(checkpoint_dir(spark))


def test_display_helpers(spark):
    df = spark.createDataFrame([(1234567, 3 * 1024 * 1024)], "n long, b long")
    r = df.select(labels.thousands("n"), labels.mib_text("b")).first()
    assert tuple(r) == ("1 234 567", "3.0 MiB")


def test_year_family_reads_all_years_with_a_year_column(spark, tmp_path):
    for y, rows in ((2022, "k;v\n1;a\n2;b\n"), (2023, "k;v\n3;c\n")):
        (tmp_path / f"usagers-{y}.csv").write_text(rows)
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType())])
    df = delimited.year_family(spark, str(tmp_path / "usagers-{year}.csv"), [2022, 2023], schema)
    assert sorted((r["k"], r["year"]) for r in df.collect()) == [(1, 2022), (2, 2022), (3, 2023)]


def test_row_cap_prefilter_keeps_the_exact_first_rows(spark):
    from driftline.operators.merge import cap_rows
    df = spark.range(5000).select(((F.col("id") * 7919) % 5000).alias("k"), (F.col("id") % 3).alias("x"))
    df = df.unionByName(spark.createDataFrame([(None, 1)], "k long, x long"))
    got = sorted(r["k"] for r in cap_rows(df, ["k", "x"], 1200).collect())
    assert got == list(range(1200))


# ---------------------------------------------------------------- model (no SQL oracle: invariants)

def test_one_hot_columns_and_vector_path_agree(spark):
    from pyspark.ml.functions import vector_to_array
    df = spark.createDataFrame([(i, lv) for i, lv in enumerate(["b", "a", "c", "b", "c"])], "id int, t string")
    cols = prepare.one_hot(df, "t").orderBy("id").collect()
    assert [(r["t_b"], r["t_c"]) for r in cols] == [(1, 0), (0, 0), (0, 1), (1, 0), (0, 1)]
    df = df.unionByName(spark.createDataFrame([(5, None)], "id int, t string"))
    vec = prepare.one_hot(df, "t", layout="vector").orderBy("id")
    arr = [r[0] for r in vec.select(vector_to_array("t_vec")).collect()]
    # slots (b, c): the first level 'a' and NULL are all zeros, as with dummy columns
    assert arr == [[1.0, 0.0], [0.0, 0.0], [0.0, 1.0], [1.0, 0.0], [0.0, 1.0], [0.0, 0.0]]
    full = prepare.one_hot(df, "t", drop_first=False, layout="vector").orderBy("id")
    arr = [r[0] for r in full.select(vector_to_array("t_vec")).collect()]
    assert arr[1] == [1.0, 0.0, 0.0] and arr[5] == [0.0, 0.0, 0.0]


def test_salted_full_outer_join_equals_plain_join(spark):
    from driftline.operators.merge import full_outer_salted
    left = spark.createDataFrame([(1, f"l{i}") for i in range(9)] + [(2, "l9"), (3, "l10"), (None, "ln")] +
                                 [(5, f"m{i}") for i in range(7)], "k int, a string")
    right = spark.createDataFrame([(1, "r0"), (1, "r1"), (4, "r2"), (None, "rn")] +
                                  [(6, f"s{i}") for i in range(8)] + [(2, "r3")], "k int, b string")
    plain = sorted(repr(tuple(r)) for r in left.join(right, "k", "full_outer").collect())
    salted = full_outer_salted(left, right, "k", hot_rows=3)
    assert sorted(repr(tuple(r)) for r in salted.select("k", "a", "b").collect()) == plain


def test_merge_cap_cuts_the_inputs_exactly(spark):
    from driftline.operators import merge
    a = spark.range(20_000).selectExpr("id % 5000 as k", "id as x").unionAll(spark.createDataFrame([(None, -1)], "k long, x long"))
    b = spark.range(9_000).selectExpr("id - 3000 as k", "id as y")
    order = ["k", "x", "y"]
    whole = [tuple(r) for r in merge.merge_outer([a, b], "k").select(*order).collect()]
    last = lambda row: tuple((v is None, v or 0) for v in row)
    whole.sort(key=last)
    for limit in (1, 10, 2_999, 3_002, 12_000, len(whole) - 1, len(whole) + 5):
        got = sorted((tuple(r) for r in merge.merge_cap([a, b], "k", order, limit).select(*order).collect()), key=last)
        assert got == whole[:limit]
    assert merge.cut_key([a, b], "k", 100) < -2000
    hot = spark.range(50_000).selectExpr("7 as k", "id as x")
    assert merge.merge_cap([hot, b.filter("k = 7")], "k", order, 30).count() == 30


def test_merge_outer_hot_path_equals_plain_chain(spark):
    from driftline.operators.merge import merge_outer
    a = spark.createDataFrame([(1, f"a{i}") for i in range(6)] + [(2, "a6"), (None, "an")], "k int, a string")
    b = spark.createDataFrame([(1, "b0"), (1, "b1"), (3, "b2")], "k int, b string")
    c = spark.createDataFrame([(1, "c0"), (2, "c1"), (4, "c2"), (4, "c3")], "k int, c string")
    plain = sorted(repr(tuple(r)) for r in merge_outer([a, b, c], "k").select("k", "a", "b", "c").collect())
    hot = sorted(repr(tuple(r)) for r in merge_outer([a, b, c], "k", hot_rows=2).select("k", "a", "b", "c").collect())
    assert hot == plain and len(plain) == 6 * 2 + 1 + 1 + 1 + 2


def test_package_is_shipped_to_python_workers(spark):
    """Workers started outside the repository must still import driftline."""
    from driftline.session import _SHIPPED
    assert spark.sparkContext.applicationId in _SHIPPED

    def probe(batches):
        import driftline  # noqa: F401  (fails when the package is not shipped)
        for b in batches:
            yield b
    assert spark.range(3).mapInPandas(probe, "id long").count() == 3


def test_stream_resumes_from_its_checkpoint_exactly_once(spark):
    from driftline.plans.logs import log_lines
    from driftline.streaming.runner import file_stream, run_available_now
    from driftline.schemas import TABLES
    src, sink, ckpt = _scratch(spark, "src"), _scratch(spark, "sink"), _scratch(spark, "ckpt")
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    ev.filter("event_id < 600").write.parquet(f"{src}/part=a")
    query = lambda: log_lines(file_stream(spark, src, TABLES["events"])).select("event_id", "message")
    first = run_available_now(query(), "resume", sink=sink, checkpoint=ckpt).count()
    ev.filter("event_id >= 600").write.parquet(f"{src}/part=b")     # new input lands
    out = run_available_now(query(), "resume", sink=sink, checkpoint=ckpt)
    assert first == 600 and out.count() == ev.count() == out.select("event_id").distinct().count()


def test_fast_draw_split_is_exact_and_repeatable(spark):
    df = spark.range(2001).select(F.col("id").alias("k"), (F.col("id") * 0.5).alias("v"))
    a = sampling.split_random(df, ["k", "v"], 0.2, "s", engine_neutral=False)
    b = sampling.split_random(df, ["k", "v"], 0.2, "s", engine_neutral=False)
    ta = {r["k"] for r in a.filter("split = 'test'").collect()}
    assert len(ta) == 401 and ta == {r["k"] for r in b.filter("split = 'test'").collect()}


def test_running_sum_with_sub_ranges_matches_plain_window(spark, monkeypatch):
    from pyspark.sql import Window
    import driftline.operators.sequence as seq
    monkeypatch.setattr(seq, "CHUNK_ROWS", 3)     # force many sub-ranges per quantile range
    rows = [(k, float((i * 37) % 101) + (0.5 if k == "b" else 0.0), 1 + i % 3) for k in ("a", "b") for i in range(300)]
    df = spark.createDataFrame(rows, "k string, v double, n long").groupBy("k", "v").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("k").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ref = {(r["k"], r["v"]): r["c"] for r in df.select("k", "v", F.sum("n").over(w).alias("c")).collect()}
    got = {(r["k"], r["v"]): r["n_cum"] for r in seq.running_sum(df, ["k"], ["v"], ["n"], buckets=4).collect()}
    assert got == ref


def test_bootstrap_preserves_marginals(spark):
    from driftline.operators import bootstrap
    src = spark.read.parquet("/root/testdata/sf0.01/orders.parquet").select("o_orderkey", "o_orderpriority",
                                                                            "o_orderstatus")
    out = bootstrap.bootstrap_columns(src.select("o_orderkey"), src, ["o_orderkey"],
                                      ["o_orderpriority", "o_orderstatus"], "marginals")
    n = src.count()
    for c in ("o_orderpriority", "o_orderstatus"):
        want = {r[0]: r[1] / n for r in src.groupBy(c).count().collect()}
        got = {r[0]: r[1] / n for r in out.groupBy(c).count().collect()}
        assert set(got) <= set(want)
        # each share within 5 binomial standard errors of the source share
        assert all(abs(got.get(v, 0.0) - p) <= 5 * (p * (1 - p) / n) ** 0.5 for v, p in want.items())


# ---------------------------------------------------------------- records with line breaks

@pytest.mark.parametrize("split", [13, 64, 1 << 20])
def test_quoted_records_over_splits_match_a_csv_reader(spark, monkeypatch, tmp_path, split):
    import csv
    import random

    from driftline.sources import delimited
    monkeypatch.setattr(delimited, "MAX_RECORD_CHARS", 400)
    rng = random.Random(split)
    want = []
    for k in range(3):
        records, text = [], "a;b;c\n"
        for i in range(40):
            fields = ["".join(rng.choice('xy;\n"é ') for _ in range(rng.randrange(12))) for _ in range(rng.choice([2, 3, 3, 3, 4]))]
            if i == 5:
                fields = ["a", "b", "c"]  # like the header
            if i == 9:
                fields = ["w" * 500 + "\n", "", ""]  # longer than a record may be
            text += ";".join(f if f.isalnum() else '"' + f.replace('"', '""') + '"' for f in fields) + "\n"
            records.append(fields)
        path = tmp_path / f"part{k}.csv"
        path.write_text(text, newline="")
        with open(path, newline="") as f:
            read = list(csv.reader(f, delimiter=";"))[1:]
        assert read == records
        want += [tuple((v or None) for v in (r + [""] * 3)[:3]) for r in read if len(r) <= 3 and len(r[0]) < 400]
    was = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = delimited.read_skip_long_lines(spark, str(tmp_path), sep=";", header=True, breaks=True).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was[0])
        spark.conf.set("spark.sql.files.openCostInBytes", was[1])
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_rows_like_the_header_are_data(spark, tmp_path):
    from driftline.sources import delimited
    for k in range(2):
        (tmp_path / f"f{k}.csv").write_text("a;b\n1;2\na;b\n")
    got = delimited.read_skip_long_lines(spark, str(tmp_path), sep=";", header=True).collect()
    assert sorted(map(tuple, got)) == [("1", "2")] * 2 + [("a", "b")] * 2


# ---------------------------------------------------------------- draws, quotas

def test_mark_smallest_takes_part_of_equal_rows_and_keeps_the_rest_in_place(spark):
    """Rows that repeat at the cut are taken up to the size asked for; null keys and clashing columns are carried."""
    from driftline.operators import sampling
    rows = [(1, None, "x")] * 400 + [(k, k % 3, None) for k in range(2, 300)] + [(None, 0, "n")] * 3
    df = spark.createDataFrame(rows, "k int, g int, draw string").repartition(5)
    for frac in (0.0, 0.1, 0.5, 0.9, 1.0):
        got = sampling.sample_exact(df, ["k"], frac, "s", keep_unselected=True)
        assert got.columns == ["k", "g", "draw", "selected"]
        back = got.collect()
        assert sorted(repr(tuple(r)[:3]) for r in back) == sorted(map(repr, rows))
        assert sum(r["selected"] for r in back) == round(len(rows) * frac)
        draws = sampling.with_draw(df.select("k").distinct(), ["k"], "s").collect()
        order = {r["k"]: r["_draw"] for r in draws}
        last = max((order[r["k"]] for r in back if r["selected"]), default=-1)
        assert all(r["selected"] for r in back if order[r["k"]] < last)
    alloc = spark.createDataFrame([(0, 40), (1, 0), (2, 99)], "g int, k long")
    marked = sampling.mark_smallest(sampling.with_draw(df, ["k"], "s"), "_draw", alloc, ["g"], ["k"]).filter("selected")
    assert {r["g"]: r["count"] for r in marked.groupBy("g").count().collect()} == {0: 40, 2: 99}
    assert sampling.sample_exact(df.limit(0), ["k"], 0.5, "s").count() == 0


def test_mark_smallest_flags_whole_rows_without_a_shuffle(spark):
    """Only the narrow tables of draws are shuffled; the rows are compared with one row per group."""
    from driftline.operators import sampling
    df = spark.range(2000).selectExpr("id", "id % 7 AS g", "repeat('x', 50) AS text")
    plan = sampling.sample_exact(df, ["id"], 0.3, "s")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and "Window" not in plan
    plan = sampling.split_stratified(df, ["id"], "g", 0.3, "s")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "Window" not in plan


def test_restart_limiter_jumps_equal_the_rule_row_by_row(spark):
    """Random incidents, one batch of Arrow rows being smaller than an episode; null times use no quota."""
    import datetime as dt
    import random

    from driftline.operators import incidents
    rnd, t0 = random.Random(3), dt.datetime(2024, 1, 1)
    rows = []
    for c, gap in (("dense", 5), ("even", 200), ("sparse", 900), (None, 60)):
        t = 0
        for _ in range(300):
            t += rnd.choice((0, 1, gap, gap, 2 * gap, 600))
            rows.append((len(rows), c, t0 + dt.timedelta(seconds=t)))
    rows += [(len(rows) + i, "even", None) for i in range(5)]
    df = spark.createDataFrame(rows, "event_id int, container string, ts timestamp").repartition(6)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        for quota in (0, 1, 3):
            got = {r["event_id"]: r["granted"] for r in
                   incidents.restart_limiter(df, "container", "ts", "event_id", max_restarts=quota).collect()}
            want, grants = {}, {}
            for i, c, t in sorted(rows, key=lambda r: (r[2] or dt.datetime.min, r[0])):
                recent = [g for g in grants.setdefault(c, []) if t and g > t - dt.timedelta(minutes=10)]
                want[i] = t is None or len(recent) < quota
                if want[i] and t:
                    grants[c].append(t)
            assert got == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
