"""Catalog tables, sliding rates, year ranges and model publishing on small frames."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from driftline.operators import clean, metrics, profile
from driftline.session import scratch_path
from driftline.sources import catalog
from driftline.sources.versions import Conflict, VersionedTable

T0 = dt.datetime(2024, 1, 1)


def _table(spark):
    return VersionedTable(spark, scratch_path(spark, "versions"))


def _ids(table):
    return sorted(r["id"] for r in table.read().collect())


def test_purge_drops_old_days_and_rewrites_the_edge(spark):
    rows = [(i, T0 + dt.timedelta(hours=7 * i)) for i in range(40)] + [(99, None)]
    df = spark.createDataFrame(rows, "id int, ts timestamp").withColumn("day", F.to_date("ts"))
    table = _table(spark)
    table.append_days(df, "day")
    table.append_days(df.filter("id % 2 = 0").withColumn("id", F.col("id") + 1000), "day")
    cutoff = T0 + dt.timedelta(days=3, hours=5)
    table.purge_before("ts", F.lit(cutoff))
    left = [i for i, t in rows if t is None or t >= cutoff]
    assert _ids(table) == sorted(left + [i + 1000 for i in left if i % 2 == 0])
    table.purge_before("ts", F.lit(cutoff))  # again: nothing changes
    assert _ids(table) == sorted(left + [i + 1000 for i in left if i % 2 == 0])


def test_purge_without_cutoff_or_rows(spark):
    table = _table(spark)
    assert table.purge_before("ts", F.lit(T0)).number == 0  # no version yet
    table.append_days(spark.createDataFrame([], "id int, ts timestamp, day date"), "day")
    table.purge_before("ts", F.lit(T0))
    table.purge_before("ts", F.lit(None).cast("timestamp"))
    assert table.read().count() == 0 and table.read().columns == ["id", "ts", "day"]


@pytest.mark.parametrize("lost", ["write", "commit", "rename"])
def test_a_lost_writer_leaves_either_state_whole(spark, monkeypatch, lost):
    rows = [(i, T0 + dt.timedelta(hours=i)) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, ts timestamp").withColumn("day", F.to_date("ts"))
    table = _table(spark)
    table.append_days(df, "day")
    table.set_property("forced", 0.25)
    before = _ids(table)

    class Lost(Exception):
        pass

    def gone(*args, **kwargs):
        raise Lost

    if lost == "rename":  # the draft is written, the step itself is not made
        real = table._fs

        class NoRename:
            def __getattr__(self, name):
                return gone if name == "rename" else getattr(real, name)
        table._fs = NoRename()
    else:
        monkeypatch.setattr(table, lost, gone)
    for change in (lambda: table.purge_before("ts", F.lit(T0 + dt.timedelta(hours=30))), lambda: table.replace(df.limit(3))):
        with pytest.raises(Lost):
            change()
        fresh = VersionedTable(spark, table.root)
        assert _ids(fresh) == before and fresh.manifest().properties == {"forced": 0.25}
    fresh.purge_before("ts", F.lit(T0 + dt.timedelta(hours=30)))
    assert _ids(fresh) == list(range(30, 60))
    fresh.replace(df.limit(3))
    assert len(_ids(fresh)) == 3 and not fresh.manifest().properties
    assert fresh.vacuum() == [] and len(fresh.vacuum(older_than_hours=0)) >= 2 and len(_ids(fresh)) == 3


def test_two_writers_cannot_take_one_version(spark):
    table = _table(spark)
    table.replace(spark.range(3))
    base = table.manifest()
    table.commit(base, base.folders, {"who": "first"}, base.schema)
    with pytest.raises(Conflict):
        table.commit(base, base.folders, {"who": "second"}, base.schema)
    assert table.manifest().properties == {"who": "first"}
    kept = table.manifest()
    table.replace(spark.range(9))
    assert table.read(kept).count() == 3 and table.read().count() == 9  # a reader keeps its version


def test_replace_changes_the_schema_and_estimates_fall_back(spark):
    name = catalog.table_name(spark, "t")
    catalog.replace_table(spark.range(5), name)
    assert catalog.estimated_count(spark, name) == (5, False)
    catalog.analyze(spark, name)
    assert catalog.estimated_count(spark, name) == (5, True)
    assert catalog.drop_and_replace(spark.createDataFrame([("a",)], "x string"), name).columns == ["x"]


def test_sliding_increase_against_every_window(spark):
    rng = random.Random(5)
    rows, value = [], 0
    for i in range(200):
        value = 0 if rng.random() < 0.1 else value + rng.randrange(5)
        rows.append((rng.choice("ab"), T0 + dt.timedelta(minutes=rng.randrange(3000)), i, value))
    df = spark.createDataFrame(rows, "s string, ts timestamp, i int, v int").withColumn("step", F.date_trunc("hour", "ts"))
    got = {(r["s"], r["eval_at"]): r["increase"] for r in metrics.sliding_increase(df, ["s"], ["ts", "i"], "v", "step", 3).collect()}
    want = {}
    for s in "ab":
        for h in range(0, 60):
            at = T0 + dt.timedelta(hours=h)
            vs = [v for x, t, _i, v in sorted(rows, key=lambda r: (r[1], r[2])) if x == s and at - dt.timedelta(hours=3) <= t < at]
            if len(vs) >= 2:
                want[s, at] = sum(b - a if b >= a else b for a, b in zip(vs, vs[1:]))
    assert got == want


def test_year_filters(spark):
    df = spark.createDataFrame([("2019", dt.datetime(2019, 1, 1)), ("n/a", dt.datetime(2019, 12, 31, 23, 59, 59)),
                                (None, None), ("2020", dt.datetime(2020, 1, 1))], "y string, t timestamp")
    assert df.filter(profile.in_year("t", 2019)).count() == 2
    assert df.filter(profile.year_equals("y", 2019)).count() == 1


def test_required_columns(spark):
    clean.require_columns(spark.range(1), ["id"])
    with pytest.raises(ValueError, match="a, b"):
        clean.require_columns(spark.range(1), ["id", "b", "a"])


def test_gauge_series_has_the_newest_value_of_every_step(spark):
    import __spark_entry__ as E
    sf = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{sf}/events.parquet").collect():
        step = r["ts"].replace(minute=0, second=0, microsecond=0)
        want[r["event_type"], step] = max(want.get((r["event_type"], step), (dt.datetime.min, -1, 0.0)), (r["ts"], r["event_id"], r["value"]))
    got = {(r["series"], r["step"]): (r["ts_latest"], r["value"]) for r in E.queries()["metric_series"](spark, sf).collect()}
    assert got == {k: (t, v) for k, (t, _i, v) in want.items()} and len(got) > 100


def test_range_rate_against_every_window(spark):
    """Ranges with gaps at either edge, resets and counters that start near zero, by the rule written out in a loop."""
    rng = random.Random(9)
    rows, value, t = [], 0, 0.0
    for i in range(120):
        t += rng.choice([20, 300, 5000])  # dense and sparse stretches
        value = 0 if rng.random() < 0.1 else value + rng.randrange(5)
        rows.append(("s", T0 + dt.timedelta(seconds=t), i, value))
    df = spark.createDataFrame(rows, "s string, ts timestamp, i int, v int").withColumn("step", F.date_trunc("hour", "ts"))
    got = {r["eval_at"]: (r["increase"], round(r["rate"], 9)) for r in metrics.range_rate(df, ["s"], ["ts", "i"], "v", "step", 3, 3600).collect()}
    want, carried = {}, set()
    for h in range(int(t // 3600) + 5):
        at = T0 + dt.timedelta(hours=h)
        inside = [(x.timestamp(), v) for _, x, _, v in rows if at - dt.timedelta(hours=3) <= x < at]
        if len(inside) < 2:
            continue
        (a, v0), (b, _) = inside[0], inside[-1]
        inc = sum(y - x if y >= x else y for (_, x), (_, y) in zip(inside, inside[1:]))
        gap = (b - a) / (len(inside) - 1)
        start, end = a - (at.timestamp() - 3 * 3600), at.timestamp() - b
        carried |= {("start", start < 1.1 * gap), ("end", end < 1.1 * gap)}
        start, end = (x if x < 1.1 * gap else gap / 2 for x in (start, end))
        if inc > 0 and (b - a) * v0 / inc < start:
            start = (b - a) * v0 / inc
            carried.add("zero")
        want[at] = inc, round(inc * (b - a + start + end) / (b - a) / (3 * 3600), 9)
    assert len(carried) == 5 and set(got) == set(want)
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=2e-9) for k in want)


def test_exact_pvalue_counts_paths(spark):
    from math import comb

    from driftline.operators import drift

    def share(n, m, h):
        """Paths inside the band as whole numbers."""
        row = [1 if j * n < h else 0 for j in range(m + 1)]
        row = [int(all(row[:j + 1])) for j in range(m + 1)]
        for i in range(1, n + 1):
            new = []
            for j in range(m + 1):
                new.append(0 if abs(i * m - j * n) >= h else row[j] + (new[j - 1] if j else 0))
            row = new
        return 1 - row[m] / comb(n + m, n)

    cases = [(n, m, h) for n in (1, 2, 3, 5, 8) for m in (1, 2, 4, 7, 12) for h in range(0, n * m + 1)]
    for n, m, h in cases:
        assert drift._share_of_paths(n, m, h) == pytest.approx(share(n, m, h) if h else 1.0, abs=1e-12), (n, m, h)
    assert drift._share_of_paths(120, 300, 120 * 300) == pytest.approx(2 / comb(420, 120), rel=1e-9)  # tiny shares stay exact
    big = drift._share_of_paths(3000, 3000, round(0.03 * 3000 * 3000))
    assert big == pytest.approx(0.133, abs=0.01)  # the limiting series gives 0.134
    d = spark.createDataFrame([("a", 0.5, 4, 6), ("b", 0.5, 40_000, 60_000), ("c", None, 4, 6)], "feature string, drift_score double, n_ref long, n_cur long")
    p = {r["feature"]: r["p_value"] for r in drift.with_pvalue(d).collect()}
    assert p["a"] == pytest.approx(share(4, 6, 12)) and p["b"] == 0.0 and p["c"] is None
