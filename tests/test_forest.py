"""The forest against a plain tree, its grouped votes, its bounds, publishing and scoring as a stream."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.operators import model
from driftline.operators import tree as trees
from driftline.operators.tree import FIELDS, BlockBootstrap, bootstrap, grow, grow_large, unpack
from driftline.plans import training
from driftline.session import scratch_path

SF = "/root/testdata/sf0.001"


def plain_tree(x, y, w, classes, max_depth, min_leaf, depth=0):
    """Class shares by exhaustive search: {row: shares} of the rows given as (values, label, weight)."""
    total = np.bincount(y, w, classes)
    if (total > 0).sum() <= 1 or total.sum() < 2 * min_leaf or depth == max_depth:
        return lambda row: total / total.sum()
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for low, high in zip(values, values[1:]):
            left = x[:, f] <= low
            a, b = np.bincount(y[left], w[left], classes), np.bincount(y[~left], w[~left], classes)
            if min(a.sum(), b.sum()) < min_leaf:
                continue
            gain = (a ** 2).sum() / a.sum() + (b ** 2).sum() / b.sum()
            if best is None or gain > best[0] + 1e-9:
                best = gain, f, (low + high) / 2
    if best is None:
        return lambda row: total / total.sum()
    _, f, cut = best
    left = x[:, f] <= cut
    lower = plain_tree(x[left], y[left], w[left], classes, max_depth, min_leaf, depth + 1)
    upper = plain_tree(x[~left], y[~left], w[~left], classes, max_depth, min_leaf, depth + 1)
    return lambda row: lower(row) if row[f] <= cut else upper(row)


@pytest.mark.parametrize("classes, max_depth, min_leaf", [(2, None, 1), (3, None, 1), (2, 3, 1), (3, None, 7)])
def test_tree_against_exhaustive_search(classes, max_depth, min_leaf):
    rng = np.random.default_rng(classes)
    x = rng.random((120, 3))  # continuous values, so that the best cut is hardly ever tied
    y = ((x[:, 0] * 3).astype(int) + (x[:, 1] > 0.6) + (rng.random(120) > 0.9)) % classes
    w = bootstrap(120, rng)
    tree = grow(x, y, w, classes, rng, tried=3, max_depth=max_depth, min_leaf=min_leaf)
    plain = plain_tree(x[w > 0], y[w > 0], w[w > 0].astype(float), classes, max_depth, min_leaf)
    want, got = np.array([plain(row) for row in x]), tree.vote(x, classes)
    assert (np.abs(want - got).max(1) < 1e-9).mean() > 0.97  # tied cuts of small nodes may fall either way
    seen = x[w > 0]
    if max_depth is None and min_leaf == 1:
        assert (tree.vote(seen, classes).argmax(1) == y[w > 0]).all()


def test_votes_against_a_walk_row_by_row():
    """Leaves at any depth, values equal to a threshold and missing ones; only rows on their way are gathered, few levels at a time."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 12, (400, 3)).astype(float)
    x[rng.random(x.shape) < 0.1] = -np.inf
    y = ((x[:, 0] > 5) ^ (rng.random(400) > 0.8)).astype(int)
    tree = grow(x, y, bootstrap(400, rng), 2, rng, tried=2)
    other = np.vstack([x, rng.integers(-2, 15, (300, 3)).astype(float), [[np.inf] * 3]])

    def walk(row):
        at = 0
        while tree.feature[at] >= 0:
            at = tree.left[at] + (row[tree.feature[at]] > tree.threshold[at])
        return tree.shares.reshape(-1, 2)[at]

    assert (tree.vote(other, 2) == np.array([walk(row) for row in other])).all()
    leaf, _, threshold, left = tree.steps
    assert (left[leaf] == np.flatnonzero(leaf)).all() and np.isinf(threshold[leaf]).all()  # a row in a leaf stays


def test_tree_edges():
    rng = np.random.default_rng(0)
    one = np.ones(4, dtype=np.int64)
    same = grow(np.zeros((4, 2)), np.array([0, 1, 1, 1]), one, 2, rng, 1)  # nothing varies: one leaf
    assert len(same.feature) == 1 and same.vote(np.zeros((2, 2)), 2).tolist() == [[0.25, 0.75]] * 2
    none = grow(np.zeros((0, 2)), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), 1, rng, 1)
    assert len(none.feature) == 1
    varied = grow(np.array([[0.0, 1.0], [0.0, 2.0], [0.0, 3.0], [0.0, 4.0]]), np.array([0, 0, 1, 1]), one, 2, rng, 1)
    assert varied.feature[0] == 1  # the only feature that varies is found though one is tried
    missing = grow(np.array([[-np.inf], [-np.inf], [1.0], [2.0]]), np.array([0, 0, 1, 1]), one, 2, rng, 1)
    assert missing.vote(np.array([[-np.inf], [0.5], [9.0]]), 2).argmax(1).tolist() == [0, 1, 1]
    deep = grow(np.arange(64.0)[:, None], np.arange(64) % 2, np.ones(64, dtype=np.int64), 2, rng, 1)
    assert (deep.vote(np.arange(64.0)[:, None], 2).argmax(1) == np.arange(64) % 2).all()


@pytest.fixture(scope="module")
def rows(spark):
    s = training.hash_split(spark, SF)
    return s.filter("split = 'train'"), s.filter("split = 'test'")


@pytest.fixture(scope="module")
def forest(rows):
    return model.fit_forest(rows[0], training.FEATURES, "y", num_trees=12)


def test_grouped_votes_are_the_votes_of_all_trees(spark, rows, forest, monkeypatch):
    keep = [*training.KEY, "l_extendedprice"]
    whole = sorted(map(tuple, model.votes(forest, rows[1], keep).collect()))
    assert len(forest.groups()) == 1 and len(whole) == rows[1].count()
    asked = []
    read = model._group
    monkeypatch.setattr(model, "_group", lambda s, f, a, b: asked.append((a, b)) or read(s, f, a, b))
    monkeypatch.setattr(model, "GROUP_BYTES", 5 * forest.largest)
    grouped = sorted(map(tuple, model.votes(forest, rows[1], keep).collect()))
    assert asked == [(0, 5), (5, 10), (10, 12)]
    assert [r[:3] for r in grouped] == [r[:3] for r in whole]
    assert np.allclose([r[3] for r in grouped], [r[3] for r in whole], atol=1e-12)
    monkeypatch.setattr(model, "GROUP_BYTES", 1)  # a tree larger than a group still goes alone
    assert np.allclose([r[3] for r in sorted(map(tuple, model.votes(forest, rows[1], keep).collect()))], [r[3] for r in whole], atol=1e-12)


def test_forest_votes_are_the_trees_votes(spark, rows, forest):
    test = rows[1].limit(200).collect()
    x = np.array([[(float(r[f]) - m) / s for f, m, s in zip(forest.features, forest.means, forest.scales)] for r in test])
    want = np.mean([t.vote(x, 2) for t in model._group(spark, forest, 0, 12)], axis=0)
    got = model.votes(forest, spark.createDataFrame(test, rows[1].schema), training.KEY).collect()
    by_key = {}
    for r, v in zip(test, want):
        by_key.setdefault((r["l_orderkey"], r["l_linenumber"]), []).append(tuple(np.round(v, 9)))
    assert all(tuple(np.round(r["votes"], 9)) in by_key[r["l_orderkey"], r["l_linenumber"]] for r in got) and len(got) == 200


def test_forest_does_not_depend_on_the_layout(spark, rows, forest):
    again = model.fit_forest(rows[0].repartition(7, "l_tax"), training.FEATURES, "y", num_trees=12)
    a, b = (sorted(map(tuple, model.score(f, rows[1], training.KEY).collect())) for f in (forest, again))
    assert a == b


def test_forest_learns(spark):
    rng = np.random.default_rng(4)
    data = [(float(a), float(b), None if i % 50 == 0 else float(c), int(a + b > 1)) for i, (a, b, c) in enumerate(rng.random((1500, 3)))]
    d = spark.createDataFrame(data, "a double, b double, c double, y int")
    f = model.fit_forest(d.limit(1000), ["a", "b", "c"], "y")
    out = model.score(f, d, ["y"])
    assert out.filter("y = prediction").count() > 1440 and f.classes == (0, 1) and f.max_depth == 0
    assert out.filter("p_max < 0.5 or p_max > 1").count() == 0


def test_training_rows_are_bounded(spark):
    d = spark.range(5000).select(F.lit(1.0).alias("x"), (F.col("id") % 2).cast("int").alias("y"))  # equal rows draw apart
    assert model.training_rows(d, ["x"], "y", 300).num_rows == 300
    assert model.training_rows(d, ["x"], "y", 5000).num_rows == 5000
    assert model.training_rows(d.withColumn("y", F.lit(None).cast("int")), ["x"], "y", 300).num_rows == 0


def test_empty_tables(spark, rows, forest):
    none = rows[0].limit(0)
    empty = model.fit_forest(none, training.FEATURES, "y", num_trees=3)
    assert empty.classes == () and [r["prediction"] for r in model.score(empty, rows[1].limit(3), ["y"]).collect()] == [None] * 3
    assert model.score(forest, none, ["y"]).count() == 0


def test_saved_forest_scores_like_the_live_one(spark, rows, forest):
    path = scratch_path(spark, "rf")
    model.save(forest, path)
    a, b = (sorted(map(tuple, model.score(f, rows[1], training.KEY).collect())) for f in (forest, model.load(path)))
    assert a == b and all(0.5 - 1e-9 <= r[3] <= 1.0 + 1e-9 and r[2] in (0, 1) for r in a)


@pytest.mark.parametrize("name", ["rf_train_eval", "batch_score", "batch_report", "model_publish", "score_stream"])
def test_forest_queries_train_the_full_forest(spark, monkeypatch, name):
    from driftline.plans import QUERIES
    made = []

    class Enough(Exception):
        pass

    def fit(*args, **kwargs):
        import inspect
        bound = inspect.signature(real).bind(*args, **kwargs)
        bound.apply_defaults()
        made.append((bound.arguments["num_trees"], bound.arguments["max_depth"], bound.arguments["max_train_rows"]))
        raise Enough

    real = model.fit_forest
    monkeypatch.setattr(model, "fit_forest", fit)
    with pytest.raises(Enough):
        QUERIES[name](spark, SF)
    assert made == [(100, None, 100_000)]


def test_report_and_upload(spark):
    report = {r["label"]: r for r in training.evaluation(spark, SF).collect()}
    assert set(report) == {"0", "1", "accuracy", "macro avg", "weighted avg"}
    assert all(0.0 <= r[m] <= 1.0 for r in report.values() for m in ("precision", "recall", "f1_score"))
    assert report["0"]["support"] + report["1"]["support"] == report["accuracy"]["support"]
    out = training.scored_upload(spark, SF)
    assert out.count() == training.hash_split(spark, SF).filter("split = 'test'").count()
    assert {r[0] for r in out.select("label_text").distinct().collect()} <= {"Grave", "Pas Grave", None}


def test_publishing_moves_the_pointer_last(spark, forest):
    folder = scratch_path(spark, "published")
    facts = {"model_name": "m", "num_trees": 12, "max_depth": 0, "features": list(forest.features)}
    assert model.newest(spark, folder) is None
    assert model.publish_if_better(forest, 0.6, 0.5, folder, facts) and not model.publish_if_better(forest, 0.6, 0.6, folder, facts)
    model.save(forest, f"{folder}/models/2-lost")  # a publisher that was lost before its metadata row
    assert model.newest(spark, folder)["version"] == 1
    assert model.publish_if_better(forest, 0.7, 0.6, folder, facts) and model.newest(spark, folder)["version"] == 2


def test_a_batch_that_runs_again_keeps_its_model(spark, rows, forest, monkeypatch):
    from driftline.sources import delimited
    from driftline.streaming import scoring
    root = scratch_path(spark, "again")
    facts = {"model_name": "m", "num_trees": 12, "max_depth": 0, "features": list(forest.features)}
    test = rows[1].drop("split")
    model.publish_if_better(forest, 0.5, 0.0, f"{root}/published", facts)
    delimited.write_delimited(test.coalesce(1), f"{root}/landing", sep=",", mode="append")
    run = dict(landing=f"{root}/landing", schema=test.schema, published=f"{root}/published", sink=f"{root}/sink", checkpoint=f"{root}/ckpt")

    def lost(forest, batch):
        raise RuntimeError("lost")

    with pytest.raises(Exception):
        scoring.score_arrivals(spark, **run, predictions=lost)
    model.publish_if_better(forest, 0.6, 0.5, f"{root}/published", facts)
    scoring.score_arrivals(spark, **run, predictions=training.predictions)
    out = spark.read.schema(training.SCORED).parquet(f"{root}/sink/batch=*")
    assert out.count() == test.count() and {r[0] for r in out.select("model_version").distinct().collect()} == {1}
    delimited.write_delimited(test.coalesce(1), f"{root}/landing", sep=",", mode="append")
    scoring.score_arrivals(spark, **run, predictions=training.predictions)
    out = spark.read.schema(training.SCORED).parquet(f"{root}/sink/batch=*").groupBy("model_version").count().collect()
    assert {r[0]: r[1] for r in out} == {1: test.count(), 2: test.count()}


def test_every_labelled_row_is_trained_on(spark):
    """labels without a pattern can only be told by trees that have seen the row; a draw of 300 rows knows a tenth of them."""
    rng = np.random.default_rng(8)
    data = [(float(a), float(b), int(c), i) for i, (a, b, c) in enumerate(zip(rng.random(3000), rng.random(3000), rng.integers(0, 3, 3000)))]
    d = spark.createDataFrame(data, "a double, b double, y int, id int")
    f = model.fit_forest(d.withColumn("y", F.when(F.col("id") % 7 > 0, F.col("y"))), ["a", "b"], "y", num_trees=25, max_train_rows=300)
    right = {r["seen"]: r["right"] for r in model.score(f, d, ["y", "id"]).groupBy((F.col("id") % 7 > 0).alias("seen"))
             .agg(F.avg((F.col("y") == F.col("prediction")).cast("int")).alias("right")).collect()}
    assert f.classes == (0, 1, 2) and right[True] > 0.98 and right[False] < 0.5  # rows without a label are not trained on


def test_a_large_table_grows_the_same_forest_in_any_layout(spark):
    """Missing values, codes and numbers, rows that come twice."""
    rng = np.random.default_rng(9)
    data = [(float(a) if a else None, float(b) if b > 0.1 else None, float(c), int(c > 4) + int(b > 0.7))
            for a, b, c in zip(rng.integers(0, 9, 2000), rng.random(2000).round(2), rng.integers(0, 10, 2000))]
    d = spark.createDataFrame(data + data[:300], "a double, b double, c double, y int")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    one, two = (model.fit_forest(d.repartition(*p), ["a", "b", "c"], "y", num_trees=6, max_train_rows=100) for p in ((1,), (5, "b")))
    a, b = ([[getattr(t, k).tolist() for k in FIELDS] for t in model._group(spark, f, 0, 6)] for f in (one, two))
    assert a == b and len({str(t) for t in a}) == 6
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    scored = model.score(one, d, ["y"])
    assert scored.filter("y = prediction").count() > 0.9 * d.count()
    poor = d.withColumn("b", F.when(F.col("a") == 3, F.lit(float("nan"))).otherwise(F.col("b")))  # no mean: never split on
    assert all((t.feature != 1).all() for n in (100, 5000) for f in [model.fit_forest(poor, ["a", "b", "c"], "y", num_trees=2, max_train_rows=n)]
               for t in model._group(spark, f, 0, 2))


def test_a_large_table_is_streamed_to_one_task_a_tree(spark):
    d = spark.range(900).select(F.col("id").cast("double").alias("f0"), (F.col("id") % 2).cast("int").alias("y"))
    grown, _, classes = model._from_table(d, 900, (0.0,), (1.0,), 7, 1, None, 1, 42, 100)
    plan = grown._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan and grown.rdd.getNumPartitions() == 7 and classes == [0, 1]
    keys = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"]
    before = [spark.conf.get(k) for k in keys]
    with model._few_records(spark):  # a record holds thousands of rows: a reader's batch of 4,096 of them filled the heap
        assert [spark.conf.get(k) for k in keys] == [str(model.RECORDS)] * 2
        rows = grown.groupBy("tree").agg(F.sum(F.octet_length("y")).alias("n")).collect()  # a label of two is a byte
    assert {r["tree"]: r["n"] for r in rows} == {k: 900 for k in range(7)} and [spark.conf.get(k) for k in keys] == before


@pytest.mark.parametrize("classes, max_depth, min_leaf, at_once", [(2, None, 1, 9), (3, None, 1, 40), (2, 3, 1, 9), (3, None, 7, 9)])
def test_large_tree_against_exhaustive_search(monkeypatch, classes, max_depth, min_leaf, at_once):
    """Nodes split one by one, a few rows at a time, some features as codes."""
    rng = np.random.default_rng(classes)
    x = rng.random((150, 3))
    x[:5, 0] = -np.inf
    y = ((np.maximum(x[:, 0], 0) * 3).astype(int) + (x[:, 1] > 0.6) + (rng.random(150) > 0.9)) % classes
    w = bootstrap(150, rng)
    here = np.flatnonzero(w)
    known = np.unique(x[:, 1])
    monkeypatch.setattr(trees, "PIECE", 11)
    tree = grow_large([x[here, 0], np.searchsorted(known, x[here, 1]).astype(np.uint8), x[here, 2]], [None, known, None], y[here].astype(np.uint8),
                      w[here].astype(np.uint8), classes, rng, 3, max_depth, min_leaf, at_once)
    plain = plain_tree(x[here], y[here], w[here].astype(float), classes, max_depth, min_leaf)
    assert (np.abs(np.array([plain(row) for row in x]) - tree.vote(x, classes)).max(1) < 1e-9).mean() > 0.97
    if max_depth is None and min_leaf == 1:
        assert (tree.vote(x[here], classes).argmax(1) == y[here]).all()


def test_large_leaves_and_cuts_over_pieces(monkeypatch):
    rng = np.random.default_rng(0)
    one = lambda n: np.ones(n, dtype=np.uint8)
    mixed = grow_large([np.zeros(50)], [None], (np.arange(50) % 5 > 0).astype(np.uint8), one(50), 2, rng, 1, at_once=10)
    assert len(mixed.feature) == 1 and mixed.vote(np.zeros((2, 1)), 2).tolist() == [[0.2, 0.8]] * 2
    pure = grow_large([np.arange(50.0)], [None], one(50), one(50), 2, rng, 1, at_once=10)
    assert len(pure.feature) == 1 and pure.vote(np.zeros((1, 1)), 2).tolist() == [[0.0, 1.0]]
    short = grow_large([np.arange(50.0)], [None], one(50) % 2, one(50), 2, rng, 1, max_depth=0, at_once=10)
    assert len(short.feature) == 1
    monkeypatch.setattr(trees, "PIECE", 10)
    for cut in range(1, 40):  # also where two pieces meet
        x = rng.permutation(np.arange(40.0))
        tree = grow_large([x.copy()], [None], (x >= cut).astype(np.uint8), one(40), 2, rng, 1, at_once=10)
        assert tree.feature.tolist() == [0, -2, -3] and tree.threshold.tolist() == [cut - 0.5]


def test_block_draws():
    draw, again = (BlockBootstrap(1050, 100, [4, 2]) for _ in range(2))
    w = draw.weights(0, 1050)
    assert len(w) == 1050 and w.sum() == 1050 and (w != BlockBootstrap(1050, 100, [4, 3]).weights(0, 1050)).any()
    parts = [again.weights(a, b) for a, b in ((990, 1050), (0, 100), (100, 101), (101, 310), (310, 990))]
    assert (np.concatenate([*parts[1:], parts[0]]) == w).all()
    many = np.array([BlockBootstrap(1050, 100, [k]).weights(0, 1050) for k in range(300)])
    assert abs((many > 0).mean() - (1 - math.exp(-1))) < 0.005 and many.sum(1).tolist() == [1050] * 300
    assert abs(many[:, :50].sum(1).var() - 50 * (1 - 50 / 1050)) < 12  # as if drawn from all rows at once


def test_packed_trees_vote_like_whole_ones():
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 6, (300, 2)).astype(float), rng.integers(0, 3, 300)
    tree = grow(x, y, bootstrap(300, rng), 3, rng, 1)
    packed = tree.packed()
    stored = unpack({k: getattr(packed, k).astype(t).tobytes() for k, t in FIELDS.items()})
    unpacked = unpack({k: getattr(tree, k).astype(t).tobytes() for k, t in FIELDS.items()})  # as models were stored before
    assert (tree.shares.reshape(-1, 3).max(1) < 1).any() and len(packed.threshold) < len(tree.threshold)
    assert (stored.vote(x, 3) == tree.vote(x, 3)).all() and (unpacked.vote(x, 3) == tree.vote(x, 3)).all()


def test_score_stream_with_forests_of_large_tables(spark, monkeypatch):
    """both models are trained on all their rows, more than a task grows at once."""
    from driftline.plans import QUERIES
    real, seen = model.fit_forest, []
    from_table = model._from_table
    monkeypatch.setattr(model, "_from_table", lambda rows, n, *how: seen.append((n, rows.count())) or from_table(rows, n, *how))
    monkeypatch.setattr(model, "fit_forest", lambda train, features, label: real(train, features, label, num_trees=4, max_train_rows=500))
    out = {r["model_version"]: r for r in QUERIES["score_stream"](spark, SF).collect()}
    train = training.hash_split(spark, SF).filter("split = 'train'")
    known = [train.filter("l_orderkey % 2 = 0").count(), train.count()]
    assert seen == [(k, k) for k in known] and all(out[v]["as_batch"] for v in (1, 2))
