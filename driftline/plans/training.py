"""Random forest on lineitem: training and evaluation, batch scoring, report files, publishing, scoring as a stream.

Features: quantity, price, discount, tax, line number; target: return flag 'R' (1) vs the rest (0). A fifth of the
keys, told by digest so that SQL can tell them too, are test rows. SQL cannot grow the trees: the oracles state
which rows are scored or quarantined, the supports, and which checks of the predictions must hold; the unit tests
hold the forest itself against a plain one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions.labels import severity_label
from driftline.operators import clean, evaluate, model
from driftline.plans.registry import query
from driftline.session import scratch_path
from driftline.sources import delimited
from driftline.sources.tables import Tables
from driftline.streaming.scoring import score_arrivals

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
KEY = ["l_orderkey", "l_linenumber"]
# The scoring-time domain of the coded inputs.
REPORT_DOMAIN = {"l_linenumber": list(range(1, 8)), "l_discount": (0.0, 0.1), "l_tax": (0.0, 0.07),
                 "l_quantity": (1.0, 50.0), "l_extendedprice": (0.0, 1e6)}


def labelled(spark, sf) -> DataFrame:
    li = Tables(spark, sf).lineitem
    return li.select(*KEY, *[F.col(c).cast("double").alias(c) if c != "l_linenumber" else F.col(c)
                             for c in FEATURES[:-1]],
                     (F.col("l_returnflag") == "R").cast("int").alias("y"))


def hash_split(spark, sf) -> DataFrame:
    """Labelled rows, a fifth of the keys (by digest, so that SQL can tell them too) marked as test rows."""
    digest = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in KEY]))
    return labelled(spark, sf).withColumn("split", F.when(F.substring(digest, 1, 2) < "33", "test").otherwise("train"))


def evaluation(spark, sf) -> DataFrame:
    """M3 + A11: fit on the train rows, report on the test rows."""
    s = hash_split(spark, sf)
    m = model.fit_forest(s.filter(F.col("split") == "train"), FEATURES, "y")
    scored = model.score(m, s.filter(F.col("split") == "test"), ["y"])
    return evaluate.classification_report(scored, "y", "prediction")


_TEST_SQL = """
t AS (SELECT l_orderkey, l_linenumber, CAST(l_returnflag = 'R' AS INTEGER) AS y,
             coalesce(l_linenumber BETWEEN 1 AND 7 AND l_discount BETWEEN 0 AND 0.1::DOUBLE AND l_tax BETWEEN 0 AND 0.07::DOUBLE
                      AND l_quantity BETWEEN 1 AND 50 AND l_extendedprice BETWEEN 0 AND 1000000, FALSE) AS ok
      FROM lineitem WHERE substr(md5(concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR))), 1, 2) < '33')"""

@query("rf_train_eval", f"""
WITH {_TEST_SQL}, n AS (SELECT count(*) FILTER (y = 0) AS n0, count(*) FILTER (y = 1) AS n1, count(*) AS n FROM t),
r(label, support) AS (SELECT '0', n0 FROM n UNION ALL SELECT '1', n1 FROM n UNION ALL SELECT 'accuracy', n FROM n
                      UNION ALL SELECT 'macro avg', n FROM n UNION ALL SELECT 'weighted avg', n FROM n)
SELECT label, CAST(support AS DOUBLE) AS support, TRUE AS in_range, TRUE AS f1_agrees, TRUE AS recall_agrees FROM r
""")
def rf_train_eval(spark, sf):
    """M3 + A11: the report's supports, and what must hold of its figures: between 0 and 1, F1 the harmonic mean of a
    class's precision and recall, weighted recall the accuracy."""
    r = evaluation(spark, sf)
    p, rec, f1 = (F.col(c) for c in evaluate.REPORT_METRICS[:3])
    in_range = p.between(0.0, 1.0) & rec.between(0.0, 1.0) & f1.between(0.0, 1.0)
    mean = F.when(p + rec == 0, F.lit(0.0)).otherwise(2 * p * rec / (p + rec))
    f1_agrees = ~F.col("label").isin("0", "1") | (F.abs(f1 - mean) < 1e-5)
    accuracy = F.max(F.when(F.col("label") == "accuracy", p)).over(Window.partitionBy())  # five rows
    return r.select("label", "support", in_range.alias("in_range"), f1_agrees.alias("f1_agrees"),
                    ((F.col("label") != "weighted avg") | (F.abs(rec - accuracy) < 1e-5)).alias("recall_agrees"))


def scored_upload(spark, sf) -> DataFrame:
    """S5 + M5: uploaded CSV -> validate -> saved forest -> predictions with probability and label text.

    Rows outside the scoring domain are quarantined (kept, unscored, with their violations) instead of failing the
    whole batch.
    """
    s = hash_split(spark, sf)
    live = model.load(model.save(model.fit_forest(s.filter(F.col("split") == "train"), FEATURES, "y"), scratch_path(spark, "rf_model")).path)
    # The rows to score arrive as an uploaded comma-separated file with a header
    landing = scratch_path(spark, "score_upload")
    upload = s.filter(F.col("split") == "test").drop("split")
    delimited.write_delimited(upload, landing, sep=",")
    return predictions(live, delimited.read_delimited(spark, landing, upload.schema, sep=","))


def predictions(forest: model.Forest, received: DataFrame) -> DataFrame:
    """The received rows' keys and label with prediction, p_max and label_text; null where a row is out of its domain."""
    test = clean.validate(received, REPORT_DOMAIN)
    scored = model.score(forest, test.filter(F.size("violations") == 0), [*KEY, "y"]).withColumn("label_text", severity_label("prediction"))
    bad = (test.filter(F.size("violations") > 0)
               .select(*KEY, "y", F.lit(None).cast("int").alias("prediction"), F.lit(None).cast("double").alias("p_max"),
                       F.lit(None).cast("string").alias("label_text")))
    return scored.unionByName(bad)


@query("batch_score", f"""
WITH {_TEST_SQL}
SELECT l_orderkey, l_linenumber, y, ok AS scored, TRUE AS valid FROM t
""")
def batch_score(spark, sf):
    """S5 + M5 + F8 + F20: which rows of the upload are scored, and whether what they got is a class, its text and its share."""
    out = scored_upload(spark, sf)
    text = F.when(F.col("prediction") == 1, "Grave").otherwise("Pas Grave")
    whole = F.col("prediction").isin(0, 1) & _share("p_max") & (F.col("label_text") == text)
    none = F.col("p_max").isNull() & F.col("label_text").isNull()
    return out.select(*KEY, "y", F.col("prediction").isNotNull().alias("scored"), F.when(F.col("prediction").isNotNull(), whole).otherwise(none).alias("valid"))


def _share(name: str):
    """The share of the winner of two classes, up to rounding."""
    return F.col(name).between(0.5 - 1e-9, 1.0 + 1e-9)


PREDICTION_FILE = T.StructType([T.StructField("l_orderkey", T.LongType()), T.StructField("l_linenumber", T.IntegerType()),
                                T.StructField("y", T.IntegerType()), T.StructField("prediction", T.IntegerType()),
                                T.StructField("p_max", T.DoubleType())])


@query("batch_report", f"""
WITH {_TEST_SQL}
SELECT COUNT(*) FILTER (ok) AS n_scored, COUNT(*) FILTER (NOT ok) AS n_quarantined,
       COUNT(*) FILTER (ok AND y = 0) AS support_0, COUNT(*) FILTER (ok AND y = 1) AS support_1, CAST(5 AS BIGINT) AS report_rows,
       TRUE AS predictions_valid, TRUE AS metrics_valid, TRUE AS accuracy_agrees
FROM t
""")
def batch_report(spark, sf):
    """M5 + K9: predictions and report written as files; the facts below are taken from the files read back."""
    s = hash_split(spark, sf)
    m = model.fit_forest(s.filter(F.col("split") == "train"), FEATURES, "y")
    test = clean.validate(s.filter(F.col("split") == "test"), REPORT_DOMAIN)
    folder = scratch_path(spark, "batch_report")
    scored = model.score(m, test.filter(F.size("violations") == 0), [*KEY, "y"])
    delimited.write_delimited(scored, f"{folder}/y_pred", sep=",")
    test.filter(F.size("violations") > 0).write.json(f"{folder}/quarantine")
    predictions = delimited.read_delimited(spark, f"{folder}/y_pred", PREDICTION_FILE, sep=",")
    report = evaluate.classification_report(predictions, "y", "prediction")
    delimited.write_delimited(report, f"{folder}/classification_report", sep=",")
    report = delimited.read_delimited(spark, f"{folder}/classification_report", report.schema, sep=",")
    valid = F.col("prediction").isin(0, 1) & _share("p_max")
    counts = predictions.agg(
        F.count(F.lit(1)).alias("n_scored"), F.count_if(F.col("y") == 0).alias("support_0"), F.count_if(F.col("y") == 1).alias("support_1"),
        F.coalesce(F.bool_and(valid), F.lit(True)).alias("predictions_valid"),
        F.coalesce(F.avg((F.col("y") == F.col("prediction")).cast("double")), F.lit(0.0)).alias("_accuracy"))
    figures = [F.col(c).between(0.0, 1.0) for c in evaluate.REPORT_METRICS[:3]]
    checks = report.agg(F.count(F.lit(1)).alias("report_rows"), F.bool_and(figures[0] & figures[1] & figures[2]).alias("metrics_valid"),
                        F.max(F.when(F.col("label") == "accuracy", F.col("precision"))).alias("_reported"))
    bad = spark.read.schema(test.schema).json(f"{folder}/quarantine").agg(F.count(F.lit(1)).alias("n_quarantined"))
    c, r, q = counts.first(), checks.first(), bad.first()  # one row each
    return spark.createDataFrame(
        [(c["n_scored"], q["n_quarantined"], c["support_0"], c["support_1"], r["report_rows"], c["predictions_valid"],
          r["metrics_valid"], abs(c["_accuracy"] - r["_reported"]) < 1e-6)],
        "n_scored long, n_quarantined long, support_0 long, support_1 long, report_rows long, predictions_valid boolean, "
        "metrics_valid boolean, accuracy_agrees boolean")


@query("model_publish", f"""
WITH {_TEST_SQL}, n AS (SELECT COUNT(*) AS n_test FROM t)
SELECT 1 AS attempt, TRUE AS published, CAST(1 AS BIGINT) AS n_metadata, TRUE AS same_model, n_test FROM n
UNION ALL SELECT 2, FALSE, CAST(1 AS BIGINT), TRUE, n_test FROM n
""")
def model_publish(spark, sf):
    """K10 + M8: the first model beats 0.0 and is saved with its metadata; an equal one is not."""
    s = hash_split(spark, sf)
    m = model.fit_forest(s.filter(F.col("split") == "train"), FEATURES, "y")
    test = s.filter(F.col("split") == "test")
    folder = scratch_path(spark, "model_publish")
    facts = {"model_name": "forest", "num_trees": m.num_trees, "max_depth": m.max_depth, "features": FEATURES}
    acc = evaluate.accuracy(model.score(m, test, ["y"]), "y", "prediction").first()["accuracy"] or 0.0
    best, rows = 0.0, []
    for attempt in (1, 2):
        published = model.publish_if_better(m, acc, best, folder, facts)
        best = acc if published else best
        held = spark.read.schema(model.METADATA).json(f"{folder}/metadata")
        live = model.score(model.load(model.newest(spark, folder)["path"]), test, ["y"])
        again = evaluate.accuracy(live, "y", "prediction").first()["accuracy"]
        rows.append((attempt, published, held.count(), again == acc, live.count()))
    return spark.createDataFrame(rows, "attempt int, published boolean, n_metadata long, same_model boolean, n_test long")


SCORED = T.StructType([*[f for f in PREDICTION_FILE.fields], T.StructField("label_text", T.StringType()), T.StructField("model_version", T.IntegerType())])


def _same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows equally often."""
    counted = a.withColumn("_n", F.lit(1)).unionByName(b.withColumn("_n", F.lit(-1))).groupBy(*a.columns).agg(F.sum("_n").alias("_n"))
    return counted.filter(F.col("_n") != 0).limit(1).count() == 0


@query("score_stream", f"""
WITH {_TEST_SQL}
SELECT CASE WHEN l_orderkey % 2 = 0 THEN 1 ELSE 2 END AS model_version, COUNT(*) FILTER (ok) AS n_scored, COUNT(*) FILTER (NOT ok) AS n_quarantined,
       TRUE AS as_batch
FROM t GROUP BY 1
""")
def score_stream(spark, sf):
    """M5 + S5 as a stream: files that land before and after a model is published, each scored by the model of its time.

    The first model is trained on half of the train rows, the second on all; ``as_batch`` holds a version's rows
    against the batch form with that model.
    """
    s = hash_split(spark, sf)
    train, test = s.filter(F.col("split") == "train"), s.filter(F.col("split") == "test").drop("split")
    root = scratch_path(spark, "score_stream")
    landing, published, sink, checkpoint = (f"{root}/{d}" for d in ("landing", "published", "scored", "checkpoint"))
    facts = {"model_name": "forest", "num_trees": 100, "max_depth": 0, "features": FEATURES}
    rows = []
    for version, known in ((1, train.filter(F.col("l_orderkey") % 2 == 0)), (2, train)):
        forest = model.fit_forest(known, FEATURES, "y")
        model.publish_if_better(forest, version / 2, (version - 1) / 2, published, facts)
        part = test.filter(F.col("l_orderkey") % 2 == version - 1)
        # several files a phase, one micro-batch each
        delimited.write_delimited(part.repartition(3, *KEY), landing, sep=",", mode="append")
        score_arrivals(spark, landing, test.schema, published, sink, checkpoint, predictions, max_files=1, name=f"score_stream_{root[-8:]}")
        got = spark.read.schema(SCORED).parquet(f"{sink}/batch=*").filter(F.col("model_version") == version)
        want = predictions(forest, part).withColumn("model_version", F.lit(version))
        n = got.agg(F.count("prediction").alias("scored"), F.count(F.lit(1)).alias("all")).first()
        rows.append((version, n["scored"], n["all"] - n["scored"], _same_rows(got, want)))
    return spark.createDataFrame([r for r in rows if r[1] + r[2]], "model_version int, n_scored long, n_quarantined long, as_batch boolean")
