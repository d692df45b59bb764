"""Registry queries on a version table derived from ``part``.

One version per part: model = brand, version = part key as text, stage
from the part type, accuracy from the retail price; the best-model tag is
the accuracy for large parts, an invalid text for mid-size parts and
absent otherwise.  Run metrics (the run table) derive from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.operators import registry as reg
from driftline.plans.registry import query
from driftline.sources.tables import Tables

VERSIONS_SQL = """
v AS (
  SELECT p_brand AS model_name, CAST(p_partkey AS VARCHAR) AS model_version, p_partkey AS vnum,
         CASE p_type WHEN 'PROMO' THEN 'Production' WHEN 'STANDARD' THEN 'Staging' ELSE 'None' END AS stage,
         'run-' || CAST(p_partkey AS VARCHAR) AS run_id,
         round((p_retailprice - 900) / 100, 4) AS accuracy,
         CASE WHEN p_size > 40 THEN round((p_retailprice - 900) / 100, 4)
              WHEN p_size > 34 THEN NULL END AS tag_acc,
         p_size > 34 AS has_tag,
         TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(p_size AS INTEGER)) AS run_date
  FROM part)"""


def versions(spark, sf) -> DataFrame:
    p = Tables(spark, sf).part
    acc = F.round((F.col("p_retailprice") - 900) / 100, 4)
    tag = (F.when(F.col("p_size") > 40, acc.cast("string"))
            .when(F.col("p_size") > 34, F.lit("n/a")))
    tags = F.when(tag.isNotNull(),
                  F.create_map(F.lit("owner"), F.lit("ml-team"), F.lit(reg.BEST_TAG), tag)) \
            .otherwise(F.create_map(F.lit("owner"), F.lit("ml-team")))
    stage = (F.when(F.col("p_type") == "PROMO", "Production").when(F.col("p_type") == "STANDARD", "Staging")
              .otherwise("None"))
    return p.select(F.col("p_brand").alias("model_name"), F.col("p_partkey").cast("string").alias("model_version"),
                    stage.alias("stage"), F.concat(F.lit("run-"), F.col("p_partkey").cast("string")).alias("run_id"),
                    tags.alias("tags"))


def runs(spark, sf) -> DataFrame:
    p = Tables(spark, sf).part
    acc = F.round((F.col("p_retailprice") - 900) / 100, 4)
    prec, rec = F.round(acc * 0.9, 4), F.round(acc * 0.8, 4)
    return p.select(F.concat(F.lit("run-"), F.col("p_partkey").cast("string")).alias("run_id"),
                    (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(days=F.col("p_size")))
                    .alias("run_date"),
                    acc.alias("accuracy"), prec.alias("precision_macro_avg"), rec.alias("recall_macro_avg"),
                    F.round(F.try_divide(2 * prec * rec, prec + rec), 6).alias("f1_macro_avg"))


@query("registry_best", f"""
WITH {VERSIONS_SQL},
t AS (SELECT * FROM v WHERE tag_acc IS NOT NULL)
SELECT model_name, arg_max(model_version, (tag_acc, vnum)) AS best_version, max(tag_acc) AS best_accuracy
FROM t GROUP BY model_name
""")
def registry_best(spark, sf):
    return reg.best_version(versions(spark, sf))


@query("registry_latest", f"""
WITH {VERSIONS_SQL},
l AS (SELECT model_name, arg_max(model_version, (stage = 'Production', vnum)) AS model_version FROM v GROUP BY 1)
SELECT l.model_name, l.model_version, v.stage, v.run_date, v.accuracy,
       round(v.accuracy * 0.9, 4) AS precision_macro_avg, round(v.accuracy * 0.8, 4) AS recall_macro_avg,
       round(2 * round(v.accuracy * 0.9, 4) * round(v.accuracy * 0.8, 4)
             / NULLIF(round(v.accuracy * 0.9, 4) + round(v.accuracy * 0.8, 4), 0), 6) AS f1_macro_avg
FROM l JOIN v USING (model_name, model_version)
""")
def registry_latest(spark, sf):
    lv = reg.latest_version(versions(spark, sf)).select("model_name", "model_version", "stage", "run_id")
    # Run <-> version lookup (one selected version per model)
    return lv.join(runs(spark, sf), "run_id").drop("run_id")


@query("registry_promote", f"""
WITH {VERSIONS_SQL},
cand AS (SELECT model_name, arg_max(model_version, vnum) AS cv, arg_max(accuracy, vnum) AS ca FROM v GROUP BY 1),
cur AS (SELECT v.model_name, max(tag_acc) AS best FROM v JOIN cand USING (model_name)
        WHERE v.model_version <> cand.cv AND tag_acc IS NOT NULL GROUP BY 1),
d AS (SELECT cand.* FROM cand LEFT JOIN cur USING (model_name) WHERE ca > CASE WHEN cur.best IS NULL THEN 0.0 ELSE cur.best END)
SELECT v.model_name, v.model_version,
       CASE WHEN v.model_version = d.cv THEN 'Production' ELSE v.stage END AS stage,
       CASE WHEN v.model_version = d.cv THEN d.ca WHEN d.cv IS NOT NULL THEN NULL ELSE v.tag_acc END AS best_tag,
       CASE WHEN d.cv IS NULL AND v.has_tag AND v.tag_acc IS NULL THEN true ELSE false END AS invalid_tag,
       COALESCE(v.model_version = d.cv, false) AS promoted
FROM v LEFT JOIN d USING (model_name)
""")
def registry_promote(spark, sf):
    v = versions(spark, sf)
    r = runs(spark, sf)
    newest = (v.groupBy("model_name")
               .agg(F.max_by("model_version", reg.version_int()).alias("model_version")))
    cands = newest.join(v.select("model_name", "model_version", "run_id"), ["model_name", "model_version"]) \
                  .join(r.select("run_id", "accuracy"), "run_id").drop("run_id")
    out = reg.promote(v, cands)
    tag = F.col("tags")[reg.BEST_TAG]
    return out.select("model_name", "model_version", "stage", tag.try_cast("double").alias("best_tag"),
                      (tag.isNotNull() & tag.try_cast("double").isNull()).alias("invalid_tag"), "promoted")


@query("registry_untag", f"""
WITH {VERSIONS_SQL}
SELECT model_name, model_version, 1 AS n_tags, false AS has_best FROM v
""")
def registry_untag(spark, sf):
    u = reg.untag(versions(spark, sf))
    return u.select("model_name", "model_version", F.size("tags").alias("n_tags"),
                    F.map_contains_key("tags", reg.BEST_TAG).alias("has_best"))
