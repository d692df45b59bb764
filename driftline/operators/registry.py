"""Model-version registry operators on a table ``(model_name, model_version, stage, run_id, tags MAP)``.

Versions are text; every ordering casts them to integers (so '99' < '746').
Selections are ``max_by`` aggregates per model (partial aggregation, no
sort); rewrites of the table are column expressions over one join with
the per-model decision (one row per model).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The tag that marks the best version and the serving stage.
BEST_TAG = "best_model"
PRODUCTION = "Production"


def version_int(col: str = "model_version") -> Column:
    """integer value of a text version (NULL when not a number)."""
    return F.col(col).try_cast("int")


def tag_accuracy(tags: str = "tags") -> Column:
    """M7: numeric value of the best-model tag; invalid text -> NULL (skipped)."""
    return F.col(tags)[BEST_TAG].try_cast("double")


def best_version(versions: DataFrame, model: str = "model_name") -> DataFrame:
    """M7/L4: per model, the version with the highest tag accuracy (ties: higher version)."""
    tagged = versions.filter(tag_accuracy().isNotNull())
    order = F.struct(tag_accuracy().alias("a"), version_int().alias("v"))
    pick = F.max_by(F.struct(F.col("model_version"), tag_accuracy().alias("acc")), order)
    return tagged.groupBy(model).agg(pick.alias("_b")).select(
        model, F.col("_b.model_version").alias("best_version"), F.col("_b.acc").alias("best_accuracy"))


def latest_version(versions: DataFrame, preferred_stage: str = PRODUCTION,
                   model: str = "model_name") -> DataFrame:
    """The highest version in the preferred stage, else the highest of any stage."""
    order = F.struct((F.col("stage") == preferred_stage).alias("s"), version_int().alias("v"))
    pick = F.max_by(F.struct(*[F.col(c) for c in versions.columns if c != model]), order)
    return versions.groupBy(model).agg(pick.alias("_l")).select(model, "_l.*")


def untag(versions: DataFrame, tag: str = BEST_TAG) -> DataFrame:
    """Remove one tag from every version."""
    return versions.withColumn("tags", F.map_filter("tags", lambda k, v: k != F.lit(tag)))


def promote(versions: DataFrame, candidates: DataFrame, model: str = "model_name") -> DataFrame:
    """M8: promote each model's candidate iff its accuracy beats the current best strictly (0.0 without one).

    ``candidates``: ``(model, model_version, accuracy)``, one row per model.
    A promoted candidate receives the tag (its accuracy as text) and the
    serving stage; the tag is removed from every other version of that
    model.  Models without a promotion keep their versions unchanged.
    """
    others = versions.join(candidates.select(model, F.col("model_version").alias("_cv")), model, "left") \
                     .filter(F.col("_cv").isNull() | (F.col("model_version") != F.col("_cv")))
    current = best_version(others.drop("_cv"), model)
    decision = (candidates.join(current, model, "left")
                .select(model, F.col("model_version").alias("_pv"), F.col("accuracy").alias("_pa"),
                        (F.col("accuracy") > F.coalesce("best_accuracy", F.lit(0.0)))
                        .alias("_promote"))
                .filter("_promote"))
    v = versions.join(decision, model, "left")
    promoted = F.col("_promote").isNotNull()
    is_cand = promoted & (F.col("model_version") == F.col("_pv"))
    tags = (F.when(is_cand, F.map_concat(F.map_filter("tags", lambda k, x: k != F.lit(BEST_TAG)),
                                         F.create_map(F.lit(BEST_TAG), F.col("_pa").cast("string"))))
             .when(promoted, F.map_filter("tags", lambda k, x: k != F.lit(BEST_TAG)))
             .otherwise(F.col("tags")))
    stage = F.when(is_cand, F.lit(PRODUCTION)).otherwise(F.col("stage"))
    return v.withColumns({"tags": tags, "stage": stage, "promoted": is_cand}).drop("_pv", "_pa", "_promote")
