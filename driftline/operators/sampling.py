"""Exact-size, reproducible sampling, splitting and per-column bootstrap.

Randomness comes from :func:`driftline.functions.hashing.draw`, so every
engine draws the same numbers and reruns (or re-executed tasks after an
executor loss) give the same rows.

Exact "k smallest draws per group" without a global sort
(:func:`mark_smallest`): draws are bucketed by their top ``bits`` bits;
the bucket-count table (at most ``2^bits`` rows per group) gives each
group's boundary bucket and how many of its rows are still needed; only
the rows of that one bucket are ranked, equal ones counted first.  Every other row is decided by a
comparison, so no task ever holds a whole group.

The counts and the ranks read the draw, the ties and the groups only and
leave one row per group: the last row taken.  The whole rows are then read
once, compared with that row and flagged in place, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.hashing import DRAW_BITS, draw, draw_fast
from driftline.session import cut_lineage

#: Groups whose boundaries are broadcast; with more, they are joined by a shuffle.
FEW_GROUPS = 10_000
BUCKET_BITS = 20

KRule = Callable[[Column], Column]


def mark_smallest(df: DataFrame, draw_col: str, k: KRule | DataFrame, groups: Sequence[str] = (),
                  tiebreak: Sequence[str] = (), out: str = "selected", bits: int = BUCKET_BITS) -> DataFrame:
    """Flag the ``k`` rows with the smallest ``(draw, tiebreak)`` per group.

    ``k`` is either a rule ``n -> k`` applied to each group's size, or a
    frame ``(groups..., k)`` with one row per group.
    """
    groups = list(groups) or ["_g"]
    x = df if "_g" not in groups else df.withColumn("_g", F.lit(0))
    x = x.withColumn("_row", F.struct(draw_col, *tiebreak))
    narrow = x.select(*groups, "_row", F.shiftright(F.col(draw_col), DRAW_BITS - bits).alias("_bucket"))
    bc = narrow.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_bn"))
    bc = bc.withColumn("_cum", F.sum("_bn").over(
        Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)))
    if isinstance(k, DataFrame):
        bc = bc.join(k.select(*groups, F.col("k").cast("bigint").alias("_k")), groups, "left")
    else:
        bc = bc.withColumn("_k", k(F.sum("_bn").over(Window.partitionBy(*groups))).cast("bigint"))
    # boundary bucket: the first bucket whose cumulative count reaches k
    bnd = (bc.filter((F.col("_cum") >= F.col("_k")) & (F.col("_k") > 0))
             .groupBy(*groups)
             .agg(F.min_by(F.struct(F.col("_bucket").alias("b"),
                                    (F.col("_k") - F.col("_cum") + F.col("_bn")).alias("r")),
                           F.col("_bucket")).alias("_x"))
             .select(*groups, F.col("_x.b").alias("_bucket"), F.col("_x.r").alias("_r")))
    bnd = cut_lineage(bnd)  # a row for each group
    few = bnd.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS
    # the last row taken, how many rows equal it and how many of those are taken
    near = (narrow.join(F.broadcast(bnd) if few else bnd, [*groups, "_bucket"])
                  .groupBy(*groups, "_row").agg(F.count(F.lit(1)).alias("_same"), F.first("_r").alias("_r")))
    upto = F.sum("_same").over(Window.partitionBy(*groups).orderBy("_row").rowsBetween(Window.unboundedPreceding, 0))
    last = (near.withColumn("_upto", upto).filter((F.col("_upto") >= F.col("_r")) & (F.col("_upto") - F.col("_same") < F.col("_r")))
                .select(*groups, F.col("_row").alias("_last"), (F.col("_same") - F.col("_upto") + F.col("_r")).alias("_take"), "_same"))
    last = cut_lineage(last)
    torn = not last.filter(F.col("_take") < F.col("_same")).isEmpty()
    if groups == ["_g"]:
        edge = last.select(F.struct("_last", "_take", "_same")).scalar()
        x = x.withColumns({c: edge[c] for c in ("_last", "_take", "_same")})
    else:
        x = x.join(F.broadcast(last) if few else last, groups, "left")
    x = x.withColumn(out, F.coalesce(F.col("_row") <= F.col("_last"), F.lit(False)))
    if torn:  # only some of the rows that equal the last one are taken
        at = F.coalesce((F.col("_row") == F.col("_last")) & (F.col("_take") < F.col("_same")), F.lit(False))
        nth = F.row_number().over(Window.partitionBy(*groups).orderBy("_row"))
        x = x.filter(~at).unionByName(x.filter(at).withColumn(out, nth <= F.col("_take")))
    return x.drop("_row", "_last", "_take", "_same", *(["_g"] if "_g" in groups else []))


def with_draw(df: DataFrame, key: Sequence[str], salt: str, name: str = "_draw",
              engine_neutral: bool = True) -> DataFrame:
    """Add the row's draw: md5-based (any SQL engine can recompute it) or, when
    ``engine_neutral`` is off, the cheaper typed ``xxhash64`` draw."""
    fn = draw if engine_neutral else draw_fast
    return df.withColumn(name, fn(*key, F.lit(salt)))


def sample_exact(df: DataFrame, key: Sequence[str], frac: float, salt: str,
                 keep_unselected: bool = False) -> DataFrame:
    """Exactly ``round_half_even(n * frac)`` rows without replacement."""
    x = with_draw(df, key, salt)
    marked = mark_smallest(x, "_draw", lambda n: F.bround(n * F.lit(frac)), tiebreak=list(key))
    if keep_unselected:
        return marked.drop("_draw")
    return marked.filter("selected").drop("selected", "_draw")


def split_random(df: DataFrame, key: Sequence[str], test_size: float, salt: str,
                 out: str = "split", engine_neutral: bool = True) -> DataFrame:
    """``ceil(test_size * n)`` rows labelled 'test', the rest 'train'."""
    x = with_draw(df, key, salt, engine_neutral=engine_neutral)
    marked = mark_smallest(x, "_draw", lambda n: F.ceil(n * F.lit(test_size)), tiebreak=list(key))
    return (marked.withColumn(out, F.when(F.col("selected"), "test").otherwise("train"))
                  .drop("selected", "_draw"))


def stratified_allocation(df: DataFrame, label: str, test_size: float) -> DataFrame:
    """R6 allocation: per-class test counts summing to ``ceil(test_size * n)``.

    ``floor(n_c * n_test / n)`` per class, then one more for the classes
    with the largest remainders (ties: smaller class value first).  Runs on
    the class-count table (one row per class).
    """
    cc = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    wall = Window.partitionBy()
    cc = cc.withColumn("_n", F.sum("n_c").over(wall))
    cc = cc.withColumn("_nt", F.ceil(F.col("_n") * F.lit(test_size)))
    cc = cc.withColumn("_base", F.floor(F.col("n_c") * F.col("_nt") / F.col("_n")))
    cc = cc.withColumn("_rem", F.col("n_c") * F.col("_nt") - F.col("_base") * F.col("_n"))
    cc = cc.withColumn("_left", F.col("_nt") - F.sum("_base").over(wall))
    cc = cc.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("_rem").desc(), F.col(label))))
    return cc.select(label, "n_c", (F.col("_base") + F.when(F.col("_rank") <= F.col("_left"), 1)
                                    .otherwise(0)).cast("bigint").alias("k"))


def split_stratified(df: DataFrame, key: Sequence[str], label: str, test_size: float, salt: str,
                     out: str = "split") -> DataFrame:
    """Stratified split with the exact per-class sizes of :func:`stratified_allocation`."""
    alloc = stratified_allocation(df, label, test_size)
    x = with_draw(df, key, salt)
    marked = mark_smallest(x, "_draw", alloc, groups=[label], tiebreak=list(key))
    return (marked.withColumn(out, F.when(F.col("selected"), "test").otherwise("train"))
                  .drop("selected", "_draw"))


def sample_n(df: DataFrame, key: Sequence[str], n: int, salt: str) -> DataFrame:
    """Fixed-size sample - the ``n`` smallest draws (all rows when fewer).

    Distributed top-k: each partition keeps ``n`` rows before the merge.
    """
    return with_draw(df, key, salt).orderBy("_draw", *key).limit(n).drop("_draw")
