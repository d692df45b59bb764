"""Per-column bootstrap and the real + synthetic mix.

For a column with non-null values sorted as ``v_0 <= ... <= v_{n-1}``, a
carrier row draws ``i = draw(key, column, salt) mod n`` and takes ``v_i``.
Instead of numbering all values (a single-task ``row_number``) the column
is reduced to its distinct values with counts; exact running counts give
each distinct value its index range ``[lo, hi)``; the lookup of ``i`` is an
equi-join on a block number (``i div W``) plus a range filter - an exact
range join whose lookup side has at most ``#distinct + n / W`` rows.  ``W``
is capped, so no block key receives more than about ``W`` carriers even
when a column has only a few distinct values.

Values keep their types: columns of one type are unpivoted together in one
scan, and travel in a field of that type.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions.hashing import draw
from driftline.operators.sampling import sample_exact
from driftline.operators.sequence import running_sum
from driftline.session import cut_lineage

BLOCK_CAP = 4096
#: Columns with so few values are drawn in the projection, without the block join.
FEW_VALUES = 16
FEW_KINDS = ("string", "boolean", "tinyint", "smallint", "int", "bigint")
#: Text columns are cut into ranges at some of their values, taken from a bounded number of them;
#: the cuts only spread the work.
TEXT_CUTS = 64
CUT_VALUES = 4096
#: Ranges of numbers are unfolded in two steps, so no row holds a long array.
UNFOLD = 1 << 15


def unfolded(df: DataFrame, first: Column, last: Column, out: str) -> DataFrame:
    """A row for each number from ``first`` to ``last``."""
    x = df.withColumn("_from", first).withColumn("_upto", last)
    x = x.withColumn("_at", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_upto") - F.col("_from")) / UNFOLD))))
    start = F.col("_from") + F.col("_at") * UNFOLD
    return x.withColumn(out, F.explode(F.sequence(start, F.least(F.col("_upto"), start + (UNFOLD - 1))))).drop("_from", "_upto", "_at")


def _by_type(df: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    groups: dict[str, list[str]] = {}
    for c in columns:
        groups.setdefault(df.schema[c].dataType.simpleString(), []).append(c)
    return groups


def _field(kind: str) -> str:
    return "v_" + "".join(ch if ch.isalnum() else "_" for ch in kind)


def _text_chunk(counts: DataFrame) -> Column:
    """Ranges of the texts, rising with them: the number of cuts at or below the value."""
    some = [r["v"] for r in counts.select("v").distinct().orderBy(F.xxhash64("v")).limit(CUT_VALUES).collect()]
    some.sort(key=lambda v: v.encode())
    cuts = sorted({some[len(some) * k // TEXT_CUTS] for k in range(1, TEXT_CUTS)}) if some else []
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("v")))


def value_ranges(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, a field for each type, lo, hi, n, d): index range of each distinct non-null value."""
    groups = _by_type(df, columns)
    out = None
    for kind, cs in groups.items():
        pairs = ", ".join(f"'{c}', `{c}`" for c in cs)
        counts = (df.select(F.expr(f"stack({len(cs)}, {pairs}) AS (column, v)")).filter(F.col("v").isNotNull())
                  .groupBy("column", "v").agg(F.count(F.lit(1)).alias("cnt")))
        counts = cut_lineage(counts)  # the cuts, the chunk windows and the chunk totals all read it
        if kind == "string":
            r = running_sum(counts, ["column"], ["v"], ["cnt"], chunk=_text_chunk(counts))
        elif kind == "boolean":
            r = running_sum(counts, ["column"], ["v"], ["cnt"], chunk=F.col("v").cast("int"))
        else:
            r = running_sum(counts, ["column"], ["v"], ["cnt"], few_keys=True)
        r = r.select("column", *[(F.col("v") if k == kind else F.lit(None).cast(k)).alias(_field(k)) for k in groups],
                     (F.col("cnt_cum") - F.col("cnt")).alias("lo"), F.col("cnt_cum").alias("hi"))
        out = r if out is None else out.unionByName(r)
    stats = out.groupBy("column").agg(F.max("hi").alias("n"), F.count(F.lit(1)).alias("d"))
    return out.join(F.broadcast(stats), "column")  # a row for each column


def bootstrap_columns(carriers: DataFrame, source: DataFrame, key: Sequence[str],
                      columns: Sequence[str], salt: str) -> DataFrame:
    """One bootstrapped value per carrier row and column (columns drawn independently).

    A column without non-null values stays NULL.  Output: ``key`` +
    ``columns`` with the source types, a row for each carrier.  Carriers that share a key are
    numbered; the number takes part in the draw from the second one on.
    """
    key = list(key)
    groups = _by_type(source, columns)
    fields = [_field(k) for k in groups]
    # one row per distinct value: written once, read by the lookup and the size table
    ranges = cut_lineage(value_ranges(source, columns))
    # block width: about one distinct value per block, but never more than BLOCK_CAP
    # indexes, so a column with few values still spreads its carriers over n / BLOCK_CAP keys
    ranges = ranges.withColumn("W", F.greatest(F.lit(1), F.least(F.lit(BLOCK_CAP),
                                                                  F.floor(F.col("n") / F.col("d")))))
    few = _few_values(ranges, {c: k for k, cs in groups.items() for c in cs})
    many = [c for c in columns if c not in few]
    ranges = ranges.filter(~F.col("column").isin(list(few))) if few else ranges
    lookup = unfolded(ranges.select("column", *fields, "lo", "hi", "W"), F.floor(F.col("lo") / F.col("W")),
                      F.floor((F.col("hi") - 1) / F.col("W")), "block").drop("W")
    sizes = F.broadcast(ranges.select("column", "n", "W").distinct())  # a row for each column
    same = carriers.groupBy(*key).agg(F.count(F.lit(1)).alias("_same"))
    numbered = unfolded(same, F.lit(1).cast("bigint"), F.col("_same"), "_nth").drop("_same")
    again = F.when(F.col("_nth") > 1, F.col("_nth"))  # nothing for the first
    near = {c: _drawn(few[c], F.pmod(draw(*key, again, F.lit(c), F.lit(salt)), F.lit(few[c][-1][1]))) for c in few}
    if not many:
        return numbered.select(*key, *[near[c].cast(source.schema[c].dataType).alias(c) for c in columns])
    cols = F.array(*[F.lit(c) for c in many])
    car = numbered.select(*key, "_nth", F.explode(cols).alias("column")).join(sizes, "column", "left")
    car = car.withColumn("i", F.pmod(draw(*key, again, F.col("column"), F.lit(salt)), F.col("n")))
    car = car.withColumn("block", F.floor(F.col("i") / F.col("W")))
    hit = (car.join(lookup, ["column", "block"], "left")
              .filter(F.col("lo").isNull() | ((F.col("i") >= F.col("lo")) & (F.col("i") < F.col("hi")))))
    wide = (hit.groupBy(*key, "_nth").pivot("column", many)
               .agg(F.first(F.struct(*fields), ignorenulls=True)))
    own = {c: _field(k) for k, cs in groups.items() for c in cs}
    return wide.select(*key, *[near[c].cast(source.schema[c].dataType).alias(c) if c in near else F.col(c)[own[c]].alias(c) for c in columns])


def _few_values(ranges: DataFrame, kinds: dict[str, str]) -> dict[str, list[tuple]]:
    """(value, hi) in order, of the plain columns with at most ``FEW_VALUES`` distinct values; one row per value comes to the driver."""
    plain = [c for c, k in kinds.items() if k in FEW_KINDS]
    if not plain:
        return {}
    small = ranges.filter(F.col("column").isin(plain) & (F.col("d") <= FEW_VALUES)).orderBy("column", "hi").collect()
    out: dict[str, list[tuple]] = {}
    for r in small:
        out.setdefault(r["column"], []).append((r[_field(kinds[r["column"]])], r["hi"]))
    return out


def _drawn(values: list[tuple], i: Column) -> Column:
    """The value whose index range holds ``i``: a chain of comparisons, as there are few."""
    out = F.lit(values[-1][0])
    for value, hi in reversed(values[:-1]):
        out = F.when(i < hi, F.lit(value)).otherwise(out)
    return out


def synthetic_mix(df: DataFrame, key: Sequence[str], columns: Sequence[str], salt: str,
                  frac: float = 0.5) -> DataFrame:
    """Exactly ``round(n*frac)`` real rows + ``n - that`` bootstrapped rows.

    The unselected rows are the carriers of the synthetic draws, so the
    synthetic half has the required size without any generated input.
    """
    key, values = list(key), [c for c in columns if c not in key]
    # both halves read it
    marked = cut_lineage(sample_exact(df.select(*key, *values), key, frac, salt, keep_unselected=True))
    real = marked.filter("selected").drop("selected").withColumn("provenance", F.lit("real"))
    carriers = marked.filter(~F.col("selected")).select(*key)
    synth = bootstrap_columns(carriers, df, key, columns, salt).withColumn("provenance", F.lit("synthetic"))
    return real.unionByName(synth)
