"""Mix sources to target weights by weighted fair queueing.

Each source sends its documents in a shuffled order, again and again up to ``repeats`` times. A document's
virtual finish time is the number of words its source has sent up to and with it, divided by the source's
target. Documents are taken in the order of finish time, over all sources, until the next one would exceed
the budget. As every source moves through virtual time at the rate of its target, the cut leaves each
source within about one document of its target.

No window covers a whole source or the whole corpus: the shuffled order is cut into chunks of the draw,
whose totals give each chunk its start; finish times fall into equal buckets of virtual time, whose totals
tell which bucket holds the cut, and only that bucket is put in exact order.

Defined cases: null and blank texts have size 0 and are never taken; a null source is a source of its own,
ranked last; a null id draws by its text; rows of one source with the same id and size follow each other in
the order and are counted before they are ordered, so such a group is neither taken as a whole nor held by
one task; equal finish times go by source rank, draw, size and pass; an empty table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.hashing import DRAW_BITS, draw
from driftline.llm.common import fresh, join_checked, named, words
from driftline.session import cut_lineage

WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2
SALT = "mix"

#: Documents per chunk of a source's order, and per bucket of virtual time; at most 2^MAX_BITS of either.
CHUNK_ROWS = 512
MAX_BITS = 16
#: Rows of a group of equal rows that one task writes out.
REPEAT_ROWS = 4096


@dataclass
class Mix:
    """``documents``: id, source, size, draw, target, source_size, copies. ``cuts``: how far each source is taken."""

    documents: DataFrame
    cuts: DataFrame


def size_of(text: Column) -> Column:
    return F.size(words(text)).cast("bigint")


def draw_of(doc_id: Column, text: Column, salt: str = SALT) -> Column:
    """A document's place in the shuffled order of its source: 60 bits from its id, or from its text without one."""
    by_text = F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return draw(F.coalesce(doc_id.cast("string"), by_text), F.lit(salt))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
            repeats: int = REPEATS) -> DataFrame:
    """Words to take of each source: ``share`` of all words by weight, none above ``repeats`` times its size.

    ``sizes`` has one row per source (src, size). Sources reach their ceiling in the order of ceiling over
    weight; with the first k at their ceiling the rest share what is left, and k is the first for which
    nobody is above. One window over the sources decides it, without rounds.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("src").asc_nulls_last())))
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") - 1) % len(weights))
    order = Window.orderBy("ratio", "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    x = (ranked.withColumn("weight", weight)
         .withColumn("ceiling", (F.col("size") * repeats).cast("double"))
         .withColumn("ratio", F.col("ceiling") / F.col("weight"))
         .withColumn("total", F.sum("size").over(Window.partitionBy()))
         .withColumn("level", (F.lit(share) * F.col("total") - F.coalesce(F.sum("ceiling").over(before), F.lit(0.0)))
                     / F.sum("weight").over(after)))
    # the first source that is below its ceiling at the level of its turn sets the level of all after it
    level = F.min(F.when(F.col("level") < F.col("ratio"), F.struct("ratio", "rank", "level"))).over(Window.partitionBy())
    return x.withColumn("set", level).select(
        "src", "rank", F.col("size").alias("source_size"), "total",
        F.least(F.col("ceiling"), F.coalesce(F.col("set.level") * F.col("weight"), F.col("ceiling"))).alias("target"))


def mix(docs: DataFrame, *, doc_id: str = "doc_id", source: str = "source", text: str = "text",
        weights: Sequence[float] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, salt: str = SALT) -> Mix:
    """Decide how many copies of each document the mix takes."""
    slim = (docs.select(named(doc_id).alias("doc_id"), named(source).alias("src"), size_of(named(text)).alias("size"),
                        draw_of(named(doc_id), named(text), salt).alias("draw"))
            .groupBy("doc_id", "src", "size", "draw").agg(F.count(F.lit(1)).alias("rows")))
    slim = cut_lineage(slim)
    counted = slim.agg(F.count(F.lit(1)).alias("groups"), F.max("rows").alias("most"), F.sum("rows").alias("rows")).first()
    bits = min(MAX_BITS, max(4, ((counted["rows"] or 0) // CHUNK_ROWS).bit_length()))
    chunk = F.shiftright("draw", DRAW_BITS - bits)
    slim = slim.withColumn("chunk", chunk)

    parts = cut_lineage(slim.groupBy("src", "chunk").agg(F.sum(F.col("size") * F.col("rows")).alias("words")))
    plan = targets(parts.groupBy("src").agg(F.sum("words").alias("size")), weights, share, repeats)
    upto = Window.partitionBy("src").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = (parts.withColumn("start", F.coalesce(F.sum("words").over(upto), F.lit(0))).alias("p")
              .join(plan.alias("t"), F.col("p.src").eqNullSafe(F.col("t.src")))
              .select(F.col("p.src").alias("c_src"), F.col("p.chunk").alias("c_chunk"), "start", "rank", "source_size",
                      "total", "target"))
    within = Window.partitionBy("c_src", "c_chunk").orderBy("draw", "size", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("size") * F.col("rows")).over(within), F.lit(0))
    groups = (slim.join(starts, F.col("src").eqNullSafe(F.col("c_src")) & (F.col("chunk") == F.col("c_chunk")))
              .select("doc_id", "c_src", "size", "draw", "rank", "source_size", "total", "target", "rows", (F.col("start") + before).alias("before")))
    sent = cut_lineage(_written_out(groups, (counted["most"] or 0) > REPEAT_ROWS)
                       .withColumn("sent", F.col("before") + F.col("repeat") * F.col("size")).drop("before", "rows"))

    def finish(k: int) -> Column:
        return F.try_divide((k * F.col("source_size") + F.col("sent")).cast("double"), F.col("target"))

    buckets = 1 << bits
    passes = [F.struct(F.lit(k).alias("k"), finish(k).alias("finish")) for k in range(repeats)]
    entries = sent.where("size > 0").select("size", "draw", "rank", "total", F.explode(F.array(*passes)).alias("e"))
    entries = entries.select("size", "draw", "rank", "total", "e.k", "e.finish", _bucket(F.col("e.finish"), buckets).alias("bucket"))
    cut = _cut(entries, share)
    taken = [_is_taken(cut, F.struct(finish(k).alias("finish"), F.col("rank"), F.col("draw"), F.col("size"),
                                     F.lit(k).alias("k")), buckets) for k in range(repeats)]
    copies = F.when(F.col("size") > 0, sum(t.cast("int") for t in taken)).otherwise(F.lit(0))
    documents = sent.select("doc_id", F.col("c_src").alias("source"), "size", "draw", "source_size", "target",
                            copies.alias("copies"))
    # how far each source is taken: the last place with the most copies, how many of the rows there get them, and of how many
    places = documents.groupBy("source", "draw", "size").agg(F.max("copies").alias("copies"), F.sum("copies").alias("all"), F.count(F.lit(1)).alias("of"))
    there = (F.col("all") - F.col("of") * (F.col("copies") - 1)).alias("there")
    cuts = (places.where("copies > 0").groupBy("source").agg(F.max(F.struct("copies", "draw", "size", there, "of")).alias("last"))
            .select("source", "last.*"))
    return Mix(documents, cuts)


def _written_out(groups: DataFrame, large: bool) -> DataFrame:
    """One row for each of a group's equal rows, numbered ``repeat`` from 1; a large group goes to many tasks."""
    if not large:
        return groups.withColumn("repeat", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("rows"))))
    first = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("rows") - 1, F.lit(REPEAT_ROWS).cast("bigint")))
    pieces = groups.withColumn("first", first).repartition("draw", "first")
    last = F.least(F.col("rows"), F.col("first") + REPEAT_ROWS)
    return pieces.withColumn("repeat", F.explode(F.sequence(F.col("first") + 1, last))).drop("first")


def _bucket(finish: Column, buckets: int) -> Column:
    """Equal steps of virtual time up to 1, equal ratios beyond."""
    return F.when(finish <= 1, F.floor(finish * buckets)).otherwise(
        buckets + F.floor(F.log2(finish) * buckets)).cast("bigint")


def _cut(entries: DataFrame, share: float) -> tuple | None:
    """(bucket, last entry taken in it, or None); None if the budget holds everything.

    Bucket totals are at most a few 2^MAX_BITS rows; the exact order is made of one bucket alone.
    """
    totals = entries.groupBy("bucket").agg(F.sum("size").alias("words"), F.max("total").alias("total"))
    run = totals.withColumn("upto", F.sum("words").over(Window.orderBy("bucket")))
    budget = F.lit(share) * F.col("total")
    over = run.where(F.col("upto") > budget).agg(F.min(F.struct("bucket", (F.col("upto") - F.col("words")).alias("before"))).alias("x"))
    first = over.first()["x"]
    if first is None:
        return None
    entry = F.struct("finish", "rank", "draw", "size", "k")
    ordered = entries.where(F.col("bucket") == first["bucket"]).withColumn(
        "upto", F.lit(first["before"]) + F.sum("size").over(Window.orderBy("finish", "rank", "draw", "size", "k")))
    last = ordered.where(F.col("upto") <= budget).agg(F.max(entry).alias("x")).first()["x"]
    return first["bucket"], last


def _is_taken(cut: tuple | None, entry: Column, buckets: int) -> Column:
    if cut is None:
        return F.lit(True)
    at = _bucket(entry["finish"], buckets)
    if cut[1] is None:
        return at < cut[0]
    e = cut[1]
    last = F.struct(F.lit(e["finish"]).alias("finish"), F.lit(e["rank"]).alias("rank"), F.lit(e["draw"]).cast("bigint").alias("draw"),
                    F.lit(e["size"]).cast("bigint").alias("size"), F.lit(e["k"]).alias("k"))
    return (at < cut[0]) | ((at == cut[0]) & (entry <= last))


def _bounds(edge: DataFrame) -> DataFrame:
    """(bound_source, bound, below, same): the hash of the ``there``-th row of each source, rows with less, rows with that hash.

    Counts by the hash's leading bits find its bucket; only that bucket's hashes are put in order.
    """
    counted = edge.toDF("src", "there", "hash").withColumn("top", F.shiftright("hash", 64 - MAX_BITS))

    def found(rows: DataFrame, by: str, start: Column) -> DataFrame:
        run = Window.partitionBy("src").orderBy(by)
        upto = start + F.sum("n").over(run.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return rows.withColumn("upto", upto).withColumn("below", F.col("upto") - F.col("n")).where((F.col("below") < F.col("there")) & (F.col("there") <= F.col("upto")))

    tops = found(counted.groupBy("src", "there", "top").agg(F.count(F.lit(1)).alias("n")), "top", F.lit(0))
    inside = counted.alias("e").join(tops.alias("t"), F.col("e.src").eqNullSafe(F.col("t.src")) & (F.col("e.top") == F.col("t.top"))).select(
        F.col("e.src").alias("src"), F.col("e.there").alias("there"), "hash", F.col("t.below").alias("start"))
    hashes = inside.groupBy("src", "there", "start", "hash").agg(F.count(F.lit(1)).alias("n"))
    return found(hashes, "hash", F.col("start")).select(F.col("src").alias("bound_source"), F.col("hash").alias("bound"), "below", F.col("n").alias("same"))


def take(docs: DataFrame, *, doc_id: str = "doc_id", source: str = "source", text: str = "text", salt: str = SALT,
         **options) -> DataFrame:
    """The mixed documents with their own columns, one row for each copy taken.

    A source's documents are taken up to a place in its order, so the whole decision is one row per source:
    the text is neither shuffled nor joined to its own table. Where only some of the rows at that place are taken
    once more, they are chosen by a hash of the whole row; rows that are equal in all columns are written out
    from one of them.
    """
    cuts = mix(docs, doc_id=doc_id, source=source, text=text, salt=salt, **options).cuts
    names = fresh(docs, "cut_source", "cut_copies", "cut_draw", "cut_size", "cut_there", "cut_of", "cut_bound", "cut_below", "cut_same", "copy")
    src, copies, draw_, size, there, of, bound, below, same, out = names
    cuts = cut_lineage(cuts.toDF(*names[:6]))
    own = [named(c) for c in docs.columns]
    place = F.struct(draw_of(named(doc_id), named(text), salt).alias("draw"), size_of(named(text)).alias("size"))
    last = F.struct(named(draw_).alias("draw"), named(size).alias("size"))
    on = named(source).eqNullSafe(named(src))
    split = cuts.where(named(there) < named(of))
    if not split.limit(1).count():
        joined = join_checked(docs, cuts, on, "inner")
        n = F.when(size_of(named(text)) > 0, named(copies) - F.when(place <= last, 0).otherwise(1)).otherwise(0)
        return joined.withColumn(out, F.explode(F.array_repeat(F.lit(1), n.cast("int")))).select(*own)
    whole_row = F.xxhash64(F.to_json(F.struct(*own)))
    edge = join_checked(docs, split, on, "inner").where(place == last).select(named(src), named(there), whole_row)
    bounds = _bounds(cut_lineage(edge)).toDF("bound_source", bound, below, same)
    cuts = cut_lineage(cuts.join(bounds, named(src).eqNullSafe(F.col("bound_source")), "left").drop("bound_source"))
    joined = join_checked(docs, cuts, on, "inner")
    # null where the source's last place is taken whole
    beside = F.when((place == last) & named(bound).isNotNull(), whole_row)
    full = (place < last) | ((place == last) & (named(bound).isNull() | (beside < named(bound))))
    n = F.when(size_of(named(text)) > 0, named(copies) - F.when(full, 0).otherwise(1)).otherwise(0)
    rest = joined.where(~F.coalesce(beside == named(bound), F.lit(False)))
    rest = rest.withColumn(out, F.explode(F.array_repeat(F.lit(1), n.cast("int")))).select(*own)
    more = named(there) - named(below)  # of the equal rows, so many are taken once more than the others
    equal = (joined.where(beside == named(bound)).groupBy(named(src)).agg(
        F.first(F.struct(*own)).alias("row"), F.first(named(same) * (named(copies) - 1) + more).alias("rows")).withColumn("draw", F.lit(0)))
    return rest.unionAll(_written_out(equal.where("rows > 0"), True).select("row.*"))
