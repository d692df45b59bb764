"""Document fingerprints by winnowing.

Every run of ``GRAM`` tokens is hashed; of each ``WINDOW`` consecutive hashes the least is chosen, the rightmost
of equal ones; the fingerprint is the chosen hashes with their positions. Any passage of at least
``GRAM + WINDOW - 1`` tokens that two texts share puts a common hash into both fingerprints. Tokens are words;
a word of more than ``TOKEN_CHARS`` characters is several tokens.

Few words give few runs, so short texts are read by characters as well: up to ``SHORT_CHARS`` by runs of
``SHORT_GRAM``, all of which are kept, up to ``MIDDLE_CHARS`` by winnowed runs of ``CHAR_GRAM``. The kinds overlap
in length: a text and another of two thirds to one and a half of its length always have one in common beside
the words. Where there are fewer runs than two windows, all are kept.

A hash and its position are one number: 39 bits of the hash, then 24 bits of the position, reversed, so that
the least number in a window is its least hash, the rightmost of equal ones. Positions wrap at 2^24 words,
which changes nothing but the tie of equal hashes across the wrap.

Defined cases: null texts count as empty; texts without words have an empty fingerprint, texts with fewer
tokens than a gram have one gram; two empty
fingerprints are equal (1.0), an empty and another are not alike (0.0); documents with equal ids follow each
other by the hash of their text, null ids come last; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.common import BLANKS, let, named
from driftline.session import cut_lineage

GRAM = 5
WINDOW = 8
TOKEN_CHARS = 16
#: Runs of characters, and the lengths of text (code points) that they serve: [1, 96], [65, 1024]; words serve all.
SHORT_GRAM, SHORT_CHARS = 3, 96
CHAR_GRAM, CHAR_FROM, MIDDLE_CHARS = 8, 65, 1024
POSITION_BITS = 24
HASH_SHIFT = 64 - 39

#: Bytes of text that one range of ids should hold, and ranges at most; larger ranges are cut by equal steps of the id.
RANGE_BYTES = 8 << 20
MAX_RANGES = 4096
STEPS_BELOW = 16


def fingerprint(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """array<bigint>: the chosen hashes with positions, in the order of the text."""
    top = (1 << POSITION_BITS) - 1

    def packed(h: Column, i: Column) -> Column:
        high = F.shiftleft(F.shiftrightunsigned(h, HASH_SHIFT), POSITION_BITS)
        return high.bitwiseOR((F.lit(top) - i.bitwiseAND(F.lit(top))).cast("bigint"))

    def runs(tokens: Column, size: int) -> Column:
        return F.transform(
            F.slice(tokens, 1, F.greatest(F.size(tokens) - (size - 1), F.least(F.size(tokens), F.lit(1)))),
            lambda w, i: packed(F.xxhash64(w, *[F.get(tokens, i + k) for k in range(1, size)]), i))

    def winnowed(g: Column) -> Column:
        least = F.transform(F.slice(g, 1, F.greatest(F.size(g) - (window - 1), F.lit(0))),
                            lambda x, i: F.least(x, *[F.get(g, i + k) for k in range(1, window)]))
        return F.array_distinct(F.when(F.size(g) < 2 * window, g).otherwise(least))

    def of_length(n: Column) -> Column:
        none = F.array().cast("array<bigint>")
        chars = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
        tokens = F.regexp_extract_all(text, F.lit(rf"[^\x20\x09-\x0D]{{1,{TOKEN_CHARS}}}"), F.lit(0))
        return F.concat(
            F.when(n <= SHORT_CHARS, let(chars, lambda c: F.array_distinct(runs(c, SHORT_GRAM)))).otherwise(none),
            F.when(n.between(CHAR_FROM, MIDDLE_CHARS), let(chars, lambda c: let(runs(c, CHAR_GRAM), winnowed))).otherwise(none),
            let(tokens, lambda t: let(runs(t, gram), winnowed)))

    core = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(core == "", F.array().cast("array<bigint>")).otherwise(let(F.length(text), of_length))


def positions(print_: Column) -> Column:
    """Positions of the chosen hashes, in tokens or characters."""
    top = (1 << POSITION_BITS) - 1
    return F.transform(print_, lambda x: F.lit(top) - x.bitwiseAND(F.lit(top)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of the sets of hashes, 1 for two empty ones."""
    def bare(x: Column) -> Column:
        return F.array_distinct(F.transform(x, lambda h: F.shiftright(h, POSITION_BITS)))

    def of(x: Column, y: Column) -> Column:
        both = F.size(F.array_intersect(x, y))
        return F.when(F.size(x) + F.size(y) == 0, F.lit(1.0)).otherwise(both / (F.size(x) + F.size(y) - both))

    return let(bare(a), lambda x: let(bare(b), lambda y: of(x, y)))


def text_of(print_: Column) -> Column:
    """Each chosen number in hexadecimal, joined by commas."""
    return F.array_join(F.transform(print_, lambda x: F.lower(F.hex(x))), ",")


def ranges(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> tuple[list, int]:
    """Cuts of the ids into ranges of about equal bytes, and the equal steps that each of them is cut into."""
    facts = docs.agg(F.sum(F.octet_length("text")).alias("bytes")).first()
    wanted = max(1, -(-int(facts["bytes"] or 0) // range_bytes))
    coarse = min(wanted, MAX_RANGES)
    if coarse == 1:
        return [], 1
    shares = [k / coarse for k in range(1, coarse)]
    cuts = docs.agg(F.percentile_approx("doc_id", shares, 10 * coarse).alias("c"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    if cuts["c"] is None:
        return [], 1
    return sorted({cuts["lo"], *cuts["c"], cuts["hi"]}), min(STEPS_BELOW, -(-wanted // coarse))


def range_of(doc_id: Column, cuts: list, steps: int) -> Column:
    """The number of an id's range, rising with the id: a binary search in the cuts, then a step within."""
    if not cuts:
        return F.lit(0).cast("bigint")
    edges = F.lit(cuts) if len(cuts) > 1 else F.array(F.lit(cuts[0]))
    halves = [1 << k for k in range(len(cuts).bit_length() - 1, -1, -1)]

    def search(e: Column) -> Column:
        at = F.lit(0)
        lo = F.aggregate(F.array(*[F.lit(h) for h in halves]), at,
                         lambda a, h: F.when(F.get(e, a + h - 1) <= doc_id, a + h).otherwise(a))
        return let(lo, lambda i: i.cast("bigint") * steps + (
            F.least(F.lit(steps - 1), F.floor((doc_id - F.get(e, i - 1)) / F.greatest(F.get(e, i) - F.get(e, i - 1), F.lit(1)) * steps))
            if steps > 1 else F.lit(0)))

    return let(edges, search)


def with_next(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, text, next_text, part and order keys, the next document being the one with the next lower id.

    The text is shuffled once, by ranges of ids. The first document of each range is sent to the range before
    it as well, as a guest at its end, so a range needs no other one.
    """
    cuts, steps = ranges(docs, range_bytes)
    tie = F.xxhash64("text")
    x = docs.withColumn("tie", tie).withColumn("part", F.when(F.col("doc_id").isNull(), F.lit(-1) - F.shiftrightunsigned("tie", 56))
                                               .otherwise(range_of(F.col("doc_id"), cuts, steps)).cast("bigint"))
    # descending ids: ranges run from high to low, the null ids' ranges come last
    key = F.struct(F.col("doc_id").isNotNull().alias("has"), F.col("doc_id").alias("doc_id"), (-F.col("part")).alias("np"), (F.lit(-1) - F.col("tie")).alias("t"))
    heads = cut_lineage(x.groupBy("part").agg(F.max(key).alias("head")))
    numbered = heads.withColumn("before", F.lag("part").over(Window.orderBy(F.col("part").desc())))
    last = F.min("part").over(Window.partitionBy())
    guests = numbered.withColumn("goes_to", F.coalesce("before", last)).select("part", "head", "goes_to")
    first_rows = (x.withColumn("key", key).join(F.broadcast(guests.withColumnRenamed("part", "g_part")),
                                               (F.col("part") == F.col("g_part")) & (F.col("key") == F.col("head")))
                  .dropDuplicates(["g_part"])
                  .select("doc_id", "text", "tie", F.col("goes_to").alias("part"), F.lit(1).alias("guest")))
    both = x.select("doc_id", "text", "tie", "part", F.lit(0).alias("guest")).unionByName(first_rows)
    order = Window.partitionBy("part").orderBy("guest", F.col("doc_id").desc_nulls_last(), "tie")
    return both.withColumn("next_text", F.lead("text").over(order))


def edited(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Every document's fingerprint beside that of its edited text, and its likeness to this and to the next document's."""
    x = with_next(docs, range_bytes)
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    changed = F.concat(F.substr(F.col("text"), F.lit(1), n - cut), F.substr(F.coalesce("next_text", F.lit("")), F.lit(1), cut))
    x = x.select("doc_id", "tie", "part", "guest", n.cast("bigint").alias("n_chars"), fingerprint(F.col("text")).alias("print"),
                 F.when(F.col("guest") == 0, F.struct(F.sha2(changed.cast("binary"), 256).alias("sha"), fingerprint(changed).alias("print"))).alias("new"))
    order = Window.partitionBy("part").orderBy("guest", F.col("doc_id").desc_nulls_last(), "tie")
    x = x.withColumn("next_print", F.lead("print").over(order)).where("guest = 0")
    return x.select("doc_id", "n_chars", F.col("new.sha").alias("edited_sha256"), "print", F.col("new.print").alias("edited_print"),
                    likeness(F.col("print"), F.col("new.print")).alias("near_edited"),
                    likeness(F.col("print"), F.coalesce("next_print", F.array().cast("array<bigint>"))).alias("near_next"))


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, print (chosen hashes with positions) and positions of every document."""
    out = docs.select(named(doc_id).alias("doc_id"), fingerprint(named(text)).alias("print"))
    return out.withColumn("positions", positions(F.col("print")))
