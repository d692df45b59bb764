"""Quality rules whose limits come from the corpus: mergeable quantile sketches per language and source.

Fixed cutoffs that suit one language or source reject good documents of another. Here each
(language, source) has a quantile sketch of every rule's figure; the limit is an upper fence above the
bulk of that group. A sketch is a log-linear histogram (2^-10 relative error) kept as rows
``(group, rule, bucket, count)``, so sketches of any partial data merge by adding counts: a group
with too few documents uses the merged sketch of its language, and below that the one of the corpus.
The wider sketch also bounds a group's fence: where junk is the bulk of a source, its own quantiles are junk.

All figures are integers (thousandths), so every engine and every rerun gives the same verdicts.

Defined cases: null, empty and blank texts have no words and fail the base rules; null languages and
sources form groups of their own; repeated rows are judged each for itself and alike; an empty table
gives an empty result; further columns are carried, and a document column with the name of a figure
is replaced by the figure.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.common import BLANKS, fresh, join_checked, let, named, staged, words
from driftline.session import cut_lineage

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WINDOW_WORDS = 3

#: Buckets keep this many leading bits of a figure.
SKETCH_BITS = 11
#: Groups with fewer documents use the next wider sketch.
MIN_GROUP = 200
#: No fence is above so many times that of the next wider sketch, so junk that fills a group cannot set its own limit.
WIDER_REACH = 3


@dataclass(frozen=True)
class Rule:
    """``numerator * 1000 div denominator`` must not exceed ``q_high + reach * max(q_high - q_low, least)``."""

    name: str
    numerator: str
    denominator: str
    least: int
    reach: int = 3
    low: int = 25
    high: int = 75


RULES = (
    Rule("symbols", "n_symbols", "n_words", least=60),
    Rule("dup_lines", "n_dup_lines", "n_lines", least=150),
    Rule("repeats", "n_repeat_words", "n_words", least=150),
    Rule("word_length", "word_chars", "n_words", least=1500),
)


def repeated_words(tokens: Column, size: int = WINDOW_WORDS) -> Column:
    """Number of words that lie in a window of ``size`` words which occurs twice or more in the text.

    Windows are compared by their 64-bit hash. Only texts with an equal pair sort (hash, position)
    pairs; the covered positions are then counted by the gaps between the repeated windows.
    """
    def positions(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return let(pairs, lambda s: F.array_sort(F.transform(
            F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])),
            lambda x: x["p"])))

    def covered(starts: Column) -> Column:
        return F.aggregate(
            F.transform(starts, lambda p, i: F.least(F.lit(size), F.coalesce(F.get(starts, i + 1) - p, F.lit(size)))),
            F.lit(0).cast("bigint"), lambda a, x: a + x)

    def count(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("bigint")).otherwise(
            let(positions(hashes), covered))

    def of_windows(t: Column) -> Column:
        hashes = F.transform(F.slice(t, 1, F.greatest(F.size(t) - (size - 1), F.lit(0))),
                             lambda w, i: F.xxhash64(w, *[F.get(t, i + k) for k in range(1, size)]))
        return let(hashes, count)

    return let(tokens, of_windows)


def figures(docs: DataFrame, *, text: str = "text", carry: Sequence[str] | None = None) -> DataFrame:
    """The counts of every whole text, beside the columns in ``carry`` (all, if not given)."""
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    body, = fresh(docs, "body")
    kept = [c for c in (docs.columns if carry is None else carry) if c.lower() not in names]
    x = docs.withColumn(body, F.coalesce(named(text), F.lit("")))
    t = named(body)
    lines = F.filter(F.split(t, "\n", -1), lambda s: F.btrim(s, F.lit(BLANKS)) != "")
    counts = F.struct(F.size(lines).cast("bigint").alias("n_lines"),
                      (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"))
    tokens = words(t)
    of_words = let(tokens, lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"),
                                              repeated_words(w).alias("n_repeat_words")))
    of_lines, by_word = fresh(x, "of_lines", "by_word")
    x = x.select(*[named(c) for c in kept], t.alias(body), counts.alias(of_lines), of_words.alias(by_word))
    return x.select(
        *[named(c) for c in kept], named(by_word)["n_words"].alias("n_words"),
        F.length(F.translate(t, BLANKS, "")).cast("bigint").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        named(of_lines)["n_lines"].alias("n_lines"), named(of_lines)["n_dup_lines"].alias("n_dup_lines"),
        named(by_word)["n_repeat_words"].alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def figure(rule: Rule) -> Column:
    """The rule's figure in thousandths; texts without words or lines have 0."""
    n, d = F.col(rule.numerator), F.col(rule.denominator)
    return F.when(d > 0, F.call_function("div", n * 1000, d)).otherwise(F.lit(0)).cast("bigint")


def bucket(x: Column) -> Column:
    """Log-linear bucket: the leading ``SKETCH_BITS`` bits and how many bits follow them."""
    extra = F.greatest(F.length(F.bin(x)) - SKETCH_BITS, F.lit(0))
    return (extra * (1 << SKETCH_BITS) + F.call_function("shiftright", x, extra)).cast("bigint")


def bucket_floor(b: Column) -> Column:
    """The least figure of a bucket."""
    return F.call_function("shiftleft", F.pmod(b, F.lit(1 << SKETCH_BITS)),
                           F.floor(b / (1 << SKETCH_BITS)).cast("int")).cast("bigint")


def sketches(counts: DataFrame, groups: Sequence[str], rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per group, rule and non-empty bucket: the mergeable sketches, combined before the shuffle."""
    cells = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), bucket(figure(r)).alias("b")) for r in rules]))
    return (counts.where("n_words > 0").select(*[named(g) for g in groups], cells.alias("cell"))
            .groupBy(*[named(g) for g in groups], F.col("cell.rule").alias("rule"), F.col("cell.b").alias("b"))
            .agg(F.count(F.lit(1)).alias("n")))


def merge(sketch: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Sketches of wider groups: add the counts."""
    return sketch.groupBy(*[named(g) for g in groups], "rule", "b").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, groups: Sequence[str], rules: Sequence[Rule] = RULES) -> DataFrame:
    """Upper fence per group and rule, with the number of documents behind it."""
    w = Window.partitionBy(*groups, "rule")
    x = sketch.withColumn("total", F.sum("n").over(w)).withColumn("upto", F.sum("n").over(w.orderBy("b")))
    agg = x.groupBy(*[named(g) for g in groups], "rule").agg(
        F.max("total").alias("docs"),
        *[F.min(F.when(F.col("upto") * 100 >= F.col("total") * p, F.col("b"))).alias(f"q{p}")
          for p in sorted({p for r in rules for p in (r.low, r.high)})])
    fence = F.lit(None).cast("bigint")
    for r in rules:
        low, high = bucket_floor(F.col(f"q{r.low}")), bucket_floor(F.col(f"q{r.high}"))
        fence = F.when(F.col("rule") == r.name, high + r.reach * F.greatest(high - low, F.lit(r.least))).otherwise(fence)
    return agg.select(*[named(g) for g in groups], "rule", "docs", fence.alias("fence"))


def thresholds(sketch: DataFrame, lang: str, source: str, rules: Sequence[Rule] = RULES,
               min_group: int = MIN_GROUP) -> DataFrame:
    """One row per (language, source) with a limit for each rule, from the narrowest sketch that has enough documents."""
    by_lang = merge(sketch, [lang])
    own = fences(sketch, [lang, source], rules).alias("o")
    wider = fences(by_lang, [lang], rules).alias("l")
    whole = fences(merge(by_lang, []), [], rules).alias("w")
    same_lang = F.col(f"o.`{lang}`").eqNullSafe(F.col(f"l.`{lang}`")) & (F.col("o.rule") == F.col("l.rule"))
    x = own.join(wider, same_lang).join(F.broadcast(whole), F.col("o.rule") == F.col("w.rule"))  # a row for each rule
    of_lang = F.when(F.col("l.docs") >= min_group, F.least(F.col("l.fence"), WIDER_REACH * F.col("w.fence"))).otherwise(F.col("w.fence"))
    limit = F.when(F.col("o.docs") >= min_group, F.least(F.col("o.fence"), WIDER_REACH * of_lang)).otherwise(of_lang)
    return (x.select(F.col(f"o.`{lang}`").alias("g_lang"), F.col(f"o.`{source}`").alias("g_source"),
                     F.col("o.rule").alias("rule"), limit.alias("limit"))
            .groupBy("g_lang", "g_source")
            .agg(*[F.max(F.when(F.col("rule") == r.name, F.col("limit"))).alias(f"limit_{r.name}") for r in rules]))


def judge(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source",
          carry: Sequence[str] | None = None, rules: Sequence[Rule] = RULES,
          min_group: int = MIN_GROUP) -> DataFrame:
    """Every document with its figures, ``base_failed`` and ``kept``.

    The figures are written once, as both the sketches and the verdict read them; the limits are
    joined back by language and source.
    """
    own = list(docs.columns if carry is None else carry)
    need = list(dict.fromkeys([*own, lang, source]))
    counts = staged(figures(docs, text=text, carry=need), "quality")
    sketch = cut_lineage(sketches(counts, [lang, source], rules))  # some buckets a group; three levels read them
    limits = thresholds(sketch, lang, source, rules, min_group)
    limits = limits.toDF(*fresh(counts, *limits.columns))
    of_lang, of_source, *of_rules = limits.columns
    on = named(lang).eqNullSafe(named(of_lang)) & named(source).eqNullSafe(named(of_source))
    ok = F.lit(True)
    for r, limit in zip(rules, of_rules):
        ok = ok & (figure(r) <= F.coalesce(named(limit), F.lit((1 << 62))))
    kept = [c for c in own if c in counts.columns]
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    return join_checked(counts, limits, on).select(
        *[named(c) for c in kept if c not in names], *names,
        base_failed().alias("base_failed"), (~base_failed() & ok).alias("kept"))


def keep(docs: DataFrame, **options) -> DataFrame:
    """The documents that pass, with their own columns. Columns named as figures are carried under other names."""
    names = {"n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "kept"}
    aside = {c: n for c, n in zip((c for c in docs.columns if c.lower() in names),
                                  fresh(docs, *[f"own_{c}" for c in docs.columns if c.lower() in names]))}
    x = docs.select(*[named(c).alias(aside.get(c, c)) for c in docs.columns])
    judged = judge(x, **options).where("kept")
    return judged.select(*[named(aside.get(c, c)).alias(c) for c in docs.columns])
