"""URL rules found by their rarest literal token.

A rule is a regular expression over ``host + path`` together with literal tokens that any matching URL must
contain. Each rule is filed under the one of its tokens that the fewest URLs of the table contain. A URL
looks up its own tokens in that index; only the rules it fetches run their expression.

Two kinds of rules: address rules (a host with all its subdomains, and a path prefix), of which the longest
that fits decides, and word and pair rules (a label of the host contains one of some words, or two of them
side by side), which decide where no address rule fits. What no rule fits is allowed.

Defined cases: a null URL, or one without ``://``, has an empty host and path and is allowed by the
method; equal URLs are judged once and give equal rows; rules of equal length go by their text; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import BROADCAST_ROWS, named

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A hot token's rows are spread over so many keys where the index is too large to broadcast.
SALTS = 16

# The rules of the query, as (host, path, verdict).
ADDRESS_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)

#: Words of a host label that mark betting and advertising hosts.
BLOCKED_WORDS = ("casino", "bets", "ads")

#: A topic and a lure, joined by a hyphen in either order in a host label, are blocked together.
TOPICS = ("poker", "slots", "roulette", "betting", "lottery", "jackpot", "loans", "payday", "pills", "pharmacy",
          "replica", "adult", "escort", "dating", "torrents", "warez", "cracks", "keygen", "forex", "sweepstakes")
LURES = ("win", "free", "best", "bonus", "cheap", "online", "club", "live", "hot", "instant")


@dataclass(frozen=True)
class UrlRule:
    """``name`` is empty for word rules; ``tokens`` are literal and all of them occur in every match."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]


def address_rule(host: str, path: str, verdict: str) -> UrlRule:
    """A host with its subdomains, and the beginning of a path. Only whole path segments serve as tokens."""
    host = host.lower()
    segments = path.split("/")[1:-1]
    tokens = [f"h:{x}" for label in host.split(".") for x in label.split("-") if x] + [f"p:{s}" for s in segments if s]
    return UrlRule(host + path, verdict, rf"^([^/]*\.)?{re.escape(host)}{re.escape(path)}", tuple(dict.fromkeys(tokens)))


def word_rule(word: str, verdict: str = "block") -> UrlRule:
    return UrlRule("", verdict, rf"^([^/]*[.-])?{re.escape(word)}([.-]|/|$)", (f"h:{word}",))


def pair_rule(a: str, b: str, verdict: str = "block") -> UrlRule:
    """Two words next to each other in a host label; a URL must hold both tokens, the index files the rarer one."""
    a_, b_ = re.escape(a), re.escape(b)
    return UrlRule("", verdict, rf"^([^/]*[.-])?({a_}-{b_}|{b_}-{a_})([.-]|/|$)", (f"h:{a}", f"h:{b}"))


def default_rules() -> list[UrlRule]:
    return ([address_rule(*r) for r in ADDRESS_RULES] + [word_rule(w) for w in BLOCKED_WORDS]
            + [pair_rule(t, x) for t in TOPICS for x in LURES])


def _after_scheme(url: Column) -> Column:
    """What follows the first ``://``; a later one belongs to the path, query or fragment."""
    u = F.coalesce(url, F.lit(""))
    return F.when(F.instr(u, "://") > 0, F.substr(u, F.instr(u, "://") + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*(/[^?#]*)", 1)


def tokens_of(host: Column, path: Column) -> Column:
    """Distinct literal tokens of a URL: pieces of the host's labels and whole path segments."""
    h = F.transform(F.filter(F.split(host, "[.-]"), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    p = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.concat(h, p))


def rule_table(spark, rules: Sequence[UrlRule]) -> DataFrame:
    rows = [(i, r.name, r.verdict, r.pattern, list(r.tokens)) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "rule_id int, name string, verdict string, pattern string, tokens array<string>")


def index_rules(rules: DataFrame, tokens: DataFrame) -> DataFrame:
    """File each rule under its rarest token. ``tokens``: one row (token) per URL and token."""
    wanted = rules.select("rule_id", F.explode("tokens").alias("token"))
    few = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    seen = tokens.join(F.broadcast(wanted.select("token").distinct()) if few else wanted.select("token").distinct(),
                       "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("seen"))
    best = (wanted.join(seen, "token", "left")
            .groupBy("rule_id").agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "token")).alias("rarest")))
    return rules.join(best, "rule_id").select("rule_id", "name", "verdict", "pattern", F.col("rarest.token").alias("token"))


def judge(pages: DataFrame, rules: Sequence[UrlRule] | DataFrame | None = None, *, page_id: str = "page_id",
          url: str = "url") -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    spark = pages.sparkSession
    table = rules if isinstance(rules, DataFrame) else rule_table(spark, default_rules() if rules is None else rules)
    urls = pages.select(named(url).alias("u")).distinct()
    parsed = urls.select("u", host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path"))
    tokens = parsed.select("u", "host", "path", F.explode(tokens_of(F.col("host"), F.col("path"))).alias("token"))
    index = index_rules(table, tokens.select("token"))
    if index.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        fetched = tokens.join(F.broadcast(index), "token")
    else:  # a hot token's URLs go to several tasks, each with that token's rules
        salt = F.pmod(F.xxhash64("u"), F.lit(SALTS))
        spread = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        fetched = tokens.withColumn("salt", salt).join(spread, ["token", "salt"])
    fits = fetched.where(F.rlike(F.concat("host", "path"), F.col("pattern")))
    best = fits.groupBy("u").agg(F.max(F.struct(
        F.length("name").alias("length"), F.col("name"), F.col("verdict"))).alias("best"))
    found = pages.select(named(page_id).alias("page_id"), named(url).alias("url")).join(
        best, F.col("url") == F.col("u"), "left")
    return found.select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
        F.when(F.col("best.length") > 0, F.col("best.name")).alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit("allow")).alias("verdict"))
