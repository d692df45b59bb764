"""The training-data operators bound to the tables, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import (
    licenses, mixing, quality_rules, sampled_pieces, simhash, text_queries, token_counts, token_output, toxicity, url_filters, winnowing)
from driftline.llm.text_queries import table



def vocabulary(name: str) -> str:
    """A public tokenizer's file; the package lies at the same place on every machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents mixed to source weights 3, 1, 2, ... at 150 % of all words."""
    return mixing.mix(table(spark, sf_dir, "documents")).documents.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' sequences in training order, written as shards and read back: slot, document, ids."""
    return token_output.materialised(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken")).select(
        "slot", "shard", "place", "doc_id", "part", "used", F.xxhash64("ids").alias("ids_hash"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    return url_filters.judge(table(spark, sf_dir, "pages"))


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, its edited text's, and how alike they and the next document's are."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return winnowing.edited(docs).select(
        "doc_id", "n_chars", "edited_sha256", winnowing.text_of(F.col("print")).alias("fingerprint"),
        winnowing.text_of(F.col("edited_print")).alias("edited_fingerprint"), "near_edited", "near_next")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a licence notice or text."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the smallest id it reaches by links of two bits or fewer."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=2)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op8_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampled segmentation of every document, and whether decoding it gives the text."""
    return sampled_pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("piece_bpe_32k.model"),
                                 keep=["doc_id"], lossless="lossless")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document."""
    return toxicity.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures and verdict of every document."""
    return quality_rules.judge(table(spark, sf_dir, "documents"), carry=["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {f.__name__: f for f in (
    op1_mix_sources, op2_token_output, op3_url_filters, op4_winnowing, op5_license_scan, op6_simhash, op7_token_counts,
    op8_sampled_pieces, op9_toxicity, op10_quality_rules)} | text_queries.QUERIES

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

MIX_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, len({_WORDS})::BIGINT AS size,
         ('0x' || substr(md5(concat_ws('|', coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, ''))), 'mix')), 1, 15))::BIGINT AS draw
  FROM documents
), s AS (
  SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM d GROUP BY source
), r AS (
  SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
         (source_size * 2)::DOUBLE AS ceiling, (sum(source_size) OVER ())::BIGINT AS total FROM s
), l AS (
  SELECT *, ceiling / weight AS ratio,
         (1.5::DOUBLE * total::DOUBLE - coalesce(sum(ceiling) OVER (ORDER BY ceiling / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY ceiling / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r
), t AS (
  SELECT *, least(ceiling, coalesce((SELECT arg_min(level, (ratio, rank)) FROM l WHERE level < ratio) * weight, ceiling)) AS target FROM l
), e AS (
  SELECT d.*, t.rank, t.source_size, t.target, t.total, k.k,
         (k.k * t.source_size + sum(d.size) OVER (PARTITION BY t.rank, k.k ORDER BY d.draw, d.size, d.rid ROWS UNBOUNDED PRECEDING))::DOUBLE / t.target AS finish
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source CROSS JOIN (VALUES (0), (1)) k(k)
), x AS (
  SELECT *, sum(CASE WHEN size > 0 THEN size ELSE 0 END) OVER (ORDER BY finish, rank, draw, size, k, rid ROWS UNBOUNDED PRECEDING) AS upto FROM e
)
SELECT doc_id, any_value(size)::BIGINT AS size, any_value(source_size)::BIGINT AS source_size, any_value(target) AS target,
       sum(CASE WHEN size > 0 AND upto <= 1.5::DOUBLE * total THEN size ELSE 0 END)::BIGINT AS taken, any_value(source) AS source,
       sum(CASE WHEN size > 0 AND upto <= 1.5::DOUBLE * total THEN 1 ELSE 0 END)::INTEGER AS copies
FROM x GROUP BY rid, doc_id
"""

_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in url_filters.ADDRESS_RULES)
_BLOCKED, _TOPICS, _LURES = ("|".join(x) for x in (url_filters.BLOCKED_WORDS, url_filters.TOPICS, url_filters.LURES))

URL_SQL = rf"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '(?s)^[^/?#]*(/[^?#]*)', 1) AS path
  FROM (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)
), r AS (SELECT * FROM (VALUES {_RULES}) r(rhost, rpath, verdict)
), b AS (
  SELECT p.page_id, p.host, p.path, arg_max(r.rhost || r.rpath, (length(r.rhost || r.rpath), r.rhost || r.rpath)) AS rule,
         arg_max(r.verdict, (length(r.rhost || r.rpath), r.rhost || r.rpath)) AS verdict
  FROM p LEFT JOIN r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath)
  GROUP BY p.page_id, p.host, p.path
)
SELECT page_id, host, path, rule,
       coalesce(verdict, CASE WHEN regexp_matches(host, '(^|[.-])({_BLOCKED})([.-]|$)') OR regexp_matches(host, '(^|[.-])({_TOPICS})-({_LURES})([.-]|$)')
                                OR regexp_matches(host, '(^|[.-])({_LURES})-({_TOPICS})([.-]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM b
"""


def _license_sql() -> str:
    own = licenses.prepared(licenses.TEMPLATES)
    rows = ", ".join(f"('{t.name}', '{g}', {p}, {str(g in t.anchors).upper()}, {t.length}, {len(t.grams)})" for t in own for g, p in zip(t.grams, t.places))
    return rf"""
WITH t(licence, gram, place, anchor, length, b) AS (VALUES {rows}
), w AS (
  SELECT row_number() OVER () AS rid, doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')), ' ') AS ws FROM documents
), g AS (
  SELECT rid, doc_id, i - 1 AS i, ws[i] || ' ' || ws[i + 1] AS gram FROM (SELECT *, unnest(range(1, len(ws))) AS i FROM w WHERE len(ws) > 1)
), s AS (
  SELECT DISTINCT g.rid, g.doc_id, t.licence, t.length, t.b, g.i - t.place AS start FROM g JOIN t ON g.gram = t.gram AND t.anchor
), x AS (
  SELECT s.rid, s.doc_id, s.licence, s.b, s.start, count(DISTINCT g.gram) AS a, count(DISTINCT t.gram) AS both_n
  FROM s JOIN g ON g.rid = s.rid AND g.i >= s.start AND g.i < s.start + s.length LEFT JOIN t ON t.licence = s.licence AND t.gram = g.gram
  GROUP BY ALL
), d AS (SELECT rid, doc_id, licence, max(2.0::DOUBLE * both_n / (a + b)) AS dice FROM x GROUP BY ALL HAVING max(2.0::DOUBLE * both_n / (a + b)) >= {licenses.THRESHOLD}::DOUBLE)
SELECT doc_id, arg_min(licence, (-dice, licence)) AS licence, max(dice) AS dice, count(*) AS n_licences FROM d GROUP BY rid, doc_id
"""


def _quality_sql() -> str:
    top = 1 << quality_rules.SKETCH_BITS
    cells = ", ".join(f"{{'rule': '{r.name}', 'x': CASE WHEN {r.denominator} > 0 THEN ({r.numerator} * 1000) // {r.denominator} ELSE 0 END}}"
                      for r in quality_rules.RULES)
    qs = sorted({p for r in quality_rules.RULES for p in (r.low, r.high)})

    def fence(groups: str) -> str:
        by = f"{groups}, " if groups else ""
        qcols = ", ".join(f"min(CASE WHEN upto * 100 >= total * {p} THEN b END) AS q{p}" for p in qs)
        floors = ", ".join(f"((q{p} % {top}) << (q{p} // {top})::INTEGER)::BIGINT AS f{p}" for p in qs)
        cases = " ".join(f"WHEN '{r.name}' THEN f{r.high} + {r.reach} * greatest(f{r.high} - f{r.low}, {r.least})" for r in quality_rules.RULES)
        return f"""(SELECT {by}rule, docs, CASE rule {cases} END AS fence FROM (SELECT *, {floors} FROM (
            SELECT {by}rule, max(total) AS docs, {qcols} FROM (
              SELECT *, sum(n) OVER (PARTITION BY {by}rule) AS total, sum(n) OVER (PARTITION BY {by}rule ORDER BY b) AS upto FROM (
                SELECT {by}rule, b, count(*) AS n FROM cells GROUP BY {by}rule, b)) GROUP BY {by}rule)))"""

    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT rid, {_WORDS} AS ws FROM d)
), tri AS (
  SELECT rid, i, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)
), rep AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w, w2, w3) AS c FROM tri WHERE w3 IS NOT NULL) WHERE c > 1
), cov AS (
  SELECT rid, count(*) AS n_repeat_words FROM (SELECT DISTINCT rid, i + k AS p FROM rep CROSS JOIN (VALUES (0), (1), (2)) k(k)) GROUP BY rid
), m AS (
  SELECT d.rid, doc_id, lang, source, len({_WORDS})::BIGINT AS n_words, length(translate(text, E' \t\n\x0b\x0c\r', ''))::BIGINT AS word_chars,
         (length(text) - length(translate(text, '{quality_rules.SYMBOLS}', '')))::BIGINT AS n_symbols,
         list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS ls,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN cov USING (rid)
), f AS (
  SELECT *, len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines FROM m
), cells AS (
  SELECT lang, source, rule, greatest(length(bin(x)) - {quality_rules.SKETCH_BITS}, 0) * {top} + (x >> greatest(length(bin(x)) - {quality_rules.SKETCH_BITS}, 0)::INTEGER) AS b
  FROM (SELECT lang, source, c.rule AS rule, c.x AS x FROM (SELECT lang, source, unnest([{cells}]) AS c FROM f WHERE n_words > 0))
), lim AS (
  SELECT lang, source, rule, CASE WHEN docs >= {quality_rules.MIN_GROUP} THEN least(fence, {quality_rules.WIDER_REACH} * of_lang) ELSE of_lang END AS lim
  FROM (SELECT o.*, CASE WHEN l.docs >= {quality_rules.MIN_GROUP} THEN least(l.fence, {quality_rules.WIDER_REACH} * a.fence) ELSE a.fence END AS of_lang
  FROM {fence("lang, source")} o JOIN {fence("lang")} l ON o.lang IS NOT DISTINCT FROM l.lang AND o.rule = l.rule JOIN {fence("")} a ON o.rule = a.rule)
), over_limit AS (
  SELECT DISTINCT x.rid FROM (SELECT rid, lang, source, unnest([{cells}]) AS c FROM f) x
  JOIN lim ON x.lang IS NOT DISTINCT FROM lim.lang AND x.source IS NOT DISTINCT FROM lim.source AND x.c.rule = lim.rule WHERE x.c.x > lim.lim
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words) AS base_failed,
       NOT (n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words) AND over_limit.rid IS NULL AS kept
FROM f LEFT JOIN over_limit USING (rid)
"""


ORACLES = {"op1_mix_sources": MIX_SQL, "op3_url_filters": URL_SQL, "op5_license_scan": _license_sql(),
           "op10_quality_rules": _quality_sql()} | text_queries.ORACLES
