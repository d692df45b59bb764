"""The operators on whole texts and pages bound to the tables: extraction, resampling, filter audit, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import filter_audit, main_text, resampling


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return main_text.extract(table(spark, sf_dir, "pages"), carry=["page_id", "url"]).select("page_id", "url", "text", "n_chars")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's importance for the benchmark's distribution, and its rank among the quarter that is drawn."""
    return resampling.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_features", "weight", "score", "rank")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes in every order, for each language."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumn("step", F.col("step").cast("int"))


QUERIES = {f.__name__: f for f in (op11_html_extraction, op12_importance_resampling, op13_filter_audit)}

RESAMPLING_SQL = rf"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{resampling.WORD}') AS ws
  FROM documents
), b AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{resampling.WORD}') AS ws FROM benchmark
), df AS (
  SELECT rid, unnest(ws || list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS f FROM w
), bf AS (
  SELECT unnest(ws || list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS f FROM b
), steps AS (
  SELECT n, list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS c
  FROM range(256) r(n)
), tab AS (SELECT list(c ORDER BY n) AS t FROM steps
), u AS (SELECT f, hex(f) AS h FROM (SELECT f FROM df UNION SELECT f FROM bf)
), crc AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
                lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) % {resampling.BUCKETS} AS bucket
  FROM u, tab
), g AS (
  SELECT r.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM df) + {resampling.BUCKETS})::DOUBLE
         / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bf) + {resampling.BUCKETS})::DOUBLE)))::BIGINT AS gain
  FROM range({resampling.BUCKETS}) r(bucket)
  LEFT JOIN (SELECT bucket, count(*) AS n FROM df JOIN crc USING (f) GROUP BY bucket) s USING (bucket)
  LEFT JOIN (SELECT bucket, count(*) AS n FROM bf JOIN crc USING (f) GROUP BY bucket) t USING (bucket)
), m AS (
  SELECT rid, count(*) AS n, sum(gain)::BIGINT AS s FROM df JOIN crc USING (f) JOIN g USING (bucket) GROUP BY rid
), x AS (
  SELECT w.rid, doc_id, len(ws) AS n_words, coalesce(m.n, 0)::BIGINT AS n_features,
         CASE WHEN m.n IS NULL THEN 0 ELSE (m.s - ((m.s % m.n) + m.n) % m.n) // m.n END::BIGINT AS weight,
         ('0x' || substr(sha256('{resampling.SALT}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM w LEFT JOIN m USING (rid)
), y AS (
  SELECT *, (weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score FROM x
), z AS (
  SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id ASC NULLS LAST, rid) AS k, count(*) OVER () AS able FROM y WHERE n_words >= {resampling.MIN_WORDS}
)
SELECT doc_id, n_features, weight, score, CASE WHEN k <= able * {resampling.PERCENT} // 100 THEN k END::BIGINT AS rank
FROM y LEFT JOIN z USING (rid)
"""

AUDIT_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id
  FROM documents
), l AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), FALSE) AS good, coalesce(bool_or(toxic = 1), FALSE) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), m AS (
  SELECT part, coalesce(good, FALSE) AS good, coalesce(bad, FALSE) AS bad,
         (len(ws) < 100)::INT + 2 * (100 * len(list_distinct(ws)) < 80 * len(ws))::INT
         + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text))::INT
         + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(first_id < d.doc_id, FALSE)::INT AS mask
  FROM d LEFT JOIN l USING (doc_id)
), c AS (SELECT part, good, bad, mask, count(*) AS n FROM m GROUP BY ALL
), f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), o AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
  FROM f a, f b, f c, f d, f e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
), s AS (
  SELECT filter_order, step, f.bit,
         (SELECT coalesce(sum(x.bit), 0) FROM f x WHERE strpos(filter_order, x.letter) < step)::INT AS before
  FROM o, range(1, 6) r(step), f WHERE f.letter = substr(filter_order, step::INT, 1)
), r AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & before = 0 AND mask & bit > 0 AND good THEN n ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & before = 0 AND mask & bit > 0 AND bad THEN n ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM r
"""

ORACLES = {"op12_importance_resampling": RESAMPLING_SQL, "op13_filter_audit": AUDIT_SQL}
