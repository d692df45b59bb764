"""Extraction / loading queries: alignment, coercion, validation, merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.functions import coerce, labels
from driftline.operators import clean, merge
from driftline.plans.registry import query
from driftline.schemas import SCORING_DEFAULT, SCORING_DOMAIN
from driftline.sources.tables import Tables

# The column list the loader wants (two are absent in lineitem).
WANTED = ["l_orderkey", "l_linenumber", "l_quantity", "l_shipmode", "l_discount",
          "l_comment", "l_returnflag"]


@query("schema_align", """
SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_returnflag FROM lineitem
""")
def schema_align(spark, sf):
    df, _missing = clean.align_columns(Tables(spark, sf).lineitem, WANTED)
    return df


def _qty_text():
    """Quantity rendered as raw text: quoted on line 1, junk on line 7."""
    q = F.col("l_quantity").cast("int").cast("string")
    return (F.when(F.col("l_linenumber") == 1, F.concat(F.lit('"'), q, F.lit('"')))
             .when(F.col("l_linenumber") == 7, F.lit("n/a")).otherwise(q))


@query("coerce_numeric", """
WITH r AS (
  SELECT l_orderkey, l_linenumber,
         CASE WHEN l_linenumber = 1 THEN '"' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || '"'
              WHEN l_linenumber = 7 THEN 'n/a'
              ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS raw
  FROM lineitem)
SELECT l_orderkey, l_linenumber, raw, TRY_CAST(trim(raw, '"') AS DOUBLE) AS value FROM r
""")
def coerce_numeric(spark, sf):
    li = Tables(spark, sf).lineitem.select("l_orderkey", "l_linenumber", _qty_text().alias("raw"))
    return li.withColumn("value", coerce.strip_quotes_to_number("raw"))


def _raw_load_frame(li):
    """Render lineitem as the loader's raw text columns (blanks, commas, padding)."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    price_txt = F.concat(F.floor("l_extendedprice").cast("bigint").cast("string"), F.lit(","),
                         F.lpad((cents % 100).cast("string"), 2, "0"))
    return li.select(
        "l_orderkey",
        F.when(F.col("l_linenumber") == 7, F.lit(None).cast("string"))
         .otherwise(F.col("l_linenumber").cast("string")).alias("line_txt"),
        F.when(F.col("l_linenumber") == 3, F.lit(""))
         .otherwise(F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(".0"))).alias("qty_txt"),
        F.when(F.col("l_returnflag") == "N", F.lit("")).otherwise(price_txt).alias("price_txt"),
        F.when(F.col("l_linestatus") == "O", F.lit("  "))
         .otherwise(F.concat(F.lit(" "), F.col("l_returnflag"), F.lit(" "))).alias("flag_txt"),
    )


@query("load_clean", """
WITH r AS (
  SELECT l_orderkey,
         CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_linenumber AS VARCHAR) END AS line_txt,
         CASE WHEN l_linenumber = 3 THEN '' ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || '.0' END AS qty_txt,
         CASE WHEN l_returnflag = 'N' THEN ''
              ELSE CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR) || ',' ||
                   lpad(CAST(CAST(round(l_extendedprice * 100) AS BIGINT) % 100 AS VARCHAR), 2, '0') END AS price_txt,
         CASE WHEN l_linestatus = 'O' THEN '  ' ELSE ' ' || l_returnflag || ' ' END AS flag_txt
  FROM lineitem)
SELECT l_orderkey,
       CAST(trunc(COALESCE(TRY_CAST(CASE WHEN trim(line_txt) = '' THEN '0' ELSE line_txt END AS DOUBLE), 0)) AS INTEGER) AS line,
       CAST(trunc(COALESCE(TRY_CAST(CASE WHEN trim(qty_txt) = '' THEN '0' ELSE qty_txt END AS DOUBLE), 0)) AS INTEGER) AS qty,
       COALESCE(TRY_CAST(CASE WHEN trim(replace(price_txt, ',', '.')) = '' THEN '0' ELSE replace(price_txt, ',', '.') END AS DOUBLE), 0.0) AS price,
       NULLIF(trim(flag_txt), '') AS flag
FROM r WHERE line_txt IS NOT NULL
""")
def load_clean(spark, sf):
    raw = clean.drop_null_rows(_raw_load_frame(Tables(spark, sf).lineitem), ["line_txt"])
    return raw.select("l_orderkey",
                      coerce.coerce_int("line_txt").alias("line"),
                      coerce.coerce_int("qty_txt").alias("qty"),
                      coerce.decimal_comma("price_txt").alias("price"),
                      coerce.clean_text("flag_txt").alias("flag"))


# The lineitem domain used for validation (lists and inclusive ranges).
LINEITEM_DOMAIN = {
    "l_returnflag": ["A", "N", "R"],
    "l_linenumber": [1, 2, 3, 4, 5, 6],
    "l_quantity": (1.0, 45.0),
    "l_discount": (0.0, 0.08),
}


@query("validate_domain", """
WITH v AS (
  SELECT l_orderkey, l_linenumber,
         list_filter([
           CASE WHEN l_returnflag IN ('A','N','R') THEN NULL ELSE 'l_returnflag' END,
           CASE WHEN l_linenumber IN (1,2,3,4,5,6) THEN NULL ELSE 'l_linenumber' END,
           CASE WHEN l_quantity BETWEEN 1.0 AND 45.0 THEN NULL ELSE 'l_quantity' END,
           CASE WHEN l_discount BETWEEN 0.0 AND 0.08 THEN NULL ELSE 'l_discount' END], lambda x: x IS NOT NULL) AS vio
  FROM lineitem)
SELECT l_orderkey, l_linenumber, array_to_string(vio, ',') AS violations, CAST(len(vio) AS INTEGER) AS n_violations
FROM v WHERE len(vio) > 0
""")
def validate_domain(spark, sf):
    li = Tables(spark, sf).lineitem.select("l_orderkey", "l_linenumber", "l_returnflag",
                                           "l_quantity", "l_discount")
    v = clean.validate(li, LINEITEM_DOMAIN)
    return (v.filter(F.size("violations") > 0)
             .select("l_orderkey", "l_linenumber",
                     F.array_join("violations", ",").alias("violations"),
                     F.size("violations").alias("n_violations")))


@query("defaults_fill", """
SELECT p_partkey, p_size, 1 AS p_container, 1 AS p_mfgr FROM part
""")
def defaults_fill(spark, sf):
    part = Tables(spark, sf).part.select("p_partkey", "p_size")
    return clean.fill_absent(part, ["p_partkey", "p_size", "p_container", "p_mfgr"], default=1)


# Label -> code dictionary (one segment deliberately absent -> default 1).
SEGMENT_CODES = {"AUTOMOBILE": 1, "BUILDING": 2, "FURNITURE": 3, "HOUSEHOLD": 4}


@query("encode_lookup", """
SELECT c_custkey, c_mktsegment,
       COALESCE(CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2
                                  WHEN 'FURNITURE' THEN 3 WHEN 'HOUSEHOLD' THEN 4 END, 1) AS segment_code
FROM customer
""")
def encode_lookup(spark, sf):
    cust = Tables(spark, sf).customer.select("c_custkey", "c_mktsegment")
    out = clean.encode_lookup(cust, "c_mktsegment", SEGMENT_CODES, "segment_code", default=1)
    return out.withColumn("segment_code", F.col("segment_code").cast("int"))


#: Rows that ``merge_cap`` keeps; below the merge's size on the smallest tables but one.
CAP_ROWS = 20_000


def _merge_inputs(spark, sf):
    """Three tables on one key; orders of other states or priorities get keys of their own, which match nothing."""
    t = Tables(spark, sf)
    key = F.col("o_orderkey")
    caract = t.orders.select(F.when(F.col("o_orderstatus").isin("F", "O"), key).otherwise(-2 * key).alias("k"),
                             "o_orderstatus", "o_totalprice")
    usagers = t.lineitem.select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_quantity")
    lieux = t.orders.select(F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), key).otherwise(-2 * key - 1).alias("k"),
                            "o_orderpriority")
    return caract, usagers, lieux


_MERGE_SQL = """
SELECT COALESCE(a.k, b.k, c.k) AS k, a.o_orderstatus, a.o_totalprice, b.l_linenumber, b.l_quantity,
       c.o_orderpriority
FROM (SELECT CASE WHEN o_orderstatus IN ('F','O') THEN o_orderkey ELSE -2 * o_orderkey END AS k, o_orderstatus, o_totalprice
      FROM orders) a
FULL OUTER JOIN (SELECT l_orderkey AS k, l_linenumber, l_quantity FROM lineitem) b ON a.k = b.k
FULL OUTER JOIN (SELECT CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN o_orderkey ELSE -2 * o_orderkey - 1 END AS k,
                        o_orderpriority FROM orders) c ON COALESCE(a.k, b.k) = c.k
"""


@query("merge_outer", _MERGE_SQL)
def merge_outer(spark, sf):
    return merge.merge_outer(list(_merge_inputs(spark, sf)), "k")


@query("merge_cap", f"""
SELECT * FROM ({_MERGE_SQL}) m
ORDER BY k, o_orderstatus NULLS LAST, o_totalprice NULLS LAST, l_linenumber NULLS LAST,
         l_quantity NULLS LAST, o_orderpriority NULLS LAST
LIMIT {CAP_ROWS}
""")
def merge_cap(spark, sf):
    return merge.merge_cap(list(_merge_inputs(spark, sf)), "k", ["k", "o_orderstatus", "o_totalprice", "l_linenumber",
                                                                 "l_quantity", "o_orderpriority"], CAP_ROWS)


@query("header_clean", """
SELECT c_custkey, c_name, lower(replace(replace(c_mktsegment || ' top-tier', ' ', '_'), '-', '_')) AS gauge FROM customer
""")
def header_clean(spark, sf):
    """P3 + P5 + P17: blank-padded headers are cleaned, the needed columns checked, gauge names normalised."""
    raw = Tables(spark, sf).customer.select(F.col("c_custkey").alias(" c_custkey"), F.col("c_name").alias("c_name  "),
                                            F.concat("c_mktsegment", F.lit(" top-tier")).alias(" gauge "))
    t = raw.toDF(*coerce.clean_header(raw.columns))
    clean.require_columns(t, ["c_custkey", "c_name", "gauge"])
    return t.withColumn("gauge", coerce.normalize_name("gauge"))


@query("display_text", """
SELECT o_orderkey, printf('%.1f MiB', o_totalprice * 1000 / 1048576) AS size_text,
       replace(format('{:,}', CAST(trunc(o_totalprice) AS BIGINT)), ',', ' ') AS price_text FROM orders
""")
def display_text(spark, sf):
    """sizes in MiB and integers with blanks between thousands."""
    return Tables(spark, sf).orders.select("o_orderkey", labels.mib_text(F.col("o_totalprice") * 1000).alias("size_text"),
                                           labels.thousands("o_totalprice").alias("price_text"))


@query("merge_overlap", """
SELECT COALESCE(o.o_orderkey, l.l_orderkey) AS k, o.o_custkey, o.o_orderstatus, l.l_linenumber, l.l_quantity
FROM orders o FULL OUTER JOIN lineitem l ON o.o_orderkey = l.l_orderkey
""")
def merge_overlap(spark, sf):
    """A column that the left side has too is dropped from the right side before the merge."""
    t = Tables(spark, sf)
    left = t.orders.select(F.col("o_orderkey").alias("k"), "o_custkey", "o_orderstatus")
    right = t.lineitem.select(F.col("l_orderkey").alias("k"), F.lit("other").alias("o_orderstatus"), "l_linenumber", "l_quantity")
    return merge.merge_outer([left, right], "k")


# The scoring record's fields, drawn from the row's key; the last one is absent and gets the default.
_RECORD = {f: i + 1 for i, f in enumerate(SCORING_DOMAIN)}
_ABSENT = list(SCORING_DOMAIN)[-1]


def _record_sql() -> str:
    codes = ", ".join(f"CASE WHEN {SCORING_DEFAULT if f == _ABSENT else f'(l_orderkey * {i} + l_linenumber) % 12 - 1'} "
                      f"NOT IN ({', '.join(map(str, SCORING_DOMAIN[f]))}) THEN '{f}' END" for f, i in _RECORD.items())
    return f"""
SELECT l_orderkey, l_linenumber, array_to_string(list_filter([{codes}], lambda x: x IS NOT NULL), ',') AS violations,
       CAST({SCORING_DEFAULT} AS BIGINT) AS filled FROM lineitem"""


@query("scoring_record", _record_sql())
def scoring_record(spark, sf):
    """P13 + P14: the whole scoring record checked against its closed lists; an absent field gets the default."""
    key = F.col("l_orderkey")
    rows = Tables(spark, sf).lineitem.select("l_orderkey", "l_linenumber", *[
        ((key * i + F.col("l_linenumber")) % 12 - 1).alias(f) for f, i in _RECORD.items() if f != _ABSENT])
    whole = clean.fill_absent(rows, ["l_orderkey", "l_linenumber", *_RECORD], default=SCORING_DEFAULT)
    return clean.validate(whole, SCORING_DOMAIN).select(
        "l_orderkey", "l_linenumber", F.array_join("violations", ",").alias("violations"), F.col(_ABSENT).cast("bigint").alias("filled"))
