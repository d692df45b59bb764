"""Sampling / split / bootstrap queries on orders (md5 draws shared with DuckDB)."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.functions.hashing import draw_sql
from driftline.operators import bootstrap, sampling
from driftline.plans.registry import query
from driftline.sources.tables import Tables

SALT = "driftline"
KEY = ["o_orderkey"]
BOOT_COLS = ["o_custkey", "o_orderpriority", "o_orderstatus", "o_totalprice"]

_D = draw_sql("o_orderkey", f"'{SALT}'")


@query("sample_exact", f"""
WITH x AS (SELECT *, {_D} AS d FROM orders),
r AS (SELECT *, row_number() OVER (ORDER BY d, o_orderkey) AS rn, COUNT(*) OVER () AS n FROM x)
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
FROM r WHERE rn <= round_even(n * 0.5, 0)
""")
def sample_exact(spark, sf):
    return sampling.sample_exact(Tables(spark, sf).orders, KEY, 0.5, SALT)


@query("sample_n", f"""
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
FROM orders ORDER BY {_D}, o_orderkey LIMIT 1000
""")
def sample_n(spark, sf):
    return sampling.sample_n(Tables(spark, sf).orders, KEY, 1000, SALT)


@query("split_random", f"""
WITH x AS (SELECT o_orderkey, o_orderstatus, {_D} AS d FROM orders),
r AS (SELECT *, row_number() OVER (ORDER BY d, o_orderkey) AS rn, COUNT(*) OVER () AS n FROM x)
SELECT o_orderkey, o_orderstatus, CASE WHEN rn <= ceil(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM r
""")
def split_random(spark, sf):
    o = Tables(spark, sf).orders.select("o_orderkey", "o_orderstatus")
    return sampling.split_random(o, KEY, 0.2, SALT)


@query("split_stratified", f"""
WITH x AS (SELECT o_orderkey, o_orderstatus, {_D} AS d FROM orders),
cc AS (SELECT o_orderstatus, COUNT(*) AS n_c FROM x GROUP BY 1),
a0 AS (SELECT o_orderstatus, n_c, sum(n_c) OVER () AS n, ceil(sum(n_c) OVER () * 0.2) AS nt FROM cc),
a1 AS (SELECT *, floor(n_c * nt / n) AS base, n_c * nt - floor(n_c * nt / n) * n AS rem FROM a0),
a2 AS (SELECT *, nt - sum(base) OVER () AS left_over,
              row_number() OVER (ORDER BY rem DESC, o_orderstatus) AS rk FROM a1),
alloc AS (SELECT o_orderstatus, base + CASE WHEN rk <= left_over THEN 1 ELSE 0 END AS k FROM a2),
r AS (SELECT x.*, row_number() OVER (PARTITION BY x.o_orderstatus ORDER BY d, o_orderkey) AS rn FROM x)
SELECT o_orderkey, r.o_orderstatus, CASE WHEN rn <= k THEN 'test' ELSE 'train' END AS split
FROM r JOIN alloc USING (o_orderstatus)
""")
def split_stratified(spark, sf):
    o = Tables(spark, sf).orders.select("o_orderkey", "o_orderstatus")
    return sampling.split_stratified(o, KEY, "o_orderstatus", 0.2, SALT)


def _source(spark, sf):
    o = Tables(spark, sf).orders
    return o.select("o_orderkey", "o_custkey", F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus"),
                    "o_totalprice", "o_orderpriority")


def _boot_sql(carriers: str) -> str:
    vals = "\n  UNION ALL ".join(
        f"SELECT '{c}' AS col, {('CAST(' + c + ' AS DOUBLE)') if c in ('o_custkey', 'o_totalprice') else 'NULL::DOUBLE'} AS vnum, "
        f"{('CAST(' + c + ' AS VARCHAR)') if c not in ('o_custkey', 'o_totalprice') else 'NULL::VARCHAR'} AS vstr "
        f"FROM src WHERE {c} IS NOT NULL" for c in BOOT_COLS)
    cols = ", ".join(f"('{c}')" for c in BOOT_COLS)
    d = draw_sql("car.o_orderkey", "car.col", f"'{SALT}'")
    return f"""
src AS (SELECT o_orderkey, o_custkey, NULLIF(o_orderstatus, 'P') AS o_orderstatus, o_totalprice, o_orderpriority
        FROM orders),
vals AS ({vals}),
idx AS (SELECT col, vnum, vstr, row_number() OVER (PARTITION BY col ORDER BY vnum, vstr) - 1 AS i,
               COUNT(*) OVER (PARTITION BY col) AS n FROM vals),
car AS (SELECT c.o_orderkey, t.col FROM ({carriers}) c, (VALUES {cols}) t(col)),
drawn AS (SELECT car.o_orderkey, car.col, {d} % s.n AS i
          FROM car JOIN (SELECT DISTINCT col, n FROM idx) s ON car.col = s.col),
boot AS (SELECT o_orderkey,
       max(CASE WHEN col = 'o_custkey' THEN CAST(vnum AS BIGINT) END) AS o_custkey,
       max(CASE WHEN col = 'o_orderpriority' THEN vstr END) AS o_orderpriority,
       max(CASE WHEN col = 'o_orderstatus' THEN vstr END) AS o_orderstatus,
       max(CASE WHEN col = 'o_totalprice' THEN vnum END) AS o_totalprice
  FROM drawn JOIN idx USING (col, i) GROUP BY o_orderkey)"""


@query("bootstrap_columns", f"""
WITH {_boot_sql("SELECT o_orderkey FROM orders")}
SELECT * FROM boot
""")
def bootstrap_columns(spark, sf):
    src = _source(spark, sf)
    return bootstrap.bootstrap_columns(src.select(*KEY), src, KEY, BOOT_COLS, SALT)


@query("synthetic_mix", f"""
WITH x AS (SELECT o_orderkey, {_D} AS d FROM orders),
r AS (SELECT o_orderkey, row_number() OVER (ORDER BY d, o_orderkey) AS rn, COUNT(*) OVER () AS n FROM x),
sel AS (SELECT o_orderkey, rn <= round_even(n * 0.5, 0) AS selected FROM r),
{_boot_sql("SELECT o_orderkey FROM sel WHERE NOT selected")}
SELECT s.o_orderkey, s.o_custkey, s.o_orderpriority, s.o_orderstatus, s.o_totalprice, 'real' AS provenance
FROM src s JOIN sel USING (o_orderkey) WHERE selected
UNION ALL
SELECT o_orderkey, o_custkey, o_orderpriority, o_orderstatus, o_totalprice, 'synthetic' AS provenance FROM boot
""")
def synthetic_mix(spark, sf):
    return bootstrap.synthetic_mix(_source(spark, sf), KEY, BOOT_COLS, SALT, 0.5)


_DUP_KEY = ["l_orderkey", "l_linenumber"]
_DUP_COLS = ["l_shipdate", "l_quantity", "l_partkey_wide", "l_returnflag"]
_WIDE = "l_partkey + 9007199254740993"  # beyond what a double holds exactly
_DUP_D = draw_sql("l_orderkey", "l_linenumber", f"'{SALT}'")


@query("synthetic_mix_dupkeys", f"""
WITH s AS (SELECT l_orderkey, l_linenumber, l_shipdate, l_quantity, {_WIDE} AS l_partkey_wide, l_returnflag FROM lineitem),
r AS (SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY {_DUP_D}, l_orderkey, l_linenumber) AS rn, COUNT(*) OVER () AS n FROM s),
c AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey, l_linenumber) AS nth FROM r WHERE rn > round_even(n * 0.5, 0)),
{", ".join(f"v_{c} AS (SELECT {c} AS v, row_number() OVER (ORDER BY {c}) - 1 AS i, COUNT(*) OVER () AS m FROM s WHERE {c} IS NOT NULL)" for c in _DUP_COLS)},
b AS (SELECT c.*, {", ".join(f"{draw_sql('l_orderkey', 'l_linenumber', 'nullif(nth, 1)', chr(39) + c + chr(39), chr(39) + SALT + chr(39))} % (SELECT max(m) FROM v_{c}) AS i_{c}" for c in _DUP_COLS)} FROM c)
SELECT {", ".join(f"v_{c}.v AS {c}" for c in _DUP_COLS)} FROM b {" ".join(f"JOIN v_{c} ON v_{c}.i = i_{c}" for c in _DUP_COLS)}
""")
def synthetic_mix_dupkeys(spark, sf):
    """R3 on a key that repeats, with a timestamp and integers beyond 2^53: the synthetic half."""
    li = Tables(spark, sf).lineitem.withColumn("l_partkey_wide", F.expr(_WIDE))
    out = bootstrap.synthetic_mix(li.select(*_DUP_KEY, *_DUP_COLS), _DUP_KEY, _DUP_COLS, SALT, 0.5)
    return out.filter("provenance = 'synthetic'").select(*_DUP_COLS)
