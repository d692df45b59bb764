"""File round trips: delimited write/read and the too-many-fields line filter.

Outputs go to fresh folders below the session's checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.plans.registry import query
from driftline.schemas import TABLES
from driftline.session import cut_lineage, scratch_path
from driftline.sources import delimited
from driftline.sources.tables import Tables

ORDER_COLS = [f.name for f in TABLES["orders"].fields]


@query("csv_roundtrip", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders
""")
def csv_roundtrip(spark, sf):
    path = scratch_path(spark, "orders_csv")
    delimited.write_delimited(Tables(spark, sf).orders, path, sep=";")
    return delimited.read_delimited(spark, path, TABLES["orders"], sep=";")


def _lines(spark, sf):
    """Orders as ';' text lines: status P lines carry one surplus field, 5-LOW lines lack the last field."""
    o = Tables(spark, sf).orders
    fields = [F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), F.col("o_orderstatus"),
              F.col("o_totalprice").cast("string"), F.date_format("o_orderdate", delimited.TIMESTAMP_FORMAT)]
    full = F.concat_ws(";", *fields, F.col("o_orderpriority"))
    line = (F.when(F.col("o_orderstatus") == "P", F.concat_ws(";", full, F.lit("")))
             .when(F.col("o_orderpriority") == "5-LOW", F.concat_ws(";", *fields))
             .otherwise(full))
    return o.select(line.alias("value"))


@query("csv_bad_lines", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate,
       CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END AS o_orderpriority
FROM orders WHERE o_orderstatus <> 'P'
""")
def csv_bad_lines(spark, sf):
    path = scratch_path(spark, "orders_lines")
    _lines(spark, sf).write.mode("overwrite").text(path)
    t = delimited.read_skip_long_lines(spark, path, ORDER_COLS, sep=";")
    return t.select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"),
                    F.col("o_custkey").cast("bigint").alias("o_custkey"), "o_orderstatus",
                    F.col("o_totalprice").cast("double").alias("o_totalprice"),
                    F.to_timestamp("o_orderdate", delimited.TIMESTAMP_FORMAT).alias("o_orderdate"),
                    "o_orderpriority")


@query("csv_header_lines", """
SELECT o_orderkey, 'café; ' || o_orderpriority AS note, o_orderstatus FROM orders WHERE o_orderstatus <> 'P'
""")
def csv_header_lines(spark, sf):
    """Latin-1 lines with a header, a quoted separator in each, and a surplus field on status P lines."""
    line = F.concat(F.col("o_orderkey").cast("string"), F.lit(';"café; '), F.col("o_orderpriority"), F.lit('";'),
                    F.col("o_orderstatus"), F.when(F.col("o_orderstatus") == "P", ";surplus").otherwise(""))
    path = scratch_path(spark, "orders_header_lines")
    # one column without quoting: the lines are written as they are
    (Tables(spark, sf).orders.select(line.alias("o_orderkey;note;o_orderstatus"))
     .write.option("header", True).option("quote", "").option("sep", "\x01").option("encoding", "ISO-8859-1").csv(path))
    t = delimited.read_skip_long_lines(spark, path, sep=";", header=True, encoding="ISO-8859-1")
    return t.select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), "note", "o_orderstatus")


SPLIT_BYTES = 1 << 16


@query("csv_quoted_breaks", """
SELECT CASE WHEN o_orderkey % 50 = 7 THEN 'key' ELSE CAST(o_orderkey AS VARCHAR) END AS key,
       CASE WHEN o_orderkey % 50 = 7 THEN 'note'
            WHEN o_orderkey % 3 = 0 THEN 'first; line' || chr(10) || 'second "' || o_orderpriority || '" line' || chr(10) || chr(10) || 'end'
            WHEN o_orderkey % 3 = 1 THEN o_orderpriority ELSE NULL END AS note,
       CASE WHEN o_orderkey % 50 = 7 THEN 'status' WHEN o_orderkey % 3 = 2 THEN NULL ELSE o_orderstatus END AS status
FROM orders WHERE o_orderkey % 50 = 7 OR o_orderkey % 11 <> 0
""")
def csv_quoted_breaks(spark, sf):
    """S2 with line breaks, separators and quotes inside quoted fields, over several splits of each file: surplus fields are
    skipped, short records padded, and data rows that read like the header are kept."""
    o = Tables(spark, sf).orders
    key, quote = F.col("o_orderkey").cast("string"), F.lit('"')
    note = F.concat(quote, F.lit('first; line\nsecond ""'), "o_orderpriority", F.lit('"" line\n\nend'), quote)
    record = (F.when(F.col("o_orderkey") % 3 == 0, F.concat_ws(";", key, note, "o_orderstatus"))
              .when(F.col("o_orderkey") % 3 == 1, F.concat_ws(";", key, "o_orderpriority", "o_orderstatus")).otherwise(key))
    record = F.when(F.col("o_orderkey") % 11 == 0, F.concat(record, F.lit(';;;x;"y\nz"'))).otherwise(record)
    record = F.when(F.col("o_orderkey") % 50 == 7, F.lit("key;note;status")).otherwise(record)
    path = scratch_path(spark, "quoted")
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0  # every file begins with the header
    o.select(F.when(first, F.concat(F.lit("key;note;status\n"), record)).otherwise(record).alias("value")).write.text(f"{path}/files")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(SPLIT_BYTES))
    try:
        return cut_lineage(delimited.read_skip_long_lines(spark, f"{path}/files", sep=";", header=True, breaks=True))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


@query("encoding_fallback", """
SELECT p_partkey, 'pièce ' || p_name AS label FROM part
""")
def encoding_fallback(spark, sf):
    """S3: a Latin-1 file is found not to be UTF-8 and read as Latin-1."""
    part = Tables(spark, sf).part.select("p_partkey", F.concat(F.lit("pièce "), "p_name").alias("label"))
    path = scratch_path(spark, "part_latin1")
    delimited.write_delimited(part, path, encoding="ISO-8859-1")
    return delimited.read_with_encoding_fallback(spark, path, part.schema)


@query("year_files", """
SELECT o_orderkey, o_totalprice, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders
""")
def year_files(spark, sf):
    """One folder of files per year, read as one table with the year of the name."""
    orders = Tables(spark, sf).orders.select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("file_year"))
    path = scratch_path(spark, "orders_by_year")
    orders.write.partitionBy("file_year").option("sep", ";").option("header", True).csv(path)
    years = [r[0] for r in orders.select("file_year").distinct().collect()]  # one row per year
    return delimited.year_family(spark, f"{path}/file_year={{year}}", sorted(years), orders.drop("file_year").schema)
