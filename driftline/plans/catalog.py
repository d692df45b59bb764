"""Catalog-table queries: replace load, metrics table, retention purge, estimated counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.plans.logs import LINES_SQL, RETENTION_DAYS, as_of, log_lines
from driftline.plans.registry import query
from driftline.session import scratch_path
from driftline.sources import catalog
from driftline.sources.tables import Tables
from driftline.sources.versions import VersionedTable


@query("table_replace", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders
""")
def table_replace(spark, sf):
    """K2: the second load replaces the first one whole."""
    orders = Tables(spark, sf).orders
    name = catalog.table_name(spark, "orders")
    catalog.replace_table(orders.filter(F.col("o_orderstatus") == "F"), name)
    return catalog.replace_table(orders, name)


@query("metrics_table", """
SELECT event_type AS metric, COUNT(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY event_type
""")
def metrics_table(spark, sf):
    """K3: a metrics table of another schema is dropped and replaced."""
    by_type = Tables(spark, sf).events.groupBy(F.col("event_type").alias("metric"))
    name = catalog.table_name(spark, "metrics")
    catalog.drop_and_replace(by_type.agg(F.max("ts").alias("newest")), name)
    return catalog.drop_and_replace(by_type.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean")), name)


@query("estimated_count", """
SELECT 'orders' AS table_name, COUNT(*) AS n, TRUE AS estimated FROM orders
UNION ALL SELECT 'customer', COUNT(*), FALSE FROM customer
""")
def estimated_count(spark, sf):
    """A2: orders are analysed, customer is not and falls back to the exact count."""
    t, rows = Tables(spark, sf), []
    for base, analysed in (("orders", True), ("customer", False)):
        name = catalog.table_name(spark, base)
        catalog.replace_table(getattr(t, base), name)
        if analysed:
            catalog.analyze(spark, name)
        rows.append((base, *catalog.estimated_count(spark, name)))
    return spark.createDataFrame(rows, "table_name string, n long, estimated boolean")


@query("log_purge", f"""
WITH {LINES_SQL}
SELECT event_id, ts, container_name, message FROM lines
WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL {RETENTION_DAYS} DAY
""")
def log_purge(spark, sf):
    """K8: the log table keeps the last days: older days leave the manifest, the cutoff's day is rewritten, in one step."""
    ev = Tables(spark, sf).events
    table = VersionedTable(spark, scratch_path(spark, "logs"))
    table.append_days(log_lines(ev).select("event_id", "ts", "container_name", "message", F.to_date("ts").alias("day")), "day")
    cutoff = as_of(ev) - F.make_dt_interval(days=F.lit(RETENTION_DAYS))
    return table.read(table.purge_before("ts", cutoff)).drop("day")
