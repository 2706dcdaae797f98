"""Stand-ins: the supplied tables as the graphs, histories and documents that the operators take; DataFrame and SQL side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.paths import plain_paths
from ..shared import latest_by
from ..shared import table as t


def trade_volumes(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst, revenue, orders): supplier nation to customer nation, own nation left out.

    Revenue is summed in whole ten-thousandths, so that no order of rows changes it, by supplier and customer before the nations are joined, so the wide join meets pre-aggregated rows.
    """
    line = t(spark, d, "lineitem").select("l_orderkey", "l_suppkey", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 10_000).cast("bigint").alias("r"))
    orders = t(spark, d, "orders").select("o_orderkey", "o_custkey")
    by = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_suppkey", "o_custkey").agg(F.sum("r").alias("r"), F.count("*").alias("n"))
    sup = t(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("src"))
    cus = t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("dst"))
    return by.join(sup, "l_suppkey").join(cus, "o_custkey").where("src <> dst").groupBy("src", "dst").agg((F.sum("r") / 10_000).alias("revenue"), F.sum("n").alias("orders"))


def trade_graph(spark: SparkSession, d: str, top: int = 3) -> DataFrame:
    """(graph_id, src, dst, weight): the ``top`` customers of each supplier nation by revenue, weight its share among them."""
    order = W.partitionBy("src").orderBy(F.col("revenue").desc(), "dst")
    kept = trade_volumes(spark, d).withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= top)
    share = F.col("revenue") / F.sum("revenue").over(W.partitionBy("src"))
    return kept.select(F.lit("trade").alias("graph_id"), F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), share.alias("weight"), "revenue")


VOLUMES = """
volumes AS (SELECT s_nationkey src, c_nationkey dst, sum(round(l_extendedprice * (1 - l_discount) * 10000)::BIGINT) / 10000 revenue, count(*) orders
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey WHERE s_nationkey <> c_nationkey GROUP BY ALL)"""
TRADE = (
    VOLUMES
    + """,
top3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY revenue DESC, dst) rn FROM volumes) WHERE rn <= 3),
edges AS (SELECT src::VARCHAR src, dst::VARCHAR dst, revenue, revenue / sum(revenue) OVER (PARTITION BY src) weight FROM top3),
nodes AS (SELECT src id FROM edges UNION SELECT dst FROM edges)"""
)


def history(spark: SparkSession, d: str) -> DataFrame:
    """(graph_id, hash, ts, message, files): each commit once, plain sorted file paths; commits without time are left out."""
    raw = t(spark, d, "commits").where("graph_id IS NOT NULL AND hash IS NOT NULL")
    plain = raw.select("graph_id", "hash", "ts", "message", "ingested_at", plain_paths(F.col("files")).alias("files"))
    return latest_by(plain, ["graph_id", "hash"], ["ts", "ingested_at"]).drop("ingested_at").where("ts IS NOT NULL")


PLAIN = r"nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(regexp_replace({0}, '^\s+|\s+$', '', 'g'), chr(92), '/'), '/(\.?/)+', '/', 'g'), '^(\./)+|/\.?$|^\.$', '', 'g'), '^/workspace(/|$)', ''), '^/', ''), '')"
HISTORY = f"""
raw AS (SELECT *, row_number() OVER (PARTITION BY graph_id, hash ORDER BY ts DESC NULLS LAST, ingested_at DESC NULLS LAST) rn FROM commits WHERE graph_id IS NOT NULL AND hash IS NOT NULL),
log AS (SELECT graph_id, hash, ts, first_value(message) OVER (PARTITION BY graph_id, hash) message, files FROM raw WHERE rn = 1 AND ts IS NOT NULL),
touched AS (SELECT DISTINCT graph_id, hash, ts, f FROM (SELECT graph_id, hash, ts, {PLAIN.replace('{0}', 'f')} f FROM (SELECT graph_id, hash, ts, unnest(files) f FROM log)) WHERE f IS NOT NULL),
width AS (SELECT graph_id, hash, count(*) width FROM touched GROUP BY ALL)"""
