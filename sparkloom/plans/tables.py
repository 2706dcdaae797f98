"""Queries that keep tables up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import maintenance as M
from ..shared import table as t
from .registry import query

_LATEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY updated_at DESC NULLS LAST) rn FROM files WHERE path IS NOT NULL) WHERE rn = 1"
_OLD = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY updated_at NULLS LAST) rn FROM files WHERE path IS NOT NULL) WHERE rn = 1"


def _slices(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Orders before 1995 and until 1996 as two snapshots of (customer, priority)."""
    o = t(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderdate")
    cut = lambda y: o.where(F.col("o_orderdate") < F.lit(f"{y}-01-01").cast("timestamp")).select("o_custkey", "o_orderpriority")
    return cut(1995), cut(1996)


@query(f"SELECT path, \"role\", layer, hash FROM ({_LATEST})")
def latest_wins(spark: SparkSession, d: str) -> DataFrame:
    """Latest row of every file."""
    return M.latest(t(spark, d, "files").where("path IS NOT NULL").select("path", "role", "layer", "hash", "updated_at"), ["path"], ["updated_at"]).drop("updated_at")


@query("""WITH a AS (SELECT c_custkey k, c_name n, c_mktsegment s FROM customer WHERE c_custkey % 3 <> 0), b AS (SELECT c_custkey k, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE lower(c_name) END n, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'NEW' END s FROM customer WHERE c_custkey % 4 <> 0)
  SELECT coalesce(a.k, b.k) k, CASE WHEN b.k IS NOT NULL AND b.n <> '' THEN b.n ELSE coalesce(a.n, b.n) END n, CASE WHEN b.k IS NOT NULL THEN coalesce(b.s, a.s) ELSE a.s END s FROM a FULL JOIN b ON a.k = b.k""")
def upsert(spark: SparkSession, d: str) -> DataFrame:
    """Customers overlaid, empty names and null segments leaving the old value."""
    c = t(spark, d, "customer")
    k = F.col("c_custkey")
    old = c.where(k % 3 != 0).select(k.alias("k"), F.col("c_name").alias("n"), F.col("c_mktsegment").alias("s"))
    new = c.where(k % 4 != 0).select(k.alias("k"), F.when(k % 2 == 0, "").otherwise(F.lower("c_name")).alias("n"), F.when(k % 5 == 0, None).otherwise(F.lit("NEW")).alias("s"))
    return M.upsert(old, new, ["k"], keep=["s"], keep_empty=["n"])


@query(f"SELECT path FROM ({_LATEST}) n WHERE NOT EXISTS (SELECT 1 FROM (SELECT * FROM ({_OLD}) WHERE \"role\" IS NOT NULL) o WHERE o.path = n.path AND o.hash IS NOT DISTINCT FROM n.hash)")
def stale_rows(spark: SparkSession, d: str) -> DataFrame:
    """Files whose oldest row, as a derived table without roleless rows, is missing or of another hash."""
    f = t(spark, d, "files").where("path IS NOT NULL")
    new = M.latest(f.select("path", "hash", "updated_at"), ["path"], ["updated_at"])
    old = f.select("path", "hash", "role", F.col("updated_at").alias("u")).groupBy("path").agg(F.min_by(F.struct("hash", "role"), "u").alias("x")).select("path", "x.hash", "x.role").where("role IS NOT NULL")
    return M.stale(new, old, "path", "hash")


@query("WITH a AS (SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderdate < '1995-01-01'), b AS (SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderdate < '1996-01-01') SELECT *, 'gone' side FROM (FROM a EXCEPT ALL FROM b) UNION ALL SELECT *, 'new' FROM (FROM b EXCEPT ALL FROM a)")
def snapshot_delta(spark: SparkSession, d: str) -> DataFrame:
    """Rows that differ between two date slices of orders."""
    return M.delta(*_slices(spark, d))


@query("WITH s AS (SELECT o_custkey k, o_orderdate < '1995-01-01' early, round(o_totalprice * 100)::BIGINT p FROM orders), a AS (SELECT k, sum(p)::DOUBLE / count(*) / 100 v FROM s WHERE early GROUP BY 1), b AS (SELECT k, sum(p)::DOUBLE / count(*) / 100 v FROM s GROUP BY 1) SELECT k, coalesce(a.v, 0) before, coalesce(b.v, 0) AS after, coalesce(b.v, 0) - coalesce(a.v, 0) AS change FROM a FULL JOIN b USING (k) WHERE abs(coalesce(b.v, 0) - coalesce(a.v, 0)) > 0.01")
def drift(spark: SparkSession, d: str) -> DataFrame:
    """Customers whose mean order value moved between two slices."""
    o = t(spark, d, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")  # whole numbers, so that no order of rows changes a mean
    mean = lambda x: x.groupBy(F.col("o_custkey").alias("k")).agg((F.sum(cents) / F.count("*") / 100).alias("v"))
    return M.drift(mean(o.where(F.col("o_orderdate") < F.lit("1995-01-01").cast("timestamp"))), mean(o), "k", "v")


@query("WITH x AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE floor(epoch(ts))::BIGINT + event_id END expires_at, (SELECT floor(epoch(max(ts)))::BIGINT FROM events) now FROM events) SELECT event_id, expires_at FROM x WHERE expires_at IS NULL OR expires_at > now")
def ttl_cache(spark: SparkSession, d: str) -> DataFrame:
    """Events as cache entries that have not expired at the last event."""
    e = t(spark, d, "events")
    now = e.agg(F.max(F.unix_seconds(F.col("ts").cast("timestamp")))).first()[0] or 0
    x = e.select("event_id", F.when(F.col("event_id") % 3 == 0, None).otherwise(F.unix_seconds(F.col("ts").cast("timestamp")) + F.col("event_id")).alias("expires_at"))
    return M.unexpired(x, now)


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    """Lines left after closed orders are deleted."""
    gone = t(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("key"))
    return M.cascade({"lineitem": (t(spark, d, "lineitem"), "l_orderkey")}, gone)["lineitem"].select("l_orderkey", "l_linenumber")


@query("SELECT c_custkey k, CASE WHEN c_custkey % 10 = 1 THEN 'replaced' ELSE c_mktsegment END s FROM customer WHERE c_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_custkey % 10 = 1 AND c_nationkey < 5) UNION ALL SELECT c_custkey, 'new' FROM customer WHERE c_custkey % 10 = 1 AND c_nationkey < 5")
def replace_groups(spark: SparkSession, d: str) -> DataFrame:
    """Customers of some nations replaced as groups."""
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_nationkey", F.when(F.col("c_custkey") % 10 == 1, "replaced").otherwise(F.col("c_mktsegment")).alias("s"))
    new = c.where("k % 10 = 1 AND c_nationkey < 5").withColumn("s", F.lit("new"))
    return M.replace_groups(c, new, ["c_nationkey"]).select("k", "s")


_DIFF = f"diff AS (SELECT path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' WHEN o.hash IS DISTINCT FROM n.hash THEN 'changed' END status FROM (SELECT path, hash FROM ({_OLD}) WHERE length(path) % 5 <> 0) o FULL JOIN (SELECT path, hash FROM ({_LATEST}) WHERE length(path) % 7 <> 0) n USING (path))"


@query(f"WITH {_DIFF} SELECT path, status FROM diff WHERE status IS NOT NULL")
def hash_diff(spark: SparkSession, d: str) -> DataFrame:
    """Files added, removed or changed between their oldest and latest rows."""
    f = t(spark, d, "files").where("path IS NOT NULL")
    new = M.latest(f.select("path", "hash", "updated_at"), ["path"], ["updated_at"]).where(F.length("path") % 7 != 0)
    old = f.groupBy("path").agg(F.min_by("hash", "updated_at").alias("hash")).where(F.length("path") % 5 != 0)
    return M.hash_diff(old, new)
