"""Keeping tables up to date: latest rows, merges, deletes, staleness, expiry, drift and deltas between snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import latest_by

#: Score change that counts as drift and role change.
SCORE_DRIFT, ROLE_DRIFT, REBUILD_BUILDS, REBUILD_DAYS, REBUILD_SHARE = 0.01, 0.05, 100, 7, 0.25


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the latest by ``order``."""
    return latest_by(df, keys, order)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str] = (), keep_empty: list[str] = ()) -> DataFrame:
    """``old`` overlaid with ``new``: a null in a ``keep`` column and an empty text in a ``keep_empty`` one leave the old value."""
    a, b = old.alias("a"), new.alias("b")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    on = same[0]
    for s in same[1:]:
        on = on & s
    x = a.withColumn("__a", F.lit(True)).alias("a").join(b.withColumn("__b", F.lit(True)).alias("b"), on, "full_outer")
    is_new = F.col("b.__b").isNotNull()

    def value(c: str):
        o, n = F.col(f"a.{c}"), F.col(f"b.{c}")
        if c in keys:
            return F.coalesce(n, o)
        if c in keep:
            return F.when(is_new, F.coalesce(n, o)).otherwise(o)
        if c in keep_empty:
            return F.when(is_new & (n != ""), n).otherwise(F.coalesce(o, n))
        return F.when(is_new, n).otherwise(o)

    return x.select(*[value(c).alias(c) for c in old.columns])


def replace_groups(old: DataFrame, new: DataFrame, group: list[str]) -> DataFrame:
    """``old`` with all rows of every group that ``new`` has replaced."""
    return old.join(new.select(*group).distinct(), group, "left_anti").unionByName(new)


def cascade(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows whose named column is among the ``key`` values that are gone."""
    return {name: df.join(gone.select(F.col("key").alias(c)).distinct(), c, "left_anti") for name, (df, c) in tables.items()}


def stale(rows: DataFrame, derived: DataFrame, key: str, version: str) -> DataFrame:
    """Keys of ``rows`` whose derived row is missing or of another version."""
    d = derived.select(key, F.col(version).alias("__v"), F.lit(True).alias("__there"))
    return rows.join(d, key, "left").where(F.col("__there").isNull() | ~F.col(version).eqNullSafe(F.col("__v"))).select(key)


def hash_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, status): added, removed or changed by hash; both sides path, hash."""
    x = old.select("path", F.col("hash").alias("a"), F.lit(1).alias("in_old")).join(new.select("path", F.col("hash").alias("b"), F.lit(1).alias("in_new")), "path", "full_outer")
    status = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return x.select("path", status.alias("status")).where("status IS NOT NULL")


def refresh_plan(diff: DataFrame, files: DataFrame, barrels: DataFrame) -> DataFrame:
    """One row (changed, total, full): rebuild in full when a quarter of the files changed or a barrel did, else in part."""
    n = diff.agg(F.count("*").alias("changed"))
    hit = diff.join(barrels.select("path").distinct(), "path", "left_semi").agg(F.count("*").alias("barrels"))
    total = files.agg(F.count("*").alias("total"))
    x = n.select("changed", total.scalar().alias("total"), hit.scalar().alias("barrels"))
    return x.select("changed", "total", ((F.col("barrels") > 0) | (F.col("changed") >= REBUILD_SHARE * F.col("total"))).alias("full"))


def incremental(old: DataFrame, new: DataFrame, diff: DataFrame) -> DataFrame:
    """Edges after a partial rebuild: those of untouched files kept, those of added and changed files from ``new``."""
    kept = old.join(diff.select(F.col("path").alias("src")), "src", "left_anti")
    fresh = new.join(diff.where("status <> 'removed'").select(F.col("path").alias("src")), "src", "left_semi")
    return kept.unionByName(fresh)


def unexpired(cache: DataFrame, now: int) -> DataFrame:
    """Entries without end or that end after ``now``, in epoch seconds."""
    return cache.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows only in one of two snapshots, repeated ones counted: all columns and side."""
    return old.exceptAll(new).withColumn("side", F.lit("gone")).unionByName(new.exceptAll(old).withColumn("side", F.lit("new")))


def drift(old: DataFrame, new: DataFrame, key: str, score: str, least: float = SCORE_DRIFT) -> DataFrame:
    """(key, before, after, change) of keys whose score moved more than ``least``; a missing side counts 0."""
    x = old.select(key, F.col(score).alias("before")).join(new.select(key, F.col(score).alias("after")), key, "full_outer")
    x = x.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("before", "after")})
    return x.withColumn("change", F.col("after") - F.col("before")).where(F.abs("change") > least)
