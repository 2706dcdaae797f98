"""Building blocks that every operator family uses: latest-wins, skew-safe joins, durable cuts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref
import zipfile
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A key that holds more than 1/HOT_PARTS of all rows is hot; there can be fewer than HOT_PARTS such keys.
HOT_PARTS = 256
#: Into so many pieces a hot key is spread.
SALTS = 64
#: A stats table of up to so many rows is broadcast.
BROADCAST_ROWS = 10_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the parquet tables of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the one with the greatest ``order``; nulls rank lowest, equal rows are told apart by hash.

    An aggregate, so each map task sends one row per key however often the key repeats.
    """
    rest = [c for c in df.columns if c not in keys]
    hashed = [c for c in rest if not df.schema[c].dataType.simpleString().startswith(("map", "variant"))]
    rank = F.struct(*[F.col(c) for c in order], F.xxhash64(*hashed))
    out = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("__row"))
    return out.select(*keys, *[F.col(f"__row.`{c}`").alias(c) for c in rest])


def join_stats(rows: DataFrame, stats: DataFrame, keys: list[str], weight: str, spread: list[str]) -> DataFrame:
    """Inner join of many rows with the stats of their key, safe for hot keys.

    ``weight`` is the column of ``stats`` with the number of rows of the key, the same in all its stats rows. The stats are written once and their size is
    checked: up to BROADCAST_ROWS rows are broadcast, so ``rows`` are not shuffled. Beyond that, keys above 1/HOT_PARTS of
    the total weight (fewer than HOT_PARTS by arithmetic) are spread over SALTS pieces chosen by the hash of the ``spread``
    columns of ``rows``, and their stats row is copied SALTS times. Rows with a null key are dropped.
    """
    kept = durable(stats)
    n, total, most = kept.agg(F.count("*"), F.sum(weight), F.max(weight)).first()
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(kept), keys)
    if not total or most * HOT_PARTS <= total:
        return rows.join(kept, keys)
    is_hot = F.col(weight) * HOT_PARTS > total
    hot = kept.where(is_hot).select(*keys, F.lit(True).alias("__hot")).distinct()
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(*spread), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = rows.join(F.broadcast(hot), keys, "left").withColumn("__salt", salt).drop("__hot")
    return left.join(kept.withColumn("__salt", F.explode(copies)), [*keys, "__salt"]).drop("__salt")


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows as a table below the checkpoint folder that the cluster names, and read them again.

    All executors share that folder, so a lost executor loses nothing. A folder of our own is set only where none is
    configured, as in local tests. What is durable already is returned as it is. Tables stay until ``discard`` or the end
    of the application.
    """
    if id(df) in _tables and _tables[id(df)][0]() is df:
        return df
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="sparkloom-checkpoint-"))
    path = f"{sc._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _tables[id(out)] = (weakref.ref(out), path)
    if not _paths:
        atexit.register(_remove_all, sc)
    _paths.add(path)
    return out


#: The durable DataFrames alive, by identity, and the folders of all durable tables not yet removed.
_tables: dict[int, tuple[weakref.ref, str]] = {}
_paths: set[str] = set()


def discard(*tables: DataFrame) -> None:
    """Remove durable tables that nothing will read any more, such as those of the round before last; others are left alone."""
    for df in tables:
        known = _tables.pop(id(df), None)
        if known and known[0]() is df:
            _remove(df.sparkSession.sparkContext, known[1])


def _remove(sc: SparkContext, path: str) -> None:
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
    _paths.discard(path)


def _remove_all(sc: SparkContext) -> None:
    for path in list(_paths):
        try:
            _remove(sc, path)
        except Exception:  # noqa: BLE001  the gateway is gone; the folder is the cluster's to clean
            return


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application, so that functions of its modules can run there."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        here = Path(__file__).parent
        archive = Path(tempfile.mkdtemp(prefix="sparkloom-ship-"), "sparkloom_package.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(here.rglob("*.py")):
                z.write(f, f.relative_to(here.parent))
        sc.addPyFile(str(archive))
        _shipped.add(sc.applicationId)


_shipped: set[str] = set()


def blank_to_null(c: Column) -> Column:
    """Null for text without a character other than blanks."""
    return F.when(F.length(F.trim(c)) > 0, c)


def running_sum(df: DataFrame, keys: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` (null counts 0) over the rows of the key up to this one, under a total ``order``.

    Rows are range-partitioned by key and order, so a key of any size is spread over many tasks. Sums are made inside
    (key, partition) groups; a partition border cuts at most one key, so the offsets of keys that span borders are fewer
    than the partitions and may be broadcast. The range layout is written once: every later read and every recomputation
    then sees the same borders.
    """
    of_key = [F.col(k) for k in keys]
    laid = durable(df.withColumn("__v", F.coalesce(value, F.lit(0))).repartitionByRange(*of_key, *order).withColumn("__pid", F.spark_partition_id()))
    sums = laid.groupBy(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__pid").alias("__part")).agg(F.sum("__v").alias("__s"))
    before = W.partitionBy(*[f"__{k}" for k in keys]).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.withColumn("__before", F.sum("__s").over(before)).where("__before IS NOT NULL").drop("__s")
    same = F.col("__pid") == F.col("__part")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    joined = laid.join(F.broadcast(offsets), same, "left")
    inside = F.sum("__v").over(W.partitionBy(*keys, "__pid").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return joined.withColumn(name, inside + F.coalesce(F.col("__before"), F.lit(0))).select(*df.columns, name)


def positions(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """``df`` with ``name``: the 0-based place of each row among those of its key, under a total ``order``; see running_sum."""
    return running_sum(df, keys, order, F.lit(1).cast("bigint"), name).withColumn(name, F.col(name) - 1)
