"""Items that appear together: pair counts by large-basket blocking, and association scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import plain_path, plain_paths
from ..shared import durable, join_stats, latest_by

#: Items of a chunk; a basket with more is split, and its chunk pairs are sent to tasks of their own.
CHUNK = 32


def _pairs_within(items: Column) -> Column:
    """All (a, b) with a before b of one sorted array."""
    tail = lambda a, i: F.transform(F.slice(items, i + 2, F.size(items)), lambda b: F.struct(a.alias("a"), b.alias("b")))
    return F.flatten(F.transform(items, tail))


def basket_chunks(baskets: DataFrame, basket: list[str], items: str, chunk: int = CHUNK) -> DataFrame:
    """(basket columns, i, m, chunk): the m pieces of up to ``chunk`` items of each basket; ``items`` is sorted and distinct."""
    starts = F.sequence(F.lit(0), F.size("items") - 1, F.lit(chunk))
    cut = F.transform(starts, lambda s: F.slice("items", s + 1, F.lit(chunk)))
    pieces = baskets.select(*basket, F.col(items).alias("items")).where(F.size("items") > 0).select(*basket, cut.alias("pieces"))
    return pieces.select(*basket, F.size("pieces").alias("m"), F.posexplode("pieces").alias("i", "chunk"))


def chunk_products(chunks: DataFrame, basket: list[str]) -> DataFrame:
    """(left, right): every two different pieces of each basket, i before j, dealt out over tasks.

    ``chunks`` is durable and spread by (basket, i). A piece is told only the numbers of its partners, at most m small rows,
    and meets them by a join on (basket, j), so that neither a whole basket nor all its products are ever in one task.
    """
    partners = F.explode(F.sequence(F.col("i") + 1, F.col("m") - 1)).alias("j")
    left = chunks.where("i < m - 1").select(*basket, F.col("chunk").alias("left"), partners)
    right = chunks.where("i > 0").select(*basket, F.col("i").alias("j"), F.col("chunk").alias("right"))
    return left.join(right, [*basket, "j"]).select("left", "right")


def basket_pairs(baskets: DataFrame, basket: list[str], items: str, chunk: int = CHUNK) -> DataFrame:
    """(a, b), a < b, one row per basket in which both items occur.

    ``items`` is a sorted array of distinct items and ``basket`` the columns that tell baskets apart. Baskets up to ``chunk``
    items are expanded where they are. Larger ones are cut into pieces that are spread over the tasks; pairs inside a
    piece come from it, those between two pieces from their product. Baskets under two items give nothing.
    """
    small = baskets.where(F.size(items).between(2, chunk)).select(F.explode(_pairs_within(F.col(items))).alias("p"))
    pieces = basket_chunks(baskets.where(F.size(items) > chunk), basket, items, chunk)
    large = durable(pieces.repartition(*[F.col(c) for c in basket], F.col("i")))
    inside = large.select(F.explode(_pairs_within(F.col("chunk"))).alias("p"))
    crossed = chunk_products(large, basket).select(F.explode("left").alias("a"), "right").select("a", F.explode("right").alias("b"))
    return small.unionByName(inside).select("p.a", "p.b").unionByName(crossed)


def _numbered_items(baskets: DataFrame, group: str, items: str) -> tuple[DataFrame, int]:
    """(group, item, n_item, id) with a 64-bit id that no two items share, and the seed of the hash that gives it."""
    single = durable(baskets.select(group, F.explode(items).alias("item")).groupBy(group, "item").agg(F.count("*").alias("n_item")))
    seed = 0
    while True:
        numbered = single.withColumn("id", F.xxhash64(F.lit(seed), group, "item"))
        rows, ids = numbered.agg(F.count("*"), F.count_distinct("id")).first()
        if rows == ids:
            return numbered, seed
        seed += 1


def association(baskets: DataFrame, group: str, basket: str, items: str, least: int = 1, chunk: int = CHUNK) -> DataFrame:
    """(group, a, b, together, n_a, n_b, n, lift, jaccard, conf_ab, conf_ba, npmi) of pairs with ``together`` >= least.

    n is the number of baskets of the group and n_a, n_b those with the item. lift = together·n / (n_a·n_b) says how far
    the pair exceeds chance; npmi is its logarithm scaled to -1..1 (1 where the pair is in every basket). The baskets are
    written once. Items are paired and counted as 64-bit numbers, which are checked to be one per item, by partial
    aggregates; names and counts are joined to the pairs that are left, a hot item or group being salted. Baskets with a
    null group are dropped; one without any item still counts in n.
    """
    kept = durable(baskets.where(F.col(group).isNotNull()).select(group, basket, F.col(items).alias("items")))
    single, seed = _numbered_items(kept, group, "items")
    coded = kept.select(group, basket, F.array_sort(F.transform("items", lambda x: F.xxhash64(F.lit(seed), group, x))).alias("ids"))
    together = basket_pairs(coded, [group, basket], "ids", chunk).groupBy("a", "b").agg(F.count("*").alias("together")).where(F.col("together") >= least)
    sizes = kept.groupBy(group).agg(F.count("*").alias("n"))
    of = lambda side: single.select(F.col("id").alias(side), F.struct("item", F.col("n_item").alias("n")).alias(f"of_{side}"), F.col("n_item").alias("w"), *([group] if side == "a" else []))
    both = join_stats(together, of("a"), ["a"], "w", ["b"]).drop("w")
    both = join_stats(both, of("b"), ["b"], "w", ["a"]).drop("w")
    turned = F.col("of_a.item") > F.col("of_b.item")
    first, second = F.when(turned, F.col("of_b")).otherwise(F.col("of_a")), F.when(turned, F.col("of_a")).otherwise(F.col("of_b"))
    both = both.select(group, "together", first.alias("x"), second.alias("y")).select(group, F.col("x.item").alias("a"), F.col("y.item").alias("b"), "together", F.col("x.n").alias("n_a"), F.col("y.n").alias("n_b"))
    both = join_stats(both, sizes, [group], "n", ["a", "b"])
    share = F.col("together") / F.col("n")
    lift = F.col("together") * F.col("n") / (F.col("n_a") * F.col("n_b"))
    return both.select(
        group, "a", "b", "together", "n_a", "n_b", "n", lift.alias("lift"),
        (F.col("together") / (F.col("n_a") + F.col("n_b") - F.col("together"))).alias("jaccard"),
        (F.col("together") / F.col("n_a")).alias("conf_ab"), (F.col("together") / F.col("n_b")).alias("conf_ba"),
        F.when(share >= 1, F.lit(1.0)).otherwise(F.log(lift) / -F.log(share)).alias("npmi"),
    )


def commit_baskets(commits: DataFrame, least: int = 2, most: int | None = None) -> DataFrame:
    """(graph_id, hash, items): the plain paths of each commit with at least ``least`` files, each (graph_id, hash) once.

    ``most`` leaves out commits with more files, for reports that are defined so; by default none is. Null and blank files vanish, spellings of one file count once; rows without graph or hash are dropped.
    """
    plain = commits.where(F.col("graph_id").isNotNull() & F.col("hash").isNotNull()).select("graph_id", "hash", "ingested_at", plain_paths(F.col("files")).alias("items"))
    return latest_by(plain, ["graph_id", "hash"], ["ingested_at"]).select("graph_id", "hash", "items").where((F.size("items") >= least) & (F.lit(most).isNull() | (F.size("items") <= F.lit(most))))


def file_association(commits: DataFrame, least: int = 1, most: int | None = None, chunk: int = 16) -> DataFrame:
    """Association of every two files of a repository over its commits with at least two files; ``most`` as in commit_baskets."""
    return association(commit_baskets(commits, most=most), "graph_id", "hash", "items", least, chunk)


def settle_report(pairs: DataFrame, report: DataFrame) -> DataFrame:
    """The counted pairs beside what an earlier report said of them.

    The report's latest row per unordered pair is used, of several the one with most co_changes; self-pairs are dropped, a confidence above 1 is read as percent,
    one that is null, NaN or negative as unknown. ``reported`` is null where the report lacks the pair.
    """
    a, b = plain_path(F.col("file_a")), plain_path(F.col("file_b"))
    share = F.when(F.isnan("confidence") | (F.col("confidence") < 0), None).when(F.col("confidence") > 1, F.col("confidence") / 100).otherwise(F.col("confidence"))
    said = report.select("graph_id", F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.col("co_changes").alias("reported"), share.alias("reported_confidence"), "computed_at").where("a < b")
    said = latest_by(said, ["graph_id", "a", "b"], ["computed_at", "reported"]).drop("computed_at")
    return pairs.join(said, ["graph_id", "a", "b"], "left").withColumn("agrees", F.coalesce(F.col("reported") == F.col("together"), F.lit(False)))
