"""Layers and partitions: classification, layer edges, consistency, modularity, cohesion, agreement of labelings, fitness rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .edges import TEST_FILE, adjacency, real

#: Default layers in order of priority, as path patterns.
LAYERS = [
    ("types", r"(^|/)(types?|interfaces?|models?)/"), ("utils", r"(^|/)(utils?|helpers?|lib|common|shared)/"), ("api", r"(^|/)(api|routes?|controllers?)/"),
    ("services", r"(^|/)services?/"), ("storage", r"(^|/)(storage|db|database|repositor(y|ies))/"), ("ui", r"(^|/)(ui|components?|pages?|views?)/"),
    ("core", r"(^|/)(core|domain)/"), ("cli", r"(^|/)(cli|bin|cmd)/"), ("jobs", r"(^|/)(jobs?|workers?|tasks?)/"), ("tests", r"(^|/)(tests?|__tests__)/"),
]
SKIP, MOST_VIOLATIONS = 2, 20


def layer_of(path: Column, patterns: list[tuple[str, str]] = LAYERS, first: list[tuple[str, str]] = ()) -> Column:
    """The first layer whose pattern the path matches, the caller's own patterns before the default ones; null if none does."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed([*first, *patterns]):
        out = F.when(path.rlike(pattern), name).otherwise(out)
    return out


def layer_edges(edges: DataFrame, layers: DataFrame) -> DataFrame:
    """(graph_id, from_layer, to_layer, edges, sources) between different layers; layers: graph_id, node, layer."""
    of = lambda end: layers.where("layer IS NOT NULL").select("graph_id", F.col("node").alias(end), F.col("layer").alias(f"{end}_layer"))
    both = real(edges).join(of("src"), ["graph_id", "src"]).join(of("dst"), ["graph_id", "dst"]).where("src_layer <> dst_layer")
    return both.groupBy("graph_id", F.col("src_layer").alias("from_layer"), F.col("dst_layer").alias("to_layer")).agg(F.count("*").alias("edges"), F.countDistinct("src").alias("sources"))


def layer_consistency(crossings: DataFrame, ranks: DataFrame) -> DataFrame:
    """Distance-weighted share of crossings that point down, per graph; ranks: layer, rank (0 the lowest)."""
    r = lambda end: ranks.select(F.col("layer").alias(f"{end}_layer"), F.col("rank").alias(f"{end}_rank"))
    x = crossings.join(r("from"), "from_layer").join(r("to"), "to_layer")
    w = F.col("edges") * F.abs(F.col("from_rank") - F.col("to_rank"))
    good = F.when(F.col("from_rank") > F.col("to_rank"), w).otherwise(0)
    return x.groupBy("graph_id").agg((F.sum(good) / F.nullif(F.sum(w), F.lit(0))).alias("consistency"), F.sum(F.when(F.col("from_rank") < F.col("to_rank"), F.col("edges")).otherwise(0)).alias("violations"))


def fitness(edges: DataFrame, layers: DataFrame, ranks: DataFrame, most: int = MOST_VIOLATIONS) -> DataFrame:
    """Rule violations: a layer depends on a higher one, skips two or more, or production code imports a test."""
    of = lambda end: layers.join(ranks, "layer").select("graph_id", F.col("node").alias(end), F.col("layer").alias(f"{end}_layer"), F.col("rank").alias(f"{end}_rank"))
    e = real(edges).join(of("src"), ["graph_id", "src"], "left").join(of("dst"), ["graph_id", "dst"], "left")
    gap = F.col("src_rank") - F.col("dst_rank")
    rule = F.when(~F.col("src").rlike(TEST_FILE) & F.col("dst").rlike(TEST_FILE), "test isolation").when(gap < 0, "upward dependency").when(gap > SKIP, "layer skip")
    found = e.withColumn("rule", rule).where("rule IS NOT NULL").select("graph_id", "rule", "src", "dst")
    return found.withColumn("n", F.row_number().over(W.partitionBy("graph_id").orderBy("rule", "src", "dst"))).where(F.col("n") <= most)


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(graph_id, q): modularity of a labeling of the undirected weighted graph; labels: graph_id, node, label."""
    a = adjacency(edges, directed=False)
    of = lambda end: labels.select("graph_id", F.col("node").alias(end), F.col("label").alias(f"{end}_label"))
    x = a.join(of("src"), ["graph_id", "src"]).join(of("dst"), ["graph_id", "dst"])
    inner = F.sum(F.when(F.col("src_label") == F.col("dst_label"), F.col("weight")).otherwise(0.0))
    per = x.groupBy("graph_id", F.col("src_label").alias("label")).agg(inner.alias("inner"), F.sum("weight").alias("degree"))
    total = F.sum("degree").over(W.partitionBy("graph_id"))
    part = per.withColumn("m2", total)
    return part.groupBy("graph_id").agg(F.sum(F.col("inner") / F.col("m2") - F.pow(F.col("degree") / F.col("m2"), 2)).alias("q"))


def cohesion(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Internal density of each label: undirected pairs inside over n(n-1)/2; 0 for a single node."""
    u = real(edges).where("src <> dst").select("graph_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    of = lambda end: labels.select("graph_id", F.col("node").alias(end), F.col("label").alias(f"label_{end}"))
    inside = u.join(of("a"), ["graph_id", "a"]).join(of("b"), ["graph_id", "b"]).where("label_a = label_b").groupBy("graph_id", F.col("label_a").alias("label")).agg(F.count("*").alias("pairs"))
    size = labels.groupBy("graph_id", "label").agg(F.count("*").alias("nodes"))
    possible = F.col("nodes") * (F.col("nodes") - 1) / 2
    return size.join(inside, ["graph_id", "label"], "left").select("graph_id", "label", "nodes", F.when(possible > 0, F.coalesce("pairs", F.lit(0)) / possible).otherwise(0.0).alias("cohesion"))


def rand_index(labels: DataFrame, a: str, b: str) -> DataFrame:
    """(graph_id, ari): adjusted Rand index of two labelings of the same nodes; 1 where both are trivial."""
    pairs = lambda c: F.sum(c * (c - 1) / 2)
    n = F.col("n")
    cell = labels.groupBy("graph_id", a, b).agg(F.count("*").alias("n"))
    both = cell.groupBy("graph_id").agg(pairs(n).alias("s"), F.sum("n").alias("n"))
    one = lambda x: cell.groupBy("graph_id", x).agg(F.sum("n").alias("n")).groupBy("graph_id").agg(pairs(n).alias(f"s_{x}"))
    x = both.join(one(a), "graph_id").join(one(b), "graph_id")
    expected = F.col(f"s_{a}") * F.col(f"s_{b}") / F.nullif(n * (n - 1) / 2, F.lit(0))
    top = (F.col(f"s_{a}") + F.col(f"s_{b}")) / 2
    return x.select("graph_id", F.coalesce((F.col("s") - expected) / F.nullif(top - expected, F.lit(0.0)), F.lit(1.0)).alias("ari"))


def majority(votes: DataFrame, groups: list[str], vote: str, share: float = 0.6) -> DataFrame:
    """The vote that at least ``share`` of a group's rows give, else 'mixed'; nulls do not vote."""
    n = votes.where(F.col(vote).isNotNull()).groupBy(*groups, vote).agg(F.count("*").alias("n"))
    # the greatest count, then the first name in byte order
    top = n.groupBy(*groups).agg(F.sum("n").alias("votes"), F.max("n").alias("most"), F.min_by(vote, F.struct(-F.col("n"), F.col(vote))).alias("winner"))
    ratio = F.col("most") / F.col("votes")
    return top.select(*groups, "votes", F.when(ratio >= share, F.col("winner")).otherwise("mixed").alias("style"), ratio.alias("share"))


def name_style(c: Column) -> Column:
    """camelCase, PascalCase, snake_case, UPPER_CASE, kebab-case, lowercase or other."""
    return (
        F.when(c.rlike("^[a-z]+[0-9]*$"), "lowercase").when(c.rlike("^[a-z][a-z0-9]*([A-Z][a-z0-9]*)+$"), "camelCase").when(c.rlike("^([A-Z][a-z0-9]*)+$") & c.rlike("[a-z]"), "PascalCase")
        .when(c.rlike("^[a-z0-9]+(_[a-z0-9]+)+$"), "snake_case").when(c.rlike("^[A-Z0-9]+(_[A-Z0-9]+)*$"), "UPPER_CASE").when(c.rlike("^[a-z0-9]+(-[a-z0-9]+)+$"), "kebab-case").when(c.isNotNull(), "other")
    )
