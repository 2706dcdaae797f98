"""Edge tables: dedup, degrees, instability, tight coupling, cross-cutting nodes, exports, barrels.

Edges carry graph_id, src, dst; further columns are named per operator. Rows with a null end are dropped everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of a type-only edge in stability, thresholds of the reports.
TYPE_ONLY_SHARE, UNSTABLE, TIGHT_NAMES, CROSS_LAYERS, REPORT_TOP = 0.3, 0.8, 5, 3, 10
#: Names that test files have, as one alternation.
TEST_FILE = r"\.(test|spec)\.[jt]sx?$|(^|/)(__tests__|tests?|e2e|cypress|playwright)/|_test\.(go|py)$|(^|/)test_[^/]*\.py$|Tests?\.java$|(^|/)conftest\.py$"
#: Files that are alive without being imported.
ENTRY_FILE = r"\.d\.ts$|\.(stories|story)\.[jt]sx?$|\.mdx?$|(^|/)(index|main|app|server|cli|mod|lib|__init__|__main__|page|layout|route)\.[a-z]+$|\.config\.[a-z]+$|(^|/)setup\.py$"


def real(edges: DataFrame) -> DataFrame:
    """Edges with both ends."""
    return edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull())


def dedup(edges: DataFrame) -> DataFrame:
    """One row per (graph_id, src, dst): union of the names, type-only only if all are."""
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_list("names"))))
    return real(edges).groupBy("graph_id", "src", "dst").agg(names.alias("names"), F.bool_and("is_type_only").alias("is_type_only"))


def degrees(edges: DataFrame, weight: Column | None = None) -> DataFrame:
    """(graph_id, node, in_degree, out_degree, in_weight, out_weight): both ends in one aggregate, so each edge is shuffled once."""
    w = F.lit(1.0) if weight is None else weight
    ends = real(edges).select("graph_id", w.alias("w"), F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("graph_id", F.col("e.node").alias("node")).agg(
        F.sum("e.i").cast("bigint").alias("in_degree"), F.sum(1 - F.col("e.i")).cast("bigint").alias("out_degree"),
        F.sum(F.col("w") * F.col("e.i")).alias("in_weight"), F.sum(F.col("w") * (1 - F.col("e.i"))).alias("out_weight"),
    )


def adjacency(edges: DataFrame, directed: bool = True) -> DataFrame:
    """(graph_id, src, dst, weight): duplicates summed; undirected adds every edge the other way round."""
    e = real(edges).select("graph_id", "src", "dst", F.coalesce("weight", F.lit(1.0)).alias("weight"))
    if not directed:
        e = e.unionByName(e.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return e.groupBy("graph_id", "src", "dst").agg(F.sum("weight").alias("weight"))


def instability(edges: DataFrame) -> DataFrame:
    """Fan-out over fan-in plus fan-out per node, type-only edges counting TYPE_ONLY_SHARE; null without edges."""
    d = degrees(edges, F.when(F.col("is_type_only"), TYPE_ONLY_SHARE).otherwise(1.0))
    return d.withColumn("instability", F.col("out_weight") / (F.col("in_weight") + F.col("out_weight")))


def unstable(edges: DataFrame) -> DataFrame:
    """The report: instability above UNSTABLE and somebody depends on it."""
    return instability(edges).where((F.col("instability") > UNSTABLE) & (F.col("in_degree") >= 1))


def tight_coupling(edges: DataFrame, least: int = TIGHT_NAMES, top: int = REPORT_TOP) -> DataFrame:
    """Pairs with at least ``least`` distinct names between them, the widest ``top``; src, dst, name rows."""
    n = real(edges).groupBy("graph_id", "src", "dst").agg(F.countDistinct("name").alias("names")).where(F.col("names") >= least)
    return n.orderBy(F.col("names").desc(), "graph_id", "src", "dst").limit(top)


def cross_cutting(edges: DataFrame, layers: DataFrame, least: int = CROSS_LAYERS) -> DataFrame:
    """Nodes imported from at least ``least`` layers; ``layers`` has graph_id, node, layer."""
    of_src = layers.select("graph_id", F.col("node").alias("src"), "layer")
    seen = real(edges).join(of_src, ["graph_id", "src"]).where("layer IS NOT NULL").groupBy("graph_id", "dst").agg(F.array_join(F.array_sort(F.collect_set("layer")), ",").alias("layers"), F.countDistinct("layer").alias("spread"))
    return seen.where(F.col("spread") >= least)


def hubs(scores: DataFrame, top: int = 8) -> DataFrame:
    """The ``top`` nodes of each graph by the greater of authority and hub score."""
    from pyspark.sql import Window as W

    s = scores.withColumn("score", F.greatest("authority", "hub"))
    return s.withColumn("rank", F.row_number().over(W.partitionBy("graph_id").orderBy(F.col("score").desc(), "node"))).where(F.col("rank") <= top)


def dead_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that nobody imports and that are neither tests nor entries nor barrels; nodes: graph_id, node, is_barrel."""
    used = real(edges).select("graph_id", F.col("dst").alias("node")).distinct()
    odd = F.coalesce("is_barrel", F.lit(False)) | F.col("node").rlike(TEST_FILE) | F.col("node").rlike(ENTRY_FILE)
    return nodes.where(~odd).join(used, ["graph_id", "node"], "left_anti")


def used_exports(edges: DataFrame) -> DataFrame:
    """Distinct (graph_id, node, name) that some edge names; edges: src, dst, names, is_barrel_routed. A routed edge also uses 'default'."""
    names = F.when(F.col("is_barrel_routed"), F.array_append("names", F.lit("default"))).otherwise(F.col("names"))
    return real(edges).select("graph_id", F.col("dst").alias("node"), F.explode(names).alias("name")).distinct()


def dead_exports(exports: DataFrame, used: DataFrame, entries: DataFrame) -> DataFrame:
    """Exports that no edge uses, those of entry nodes aside; a node used as '*' keeps all its names."""
    whole = used.where("name = '*'").select("graph_id", "node")
    return exports.join(used, ["graph_id", "node", "name"], "left_anti").join(whole, ["graph_id", "node"], "left_anti").join(entries, ["graph_id", "node"], "left_anti")


def barrels(exports: DataFrame, share: float = 0.5) -> DataFrame:
    """Nodes of whose exports more than ``share`` are re-exports; exports: graph_id, node, is_reexport."""
    n = exports.groupBy("graph_id", "node").agg(F.avg(F.col("is_reexport").cast("double")).alias("share"))
    return n.where(F.col("share") > share)


def route_barrels(edges: DataFrame, reexports: DataFrame, stars: DataFrame) -> DataFrame:
    """Edges that end in a barrel, moved to where each name really comes from.

    ``edges``: graph_id, src, dst, name. ``reexports``: graph_id, node, name, target. ``stars``: graph_id, node, target (export *).
    A name found in reexports goes to its target; one that is not goes to every star target; edges of neither kind stay.
    """
    known = reexports.select("graph_id", F.col("node").alias("dst"), "name", F.col("target").alias("named"))
    any_star = stars.select("graph_id", F.col("node").alias("dst"), F.col("target").alias("starred"))
    routed = real(edges).join(known, ["graph_id", "dst", "name"], "left").join(any_star, ["graph_id", "dst"], "left")
    target = F.coalesce("named", "starred")
    return routed.select("graph_id", "src", F.coalesce(target, F.col("dst")).alias("dst"), "name", target.isNotNull().alias("is_barrel_routed")).where("src <> dst").distinct()


def ghost_gate(ghosts: DataFrame, known: DataFrame, community: DataFrame, files: int, most: float = 0.1) -> DataFrame:
    """Ghost edges without noise: kinds in more than ``most`` of the files go, known pairs go, same-community ones count half.

    ghosts: graph_id, src, dst, kind, confidence; known: src, dst; community: graph_id, node, community.
    """
    common = ghosts.groupBy("graph_id", "kind").agg(F.countDistinct("src").alias("n")).where(F.col("n") > most * files).select("graph_id", "kind")
    left = ghosts.join(common, ["graph_id", "kind"], "left_anti").join(known.select("graph_id", "src", "dst"), ["graph_id", "src", "dst"], "left_anti")
    of = lambda end: community.select("graph_id", F.col("node").alias(end), F.col("community").alias(f"c_{end}"))
    both = left.join(of("src"), ["graph_id", "src"], "left").join(of("dst"), ["graph_id", "dst"], "left")
    halved = F.when(F.col("c_src") == F.col("c_dst"), F.col("confidence") / 2).otherwise(F.col("confidence"))
    return both.select("graph_id", "src", "dst", "kind", halved.alias("confidence"))


def merge_graphs(nodes: list[DataFrame]) -> DataFrame:
    """Nodes of several graphs as one: degrees added, scores of the first graph that has the node kept."""
    out = None
    for i, n in enumerate(nodes):
        part = n.withColumn("__from", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("node").agg(F.sum("in_degree").alias("in_degree"), F.min_by("authority", "__from").alias("authority"))
