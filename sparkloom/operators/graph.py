"""Graph algorithms on DataFrames: many graphs at once, each in a task of its own, or one large graph by relational rounds.

Edges carry graph_id, src, dst and where used weight. A graph goes to a single task only up to MOST_EDGES edges, and for
some kernels up to fewer nodes; both are counted before the groups are formed, and larger graphs must use the relational
forms (``hits_rounds``, traversal.components, traversal.reach, ``betweenness_by_source``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shared import discard, durable, ship
from . import kernels as K
from .edges import degrees, real

#: Edges of a graph that a single task takes.
MOST_EDGES = 2_000_000
#: Nodes of a graph for kernels with a bit set a node (40,000² bits are 200 MB), with a search a node, and with a scan of all nodes a step.
MOST_BITS, MOST_SEARCHES, MOST_SCANS = 40_000, 20_000, 20_000
#: Least sources of a sampled betweenness, and the mean degree from which they are doubled.
SAMPLED_LEAST, DENSE = 50, 10
#: Thresholds of roles, weight of edges in hub scores.
ROLES = {"foundation": (0.6, 0.3), "orchestrator": (0.6, 0.3), "bridge": 0.3, "utility": (0.1, 0.6, 0.1)}
TYPE_ONLY, DYNAMIC, BARREL, LEAST_SPECIFIC, SPECIFIC_BASE, STAR_NAMES = 0.7, 0.5, 0.3, 0.2, 6, 3


def bounded(rows: DataFrame, keys: list[str], most: int, what: str) -> DataFrame:
    """``rows`` as a durable table, after counting that no group of ``keys`` has more than ``most`` of them; else an error, before any group is formed.

    Where the whole table has no more, its file footers tell so, and nothing is grouped for the check.
    """
    kept = durable(rows)
    if kept.count() <= most:
        return kept
    worst = kept.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.col("n").desc()).first()
    if worst is not None and worst.n > most:
        raise ValueError(f"{worst.n} {what} in group {[worst[k] for k in keys]}, a task takes {most}; use the relational form for large groups")
    return kept


def per_graph(edges: DataFrame, f: Callable[..., Iterator[tuple]], columns: str, most_nodes: int | None = None, given: DataFrame | None = None) -> DataFrame:
    """Run f(n, names, src, dst, weight) once per graph_id; it yields tuples for ``columns``, graph_id is put in front.

    Duplicate edges are summed before they reach the task. A graph of more than MOST_EDGES distinct edges, or of more than
    ``most_nodes`` nodes, ends in an error that names the way for larger ones, before any task gets a graph. With ``given``
    (graph_id, node, value) f also gets the values of the graph's nodes as a dict; graphs without any get none.
    """
    ship(edges.sparkSession)
    names = [c.split()[0] for c in columns.split(",")]
    compact = real(edges).groupBy("graph_id", "src", "dst").agg(F.sum("weight").alias("weight")) if "weight" in edges.columns else real(edges).select("graph_id", "src", "dst").distinct().withColumn("weight", F.lit(1.0))
    compact = bounded(compact, ["graph_id"], MOST_EDGES, "edges")
    if most_nodes is not None and 2 * compact.count() > most_nodes:
        bounded(compact.select("graph_id", F.explode(F.array("src", "dst")).alias("node")).distinct(), ["graph_id"], most_nodes, "nodes")

    def run(pdf: pd.DataFrame, *values: dict) -> pd.DataFrame:
        nodes = sorted(set(pdf.src) | set(pdf.dst))
        at = {v: i for i, v in enumerate(nodes)}
        pdf = pdf.sort_values(["src", "dst"])
        src, dst = pdf.src.map(at).to_numpy(np.int64), pdf.dst.map(at).to_numpy(np.int64)
        out = pd.DataFrame(list(f(len(nodes), nodes, src, dst, pdf.weight.to_numpy(float), *values)), columns=names)
        out.insert(0, "graph_id", pdf.graph_id.iloc[0])
        return out

    schema = f"graph_id string, {columns}"
    if given is None:
        return compact.groupBy("graph_id").applyInPandas(run, schema)

    def run_both(pdf: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty:
            return pd.DataFrame({c: [] for c in ["graph_id", *names]}, dtype=object)
        return run(pdf, dict(zip(values.node, values.value, strict=True)))

    by = given.groupBy("graph_id", "node").agg(F.max("value").alias("value"))
    return compact.groupBy("graph_id").cogroup(by.groupBy("graph_id")).applyInPandas(run_both, schema)


def edge_weight(names: Column, is_type_only: Column, is_dynamic: Column, src_barrel: Column, dst_barrel: Column) -> Column:
    """Weight of an import edge: specificity of its names, less for type-only, dynamic and barrel edges."""
    n = F.when((F.size(names) == 1) & (names[0] == "*"), STAR_NAMES).otherwise(F.greatest(F.size(names), F.lit(0)))
    specific = F.greatest(F.lit(LEAST_SPECIFIC), F.log2(n + 1) / F.log2(F.lit(SPECIFIC_BASE)))
    return specific * F.when(is_type_only, 1 - TYPE_ONLY).otherwise(1.0) * F.when(is_dynamic, DYNAMIC).otherwise(1.0) * F.when(src_barrel, BARREL).otherwise(1.0) * F.when(dst_barrel, BARREL).otherwise(1.0)


def hits(edges: DataFrame, rounds: int = 30, epsilon: float = 1e-6, every_round: bool = False) -> DataFrame:
    """(graph_id, node, authority, hub) of each graph."""

    def f(n, names, src, dst, w):
        a, h = K.hits(n, src, dst, w, rounds, epsilon, every_round=every_round)
        return zip(names, a.tolist(), h.tolist(), strict=True)

    return per_graph(edges, f, "node string, authority double, hub double")


def hits_rounds(edges: DataFrame, rounds: int = 30, epsilon: float = 1e-6) -> DataFrame:
    """The same by joins and aggregates, for graphs of any size: one row per node and round, kept in the shared folder.

    Each round shuffles the two score columns along the edges; norms come from aggregates of one row per graph.
    """
    e = durable(real(edges).groupBy("graph_id", "src", "dst").agg(F.sum("weight").alias("w")))
    ends = e.select("graph_id", F.col("src").alias("node")).unionByName(e.select("graph_id", F.col("dst").alias("node"))).distinct()
    size = ends.groupBy("graph_id").agg(F.count("*").alias("n"))
    x = durable(ends.join(size, "graph_id").withColumns({"a": F.lit(1.0), "h": F.lit(1.0)}))
    for _ in range(rounds):
        into = e.join(x.select("graph_id", F.col("node").alias("src"), "h"), ["graph_id", "src"]).groupBy("graph_id", F.col("dst").alias("node")).agg(F.sum(F.col("h") * F.col("w")).alias("sa"))
        outof = e.join(x.select("graph_id", F.col("node").alias("dst"), "a"), ["graph_id", "dst"]).groupBy("graph_id", F.col("src").alias("node")).agg(F.sum(F.col("a") * F.col("w")).alias("sh"))
        step = x.drop("oa", "oh").join(into, ["graph_id", "node"], "left").join(outof, ["graph_id", "node"], "left")
        base = K.TELEPORT / F.col("n")
        step = step.withColumns({"na": base + (1 - K.TELEPORT) * F.coalesce("sa", F.lit(0.0)), "nh": base + (1 - K.TELEPORT) * F.coalesce("sh", F.lit(0.0))})
        norm = step.groupBy("graph_id").agg(F.sqrt(F.sum(F.col("na") * F.col("na"))).alias("la"), F.sqrt(F.sum(F.col("nh") * F.col("nh"))).alias("lh"))
        new = durable(step.join(norm, "graph_id").select("graph_id", "node", "n", (F.col("na") / F.col("la")).alias("a"), (F.col("nh") / F.col("lh")).alias("h"), F.col("a").alias("oa"), F.col("h").alias("oh")))
        discard(x)
        moved = new.agg(F.max(F.abs(F.col("a") - F.col("oa")) + F.abs(F.col("h") - F.col("oh")))).first()[0]
        x = new
        if moved is None or moved < epsilon:
            break
    ends = x.groupBy("graph_id").agg(F.min("a").alias("a0"), F.max("a").alias("a1"), F.min("h").alias("h0"), F.max("h").alias("h1"))
    scaled = lambda v, lo, hi: F.when(F.col(hi) - F.col(lo) > K.FLAT, (F.col(v) - F.col(lo)) / (F.col(hi) - F.col(lo))).otherwise(0.5)
    return x.join(ends, "graph_id").select("graph_id", "node", scaled("a", "a0", "a1").alias("authority"), scaled("h", "h0", "h1").alias("hub"))


def role(authority: Column, hub: Column, is_barrel: Column | None = None) -> Column:
    """Barrel, Foundation, Orchestrator, Bridge, Utility or Leaf."""
    (fa, fh), (oh, oa), b, (u0, u1, uh) = ROLES["foundation"], ROLES["orchestrator"], ROLES["bridge"], ROLES["utility"]
    out = F.when((authority > fa) & (hub < fh), "Foundation").when((hub > oh) & (authority < oa), "Orchestrator").when((authority > b) & (hub > b), "Bridge").when((authority >= u0) & (authority <= u1) & (hub < uh), "Utility").otherwise("Leaf")
    return out if is_barrel is None else F.when(is_barrel, "Barrel").otherwise(out)


def betweenness(edges: DataFrame) -> DataFrame:
    """(graph_id, node, betweenness) over all sources, each graph in one task."""
    return per_graph(edges, lambda n, names, src, dst, w: zip(names, K.betweenness(n, src, dst).tolist(), strict=True), "node string, betweenness double", MOST_SEARCHES)


def sample_sources(edges: DataFrame, community: DataFrame | None = None, seed: int = 1) -> DataFrame:
    """(graph_id, node): sources of a sampled betweenness; all nodes of graphs that are no larger than the sample.

    The sample has max(50, 2·√nodes) sources, rounded up to tens, twice as many where nodes have more than ten edges on
    average. Each community (graph_id, node, community) gives its share of them, rounded up, so that none is missed; inside a
    community nodes are drawn in proportion to their degree, by the hash of their name and ``seed``.
    """
    d = degrees(edges).select("graph_id", "node", (F.col("in_degree") + F.col("out_degree")).alias("degree"))
    d = durable(d.withColumn("community", F.lit(0)) if community is None else d.join(community.select("graph_id", "node", "community"), ["graph_id", "node"], "left"))
    size = d.groupBy("graph_id").agg(F.count("*").alias("n"), F.avg("degree").alias("mean"))
    wanted = F.ceil(F.greatest(F.lit(SAMPLED_LEAST), F.ceil(2 * F.sqrt("n"))) / 10) * 10 * F.when(F.col("mean") > DENSE, 2).otherwise(1)
    group = d.groupBy("graph_id", "community").agg(F.count("*").alias("members")).join(size, "graph_id")
    quota = group.select("graph_id", "community", F.when(wanted >= F.col("n"), F.col("members")).otherwise(F.ceil(wanted * F.col("members") / F.col("n"))).alias("quota"))
    # the k greatest of u^(1/degree) are a draw of k without replacement in proportion to the degree
    u = (F.pmod(F.xxhash64("graph_id", "node", F.lit(seed)), F.lit(1 << 30)) + 1) / float(1 << 30)
    order = W.partitionBy("graph_id", "community").orderBy((F.log(u) / F.col("degree")).desc(), "node")
    placed = d.withColumn("place", F.row_number().over(order))
    on = (placed["graph_id"] == quota["graph_id"]) & placed["community"].eqNullSafe(quota["community"])
    return placed.join(quota, on).where("place <= quota").select(placed["graph_id"], "node")


def betweenness_sampled(edges: DataFrame, community: DataFrame | None = None, seed: int = 1) -> DataFrame:
    """(graph_id, node, betweenness) from the sources of ``sample_sources``, over the greatest; exact for small graphs."""
    return betweenness_by_source(edges, sources=sample_sources(edges, community, seed))


def betweenness_by_source(edges: DataFrame, share: float = 1.0, seed: int = 1, sources: DataFrame | None = None) -> DataFrame:
    """The same with the sources dealt out over tasks, every task holding the adjacency of one graph of at most MOST_EDGES edges.

    ``sources`` (graph_id, node) may be given; ``share`` below 1 samples them by hash. Sums are scaled by the greatest, so the
    scale does not change.
    """
    ship(edges.sparkSession)
    e = bounded(real(edges).select("graph_id", "src", "dst").distinct(), ["graph_id"], MOST_EDGES, "edges")
    nodes = e.select("graph_id", F.col("src").alias("node")).unionByName(e.select("graph_id", F.col("dst").alias("node"))).distinct()
    if sources is not None:
        nodes = nodes.join(sources.select("graph_id", "node").distinct(), ["graph_id", "node"], "left_semi")
    if share < 1:
        nodes = nodes.where(F.pmod(F.xxhash64("graph_id", "node", F.lit(seed)), F.lit(1_000_000)) < share * 1_000_000)
    tasks = edges.sparkSession.sparkContext.defaultParallelism
    lots = nodes.select(F.col("graph_id").alias("graph_id"), "node", F.pmod(F.xxhash64("node"), F.lit(tasks)).alias("lot"))
    copies = e.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(tasks - 1).cast("bigint"))))

    def run(key, some: pd.DataFrame, all_edges: pd.DataFrame) -> pd.DataFrame:
        if some.empty or all_edges.empty:
            return pd.DataFrame({"graph_id": [], "node": [], "part": []}, dtype=object)
        names = sorted(set(all_edges.src) | set(all_edges.dst))
        at = {v: i for i, v in enumerate(names)}
        nexts = K.neighbours(len(names), all_edges.src.map(at).to_numpy(), all_edges.dst.map(at).to_numpy())
        total = sum(K.dependencies(nexts, at[v]) for v in some.node)
        return pd.DataFrame({"graph_id": key[0], "node": names, "part": total})

    parts = lots.groupBy("graph_id", "lot").cogroup(copies.groupBy("graph_id", "lot")).applyInPandas(run, "graph_id string, node string, part double")
    summed = parts.groupBy("graph_id", "node").agg(F.sum("part").alias("total"))
    top = summed.groupBy("graph_id").agg(F.max("total").alias("top"))
    return summed.join(top, "graph_id").select("graph_id", "node", F.when(F.col("top") > 0, F.col("total") / F.col("top")).otherwise(0.0).alias("betweenness"))


def strong_components(edges: DataFrame) -> DataFrame:
    """(graph_id, node, component, size): the component is named by its least node."""

    def f(n, names, src, dst, w):
        label = K.strong_components(n, src, dst)
        size = np.bincount(label, minlength=n)
        return ((names[v], names[label[v]], int(size[label[v]])) for v in range(n))

    return per_graph(edges, f, "node string, component string, size bigint")


def cycle_report(edges: DataFrame, most: int = 10) -> DataFrame:
    """(graph_id, cycle, length): short cycles in the order of K.cycles."""
    return per_graph(edges, lambda n, names, src, dst, w: ((">".join(names[v] for v in c), len(c)) for c in K.cycles(n, src, dst, most)), "cycle string, length int")


def chokepoints(edges: DataFrame) -> DataFrame:
    """(graph_id, node, upstream, downstream)."""
    return per_graph(edges, lambda n, names, src, dst, w: ((names[v], u, x) for v, u, x in K.chokepoints(n, src, dst)), "node string, upstream int, downstream int", MOST_BITS)


def topology(edges: DataFrame) -> DataFrame:
    """One row per graph: components, largest, second, diameter, reachable, fragmented."""
    return per_graph(edges, lambda n, names, src, dst, w: [tuple(K.topology(n, src, dst).values())], "components int, largest int, second int, diameter int, reachable double, fragmented boolean")


def critical_chain(edges: DataFrame) -> DataFrame:
    """(graph_id, place, node): the longest chain of strong components."""
    return per_graph(edges, lambda n, names, src, dst, w: ((i, names[v]) for i, v in enumerate(K.critical_chain(n, src, dst))), "place int, node string")


def feedback_arcs(edges: DataFrame) -> DataFrame:
    """(graph_id, src, dst): edges whose removal leaves no cycle."""
    return per_graph(edges, lambda n, names, src, dst, w: ((names[a], names[b]) for a, b in K.feedback_arcs(n, src, dst)), "src string, dst string", MOST_SCANS)


def dominators(edges: DataFrame, entry: str) -> DataFrame:
    """(graph_id, node, dominator) of the nodes that ``entry`` reaches; graphs without it give nothing."""

    def f(n, names, src, dst, w):
        if entry not in names:
            return []
        return ((names[v], names[x]) for v, x in sorted(K.dominators(n, src, dst, names.index(entry)).items()))

    return per_graph(edges, f, "node string, dominator string")


def diverse_paths(edges: DataFrame, start: str, end: str, k: int = 3) -> DataFrame:
    """(graph_id, rank, path, cost) of up to k unlike paths."""

    def f(n, names, src, dst, w):
        if start not in names or end not in names:
            return []
        return ((i, ">".join(names[v] for v in p), c) for i, (c, p) in enumerate(K.diverse_paths(n, src, dst, w, names.index(start), names.index(end), k)))

    return per_graph(edges, f, "rank int, path string, cost double")


def katz(edges: DataFrame, seeds: dict[str, float] | DataFrame, rounds: int = K.KATZ_ROUNDS, epsilon: float = K.KATZ_EPSILON) -> DataFrame:
    """(graph_id, node, score) of nodes that seed mass reaches; ``seeds`` are those of every graph, or a table graph_id, node, value."""
    shared = seeds if isinstance(seeds, dict) else None

    def f(n, names, src, dst, w, own=None):
        at = {v: i for i, v in enumerate(names)}
        x = K.katz(n, src, dst, w, {at[v]: float(s) for v, s in (own if shared is None else shared).items() if v in at}, rounds, epsilon)
        return ((names[v], float(x[v])) for v in range(n) if x[v] > 0)

    return per_graph(edges, f, "node string, score double", given=None if shared is not None else seeds)


def absorbing_flow(edges: DataFrame, entry: str, absorbing: list[str], steps: int = K.FLOW_STEPS, least: float = 0.01) -> DataFrame:
    """(graph_id, node, visits, absorbed) of nodes visited at least ``least`` times."""

    def f(n, names, src, dst, w):
        if entry not in names:
            return []
        visits, absorbed, _ = K.absorbing_flow(n, src, dst, w, names.index(entry), {names.index(a) for a in absorbing if a in names}, steps, 0.0 if least == 0 else K.FLOW_EPSILON)
        return ((names[v], float(visits[v]), float(absorbed[v])) for v in range(n) if visits[v] >= least)

    return per_graph(edges, f, "node string, visits double, absorbed double")


def communities(edges: DataFrame, start: Callable[[str], str]) -> DataFrame:
    """(graph_id, node, community): the least member names the group; ``start`` gives each node its first label."""

    def f(n, names, src, dst, w):
        first: dict[str, int] = {}
        label = K.communities(n, src, dst, [first.setdefault(start(v), len(first)) for v in names], K.resolution(n))
        return ((names[v], names[label[v]]) for v in range(n))

    return per_graph(edges, f, "node string, community string")
