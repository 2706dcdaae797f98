"""Bounded walks over edges: closures, callers, impact, safe-change verdicts, test cover, package prefixes.

A walk of fixed depth is unrolled into joins; each hop is deduplicated, so a hop holds at most one row per node and start.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shared import discard, durable
from .edges import TEST_FILE, real

#: Contracted edges, over all graphs, from which on components are finished in one task a graph.
FINISH = 2_000_000


def closure(edges: DataFrame, starts: DataFrame | None = None, depth: int = 5, backwards: bool = False, keep_all: bool = True) -> DataFrame:
    """(graph_id, start, node, depth): nodes reached within ``depth`` hops from each start (by default every node).

    With ``keep_all`` a node stays at every depth at which it is reached, as (node, depth) is what is deduplicated;
    otherwise only its least depth stays.
    """
    a, b = ("dst", "src") if backwards else ("src", "dst")
    e = durable(real(edges).select("graph_id", F.col(a).alias("from"), F.col(b).alias("node")).distinct())
    first = e.withColumnRenamed("from", "start")
    if starts is not None:
        first = first.join(starts.select("graph_id", "start").distinct(), ["graph_id", "start"], "left_semi")
    level = first.select("graph_id", "start", "node").distinct()
    hops = [level.withColumn("depth", F.lit(1))]
    for k in range(2, depth + 1):
        # written, so that hop k is one join and not k of them
        level = durable(level.withColumnRenamed("node", "from").join(e, ["graph_id", "from"]).select("graph_id", "start", "node").distinct())
        hops.append(level.withColumn("depth", F.lit(k)))
    out = hops[0]
    for h in hops[1:]:
        out = out.unionByName(h)
    return out if keep_all else out.groupBy("graph_id", "start", "node").agg(F.min("depth").alias("depth"))


def reach(edges: DataFrame) -> DataFrame:
    """(graph_id, start, node): full reachability by path doubling; the longest path of 2^n hops takes n rounds, and nothing is cut off.

    Each round is written to the shared folder and the one before removed. The result itself may be quadratic in the nodes
    of a graph, as asked for.
    """
    known = durable(real(edges).select("graph_id", F.col("src").alias("start"), F.col("dst").alias("node")).distinct())
    n, m = -1, known.count()
    while m > n:
        left = known.select("graph_id", "start", F.col("node").alias("mid"))
        longer = left.join(known.select("graph_id", F.col("start").alias("mid"), "node"), ["graph_id", "mid"]).select("graph_id", "start", "node")
        before, known = known, durable(known.unionByName(longer).distinct())
        n, m = m, known.count()
        discard(before)
    return known


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(graph_id, node, component): weakly connected components, named by their least node.

    Every round hooks each component to its least neighbouring component if that is less, follows these hooks to their
    ends by pointer doubling, and contracts the edges to the new components; a round joins every component that has a
    lesser neighbour. Once all contracted edges together are no more than FINISH, which their count shows, each graph's rest
    is united in one task; it ends when no edge between two components is left, so nothing is cut off. Edges to nodes
    outside ``nodes`` count for nothing. Only the contracted edges, the hooks and one label per node are kept between
    rounds, in the shared folder.
    """
    label = durable(nodes.select("graph_id", "node").dropna().distinct().withColumn("component", F.col("node")))
    of = lambda end: label.select("graph_id", F.col("node").alias(end))
    e = real(edges).select("graph_id", "src", "dst").where("src <> dst").distinct().join(of("src"), ["graph_id", "src"], "left_semi").join(of("dst"), ["graph_id", "dst"], "left_semi")
    links = durable(e.select("graph_id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
    while n := links.count():
        if n <= FINISH:
            return _relabel(label, links.groupBy("graph_id").applyInPandas(_united, f"graph_id {label.schema['graph_id'].dataType.simpleString()}, component {label.schema['node'].dataType.simpleString()}, to {label.schema['node'].dataType.simpleString()}"))
        before = (label, links)
        root = _ends(durable(links.groupBy("graph_id", F.col("dst").alias("component")).agg(F.min("src").alias("to"))))
        label = durable(_relabel(label, root))
        for end in ("src", "dst"):
            links = links.join(root.withColumnRenamed("component", end), ["graph_id", end], "left").withColumn(end, F.coalesce("to", end)).drop("to")
        links = durable(links.where("src <> dst").select("graph_id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
        discard(*before, root)
    return label


def _relabel(label: DataFrame, root: DataFrame) -> DataFrame:
    return label.join(root, ["graph_id", "component"], "left").select("graph_id", "node", F.coalesce("to", "component").alias("component"))


def _united(pdf: pd.DataFrame) -> pd.DataFrame:
    """(graph_id, component, to) of the components of one graph's links that are not their own least name."""
    up: dict = {}

    def top(x):
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    for a, b in zip(pdf.src.tolist(), pdf.dst.tolist(), strict=True):
        a, b = top(a), top(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    names = sorted(up)
    return pd.DataFrame({"graph_id": pdf.graph_id.iloc[0], "component": names, "to": [top(x) for x in names]}, dtype=object)


def _ends(hooks: DataFrame) -> DataFrame:
    """(graph_id, component, to) with ``to`` at the end of its chain of hooks; each pass doubles what a hook spans. Every hook leads to a lesser name, so there are no cycles."""
    while True:
        onward = hooks.select("graph_id", F.col("component").alias("to"), F.col("to").alias("further"))
        new = durable(hooks.join(onward, ["graph_id", "to"], "left").select("graph_id", "component", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")))
        discard(hooks)
        if new.where("moved").isEmpty():
            return new.drop("moved")
        hooks = new.drop("moved")


def two_cycles(edges: DataFrame) -> DataFrame:
    """Pairs a < b with edges both ways."""
    e = real(edges).select("graph_id", "src", "dst").distinct()
    back = e.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return e.where("src < dst").join(back, ["graph_id", "src", "dst"]).select("graph_id", F.col("src").alias("a"), F.col("dst").alias("b"))


def depth_tag(depth: Column) -> Column:
    """DIRECT, TRANSITIVE or DISTANT."""
    return F.when(depth == 1, "DIRECT").when(depth == 2, "TRANSITIVE").otherwise("DISTANT")


def callers(edges: DataFrame, scores: DataFrame, depth: int = 5, per_depth: int = 4) -> DataFrame:
    """The ``per_depth`` most authoritative callers of each node at each depth; scores: graph_id, node, authority."""
    c = closure(edges, depth=depth, backwards=True).join(scores, ["graph_id", "node"], "left")
    order = W.partitionBy("graph_id", "start", "depth").orderBy(F.col("authority").desc_nulls_last(), "node")
    return c.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_depth).withColumn("tag", depth_tag(F.col("depth")))


def impact(edges: DataFrame) -> DataFrame:
    """(graph_id, start, node, effect): direct runtime dependants will break, those two hops away are likely to; tests apart."""
    run = real(edges).where(~F.coalesce("is_type_only", F.lit(False)))
    c = closure(run, depth=2, backwards=True, keep_all=False).where("start <> node")
    effect = F.when(F.col("node").rlike(TEST_FILE), "test").when(F.col("depth") == 1, "will break").otherwise("likely")
    return c.withColumn("effect", effect)


#: Verdict of a direct dependant by change and edge kind.
BREAKS = {
    "delete": ["calls", "extends", "implements", "satisfies", "embeds", "uses_type", "decorates", "imports"],
    "signature": ["calls", "implements", "satisfies", "extends"],
    "rename": ["calls", "extends", "implements", "embeds", "uses_type", "imports"],
    "behavior": [],
}
MAYBE = {"behavior": ["calls", "extends", "embeds"], "signature": ["embeds", "uses_type"], "rename": ["satisfies"]}


def verdict(change: Column, kind: Column, confidence: Column, depth: Column) -> Column:
    """BREAKING, UNKNOWN or COMPATIBLE: confidence under .5 is unknown, so is depth over 1 unless something is deleted."""
    breaks, maybe = F.lit(False), F.lit(False)
    for name, kinds in BREAKS.items():
        breaks = breaks | ((change == name) & kind.isin(kinds)) if kinds else breaks
    for name, kinds in MAYBE.items():
        maybe = maybe | ((change == name) & kind.isin(kinds))
    return F.when(confidence < 0.5, "UNKNOWN").when((depth > 1) & (change != "delete"), "UNKNOWN").when(breaks, "BREAKING").when(maybe, "UNKNOWN").otherwise("COMPATIBLE")


def safe_change(edges: DataFrame, changes: DataFrame, depth: int = 3) -> DataFrame:
    """Verdict per dependant of a changed node: hop 1 over all kinds, then only calls, extends and implements.

    ``edges``: graph_id, src, dst, kind, confidence; ``changes``: graph_id, node, change. Least depth per dependant and
    kind; its own edges' lowest confidence counts.
    """
    e = real(edges).select("graph_id", "src", "dst", "kind", "confidence")
    changed = changes.select("graph_id", F.col("node").alias("start"), "change", F.col("node").alias("dst"))
    level = changed.join(e, ["graph_id", "dst"]).select("graph_id", "start", "change", F.col("src").alias("node"), "kind", "confidence", F.lit(1).alias("depth"))
    out = level
    strong = e.where(F.col("kind").isin("calls", "extends", "implements"))
    for k in range(2, depth + 1):
        level = level.select("graph_id", "start", "change", F.col("node").alias("dst")).distinct().join(strong, ["graph_id", "dst"]).select("graph_id", "start", "change", F.col("src").alias("node"), "kind", "confidence", F.lit(k).alias("depth"))
        out = out.unionByName(level)
    least = out.where("start <> node").groupBy("graph_id", "start", "change", "node", "kind").agg(F.min("depth").alias("depth"), F.min("confidence").alias("confidence"))
    return least.withColumn("verdict", verdict(F.col("change"), F.col("kind"), F.coalesce("confidence", F.lit(0.5)), F.col("depth")))


def test_map(edges: DataFrame, nodes: DataFrame, depth: int = 3) -> DataFrame:
    """(graph_id, node, direct, covered, test_type): which source nodes tests import directly or within ``depth`` hops."""
    tests = nodes.where(F.col("node").rlike(TEST_FILE)).select("graph_id", F.col("node").alias("start"))
    c = closure(edges, tests, depth, keep_all=False).where(~F.col("node").rlike(TEST_FILE))
    n = c.groupBy("graph_id", "node").agg(F.sum((F.col("depth") == 1).cast("int")).alias("direct"), F.count("*").alias("covered"))
    kind = F.when(F.col("direct") > 0, "unit").when(F.col("covered") > 0, "integration").otherwise("none")
    sources = nodes.where(~F.col("node").rlike(TEST_FILE)).select("graph_id", "node")
    return sources.join(n, ["graph_id", "node"], "left").select("graph_id", "node", F.coalesce("direct", F.lit(0)).alias("direct"), F.coalesce("covered", F.lit(0)).alias("covered")).withColumn("test_type", kind)


def cover(edges: DataFrame, starts: DataFrame, depth: int = 3) -> DataFrame:
    """How many nodes each start covers within ``depth`` hops."""
    return closure(edges, starts, depth, keep_all=False).groupBy("graph_id", "start").agg(F.count("*").alias("covered"))


def package_of(files: DataFrame, packages: DataFrame) -> DataFrame:
    """Longest package directory that contains each file; files: path; packages: package. Files outside any get null.

    The directories above a file are few, so the join is on equality with each of them.
    """
    parts = F.split("path", "/")
    ups = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    each = files.select("path", F.explode(ups).alias("package"))
    best = each.join(packages.select("package").distinct(), "package").groupBy("path").agg(F.max_by("package", F.length("package")).alias("package"))
    return files.select("path").join(best, "path", "left")


def cross_package(edges: DataFrame, packages: DataFrame) -> DataFrame:
    """(from_package, to_package, edges) between different packages; packages: path, package."""
    of = lambda end: packages.select(F.col("path").alias(end), F.col("package").alias(f"{end}_package"))
    x = real(edges).join(of("src"), "src").join(of("dst"), "dst").where("src_package <> dst_package")
    return x.groupBy(F.col("src_package").alias("from_package"), F.col("dst_package").alias("to_package")).agg(F.count("*").alias("edges"))


def entry_points(edges: DataFrame, nodes: DataFrame, least: float = 0.3) -> DataFrame:
    """Score .3 without callers, .3 for a route, .2 for a telling name, .2 · hub above .5; nodes: graph_id, node, hub, is_route."""
    called = real(edges).select("graph_id", F.col("dst").alias("node")).distinct().withColumn("called", F.lit(True))
    n = nodes.join(called, ["graph_id", "node"], "left")
    name = F.col("node").rlike(r"(?i)(^|[/._])(main|index|handler|run|start|app|server|cli|execute|process)")
    score = F.when(F.col("called").isNull(), 0.3).otherwise(0.0) + F.when(F.col("is_route"), 0.3).otherwise(0.0) + F.when(name, 0.2).otherwise(0.0) + F.when(F.col("hub") > 0.5, 0.2 * F.col("hub")).otherwise(0.0)
    return n.withColumn("score", score).where(F.col("score") >= least).select("graph_id", "node", "score")


def terminals(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes from which nothing flows on, or only into other packages; edges may carry cross_package."""
    inner = real(edges).where(~F.coalesce("cross_package", F.lit(False))).select("graph_id", F.col("src").alias("node")).distinct()
    return nodes.select("graph_id", "node").join(inner, ["graph_id", "node"], "left_anti")
