"""From a task's words to places in the code: seeds, task subgraph, propagation, flows, verification, silence."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import dot
from ..shared import durable
from . import graph as G
from . import kernels as K
from . import retrieval as R
from . import traversal as T
from .edges import degrees, real

#: Seed scores and limits, expansion by latent vectors, flow limits, discounts.
PATH_HIT, SYMBOL_HIT, AUTHORITY, SEEDS = 2.0, 1.5, 0.5, 10
LATENT_LEAST, LATENT_MOST, LATENT_SHARE = 0.3, 5, 0.4
FLOW_ENTRIES, FLOW_ENDS, FLOW_HOPS, FLOW_PATHS, FLOW_EDGES, FLOWS = 3, 3, 10, 3, 2, 5
REACH_LEAST, RESEED_QUANTILE, RESEED_BELOW = 1e-3, 0.75, 0.1
NEGATION_WINDOW, SHORT_PROMPT = 30, 10
#: How much of a score an edge kind passes on, backwards and for guessed edges less.
TRANSMISSION = {"calls": 0.7, "extends": 0.8, "implements": 0.6, "satisfies": 0.5, "embeds": 0.75, "uses_type": 0.3, "decorates": 0.9, "imports": 0.7}
BACKWARDS, GHOST = 0.7, 0.6
#: Fading a day and its floor, power and floor of authority, days of unknown age.
FADE, FADE_FLOOR, AUTHORITY_POWER, LEAST_AUTHORITY, UNKNOWN_AGE = 0.0333, 0.05, 0.7, 0.01, 365.0
#: Weights of edge kinds in symbol hub scores, base kinds of guessed kinds.
KIND_WEIGHT = {"calls": 1.0, "extends": 1.0, "implements": 0.3, "satisfies": 0.3, "embeds": 0.8, "uses_type": 0.3, "decorates": 0.7, "imports": 1.0}
BASE_KIND = {"di_inject": "calls", "event_bind": "calls", "route": "calls", "trait_bound": "implements", "descriptor": "uses_type"}


def _lookup(c: Column, table: dict, default: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[c], default)


def kind_weight(kind: Column) -> Column:
    """Weight of an edge kind; guessed kinds by their base kind, unknown ones .3."""
    return _lookup(_lookup(kind, BASE_KIND, kind), KIND_WEIGHT, F.lit(0.3))


def transmission(kind: Column, backwards: Column, ghost: Column) -> Column:
    """Share of a score that an edge passes on."""
    return _lookup(_lookup(kind, BASE_KIND, kind), TRANSMISSION, F.lit(0.3)) * F.when(backwards, BACKWARDS).otherwise(1.0) * F.when(ghost, GHOST).otherwise(1.0)


def both_ways(edges: DataFrame) -> DataFrame:
    """(graph_id, src, dst, weight): what share of a score each typed edge passes on, forwards and, less, backwards.

    ``edges``: graph_id, src, dst, kind, confidence; kinds of guessed edges are those of BASE_KIND, and pass on less. A null
    confidence counts 1; several edges between two nodes add up.
    """
    e = real(edges).withColumn("c", F.coalesce("confidence", F.lit(1.0)))
    ghost = F.col("kind").isin(list(BASE_KIND))
    ahead = e.select("graph_id", "src", "dst", (transmission(F.col("kind"), F.lit(False), ghost) * F.col("c")).alias("weight"))
    back = e.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"), (transmission(F.col("kind"), F.lit(True), ghost) * F.col("c")).alias("weight"))
    return ahead.unionByName(back).groupBy("graph_id", "src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(edges: DataFrame, starts: dict[str, float] | DataFrame, rounds: int = K.KATZ_ROUNDS, epsilon: float = K.KATZ_EPSILON) -> DataFrame:
    """Katz scores over typed edges, mass going both ways; ``starts`` as in graph.katz."""
    return G.katz(both_ways(edges), starts, rounds, epsilon)


def fading(days: Column, default: float) -> Column:
    """exp(-.0333 · days), .05 at least; ``default`` where the days are unknown."""
    return F.coalesce(F.greatest(F.lit(FADE_FLOOR), F.exp(-FADE * days)), F.lit(default))


def flow_weights(edges: DataFrame, authority: DataFrame, blame: DataFrame | None = None) -> DataFrame:
    """(graph_id, src, dst, weight): weights of typed edges for the absorbing flow; rows are made to sum to 1 there.

    weight = kind · confidence (.5 if unknown) · max(authority of dst, .01)^.7 · fading of the last common change (.05 if
    none) · fading of the age of dst (365 days if unknown; 1 without ``blame``) · attenuation of dst · prior (1 if none).
    ``edges``: graph_id, src, dst, kind, confidence, cochange_days, prior, only kinds that pass on flow; ``authority``:
    graph_id, node, authority; ``blame``: graph_id, node, days.
    """
    e = real(edges)
    degree = durable(degrees(e))
    size = degree.groupBy("graph_id").agg(F.count("*").alias("nodes"))
    of_dst = degree.join(size, "graph_id").select("graph_id", F.col("node").alias("dst"), attenuation(F.col("in_degree"), F.col("out_degree"), F.col("nodes")).alias("inf"))
    x = e.join(of_dst, ["graph_id", "dst"]).join(authority.select("graph_id", F.col("node").alias("dst"), "authority"), ["graph_id", "dst"], "left")
    age = F.lit(1.0)
    if blame is not None:
        x = x.join(blame.select("graph_id", F.col("node").alias("dst"), F.col("days").alias("age_days")), ["graph_id", "dst"], "left")
        age = fading(F.coalesce("age_days", F.lit(UNKNOWN_AGE)), FADE_FLOOR)
    strength = F.pow(F.greatest(F.coalesce("authority", F.lit(0.0)), F.lit(LEAST_AUTHORITY)), F.lit(AUTHORITY_POWER))
    w = kind_weight(F.col("kind")) * F.coalesce("confidence", F.lit(0.5)) * strength * fading(F.col("cochange_days"), FADE_FLOOR) * age * F.col("inf") * F.coalesce("prior", F.lit(1.0))
    return x.select("graph_id", "src", "dst", w.alias("weight")).groupBy("graph_id", "src", "dst").agg(F.sum("weight").alias("weight"))


def attenuation(in_degree: Column, out_degree: Column, nodes: Column) -> Column:
    """Less for nodes that everything points at and little leaves: the inverse frequency of being a target, 1 for others."""
    idf = F.log((nodes + 1) / (in_degree + 1)) / F.log(nodes + 1)
    return F.when((in_degree > out_degree) & (nodes > 1), F.greatest(idf, F.lit(0.1))).otherwise(1.0)


def seeds(symbols: DataFrame, terms: DataFrame, most: int = SEEDS) -> DataFrame:
    """(query, id, score): +2 per term in the path, +1.5 in the name, times (1 + .5 · authority), the best ``most``.

    ``symbols``: id, path_tokens, name_tokens, authority; ``terms``: query, term.
    """
    hit = lambda c, w: symbols.select("id", "authority", F.explode(F.array_distinct(c)).alias("term")).join(terms, "term").select("query", "id", "authority", F.lit(w).alias("w"))
    s = hit("path_tokens", PATH_HIT).unionByName(hit("name_tokens", SYMBOL_HIT)).groupBy("query", "id").agg((F.sum("w") * (1 + AUTHORITY * F.coalesce(F.max("authority"), F.lit(0.0)))).alias("score"))
    return R.top_k(s, most, ["query"], [F.round("score", 9).desc(), F.col("id")])


def latent_seeds(seed_scores: DataFrame, vectors: DataFrame, least: float = LATENT_LEAST, most: int = LATENT_MOST) -> DataFrame:
    """(query, item, score): items whose vector is within ``least`` cosine of the weighted centre of the seeds' vectors.

    Each gets .4 of the least seed score; seeds themselves are left out. ``seed_scores``: query, item, score; vectors: item, vector.
    With graph_id in both, the search stays within each graph, as vectors of two graphs have nothing in common, and graph_id is put in front.
    """
    within = ["graph_id"] if "graph_id" in vectors.columns else []
    part = seed_scores.join(vectors, [*within, "item"]).select(*within, "query", "score", F.posexplode("vector").alias("i", "x"))
    centre = part.groupBy(*within, "query", "i").agg((F.sum(F.col("x") * F.col("score")) / F.sum("score")).alias("x")).groupBy(*within, "query").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centre"))
    low = seed_scores.groupBy(*within, "query").agg((LATENT_SHARE * F.min("score")).alias("score"))
    unit = lambda c: F.transform(c, lambda x: x / F.nullif(F.sqrt(dot(F.col(c), F.col(c))), F.lit(0.0)))
    asked, items = centre.select(*within, "query", unit("centre").alias("embedding")), vectors.select(*within, F.col("item").alias("id"), unit("vector").alias("embedding"))
    if within:
        near = asked.join(items.withColumnRenamed("embedding", "other"), within).select(*within, "query", "id", dot(F.col("embedding"), F.col("other")).alias("score"))
    else:
        near = R.knn(asked, items, most + SEEDS)
    fresh = near.where(F.col("score") >= least).select(*within, "query", F.col("id").alias("item"), F.col("score").alias("cosine")).join(seed_scores.select(*within, "query", "item"), [*within, "query", "item"], "left_anti")
    return R.top_k(fresh, most, [*within, "query"], [F.round("cosine", 9).desc(), F.col("item")]).join(low, [*within, "query"]).select(*within, "query", "item", "score")


def task_subgraph(edges: DataFrame, starts: DataFrame, depth: int = 2) -> DataFrame:
    """Edges between nodes within ``depth`` hops, either way, of the starts (graph_id, start); graph_id becomes graph and start."""
    both = real(edges).select("graph_id", "src", "dst").unionByName(real(edges).select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst")))
    near = T.closure(both, starts, depth, keep_all=False).select("graph_id", "start", "node").unionByName(starts.select("graph_id", "start", F.col("start").alias("node"))).distinct()
    of = lambda end: near.select("graph_id", "start", F.col("node").alias(end))
    inside = real(edges).join(of("src"), ["graph_id", "src"]).join(of("dst"), ["graph_id", "start", "dst"])
    return inside.withColumn("graph_id", F.concat_ws(":", "graph_id", "start")).drop("start")


def task_hits(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Hub and authority scores within the neighbourhood of each start, with roles."""
    h = G.hits(task_subgraph(edges, starts))
    return h.withColumn("role", G.role(F.col("authority"), F.col("hub")))


def symbol_hits(edges: DataFrame, rounds: int = 30) -> DataFrame:
    """Hub and authority scores over typed edges (graph_id, src, dst, kind, confidence), scaled every round."""
    w = kind_weight(F.col("kind")) * F.coalesce("confidence", F.lit(1.0))
    return G.hits(edges.withColumn("weight", w).select("graph_id", "src", "dst", "weight"), rounds, every_round=True)


def strongest_paths(edges: DataFrame, starts: dict[str, float], least: float = REACH_LEAST) -> DataFrame:
    """(graph_id, node, score): the greatest product of weights over any path from a start; weights at most 1."""

    def f(n, names, src, dst, w):
        at = {v: i for i, v in enumerate(names)}
        nexts: list[dict[int, float]] = [{} for _ in range(n)]
        for a, b, x in zip(src.tolist(), dst.tolist(), w.tolist(), strict=True):
            nexts[a][b] = max(nexts[a].get(b, 0.0), min(x, 1.0))
        best = {at[v]: s for v, s in starts.items() if v in at}
        todo = sorted(((-s, v) for v, s in best.items()))
        import heapq

        heapq.heapify(todo)
        while todo:
            s, v = heapq.heappop(todo)
            if -s < best[v]:
                continue
            for u, x in nexts[v].items():
                if -s * x >= least and -s * x > best.get(u, 0.0):
                    best[u] = -s * x
                    heapq.heappush(todo, (s * x, u))
        return ((names[v], s) for v, s in sorted(best.items()))

    return G.per_graph(edges, f, "node string, score double")


def reseeded(edges: DataFrame, scores: DataFrame, starts: dict[str, float]) -> DataFrame:
    """Katz scores once more from nodes of high betweenness that the first pass hardly reached, each graph from its own; the greater score counts.

    ``scores``: graph_id, node, betweenness. High is above the element at floor(.75 · (n - 1)) of the graph's sorted values.
    """
    first = durable(G.katz(edges, starts))
    ordered = scores.groupBy("graph_id").agg(F.array_sort(F.collect_list("betweenness")).alias("all"))
    limit = ordered.select("graph_id", F.element_at("all", (F.floor(RESEED_QUANTILE * (F.size("all") - 1)) + 1).cast("int")).alias("limit"))
    weak = scores.join(limit, "graph_id").join(first, ["graph_id", "node"], "left").where((F.col("betweenness") > F.col("limit")) & (F.coalesce("score", F.lit(0.0)) < RESEED_BELOW))
    again = G.katz(edges, durable(weak.select("graph_id", "node", F.col("betweenness").alias("value"))))
    return first.unionByName(again).groupBy("graph_id", "node").agg(F.max("score").alias("score"))


def flows(edges: DataFrame, entries: dict[str, float], ends: list[str], community: dict[str, int] | None = None) -> DataFrame:
    """(graph_id, rank, path, confidence, through, crossings): likely execution flows from entries to terminals.

    The three best entries meet the three nearest terminals within ten hops; up to three unlike paths of two or more edges
    each, confidence the product of weights; ``through`` names the nodes of a path that dominate its end, ``crossings``
    counts changes of community. The best five are kept. A graph of any number of nodes is searched, up to the edges that
    ``per_graph`` takes; beyond them it raises an error.
    """
    groups = community or {}

    def f(n, names, src, dst, w):
        at = {v: i for i, v in enumerate(names)}
        nexts = K.neighbours(n, src, dst)
        found = []
        for entry in sorted((v for v in entries if v in at), key=lambda v: (-entries[v], v))[:FLOW_ENTRIES]:
            far = K.distances(nexts, at[entry], FLOW_HOPS)
            idom = K.dominators(n, src, dst, at[entry])
            for end in sorted((v for v in ends if v in at and v != entry and at[v] in far), key=lambda v: (far[at[v]], v))[:FLOW_ENDS]:
                must, x = set(), at[end]
                while x != idom.get(x, x):
                    x = idom[x]
                    must.add(x)
                for cost, path in K.diverse_paths(n, src, dst, w, at[entry], at[end], FLOW_PATHS):
                    if len(path) > FLOW_EDGES:
                        labels = [groups.get(names[v]) for v in path]
                        found.append((float(np.exp(-cost)), ">".join(names[v] for v in path), ",".join(names[v] for v in path if v in must), sum(a != b for a, b in zip(labels, labels[1:], strict=False))))
        found.sort(key=lambda x: (-x[0], x[1]))
        return [(i, p, c, t, k) for i, (c, p, t, k) in enumerate(found[:FLOWS])]

    return G.per_graph(edges, f, "rank int, path string, confidence double, through string, crossings int")


def mentions(prompt: Column, target: Column) -> Column:
    """Whether a prompt names a target, not counting names within 30 characters after a negation."""
    at = F.instr(F.lower(prompt), F.lower(target))
    before = F.substring(prompt, F.greatest(at - NEGATION_WINDOW, F.lit(1)), F.least(at - 1, F.lit(NEGATION_WINDOW)))
    return (at > 0) & ~F.coalesce(before.rlike(r"(?i)\b(not|don't|never|without|except|avoid|instead of)\b"), F.lit(False))


def trivial(prompt: Column, known: tuple = ("yes", "no", "ok", "okay", "thanks", "continue", "go on", "done")) -> Column:
    """Prompts too short or plain to act on; null counts as trivial."""
    p = F.lower(F.trim(F.coalesce(prompt, F.lit(""))))
    return (F.length(p) < SHORT_PROMPT) | p.isin(*known)


def silence(state: DataFrame) -> DataFrame:
    """Why nothing is shown, the first reason that holds, or null; state: is_trivial, best, targets, graph_age_days, mentioned."""
    reason = F.when(F.col("is_trivial"), "trivial prompt").when(F.col("targets") == 0, "no targets").when(F.col("best") < 0.3, "low confidence").when(F.col("graph_age_days") > 30, "stale graph").when(F.col("mentioned"), "target already named")
    return state.withColumn("reason", reason)


def verified(candidates: DataFrame, changed: DataFrame, weights: tuple = (0.5, 0.3, 0.2)) -> DataFrame:
    """Candidates with evidence and a recalibrated score; candidates: query, item, score, lexical, structural, temporal; changed: query, item.

    Each kind of evidence counts from .3 on; with none the score is halved, with all three it gains a tenth, up to 1.
    """
    kinds = ["lexical", "structural", "temporal"]
    has = [F.coalesce(F.col(k) >= 0.3, F.lit(False)) for k in kinds]
    n = sum((h.cast("int") for h in has), F.lit(0))
    evidence = F.concat_ws("+", *[F.when(h, k) for h, k in zip(has, kinds, strict=True)])
    confidence = sum((F.when(h, w).otherwise(0.0) for h, w in zip(has, weights, strict=True)), F.lit(0.0))
    new = F.least(F.when(n == 0, F.col("score") / 2).when(n == 3, F.col("score") * 1.1).otherwise(F.col("score")), F.lit(1.0))
    hit = changed.select("query", "item", F.lit(True).alias("was_changed")).distinct()
    return candidates.join(hit, ["query", "item"], "left").select("query", "item", new.alias("score"), evidence.alias("evidence"), confidence.alias("confidence"), F.coalesce("was_changed", F.lit(False)).alias("was_changed"))
