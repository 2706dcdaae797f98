"""Choosing targets: order among equals, match types, confidence, couplings with seeds, costs, risk, and their export as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import latest_by
from .edges import real
from .retrieval import top_k
from .traversal import closure

#: Least token cost of a symbol and cost of an edge; hops, fading, shares, threshold and length of the risk report.
LEAST_COST, EDGE_COST, CHARS = 10, 5, 4
RISK_HOPS, RISK_FADE, RISK_OWN, RISK_FAR, RISK_LEAST, RISK_TOP = 5, 0.5, 0.3, 0.7, 0.1, 15
#: Candidates, lexical, semantic and final results of find, and its bands of confidence relative to the best.
POOL, LEXICAL, SEMANTIC, FOUND, HIGH, MEDIUM = 1000, 20, 50, 5, 0.8, 0.5


def best_coupling(candidates: DataFrame, seeds: DataFrame, couplings: DataFrame) -> DataFrame:
    """(query, item, coupling): the greatest coupling of each candidate with any seed of its query, 0 where there is none.

    ``candidates`` and ``seeds``: query, item; ``couplings``: a, b, value, which holds either way round; a null value counts
    0, and of several values of a pair the greatest counts. A candidate is not coupled with itself.
    """
    c = couplings.select("a", "b", F.coalesce("value", F.lit(0.0)).alias("value"))
    both = c.unionByName(c.select(F.col("b").alias("a"), F.col("a").alias("b"), "value")).where("a <> b").groupBy("a", "b").agg(F.max("value").alias("value"))
    wanted = candidates.select("query", "item").distinct()
    met = wanted.join(both.withColumnRenamed("a", "item"), "item").join(seeds.select("query", F.col("item").alias("b")).distinct(), ["query", "b"])
    best = met.groupBy("query", "item").agg(F.max("value").alias("coupling"))
    return wanted.join(best, ["query", "item"], "left").withColumn("coupling", F.coalesce("coupling", F.lit(0.0)))


def page(rows: DataFrame, order: list[Column], size: int, number: int) -> DataFrame:
    """Page ``number`` (from 0) of ``size`` rows under a total ``order``; past the end it is empty."""
    return rows.orderBy(*order).offset(size * number).limit(size)


def in_order(scored: DataFrame, top: int | None = None) -> DataFrame:
    """``scored`` with rank: by score, then files that import the target, betweenness, in-degree and path.

    ``scored``: query, item, score, imports_target, betweenness, in_degree. Null counts as the least. With ``top`` only the
    first ranks stay, which a partition cuts to before anything is shuffled.
    """
    order = [F.round("score", 9).desc_nulls_last(), F.coalesce("imports_target", F.lit(False)).desc(), F.col("betweenness").desc_nulls_last(), F.col("in_degree").desc_nulls_last(), F.col("item").asc()]
    return top_k(scored, top or 1 << 30, ["query"], order)


def match_type(lexical: Column, only_imports: Column, coupled: Column, neighbour: Column) -> Column:
    """How an item was found: direct, import-only, coupling or neighbor, the first that holds; else null."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(yes(lexical) & ~yes(only_imports), "direct").when(yes(lexical), "import-only").when(yes(coupled), "coupling").when(yes(neighbour), "neighbor")


def relative_confidence(ranked: DataFrame) -> DataFrame:
    """``ranked`` (query, item, score) with share of the query's best score and its band: high, medium or low."""
    best = ranked.groupBy("query").agg(F.max("score").alias("best"))
    share = F.when(F.col("best") > 0, F.col("score") / F.col("best")).otherwise(0.0)
    out = ranked.join(best, "query").withColumn("share", share).drop("best")
    return out.withColumn("confidence", F.when(F.col("share") >= HIGH, "high").when(F.col("share") >= MEDIUM, "medium").otherwise("low"))


def symbol_cost(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, cost): tokens to show a symbol: a quarter of the characters of name and path, 5 for each edge at it, 10 at least.

    ``symbols``: id, name, path; ``edges``: src, dst are ids. Null names and paths have no characters.
    """
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).where("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("n"))
    chars = F.length(F.coalesce("name", F.lit(""))) + F.length(F.coalesce("path", F.lit("")))
    cost = F.greatest(F.lit(LEAST_COST), F.ceil(chars / CHARS) + EDGE_COST * F.coalesce("n", F.lit(0)))
    return symbols.join(ends, "id", "left").select("id", cost.cast("bigint").alias("cost"))


def churn_risk(edges: DataFrame, churn: DataFrame, top: int | None = RISK_TOP) -> DataFrame:
    """(graph_id, node, own, far, risk): how much a file's dependencies up to five hops away change.

    ``churn``: graph_id, node, churn in 0..1. far = sum of churn · .5^hops over the nodes within five hops, each at its least
    distance and at most 1; risk = .3 own + .7 far, from .1 on, the ``top`` of each graph (None: all).
    """
    near = closure(edges, depth=RISK_HOPS, keep_all=False).where("start <> node")
    part = near.join(churn, ["graph_id", "node"]).groupBy("graph_id", F.col("start").alias("node")).agg(F.least(F.lit(1.0), F.sum(F.col("churn") * F.pow(F.lit(RISK_FADE), F.col("depth")))).alias("far"))
    both = churn.select("graph_id", "node", F.col("churn").alias("own")).join(part, ["graph_id", "node"], "full").fillna(0.0, ["own", "far"])
    risk = both.withColumn("risk", RISK_OWN * F.col("own") + RISK_FAR * F.col("far")).where(F.round("risk", 9) >= RISK_LEAST)
    return risk if top is None else top_k(risk, top, ["graph_id"], [F.round("risk", 9).desc(), F.col("node")]).drop("rank")


def best_member(scores: DataFrame) -> DataFrame:
    """(file, score, name): the greatest score of a file's symbols and the symbol that has it, the first by name among equals."""
    top = scores.where("score IS NOT NULL AND NOT isnan(score)").groupBy("file").agg(F.min_by("name", F.struct(-F.col("score"), F.col("name"))).alias("name"), F.max("score").alias("score"))
    return top.select("file", "score", "name")


def file_edges(edges: DataFrame, type_kinds: list[str]) -> DataFrame:
    """(graph_id, src, dst, names, is_type_only) of symbol edges graph_id, src, dst, name, kind: type-only if all kinds are."""
    e = real(edges).where("src <> dst")
    names = F.array_sort(F.collect_set("name"))
    return e.groupBy("graph_id", "src", "dst").agg(names.alias("names"), F.bool_and(F.col("kind").isin(type_kinds)).alias("is_type_only"))


def rows_as_json(rows: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """(group, rows): the rows of each group as one JSON array of arrays, sorted; for exports of small groups, as a group ends in one value."""
    one = F.array(*[F.col(c).cast("string") for c in columns])
    return rows.groupBy(group).agg(F.to_json(F.array_sort(F.collect_list(one))).alias("rows"))


def write_json(report: DataFrame, folder: str) -> None:
    """The JSON sink: one line a row, in as many files as the report has partitions; an existing folder is replaced."""
    report.write.mode("overwrite").json(folder)


def latest_files(files: DataFrame) -> DataFrame:
    """The latest row of each path with a path."""
    return latest_by(files.where("path IS NOT NULL"), ["path"], ["updated_at"])
