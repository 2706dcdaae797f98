"""Reports that draw several fact tables together: graph cards, review findings, change impact, debt, conventions, packages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import retrieval as R
from . import traversal as T

#: Limits of the reports.
CO_CHANGES, BOTTLENECK, RISKS, DEBT_TOP, IMPACT_TOP, SIGNIFICANT = 3, 0.1, 2, 5, 5, 0.05
#: Patterns of branches for the complexity proxy, and its bands.
BRANCHES = [r"\bif\b", r"\belse\b", r"\bfor\b", r"\bwhile\b", r"\bcase\b", r"\bcatch\b", r"&&", r"\|\|", r"\?\?", r"\?[^.:?]"]
HIGH, MEDIUM = 50, 20


def cards(files: DataFrame, coupled: DataFrame, tests: DataFrame) -> DataFrame:
    """One row per file: role, its three strongest co-changes and how many tests cover it.

    files: path, role; coupled: file_a, file_b, confidence; tests: path, test.
    """
    both = coupled.select(F.col("file_a").alias("path"), F.col("file_b").alias("other"), "confidence").unionByName(coupled.select(F.col("file_b").alias("path"), F.col("file_a").alias("other"), "confidence"))
    top = R.top_k(both, CO_CHANGES, ["path"], [F.round("confidence", 9).desc(), F.col("other")]).groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "other"))), lambda x: x["other"]), ",").alias("co_changes"))
    n = tests.groupBy("path").agg(F.countDistinct("test").alias("tests"))
    return files.join(top, "path", "left").join(n, "path", "left").select("path", "role", F.coalesce("co_changes", F.lit("")).alias("co_changes"), F.coalesce("tests", F.lit(0)).alias("tests"))


def significant(files: DataFrame) -> DataFrame:
    """Files worth a place on a context map; files: path, betweenness, is_chokepoint, co_changes, has_integration_test."""
    return files.where((F.col("betweenness") > SIGNIFICANT) | F.coalesce("is_chokepoint", F.lit(False)) | (F.col("co_changes") > 0) | F.coalesce("has_integration_test", F.lit(False)))


def missing_co_changes(changed: DataFrame, coupled: DataFrame, least: float = 0.5) -> DataFrame:
    """(file, missing, confidence): partners of changed files, likely to change with them, that did not; changed: file."""
    way = coupled.select(F.col("file_a").alias("file"), F.col("file_b").alias("missing"), F.col("conf_ab").alias("confidence")).unionByName(coupled.select(F.col("file_b").alias("file"), F.col("file_a").alias("missing"), F.col("conf_ba").alias("confidence")))
    x = way.where(F.col("confidence") >= least).join(changed.select("file").distinct(), "file", "left_semi")
    return x.join(changed.select(F.col("file").alias("missing")).distinct(), "missing", "left_anti").select("file", "missing", "confidence")


def findings(changed: DataFrame, files: DataFrame) -> DataFrame:
    """(file, finding) for changed files that are chokepoints, cross-cutting or bottlenecks; files: path and these flags."""
    x = changed.select(F.col("file").alias("path")).distinct().join(files, "path")
    kinds = F.array_compact(F.array(F.when(F.col("is_chokepoint"), "chokepoint"), F.when(F.col("is_cross_cutting"), "cross-cutting"), F.when(~F.isnan("betweenness") & (F.col("betweenness") > BOTTLENECK), "bottleneck")))
    return x.select(F.col("path").alias("file"), F.explode(kinds).alias("finding"))


def change_impact(edges: DataFrame, coupled: DataFrame, start: DataFrame, depth: int = 5, top: int = IMPACT_TOP) -> DataFrame:
    """What a change reaches: ranks by distance, by coupling and by shared folder, fused; start: graph_id, start.

    edges: graph_id, src, dst; coupled: graph_id, a, b, confidence.
    """
    from ..functions.paths import directory

    near = T.closure(edges, start, depth, backwards=True, keep_all=False).where("start <> node")
    structural = R.top_k(near, 1 << 30, ["graph_id", "start"], [F.col("depth"), F.col("node")])
    both = coupled.select("graph_id", F.col("a").alias("start"), F.col("b").alias("node"), "confidence").unionByName(coupled.select("graph_id", F.col("b").alias("start"), F.col("a").alias("node"), "confidence"))
    temporal = R.top_k(both.join(start, ["graph_id", "start"], "left_semi"), 1 << 30, ["graph_id", "start"], [F.round("confidence", 9).desc(), F.col("node")])
    found = structural.select("graph_id", "start", "node").unionByName(temporal.select("graph_id", "start", "node")).distinct()
    folder = R.top_k(found.withColumn("same", (directory(F.col("start")) == directory(F.col("node"))).cast("int")), 1 << 30, ["graph_id", "start"], [F.col("same").desc(), F.col("node")])
    query = lambda x: x.select(F.concat_ws("|", "graph_id", "start").alias("query"), F.col("node").alias("item"), "rank")
    fused = R.rrf([query(structural), query(temporal), query(folder)])
    return R.top_k(fused, top, ["query"], [F.round("score", 9).desc(), F.col("item")])


def debt(factors: list[DataFrame], least: int = RISKS, top: int = DEBT_TOP) -> DataFrame:
    """Files with at least ``least`` distinct risk factors, the worst first; factors: file, factor."""
    x = reduce(lambda a, b: a.unionByName(b), factors).groupBy("file").agg(F.countDistinct("factor").alias("factors"), F.array_join(F.array_sort(F.collect_set("factor")), ",").alias("which"))
    return x.where(F.col("factors") >= least).orderBy(F.col("factors").desc(), "file").limit(top)


def complexity(text: Column) -> Column:
    """Number of branching patterns in a text; 0 for null."""
    counts = [F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), F.lit(0))) for p in BRANCHES]
    return reduce(lambda a, b: a + b, counts)


def band(n: Column) -> Column:
    """high, medium or low complexity."""
    return F.when(n > HIGH, "high").when(n >= MEDIUM, "medium").otherwise("low")


def package_view(report: DataFrame, columns: list[str], package: str) -> DataFrame:
    """Rows of a report whose path columns all lie in a package, the package's prefix cut off."""
    prefix = package.rstrip("/") + "/"
    out = report
    for c in columns:
        out = out.where(F.col(c).startswith(prefix))
    return out.withColumns({c: F.substring(c, len(prefix) + 1, 1 << 30) for c in columns})


def encapsulation_breaks(edges: DataFrame, packages: DataFrame) -> DataFrame:
    """Cross-package edges that reach past a package's entry file; packages: path, package, is_entry."""
    src = packages.select(F.col("path").alias("src"), F.col("package").alias("from_package"))
    dst = packages.select(F.col("path").alias("dst"), F.col("package").alias("to_package"), "is_entry")
    return edges.join(src, "src").join(dst, "dst").where("from_package <> to_package AND NOT coalesce(is_entry, false)").select("src", "dst", "from_package", "to_package")


def named_paths(text: Column) -> Column:
    """Distinct paths between backticks of a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"`([A-Za-z0-9_@.-]+(?:/[A-Za-z0-9_@.-]+)+\.[A-Za-z0-9]+)`"), F.lit(1)))


def lost_paths(documents: DataFrame, files: DataFrame) -> DataFrame:
    """(doc, path) that a document names and no file has; documents: doc, text; files: path."""
    return documents.select("doc", F.explode(named_paths(F.col("text"))).alias("path")).join(files.select("path").distinct(), "path", "left_anti")


def directive_scope(files: Column) -> Column:
    """'global' for no or three and more directories, else the first directory."""
    dirs = F.array_sort(F.array_distinct(F.transform(files, lambda p: F.regexp_replace(p, "/[^/]*$", ""))))
    return F.when((F.size(dirs) == 0) | (F.size(dirs) >= 3), "global").otherwise(F.get(dirs, F.lit(0)))
