"""Change histories: activity, churn, coupling, lagged coupling, edge priors, ages.

Commits carry graph_id, hash, ts and files, a sorted array of distinct paths. Ages are counted from a given reference time
or from the latest commit of the graph, never from the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrays import pairs_of
from ..shared import durable
from .edges import real

#: Limits of coupling.
MOST_FILES, LEAST_JACCARD, LEAST_ONE_SIDED, ACTIVE, LEAST_QUIET, LEAST_ACTIVE, MAX_LAG, REPORT_TOP, HIDDEN = 30, 0.3, 0.6, 20, 2, 3, 3, 10, 0.4
#: Decay constants in days by commits a month.
FAST, MODERATE, SLOW, FAST_FROM, SLOW_BELOW = 29.0, 45.0, 87.0, 30, 5
#: The first pattern that a message matches discounts its commit.
NOISE = [
    (r"(?i)\b(lint|format|prettier|eslint|style|biome)\b", 0.1),
    (r"(?i)\b(merge|bump|release|changelog|version)\b", 0.2),
    (r"(?i)\b(chore|ci|docs|wip|build|revert)\b", 0.3),
    (r"(?i)\b(dependabot|renovate|greenkeeper)\b", 0.1),
    (r"(?i)\b(refactor|rename|move)\b", 0.5),
]
#: Priors of edges. Decay per untouched commit, strength of the structural start, its means, floor.
EWMA, STRENGTH, PRIOR_FLOOR = 0.995, 15.0, 0.01


def noise_discount(message: Column) -> Column:
    """1 for ordinary messages, less for formatting, releases, chores, bots and moves; null counts as ordinary."""
    out = F.lit(1.0)
    for pattern, discount in reversed(NOISE):
        out = F.when(message.rlike(pattern), discount).otherwise(out)
    return out


def age_days(ts: Column, reference: Column) -> Column:
    """Days from ts to the reference, not below 0."""
    return F.greatest((F.unix_micros(reference) - F.unix_micros(ts)) / 8.64e10, F.lit(0.0))


def decay_constant(commits: Column, window_days: int = 90) -> Column:
    """29 days for busy graphs, 87 for quiet ones, else 45, by commits a month."""
    monthly = commits / max(window_days / 30, 1)
    return F.when(monthly > FAST_FROM, FAST).when(monthly < SLOW_BELOW, SLOW).otherwise(MODERATE)


def dated(commits: DataFrame) -> DataFrame:
    """Commits with their age in days before the latest of their graph, and the number of commits of the graph."""
    last = commits.groupBy("graph_id").agg(F.max("ts").alias("last"), F.count("*").alias("n_commits"))
    return commits.join(last, "graph_id").withColumn("age", age_days(F.col("ts"), F.col("last"))).drop("last")


def hot_files(commits: DataFrame, top: int = 15) -> DataFrame:
    """The ``top`` files of each graph by number of commits, with when they last changed."""
    n = commits.select("graph_id", "ts", F.explode("files").alias("file")).groupBy("graph_id", "file").agg(F.count("*").alias("commits"), F.max("ts").alias("last_changed"))
    rank = F.row_number().over(W.partitionBy("graph_id").orderBy(F.col("commits").desc(), "file"))
    return n.withColumn("rank", rank).where(F.col("rank") <= top)


def churn(lines: DataFrame) -> DataFrame:
    """Added plus deleted lines per file; binary rows, whose counts are no numbers, are skipped."""
    n = lines.withColumns({"a": F.expr("try_cast(added AS bigint)"), "d": F.expr("try_cast(deleted AS bigint)")}).where("a IS NOT NULL AND d IS NOT NULL")
    return n.groupBy("file").agg(F.sum(F.col("a") + F.col("d")).alias("churn"))


def change_coupling(commits: DataFrame, window_days: int = 90, least_jaccard: float = LEAST_JACCARD, top: int | None = REPORT_TOP) -> DataFrame:
    """Files that change together: raw and weighted counts, Jaccard, one-sided shares, support, days since.

    Only commits of 2 to 30 files form pairs and sets; support and the least count look at all with two or more. A commit
    weighs 1/(files-1) · e^(-age/decay) · noise. Kept: count at least 2 (3 in active graphs) and Jaccard at least
    ``least_jaccard`` or a one-sided share at least .6. ``top`` per graph by weight, or all with None.
    """
    size = F.size("files")
    sized = dated(commits).where(size >= 2)
    wide = sized.groupBy("graph_id").agg(F.count("*").alias("wide"))
    used = sized.where(size <= MOST_FILES)
    weight = 1 / (size - 1) * F.exp(-F.col("age") / decay_constant(F.col("n_commits"), window_days)) * noise_discount(F.col("message"))
    pairs = used.select("graph_id", "age", weight.alias("w"), F.explode(pairs_of(F.col("files"))).alias("p"))
    together = pairs.groupBy("graph_id", F.col("p.a").alias("file_a"), F.col("p.b").alias("file_b")).agg(F.count("*").alias("co_changes"), F.sum("w").alias("weight"), F.min("age").alias("age"))
    together = together.join(wide, "graph_id").where(F.col("co_changes") >= F.when(F.col("wide") > ACTIVE, LEAST_ACTIVE).otherwise(LEAST_QUIET))
    single = used.select("graph_id", F.explode("files").alias("file")).groupBy("graph_id", "file").agg(F.count("*").alias("n"))
    of = lambda x: single.select("graph_id", F.col("file").alias(f"file_{x}"), F.col("n").alias(f"n_{x}"))
    c = together.join(of("a"), ["graph_id", "file_a"]).join(of("b"), ["graph_id", "file_b"])
    n = F.col("co_changes")
    c = c.withColumns({"confidence": n / (F.col("n_a") + F.col("n_b") - n), "conf_ab": n / F.col("n_a"), "conf_ba": n / F.col("n_b"), "support": n / F.col("wide"), "last_days": F.round("age").cast("int")})
    c = c.where((F.col("confidence") >= least_jaccard) | (F.col("conf_ab") >= LEAST_ONE_SIDED) | (F.col("conf_ba") >= LEAST_ONE_SIDED))
    out = c.select("graph_id", "file_a", "file_b", "co_changes", "weight", "confidence", "conf_ab", "conf_ba", "support", "last_days")
    if top is None:
        return out
    # weights are rounded for the order, so that the order of additions cannot decide it
    order = W.partitionBy("graph_id").orderBy(F.round("weight", 9).desc(), F.round("confidence", 9).desc(), "file_a", "file_b")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def lag_coupling(commits: DataFrame, coupled: DataFrame, order: list[str], max_lag: int = MAX_LAG, least_share: float = 0.5) -> DataFrame:
    """Coupled pairs that also change within ``max_lag`` commits of each other.

    Commits are numbered by ``order`` within the graph. For a commit and a lag in 1..max_lag a pair scores 1/lag once if
    file_a changed there and file_b that many commits before or after. Kept where the sum exceeds ``least_share`` of the
    pair's count in one commit.
    """
    from ..shared import positions

    numbered = durable(positions(commits.select("graph_id", "hash", "files", *[c for c in order if c not in ("graph_id", "hash", "files")]), ["graph_id"], [F.col(c) for c in order], "i").select("graph_id", "i", "files"))
    of = lambda x: coupled.select("graph_id", "file_a", "file_b", "co_changes", F.col(f"file_{x}").alias("file"))
    touched = numbered.select("graph_id", "i", F.explode("files").alias("file"))
    lags = F.explode(F.array(*[F.lit(k) for k in range(-max_lag, max_lag + 1) if k])).alias("k")
    a = touched.join(of("a"), ["graph_id", "file"]).select("graph_id", "file_a", "file_b", "co_changes", "i", lags).withColumn("j", F.col("i") + F.col("k"))
    b = touched.join(of("b"), ["graph_id", "file"]).select("graph_id", "file_a", "file_b", F.col("i").alias("j"))
    met = a.join(b, ["graph_id", "file_a", "file_b", "j"]).select("graph_id", "file_a", "file_b", "co_changes", "i", F.abs("k").alias("lag")).distinct()
    s = met.groupBy("graph_id", "file_a", "file_b", "co_changes").agg(F.sum(1 / F.col("lag")).alias("lag_score"), F.count("*").alias("events"))
    return s.where(F.col("lag_score") > least_share * F.col("co_changes"))


def edge_priors(edges: DataFrame, commits: DataFrame, order: list[str]) -> DataFrame:
    """Beta priors of edges from history: expectation that the target changes when the source does.

    ``edges``: graph_id, src, dst, start (structural mean). alpha and beta start at start·15 and (1-start)·15 and fade by
    .995 with every commit in which the source does not change; each commit that changes it adds 1 to alpha if the target
    changes too, else to beta. In closed form: a touch at commit i of N with r later touches weighs .995^(N-1-i-r).
    """
    from ..shared import positions

    numbered = positions(commits.select("graph_id", "hash", "files", *[c for c in order if c not in ("graph_id", "hash", "files")]), ["graph_id"], [F.col(c) for c in order], "i")
    total = numbered.groupBy("graph_id").agg(F.count("*").alias("n"))
    by_src = numbered.select("graph_id", "i", F.explode("files").alias("src"))
    later = F.row_number().over(W.partitionBy("graph_id", "src").orderBy(F.col("i").desc())) - 1
    touched = by_src.withColumn("r", later).join(edges.select("graph_id", "src", "dst"), ["graph_id", "src"])
    with_dst = touched.join(by_src.select("graph_id", "i", F.col("src").alias("dst"), F.lit(1).alias("hit")), ["graph_id", "i", "dst"], "left")
    w = F.pow(F.lit(EWMA), F.col("n") - 1 - F.col("i") - F.col("r"))
    hit = F.coalesce(F.col("hit"), F.lit(0))
    sums = with_dst.join(total, "graph_id").groupBy("graph_id", "src", "dst").agg(F.count("*").alias("m"), F.sum(w * hit).alias("a"), F.sum(w * (1 - hit)).alias("b"))
    start = edges.join(total, "graph_id", "left").join(sums, ["graph_id", "src", "dst"], "left")
    fade = F.pow(F.lit(EWMA), F.coalesce(F.col("n"), F.lit(0)) - F.coalesce(F.col("m"), F.lit(0)))
    alpha = F.greatest(F.col("start") * STRENGTH * fade + F.coalesce("a", F.lit(0.0)), F.lit(PRIOR_FLOOR))
    beta = F.greatest((1 - F.col("start")) * STRENGTH * fade + F.coalesce("b", F.lit(0.0)), F.lit(PRIOR_FLOOR))
    return start.select("graph_id", "src", "dst", alpha.alias("alpha"), beta.alias("beta"), (alpha / (alpha + beta)).alias("expectation"))


def hidden_coupling(coupled: DataFrame, edges: DataFrame, least: float = HIDDEN) -> DataFrame:
    """Coupled pairs of at least ``least`` confidence that no path of one or two edges, either way, explains; all of them.

    ``coupled``: all pairs, before any cut to a report (``change_coupling`` with ``top=None``). A path of three edges or
    more, or none, leaves a pair hidden. Both hops start from the pairs, so no closure of the graph is built.
    """
    strong = coupled.where(F.col("confidence") >= least)
    e = real(edges).select("graph_id", F.col("src").alias("x"), F.col("dst").alias("y"))
    both = e.unionByName(e.select("graph_id", F.col("y").alias("x"), F.col("x").alias("y"))).distinct()
    pairs = strong.select("graph_id", "file_a", "file_b").distinct()
    one = pairs.join(both.toDF("graph_id", "file_a", "file_b"), ["graph_id", "file_a", "file_b"], "left_semi")
    two = pairs.join(both.toDF("graph_id", "file_a", "mid"), ["graph_id", "file_a"]).join(both.toDF("graph_id", "mid", "file_b"), ["graph_id", "mid", "file_b"], "left_semi")
    explained = one.unionByName(two.select("graph_id", "file_a", "file_b")).distinct()
    return strong.join(explained, ["graph_id", "file_a", "file_b"], "left_anti")


def alive(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """Pairs of files that both still exist."""
    f = files.select("graph_id", "path").distinct()
    return pairs.join(f.withColumnRenamed("path", "file_a"), ["graph_id", "file_a"], "left_semi").join(f.withColumnRenamed("path", "file_b"), ["graph_id", "file_b"], "left_semi")


def recency(symbols: DataFrame, blame: DataFrame, default_days: float = 365.0) -> DataFrame:
    """Least age of the lines of each symbol; symbols: id, file, start_line, end_line; blame: file, line, days."""
    inside = (F.col("line") >= F.col("start_line")) & (F.col("line") <= F.col("end_line"))
    hit = symbols.join(blame, "file").where(inside).groupBy("id").agg(F.min("days").alias("days"))
    return symbols.select("id").join(hit, "id", "left").select("id", F.coalesce("days", F.lit(default_days)).alias("days"))
