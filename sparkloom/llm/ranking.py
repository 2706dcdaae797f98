"""One ranking from several differently-scaled scores: ideal-point ranking inside each query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import durable, join_stats, latest_by, positions

#: Winsorising quantiles of a score within its query, and the accuracy of the quantile sketch (exact up to that many rows).
TAIL, ACCURACY = 0.10, 10_000
FEATURES = ["lexical", "proximity", "coupling", "between_trained"]
SCORES = [*FEATURES, "authority", "betweenness"]
#: Weight of a score for which no usable weight is known.
PLAIN_WEIGHT = 0.25


def usable(score: Column) -> Column:
    """The score, or null where it is null, NaN, infinite or negative."""
    return F.when((score >= 0) & ~F.isnan(score) & (score < float("inf")), score)


def ideal_point(rows: DataFrame, group: str, item: str, scores: list[str], weights: dict[str, str] | None = None) -> DataFrame:
    """``rows`` with closeness (0..1): how near each item is to the ideal point of its group.

    Scores must be clean: null means missing, anything else is finite and not negative. Within a group each score is
    winsorised at its TAIL quantiles, a missing one counts as 0, the column is divided by its Euclidean norm and weighted;
    closeness = d⁻ / (d⁺ + d⁻) from the distances to the best and the worst value of every column, to 9 digits; 0.5 where
    all items of the group are alike. Items must be unique; groups are never gathered: both passes over them are
    aggregates that are joined back with hot groups salted. Rows with a null group or item are dropped.
    """
    base = durable(rows.where(F.col(group).isNotNull() & F.col(item).isNotNull()))
    first = base.groupBy(group).agg(F.count("*").alias("n_items"), *[F.percentile_approx(s, [TAIL, 1 - TAIL], ACCURACY).alias(f"q_{s}") for s in scores])
    with_bounds = join_stats(base, first, [group], "n_items", [item])
    clip = {s: F.coalesce(F.least(F.greatest(F.col(s), F.col(f"q_{s}")[0]), F.col(f"q_{s}")[1]), F.lit(0.0)) for s in scores}
    clipped = durable(with_bounds.select(*rows.columns, *[clip[s].alias(f"x_{s}") for s in scores]))
    second = clipped.groupBy(group).agg(
        F.count("*").alias("n_items"),
        *[F.sqrt(F.sum(F.col(f"x_{s}") * F.col(f"x_{s}"))).alias(f"norm_{s}") for s in scores],
        *[F.max(f"x_{s}").alias(f"best_{s}") for s in scores],
        *[F.min(f"x_{s}").alias(f"worst_{s}") for s in scores],
    )
    full = join_stats(clipped, second, [group], "n_items", [item])
    weight = {s: F.col(weights[s]) if weights else F.lit(1.0) for s in scores}

    def distance(end: str) -> Column:
        parts = [F.when(F.col(f"norm_{s}") > 0, F.pow(weight[s] * (F.col(f"{end}_{s}") - F.col(f"x_{s}")) / F.col(f"norm_{s}"), 2)).otherwise(0.0) for s in scores]
        return F.sqrt(sum(parts[1:], parts[0]))

    far = full.withColumn("d_best", distance("best")).withColumn("d_worst", distance("worst"))
    spread = F.col("d_best") + F.col("d_worst")
    closeness = F.when(spread > 0, F.round(F.col("d_worst") / spread, 9)).otherwise(0.5)
    return far.select(*rows.columns, closeness.alias("closeness"))


def _won(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """In how many scores a is strictly ahead of b; a missing score is behind every other."""
    return sum(((F.coalesce(a[s], F.lit(-1.0)) > F.coalesce(b[s], F.lit(-1.0))).cast("int") for s in a), F.lit(0))


def _against_nearest(rows: DataFrame, group: str, item: str, scores: list[str]) -> tuple[DataFrame, DataFrame]:
    """The nearest item to the ideal of each group, and every other row with how often it is ``ahead`` of it and ``behind`` it."""
    each = F.struct(F.col(item).alias("item"), *[F.col(s) for s in scores])
    nearest = durable(rows.groupBy(group).agg(F.count("*").alias("n_items"), F.max_by(each, F.struct("closeness", -F.col(item))).alias("top")))
    met = join_stats(rows, nearest, [group], "n_items", [item]).where(F.col(item) != F.col("top.item"))
    own, top = {s: F.col(s) for s in scores}, {s: F.col(f"top.{s}") for s in scores}
    return nearest.select(group, F.col("top.item").alias(item), "top"), met.select(*rows.columns, _won(own, top).alias("ahead"), _won(top, own).alias("behind"))


def majority_first(near: DataFrame, group: str, item: str, scores: list[str]) -> DataFrame:
    """(group, item, tries) of the item that is ahead of each other item of its group on more than half of the scores.

    ``near`` comes from ideal_point; items are tried in order of their closeness, ties by the lesser item, and ``tries`` says
    how many were tried until the right one. The nearest item is met with every row of its group. If it is ahead of all of
    them it is the one. Otherwise only a row that is itself ahead of it can be the one, so the next try is the nearest
    of these few, and so on while any is left; the last one of a group is then met with every row of the group. Groups are
    never paired with themselves: each try is one join of one row per group, with hot groups salted. A group of one item has
    that item; a group without such an item has none.
    """
    near = durable(near.select(group, item, "closeness", *scores))
    half = len(scores) // 2
    nearest, met = _against_nearest(near, group, item, scores)
    doubts = durable(met.where(F.col("behind") <= half))
    found = nearest.join(doubts.select(group).distinct(), group, "left_anti").select(group, item, F.lit(1).alias("tries"))
    rest, last, tries = doubts.where(F.col("ahead") > half).select(*near.columns), None, 1
    while not rest.isEmpty():
        tries += 1
        nearest, met = _against_nearest(rest, group, item, scores)
        rest = durable(met.where(F.col("ahead") > half).select(*near.columns))
        ended = nearest.join(rest.select(group).distinct(), group, "left_anti").withColumn("tries", F.lit(tries))
        last = ended if last is None else last.unionByName(ended)
    if last is None:
        return found
    last = durable(last)
    sizes = near.join(last.select(group), group, "left_semi").groupBy(group).agg(F.count("*").alias("n_items"))
    met = join_stats(near, last.withColumnRenamed(item, "__tried").join(sizes, group), [group], "n_items", [item])
    behind = _won({s: F.col(f"top.{s}") for s in scores}, {s: F.col(s) for s in scores})
    lost = met.where((F.col(item) != F.col("top.item")) & (behind <= half)).select(group).distinct()
    return found.unionByName(last.join(lost, group, "left_anti").select(group, item, "tries"))


def candidate_scores(examples: DataFrame, files: DataFrame) -> DataFrame:
    """(example_id, query_id, graph_id, six scores) with each example_id once; unusable scores are null.

    Features beyond the end of the array are missing; authority and betweenness are those of the candidate's latest row
    in ``files``, missing for unknown and null candidates. A candidate with very many examples is salted.
    """
    once = latest_by(examples.select("example_id", "query_id", "graph_id", F.coalesce("candidate", F.lit("")).alias("candidate"), "features"), ["example_id"], [])
    known = latest_by(files.where(F.col("path").isNotNull()).select(F.col("path").alias("candidate"), "authority", "betweenness", "updated_at"), ["candidate"], ["updated_at"])
    known = known.select("candidate", *[usable(F.col(c)).alias(c) for c in ("authority", "betweenness")])
    counted = once.groupBy("candidate").agg(F.count("*").alias("n")).join(known, "candidate", "left")
    joined = join_stats(once, counted, ["candidate"], "n", ["example_id"])
    feature = [usable(F.get("features", F.lit(i))).alias(s) for i, s in enumerate(FEATURES)]
    return joined.select("example_id", "query_id", "graph_id", *feature, "authority", "betweenness")


def score_weights(weights: DataFrame) -> DataFrame:
    """(graph_id, w_<score> for each score), summing to 1: the latest weights of each repository.

    A weight above 1 is read as percent; one that is null, NaN, negative or zero gets PLAIN_WEIGHT, as authority and betweenness do.
    """
    last = latest_by(weights.where(F.col("graph_id").isNotNull()).select("graph_id", "lambda_l", "lambda_g", "lambda_t", "lambda_b", "trained_at"), ["graph_id"], ["trained_at"])
    part = lambda c: F.when(F.isnan(c) | ~(F.col(c) > 0) | F.col(c).isNull(), PLAIN_WEIGHT).when(F.col(c) > 1, F.col(c) / 100).otherwise(F.col(c))
    parts = [part("lambda_l"), part("lambda_g"), part("lambda_t"), part("lambda_b"), F.lit(PLAIN_WEIGHT), F.lit(PLAIN_WEIGHT)]
    total = sum(parts[1:], parts[0])
    return last.select("graph_id", *[(p / total).alias(f"w_{s}") for p, s in zip(parts, SCORES, strict=True)])


def weighted_candidates(scored: DataFrame, weights: DataFrame) -> DataFrame:
    """The candidates with the weights of their repository; equal weights where it has none."""
    counts = scored.groupBy(F.coalesce("graph_id", F.lit("")).alias("graph_id")).agg(F.count("*").alias("n"))
    known = counts.join(score_weights(weights), "graph_id", "left").select("graph_id", "n", *[F.coalesce(f"w_{s}", F.lit(1 / len(SCORES))).alias(f"w_{s}") for s in SCORES])
    return join_stats(scored.withColumn("graph_id", F.coalesce("graph_id", F.lit(""))), known, ["graph_id"], "n", ["example_id"])


def ranked_candidates(examples: DataFrame, files: DataFrame, weights: DataFrame) -> DataFrame:
    """(query_id, place, example_id, closeness): all examples by closeness, place 0 first, ties by example_id."""
    rows = weighted_candidates(candidate_scores(examples, files), weights)
    near = ideal_point(rows, "query_id", "example_id", SCORES, {s: f"w_{s}" for s in SCORES}).select("query_id", "example_id", "closeness")
    return positions(near, ["query_id"], [F.col("closeness").desc(), F.col("example_id").asc()], "place").select("query_id", "place", "example_id", "closeness")


def clear_winners(examples: DataFrame, files: DataFrame) -> DataFrame:
    """(query_id, example_id, tries) of each query's example that is ahead of each other one on more than half of the scores.

    Examples are tried in the order of the unweighted ideal-point ranking; see majority_first.
    """
    near = ideal_point(candidate_scores(examples, files), "query_id", "example_id", SCORES)
    return majority_first(near, "query_id", "example_id", SCORES)
