"""Choosing within a budget: greedy cover, knapsack and sections.

Greedy cover takes one group in one task, of up to MOST_CANDIDATES rows; that is counted before. Knapsack and sections take groups of any size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import durable, ship
from .graph import bounded

#: Token budget, decay and hops of coverage, least gain, snapshot factors, characters a token.
TOKENS, DECAY, HOPS, LEAST_GAIN, TYPE_FACTOR, COUNT_FACTOR, SECOND_OF_FILE = 1500, 0.8, 2, 0.05, 1.3, 0.15, 0.5
DENSE_SYMBOLS, CHARS_DENSE, CHARS_PLAIN, LEAST_COST = 0.08, 3.2, 3.5, 10
#: Candidates of a group that a single task takes.
MOST_CANDIDATES = 200_000


def token_estimate(text: Column) -> Column:
    """Characters over 3.2 where more than 8 % are symbols, else over 3.5, rounded up; 0 for null."""
    n = F.length(text)
    symbols = n - F.length(F.regexp_replace(text, r"[{}()\[\];:=<>|&!@#$%^*+\-/\\~`]", ""))
    return F.coalesce(F.ceil(n / F.when(symbols > DENSE_SYMBOLS * n, CHARS_DENSE).otherwise(CHARS_PLAIN)), F.lit(0))


def _passing(batches: Iterator[pa.RecordBatch], budget: int, whole: bool) -> Iterator[pa.RecordBatch]:
    """The rows of each group, in order, that fit what is left. Of a part of a group, those that may fit whatever stands between them.

    For a part there is only an upper bound of what is left. A row of n tokens leaves bound - n where it is taken, and is not taken only
    where less than n is left, so max(bound - n, n - 1) is the next bound. It falls with each row that passes: of a group no more rows
    pass than the budget has tokens.
    """
    begun, group, left = False, None, budget
    for batch in batches:
        passes = []
        for g, n, spent in zip(*[batch.column(c).to_pylist() for c in ("group", "tokens", "__spent")], strict=True):
            if not begun or g != group:
                begun, group, left = True, g, budget
            fits = spent or n <= left
            if fits:
                left = left - n if whole else max(left - n, n - 1)
            passes.append(fits)
        yield batch.filter(pa.array(passes, pa.bool_()))


def fitting(rows: DataFrame, order: list[Column], budget: int, spent: DataFrame | None = None) -> DataFrame:
    """(__id) of the rows with tokens that fit when the rows of each group are taken in a total ``order`` while there is room.

    ``rows``: group, __id, tokens and the columns of the order; ``spent``: (group, tokens) taken from the budget before them.
    Each partition leaves out rows that cannot fit whatever the others hold, and only the rest, per group and partition no more rows than
    the budget has tokens, meets in a task, which reads it as a sorted stream. So a group may have any size.
    """
    ship(rows.sparkSession)
    x = rows.where(F.col("tokens").between(1, budget)).withColumn("tokens", F.col("tokens").cast("bigint")).withColumn("__spent", F.lit(False))
    part = x.sortWithinPartitions("group", *order).mapInArrow(partial(_passing, budget=budget, whole=False), x.schema)
    if spent is not None:
        part = part.unionByName(spent.select("group", F.col("tokens").cast("bigint").alias("tokens"), F.lit(True).alias("__spent")), allowMissingColumns=True)
    one = part.repartition("group").sortWithinPartitions("group", F.col("__spent").desc(), *order)
    return one.mapInArrow(partial(_passing, budget=budget, whole=True), part.schema).where("NOT __spent").select("__id")


def greedy_cover(near: DataFrame, costs: DataFrame, budget: int = TOKENS) -> DataFrame:
    """(group, place, item, cost, gain): items by gain over cost until the budget is full or a ratio falls under 5 % of the first.

    ``near``: group, item, covered, hops (0..2, the item itself at 0); an item covers what is near with .8^hops, and the gain
    counts only what is better than before. ``costs``: group, item, cost.
    """
    ship(near.sparkSession)
    x = near.where(F.col("hops") <= HOPS).join(costs, ["group", "item"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        reach = {i: [(c, DECAY**h) for c, h in zip(g.covered, g.hops, strict=True)] for i, g in pdf.groupby("item", sort=True)}
        cost = pdf.groupby("item").cost.first().to_dict()
        have: dict = {}
        out, spent, first = [], 0, None
        gain_of = lambda i: sum(max(0.0, w - have.get(c, 0.0)) for c, w in reach[i])
        while reach:
            best = max(((gain_of(i) / cost[i], i) for i in reach if spent + cost[i] <= budget), key=lambda t: (t[0], [-ord(ch) for ch in str(t[1])]), default=None)
            if best is None or best[0] <= 0 or (first is not None and best[0] < LEAST_GAIN * first):
                break
            ratio, i = best
            first = first or ratio
            out.append((len(out), i, int(cost[i]), ratio * cost[i]))
            spent += cost[i]
            for c, w in reach.pop(i):
                have[c] = max(have.get(c, 0.0), w)
        done = pd.DataFrame(out, columns=["place", "item", "cost", "gain"])
        done.insert(0, "group", pdf["group"].iloc[0])
        return done

    return bounded(x, ["group"], MOST_CANDIDATES, "candidates").groupBy("group").applyInPandas(run, "`group` string, place int, item string, cost int, gain double")


def knapsack(items: DataFrame, budget: int) -> DataFrame:
    """Items by value over tokens while they fit, later ones of a file at half value; the rest is deferred.

    ``items``: group, item, file, centrality, is_type, uses, tokens. value = centrality · 1.3 for types · (1 + .15 log2(uses + 1)).
    """
    value = F.col("centrality") * F.when(F.col("is_type"), TYPE_FACTOR).otherwise(1.0) * (1 + COUNT_FACTOR * F.log2(F.col("uses") + 1))
    columns = [F.col(c).cast(k).alias(c) for c, k in (("group", "string"), ("item", "string"), ("file", "string"), ("tokens", "int"))]
    ratio = F.nanvl(value / F.col("tokens"), F.lit(None))
    known = durable(items.where("tokens > 0").select(*columns, ratio.alias("ratio"), F.monotonically_increasing_id().alias("__id")))
    # the first of each file by an aggregate, and its mark by row, so that neither meets a file of many items in one task
    order = F.struct(F.col("ratio").isNull(), -F.col("ratio"), F.col("item").isNull(), "item", "__id")
    first = known.groupBy("group", "file").agg(F.min_by("__id", order).alias("__id")).select("__id", F.lit(1.0).alias("factor"))
    rated = known.drop("file").join(first, "__id", "left").withColumn("ratio", F.col("ratio") * F.coalesce("factor", F.lit(SECOND_OF_FILE))).drop("factor")
    fits = durable(fitting(rated, [F.col("ratio").desc_nulls_last(), F.col("item").asc_nulls_last(), F.col("__id")], budget).withColumn("state", F.lit("kept")))
    return known.join(fits, "__id", "left").select("group", "item", "file", "tokens", F.coalesce("state", F.lit("deferred")).alias("state"))


def sections(rows: DataFrame, budget: int) -> DataFrame:
    """Sections of priority 0 to 2 always, others in order of priority while they fit; rows: group, section, priority, tokens (0 or more).

    Those without known tokens take no room where they are always kept, and are left out elsewhere.
    """
    columns = [F.col(c).cast(k).alias(c) for c, k in (("group", "string"), ("section", "string"), ("priority", "int"), ("tokens", "int"))]
    known = durable(rows.select(*columns, F.monotonically_increasing_id().alias("__id")))
    must = F.coalesce(F.col("priority") <= 2, F.lit(False))
    always = known.where(must).groupBy("group").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    others = known.where(~must)
    fits = fitting(others, [F.col("priority").asc_nulls_last(), F.col("section").asc_nulls_last(), F.col("__id")], budget, always)
    # a section without tokens takes no room, but is left out where those of priority 0 to 2 take more than there is
    full = always.where(F.col("tokens") > budget).select(F.col("group").alias("__full"))
    lost = others.where("tokens = 0").join(full, F.col("group").eqNullSafe(F.col("__full")), "left_semi")
    marks = durable(fits.select("__id", F.lit(True).alias("kept")).unionByName(lost.select("__id", F.lit(False).alias("kept"))))
    kept = F.coalesce("kept", must | (F.lit(budget >= 0) & (F.col("tokens") == 0)), F.lit(False))
    return known.join(marks, "__id", "left").select("group", "section", "priority", "tokens", kept.alias("kept"))
