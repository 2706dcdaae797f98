"""Small learned models: fused ranking, its features and negatives, and latent file vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import jaccard
from ..shared import ship
from . import retrieval as R
from .graph import bounded

#: Features, defaults, learning rate, rounds, penalty, negatives, selection and vector sizes.
FEATURES = ["lexical", "proximity", "coupling", "between"]
LAMBDAS = {"lexical": 0.35, "proximity": 0.35, "coupling": 0.15, "between": 0.15}
RATE, ROUNDS, PENALTY, NEGATIVES, KEEP_OVER, KEEP_MOST, SUPPRESS, STALE_COMMITS = 0.1, 200, 0.01, 3, 0.7, 5, 0.3, 10
RANK, OVERSAMPLE, POWER, LEAST_FILES = 32, 10, 2, 50
#: Labelled rows from which a model is fitted: a bounded sample by hash, all of them up to that many.
SAMPLE = 200_000
#: Pairs of item and name of a graph that a single task takes.
MOST_PAIRS = 5_000_000


def path_similarity(a: Column, b: Column) -> Column:
    """Jaccard of the segments of two paths."""
    return jaccard(F.split(a, "/"), F.split(b, "/"))


def nearness(hops: Column, most: int = 3) -> Column:
    """1 / (hops + 1) up to ``most`` hops, else 0."""
    return F.when(hops <= most, 1 / (hops + 1)).otherwise(0.0)


def max_normalised(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Each column over its greatest value; 0 where that is not positive. Nulls count 0."""
    clean = rows.withColumns({c: F.coalesce(F.when(~F.isnan(c), F.col(c)), F.lit(0.0)) for c in columns})
    top = clean.agg(*[F.max(c).alias(c) for c in columns]).first()  # one row
    return clean.withColumns({c: F.col(c) / top[c] if (top[c] or 0) > 0 else F.lit(0.0) for c in columns})


def hard_negatives(candidates: DataFrame, k: int = NEGATIVES) -> DataFrame:
    """The first ``k`` non-positives per positive: imports (tier 1) before same community (2) before two hops (3); ties by candidate."""
    return R.top_k(candidates, k, ["positive"], [F.col("tier"), F.col("candidate")])


def fit_logistic(x: np.ndarray, y: np.ndarray, rate: float = RATE, rounds: int = ROUNDS, penalty: float = PENALTY) -> np.ndarray:
    """Weights of batch gradient descent, negatives cut to 0, scaled to sum 1; all equal without signal or with one class."""
    n, m = x.shape
    even = np.full(m, 1 / m)
    if not n or y.min() == y.max():
        return even
    w, b = np.zeros(m), 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -500, 500)))
        w = w - rate * (x.T @ (p - y) / n + penalty * w)
        b = b - rate * float(np.mean(p - y))
    w = np.maximum(w, 0)
    return w / w.sum() if w.sum() > 0 else even


def fusion_weights(examples: DataFrame, group: str, features: list[str] = FEATURES, label: str = "label", sample: int = SAMPLE) -> DataFrame:
    """(group, n_examples, one weight per feature): a model per group, fitted on at most ``sample`` labelled rows of each.

    The sample is taken by the hash of the row, so it is the same at every run; up to ``sample`` rows all are used.
    """
    ship(examples.sparkSession)
    known = examples.where(F.col(label).isNotNull()).select(group, F.col(label).cast("double").alias("__y"), *[F.coalesce(F.when(~F.isnan(f), F.col(f)), F.lit(0.0)).alias(f) for f in features])
    size = known.groupBy(group).agg(F.count("*").alias("__n"))
    part = F.pmod(F.xxhash64(*features, "__y"), F.lit(1_000_003)) < F.lit(1_000_003.0) * sample / F.col("__n")
    sampled = known.join(size, group).where((F.col("__n") <= sample) | part)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*features, "__y"])
        w = fit_logistic(pdf[features].to_numpy(float), pdf["__y"].to_numpy(float))
        return pd.DataFrame([[pdf[group].iloc[0], len(pdf), *w]], columns=[group, "n_examples", *features])

    kind = examples.schema[group].dataType.simpleString()
    return sampled.groupBy(group).applyInPandas(fit, f"{group} {kind}, n_examples bigint, " + ", ".join(f"{f} double" for f in features))


def fuse(scores: DataFrame, lambdas: dict[str, float] | None = None, commits_behind: int = 0) -> DataFrame:
    """``scores`` with fused: weighted sum of the features; structure counts half when the graph is over 10 commits behind."""
    w = lambdas or LAMBDAS
    old = 0.5 if commits_behind > STALE_COMMITS else 1.0
    parts = [F.coalesce(f, F.lit(0.0)) * w[f] * (old if f in ("proximity", "between") else 1.0) for f in FEATURES]
    return scores.withColumn("fused", parts[0] + parts[1] + parts[2] + parts[3])


def select(fused: DataFrame) -> DataFrame:
    """Per query all items above .7, at most five, else the best one; those at most .3 are marked suppressed, the rest left out."""
    r = R.top_k(fused, 1 << 30, ["query"], [F.round("fused", 9).desc(), F.col("item")])
    best = r.where("rank = 1").select("query", F.col("fused").alias("best"))
    x = r.join(best, "query")
    chosen = F.when(F.col("best") > KEEP_OVER, (F.col("fused") > KEEP_OVER) & (F.col("rank") <= KEEP_MOST)).otherwise(F.col("rank") == 1)
    state = F.when(chosen, "selected").when(F.col("fused") <= SUPPRESS, "suppressed")
    return x.withColumn("state", state).where("state IS NOT NULL").drop("best")


def latent_vectors(incidence: DataFrame, rank: int = RANK, least: int = LEAST_FILES, seed: int = 1) -> DataFrame:
    """(graph_id, item, vector) from a randomised decomposition of the items' names; graphs under ``least`` items give nothing, one of more than MOST_PAIRS pairs an error.

    ``incidence``: graph_id, item, name. Only inner products of the vectors mean anything, as signs and turns are free.
    """
    ship(incidence.sparkSession)

    def decompose(pdf: pd.DataFrame) -> pd.DataFrame:
        items, names = sorted(pdf.item.unique()), sorted(pdf.name.unique())
        empty = pd.DataFrame({"graph_id": [], "item": [], "vector": []}, dtype=object)  # floats cannot become lists
        if len(items) < least or len(names) < 2:
            return empty
        r, c = pdf.item.map({v: i for i, v in enumerate(items)}).to_numpy(), pdf["name"].map({v: i for i, v in enumerate(names)}).to_numpy()
        times = lambda x: _gather(r, c, x, len(items))
        back = lambda x: _gather(c, r, x, len(names))
        k = min(rank + OVERSAMPLE, len(items), len(names))
        q = np.linalg.qr(times(np.random.default_rng(seed).standard_normal((len(names), k))))[0]
        for _ in range(POWER):
            q = np.linalg.qr(times(np.linalg.qr(back(q))[0]))[0]
        u, s, _ = np.linalg.svd(back(q).T, full_matrices=False)
        v = (q @ u[:, :rank]) * s[:rank]
        return pd.DataFrame({"graph_id": pdf.graph_id.iloc[0], "item": items, "vector": list(v)})

    kept = bounded(incidence.select("graph_id", "item", "name").distinct(), ["graph_id"], MOST_PAIRS, "pairs of item and name")
    return kept.groupBy("graph_id").applyInPandas(decompose, "graph_id string, item string, vector array<double>")


def _gather(into: np.ndarray, of: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """Product of a binary sparse matrix, given by its pairs, with a dense one."""
    out = np.zeros((n, x.shape[1]))
    np.add.at(out, into, x[of])
    return out
