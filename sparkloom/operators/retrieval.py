"""Lexical, vector and hybrid retrieval.

Documents are rows with arrays of tokens. A query is a set of rows (query, term, weight). Only the tokens that some query
names are exploded beyond their row, so what is shuffled follows the matches, not the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shared import durable, ship
from .edges import real

#: Field weights and length normalisation of path, symbols and imports; saturation; floors of average lengths.
FIELDS = {"path": (2.0, 0.3, 1.0), "symbols": (1.0, 0.4, 5.0), "imports": (0.5, 0.5, 5.0)}
K1, SYNONYM, IMPORT_CEILING, TEST_PROXY = 1.2, 0.3, 0.5, 0.6
#: Spreading by importer, import and coupling; hops; decay; least coupling.
IMPORTER, IMPORT, COUPLED, HOPS, HOP_DECAY, LEAST_COUPLING = 0.4, 0.2, 0.4, 3, 0.5, 0.5
#: Symbol scoring and commit scoring.
SYM_K1, SYM_B, SYM_DELTA, NAME_SHARE, AUTHORITY_SHARE = 1.2, 0.4, 1.0, 0.5, 0.3
GIT_K1, GIT_B, RRF = 1.5, 0.75, 60
#: A short default table of synonyms; callers pass their own as rows (term, synonym).
SYNONYMS = [["auth", "authenticate", "authorize"], ["db", "database"], ["err", "error", "exception"], ["cache", "memo"], ["queue", "worker", "job"], ["config", "settings"], ["retry", "backoff"], ["timeout", "deadline"], ["parse", "parser"], ["init", "bootstrap"], ["delete", "remove"], ["session", "cookie", "credential"]]
#: Query vectors that meet a batch at once, and bytes of query vectors that are broadcast at once.
BLOCK_VECTORS, QUERY_BYTES = 4096, 64 << 20
#: Distinct terms of queries that are looked up inside the scan of the documents.
MANY_TERMS = 1000


def synonym_rows(groups: list[list[str]] = SYNONYMS) -> list[tuple[str, str]]:
    """(term, synonym) both ways."""
    return sorted({(a, b) for g in groups for a in g for b in g if a != b})


def expand(queries: DataFrame, synonyms: DataFrame, weight: float = SYNONYM) -> DataFrame:
    """(query, term, weight): the terms with weight 1 and their synonyms, unless themselves terms, with ``weight``."""
    own = queries.select("query", "term").distinct()
    extra = own.join(synonyms, "term").select("query", F.col("synonym").alias("term")).distinct().join(own, ["query", "term"], "left_anti")
    return own.withColumn("weight", F.lit(1.0)).unionByName(extra.withColumn("weight", F.lit(weight)))


def corpus_stats(docs: DataFrame, fields: dict = FIELDS) -> DataFrame:
    """One row: n documents and the average length of each field over documents that have it, with a floor (path: over all)."""
    return _stats(docs.select(*[F.size(f).alias(f"len_{f}") for f in fields]), fields)


def _stats(lengths: DataFrame, fields: dict) -> DataFrame:
    cut = {f: F.when(F.col(f"len_{f}") > 0, F.col(f"len_{f}")) if f != "path" else F.greatest(f"len_{f}", F.lit(0)) for f in fields}
    return lengths.agg(F.count("*").alias("n"), *[F.greatest(F.coalesce(F.avg(cut[f]), F.lit(0.0)), F.lit(fields[f][2])).alias(f"avg_{f}") for f in fields])


def document_frequency(docs: DataFrame, least: int = 1) -> DataFrame:
    """(term, df) over path and symbol tokens of each document."""
    terms = docs.select(F.explode(F.array_distinct(F.concat("path", "symbols"))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= least)


def _slim(docs: DataFrame, queries: DataFrame, fields: list[str]) -> DataFrame:
    """(doc, len_<field>, <field>): lengths of the fields, and of their tokens only those that some query names, written once.

    Up to MANY_TERMS terms of queries are looked up inside the scan, so that texts are cut into tokens a single time and
    only hits are written; with more of them all tokens are kept, and the join with the terms sorts them out.
    """
    known = [r.term for r in queries.select("term").distinct().limit(MANY_TERMS + 1).collect()]
    empty = F.array().cast("array<string>")
    keep = lambda f: F.filter(F.coalesce(f, empty), lambda t: t.isin(known)) if len(known) <= MANY_TERMS else F.coalesce(f, empty)
    return durable(docs.select("doc", *[F.greatest(F.size(f), F.lit(0)).alias(f"len_{f}") for f in fields], *[keep(f).alias(f) for f in fields]))


def _matches(slim: DataFrame, queries: DataFrame, fields: list[str]) -> DataFrame:
    """(doc, term, tf_<field>, len_<field>) of terms that some query names."""
    wanted = queries.select("term").distinct()
    tag = lambda field: F.transform(field, lambda t: F.struct(t.alias("term"), F.lit(field).alias("field")))
    tagged = F.flatten(F.array(*[tag(f) for f in fields]))
    long = slim.select("doc", *[f"len_{f}" for f in fields], F.explode(tagged).alias("x")).select("doc", *[f"len_{f}" for f in fields], "x.term", "x.field").join(wanted, "term", "left_semi")
    return long.groupBy("doc", "term").agg(*[F.sum((F.col("field") == f).cast("int")).alias(f"tf_{f}") for f in fields], *[F.first(f"len_{f}").alias(f"len_{f}") for f in fields])


def bm25f(docs: DataFrame, queries: DataFrame, fields: dict = FIELDS) -> DataFrame:
    """(query, doc, score, import_only): term frequencies weighted over fields, then saturated once.

    ``docs``: doc and token arrays path, symbols, imports. df counts path and symbol tokens only, a term unknown there
    has df 1. ``import_only`` tells that every matching token is an import.
    """
    slim = _slim(docs, queries, list(fields))
    hits = durable(_matches(slim, queries, list(fields)))
    df = hits.where((F.col("tf_path") > 0) | (F.col("tf_symbols") > 0)).groupBy("term").agg(F.count("*").alias("df"))
    stats = _stats(slim, fields).first()  # one row
    ptf = reduce(lambda a, b: a + b, [w * F.col(f"tf_{f}") / (1 - b + b * F.col(f"len_{f}") / stats[f"avg_{f}"]) for f, (w, b, _) in fields.items()])
    n = F.coalesce("df", F.lit(1))
    idf = F.log((stats["n"] - n + 0.5) / (n + 0.5) + 1)
    direct = (F.col("tf_path") > 0) | (F.col("tf_symbols") > 0)
    scored = hits.join(df, "term", "left").select("doc", "term", (idf * ptf * (K1 + 1) / (ptf + K1)).alias("s"), direct.alias("direct"))
    return scored.join(queries, "term").groupBy("query", "doc").agg(F.sum(F.col("s") * F.col("weight")).alias("score"), (~F.bool_or("direct")).alias("import_only"))


def import_ceiling(scores: DataFrame, share: float = IMPORT_CEILING) -> DataFrame:
    """Import-only scores scaled so that the best is at most ``share`` of the least direct one, per query."""
    low = F.min(F.when(~F.col("import_only"), F.col("score")))
    high = F.max(F.when(F.col("import_only"), F.col("score")))
    ends = scores.groupBy("query").agg(low.alias("low"), high.alias("high"))
    ceiling = share * F.col("low")
    over = F.col("import_only") & F.col("low").isNotNull() & (F.col("high") > ceiling)
    return scores.join(ends, "query").select("query", "doc", F.when(over, F.col("score") * ceiling / F.col("high")).otherwise(F.col("score")).alias("score"), "import_only")


def test_proxy(scores: DataFrame, mapping: DataFrame, share: float = TEST_PROXY) -> DataFrame:
    """A source gets at least ``share`` of the score of a test of it; mapping: test, source."""
    lent = scores.join(mapping, scores["doc"] == mapping["test"]).select("query", F.col("source").alias("doc"), (F.col("score") * share).alias("score"))
    return scores.select("query", "doc", "score").unionByName(lent).groupBy("query", "doc").agg(F.max("score").alias("score"))


def spread(scores: DataFrame, edges: DataFrame, coupled: DataFrame, hops: int = HOPS) -> DataFrame:
    """(query, node, score) after spreading along edges and couplings; each hop starts from the results of the one before.

    ``scores``: query, node, score. Importers get .4, imports .2, coupled nodes .4 · confidence of a score, halved with each
    hop after the first; the greatest wins. ``coupled``: a, b, confidence; pairs under .5 are not used.
    """
    e = real(edges).select("src", "dst").distinct()
    strong = coupled.where(F.col("confidence") >= LEAST_COUPLING)
    way = (
        e.select(F.col("dst").alias("from"), F.col("src").alias("to"), F.lit(IMPORTER).alias("w"))
        .unionByName(e.select(F.col("src").alias("from"), F.col("dst").alias("to"), F.lit(IMPORT).alias("w")))
        .unionByName(strong.select(F.col("a").alias("from"), F.col("b").alias("to"), (COUPLED * F.col("confidence")).alias("w")))
        .unionByName(strong.select(F.col("b").alias("from"), F.col("a").alias("to"), (COUPLED * F.col("confidence")).alias("w")))
    )
    ways = durable(way.groupBy("from", "to").agg(F.max("w").alias("w")))
    now = scores.select("query", "node", "score")
    for hop in range(1, hops + 1):
        sent = now.where("score > 0").join(ways, F.col("node") == F.col("from")).select("query", F.col("to").alias("node"), (F.col("score") * F.col("w") * HOP_DECAY ** (hop - 1)).alias("score"))
        now = durable(now.unionByName(sent).groupBy("query", "node").agg(F.max("score").alias("score")))
    return now


def top_k(scores: DataFrame, k: int, groups: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group."""
    return scores.withColumn(name, F.row_number().over(W.partitionBy(*groups).orderBy(*order))).where(F.col(name) <= k)


def bm25_plus(docs: DataFrame, tokens: str, queries: DataFrame, k1: float = SYM_K1, b: float = SYM_B, delta: float = SYM_DELTA, least_avg: float = 1.0) -> DataFrame:
    """(query, doc, score) of one field, every match worth at least ``delta``; delta 0 gives plain BM25."""
    wanted = queries.select("term").distinct()
    long = docs.select("doc", F.size(tokens).alias("len"), F.explode(tokens).alias("term")).join(wanted, "term", "left_semi")
    tf = durable(long.groupBy("doc", "term").agg(F.count("*").alias("tf"), F.first("len").alias("len")))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    stats = docs.agg(F.count("*").alias("n"), F.avg(F.greatest(F.size(tokens), F.lit(0))).alias("avg")).first()  # one row
    average = max(stats["avg"] or 0.0, least_avg)
    idf = F.log((stats["n"] - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    if delta:
        norm = F.col("tf") / (1 - b + b * F.col("len") / average)
        part = idf * (norm * (k1 + 1) / (norm + k1) + delta)
    else:
        part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / average))
    scored = tf.join(df, "term").select("doc", "term", part.alias("s"))
    return scored.join(queries, "term").groupBy("query", "doc").agg(F.sum(F.col("s") * F.col("weight")).alias("score"))


def rank_symbols(body: DataFrame, name: DataFrame, symbols: DataFrame, k: int = 3) -> DataFrame:
    """Top ``k`` symbols of each file: body + .5 · name + .3 · authority; body, name: query, doc, score; symbols: doc, file, authority."""
    both = body.select("query", "doc", "score").unionByName(name.select("query", "doc", (F.col("score") * NAME_SHARE).alias("score"))).groupBy("query", "doc").agg(F.sum("score").alias("score"))
    s = both.join(symbols, "doc").withColumn("score", F.col("score") + AUTHORITY_SHARE * F.coalesce("authority", F.lit(0.0)))
    return top_k(s, k, ["query", "file"], [F.round("score", 9).desc(), F.col("doc")])


def knn(queries: DataFrame, vectors: DataFrame, k: int = 10, block: int | None = None) -> DataFrame:
    """(query, id, score, rank): the k vectors of greatest inner product for each query vector.

    Query vectors are broadcast in blocks of at most QUERY_BYTES, and each block costs one scan of the vectors; inside a task
    a batch of vectors meets BLOCK_VECTORS queries at a time as a matrix product and hands on its own best k, so a query
    gathers k rows per batch. ``block`` sets the queries of a block otherwise. Vectors that are null, of another length or not
    finite are skipped.
    """
    ship(vectors.sparkSession)
    spark = vectors.sparkSession
    q_kind, id_kind = queries.schema["query"].dataType.simpleString(), vectors.schema["id"].dataType.simpleString()
    n, width = queries.agg(F.count("*"), F.max(F.size("embedding"))).first()
    parts = max(1, -(-n // (block or max(1, QUERY_BYTES // (8 * max(1, width or 1))))))
    numbered = durable(queries.select("query", "embedding").withColumn("__b", F.pmod(F.xxhash64("query"), F.lit(parts))))
    found = None
    for i in range(parts):
        rows = numbered.where(F.col("__b") == i).collect()  # about QUERY_BYTES
        if not rows:
            continue
        sent = spark.sparkContext.broadcast((np.array([r.query for r in rows]), np.array([r.embedding for r in rows], np.float64)))

        def best(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            ids, every = sent.value
            for pdf in batches:
                ok = [v is not None and len(v) == every.shape[1] and bool(np.isfinite(np.asarray(v, float)).all()) for v in pdf.embedding]
                pdf = pdf[ok]
                if pdf.empty:
                    continue
                key, stacked = pdf.id.to_numpy(), np.stack(pdf.embedding.to_numpy()).astype(np.float64).T
                place = np.argsort(np.argsort(key, kind="stable"), kind="stable")
                for at in range(0, len(ids), BLOCK_VECTORS):
                    s = every[at : at + BLOCK_VECTORS] @ stacked
                    order = np.lexsort((np.broadcast_to(place, s.shape), -s), axis=1)[:, :k]
                    yield pd.DataFrame({"query": np.repeat(ids[at : at + BLOCK_VECTORS], order.shape[1]), "id": key[order].ravel(), "score": np.take_along_axis(s, order, 1).ravel()})

        part = vectors.select("id", "embedding").mapInPandas(best, f"query {q_kind}, id {id_kind}, score double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], f"query {q_kind}, id {id_kind}, score double, rank int")
    return top_k(found, k, ["query"], [F.col("score").desc(), F.col("id")])


def best_per_owner(neighbours: DataFrame, owners: DataFrame) -> DataFrame:
    """(query, owner, score): the best score of any vector of an owner; owners: id, owner."""
    return neighbours.join(owners, "id").groupBy("query", "owner").agg(F.max("score").alias("score"))


def rrf(rankings: list[DataFrame], k: int = RRF) -> DataFrame:
    """(query, item, score, rankers): sum of 1 / (k + rank) over rankings with query, item, rank."""
    every = reduce(lambda a, b: a.unionByName(b), [r.select("query", "item", "rank") for r in rankings])
    return every.groupBy("query", "item").agg(F.sum(1 / (k + F.col("rank"))).alias("score"), F.count("*").alias("rankers"))


def retrieval_quality(ranked: DataFrame, expected: DataFrame, k: int = 5) -> DataFrame:
    """Per query: reciprocal rank of the first expected item, recall and precision at k; ranked: query, item, rank; expected: query, item."""
    hit = ranked.join(expected, ["query", "item"], "left_semi")
    first = hit.groupBy("query").agg((1 / F.min("rank")).alias("rr"), F.sum((F.col("rank") <= k).cast("int")).alias("found"))
    size = expected.groupBy("query").agg(F.count("*").alias("expected"))
    out = size.join(first, "query", "left")
    found = F.coalesce("found", F.lit(0))
    return out.select("query", F.coalesce("rr", F.lit(0.0)).alias("rr"), (found / F.col("expected")).alias("recall"), (found / k).alias("precision"))
