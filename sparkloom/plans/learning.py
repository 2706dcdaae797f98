"""Queries on learned models and selection within a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import edges as E
from ..operators import learning as M
from ..operators import selection as C
from ..operators import traversal as T
from ..shared import latest_by
from ..shared import table as t
from .inputs import TRADE, trade_graph
from .registry import query

_EX = "ex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY example_id) rn FROM training_examples WHERE example_id IS NOT NULL) WHERE rn = 1)"
_OK = lambda i: f"coalesce(CASE WHEN features[{i}] >= 0 AND NOT isnan(features[{i}]) AND features[{i}] < 'inf'::DOUBLE THEN features[{i}] END, 0)"


def _examples(spark: SparkSession, d: str) -> DataFrame:
    e = latest_by(t(spark, d, "training_examples").where("example_id IS NOT NULL").select("example_id", "query_id", "graph_id", "features", "label"), ["example_id"], [])
    x = [F.get("features", F.lit(i)) for i in range(4)]
    return e.select("example_id", "query_id", "graph_id", "label", *[F.coalesce(F.when((v >= 0) & ~F.isnan(v) & (v < float("inf")), v), F.lit(0.0)).alias(n) for v, n in zip(x, M.FEATURES, strict=True)])


def _per_query(spark: SparkSession, d: str) -> DataFrame:
    """Features over the greatest of their query."""
    from ..shared import join_stats

    e = _examples(spark, d)
    top = e.groupBy("query_id").agg(F.count("*").alias("n"), *[F.max(c).alias(f"top_{c}") for c in M.FEATURES])
    x = join_stats(e, top, ["query_id"], "n", ["example_id"])
    return x.select("example_id", "query_id", "graph_id", "label", *[F.when(F.col(f"top_{c}") > 0, F.col(c) / F.col(f"top_{c}")).otherwise(0.0).alias(c) for c in M.FEATURES])


_NORM = f"{_EX}, f AS (SELECT example_id, query_id, graph_id, label, {_OK(1)} lexical, {_OK(2)} proximity, {_OK(3)} coupling, {_OK(4)} \"between\" FROM ex), n AS (SELECT example_id, query_id, graph_id, label, " + ", ".join(f'CASE WHEN max("{c}") OVER w > 0 THEN "{c}" / max("{c}") OVER w ELSE 0 END "{c}"' for c in M.FEATURES) + " FROM f WINDOW w AS (PARTITION BY query_id))"
_FUSED = f'{_NORM}, fu AS (SELECT query_id, example_id, lexical * 0.35 + proximity * 0.35 + coupling * 0.15 + "between" * 0.15 fused FROM n WHERE query_id IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fused, 9) DESC, example_id) rank FROM fu), b AS (SELECT *, max(CASE WHEN rank = 1 THEN fused END) OVER (PARTITION BY query_id) best FROM r)'


@query(f'WITH {_NORM} SELECT example_id, round(lexical, 6) lexical, round(proximity, 6) proximity, round(coupling, 6) coupling, round("between", 6) "between" FROM n WHERE query_id IS NOT NULL')
def fusion_features(spark: SparkSession, d: str) -> DataFrame:
    """Normalised features of every example."""
    x = _per_query(spark, d)
    return x.select("example_id", *[F.round(c, 6).alias(c) for c in M.FEATURES])


@query()
def fusion_weights(spark: SparkSession, d: str) -> DataFrame:
    """Weights fitted for each repository."""
    w = M.fusion_weights(_per_query(spark, d).where("graph_id IS NOT NULL"), "graph_id")
    return w.select("graph_id", "n_examples", *[F.round(c, 6).alias(c) for c in M.FEATURES])


@query(f"WITH {_FUSED} SELECT query_id AS \"query\", example_id item, round(fused, 6) fused, rank, CASE WHEN CASE WHEN best > 0.7 THEN fused > 0.7 AND rank <= 5 ELSE rank = 1 END THEN 'selected' ELSE 'suppressed' END state FROM b WHERE fused <= 0.3 OR CASE WHEN best > 0.7 THEN fused > 0.7 AND rank <= 5 ELSE rank = 1 END")
def fused_rank(spark: SparkSession, d: str) -> DataFrame:
    """Selected and suppressed candidates of each query by fused score."""
    x = M.fuse(_per_query(spark, d).select(F.col("query_id").alias("query"), F.col("example_id").alias("item"), *M.FEATURES))
    return M.select(x).select("query", "item", F.round("fused", 6).alias("fused"), "rank", "state")


@query(f"WITH {_EX}, c AS (SELECT query_id positive, example_id candidate, 1 + (example_id % 3)::INT tier FROM ex WHERE coalesce(label, 0) = 0 AND query_id IS NOT NULL) SELECT positive, candidate, tier, rank FROM (SELECT *, row_number() OVER (PARTITION BY positive ORDER BY tier, candidate) rank FROM c) WHERE rank <= 3")
def hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    """Three negatives of each query, tiers by id."""
    c = _examples(spark, d).where("coalesce(label, 0) = 0 AND query_id IS NOT NULL").select(F.col("query_id").alias("positive"), F.col("example_id").alias("candidate"), (1 + F.col("example_id") % 3).cast("int").alias("tier"))
    return M.hard_negatives(c)


@query()
def lsa_cosine(spark: SparkSession, d: str) -> DataFrame:
    """Files of each repository that import most like its first file."""
    s = latest_by(t(spark, d, "symbols").where("id IS NOT NULL").select("id", "graph_id", "file_path", "import_names", "indexed_at"), ["id"], ["indexed_at"])
    pairs = s.select("graph_id", F.col("file_path").alias("item"), F.explode("import_names").alias("name")).where("name <> '' AND item IS NOT NULL")
    v = M.latent_vectors(pairs)
    from ..functions.arrays import cosine

    first = v.groupBy("graph_id").agg(F.min_by("vector", "item").alias("v0"))
    return v.join(first, "graph_id").select("graph_id", "item", F.round(cosine(F.col("vector"), F.col("v0")), 4).alias("cosine")).where("cosine >= 0.3")


@query("SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE ceil(length(text) / CASE WHEN length(text) - length(regexp_replace(text, '[{}()\\[\\];:=<>|&!@#$%^*+\\-/\\\\~`]', '', 'g')) > 0.08 * length(text) THEN 3.2::DOUBLE ELSE 3.5::DOUBLE END)::BIGINT END tokens FROM documents")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    """Estimated tokens of every document."""
    return t(spark, d, "documents").select("doc_id", C.token_estimate(F.col("text")).cast("bigint").alias("tokens"))


@query()
def budget_select(spark: SparkSession, d: str) -> DataFrame:
    """Nations that cover most of the trade graph within a budget."""
    e = trade_graph(spark, d)
    near = T.closure(e, depth=2, keep_all=False).where("start <> node").select(F.col("graph_id").alias("group"), F.col("start").alias("item"), F.col("node").alias("covered"), F.col("depth").alias("hops"))
    own = e.select(F.explode(F.array("src", "dst")).alias("item")).distinct()
    near = near.unionByName(own.select(F.lit("trade").alias("group"), "item", F.col("item").alias("covered"), F.lit(0).alias("hops")))
    cost = E.degrees(e).select(F.col("graph_id").alias("group"), F.col("node").alias("item"), F.greatest(F.lit(C.LEAST_COST), 20 * (F.col("in_degree") + F.col("out_degree"))).cast("int").alias("cost"))
    return C.greedy_cover(near, cost).withColumn("gain", F.round("gain", 6))


_GREEDY = """r(g, rn, room, kept) AS (SELECT g, rn, {budget} - CASE WHEN must OR tokens <= {budget} THEN tokens ELSE 0 END, must OR tokens <= {budget} FROM o WHERE rn = 1
  UNION ALL SELECT o.g, o.rn, room - CASE WHEN must OR o.tokens <= room THEN o.tokens ELSE 0 END, must OR o.tokens <= room FROM r JOIN o ON o.g = r.g AND o.rn = r.rn + 1)"""


@query(f"""WITH RECURSIVE s AS (SELECT graph_id g, id::VARCHAR item, coalesce(file_path, '') f, (CASE WHEN authority IS NULL OR isnan(authority) THEN 0 ELSE authority END * CASE WHEN kind IN ('type', 'interface') THEN 1.3::DOUBLE ELSE 1 END * (1 + 0.15::DOUBLE)) / (10 + length(coalesce(name, ''))) ratio, 10 + length(coalesce(name, '')) tokens
    FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC NULLS LAST) rn FROM symbols WHERE id IS NOT NULL AND graph_id IS NOT NULL) WHERE rn = 1),
  a AS (SELECT *, row_number() OVER (PARTITION BY g, f ORDER BY ratio DESC, item) again FROM s), o AS (SELECT g, item, f, tokens, false must, row_number() OVER (PARTITION BY g ORDER BY ratio * CASE WHEN again > 1 THEN 0.5::DOUBLE ELSE 1 END DESC, item) rn FROM a),
  {_GREEDY.format(budget=4000)} SELECT g AS "group", item, f AS file, tokens::INT AS tokens, CASE WHEN kept THEN 'kept' ELSE 'deferred' END state FROM r JOIN o USING (g, rn)""")
def snapshot_knapsack(spark: SparkSession, d: str) -> DataFrame:
    """Symbols of each repository kept within 4000 tokens."""
    s = latest_by(t(spark, d, "symbols").where("id IS NOT NULL AND graph_id IS NOT NULL").select("id", "graph_id", "file_path", "name", "kind", "authority", "indexed_at"), ["id"], ["indexed_at"])
    return C.knapsack(s.select(F.col("graph_id").alias("group"), F.col("id").cast("string").alias("item"), F.coalesce("file_path", F.lit("")).alias("file"), F.coalesce(F.when(~F.isnan("authority"), F.col("authority")), F.lit(0.0)).alias("centrality"), F.col("kind").isin("type", "interface").alias("is_type"), F.lit(1).alias("uses"), (F.lit(C.LEAST_COST) + F.length(F.coalesce("name", F.lit("")))).alias("tokens")), 4000)


_TOKENS = "CASE WHEN text IS NULL THEN 0 ELSE ceil(length(text) / CASE WHEN length(text) - length(regexp_replace(text, '[{}()\\[\\];:=<>|&!@#$%^*+\\-/\\\\~`]', '', 'g')) > 0.08 * length(text) THEN 3.2::DOUBLE ELSE 3.5::DOUBLE END)::INT END"


@query(f"""WITH RECURSIVE s AS (SELECT lang g, format('{{:09d}}', doc_id) section, (3 + doc_id % 5)::INT priority, {_TOKENS} tokens FROM documents WHERE lang IS NOT NULL), o AS (SELECT *, priority <= 2 must, row_number() OVER (PARTITION BY g ORDER BY priority, section) rn FROM s),
  {_GREEDY.format(budget=2000)} SELECT g AS "group", section, priority, tokens::INT AS tokens, kept FROM r JOIN o USING (g, rn)""")
def section_budget(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each language as sections within 2000 tokens."""
    x = t(spark, d, "documents").where("lang IS NOT NULL").select(F.col("lang").alias("group"), F.format_string("%09d", "doc_id").alias("section"), (3 + F.col("doc_id") % 5).cast("int").alias("priority"), C.token_estimate(F.col("text")).cast("int").alias("tokens"))
    return C.sections(x, 2000)


@query(f"WITH {TRADE} SELECT src, dst, round((SELECT count(*) FROM edges b WHERE b.src = edges.dst AND b.dst IN (SELECT dst FROM edges c WHERE c.src = edges.src))::DOUBLE / (SELECT count(DISTINCT dst) FROM edges b WHERE b.src IN (edges.src, edges.dst)), 6) jaccard FROM edges WHERE EXISTS (SELECT 1 FROM edges b WHERE b.src = edges.dst)")
def neighbour_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Similarity of the customers of the two ends of each edge."""
    from ..functions.arrays import jaccard

    e = trade_graph(spark, d)
    n = e.groupBy("src").agg(F.collect_set("dst").alias("out"))
    x = e.join(n, "src").join(n.select(F.col("src").alias("dst"), F.col("out").alias("other")), "dst")
    return x.select("src", "dst", F.round(jaccard(F.col("out"), F.col("other")), 6).alias("jaccard"))
