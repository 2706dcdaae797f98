"""Queries over documents, symbols, commit messages and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.words import identifier_terms, words
from ..operators import edges as E
from ..operators import retrieval as R
from ..shared import latest_by
from ..shared import table as t
from .inputs import TRADE, trade_graph
from .registry import query

ASKED = {"q1": ["cache", "retry", "timeout"], "q2": ["parser", "schema", "config"], "q3": ["session", "token", "layer"]}
_Q = "q(query, term) AS (VALUES " + ", ".join(f"('{k}', '{w}')" for k, ws in ASKED.items() for w in ws) + ")"
_SYN = "syn(term, synonym) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in R.synonym_rows()) + ")"
_EXP = f"{_Q}, {_SYN}, qe AS (SELECT query, term, 1::DOUBLE weight FROM q UNION ALL SELECT DISTINCT query, synonym, 0.3 FROM q JOIN syn USING (term) WHERE NOT EXISTS (SELECT 1 FROM q o WHERE o.query = q.query AND o.term = synonym))"
_words = lambda c, n=3: f"list_filter(string_split_regex(lower(coalesce({c}, '')), '[^a-z0-9]+'), lambda w: length(w) >= {n})"
_DOCS = f"d AS (SELECT doc_id doc, {_words('file_path')} path, {_words('text')} symbols, {_words('source')} imports FROM documents)"


def asked(spark: SparkSession) -> DataFrame:
    """The fixed queries as rows."""
    return spark.createDataFrame([(k, w) for k, ws in ASKED.items() for w in ws], "query string, term string")


def expanded(spark: SparkSession) -> DataFrame:
    """The same with synonyms."""
    return R.expand(asked(spark), spark.createDataFrame(R.synonym_rows(), "term string, synonym string"))


def documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents with three fields: path, text and source."""
    return t(spark, d, "documents").select(F.col("doc_id").alias("doc"), words(F.col("file_path")).alias("path"), words(F.col("text")).alias("symbols"), words(F.col("source")).alias("imports"))


_BM25F = f"""{_EXP}, {_DOCS}, st AS (SELECT count(*) n, greatest(avg(len(path)), 1) ap, greatest(avg(CASE WHEN len(symbols) > 0 THEN len(symbols) END), 5) asy, greatest(avg(CASE WHEN len(imports) > 0 THEN len(imports) END), 5) ai FROM d),
 long AS (SELECT doc, unnest(path) term, 1 p, 0 s, 0 i FROM d UNION ALL SELECT doc, unnest(symbols), 0, 1, 0 FROM d UNION ALL SELECT doc, unnest(imports), 0, 0, 1 FROM d),
 tf AS (SELECT doc, term, sum(p) p, sum(s) s, sum(i) i FROM long WHERE term IN (SELECT term FROM qe) GROUP BY ALL), df AS (SELECT term, count(*) df FROM tf WHERE p > 0 OR s > 0 GROUP BY 1),
 sc AS (SELECT doc, term, p + s > 0 direct, ln((n - coalesce(df, 1) + 0.5) / (coalesce(df, 1) + 0.5) + 1) idf, 2.0 * p / (0.7 + 0.3 * len(path) / ap) + 1.0 * s / (0.6 + 0.4 * len(symbols) / asy) + 0.5 * i / (0.5 + 0.5 * len(imports) / ai) ptf FROM tf JOIN d USING (doc) LEFT JOIN df USING (term), st),
 bm AS (SELECT query, doc, sum(weight * idf * ptf * 2.2 / (ptf + 1.2)) score, NOT bool_or(direct) import_only FROM sc JOIN qe USING (term) GROUP BY ALL)"""


@query("""WITH parts AS (SELECT id, unnest(regexp_split_to_array(coalesce(name, ''), '[^a-zA-Z0-9]+')) part FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC NULLS LAST) rn FROM symbols WHERE id IS NOT NULL) WHERE rn = 1),
  camel AS (SELECT id, part, list_filter(string_split(regexp_replace(regexp_replace(part, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), ' '), lambda w: w <> '') c FROM parts),
  w AS (SELECT id, part, len(c) n, list_filter(list_transform(c, lambda w: lower(w)), lambda w: length(w) >= 2) v FROM camel), k AS (SELECT *, list_filter(v, lambda w: NOT list_contains(STOP, w)) kept FROM w)
  SELECT id, term, count(*) n FROM (SELECT id, unnest(list_concat(kept, CASE WHEN n > 1 AND len(kept) < len(v) AND length(part) >= 4 AND NOT list_contains(STOP, lower(part)) THEN [lower(part)] ELSE [] END)) term FROM k) GROUP BY ALL""".replace("STOP", str(__import__("sparkloom.functions.words", fromlist=["STOP_WORDS"]).STOP_WORDS)))
def tokenize(spark: SparkSession, d: str) -> DataFrame:
    """Terms of every symbol's name."""
    s = latest_by(t(spark, d, "symbols").where("id IS NOT NULL").select("id", "name", "indexed_at"), ["id"], ["indexed_at"])
    return s.select("id", F.explode(identifier_terms(F.col("name"))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("n"))


@query(f"WITH {_DOCS} SELECT term, count(*) df FROM (SELECT DISTINCT doc, unnest(list_concat(path, symbols)) term FROM d) GROUP BY 1 HAVING count(*) >= 2")
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    """Document frequency of every term in two documents or more."""
    return R.document_frequency(documents(spark, d), 2)


@query(f"WITH {_EXP} SELECT query, term, weight FROM qe")
def synonyms(spark: SparkSession, d: str) -> DataFrame:
    """The fixed queries with their synonyms."""
    return expanded(spark)


@query(f"WITH {_BM25F} SELECT query, doc, round(score, 6) score, import_only FROM bm")
def bm25f(spark: SparkSession, d: str) -> DataFrame:
    """Scores of all documents that match."""
    return R.bm25f(documents(spark, d), expanded(spark)).withColumn("score", F.round("score", 6))


@query(f"WITH {_BM25F}, b2 AS (SELECT query, doc, score, import_only OR doc % 7 = 0 io FROM bm), e AS (SELECT query, min(score) FILTER (WHERE NOT io) low, max(score) FILTER (WHERE io) high FROM b2 GROUP BY 1) SELECT query, doc, round(CASE WHEN io AND low IS NOT NULL AND high > 0.5 * low THEN score * 0.5 * low / high ELSE score END, 6) score FROM b2 JOIN e USING (query)")
def import_ceiling(spark: SparkSession, d: str) -> DataFrame:
    """Scores under the ceiling; every seventh document is taken as import-only as well."""
    s = R.bm25f(documents(spark, d), expanded(spark)).withColumn("import_only", F.col("import_only") | (F.col("doc") % 7 == 0))
    return R.import_ceiling(s).select("query", "doc", F.round("score", 6).alias("score"))


@query(f"WITH {_BM25F} SELECT query, doc, round(max(score), 6) score FROM (SELECT query, doc, score FROM bm UNION ALL SELECT query, doc + 1, 0.6 * score FROM bm WHERE doc % 2 = 0) GROUP BY ALL")
def test_proxy(spark: SparkSession, d: str) -> DataFrame:
    """Even documents stand in as tests of their successors."""
    s = R.bm25f(documents(spark, d), expanded(spark))
    mapping = t(spark, d, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("test"), (F.col("doc_id") + 1).alias("source"))
    return R.test_proxy(s, mapping).withColumn("score", F.round("score", 6))


def _spread_sql() -> str:
    steps = ["c AS (SELECT src a, dst b, 0.5 + weight / 2 conf FROM edges)", "way AS (SELECT f, t, max(w) w FROM (SELECT dst f, src t, 0.4::DOUBLE w FROM edges UNION ALL SELECT src, dst, 0.2 FROM edges UNION ALL SELECT a, b, 0.4 * conf FROM c UNION ALL SELECT b, a, 0.4 * conf FROM c) GROUP BY ALL)", "r0 AS (SELECT 'q' query, id node, id::INT / 10.0 score FROM nodes WHERE id::INT < 3)"]
    for h in (1, 2, 3):
        steps.append(f"r{h} AS MATERIALIZED (SELECT query, node, max(score) score FROM (SELECT * FROM r{h - 1} UNION ALL SELECT query, t, score * w * {0.5 ** (h - 1)} FROM r{h - 1} JOIN way ON f = node WHERE score > 0) GROUP BY ALL)")
    return f"WITH {TRADE}, {', '.join(steps)} SELECT query, node, round(score, 6) score FROM r3"


@query(_spread_sql())
def spread(spark: SparkSession, d: str) -> DataFrame:
    """Scores of three nations spread over the trade graph, couplings from revenue shares."""
    e = trade_graph(spark, d)
    s = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct().where(F.col("node").cast("int") < 3).select(F.lit("q").alias("query"), "node", (F.col("node").cast("int") / 10.0).alias("score"))
    return R.spread(s, e, e.select(F.col("src").alias("a"), F.col("dst").alias("b"), (0.5 + F.col("weight") / 2).alias("confidence"))).withColumn("score", F.round("score", 6))


_SYMS = "s AS (SELECT id doc, file_path AS file, authority, name, coalesce(list_transform(list_filter(body_tokens, lambda w: w IS NOT NULL), lambda w: lower(w)), []) body FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC NULLS LAST) rn FROM symbols WHERE id IS NOT NULL) WHERE rn = 1)"


def _plus_sql(name: str, tokens: str) -> str:
    return f"""{name}_l AS (SELECT doc, unnest({tokens}) term, len({tokens}) n FROM s), {name}_tf AS (SELECT doc, term, count(*) tf, any_value(n) n FROM {name}_l WHERE term IN (SELECT term FROM qe) GROUP BY ALL), {name}_df AS (SELECT term, count(*) df FROM {name}_tf GROUP BY 1),
     {name}_st AS (SELECT count(*) n, greatest(avg(len({tokens})), 1) a FROM s), {name} AS (SELECT query, doc, sum(weight * ln((st.n - df + 0.5) / (df + 0.5) + 1) * (x * 2.2 / (x + 1.2) + 1)) score FROM (SELECT t.doc, t.term, df, st.n, t.tf / (0.6 + 0.4 * t.n / st.a) x FROM {name}_tf t JOIN {name}_df USING (term), {name}_st st) st JOIN qe USING (term) GROUP BY ALL)"""


@query(f"""WITH {_EXP}, {_SYMS}, s2 AS (SELECT *, {_words('name')} nt FROM s), {_plus_sql('bb', 'body')}, {_plus_sql('nn', 'nt').replace('FROM s)', 'FROM s2)')},
  tot AS (SELECT query, doc, sum(score) score FROM (SELECT * FROM bb UNION ALL SELECT query, doc, 0.5 * score FROM nn) GROUP BY ALL), z AS (SELECT query, file, doc, score + 0.3 * coalesce(CASE WHEN isnan(authority) THEN 0 ELSE authority END, 0) score FROM tot JOIN s USING (doc))
  SELECT query, "file", doc, round(score, 6) score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query, file ORDER BY round(score, 9) DESC, doc) rank FROM z) WHERE rank <= 3""")
def bm25_plus(spark: SparkSession, d: str) -> DataFrame:
    """Best three symbols of each file by body, name and authority."""
    s = latest_by(t(spark, d, "symbols").where("id IS NOT NULL").select("id", "file_path", "authority", "name", "body_tokens", "indexed_at"), ["id"], ["indexed_at"])
    body = F.coalesce(F.transform(F.filter("body_tokens", lambda w: w.isNotNull()), F.lower), F.array().cast("array<string>"))
    s = s.select(F.col("id").alias("doc"), F.col("file_path").alias("file"), F.when(~F.isnan("authority"), F.col("authority")).alias("authority"), body.alias("body"), words(F.col("name")).alias("name"))
    q = expanded(spark)
    return R.rank_symbols(R.bm25_plus(s, "body", q), R.bm25_plus(s, "name", q), s.select("doc", "file", "authority")).select("query", "file", "doc", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH q(query, term) AS (VALUES ('c1', 'map'), ('c1', 'stage'), ('c1', 'api'), ('c2', 'formatter'), ('c2', 'run'), ('c3', 'resolve'), ('c3', 'fixture')), m AS (SELECT DISTINCT graph_id || hash doc, first_value(message) OVER (PARTITION BY graph_id, hash ORDER BY ts DESC NULLS LAST, ingested_at DESC NULLS LAST) message FROM commits),
  d AS (SELECT doc, {_words('message')} w FROM m), st AS (SELECT count(*) n, greatest(avg(len(w)), 1) a FROM d), tf AS (SELECT doc, term, count(*) tf, any_value(n) n FROM (SELECT doc, unnest(w) term, len(w) n FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, count(*) df FROM tf GROUP BY 1),
  sc AS (SELECT query, doc, sum(ln((st.n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * tf.n / a))) score FROM tf JOIN df USING (term) JOIN q USING (term), st GROUP BY ALL)
  SELECT query, doc, round(score, 6) score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) rank FROM sc) WHERE rank <= 5""")
def commit_bm25(spark: SparkSession, d: str) -> DataFrame:
    """Best commits for three queries by message."""
    c = latest_by(t(spark, d, "commits").select("graph_id", "hash", "message", "ts", "ingested_at"), ["graph_id", "hash"], ["ts", "ingested_at"])
    docs = c.select(F.concat("graph_id", "hash").alias("doc"), words(F.col("message")).alias("w"))
    q = spark.createDataFrame([("c1", "map"), ("c1", "stage"), ("c1", "api"), ("c2", "formatter"), ("c2", "run"), ("c3", "resolve"), ("c3", "fixture")], "query string, term string").withColumn("weight", F.lit(1.0))
    s = R.bm25_plus(docs, "w", q, R.GIT_K1, R.GIT_B, 0.0)
    return R.top_k(s, 5, ["query"], [F.round("score", 9).desc(), F.col("doc")]).withColumn("score", F.round("score", 6))


_DOT = "list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[])"


@query(f"SELECT query, id, round(score, 4) score, rank FROM (SELECT q.vec_id query, v.vec_id id, {_DOT} score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DOT} DESC, v.vec_id) rank FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0) WHERE rank <= 10")
def knn_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Ten nearest vectors of every hundredth one."""
    v = t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return R.knn(v.where("id % 100 = 0").withColumnRenamed("id", "query"), v).withColumn("score", F.round("score", 4))


@query(f"SELECT query, owner, round(max(score), 4) score FROM (SELECT q.vec_id query, v.label AS owner, {_DOT} score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DOT} DESC, v.vec_id) rank FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0 AND v.label < 5) WHERE rank <= 10 GROUP BY ALL")
def knn_prefiltered(spark: SparkSession, d: str) -> DataFrame:
    """The same among candidates of five labels, best score per label."""
    v = t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    near = R.knn(v.where("id % 100 = 0").select(F.col("id").alias("query"), "embedding"), v.where("label < 5"))
    return R.best_per_owner(near, v.select("id", F.col("label").alias("owner"))).withColumn("score", F.round("score", 4))


@query(f"""WITH {_BM25F}, lex AS (SELECT query, doc item, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) rank FROM bm), v AS (SELECT 'q1' query, v.vec_id item, row_number() OVER (ORDER BY {_DOT} DESC, v.vec_id) rank FROM embeddings q, embeddings v WHERE q.vec_id = 100)
  SELECT query, item, round(sum(1.0::DOUBLE / (60 + rank)), 6) score, count(*) rankers FROM (SELECT * FROM lex WHERE rank <= 20 UNION ALL SELECT * FROM v WHERE rank <= 50) GROUP BY ALL""")
def rrf_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """Lexical and vector rankings fused."""
    lex = R.top_k(R.bm25f(documents(spark, d), expanded(spark)), 20, ["query"], [F.round("score", 9).desc(), F.col("doc")]).select("query", F.col("doc").alias("item"), "rank")
    v = t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    near = R.knn(v.where("id = 100").withColumnRenamed("id", "query"), v, 50).select(F.lit("q1").alias("query"), F.col("id").alias("item"), "rank")
    return R.rrf([lex, near]).withColumn("score", F.round("score", 6))


def own_words(spark: SparkSession, d: str) -> DataFrame:
    """(query, term, weight): for every hundredth vector the words of its document, the one of the same number, with synonyms."""
    ids = t(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("doc")).distinct()
    own = documents(spark, d).join(ids, "doc").select(F.col("doc").alias("query"), F.explode(F.array_distinct("symbols")).alias("term"))
    return R.expand(own, spark.createDataFrame(R.synonym_rows(), "term string, synonym string"))


_OWN = _BM25F.replace(_Q, f"q AS (SELECT DISTINCT vec_id query, unnest({_words('text')}) term FROM documents JOIN embeddings ON vec_id = doc_id WHERE vec_id % 100 = 0)")


@query(f"""WITH {_OWN}, lex AS (SELECT query, doc item, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) rank FROM bm), v AS (SELECT q.vec_id query, v.vec_id item, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DOT} DESC, v.vec_id) rank FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0)
  SELECT query, item, round(sum(1.0::DOUBLE / (60 + rank)), 6) score, count(*) rankers FROM (SELECT * FROM lex WHERE rank <= 20 UNION ALL SELECT * FROM v WHERE rank <= 50) GROUP BY ALL""")
def rrf_hybrid_all(spark: SparkSession, d: str) -> DataFrame:
    """Lexical and vector rankings fused for every hundredth vector, its document's words as the lexical query, against all rows."""
    lex = R.top_k(R.bm25f(documents(spark, d), own_words(spark, d)), 20, ["query"], [F.round("score", 9).desc(), F.col("doc")]).select("query", F.col("doc").alias("item"), "rank")
    v = t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    near = R.knn(v.where("id % 100 = 0").withColumnRenamed("id", "query"), v, 50).select("query", F.col("id").alias("item"), "rank")
    return R.rrf([lex, near]).withColumn("score", F.round("score", 6))


@query(f"""WITH {_BM25F}, lex AS (SELECT query, doc item, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) rank FROM bm), want AS (SELECT DISTINCT query, doc item FROM (SELECT doc, unnest(symbols) term FROM d) JOIN q USING (term) WHERE doc % 3 = 0), h AS (SELECT query, 1.0::DOUBLE / min(rank) rr, sum((rank <= 5)::INT) f FROM lex JOIN want USING (query, item) GROUP BY 1), z AS (SELECT query, count(*) n FROM want GROUP BY 1)
  SELECT query, round(coalesce(rr, 0), 6) rr, round(coalesce(f, 0) / n, 6) recall, round(coalesce(f, 0) / 5, 6) AS precision FROM z LEFT JOIN h USING (query)""")
def retrieval_quality(spark: SparkSession, d: str) -> DataFrame:
    """Reciprocal rank, recall and precision when every third matching document is expected."""
    docs = documents(spark, d)
    ranked = R.top_k(R.bm25f(docs, expanded(spark)), 1 << 30, ["query"], [F.round("score", 9).desc(), F.col("doc")]).select("query", F.col("doc").alias("item"), "rank")
    want = docs.where("doc % 3 = 0").select(F.col("doc").alias("item"), F.explode("symbols").alias("term")).join(asked(spark), "term").select("query", "item").distinct()
    q = R.retrieval_quality(ranked, want)
    return q.withColumns({c: F.round(c, 6) for c in ("rr", "recall", "precision")})


@query("WITH d AS (SELECT graph_id, path, count(*) n FROM files WHERE path IS NOT NULL GROUP BY ALL) SELECT graph_id, path, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY n DESC, path) rank FROM d) WHERE rank <= 8")
def hub_top(spark: SparkSession, d: str) -> DataFrame:
    """Eight most written files of each repository as hubs."""
    f = t(spark, d, "files").where("path IS NOT NULL").groupBy("graph_id", F.col("path").alias("node")).agg(F.count("*").alias("n"))
    h = E.hubs(f.withColumns({"authority": F.col("n").cast("double"), "hub": F.lit(0.0)}))
    return h.select("graph_id", F.col("node").alias("path"), "n", "rank")
