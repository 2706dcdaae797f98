"""Queries that draw several fact tables together, extract facts from texts, and resolve intents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.words import words
from ..operators import edges as E
from ..operators import extraction as X
from ..operators import graph as G
from ..operators import history as H
from ..operators import intent as I
from ..operators import learning as M
from ..operators import reports as P
from ..operators import retrieval as R
from ..shared import durable, latest_by
from ..shared import table as t
from ..sources.source_tree import language_of
from .graph import _hits_sql
from .history import _COUPLED
from .inputs import TRADE, VOLUMES, history, trade_graph, trade_volumes
from .registry import ORACLES, query

_FILES = "f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY updated_at DESC NULLS LAST) rn FROM files WHERE path IS NOT NULL) WHERE rn = 1)"


def _files(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return latest_by(t(spark, d, "files").where("path IS NOT NULL").select("path", *columns, "updated_at"), ["path"], ["updated_at"]).select("path", *columns)


def _cards(spark: SparkSession, d: str, coupled: DataFrame) -> DataFrame:
    f = _files(spark, d, "role", "test_files")
    tests = f.select("path", F.explode("test_files").alias("test")).where("test IS NOT NULL")
    return P.cards(f.select("path", "role"), coupled, tests)


@query(f"""WITH {_COUPLED}, {_FILES}, b AS (SELECT file_a path, file_b other, confidence c FROM ranked WHERE rank <= 10 UNION ALL SELECT file_b, file_a, confidence FROM ranked WHERE rank <= 10), tp AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY round(c, 9) DESC, other) k FROM b),
  g AS (SELECT path, string_agg(other, ',' ORDER BY k) co FROM tp WHERE k <= 3 GROUP BY 1), n AS (SELECT path, count(DISTINCT x) n FROM (SELECT path, unnest(test_files) x FROM f) WHERE x IS NOT NULL GROUP BY 1) SELECT f.path, f.role AS "role", coalesce(co, '') co_changes, coalesce(n, 0) tests FROM f LEFT JOIN g USING (path) LEFT JOIN n USING (path)""")
def graph_cards(spark: SparkSession, d: str) -> DataFrame:
    """Card of every file."""
    return _cards(spark, d, H.change_coupling(history(spark, d)))


@query(ORACLES["graph_cards"].replace("ranked WHERE rank <= 10", "coupled"))
def graph_cards_all(spark: SparkSession, d: str) -> DataFrame:
    """Card of every file from all couplings of its repository, not only the ten reported ones."""
    return _cards(spark, d, H.change_coupling(history(spark, d), top=None))


@query(f"""WITH {_COUPLED}, w AS (SELECT graph_id, file_a "file", file_b missing, conf_ab c FROM coupled UNION ALL SELECT graph_id, file_b, file_a, conf_ba FROM coupled), ch AS (SELECT min("file") f FROM w GROUP BY graph_id)
  SELECT "file", missing, round(c, 6) confidence FROM w WHERE c >= 0.5 AND "file" IN (SELECT f FROM ch) AND missing NOT IN (SELECT f FROM ch)""")
def missing_co_changes(spark: SparkSession, d: str) -> DataFrame:
    """Partners left out by a change to the first coupled file of each repository."""
    coupled = H.change_coupling(history(spark, d), top=None)
    changed = coupled.groupBy("graph_id").agg(F.min(F.least("file_a", "file_b")).alias("file")).select("file")
    return P.missing_co_changes(changed, coupled).withColumn("confidence", F.round("confidence", 6))


@query(f"""WITH {_FILES}, c AS (SELECT * FROM f) SELECT path AS "file", 'chokepoint' finding FROM c WHERE is_chokepoint UNION ALL SELECT path, 'cross-cutting' FROM c WHERE is_cross_cutting UNION ALL SELECT path, 'bottleneck' FROM c WHERE betweenness > 0.1 AND NOT isnan(betweenness)""")
def ci_findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings on a change that touches every file."""
    f = _files(spark, d, "is_chokepoint", "is_cross_cutting", "betweenness")
    return P.findings(f.select(F.col("path").alias("file")), f)


@query(f"""WITH RECURSIVE {TRADE}, st AS (SELECT id FROM nodes), w(s, n, k) AS (SELECT dst, src, 1 FROM edges WHERE dst IN (FROM st) UNION SELECT s, src, k + 1 FROM w JOIN edges ON dst = n WHERE k < 5),
  near AS (SELECT s, n, min(k) k FROM w WHERE s <> n GROUP BY ALL), r1 AS (SELECT s, n, row_number() OVER (PARTITION BY s ORDER BY k, n) r FROM near),
  cp AS (SELECT src s, dst n, weight c FROM edges UNION ALL SELECT dst, src, weight FROM edges), r2 AS (SELECT s, n, row_number() OVER (PARTITION BY s ORDER BY round(c, 9) DESC, n) r FROM cp WHERE s IN (FROM st)),
  al AS (SELECT s, n FROM r1 UNION SELECT s, n FROM r2), r3 AS (SELECT s, n, row_number() OVER (PARTITION BY s ORDER BY n) r FROM al), fu AS (SELECT s, n, sum(1.0::DOUBLE / (60 + r)) score, count(*) rankers FROM (FROM r1 UNION ALL FROM r2 UNION ALL FROM r3) GROUP BY ALL)
  SELECT "query", item, score, rankers, rank FROM (SELECT 'trade|' || s AS "query", n AS item, round(score, 6) score, rankers, row_number() OVER (PARTITION BY s ORDER BY round(score, 9) DESC, n) rank FROM fu) WHERE rank <= 5""")
def change_impact(spark: SparkSession, d: str) -> DataFrame:
    """What a change of each nation reaches, by distance, revenue and folder (all one)."""
    e = trade_graph(spark, d)
    start = e.select("graph_id", F.explode(F.array("src", "dst")).alias("start")).distinct()
    c = e.select("graph_id", F.col("src").alias("a"), F.col("dst").alias("b"), F.col("weight").alias("confidence"))
    return P.change_impact(e, c, start).withColumn("score", F.round("score", 6))


@query(f"""WITH {_FILES}, k AS (SELECT path, 'chokepoint' x FROM f WHERE is_chokepoint UNION ALL SELECT path, 'cross-cutting' FROM f WHERE is_cross_cutting UNION ALL SELECT path, 'untested' FROM f WHERE NOT has_tests UNION ALL SELECT path, 'unstable' FROM f WHERE instability > 0.8 AND NOT isnan(instability))
  SELECT path AS "file", count(DISTINCT x) factors, string_agg(DISTINCT x, ',' ORDER BY x) which FROM k GROUP BY 1 HAVING count(DISTINCT x) >= 2 ORDER BY 2 DESC, 1 LIMIT 5""")
def technical_debt(spark: SparkSession, d: str) -> DataFrame:
    """Files with most kinds of risk."""
    f = _files(spark, d, "is_chokepoint", "is_cross_cutting", "has_tests", "instability")
    of = lambda c, name: f.where(c).select(F.col("path").alias("file"), F.lit(name).alias("factor"))
    return P.debt([of(F.col("is_chokepoint"), "chokepoint"), of(F.col("is_cross_cutting"), "cross-cutting"), of(~F.col("has_tests"), "untested"), of((F.col("instability") > 0.8) & ~F.isnan("instability"), "unstable")])


_BR = "+".join(f"len(regexp_extract_all(coalesce(text, ''), '{p}'))" for p in P.BRANCHES)


@query(f"SELECT doc_id, ({_BR})::INT branches, CASE WHEN ({_BR}) > 50 THEN 'high' WHEN ({_BR}) >= 20 THEN 'medium' ELSE 'low' END band FROM documents")
def complexity(spark: SparkSession, d: str) -> DataFrame:
    """Branching of every document."""
    n = P.complexity(F.col("text"))
    return t(spark, d, "documents").select("doc_id", n.alias("branches")).withColumn("band", P.band(F.col("branches")))


@query(f"WITH {_FILES}, x AS (SELECT DISTINCT doc_id doc, unnest(regexp_extract_all(text, '`([A-Za-z0-9_@.-]+(?:/[A-Za-z0-9_@.-]+)+\\.[A-Za-z0-9]+)`', 1)) path FROM documents WHERE text IS NOT NULL) SELECT doc, path FROM x WHERE path NOT IN (SELECT path FROM f)")
def lost_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths that documents name and no file has."""
    return P.lost_paths(t(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text"), t(spark, d, "files").where("path IS NOT NULL"))


@query(f"WITH {VOLUMES} SELECT a.n_regionkey::VARCHAR from_package, b.n_regionkey::VARCHAR to_package, count(*) edges FROM volumes JOIN nation a ON src = a.n_nationkey JOIN nation b ON dst = b.n_nationkey WHERE a.n_regionkey <> b.n_regionkey GROUP BY ALL")
def cross_package(spark: SparkSession, d: str) -> DataFrame:
    """Trade between regions as packages."""
    from ..operators.traversal import cross_package as count

    e = trade_volumes(spark, d).select("src", "dst")
    return count(e, t(spark, d, "nation").select(F.col("n_nationkey").alias("path"), F.col("n_regionkey").cast("string").alias("package")))


@query("WITH need AS (SELECT DISTINCT c_mktsegment i, o_orderpriority m FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 480000), have AS (SELECT DISTINCT o_custkey ty, o_orderpriority m FROM orders), z AS (SELECT i, count(*) n FROM need GROUP BY 1) SELECT ty AS \"type\", i AS interface FROM have JOIN need USING (m) JOIN z USING (i) GROUP BY ty, i, n HAVING count(*) = n")
def satisfied_interfaces(spark: SparkSession, d: str) -> DataFrame:
    """Customers that use every priority that a segment's dearest orders need."""
    o = t(spark, d, "orders")
    need = o.where("o_totalprice > 480000").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("interface"), F.col("o_orderpriority").alias("method"))
    return X.satisfied_interfaces(o.select(F.col("o_custkey").alias("type"), F.col("o_orderpriority").alias("method")), need)


def _texts(spark: SparkSession, d: str) -> DataFrame:
    x = t(spark, d, "documents").where("source = 'source_excerpt'")
    return x.select(F.concat_ws("#", F.col("doc_id").cast("string"), "file_path").alias("path"), F.coalesce(language_of(F.col("file_path")), F.lit("typescript")).alias("language"), "text")


@query()
def extract_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Symbols of the source excerpts."""
    return X.facts(X.extract(_texts(spark, d)), "symbols").select("path", "name", "kind", "start_line", "end_line", "is_exported", F.size("body_tokens").alias("tokens"))


@query()
def extract_calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls in the source excerpts; which symbols such calls mean is resolved_calls."""
    return X.facts(X.extract(_texts(spark, d)), "calls").select("path", "caller", "object", "callee", "line", "is_new")


_SEEDTERMS = {"i1": ["cache", "retry", "session"], "i2": ["parser", "schema", "token"]}
_ST = "q(query, term) AS (VALUES " + ", ".join(f"('{k}', '{w}')" for k, ws in _SEEDTERMS.items() for w in ws) + ")"
_w = lambda c: f"list_filter(string_split_regex(lower(coalesce({c}, '')), '[^a-z0-9]+'), lambda w: length(w) >= 3)"


@query(f"""WITH {_ST}, s AS (SELECT id, CASE WHEN isnan(authority) THEN NULL ELSE authority END authority, {_w('file_path')} p, {_w('name')} n FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC NULLS LAST) rn FROM symbols WHERE id IS NOT NULL) WHERE rn = 1),
  h AS (SELECT query, id, authority, 2.0::DOUBLE w FROM (SELECT DISTINCT id, authority, unnest(p) term FROM s) JOIN q USING (term) UNION ALL SELECT query, id, authority, 1.5 FROM (SELECT DISTINCT id, authority, unnest(n) term FROM s) JOIN q USING (term)),
  c AS (SELECT query, id, sum(w) * (1 + 0.5 * coalesce(max(authority), 0)) score FROM h GROUP BY ALL) SELECT query, id, round(score, 6) score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) rank FROM c) WHERE rank <= 10""")
def intent_seeds(spark: SparkSession, d: str) -> DataFrame:
    """Symbols that two tasks' words point at."""
    s = latest_by(t(spark, d, "symbols").where("id IS NOT NULL").select("id", "file_path", "name", "authority", "indexed_at"), ["id"], ["indexed_at"])
    s = s.select("id", F.when(~F.isnan("authority"), F.col("authority")).alias("authority"), words(F.col("file_path")).alias("path_tokens"), words(F.col("name")).alias("name_tokens"))
    q = spark.createDataFrame([(k, w) for k, ws in _SEEDTERMS.items() for w in ws], "query string, term string")
    return I.seeds(s, q).withColumn("score", F.round("score", 6))


@query()
def latent_seeds(spark: SparkSession, d: str) -> DataFrame:
    """Files whose imports are like those of the first two files of their repository, for every repository; query is its graph_id."""
    s = latest_by(t(spark, d, "symbols").where("id IS NOT NULL").select("id", "graph_id", "file_path", "import_names", "indexed_at"), ["id"], ["indexed_at"])
    v = durable(M.latent_vectors(s.where("file_path IS NOT NULL").select("graph_id", F.col("file_path").alias("item"), F.explode("import_names").alias("name")).where("name <> ''")))
    first = R.top_k(v, 2, ["graph_id"], [F.col("item")]).select("graph_id", F.col("graph_id").alias("query"), "item", F.lit(1.0).alias("score"))
    return I.latent_seeds(first, v).drop("graph_id")


def _around(start: str) -> str:
    """Edges and nodes of the trade graph within two hops of a nation, either way."""
    return f"""{TRADE.replace('edges AS', 'whole AS').replace('FROM edges', 'FROM whole').replace('nodes AS', 'every AS')}, u AS (SELECT src x, dst y FROM whole UNION SELECT dst, src FROM whole),
      near AS (SELECT '{start}' id UNION SELECT y FROM u WHERE x = '{start}' UNION SELECT b.y FROM u a JOIN u b ON b.x = a.y WHERE a.x = '{start}'), edges AS (SELECT src, dst FROM whole WHERE src IN (FROM near) AND dst IN (FROM near)), nodes AS (SELECT src id FROM edges UNION SELECT dst FROM edges)"""


@query(" UNION ALL ".join(f"SELECT * FROM ({_hits_sql(_around(x), '1')} SELECT 'trade:{x}' graph_id, node, round(authority, 4) authority, round(hub, 4) hub FROM scored)" for x in ("1", "2")))
def task_hits(spark: SparkSession, d: str) -> DataFrame:
    """Hub and authority scores around nations 1 and 2."""
    e = trade_graph(spark, d).select("graph_id", "src", "dst", F.lit(1.0).alias("weight"))
    starts = spark.createDataFrame([("trade", "1"), ("trade", "2")], "graph_id string, start string")
    return I.task_hits(e, starts).select("graph_id", "node", *[F.round(c, 4).alias(c) for c in ("authority", "hub")])


@query(_hits_sql(TRADE, "weight * CASE WHEN src::INT % 2 = 0 THEN 1.0::DOUBLE ELSE 0.3 END", every_round=True) + " SELECT 'trade' graph_id, node, round(authority, 4) authority, round(hub, 4) hub FROM scored")
def symbol_hits(spark: SparkSession, d: str) -> DataFrame:
    """Hub scores over typed edges, scaled every round; kinds are made up from the nations' numbers."""
    e = trade_graph(spark, d).select("graph_id", "src", "dst", F.when(F.col("src").cast("int") % 2 == 0, "calls").otherwise("uses_type").alias("kind"), F.col("weight").alias("confidence"))
    return I.symbol_hits(e).withColumns({c: F.round(c, 4) for c in ("authority", "hub")})


@query(f"""WITH RECURSIVE {TRADE}, w(n, s, k) AS (SELECT '1', 1.0::DOUBLE, 0 UNION ALL SELECT dst, max(s * weight), k + 1 FROM w JOIN edges ON src = n WHERE s * weight >= 0.001 AND k < 12 GROUP BY dst, k) SELECT n AS node, round(max(s), 6) score FROM w GROUP BY 1""")
def strongest_paths(spark: SparkSession, d: str) -> DataFrame:
    """Greatest product of revenue shares from nation 1."""
    return I.strongest_paths(trade_graph(spark, d), {"1": 1.0}).select("node", F.round("score", 6).alias("score"))


@query()
def reseeded(spark: SparkSession, d: str) -> DataFrame:
    """Katz scores with a second start from bottlenecks."""
    e = trade_graph(spark, d)
    return I.reseeded(e, G.betweenness(e), {"1": 1.0}).withColumn("score", F.round("score", 6))


@query()
def execution_flows(spark: SparkSession, d: str) -> DataFrame:
    """Likely flows from two nations to three others, communities by parity."""
    return I.flows(trade_graph(spark, d), {"1": 0.9, "2": 0.5}, ["3", "5", "19"], {str(i): i % 2 for i in range(25)}).withColumn("confidence", F.round("confidence", 6))


@query(f"WITH {TRADE}, g AS (SELECT src, dst, CASE WHEN src::INT % 3 = 0 THEN 'rare' ELSE 'common' END kind, 0.8::DOUBLE c FROM edges), cm AS (SELECT kind FROM g GROUP BY 1 HAVING count(DISTINCT src) > 0.4 * 25) SELECT src, dst, kind, CASE WHEN src::INT % 2 = dst::INT % 2 THEN c / 2 ELSE c END confidence FROM g WHERE kind NOT IN (FROM cm) AND NOT (src::INT % 6 = 0 AND dst::INT % 4 = 0)")
def ghost_gate(spark: SparkSession, d: str) -> DataFrame:
    """Guessed edges without noise, communities by parity."""
    e = trade_graph(spark, d)
    g = e.select("graph_id", "src", "dst", F.when(F.col("src").cast("int") % 3 == 0, "rare").otherwise("common").alias("kind"), F.lit(0.8).alias("confidence"))
    known = e.where((F.col("src").cast("int") % 6 == 0) & (F.col("dst").cast("int") % 4 == 0))
    c = e.select("graph_id", F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("community", F.col("node").cast("int") % 2)
    return E.ghost_gate(g, known, c, 25, 0.4).drop("graph_id")
