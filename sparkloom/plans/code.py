"""Queries over the import graph of the supplied symbols: a file imports the file that exports the name it uses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashes import rolling31, short_sha
from ..functions.paths import directory
from ..operators import edges as E
from ..operators import extraction as X
from ..operators import graph as G
from ..operators import history as H
from ..operators import intent as I
from ..operators import targets as Y
from ..operators import traversal as T
from ..operators.reports import package_view
from ..shared import latest_by
from ..shared import table as t
from .inputs import HISTORY, history
from .registry import query

_SYM = """sym AS (SELECT id, graph_id, file_path, name, kind, import_names, is_exported, authority FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC NULLS LAST) rn FROM symbols WHERE id IS NOT NULL) WHERE rn = 1 AND graph_id IS NOT NULL AND file_path IS NOT NULL),
defs AS (SELECT graph_id, name, min(file_path) dst FROM sym WHERE is_exported AND name IS NOT NULL GROUP BY ALL),
imp AS (SELECT DISTINCT graph_id, file_path src, name, kind FROM (SELECT graph_id, file_path, kind, unnest(import_names) AS name FROM sym) WHERE name <> ''),
named AS (SELECT DISTINCT graph_id, src, dst, name, kind FROM imp JOIN defs USING (graph_id, name) WHERE src <> dst),
e AS (SELECT graph_id, src, dst, count(DISTINCT name) n, bool_and(kind IN ('type', 'interface')) AS type_only FROM named GROUP BY ALL)"""
_TYPES = ["type", "interface"]


def _symbols(spark: SparkSession, d: str) -> DataFrame:
    s = t(spark, d, "symbols").where("id IS NOT NULL").select("id", "graph_id", "file_path", "name", "kind", "import_names", "is_exported", "authority", "indexed_at")
    return latest_by(s, ["id"], ["indexed_at"]).where("graph_id IS NOT NULL AND file_path IS NOT NULL")


def _defs(s: DataFrame) -> DataFrame:
    return s.where("is_exported AND name IS NOT NULL").groupBy("graph_id", "name").agg(F.min("file_path").alias("dst"))


def _imports(s: DataFrame) -> DataFrame:
    return s.select("graph_id", F.col("file_path").alias("src"), "kind", F.explode("import_names").alias("name")).where("name <> ''").distinct()


def _named(spark: SparkSession, d: str) -> DataFrame:
    """(graph_id, src, dst, name, kind): what file imports which name from which file; kind is that of the importing symbol."""
    s = _symbols(spark, d)
    return _imports(s).join(_defs(s), ["graph_id", "name"]).where("src <> dst").select("graph_id", "src", "dst", "name", "kind")


def import_graph(spark: SparkSession, d: str) -> DataFrame:
    """(graph_id, src, dst, weight, is_type_only) between files, weight the number of names."""
    f = Y.file_edges(_named(spark, d), _TYPES)
    return f.select("graph_id", "src", "dst", F.size("names").cast("double").alias("weight"), "is_type_only")


@query(f"WITH {_SYM} SELECT graph_id, src, dst, n AS names, type_only FROM e")
def import_edges(spark: SparkSession, d: str) -> DataFrame:
    """File edges from symbol edges; type-only if every importing symbol is a type."""
    return Y.file_edges(_named(spark, d), _TYPES).select("graph_id", "src", "dst", F.size("names").cast("bigint").alias("names"), F.col("is_type_only").alias("type_only"))


@query(f"WITH {_SYM}, u AS (SELECT graph_id, src, dst, n FROM e UNION ALL SELECT graph_id, dst, src, n FROM e) SELECT graph_id, src, dst, sum(n)::DOUBLE weight FROM u GROUP BY ALL")
def import_adjacency(spark: SparkSession, d: str) -> DataFrame:
    """Undirected weighted adjacency of the import graph."""
    return E.adjacency(import_graph(spark, d), directed=False)


@query(f"""WITH {_SYM}, ends AS (SELECT graph_id, dst node, CASE WHEN type_only THEN 0.3::DOUBLE ELSE 1 END i, 0::DOUBLE o, 1 k FROM e UNION ALL SELECT graph_id, src, 0, CASE WHEN type_only THEN 0.3::DOUBLE ELSE 1 END, 0 FROM e),
  z AS (SELECT graph_id, node, sum(i) i, sum(o) o, sum(k) k FROM ends GROUP BY ALL) SELECT graph_id, node, round(o / (i + o), 6) instability FROM z WHERE o / (i + o) > 0.8 AND k >= 1""")
def unstable_files(spark: SparkSession, d: str) -> DataFrame:
    """Files that somebody imports and that import much more."""
    return E.unstable(import_graph(spark, d)).select("graph_id", "node", F.round("instability", 6).alias("instability"))


@query(f"WITH {_SYM}, ex AS (SELECT DISTINCT graph_id, file_path node, name FROM sym WHERE is_exported AND name IS NOT NULL) SELECT ex.* FROM ex WHERE NOT EXISTS (SELECT 1 FROM named WHERE named.graph_id = ex.graph_id AND dst = node AND named.name = ex.name) AND NOT regexp_matches(node, '(^|/)(index|main|app|server|cli|mod|lib|__init__|__main__|page|layout|route)\\.[a-z]+$')")
def dead_exports(spark: SparkSession, d: str) -> DataFrame:
    """Exported names that no other file of the repository imports, entry files aside."""
    s = _symbols(spark, d)
    exports = s.where("is_exported AND name IS NOT NULL").select("graph_id", F.col("file_path").alias("node"), "name").distinct()
    used = E.used_exports(_named(spark, d).select("graph_id", "src", "dst", F.array("name").alias("names"), F.lit(False).alias("is_barrel_routed")))
    entries = exports.where(F.col("node").rlike(E.ENTRY_FILE)).select("graph_id", "node").distinct()
    return E.dead_exports(exports, used, entries)


@query(f"WITH {_SYM}, i2 AS (SELECT DISTINCT graph_id, src node, name FROM imp), ex AS (SELECT s.graph_id, s.file_path node, (i2.name IS NOT NULL)::INT again FROM sym s LEFT JOIN i2 ON i2.graph_id = s.graph_id AND i2.node = s.file_path AND i2.name = s.name WHERE is_exported AND s.name IS NOT NULL) SELECT graph_id, node, round(avg(again), 6) AS share FROM ex GROUP BY ALL HAVING avg(again) > 0.02")
def barrel_files(spark: SparkSession, d: str) -> DataFrame:
    """Files that export again what they import, from a fiftieth of their exports on, as these tables have few."""
    s = _symbols(spark, d)
    own = _imports(s).select("graph_id", F.col("src").alias("node"), "name", F.lit(True).alias("again")).distinct()
    exports = s.where("is_exported AND name IS NOT NULL").select("graph_id", F.col("file_path").alias("node"), "name").join(own, ["graph_id", "node", "name"], "left")
    return E.barrels(exports.select("graph_id", "node", F.coalesce("again", F.lit(False)).alias("is_reexport")), 0.02).withColumn("share", F.round("share", 6))


@query(f"""WITH {_SYM}, star AS (SELECT DISTINCT graph_id, src node, dst target FROM e WHERE n = 1), re AS (SELECT graph_id, src node, name, min(dst) target FROM named GROUP BY ALL),
  nm AS (SELECT DISTINCT graph_id, src, dst, name FROM named),
  r AS (SELECT nm.graph_id, nm.src, nm.dst, nm.name, re.target named_at, star.target star_at FROM nm LEFT JOIN re ON re.graph_id = nm.graph_id AND re.node = nm.dst AND re.name = nm.name LEFT JOIN star ON star.graph_id = nm.graph_id AND star.node = nm.dst)
  SELECT DISTINCT graph_id, src, coalesce(named_at, star_at, dst) dst, name, coalesce(named_at, star_at) IS NOT NULL routed FROM r WHERE src <> coalesce(named_at, star_at, dst)""")
def routed_imports(spark: SparkSession, d: str) -> DataFrame:
    """Imports moved behind the file they name, as if every file re-exported what it imports and single-name edges were stars."""
    n = _named(spark, d).select("graph_id", "src", "dst", "name").distinct()
    again = n.groupBy("graph_id", F.col("src").alias("node"), "name").agg(F.min("dst").alias("target"))
    stars = import_graph(spark, d).where("weight = 1").select("graph_id", F.col("src").alias("node"), F.col("dst").alias("target")).distinct()
    return E.route_barrels(n, again, stars).withColumnRenamed("is_barrel_routed", "routed")


@query(f"WITH RECURSIVE {_SYM}, u AS (SELECT graph_id, src x, dst y FROM e UNION SELECT graph_id, dst, src FROM e), r AS (SELECT graph_id, x s, x t FROM u UNION SELECT r.graph_id, r.s, u.y FROM r JOIN u ON u.graph_id = r.graph_id AND u.x = r.t) SELECT graph_id, s AS node, min(t) component FROM r GROUP BY ALL")
def import_components(spark: SparkSession, d: str) -> DataFrame:
    """Weakly connected parts of the import graph, by rounds of joins."""
    e = import_graph(spark, d)
    return T.components(e, e.select("graph_id", F.explode(F.array("src", "dst")).alias("node")))


@query(f"WITH RECURSIVE {_SYM}, r AS (SELECT graph_id, src s, dst t FROM e UNION SELECT r.graph_id, r.s, e.dst FROM r JOIN e ON e.graph_id = r.graph_id AND e.src = r.t), m AS (SELECT x.graph_id, x.s, least(x.s, min(x.t)) c FROM r x JOIN r y ON y.graph_id = x.graph_id AND y.s = x.t AND y.t = x.s GROUP BY x.graph_id, x.s), n AS (SELECT graph_id, src id FROM e UNION SELECT graph_id, dst FROM e), z AS (SELECT n.graph_id, id, coalesce(c, id) c FROM n LEFT JOIN m ON m.graph_id = n.graph_id AND s = id) SELECT graph_id, id AS node, c AS component, count(*) OVER (PARTITION BY graph_id, c) AS size FROM z")
def import_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Strongly connected parts of every repository's import graph."""
    return G.strong_components(import_graph(spark, d))


_COUPLED = """raw_c AS (SELECT graph_id, least(a, b) a, greatest(a, b) b, CASE WHEN isnan(confidence) OR confidence < 0 THEN NULL WHEN confidence > 1 THEN confidence / 100 ELSE confidence END AS v FROM (SELECT graph_id, file_a a, file_b b, confidence FROM change_coupling) WHERE a <> b),
cc AS (SELECT graph_id, a, b, max(v) v FROM raw_c WHERE v IS NOT NULL GROUP BY ALL)"""


def _couplings(spark: SparkSession, d: str) -> DataFrame:
    """(graph_id, a, b, value): the greatest usable confidence of each reported pair."""
    c = t(spark, d, "change_coupling").where("file_a <> file_b")
    value = F.when(F.isnan("confidence") | (F.col("confidence") < 0), None).when(F.col("confidence") > 1, F.col("confidence") / 100).otherwise(F.col("confidence"))
    p = c.select("graph_id", F.least("file_a", "file_b").alias("a"), F.greatest("file_a", "file_b").alias("b"), value.alias("value")).where("value IS NOT NULL")
    return p.groupBy("graph_id", "a", "b").agg(F.max("value").alias("value"))


@query(f"""WITH {_SYM}, {_COUPLED}, u AS (SELECT graph_id, src x, dst y FROM e UNION SELECT graph_id, dst, src FROM e), two AS (SELECT DISTINCT p.graph_id, p.x, q.y FROM u p JOIN u q ON q.graph_id = p.graph_id AND q.x = p.y)
  SELECT graph_id, a AS file_a, b AS file_b, round(v, 6) confidence FROM cc WHERE v >= 0.4 AND NOT EXISTS (SELECT 1 FROM u WHERE u.graph_id = cc.graph_id AND x = a AND y = b) AND NOT EXISTS (SELECT 1 FROM two WHERE two.graph_id = cc.graph_id AND x = a AND y = b)""")
def hidden_by_distance(spark: SparkSession, d: str) -> DataFrame:
    """Reported couplings of files that no path of one or two imports connects."""
    c = _couplings(spark, d).select("graph_id", F.col("a").alias("file_a"), F.col("b").alias("file_b"), F.col("value").alias("confidence"))
    return H.hidden_coupling(c, import_graph(spark, d)).withColumn("confidence", F.round("confidence", 6))


_EX = "ex AS (SELECT DISTINCT query_id, candidate, coalesce(label, 0) label FROM training_examples WHERE query_id IS NOT NULL AND candidate IS NOT NULL)"


@query(f"""WITH {_COUPLED}, {_EX}, bth AS (SELECT a, b, v FROM cc UNION ALL SELECT b, a, v FROM cc), m AS (SELECT x.query_id, x.candidate, max(v) v FROM (SELECT DISTINCT query_id, candidate FROM ex) x JOIN ex s ON s.query_id = x.query_id AND s.label = 1 JOIN bth ON a = x.candidate AND b = s.candidate GROUP BY ALL)
  SELECT DISTINCT query_id AS query, ex.candidate AS item, round(coalesce(v, 0), 6) coupling FROM ex LEFT JOIN m USING (query_id, candidate)""")
def seed_coupling(spark: SparkSession, d: str) -> DataFrame:
    """Greatest reported coupling of each candidate with a positive of its query."""
    x = t(spark, d, "training_examples").where("query_id IS NOT NULL AND candidate IS NOT NULL").select(F.col("query_id").alias("query"), F.col("candidate").alias("item"), "label")
    return Y.best_coupling(x, x.where("label = 1"), _couplings(spark, d).select("a", "b", "value")).withColumn("coupling", F.round("coupling", 6))


_OK = lambda c: f"CASE WHEN {c} >= 0 AND NOT isnan({c}) AND {c} < 'inf'::DOUBLE THEN {c} END"
_FL = f"fl AS (SELECT path, graph_id, {_OK('betweenness')} betweenness, {_OK('authority')} authority, imported_by_count, role FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY updated_at DESC NULLS LAST) rn FROM files WHERE path IS NOT NULL) WHERE rn = 1)"
_ONE = "one AS (SELECT query_id, candidate, example_id, features, label FROM (SELECT *, row_number() OVER (PARTITION BY example_id) rn FROM training_examples WHERE example_id IS NOT NULL AND query_id IS NOT NULL) WHERE rn = 1)"


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """(query, item, example_id, score, betweenness, in_degree, imports_target, lexical, label): one row per example."""
    ok = lambda c: F.when((c >= 0) & ~F.isnan(c) & (c < float("inf")), c)
    x = latest_by(t(spark, d, "training_examples").where("example_id IS NOT NULL AND query_id IS NOT NULL").select("example_id", "query_id", "candidate", "features", "label"), ["example_id"], [])
    f = Y.latest_files(t(spark, d, "files").select("path", "betweenness", "imported_by_count", "updated_at")).select(F.col("path").alias("candidate"), ok(F.col("betweenness")).alias("betweenness"), F.col("imported_by_count").alias("in_degree"))
    lexical, proximity = ok(F.get("features", F.lit(0))), ok(F.get("features", F.lit(1)))
    return x.join(f, "candidate", "left").select(
        F.col("query_id").alias("query"), F.col("example_id").alias("item"), F.round(lexical, 1).alias("score"), "betweenness", "in_degree",
        (F.coalesce(proximity, F.lit(0.0)) > 0).alias("imports_target"), lexical.alias("lexical"), proximity.alias("proximity"), ok(F.get("features", F.lit(2))).alias("coupling"), "label",
    )


_SCORED = f"""{_FL}, {_ONE}, sc AS (SELECT query_id AS query, example_id AS item, round({_OK('features[1]')}, 1) score, betweenness, imported_by_count in_degree, coalesce({_OK('features[2]')}, 0) > 0 imports_target, {_OK('features[1]')} lexical, {_OK('features[2]')} proximity, {_OK('features[3]')} coupling, label FROM one LEFT JOIN fl ON path = candidate)"""


@query(f"WITH {_SCORED} SELECT query, item, row_number() OVER (PARTITION BY query ORDER BY score DESC NULLS LAST, imports_target DESC, betweenness DESC NULLS LAST, in_degree DESC NULLS LAST, item) AS rank FROM sc")
def target_order(spark: SparkSession, d: str) -> DataFrame:
    """Examples of each query in the five-level order; scores are rounded so that there are ties to break."""
    return Y.in_order(_scored(spark, d)).select("query", "item", "rank")


@query(f"WITH {_SCORED} SELECT query, item, CASE WHEN lexical > 0 AND NOT coalesce(proximity > lexical, false) THEN 'direct' WHEN lexical > 0 THEN 'import-only' WHEN coupling > 0 THEN 'coupling' WHEN proximity > 0 THEN 'neighbor' END match FROM sc")
def match_types(spark: SparkSession, d: str) -> DataFrame:
    """How each example would have been found, by which of its features are above 0."""
    kind = Y.match_type(F.col("lexical") > 0, F.col("proximity") > F.col("lexical"), F.col("coupling") > 0, F.col("proximity") > 0)
    return _scored(spark, d).select("query", "item", kind.alias("match"))


@query(f"WITH {_SCORED}, b AS (SELECT query, item, coalesce(lexical, 0) score, max(coalesce(lexical, 0)) OVER (PARTITION BY query) best FROM sc), s AS (SELECT query, item, CASE WHEN best > 0 THEN score / best ELSE 0 END share FROM b) SELECT query, item, round(share, 6) AS share, CASE WHEN share >= 0.8 THEN 'high' WHEN share >= 0.5 THEN 'medium' ELSE 'low' END confidence FROM s")
def relative_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Confidence of each example relative to the best of its query."""
    x = _scored(spark, d).select("query", "item", F.coalesce("lexical", F.lit(0.0)).alias("score"))
    return Y.relative_confidence(x).select("query", "item", F.round("share", 6).alias("share"), "confidence")


@query(f"""WITH {_SCORED}, h AS (SELECT query, item, score, coalesce(lexical >= 0.3, false) l, coalesce(proximity >= 0.3, false) s, coalesce(coupling >= 0.3, false) t, label FROM (SELECT query, item, coalesce(score, 0) score, lexical, proximity, coupling, label FROM sc))
  SELECT query, item, round(least(CASE WHEN NOT l AND NOT s AND NOT t THEN score / 2 WHEN l AND s AND t THEN score * 1.1::DOUBLE ELSE score END, 1), 6) score, concat_ws('+', CASE WHEN l THEN 'lexical' END, CASE WHEN s THEN 'structural' END, CASE WHEN t THEN 'temporal' END) evidence,
   round(0.5::DOUBLE * l::INT + 0.3::DOUBLE * s::INT + 0.2::DOUBLE * t::INT, 6) confidence, coalesce(label = 1, false) was_changed FROM h""")
def verified_targets(spark: SparkSession, d: str) -> DataFrame:
    """Examples with the evidence for them and a recalibrated score; positives are what was changed."""
    x = _scored(spark, d)
    c = x.select("query", "item", F.coalesce("score", F.lit(0.0)).alias("score"), "lexical", F.col("proximity").alias("structural"), F.col("coupling").alias("temporal"))
    return I.verified(c, x.where("label = 1").select("query", "item")).withColumns({k: F.round(k, 6) for k in ("score", "confidence")})


@query(f"WITH {_SYM} SELECT id, name, file_path FROM sym ORDER BY id LIMIT 50 OFFSET 100")
def symbol_page(spark: SparkSession, d: str) -> DataFrame:
    """The third page of fifty symbols by id."""
    return Y.page(_symbols(spark, d).select("id", "name", "file_path"), [F.col("id")], 50, 2)


@query(f"WITH {_SYM}, s AS (SELECT graph_id || '/' || file_path AS id, file_path FROM sym GROUP BY ALL), n AS (SELECT id, count(*) n FROM (SELECT graph_id || '/' || src AS id FROM e UNION ALL SELECT graph_id || '/' || dst FROM e) GROUP BY 1) SELECT s.id, greatest(10, ceil(length(file_path) / 4) + 5 * coalesce(n, 0))::BIGINT AS cost FROM s LEFT JOIN n ON n.id = s.id")
def file_costs(spark: SparkSession, d: str) -> DataFrame:
    """Tokens to show each file with its import edges."""
    one = F.concat_ws("/", "graph_id", "file_path")
    s = _symbols(spark, d).select(one.alias("id"), F.lit("").alias("name"), F.col("file_path").alias("path")).distinct()
    e = import_graph(spark, d).select(F.concat_ws("/", "graph_id", "src").alias("src"), F.concat_ws("/", "graph_id", "dst").alias("dst"))
    return Y.symbol_cost(s, e)


_HOPS = "h1 AS (SELECT graph_id, src s, dst t FROM e), " + ", ".join(f"h{k} AS (SELECT DISTINCT h{k - 1}.graph_id, s, dst t FROM h{k - 1} JOIN e ON e.graph_id = h{k - 1}.graph_id AND e.src = t)" for k in range(2, 6))
_EVERY = " UNION ALL ".join(f"SELECT graph_id, s, t, {k} k FROM h{k}" for k in range(1, 6))


@query(f"""WITH {_SYM}, {HISTORY}, cn AS (SELECT graph_id, f node, count(*) n FROM touched GROUP BY ALL), ch AS (SELECT graph_id, node, n / max(n) OVER (PARTITION BY graph_id) churn FROM cn), {_HOPS}, near AS (SELECT graph_id, s, t, min(k) k FROM ({_EVERY}) WHERE s <> t GROUP BY ALL),
  far AS (SELECT near.graph_id, s node, least(1, sum(churn * pow(0.5::DOUBLE, k))) far FROM near JOIN ch ON ch.graph_id = near.graph_id AND node = t GROUP BY ALL),
  r AS (SELECT graph_id, node, 0.3::DOUBLE * coalesce(churn, 0) + 0.7::DOUBLE * coalesce(far, 0) risk FROM ch FULL JOIN far USING (graph_id, node))
  SELECT graph_id, node, round(risk, 6) risk FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY round(risk, 9) DESC, node) rn FROM r WHERE round(risk, 9) >= 0.1) WHERE rn <= 15""")
def churn_risk(spark: SparkSession, d: str) -> DataFrame:
    """Files whose imports change most, with churn as the share of the repository's busiest file."""
    n = history(spark, d).select("graph_id", F.explode("files").alias("node")).groupBy("graph_id", "node").agg(F.count("*").alias("n"))
    top = n.groupBy("graph_id").agg(F.max("n").alias("top"))
    churn = n.join(top, "graph_id").select("graph_id", "node", (F.col("n") / F.col("top")).alias("churn"))
    return Y.churn_risk(import_graph(spark, d), churn).select("graph_id", "node", F.round("risk", 6).alias("risk"))


@query(f"WITH {_SYM}, x AS (SELECT file_path AS file, authority, name, row_number() OVER (PARTITION BY file_path ORDER BY authority DESC, name) rn FROM sym WHERE authority IS NOT NULL AND NOT isnan(authority) AND name IS NOT NULL) SELECT file, authority AS score, name FROM x WHERE rn = 1")
def best_symbols(spark: SparkSession, d: str) -> DataFrame:
    """The symbol of most authority of each file."""
    return Y.best_member(_symbols(spark, d).where("name IS NOT NULL").select(F.col("file_path").alias("file"), "name", F.col("authority").alias("score")))


@query(f"""WITH {_SYM}, nm AS (SELECT DISTINCT graph_id, src, dst, name FROM named), inn AS (SELECT graph_id, dst, name FROM imp JOIN defs USING (graph_id, name) WHERE src = dst),
  w AS (SELECT graph_id, dst AS f, name, count(*)::DOUBLE w FROM nm GROUP BY ALL UNION ALL SELECT graph_id, dst, name, count(*) * 0.3::DOUBLE FROM inn GROUP BY ALL), z AS (SELECT graph_id || '#' || f AS file, name, sum(w) w FROM w GROUP BY ALL) SELECT file, name, round(w / max(w) OVER (PARTITION BY file), 3) authority FROM z""")
def symbol_authority(spark: SparkSession, d: str) -> DataFrame:
    """Authority of exported names: files that import them, and uses inside their own file."""
    s = _symbols(spark, d)
    met = _imports(s).join(_defs(s), ["graph_id", "name"])
    file = F.concat_ws("#", "graph_id", "dst").alias("file")
    far = met.where("src <> dst").select("graph_id", "src", "dst", "name").distinct().select(file, "name", F.lit(1.0).alias("weight"))
    return X.symbol_authority(far, met.where("src = dst").select(file, "name"))


@query(f"WITH {_SYM}, c AS (SELECT DISTINCT graph_id, file_path p, name caller, unnest(import_names) callee FROM sym WHERE name IS NOT NULL), own AS (SELECT DISTINCT graph_id, file_path, name FROM sym WHERE name IS NOT NULL), r AS (SELECT c.*, own.name IS NOT NULL mine, defs.dst FROM c LEFT JOIN own ON own.graph_id = c.graph_id AND file_path = p AND own.name = callee LEFT JOIN defs ON defs.graph_id = c.graph_id AND defs.name = callee WHERE callee <> '') SELECT graph_id || '#' || p AS path, caller, callee, graph_id || '#' || CASE WHEN mine THEN p ELSE dst END AS target, CASE WHEN mine THEN 1 ELSE 2 END AS tier FROM r WHERE mine OR dst IS NOT NULL")
def resolved_calls(spark: SparkSession, d: str) -> DataFrame:
    """Imported names as calls: those of the own file first, else the file that the repository exports the name from."""
    s = _symbols(spark, d)
    p = F.concat_ws("#", "graph_id", "file_path").alias("path")
    calls = s.where("name IS NOT NULL").select(p, F.col("name").alias("caller"), F.explode("import_names").alias("callee")).where("callee <> ''").distinct()
    calls = calls.select("path", "caller", "callee", F.lit(None).cast("string").alias("object"), F.lit(1).alias("line"), F.lit(False).alias("is_new"))
    imports = _imports(s).join(_defs(s), ["graph_id", "name"]).select(F.concat_ws("#", "graph_id", "src").alias("path"), F.concat_ws("#", "graph_id", "dst").alias("target"), F.array("name").alias("names")).distinct()
    known = s.where("name IS NOT NULL").select(p, "name", "kind")
    return X.resolve_calls(calls, known, imports).select("path", "caller", "callee", "target", "tier")


@query(f"WITH {_SYM} SELECT graph_id, src, dst, kind, round(CASE kind WHEN 'calls' THEN 1.0 WHEN 'extends' THEN 1.0 WHEN 'implements' THEN 0.3 ELSE 0.3 END, 6)::DOUBLE AS weight, round((CASE kind WHEN 'calls' THEN 0.7 WHEN 'extends' THEN 0.8 WHEN 'implements' THEN 0.6 ELSE 0.3 END * CASE WHEN src > dst THEN 0.7 ELSE 1 END)::DOUBLE, 6) passes FROM (SELECT DISTINCT graph_id, src, dst, CASE kind WHEN 'class' THEN 'extends' WHEN 'function' THEN 'calls' WHEN 'interface' THEN 'implements' ELSE 'uses_type' END kind FROM named)")
def edge_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Weight of typed import edges and what share of a score they pass on; edges against the order of paths count as backwards."""
    kind = F.when(F.col("kind") == "class", "extends").when(F.col("kind") == "function", "calls").when(F.col("kind") == "interface", "implements").otherwise("uses_type")
    n = _named(spark, d).select("graph_id", "src", "dst", kind.alias("kind")).distinct()
    passes = I.transmission(F.col("kind"), F.col("src") > F.col("dst"), F.lit(False))
    return n.select("graph_id", "src", "dst", "kind", F.round(I.kind_weight(F.col("kind")), 6).alias("weight"), F.round(passes, 6).alias("passes"))


@query(f"WITH {_SYM}, n AS (SELECT graph_id, node, sum(i) i, sum(o) o FROM (SELECT graph_id, dst node, 1 i, 0 o FROM e UNION ALL SELECT graph_id, src, 0, 1 FROM e) GROUP BY ALL), z AS (SELECT *, count(*) OVER (PARTITION BY graph_id) k FROM n) SELECT graph_id, node, round(CASE WHEN i > o AND k > 1 THEN greatest(ln((k + 1) / (i + 1)) / ln(k + 1), 0.1) ELSE 1 END::DOUBLE, 6) attenuation FROM z")
def import_attenuation(spark: SparkSession, d: str) -> DataFrame:
    """How much less counts what comes through files that everybody imports."""
    g = E.degrees(import_graph(spark, d))
    k = g.groupBy("graph_id").agg(F.count("*").alias("k"))
    return g.join(k, "graph_id").select("graph_id", "node", F.round(I.attenuation(F.col("in_degree"), F.col("out_degree"), F.col("k")), 6).alias("attenuation"))


@query(f"WITH {_SYM} SELECT graph_id, to_json(list([src, dst] ORDER BY src, dst))::VARCHAR AS rows FROM e GROUP BY 1")
def graph_json(spark: SparkSession, d: str) -> DataFrame:
    """The edges of each repository as one JSON array."""
    return Y.rows_as_json(import_graph(spark, d), "graph_id", ["src", "dst"])


@query(f"WITH {_SYM}, p AS (SELECT min(regexp_replace(src, '/[^/]*$', '')) || '/' p FROM e) SELECT graph_id, substr(src, length(p) + 1) src, substr(dst, length(p) + 1) dst FROM e, p WHERE starts_with(src, p) AND starts_with(dst, p)")
def package_edges(spark: SparkSession, d: str) -> DataFrame:
    """Import edges inside the first folder that has any, the folder cut off."""
    e = import_graph(spark, d).select("graph_id", "src", "dst")
    first = e.agg(F.min(directory(F.col("src")))).first()[0]
    return package_view(e, ["src", "dst"], first or "")


@query("SELECT entry_id, length(lower(trim(coalesce(content, '')))) < 10 OR lower(trim(coalesce(content, ''))) IN ('yes', 'no', 'ok', 'okay', 'thanks', 'continue', 'go on', 'done') trivial FROM session_entries")
def trivial_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Which log entries are too short or plain to act on."""
    return t(spark, d, "session_entries").select("entry_id", I.trivial(F.col("content")).alias("trivial"))


@query("""WITH x AS (SELECT entry_id, content, instr(lower(content), 'test') pos FROM session_entries) SELECT entry_id, coalesce(pos > 0 AND NOT regexp_matches(substr(content, greatest(pos - 30, 1), least(pos - 1, 30)), '(?i)\\b(not|don''t|never|without|except|avoid|instead of)\\b'), false) mentioned FROM x""")
def mentions(spark: SparkSession, d: str) -> DataFrame:
    """Which log entries speak of tests without a negation just before."""
    return t(spark, d, "session_entries").select("entry_id", F.coalesce(I.mentions(F.col("content"), F.lit("test")), F.lit(False)).alias("mentioned"))


_KINDS = "CASE kind WHEN 'class' THEN 'extends' WHEN 'function' THEN 'calls' WHEN 'interface' THEN 'implements' ELSE 'uses_type' END"
_FLOW = f"""te AS (SELECT DISTINCT graph_id, src, dst, {_KINDS} kind FROM named), dg AS (SELECT graph_id, node, sum(i) i, sum(o) o FROM (SELECT graph_id, dst node, 1 i, 0 o FROM te UNION ALL SELECT graph_id, src, 0, 1 FROM te) GROUP BY ALL),
  sz AS (SELECT graph_id, count(*) k FROM dg GROUP BY 1), inf AS (SELECT dg.graph_id, node, CASE WHEN i > o AND k > 1 THEN greatest(ln((k + 1) / (i + 1)) / ln(k + 1), 0.1) ELSE 1 END::DOUBLE inf FROM dg JOIN sz USING (graph_id)),
  cd AS (SELECT graph_id, least(file_a, file_b) a, greatest(file_a, file_b) b, min(last_cochange_days) dd FROM change_coupling WHERE file_a <> file_b GROUP BY ALL),
  au AS (SELECT graph_id, file_path node, max(CASE WHEN isnan(authority) THEN NULL ELSE authority END) a FROM sym GROUP BY ALL),
  fw AS (SELECT te.graph_id, te.src, te.dst, sum(CASE kind WHEN 'calls' THEN 1.0::DOUBLE WHEN 'extends' THEN 1.0 ELSE 0.3 END * 0.5 * pow(greatest(coalesce(au.a, 0), 0.01), 0.7::DOUBLE) * coalesce(greatest(0.05::DOUBLE, exp(-0.0333::DOUBLE * dd)), 0.05) * inf) w
    FROM te JOIN inf ON inf.graph_id = te.graph_id AND inf.node = te.dst LEFT JOIN au ON au.graph_id = te.graph_id AND au.node = te.dst LEFT JOIN cd ON cd.graph_id = te.graph_id AND cd.a = least(te.src, te.dst) AND cd.b = greatest(te.src, te.dst) GROUP BY ALL)"""


def _typed(spark: SparkSession, d: str) -> DataFrame:
    """(graph_id, src, dst, kind): import edges typed by the kind of the importing symbol."""
    kind = F.when(F.col("kind") == "class", "extends").when(F.col("kind") == "function", "calls").when(F.col("kind") == "interface", "implements").otherwise("uses_type")
    return _named(spark, d).select("graph_id", "src", "dst", kind.alias("kind")).distinct()


@query(f"WITH {_SYM}, {_FLOW} SELECT graph_id, src, dst, round(w, 9) AS weight FROM fw")
def flow_weights(spark: SparkSession, d: str) -> DataFrame:
    """Weights of the import edges for the absorbing flow: kind, authority, last common change, attenuation."""
    days = t(spark, d, "change_coupling").where("file_a <> file_b").groupBy("graph_id", F.least("file_a", "file_b").alias("a"), F.greatest("file_a", "file_b").alias("b")).agg(F.min("last_cochange_days").alias("cochange_days"))
    e = _typed(spark, d).withColumns({"a": F.least("src", "dst"), "b": F.greatest("src", "dst")}).join(days, ["graph_id", "a", "b"], "left")
    e = e.select("graph_id", "src", "dst", "kind", F.lit(None).cast("double").alias("confidence"), "cochange_days", F.lit(None).cast("double").alias("prior"))
    own = _symbols(spark, d).groupBy("graph_id", F.col("file_path").alias("node")).agg(F.max(F.when(~F.isnan("authority"), F.col("authority"))).alias("authority"))
    return I.flow_weights(e, own).withColumn("weight", F.round("weight", 9))


@query(f"""WITH {_SYM}, te AS (SELECT DISTINCT graph_id, src, dst, {_KINDS} kind FROM named), p AS (SELECT graph_id, src, dst, CASE kind WHEN 'calls' THEN 0.7::DOUBLE WHEN 'extends' THEN 0.8 WHEN 'implements' THEN 0.6 ELSE 0.3 END w FROM te)
  SELECT graph_id, src, dst, round(sum(w), 6) AS weight FROM (FROM p UNION ALL SELECT graph_id, dst, src, w * 0.7::DOUBLE FROM p) GROUP BY ALL""")
def propagation_edges(spark: SparkSession, d: str) -> DataFrame:
    """Typed import edges both ways, as scores spread along them."""
    return I.both_ways(_typed(spark, d).withColumn("confidence", F.lit(1.0))).withColumn("weight", F.round("weight", 6))


@query()
def propagated(spark: SparkSession, d: str) -> DataFrame:
    """Scores spread both ways over typed imports from the first file of each repository."""
    e = _typed(spark, d).withColumn("confidence", F.lit(1.0))
    first = e.groupBy("graph_id").agg(F.min("src").alias("node")).withColumn("value", F.lit(1.0))
    return I.propagate(e, first).withColumn("score", F.round("score", 6))


@query("SELECT path, substr(sha256(path), 1, 16) AS sha FROM files WHERE path IS NOT NULL GROUP BY ALL")
def path_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Short digests of all paths."""
    return t(spark, d, "files").where("path IS NOT NULL").select("path").distinct().select("path", short_sha(F.col("path")).alias("sha"))


@query("""WITH RECURSIVE p AS (SELECT DISTINCT path FROM files WHERE path IS NOT NULL AND length(path) <= 60), h(path, i, h) AS (SELECT path, 0, 0::BIGINT FROM p UNION ALL SELECT path, i + 1, (h * 31 + ascii(path[i + 1])) & 4294967295 FROM h WHERE i < length(path)) SELECT path, h AS hash FROM h WHERE i = length(path)""")
def rolling_hashes(spark: SparkSession, d: str) -> DataFrame:
    """The 31-hash of every path of up to sixty characters."""
    return t(spark, d, "files").where("length(path) <= 60").select("path").distinct().select("path", rolling31(F.col("path")).alias("hash"))


_BETWEEN = f"""WITH RECURSIVE {_SYM}, n AS (SELECT graph_id, src id FROM e UNION SELECT graph_id, dst FROM e), walk(g, s, t, far, n) AS (SELECT graph_id, id, id, 0, 1::DOUBLE FROM n UNION ALL SELECT g, s, dst, far + 1, sum(walk.n)::DOUBLE FROM walk JOIN e ON e.graph_id = g AND src = t WHERE far < 30 GROUP BY g, s, dst, far + 1),
 near AS (SELECT g, s, t, min(far) far FROM walk GROUP BY ALL), sp AS (SELECT walk.* FROM walk JOIN near USING (g, s, t, far)),
 raw AS (SELECT a.g, a.t v, sum(a.n * b.n / c.n) b FROM sp a JOIN sp b ON b.g = a.g AND b.s = a.t JOIN sp c ON c.g = a.g AND c.s = a.s AND c.t = b.t AND c.far = a.far + b.far WHERE a.t <> a.s AND b.t <> a.t AND b.t <> a.s GROUP BY ALL)
 SELECT n.graph_id, id AS node, round(coalesce(b / max(b) OVER (PARTITION BY n.graph_id), 0), 6) betweenness FROM n LEFT JOIN raw ON g = n.graph_id AND v = id"""


@query(_BETWEEN)
def import_betweenness(spark: SparkSession, d: str) -> DataFrame:
    """Betweenness of files in their repository's import graph, all sources."""
    return G.betweenness_by_source(import_graph(spark, d)).withColumn("betweenness", F.round("betweenness", 6))


@query()
def sampled_betweenness(spark: SparkSession, d: str) -> DataFrame:
    """The same from sampled sources, stratified by folder; graphs of up to fifty files are exact."""
    e = import_graph(spark, d)
    folder = e.select("graph_id", F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("community", directory(F.col("node")))
    return G.betweenness_sampled(e, folder).withColumn("betweenness", F.round("betweenness", 6))
