"""Queries over the trade graph and other stand-ins for dependency graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import edges as E
from ..operators import graph as G
from ..operators import layers as L
from ..operators import traversal as T
from ..shared import latest_by
from ..shared import table as t
from .inputs import TRADE, VOLUMES, trade_graph, trade_volumes
from .registry import query

_ROUNDS = 30


def _hits_sql(edges: str, weight: str, rounds: int = _ROUNDS, every_round: bool = False) -> str:
    """HITS as a chain of common table expressions, one per round; ``edges`` defines edges(src, dst, ...) and nodes(id)."""
    scale = (lambda x: f"({x} - min({x}) OVER ()) / (max({x}) OVER () - min({x}) OVER ())") if every_round else (lambda x: f"{x} / sqrt(sum({x} * {x}) OVER ())")
    steps = ["s0 AS (SELECT id, 1.0::DOUBLE a, 1.0::DOUBLE h FROM nodes)"]
    for i in range(rounds):
        steps.append(f"""s{i + 1} AS MATERIALIZED (SELECT id, {scale('na')} a, {scale('nh')} h FROM (SELECT id,
          0.15 / (SELECT count(*) FROM nodes) + 0.85 * coalesce((SELECT sum(h * {weight}) FROM edges JOIN s{i} p ON p.id = src WHERE dst = n.id), 0) na,
          0.15 / (SELECT count(*) FROM nodes) + 0.85 * coalesce((SELECT sum(a * {weight}) FROM edges JOIN s{i} p ON p.id = dst WHERE src = n.id), 0) nh FROM nodes n))""")
    last = f"scored AS (SELECT id node, (a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ()) authority, (h - min(h) OVER ()) / (max(h) OVER () - min(h) OVER ()) hub FROM s{rounds})"
    return f"WITH {edges}, {', '.join(steps)}, {last}"


_ROLE = "CASE WHEN authority > 0.6 AND hub < 0.3 THEN 'Foundation' WHEN hub > 0.6 AND authority < 0.3 THEN 'Orchestrator' WHEN authority > 0.3 AND hub > 0.3 THEN 'Bridge' WHEN authority BETWEEN 0.1 AND 0.6 AND hub < 0.1 THEN 'Utility' ELSE 'Leaf' END"


def _unweighted(spark: SparkSession, d: str) -> DataFrame:
    return trade_graph(spark, d).select("graph_id", "src", "dst", F.lit(1.0).alias("weight"))


def _nodes(edges: DataFrame) -> DataFrame:
    return edges.select("graph_id", F.explode(F.array("src", "dst")).alias("node")).distinct()


def _round(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(f"WITH {TRADE} SELECT src, dst, revenue, round(weight, 6) weight FROM edges")
def trade_edges(spark: SparkSession, d: str) -> DataFrame:
    """The trade graph itself."""
    return _round(trade_graph(spark, d).select("src", "dst", "revenue", "weight"), 6, "weight")


@query("SELECT 'x' graph_id, l_suppkey src, l_returnflag dst, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS names, bool_and(l_tax < 0.01) is_type_only FROM lineitem GROUP BY ALL")
def edge_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Supplier to return flag, names the line states."""
    e = t(spark, d, "lineitem").select(F.lit("x").alias("graph_id"), F.col("l_suppkey").alias("src"), F.col("l_returnflag").alias("dst"), F.array("l_linestatus").alias("names"), (F.col("l_tax") < 0.01).alias("is_type_only"))
    return E.dedup(e).withColumn("names", F.array_join("names", ","))


@query(f"WITH {TRADE} SELECT id AS node, (SELECT count(*) FROM edges WHERE dst = id) in_degree, (SELECT count(*) FROM edges WHERE src = id) out_degree FROM nodes")
def degree_counts(spark: SparkSession, d: str) -> DataFrame:
    """In- and out-degree."""
    return E.degrees(trade_graph(spark, d)).select("node", "in_degree", "out_degree")


@query(_hits_sql(TRADE, "1") + " SELECT node, round(authority, 4) authority, round(hub, 4) hub FROM scored")
def hits_trade(spark: SparkSession, d: str) -> DataFrame:
    """Hubs and authorities, unweighted, 30 rounds."""
    return _round(G.hits(_unweighted(spark, d), _ROUNDS, 0.0).drop("graph_id"), 4, "authority", "hub")


@query(_hits_sql(TRADE, "1", 4) + " SELECT node, round(authority, 4) authority, round(hub, 4) hub FROM scored")
def hits_rounds(spark: SparkSession, d: str) -> DataFrame:
    """The same by relational rounds, as for graphs too large for a task; 4 rounds."""
    return _round(G.hits_rounds(_unweighted(spark, d), 4, 0.0).drop("graph_id"), 4, "authority", "hub")


@query(_hits_sql(TRADE, "1") + f" SELECT node, {_ROLE} AS \"role\" FROM (SELECT node, round(authority, 4) authority, round(hub, 4) hub FROM scored)")
def roles_trade(spark: SparkSession, d: str) -> DataFrame:
    """Roles by hub and authority scores."""
    s = _round(G.hits(_unweighted(spark, d), _ROUNDS, 0.0), 4, "authority", "hub")
    return s.select("node", G.role(F.col("authority"), F.col("hub")).alias("role"))


_BRANDS = "edges AS (SELECT s_nationkey::VARCHAR || 's' src, p_brand dst, count(DISTINCT p_size % 7) k FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY ALL), nodes AS (SELECT src id FROM edges UNION SELECT dst FROM edges)"


def _brands(spark: SparkSession, d: str) -> DataFrame:
    part = t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("dst"), (F.col("p_size") % 7).alias("name"))
    sup = t(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.concat(F.col("s_nationkey").cast("string"), F.lit("s")).alias("src"))
    line = t(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    return line.join(part, "l_partkey").join(sup, "l_suppkey").select(F.lit("brands").alias("graph_id"), "src", "dst", "name")


@query(_hits_sql(_BRANDS, "greatest(0.2, log2(k + 1) / log2(6))", 10) + " SELECT node, round(authority, 3) authority, round(hub, 3) hub FROM scored")
def weighted_hits(spark: SparkSession, d: str) -> DataFrame:
    """Hub scores of nations to brands with weights by the number of names."""
    e = _brands(spark, d).groupBy("graph_id", "src", "dst").agg(F.collect_set("name").alias("names"))
    no = F.lit(False)
    e = e.withColumn("weight", G.edge_weight(F.col("names").cast("array<string>"), no, no, no, no))
    return _round(G.hits(e.select("graph_id", "src", "dst", "weight"), 10, 0.0).drop("graph_id"), 3, "authority", "hub")


@query(f"WITH {VOLUMES}, x AS (SELECT src, dst, orders % 2 = 0 weak FROM volumes), ends AS (SELECT dst id, CASE WHEN weak THEN 0.3::DOUBLE ELSE 1 END i, 0 o FROM x UNION ALL SELECT src, 0, CASE WHEN weak THEN 0.3::DOUBLE ELSE 1 END FROM x) SELECT id::VARCHAR node, round(sum(o) / (sum(i) + sum(o)), 6) instability FROM ends GROUP BY id")
def instability(spark: SparkSession, d: str) -> DataFrame:
    """Instability of nations; pairs with an even number of orders count as type-only."""
    e = trade_volumes(spark, d).select(F.lit("v").alias("graph_id"), F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), (F.col("orders") % 2 == 0).alias("is_type_only"))
    return _round(E.instability(e).select("node", "instability"), 6, "instability")


@query("SELECT * FROM (SELECT o_custkey src, l_suppkey dst, count(DISTINCT p_brand) AS names FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL HAVING count(DISTINCT p_brand) >= 3) ORDER BY names DESC, src, dst LIMIT 10")
def tight_coupling(spark: SparkSession, d: str) -> DataFrame:
    """Customers and suppliers with the most brands between them."""
    part = t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("name"))
    e = t(spark, d, "lineitem").join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_partkey", F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst")).join(part, "l_partkey")
    return E.tight_coupling(e.withColumn("graph_id", F.lit("x")), least=3).drop("graph_id")


@query("SELECT p_partkey dst, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) layers, count(DISTINCT c_mktsegment) spread FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey GROUP BY 1 HAVING count(DISTINCT c_mktsegment) >= 3")
def cross_cutting(spark: SparkSession, d: str) -> DataFrame:
    """Parts bought from at least three market segments."""
    e = t(spark, d, "lineitem").join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.lit("x").alias("graph_id"), F.col("o_custkey").alias("src"), F.col("l_partkey").alias("dst"))
    layers = t(spark, d, "customer").select(F.lit("x").alias("graph_id"), F.col("c_custkey").alias("node"), F.col("c_mktsegment").alias("layer"))
    return E.cross_cutting(e.join(t(spark, d, "part").select(F.col("p_partkey").alias("dst")), "dst", "left_semi"), layers).drop("graph_id")


@query("SELECT DISTINCT l_suppkey node, l_shipdate::DATE::VARCHAR AS name FROM lineitem")
def used_exports(spark: SparkSession, d: str) -> DataFrame:
    """Names (dates) by which suppliers are used."""
    e = t(spark, d, "lineitem").select(F.lit("x").alias("graph_id"), F.col("l_orderkey").alias("src"), F.col("l_suppkey").alias("dst"), F.array(F.to_date("l_shipdate").cast("string")).alias("names"), F.lit(False).alias("is_barrel_routed"))
    return E.used_exports(e).select("node", "name")


@query("SELECT p_partkey::VARCHAR node FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 45)")
def dead_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Parts never ordered in large numbers."""
    nodes = t(spark, d, "part").select(F.lit("x").alias("graph_id"), F.col("p_partkey").cast("string").alias("node"), F.lit(False).alias("is_barrel"))
    e = t(spark, d, "lineitem").where("l_quantity >= 45").select(F.lit("x").alias("graph_id"), F.col("l_orderkey").alias("src"), F.col("l_partkey").cast("string").alias("dst"))
    return E.dead_nodes(nodes, e).select("node")


_FILES = "f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY updated_at DESC NULLS LAST) rn FROM files WHERE path IS NOT NULL) WHERE rn = 1)"


def _files(spark: SparkSession, d: str) -> DataFrame:
    f = t(spark, d, "files").where("path IS NOT NULL")
    return latest_by(f.select("path", "graph_id", "layer", "role", "community_id", "has_tests", "authority", "betweenness", "updated_at"), ["path"], ["updated_at"])


_PATTERNS = " ".join(f"WHEN regexp_matches(path, '{p}') THEN '{n}'" for n, p in L.LAYERS)


@query(f"WITH {_FILES} SELECT path, CASE {_PATTERNS} END layer FROM f")
def layers(spark: SparkSession, d: str) -> DataFrame:
    """Layer of every file by its path."""
    return _files(spark, d).select("path", L.layer_of(F.col("path")).alias("layer"))


_SEG = f"{VOLUMES}, e AS (SELECT src, dst, a.n_regionkey ra, b.n_regionkey rb FROM volumes JOIN nation a ON src = a.n_nationkey JOIN nation b ON dst = b.n_nationkey), x AS (SELECT r.r_name from_layer, q.r_name to_layer, ra, rb, count(*) edges, count(DISTINCT src) sources FROM e JOIN region r ON ra = r.r_regionkey JOIN region q ON rb = q.r_regionkey WHERE ra <> rb GROUP BY ALL)"


def _volume_edges(spark: SparkSession, d: str) -> DataFrame:
    return trade_volumes(spark, d).select(F.lit("v").alias("graph_id"), "src", "dst")


def _regions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n, r = t(spark, d, "nation"), t(spark, d, "region")
    layer = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.lit("v").alias("graph_id"), F.col("n_nationkey").alias("node"), F.col("r_name").alias("layer"))
    return layer, r.select(F.col("r_name").alias("layer"), F.col("r_regionkey").alias("rank"))


@query(f"WITH {_SEG} SELECT from_layer, to_layer, edges, sources FROM x")
def layer_edges(spark: SparkSession, d: str) -> DataFrame:
    """Trade between regions as edges between layers."""
    return L.layer_edges(_volume_edges(spark, d), _regions(spark, d)[0]).drop("graph_id")


@query(f"WITH {_SEG} SELECT round(sum(CASE WHEN ra > rb THEN edges * (ra - rb) ELSE 0 END) / sum(edges * abs(ra - rb)), 6) consistency, sum(CASE WHEN ra < rb THEN edges ELSE 0 END)::BIGINT violations FROM x")
def layer_consistency(spark: SparkSession, d: str) -> DataFrame:
    """Share of regional trade that points down, regions ranked by key."""
    layer, ranks = _regions(spark, d)
    return _round(L.layer_consistency(L.layer_edges(_volume_edges(spark, d), layer), ranks).drop("graph_id"), 6, "consistency")


@query(f"WITH {_SEG}, rules AS (SELECT CASE WHEN ra < rb THEN 'upward dependency' WHEN ra - rb > 2 THEN 'layer skip' END \"rule\", src::VARCHAR src, dst::VARCHAR dst FROM e) SELECT \"rule\", src, dst, n FROM (SELECT *, row_number() OVER (ORDER BY \"rule\", src, dst) n FROM rules WHERE \"rule\" IS NOT NULL) WHERE n <= 20")
def fitness_rules(spark: SparkSession, d: str) -> DataFrame:
    """First twenty violations of the layer rules."""
    layer, ranks = _regions(spark, d)
    e = _volume_edges(spark, d).select("graph_id", F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
    return L.fitness(e, layer.withColumn("node", F.col("node").cast("string")), ranks).drop("graph_id")


_UND = f"{TRADE}, lab AS (SELECT n_nationkey::VARCHAR id, n_regionkey lab FROM nation), und AS (SELECT src a, dst b FROM edges UNION ALL SELECT dst, src FROM edges)"


@query(f"WITH {_UND}, per AS (SELECT x.lab, sum((x.lab = y.lab)::INT) inn, count(*) deg FROM und JOIN lab x ON a = x.id JOIN lab y ON b = y.id GROUP BY 1), m AS (SELECT sum(deg) m2 FROM per) SELECT round(sum(inn / m2 - pow(deg / m2, 2)), 6) q FROM per, m")
def modularity(spark: SparkSession, d: str) -> DataFrame:
    """Modularity of the trade graph by region."""
    labels = t(spark, d, "nation").select(F.lit("trade").alias("graph_id"), F.col("n_nationkey").cast("string").alias("node"), F.col("n_regionkey").alias("label"))
    return _round(L.modularity(_unweighted(spark, d), labels).drop("graph_id"), 6, "q")


@query(f"WITH {_UND}, p AS (SELECT DISTINCT least(a, b) a, greatest(a, b) b FROM und WHERE a <> b), i AS (SELECT x.lab, count(*) n FROM p JOIN lab x ON a = x.id JOIN lab y ON b = y.id WHERE x.lab = y.lab GROUP BY 1), s AS (SELECT lab, count(*) n FROM lab GROUP BY 1) SELECT s.lab AS label, s.n nodes, round(coalesce(i.n, 0) / (s.n * (s.n - 1) / 2), 6) cohesion FROM s LEFT JOIN i USING (lab)")
def cohesion(spark: SparkSession, d: str) -> DataFrame:
    """Internal density of regions."""
    labels = t(spark, d, "nation").select(F.lit("trade").alias("graph_id"), F.col("n_nationkey").cast("string").alias("node"), F.col("n_regionkey").alias("label"))
    return _round(L.cohesion(_unweighted(spark, d), labels).drop("graph_id"), 6, "cohesion")


@query(f"""WITH {_FILES}, x AS (SELECT graph_id, coalesce(layer, '') a, coalesce(community_id, -1) b FROM f), c AS (SELECT graph_id, a, b, count(*) n FROM x GROUP BY ALL),
  s AS (SELECT graph_id, sum(n * (n - 1) / 2) s, sum(n) n FROM c GROUP BY 1), sa AS (SELECT graph_id, sum(n * (n - 1) / 2) s FROM (SELECT graph_id, a, sum(n) n FROM c GROUP BY ALL) GROUP BY 1), sb AS (SELECT graph_id, sum(n * (n - 1) / 2) s FROM (SELECT graph_id, b, sum(n) n FROM c GROUP BY ALL) GROUP BY 1)
  SELECT graph_id, round((s.s - sa.s * sb.s / (n * (n - 1) / 2)) / ((sa.s + sb.s) / 2 - sa.s * sb.s / (n * (n - 1) / 2)), 6) ari FROM s JOIN sa USING (graph_id) JOIN sb USING (graph_id)""")
def ari(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of layers and communities of the files of each repository."""
    x = _files(spark, d).select("graph_id", F.coalesce("layer", F.lit("")).alias("a"), F.coalesce("community_id", F.lit(-1)).alias("b"))
    return _round(L.rand_index(x, "a", "b"), 6, "ari")


_STYLE = """CASE WHEN regexp_matches(name, '^[a-z]+[0-9]*$') THEN 'lowercase' WHEN regexp_matches(name, '^[a-z][a-z0-9]*([A-Z][a-z0-9]*)+$') THEN 'camelCase' WHEN regexp_matches(name, '^([A-Z][a-z0-9]*)+$') AND regexp_matches(name, '[a-z]') THEN 'PascalCase'
 WHEN regexp_matches(name, '^[a-z0-9]+(_[a-z0-9]+)+$') THEN 'snake_case' WHEN regexp_matches(name, '^[A-Z0-9]+(_[A-Z0-9]+)*$') THEN 'UPPER_CASE' WHEN regexp_matches(name, '^[a-z0-9]+(-[a-z0-9]+)+$') THEN 'kebab-case' WHEN name IS NOT NULL THEN 'other' END"""


@query(f"""WITH v AS (SELECT graph_id, kind, {_STYLE} s FROM symbols), c AS (SELECT graph_id, kind, s, count(*) n FROM v WHERE s IS NOT NULL GROUP BY ALL), r AS (SELECT *, sum(n) OVER w votes, row_number() OVER (PARTITION BY graph_id, kind ORDER BY n DESC, s) rn FROM c WINDOW w AS (PARTITION BY graph_id, kind))
  SELECT graph_id, kind, votes::BIGINT votes, CASE WHEN n / votes >= 0.6 THEN s ELSE 'mixed' END style, round(n / votes, 6) AS share FROM r WHERE rn = 1""")
def majority_style(spark: SparkSession, d: str) -> DataFrame:
    """Naming style of each kind of symbol in each repository."""
    v = t(spark, d, "symbols").select("graph_id", "kind", L.name_style(F.col("name")).alias("s"))
    return _round(L.majority(v, ["graph_id", "kind"], "s"), 6, "share")


_BACK = f"{TRADE}, h1 AS (SELECT DISTINCT dst start, src node FROM edges), h2 AS (SELECT DISTINCT h1.start, e.src node FROM h1 JOIN edges e ON e.dst = h1.node), h3 AS (SELECT DISTINCT h2.start, e.src node FROM h2 JOIN edges e ON e.dst = h2.node), h4 AS (SELECT DISTINCT h3.start, e.src node FROM h3 JOIN edges e ON e.dst = h3.node), h5 AS (SELECT DISTINCT h4.start, e.src node FROM h4 JOIN edges e ON e.dst = h4.node)"


@query(f"WITH {_BACK} SELECT h1.start AS start, node, 'will break' effect FROM h1 WHERE node <> start UNION ALL SELECT h2.start, node, 'likely' FROM h2 WHERE node <> start AND NOT EXISTS (SELECT 1 FROM h1 WHERE h1.start = h2.start AND h1.node = h2.node)")
def impact_two_hop(spark: SparkSession, d: str) -> DataFrame:
    """Who breaks if a nation changes."""
    return T.impact(trade_graph(spark, d).withColumn("is_type_only", F.lit(False))).select("start", "node", "effect")


@query(f"WITH {_BACK}, every AS (" + " UNION ALL ".join(f"SELECT start, node, {k} depth FROM h{k}" for k in range(1, 6)) + """), s AS (SELECT id, count(src) authority FROM nodes LEFT JOIN edges ON dst = id GROUP BY 1)
  SELECT start, node, depth, rank, CASE depth WHEN 1 THEN 'DIRECT' WHEN 2 THEN 'TRANSITIVE' ELSE 'DISTANT' END tag FROM (SELECT every.*, row_number() OVER (PARTITION BY start, depth ORDER BY authority DESC NULLS LAST, node) rank FROM every LEFT JOIN s ON s.id = node) WHERE rank <= 4""")
def callers_5(spark: SparkSession, d: str) -> DataFrame:
    """Callers to depth 5, the four with most importers at each depth."""
    e = trade_graph(spark, d)
    score = E.degrees(e).select("graph_id", "node", F.col("in_degree").alias("authority"))
    return T.callers(e, score).select("start", "node", "depth", "rank", "tag")


@query(f"""WITH {TRADE}, k AS (SELECT src, dst, CASE WHEN src::INT % 3 = 0 THEN 'uses_type' WHEN src::INT % 3 = 1 THEN 'calls' ELSE 'extends' END kind, CASE WHEN src::INT % 5 = 0 THEN 0.4::DOUBLE ELSE 0.9 END conf FROM edges),
  ch AS (SELECT id start, CASE WHEN id::INT % 2 = 0 THEN 'delete' ELSE 'signature' END change FROM nodes), strong AS (SELECT * FROM k WHERE kind IN ('calls', 'extends')),
  l1 AS (SELECT start, change, src node, kind, conf, 1 depth FROM ch JOIN k ON dst = start), l2 AS (SELECT start, change, src node, strong.kind, strong.conf, 2 depth FROM (SELECT DISTINCT start, change, node FROM l1) JOIN strong ON dst = node),
  l3 AS (SELECT start, change, src node, strong.kind, strong.conf, 3 depth FROM (SELECT DISTINCT start, change, node FROM l2) JOIN strong ON dst = node),
  m AS (SELECT start, change, node, kind, min(depth) depth, min(conf) conf FROM (FROM l1 UNION ALL FROM l2 UNION ALL FROM l3) WHERE node <> start GROUP BY ALL)
  SELECT start, change, node, kind, depth, CASE WHEN conf < 0.5 THEN 'UNKNOWN' WHEN depth > 1 AND change <> 'delete' THEN 'UNKNOWN' WHEN change = 'delete' OR kind IN ('calls', 'extends') THEN 'BREAKING' WHEN kind = 'uses_type' THEN 'UNKNOWN' ELSE 'COMPATIBLE' END verdict FROM m""")
def safe_change(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts on deleting or changing each nation."""
    n = F.col("src").cast("int")
    kind = F.when(n % 3 == 0, "uses_type").when(n % 3 == 1, "calls").otherwise("extends")
    e = trade_graph(spark, d).select("graph_id", "src", "dst", kind.alias("kind"), F.when(n % 5 == 0, 0.4).otherwise(0.9).alias("confidence"))
    ch = _nodes(e).withColumn("change", F.when(F.col("node").cast("int") % 2 == 0, "delete").otherwise("signature"))
    return T.safe_change(e, ch).select("start", "change", "node", "kind", "depth", "verdict")


_CLOSED = f"{TRADE}, r AS (SELECT src s, dst t FROM edges UNION SELECT r.s, e.dst FROM r JOIN edges e ON e.src = r.t)"


@query(f"WITH RECURSIVE {_CLOSED} SELECT s AS start, t AS node FROM r")
def reachability(spark: SparkSession, d: str) -> DataFrame:
    """Which nation's revenue reaches which, by path doubling."""
    return T.reach(trade_graph(spark, d)).select("start", "node")


@query(f"WITH RECURSIVE {_CLOSED} SELECT id AS node, (SELECT count(*) FROM r WHERE t = id AND s <> id) upstream, (SELECT count(*) FROM r WHERE s = id AND t <> id) downstream FROM nodes WHERE EXISTS (SELECT 1 FROM edges WHERE dst = id) AND upstream >= greatest(2, ceil(sqrt((SELECT count(*) FROM nodes)))) AND downstream >= 1")
def chokepoints(spark: SparkSession, d: str) -> DataFrame:
    """Nations through which much flows."""
    return G.chokepoints(trade_graph(spark, d)).drop("graph_id").select("node", F.col("upstream").cast("bigint").alias("upstream"), F.col("downstream").cast("bigint").alias("downstream"))


@query(f"WITH RECURSIVE {_CLOSED}, p AS (SELECT id, coalesce((SELECT least(id, min(x.t)) FROM r x JOIN r y ON y.s = x.t AND y.t = x.s WHERE x.s = id), id) c FROM nodes) SELECT id AS node, c AS component, count(*) OVER (PARTITION BY c) AS size FROM p")
def scc(spark: SparkSession, d: str) -> DataFrame:
    """Strong components."""
    return G.strong_components(trade_graph(spark, d)).drop("graph_id")


@query(f"WITH {TRADE} SELECT x.src a, x.dst b FROM edges x JOIN edges y ON x.src = y.dst AND x.dst = y.src WHERE x.src < x.dst")
def two_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Nations that trade both ways."""
    return T.two_cycles(trade_graph(spark, d)).select("a", "b")


@query()
def cycle_report(spark: SparkSession, d: str) -> DataFrame:
    """Short cycles."""
    return G.cycle_report(trade_graph(spark, d))


def _components_sql(rounds: int = 12) -> str:
    """Least label of the neighbourhood, round by round; the supplier-part graph is settled long before the last one."""
    steps = ["l0 AS (SELECT DISTINCT x id, x c FROM u)"]
    for i in range(rounds):
        steps.append(f"l{i + 1} AS MATERIALIZED (SELECT l.id, least(l.c, min(n.c)) c FROM l{i} l JOIN u ON u.x = l.id JOIN l{i} n ON n.id = u.y GROUP BY l.id, l.c)")
    return f"WITH b AS (SELECT DISTINCT 's' || l_suppkey s, 'p' || l_partkey p FROM lineitem), u AS (SELECT s x, p y FROM b UNION ALL SELECT p, s FROM b), {', '.join(steps)} SELECT id AS node, c AS component FROM l{rounds}"


@query(_components_sql())
def components(spark: SparkSession, d: str) -> DataFrame:
    """Connected suppliers and parts."""
    e = t(spark, d, "lineitem").select(F.lit("x").alias("graph_id"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey")).alias("dst"))
    return T.components(e, _nodes(e)).select("node", "component")


@query(f"WITH RECURSIVE {TRADE}, u AS (SELECT src x, dst y FROM edges UNION SELECT dst, src FROM edges), r AS (SELECT x s, x t FROM u UNION SELECT r.s, u.y FROM r JOIN u ON u.x = r.t), c AS (SELECT s, min(t) c FROM r GROUP BY 1), z AS (SELECT c, count(*) n FROM c GROUP BY 1) SELECT count(*)::INT components, max(n)::INT largest, coalesce((SELECT n FROM z ORDER BY n DESC, c LIMIT 1 OFFSET 1), 0)::INT AS second FROM z")
def topology(spark: SparkSession, d: str) -> DataFrame:
    """Number and sizes of weak components."""
    return G.topology(trade_graph(spark, d)).select("components", "largest", "second")


@query(f"""WITH RECURSIVE {TRADE}, u AS (SELECT src x, dst y FROM edges UNION SELECT dst, src FROM edges), walk(s, t, far) AS (SELECT id, id, 0 FROM nodes UNION SELECT s, y, far + 1 FROM walk JOIN u ON x = t WHERE far < 25),
  dist AS (SELECT s, t, min(far) far FROM walk GROUP BY ALL), c AS (SELECT s, min(t) c, count(*) n FROM dist GROUP BY 1), z AS (SELECT c, max(n) n FROM c GROUP BY 1), one AS (SELECT c FROM z ORDER BY n DESC, c LIMIT 1),
  far AS (SELECT t FROM dist, one WHERE s = c ORDER BY far DESC, t LIMIT 1), k AS (SELECT count(*) n FROM nodes)
  SELECT 'trade' graph_id, (SELECT max(far) FROM dist WHERE s = (SELECT t FROM far))::INT diameter, round((SELECT sum(n * (n - 1)) FROM z) / (SELECT n * (n - 1) FROM k), 6) reachable, coalesce((SELECT n FROM z ORDER BY n DESC, c LIMIT 1 OFFSET 1), 0) >= 5 fragmented""")
def diameter(spark: SparkSession, d: str) -> DataFrame:
    """Diameter by double sweep, reach and fragmentation."""
    return _round(G.topology(trade_graph(spark, d)).select("graph_id", "diameter", "reachable", "fragmented"), 6, "reachable")


@query(f"""WITH RECURSIVE {_CLOSED}, p AS (SELECT id, coalesce((SELECT least(id, min(x.t)) FROM r x JOIN r y ON y.s = x.t AND y.t = x.s WHERE x.s = id), id) c FROM nodes),
  k AS (SELECT DISTINCT a.c x, b.c y FROM edges JOIN p a ON a.id = src JOIN p b ON b.id = dst WHERE a.c <> b.c), path(l) AS (SELECT DISTINCT [c] FROM p UNION ALL SELECT list_append(l, y) FROM path JOIN k ON x = l[-1]),
  best AS (SELECT l FROM path ORDER BY len(l) DESC, l LIMIT 1) SELECT 'trade' graph_id, (i - 1)::INT place, l[i] node FROM best, generate_series(1, 25) g(i) WHERE i <= len(l)""")
def critical_chain(spark: SparkSession, d: str) -> DataFrame:
    """Longest chain of strong components."""
    return G.critical_chain(trade_graph(spark, d))


_BETWEEN = f"""WITH RECURSIVE {TRADE}, walk(s, t, far, n) AS (SELECT id, id, 0, 1::DOUBLE FROM nodes UNION ALL
   SELECT s, dst, far + 1, sum(n)::DOUBLE FROM walk JOIN edges ON src = t WHERE far < 25 GROUP BY s, dst, far + 1),
 near AS (SELECT s, t, min(far) far FROM walk GROUP BY ALL), sp AS (SELECT walk.s, walk.t, walk.far, walk.n FROM walk JOIN near USING (s, t, far)),
 raw AS (SELECT a.t v, sum(a.n * b.n / c.n) b FROM sp a JOIN sp b ON b.s = a.t JOIN sp c ON c.s = a.s AND c.t = b.t AND c.far = a.far + b.far WHERE a.t <> a.s AND b.t <> a.t AND b.t <> a.s GROUP BY 1)
 SELECT id AS node, round(coalesce(b, 0) / (SELECT max(b) FROM raw), 6) betweenness FROM nodes LEFT JOIN raw ON v = id"""


@query(_BETWEEN)
def betweenness_exact(spark: SparkSession, d: str) -> DataFrame:
    """Betweenness over all sources."""
    return _round(G.betweenness(trade_graph(spark, d)).drop("graph_id"), 6, "betweenness")


@query(_BETWEEN)
def betweenness_by_source(spark: SparkSession, d: str) -> DataFrame:
    """The same with sources dealt out over tasks."""
    return _round(G.betweenness_by_source(trade_graph(spark, d)).drop("graph_id"), 6, "betweenness")


def _katz_sql() -> str:
    power = ["v0 AS (SELECT id, 1 / sqrt((SELECT count(*) FROM nodes)) x FROM nodes)"]
    for i in range(10):
        power.append(f"y{i} AS MATERIALIZED (SELECT n.id, coalesce((SELECT sum(p.x * weight) FROM edges JOIN v{i} p ON p.id = src WHERE dst = n.id), 0) x FROM nodes n), v{i + 1} AS MATERIALIZED (SELECT id, x / (SELECT sqrt(sum(x * x)) FROM y{i}) x FROM y{i})")
    walk = ["k0 AS (SELECT id, CASE id WHEN '1' THEN 1.0::DOUBLE WHEN '2' THEN 0.5 ELSE 0 END s, CASE id WHEN '1' THEN 1.0::DOUBLE WHEN '2' THEN 0.5 ELSE 0 END x FROM nodes)"]
    for i in range(15):
        walk.append(f"k{i + 1} AS MATERIALIZED (SELECT n.id, n.s, n.s + 0.85 / (SELECT sqrt(sum(x * x)) FROM y9) * coalesce((SELECT sum(p.x * weight) FROM edges JOIN k{i} p ON p.id = src WHERE dst = n.id), 0) x FROM k0 n)")
    return f"WITH {TRADE}, {', '.join(power)}, {', '.join(walk)} SELECT id AS node, round(x / (SELECT max(x) FROM k15), 4) score FROM k15 WHERE x / (SELECT max(x) FROM k15) >= 1e-4"


@query(_katz_sql())
def katz(spark: SparkSession, d: str) -> DataFrame:
    """Spread from two nations, weighted by revenue share, 15 rounds."""
    return _round(G.katz(trade_graph(spark, d), {"1": 1.0, "2": 0.5}, 15, 0.0).drop("graph_id"), 4, "score")


def _flow_sql(steps: int = 12) -> str:
    ends = "('3', '5')"
    rows = ["m0 AS (SELECT id, CASE id WHEN '1' THEN 1.0::DOUBLE ELSE 0 END x FROM nodes)"]
    for i in range(steps):
        rows.append(f"m{i + 1} AS MATERIALIZED (SELECT n.id, coalesce((SELECT sum(p.x * weight) FROM edges JOIN m{i} p ON p.id = src WHERE dst = n.id AND p.id NOT IN {ends}), 0) x FROM nodes n)")
    total = " UNION ALL ".join(f"SELECT id, x, {i} i FROM m{i}" for i in range(steps + 1))
    return f"WITH {TRADE}, {', '.join(rows)}, z AS ({total}) SELECT id AS node, round(sum(x), 4) visits, round(sum(CASE WHEN id IN {ends} THEN x ELSE 0 END), 4) absorbed FROM z GROUP BY 1 HAVING sum(x) > 0"


@query(_flow_sql())
def markov_flow(spark: SparkSession, d: str) -> DataFrame:
    """Flow of a unit from one nation until two others absorb it, 12 steps."""
    f = G.absorbing_flow(trade_graph(spark, d), "1", ["3", "5"], 12, 0.0).where("visits > 0")
    return _round(f.drop("graph_id"), 4, "visits", "absorbed")


@query(f"WITH {TRADE}, s AS (SELECT id, CASE WHEN NOT EXISTS (SELECT 1 FROM edges WHERE dst = id) THEN 0.3 ELSE 0 END + CASE WHEN id::INT % 4 = 0 THEN 0.3 ELSE 0 END + CASE WHEN id::INT % 5 = 0 THEN 0.2 * 0.75 ELSE 0 END score FROM nodes) SELECT id AS node, round(score::DOUBLE, 6) score FROM s WHERE score >= 0.3")
def entry_points(spark: SparkSession, d: str) -> DataFrame:
    """Entry points; nations divisible by 4 are routes, by 5 hubs."""
    e = trade_graph(spark, d)
    n = F.col("node").cast("int")
    return _round(T.entry_points(e, _nodes(e).withColumns({"hub": F.when(n % 5 == 0, 0.75).otherwise(0.1), "is_route": n % 4 == 0})).drop("graph_id"), 6, "score")


@query(f"WITH {TRADE} SELECT id AS node FROM nodes WHERE NOT EXISTS (SELECT 1 FROM edges WHERE src = id AND dst::INT % 2 = 0)")
def terminals(spark: SparkSession, d: str) -> DataFrame:
    """Nations with no flow to even ones (odd ones are another package)."""
    e = trade_graph(spark, d).withColumn("cross_package", F.col("dst").cast("int") % 2 == 1)
    return T.terminals(e, _nodes(e)).select("node")


@query(f"""WITH RECURSIVE {TRADE}, w(gone, t) AS (SELECT id, '1' FROM nodes WHERE id <> '1' UNION SELECT gone, dst FROM w JOIN edges ON src = t WHERE dst <> gone), r(t) AS (SELECT '1' UNION SELECT dst FROM r JOIN edges ON src = r.t),
  dom AS (SELECT r.t v, nodes.id d FROM r, nodes WHERE r.t <> '1' AND nodes.id <> r.t AND (nodes.id = '1' OR NOT EXISTS (SELECT 1 FROM w WHERE gone = nodes.id AND w.t = r.t))),
  n AS (SELECT v, count(*) k FROM dom GROUP BY 1), near AS (SELECT dom.v, d, row_number() OVER (PARTITION BY dom.v ORDER BY coalesce(k, 0) DESC, d) rn FROM dom LEFT JOIN n ON n.v = d)
  SELECT 'trade' graph_id, v AS node, d AS dominator FROM near WHERE rn = 1 UNION ALL SELECT 'trade', '1', '1'""")
def dominators(spark: SparkSession, d: str) -> DataFrame:
    """Immediate dominators from nation 1."""
    return G.dominators(trade_graph(spark, d), "1")


@query()
def k_paths(spark: SparkSession, d: str) -> DataFrame:
    """Unlike paths from nation 1 to nation 2."""
    return _round(G.diverse_paths(trade_graph(spark, d), "1", "2"), 6, "cost")


@query()
def leiden(spark: SparkSession, d: str) -> DataFrame:
    """Communities, starting from single nations."""
    return G.communities(_unweighted(spark, d), lambda name: name)


@query()
def feedback_arcs(spark: SparkSession, d: str) -> DataFrame:
    """Edges that close cycles."""
    return G.feedback_arcs(trade_graph(spark, d))


@query(f"WITH {TRADE}, h1 AS (SELECT src start, dst node FROM edges), h2 AS (SELECT start, dst FROM h1 JOIN edges ON src = node), h3 AS (SELECT start, dst FROM h2 JOIN edges ON src = h2.dst), a AS (FROM h1 UNION FROM h2 UNION FROM (SELECT start, dst FROM (SELECT h2.start, edges.dst FROM h2 JOIN edges ON edges.src = h2.dst))) SELECT start, count(*) covered FROM a GROUP BY 1")
def transitive_cover(spark: SparkSession, d: str) -> DataFrame:
    """How many nations each one covers in three hops."""
    e = trade_graph(spark, d)
    starts = _nodes(e).select("graph_id", F.col("node").alias("start"))
    return T.cover(e, starts).select("start", "covered")


@query(f"WITH {_FILES}, p AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') package FROM f WHERE path LIKE '%/src/%/%'), x AS (SELECT path, package, row_number() OVER (PARTITION BY path ORDER BY length(package) DESC) rn FROM f JOIN p ON starts_with(path, package || '/')) SELECT f.path, x.package FROM f LEFT JOIN x ON x.path = f.path AND x.rn = 1")
def longest_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Package directory of each file."""
    f = _files(spark, d).select("path")
    packages = f.where(F.col("path").like("%/src/%/%")).select(F.regexp_replace("path", "/[^/]*$", "").alias("package"))
    return T.package_of(f, packages)


@query(f"""WITH {TRADE}, tests AS (SELECT id FROM nodes WHERE id::INT % 5 = 0), e AS (SELECT DISTINCT src, dst FROM edges),
  h1 AS (SELECT src s, dst n, 1 d FROM e WHERE src IN (FROM tests)), h2 AS (SELECT DISTINCT s, dst n, 2 d FROM h1 JOIN e ON src = n), h3 AS (SELECT DISTINCT s, dst n, 3 d FROM h2 JOIN e ON src = n),
  c AS (SELECT s, n, min(d) d FROM (FROM h1 UNION ALL FROM h2 UNION ALL FROM h3) WHERE n NOT IN (FROM tests) GROUP BY ALL), k AS (SELECT n, sum((d = 1)::INT) direct, count(*) covered FROM c GROUP BY 1)
  SELECT id AS node, coalesce(direct, 0)::BIGINT direct, coalesce(covered, 0)::BIGINT covered, CASE WHEN coalesce(direct, 0) > 0 THEN 'unit' WHEN coalesce(covered, 0) > 0 THEN 'integration' ELSE 'none' END test_type FROM nodes LEFT JOIN k ON n = id WHERE id NOT IN (FROM tests)""")
def test_mapping(spark: SparkSession, d: str) -> DataFrame:
    """Which nations the test ones (divisible by 5) cover."""
    name = lambda c: F.when(F.col(c).cast("int") % 5 == 0, F.concat(F.lit("tests/"), F.col(c))).otherwise(F.col(c))
    e = trade_graph(spark, d).select("graph_id", name("src").alias("src"), name("dst").alias("dst"))
    return T.test_map(e, _nodes(e)).drop("graph_id")
