"""Queries over change histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import history as H
from ..shared import table as t
from .inputs import HISTORY, history
from .registry import ORACLES, query

_NOISE = "CASE " + " ".join(f"WHEN regexp_matches(coalesce(message, ''), '{p}') THEN {w}::DOUBLE" for p, w in H.NOISE) + " ELSE 1::DOUBLE END"
_COUPLED = f"""{HISTORY},
dates AS (SELECT graph_id, max(ts) last, count(*) n FROM log GROUP BY 1),
c AS (SELECT log.graph_id, log.hash, width, (epoch_us(last) - epoch_us(ts)) / 8.64e10 age, {_NOISE} noise, CASE WHEN n / 3.0 > 30 THEN 29 WHEN n / 3.0 < 5 THEN 87 ELSE 45 END dc FROM log JOIN dates USING (graph_id) JOIN width USING (graph_id, hash) WHERE width >= 2),
wide AS (SELECT graph_id, count(*) wide FROM c GROUP BY 1),
u AS (SELECT * FROM c WHERE width <= 30),
i AS (SELECT touched.graph_id, hash, f, age, noise * exp(-age / dc) / (width - 1) w FROM touched JOIN u USING (graph_id, hash)),
one AS (SELECT graph_id, f, count(*) n FROM i GROUP BY ALL),
two AS (SELECT x.graph_id, x.f file_a, y.f file_b, count(*) co_changes, sum(x.w) weight, min(x.age) age FROM i x JOIN i y ON x.graph_id = y.graph_id AND x.hash = y.hash AND x.f < y.f GROUP BY ALL),
scored AS (SELECT two.*, wide, co_changes / (p.n + q.n - co_changes) confidence, co_changes / p.n conf_ab, co_changes / q.n conf_ba, co_changes / wide support, round(age)::INT last_days
  FROM two JOIN wide USING (graph_id) JOIN one p ON p.graph_id = two.graph_id AND p.f = file_a JOIN one q ON q.graph_id = two.graph_id AND q.f = file_b WHERE co_changes >= CASE WHEN wide > 20 THEN 3 ELSE 2 END),
coupled AS (SELECT * FROM scored WHERE confidence >= 0.3 OR conf_ab >= 0.6 OR conf_ba >= 0.6),
ranked AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY round(weight, 9) DESC, round(confidence, 9) DESC, file_a, file_b) rank FROM coupled)"""


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(f"WITH {HISTORY} SELECT * FROM (SELECT graph_id, f AS file, count(*) commits, strftime(max(ts), '%Y-%m-%d') last_day, row_number() OVER (PARTITION BY graph_id ORDER BY count(*) DESC, f) rank FROM touched GROUP BY graph_id, f) WHERE rank <= 15")
def hot_files(spark: SparkSession, d: str) -> DataFrame:
    """Most often changed files of each repository."""
    return H.hot_files(history(spark, d)).select("graph_id", "file", "commits", F.date_format("last_changed", "yyyy-MM-dd").alias("last_day"), "rank")


@query("SELECT p_brand AS file, sum(l_quantity::BIGINT + l_linenumber)::BIGINT churn FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def churn(spark: SparkSession, d: str) -> DataFrame:
    """Churn with quantity as added and line number as deleted lines."""
    part = t(spark, d, "part").select("p_partkey", F.col("p_brand").alias("file"))
    lines = t(spark, d, "lineitem").select("l_partkey", F.col("l_quantity").cast("bigint").cast("string").alias("added"), F.col("l_linenumber").cast("string").alias("deleted"))
    return H.churn(lines.join(part, F.col("l_partkey") == F.col("p_partkey")))


@query(f"WITH {_COUPLED} SELECT graph_id, file_a, file_b, co_changes, round(weight, 6) weight, round(confidence, 6) confidence, round(conf_ab, 6) conf_ab, round(conf_ba, 6) conf_ba, round(support, 6) support, last_days, rank FROM ranked WHERE rank <= 10")
def change_coupling(spark: SparkSession, d: str) -> DataFrame:
    """The ten strongest couplings of each repository."""
    return _rounded(H.change_coupling(history(spark, d)), "weight", "confidence", "conf_ab", "conf_ba", "support")


@query(f"WITH {_COUPLED} SELECT graph_id, file_a, file_b, round(conf_ab, 6) conf_ab, round(conf_ba, 6) conf_ba, CASE WHEN conf_ab > conf_ba THEN 'a implies b' WHEN conf_ba > conf_ab THEN 'b implies a' ELSE 'both ways' END direction FROM coupled")
def directional_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Which way each coupled pair leans."""
    c = H.change_coupling(history(spark, d), top=None)
    way = F.when(F.col("conf_ab") > F.col("conf_ba"), "a implies b").when(F.col("conf_ba") > F.col("conf_ab"), "b implies a").otherwise("both ways")
    return _rounded(c.select("graph_id", "file_a", "file_b", "conf_ab", "conf_ba", way.alias("direction")), "conf_ab", "conf_ba")


@query(f"""WITH {_COUPLED}, num AS (SELECT graph_id, hash, row_number() OVER (PARTITION BY graph_id ORDER BY ts, hash) - 1 i FROM log),
  tch AS (SELECT touched.graph_id, i, f FROM touched JOIN num USING (graph_id, hash)),
  met AS (SELECT DISTINCT k.graph_id, file_a, file_b, co_changes, x.i, abs(y.i - x.i) lag FROM coupled k JOIN tch x ON x.graph_id = k.graph_id AND x.f = file_a JOIN tch y ON y.graph_id = k.graph_id AND y.f = file_b AND y.i <> x.i AND abs(y.i - x.i) <= 3)
  SELECT graph_id, file_a, file_b, co_changes, round(sum(1.0::DOUBLE / lag), 6) lag_score, count(*) events FROM met GROUP BY ALL HAVING sum(1.0::DOUBLE / lag) > 0.5 * co_changes""")
def lag_coupling(spark: SparkSession, d: str) -> DataFrame:
    """Coupled pairs that also follow each other within three commits."""
    log = history(spark, d)
    return _rounded(H.lag_coupling(log, H.change_coupling(log, top=None), ["ts", "hash"]), "lag_score")


@query(f"""WITH {_COUPLED}, num AS (SELECT graph_id, hash, row_number() OVER (PARTITION BY graph_id ORDER BY ts, hash) - 1 i FROM log), total AS (SELECT graph_id, count(*) n FROM num GROUP BY 1),
  tch AS (SELECT touched.graph_id, i, f, row_number() OVER (PARTITION BY touched.graph_id, f ORDER BY i DESC) - 1 r FROM touched JOIN num USING (graph_id, hash)),
  s AS (SELECT k.graph_id, file_a, file_b, count(*) m, sum(CASE WHEN y.f IS NOT NULL THEN pow(0.995, n - 1 - x.i - x.r) ELSE 0 END) a, sum(CASE WHEN y.f IS NULL THEN pow(0.995, n - 1 - x.i - x.r) ELSE 0 END) b
    FROM coupled k JOIN total USING (graph_id) JOIN tch x ON x.graph_id = k.graph_id AND x.f = file_a LEFT JOIN tch y ON y.graph_id = k.graph_id AND y.f = file_b AND y.i = x.i GROUP BY ALL),
  p AS (SELECT s.*, greatest(0.4 * 15 * pow(0.995, n - m) + a, 0.01) alpha, greatest(0.6 * 15 * pow(0.995, n - m) + b, 0.01) beta FROM s JOIN total USING (graph_id))
  SELECT graph_id, file_a AS src, file_b AS dst, round(alpha, 6) alpha, round(beta, 6) beta, round(alpha / (alpha + beta), 6) expectation FROM p""")
def ewma_priors(spark: SparkSession, d: str) -> DataFrame:
    """Priors of the coupled pairs, as edges with a structural mean of .4."""
    log = history(spark, d)
    edges = H.change_coupling(log, top=None).select("graph_id", F.col("file_a").alias("src"), F.col("file_b").alias("dst"), F.lit(0.4).alias("start"))
    return _rounded(H.edge_priors(edges, log, ["ts", "hash"]), "alpha", "beta", "expectation")


@query(f"WITH {_COUPLED} SELECT graph_id, file_a, file_b FROM ranked WHERE rank <= 10 AND EXISTS (SELECT 1 FROM files WHERE files.graph_id = ranked.graph_id AND path = file_a) AND EXISTS (SELECT 1 FROM files WHERE files.graph_id = ranked.graph_id AND path = file_b)")
def alive_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Reported couplings of files that still exist."""
    return H.alive(H.change_coupling(history(spark, d)), t(spark, d, "files")).select("graph_id", "file_a", "file_b")


@query(ORACLES["alive_pairs"].replace("ranked WHERE rank <= 10 AND", "coupled ranked WHERE"))
def alive_pairs_all(spark: SparkSession, d: str) -> DataFrame:
    """All couplings of files that still exist, not only those among the ten reported."""
    return H.alive(H.change_coupling(history(spark, d), top=None), t(spark, d, "files")).select("graph_id", "file_a", "file_b")


@query(f"WITH {HISTORY} SELECT graph_id, hash, {_NOISE} noise FROM log")
def commit_noise(spark: SparkSession, d: str) -> DataFrame:
    """Discount of every commit by its message."""
    return history(spark, d).select("graph_id", "hash", H.noise_discount(F.col("message")).alias("noise"))


def _across_layers(spark: SparkSession, d: str, coupled: DataFrame) -> DataFrame:
    """Coupled pairs of confidence .4 or more whose files lie in different layers."""
    from ..shared import latest_by

    layers = latest_by(t(spark, d, "files").select("path", "layer", "updated_at"), ["path"], ["updated_at"]).select("path", "layer")
    of = lambda x: layers.select(F.col("path").alias(f"file_{x}"), F.col("layer").alias(f"layer_{x}"))
    c = coupled.where("confidence >= 0.4").join(of("a"), "file_a", "left").join(of("b"), "file_b", "left")
    return _rounded(c.where(~F.col("layer_a").eqNullSafe(F.col("layer_b"))).select("graph_id", "file_a", "file_b", "confidence"), "confidence")


@query(f"""WITH {_COUPLED} SELECT ranked.graph_id, file_a, file_b, round(confidence, 6) confidence FROM ranked
  WHERE rank <= 10 AND confidence >= 0.4 AND (SELECT max(layer) FROM (SELECT path, layer, row_number() OVER (PARTITION BY path ORDER BY updated_at DESC NULLS LAST) rn FROM files) WHERE rn = 1 AND path = file_a) IS DISTINCT FROM
   (SELECT max(layer) FROM (SELECT path, layer, row_number() OVER (PARTITION BY path ORDER BY updated_at DESC NULLS LAST) rn FROM files) WHERE rn = 1 AND path = file_b)""")
def hidden_coupling(spark: SparkSession, d: str) -> DataFrame:
    """Strong couplings across layers, where nothing in the structure explains them."""
    return _across_layers(spark, d, H.change_coupling(history(spark, d)))


@query(ORACLES["hidden_coupling"].replace("FROM ranked\n  WHERE rank <= 10 AND", "FROM coupled ranked\n  WHERE"))
def hidden_coupling_all(spark: SparkSession, d: str) -> DataFrame:
    """The same among all couplings of a repository, not only its ten reported ones."""
    return _across_layers(spark, d, H.change_coupling(history(spark, d), top=None))


@query("""WITH s AS (SELECT id, file_path, start_line, end_line FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC NULLS LAST) rn FROM symbols WHERE id IS NOT NULL) WHERE rn = 1),
  b AS (SELECT file_path, line, min(days) AS days FROM (SELECT file_path, start_line line, (start_line % 97)::DOUBLE AS days FROM s WHERE start_line IS NOT NULL) GROUP BY ALL),
  hit AS (SELECT id, min(days) AS days FROM s JOIN b ON b.file_path = s.file_path AND line BETWEEN start_line AND end_line GROUP BY 1)
  SELECT s.id, coalesce(hit.days, 365.0) AS days FROM s LEFT JOIN hit USING (id)""")
def symbol_recency(spark: SparkSession, d: str) -> DataFrame:
    """Age of each symbol from the ages of its lines (interval join)."""
    from ..shared import latest_by

    s = latest_by(t(spark, d, "symbols").where("id IS NOT NULL").select("id", F.col("file_path").alias("file"), "start_line", "end_line", "indexed_at"), ["id"], ["indexed_at"])
    blame = s.where("start_line IS NOT NULL").groupBy("file", F.col("start_line").alias("line")).agg(F.min((F.col("start_line") % 97).cast("double")).alias("days"))
    return H.recency(s, blame)
