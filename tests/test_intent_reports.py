"""Intent and report operators on hand-made tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import extraction as X
from sparkloom.operators import intent as I
from sparkloom.operators import reports as P
from sparkloom.operators import sessions as S
from sparkloom.operators import traversal as V

EDGES = "graph_id string, src string, dst string, weight double"


def test_prompts(spark):
    df = spark.createDataFrame([("please fix src/a.ts now", "src/a.ts", True, False), ("do not touch src/a.ts", "src/a.ts", False, False), ("ok", "x", False, True), (None, "x", None, True)], "p string, t string, named boolean, trivial boolean")
    rows = df.select("named", "trivial", I.mentions(F.col("p"), F.col("t")).alias("a"), I.trivial(F.col("p")).alias("b")).collect()
    assert [(r.a, r.b) for r in rows] == [(True, False), (False, False), (False, True), (None, True)]


def test_weights_of_kinds(spark):
    r = spark.range(1).select(I.kind_weight(F.lit("embeds")).alias("a"), I.kind_weight(F.lit("di_inject")).alias("b"), I.kind_weight(F.lit("odd")).alias("c"), I.transmission(F.lit("calls"), F.lit(True), F.lit(True)).alias("d")).first()
    assert (r.a, r.b, r.c) == (0.8, 1.0, 0.3) and r.d == pytest.approx(0.7 * 0.7 * 0.6)


def test_flows_name_what_dominates_their_end(spark):
    e = spark.createDataFrame([("g", "in", "a", 0.9), ("g", "a", "b", 0.9), ("g", "a", "c", 0.5), ("g", "b", "out", 0.9), ("g", "c", "out", 0.5)], EDGES)
    r = I.flows(e, {"in": 1.0}, ["out"], {"in": 1, "a": 1, "b": 2, "out": 2}).orderBy("rank").collect()
    assert r[0].path == "in>a>b>out" and r[0].through == "in,a" and r[0].crossings == 1 and r[0].confidence == pytest.approx(0.9**3)


def test_flows_of_a_graph_of_many_nodes(spark):
    rows = [("g", "in", "a", 0.9), ("g", "a", "out", 0.9)] + [("g", "in" if i % 2 else f"x{i - 1}", f"x{i}", 0.1) for i in range(1, 2500)]
    r = I.flows(spark.createDataFrame(rows, EDGES), {"in": 1.0}, ["out"]).collect()
    assert [(x.path, x.through) for x in r] == [("in>a>out", "in,a")] and r[0].confidence == pytest.approx(0.81)


def test_latent_seeds_of_every_repository(spark, tmp_path):
    from sparkloom.plans import QUERIES

    rows = [(f"{g}{i}{n}", g, f"{g}/{i:02d}", [f"{'ab'[i % 2]}{n}"], i) for g, m in (("one", 60), ("two", 60), ("tiny", 4)) for i in range(m) for n in range(4) if (i + n) % 5]
    s = spark.createDataFrame(rows, "id string, graph_id string, file_path string, import_names array<string>, k int").withColumn("indexed_at", F.timestamp_seconds("k"))
    s.write.parquet(f"{tmp_path}/symbols.parquet")
    got = QUERIES["latent_seeds"](spark, str(tmp_path)).collect()
    assert {r.query for r in got} == {"one", "two"} and all(r.item.startswith(r.query) for r in got)
    assert all(sum(r.query == g for r in got) == I.LATENT_MOST for g in ("one", "two")) and not {r.item for r in got} & {"one/00", "one/01", "two/00", "two/01"}
    assert {r.score for r in got} == {0.4}


def test_verdicts_and_impact(spark):
    e = spark.createDataFrame([("g", "t", "a", "calls", 0.9), ("g", "u", "t", "calls", 0.9), ("g", "v", "a", "uses_type", 0.2)], "graph_id string, src string, dst string, kind string, confidence double")
    ch = spark.createDataFrame([("g", "a", "signature")], "graph_id string, node string, change string")
    assert {(r.node, r.verdict) for r in V.safe_change(e, ch).collect()} == {("t", "BREAKING"), ("u", "UNKNOWN"), ("v", "UNKNOWN")}
    i = V.impact(e.withColumn("is_type_only", F.col("kind") == "uses_type")).where("start = 'a'")
    assert {(r.node, r.effect) for r in i.collect()} == {("t", "will break"), ("u", "likely")}


def test_missing_partners_debt_and_packages(spark):
    c = spark.createDataFrame([("a", "b", 0.9, 0.2), ("a", "c", 0.6, 0.6)], "file_a string, file_b string, conf_ab double, conf_ba double")
    changed = spark.createDataFrame([("a",), ("c",), (None,)], "file string")
    assert [(r.file, r.missing) for r in P.missing_co_changes(changed, c).collect()] == [("a", "b")]
    f = lambda rows: spark.createDataFrame(rows, "file string, factor string")
    assert [(r.file, r.factors) for r in P.debt([f([("x", "p"), ("y", "p")]), f([("x", "q"), ("x", "q")])]).collect()] == [("x", 2)]
    paths = spark.createDataFrame([("p/a/x.ts",), ("p/y.ts",), ("z.ts",)], "path string")
    packs = spark.createDataFrame([("p",), ("p/a",)], "package string")
    assert {r.path: r.package for r in V.package_of(paths, packs).collect()} == {"p/a/x.ts": "p/a", "p/y.ts": "p", "z.ts": None}
    assert P.package_view(paths, ["path"], "p").count() == 2
    assert spark.range(1).select(P.directive_scope(F.array(F.lit("b/x"), F.lit("a/y"))).alias("s")).first().s == "a"


def test_proximity_and_aliases(spark):
    u = spark.createDataFrame([("a/x", "f", "g")], "path string, caller string, callee string")
    cand = spark.createDataFrame([("a/y", "g", 0.25), ("b/z", "g", 1.0)], "target string, callee string, authority double")
    near = spark.createDataFrame([("a/x", ["m"]), ("a/y", ["m"]), ("b/z", ["n"])], "path string, near array<string>")
    assert X.proximity(u, cand, near).first().target == "a/y"
    names = spark.createDataFrame([("A",), ("Z",)], "name string")
    al = spark.createDataFrame([("A", "B"), ("B", "C")], "alias string, name string")
    assert {r.name: r.real for r in X.follow_aliases(names, al).collect()} == {"A": "C", "Z": "Z"}


def test_sessions_without_edits_stay_explore(spark):
    schema = "session_id string, turn_index int, ts timestamp, tools array<struct<name string, command string, path string>>, input_tokens bigint, output_tokens bigint, cache_read_tokens bigint, cache_creation_tokens bigint, file_paths array<string>"
    t = [("s", i, None, [("Bash", "pytest -x", None)], None, 1, 0, 0, None) for i in range(3)]
    t += [("e", 0, None, [("Edit", None, "a.ts")], 0, 1, 0, 0, None), ("e", 1, None, [("bash", "npm test", None)], 0, 1, 0, 0, None), ("e", 2, None, [("bash", "npm test", None)], 0, 2, 0, 0, None), ("e", 3, None, None, 0, 1000, 0, 0, None), ("e", 3, None, None, 0, 1000, 0, 0, None)]
    p = S.phases(S.turn_facts(spark.createDataFrame(t, schema))).cache()
    assert {r.phase for r in p.where("session_id = 's'").collect()} == {"explore"}
    assert [(r.first_turn, r.last_turn, r.runs, r.wasted_cost) for r in S.test_streaks(p).collect()] == [(1, 2, 2, pytest.approx(30e-6))]
    assert S.summary_bloat(p).first().turns == 1 and S.rereads(p).count() == 0
