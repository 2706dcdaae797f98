"""Choosing targets, guessed edges, Rust methods and limits of kernels, on small cases and with nulls, ties and empty tables."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import ghosts as Z
from sparkloom.operators import graph as G
from sparkloom.operators import intent as I
from sparkloom.operators import targets as Y
from sparkloom.operators.parsers import parse

EDGES = "graph_id string, src string, dst string, weight double"


def test_best_coupling_holds_either_way_and_takes_the_greatest(spark):
    c = spark.createDataFrame([("q", "x", 1), ("q", "y", 2), ("q", "z", 3), ("q", "x", 9)], "query string, item string, value int")
    s = spark.createDataFrame([("q", "s1"), ("q", "s2"), ("q", "x"), ("other", "z")], "query string, item string")
    k = spark.createDataFrame([("s1", "x", 0.2), ("x", "s2", 0.7), ("x", "x", 1.0), ("y", "s1", None), (None, "z", 0.9)], "a string, b string, value double")
    assert {r["item"]: r.coupling for r in Y.best_coupling(c, s, k).collect()} == {"x": 0.7, "y": 0.0, "z": 0.0}
    assert Y.best_coupling(c.limit(0), s, k).count() == 0


def test_five_levels_of_order(spark):
    rows = [("q", "e", 1.0, False, None, 1), ("q", "d", 1.0, False, 0.5, 1), ("q", "c", 1.0, False, 0.5, 2), ("q", "b", 1.0, True, None, None), ("q", "a", 2.0, None, None, None), ("q", "f", 1.0, False, None, 1), ("q", "z", None, True, 1.0, 9)]
    df = spark.createDataFrame(rows, "query string, item string, score double, imports_target boolean, betweenness double, in_degree int")
    assert [r["item"] for r in Y.in_order(df).orderBy("rank").collect()] == ["a", "b", "c", "d", "e", "f", "z"]
    assert [r["item"] for r in Y.in_order(df, 2).orderBy("rank").collect()] == ["a", "b"]


def test_match_types_confidence_pages_and_costs(spark):
    df = spark.createDataFrame([(1, True, None, None, None), (2, True, True, None, None), (3, None, None, True, True), (4, False, True, False, True), (5, None, None, None, None)], "i int, l boolean, o boolean, c boolean, n boolean")
    got = {r.i: r.m for r in df.select("i", Y.match_type(*[F.col(x) for x in "locn"]).alias("m")).collect()}
    assert got == {1: "direct", 2: "import-only", 3: "coupling", 4: "neighbor", 5: None}
    ranked = spark.createDataFrame([("q", "a", 2.0), ("q", "b", 1.0), ("q", "c", 0.1), ("r", "d", 0.0)], "query string, item string, score double")
    assert {r["item"]: r.confidence for r in Y.relative_confidence(ranked).collect()} == {"a": "high", "b": "medium", "c": "low", "d": "low"}
    assert [r.i for r in Y.page(df, [F.col("i")], 2, 1).collect()] == [3, 4] and Y.page(df, [F.col("i")], 2, 9).count() == 0
    s = spark.createDataFrame([(1, "n" * 60, "p" * 20), (2, None, None), (3, "a", "b")], "id int, name string, path string")
    e = spark.createDataFrame([(1, 3), (3, None), (3, 2)], "src int, dst int")
    assert {r.id: r.cost for r in Y.symbol_cost(s, e).collect()} == {1: 25, 2: 10, 3: 16}


def test_risk_fades_with_distance(spark):
    e = spark.createDataFrame([("g", "a", "b", 1.0), ("g", "b", "c", 1.0), ("g", "c", "a", 1.0)], EDGES)
    churn = spark.createDataFrame([("g", "c", 1.0), ("g", "lone", 0.5), ("g", "calm", 0.1)], "graph_id string, node string, churn double")
    got = {r.node: (r.far, r.risk) for r in Y.churn_risk(e, churn).collect()}
    assert got == {"a": (0.25, pytest.approx(0.175)), "b": (0.5, pytest.approx(0.35)), "c": (0.0, pytest.approx(0.3)), "lone": (0.0, pytest.approx(0.15))}


def test_json_sink_and_rows(spark, tmp_path):
    df = spark.createDataFrame([("g", "b", "c"), ("g", "a", None), ("h", "x", "y")], "graph_id string, src string, dst string")
    assert {r.graph_id: json.loads(r.rows) for r in Y.rows_as_json(df, "graph_id", ["src", "dst"]).collect()} == {"g": [["a", None], ["b", "c"]], "h": [["x", "y"]]}
    Y.write_json(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3


SYMBOLS = "path string, name string, kind string, start_line int, end_line int"
IMPORTS = "path string, name string, target string"


def test_guessed_edges(spark):
    symbols = spark.createDataFrame(
        [("a.ts", "Ctl", "class", 1, 20), ("a.ts", "list", "method", 5, 8), ("a.ts", "list", "method", 30, 31), ("b.ts", "Repo", "class", 1, 9), ("b.ts", "Port", "interface", 11, 12),
         ("m.rs", "Shape", "trait", 1, 3), ("n.rs", "Disc", "struct", 4, 6), ("d.py", "Typed", "class", 1, None), ("d.py", "__get__", "function", 2, 3), ("d.py", "Plain", "class", 0, 0)], SYMBOLS)
    decorators = spark.createDataFrame([("a.ts", "Ctl", "Controller"), ("a.ts", "list", "Get"), ("b.ts", "Repo", None)], "path string, target string, name string")
    imports = spark.createDataFrame([("a.ts", "Repo", "b.ts"), ("a.ts", "Port", "b.ts"), ("u.py", "Typed", "d.py"), ("u.py", "Gone", None)], IMPORTS)
    uses = spark.createDataFrame([("a.ts", "Ctl", "Repo", 3), ("a.ts", "Ctl", "Port", 4), ("a.ts", "Other", "Repo", 4)], "path string, name string, type string, line int")
    assert [(r.src_name, r.dst, r.dst_name, r.kind) for r in Z.injected(decorators, uses, imports, symbols).collect()] == [("Ctl", "b.ts", "Repo", "di_inject")]
    calls = spark.createDataFrame([("s.ts", "auth", "router", "use", 1), ("s.ts", "show", "router", "get", 2), ("s.ts", "auth", "router", "post", 3), ("s.ts", "far", "other", "get", 4), ("s.ts", None, "router", "get", 5)], "path string, caller string, object string, callee string, line int")
    assert {(r.src_name, r.dst_name) for r in Z.routes(decorators, symbols, calls).collect()} == {("list", "Ctl"), ("auth", "show")}
    impls = spark.createDataFrame([("n.rs", "Disc", "Shape", "area"), ("n.rs", "Disc", "Clone", "clone"), ("n.rs", "Disc", None, "new"), ("o.rs", "Disc", "Shape", "area")], "path string, type string, trait string, method string")
    assert [(r.src, r.src_name, r.dst, r.dst_name, r.line) for r in Z.trait_bounds(impls, symbols).collect()] == [("n.rs", "Disc", "m.rs", "Shape", 4)]
    made = spark.createDataFrame([("u.py", "x", "Typed", "Model", 7), ("d.py", "y", "Typed", None, 9), ("u.py", "z", "Plain", "Model", 8), ("v.py", "w", "Typed", None, 1)], "path string, variable string, class string, owner string, line int")
    assert {(r.src, r.src_name, r.dst) for r in Z.descriptors(symbols, made, imports).collect()} == {("u.py", "Model", "d.py"), ("d.py", "y", "d.py")}
    assert Z.routes(decorators.limit(0), symbols, calls.limit(0)).count() == 0


def test_rust_methods_by_own_trait_and_deref(spark):
    symbols = spark.createDataFrame([("a.rs", "Boxed", "struct", 1, 2), ("b.rs", "Inner", "struct", 1, 2), ("c.rs", "Deep", "enum", 1, 2), ("t.rs", "Draw", "trait", 1, 2)], SYMBOLS)
    impls = spark.createDataFrame([("Boxed", None, "own"), ("Boxed", "Draw", "draw"), ("Inner", None, "open"), ("Inner", None, "own"), ("Deep", None, "sink")], "type string, trait string, method string")
    derefs = spark.createDataFrame([("Boxed", "Inner"), ("Inner", "Deep")], "type string, to string")
    imports = spark.createDataFrame([("m.rs", "Draw", "t.rs")], IMPORTS)
    calls = spark.createDataFrame([("m.rs", "f", "Boxed", m, i) for i, m in enumerate(["own", "draw", "open", "sink", "none"])] + [("x.rs", "f", "Boxed", "draw", 9), ("x.rs", "f", None, "own", 9)], "path string, caller string, object string, callee string, line int")
    got = {(r.path, r.callee): (r.type, r.target, r.hops) for r in Z.rust_methods(calls, impls, derefs, symbols, imports).collect()}
    assert got == {("m.rs", "own"): ("Boxed", "a.rs", 0), ("m.rs", "draw"): ("Boxed", "a.rs", 0), ("m.rs", "open"): ("Inner", "b.rs", 1), ("m.rs", "sink"): ("Deep", "c.rs", 2)}
    assert {(r.src_name, r.dst_name) for r in Z.deref_edges(derefs, symbols).collect()} == {("Boxed", "Inner"), ("Inner", "Deep")}


def test_lifetimes_are_no_quotes():
    f = parse("rust", "pub fn odd<'a>(x: &'a i32) { one(x); two(x, 'c'); }\nstruct View<'a> { text: &'a str }\nfn last() { three(); }\n")
    assert {c[2] if len(c) > 2 else c for c in f["calls"]} >= {"one", "two"} or {"one", "two", "three"} <= {x for c in f["calls"] for x in c if isinstance(x, str)}
    assert {s[0]: (s[2], s[3]) for s in f["symbols"]}["View"] == (2, 2)


def test_reseeding_keeps_graphs_apart(spark):
    rows = [(g, a, b, 1.0) for g in ("x", "y") for a, b in [("s", "m"), ("m", "t"), ("u", "m"), ("p", "q")]]
    e = spark.createDataFrame(rows, EDGES)
    scores = spark.createDataFrame([("x", "p", 0.9), ("x", "m", 0.1), ("x", "t", 0.0), ("y", "m", 0.9), ("y", "t", 0.0), ("y", "p", 0.1)], "graph_id string, node string, betweenness double")
    got = {(r.graph_id, r.node): r.score for r in I.reseeded(e, scores, {"s": 1.0}).collect()}
    first = {(r.graph_id, r.node): r.score for r in G.katz(e, {"s": 1.0}).collect()}
    assert ("x", "p") in got and ("y", "p") not in got and ("x", "p") not in first
    assert all(got[k] >= v for k, v in first.items())


def test_limits_are_counted_before_a_task_starts(spark, monkeypatch):
    e = spark.createDataFrame([("x", "a", "b", 1.0), ("x", "b", "c", 1.0)], EDGES)
    monkeypatch.setattr(G, "MOST_BITS", 2)
    with pytest.raises(ValueError, match="nodes"):
        G.chokepoints(e)
    monkeypatch.setattr(G, "MOST_EDGES", 1)
    with pytest.raises(ValueError, match="edges"):
        G.betweenness_by_source(e)


def test_sampled_sources_are_all_or_a_stratified_share(spark):
    ring = [("big", f"n{i:03d}", f"n{(i + 1) % 400:03d}", 1.0) for i in range(400)] + [("small", "a", "b", 1.0), ("small", "b", "c", 1.0)]
    e = spark.createDataFrame(ring, EDGES)
    kinds = e.select("graph_id", F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("community", F.when(F.col("node") < "n100", 1).when(F.col("node") < "n390", 2))
    got = G.sample_sources(e, kinds).join(kinds, ["graph_id", "node"]).groupBy("graph_id", "community").count().collect()
    assert {(r.graph_id, r.community): r["count"] for r in got} == {("big", 1): 13, ("big", 2): 37, ("big", None): 2, ("small", 1): 3} or sum(r["count"] for r in got if r.graph_id == "small") == 3
    assert 50 <= sum(r["count"] for r in got if r.graph_id == "big") <= 53 and len([r for r in got if r.graph_id == "big"]) == 3
    exact = {r.node: r.betweenness for r in G.betweenness(e.where("graph_id = 'small'")).collect()}
    assert {r.node: r.betweenness for r in G.betweenness_sampled(e.where("graph_id = 'small'")).collect()} == exact


def test_hashes(spark):
    from sparkloom.functions.hashes import rolling31, short_sha, xorshift32

    df = spark.createDataFrame([("abc", 1), ("", 0), (None, 5)], "t string, n int").withColumn("x", xorshift32(F.col("n")))
    got = df.select(rolling31(F.col("t")).alias("h"), short_sha(F.col("t")).alias("s"), "x").collect()
    assert [r.h for r in got] == [96354, 0, 0] and got[0].s == "ba7816bf8f01cfea" and got[2].s is None
    assert [r.x for r in got] == [270369, 270369, 1351845]


def test_import_order(spark):
    texts = {
        "sorted": "// head\nimport a from 'alpha';\nimport { b } from 'beta';\n\nimport c from './c';\nconst x = 1;\nimport z from 'zeta';",
        "mixed": "import b from 'beta';\nimport a from 'alpha';\nimport c from './c';",
        "relative": "import c from './c';\nimport 'side';\nimport b from '@/b';",
        "builtin": "import fs from 'node:fs';\n\nimport a from 'alpha';\nimport b from 'beta';",
        "few": "import a from 'a';", "none": None,
    }
    from sparkloom.operators import extraction as X

    got = {r.path: (r.ordering, r.alphabetical, r.builtins_apart) for r in X.import_order(spark.createDataFrame(list(texts.items()), "path string, text string")).collect()}
    assert got == {
        "sorted": ("external-first, blank-line separated", True, False), "mixed": ("external-first", False, False), "relative": (None, True, False),
        "builtin": ("external-first, blank-line separated", True, True), "few": (None, False, False), "none": (None, False, False),
    }


def test_signatures_and_pipeline(spark):
    from sparkloom.operators import extraction as X

    files = spark.createDataFrame([("a.ts", "typescript", "export function alpha(x: {a: number},\n  y = 2): number {\n  return beta(x);\n}\n"), ("b.py", "python", "def gamma(x: int) -> int:\n    return x\n"), ("c.ts", "typescript", None), ("d.xx", None, "x")], "path string, language string, text string")
    got = {r.name: (r.signature, r.is_exported) for r in X.signatures(files).collect()}
    assert got == {"alpha": ("export function alpha(x: {a: number}, y = 2): number", True), "gamma": ("def gamma(x: int) -> int", True)}
    symbols = spark.createDataFrame([("a/x.ts", "f", "function"), ("a/y.ts", "g", "function"), ("b/z.ts", "g", "function"), ("a/x.ts", "h", "function")], "path string, name string, kind string")
    imports = spark.createDataFrame([("a/x.ts", "a/y.ts", ["g"])], "path string, target string, names array<string>")
    calls = spark.createDataFrame([("a/x.ts", "f", "h", None, 1, False), ("a/x.ts", "f", "g", None, 2, False), ("a/w.ts", "m", "g", None, 3, False), ("a/w.ts", "m", "nothing", None, 4, False)], "path string, caller string, callee string, object string, line int, is_new boolean")
    edges = {(r.src, r.callee): (r.dst, r.tier) for r in X.symbol_pipeline(calls, symbols, imports).collect()}
    assert edges[("a/x.ts", "h")] == ("a/x.ts", 1) and edges[("a/x.ts", "g")] == ("a/y.ts", 2) and edges[("a/w.ts", "g")] == ("a/y.ts", 5) and ("a/w.ts", "nothing") not in edges


def test_both_ways_pass_on_less_backwards_and_for_guesses(spark):
    e = spark.createDataFrame([("g", "a", "b", "calls", 1.0), ("g", "b", "c", "di_inject", 0.5), ("g", "c", None, "calls", 1.0)], "graph_id string, src string, dst string, kind string, confidence double")
    got = {(r.src, r.dst): r.weight for r in I.both_ways(e).collect()}
    assert got == pytest.approx({("a", "b"): 0.7, ("b", "a"): 0.49, ("b", "c"): 0.21, ("c", "b"): 0.147})
    assert {r.node for r in I.propagate(e, {"c": 1.0}).collect()} == {"a", "b", "c"}
