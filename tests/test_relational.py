"""Shared joins and relational operators on small tables, with nulls, ties, hot keys and empty inputs."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sparkloom.functions.commands import plain_command
from sparkloom.functions.identifiers import identifier_words
from sparkloom.functions.paths import plain_path, plain_paths
from sparkloom.functions.words import identifier_terms
from sparkloom.operators import edges as E
from sparkloom.operators import graph as G
from sparkloom.operators import history as H
from sparkloom.operators import layers as L
from sparkloom.operators import learning as M
from sparkloom.operators import maintenance as T
from sparkloom.operators import retrieval as R
from sparkloom.operators import selection as S
from sparkloom.operators import traversal as V
from sparkloom.shared import join_stats, latest_by, positions, running_sum


@pytest.mark.parametrize("hot", [False, True])
def test_join_stats_equals_join(spark, request, hot):
    if hot:
        request.getfixturevalue("no_broadcast")
    rng = random.Random(1)
    rows = spark.createDataFrame([(i, rng.choice([1, 1, 1, 2, 3, None])) for i in range(200)], "id int, k int")
    stats = rows.groupBy("k").agg(F.count("*").alias("n"))
    got = sorted((r.id, r.k, r.n) for r in join_stats(rows, stats, ["k"], "n", ["id"]).collect())
    want = sorted((r.id, r.k, r.n) for r in rows.join(stats, "k").collect())
    assert got == want
    assert join_stats(rows.limit(0), stats.limit(0), ["k"], "n", ["id"]).count() == 0


def test_running_sums_and_positions_over_any_key_size(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a"] * 9 + ["b", None]), i, rng.choice([0, 1, None])) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, i int, v int").repartition(7)
    order = [F.col("i").desc()]
    got = {(r.k, r.i): (r.p, r.s) for r in running_sum(positions(df, ["k"], order, "p"), ["k"], order, F.col("v"), "s").collect()}
    seen, total = {}, {}
    for k, i, v in sorted(rows, key=lambda r: -r[1]):
        seen[k], total[k] = seen.get(k, -1) + 1, total.get(k, 0) + (v or 0)
        assert got[k, i] == (seen[k], total[k])


def test_latest_by_prefers_known_order_and_counts_ties_once(spark):
    t = datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", t, 1), ("a", t + timedelta(1), 2), ("a", None, 3), ("b", None, 4), ("b", None, 4), (None, t, 5)], "k string, at timestamp, v int")
    assert sorted((r.k or "", r.v) for r in latest_by(df, ["k"], ["at"]).collect()) == [("", 5), ("a", 2), ("b", 4)]


def test_spellings(spark):
    cases = {" /workspace/a//b.ts": "a/b.ts", "./a/./b.ts": "a/b.ts", "a\\b.ts ": "a/b.ts", "a/x/../b.ts": "a/b.ts", "/workspace": None, "": None, " ": None, ".github/a": ".github/a", "../a": "a", "workspace/a": "workspace/a", "a/b/": "a/b", "/workspace/../a": "a"}
    df = spark.createDataFrame(list(cases.items()), "c string, want string")
    assert df.where(~plain_path(F.col("c")).eqNullSafe(F.col("want"))).collect() == []
    assert spark.range(1).select(plain_paths(F.array(*map(F.lit, cases))).alias("p")).first().p == [".github/a", "a", "a/b", "a/b.ts", "workspace/a"]


def test_commands_and_words(spark):
    cases = {"CI=1 A=b npm  run -q lint 2>&1 | tail": "npm run lint", "x -- y;z": "x y", "a && b": "a", "a 2>/dev/null": "a", "a2>b": "a2", "a &>b": "a", None: "", "-x": "", "env A=b c": "env A=b c"}
    df = spark.createDataFrame(list(cases.items()), "c string, want string")
    assert [r.c for r in df.where(plain_command(F.col("c")) != F.col("want")).collect()] == []
    one = spark.range(1).select(identifier_words(F.lit("parseHTTPServer aB XMLé")).alias("w"), identifier_terms(F.lit("useContext set_value HTTPSServer"), ["use", "set"]).alias("t")).first()
    assert one.w == ["parse", "http", "server", "xml"] and one.t == ["context", "usecontext", "value", "https", "server"]


EDGES = "graph_id string, src string, dst string, weight double"


def test_hits_in_one_task_equals_rounds(spark):
    rng = random.Random(4)
    rows = [(g, f"n{a}", f"n{b}", rng.random()) for g in "xy" for a in range(12) for b in range(12) if a != b and rng.random() < 0.2] + [("x", None, "n1", 1.0)]
    e = spark.createDataFrame(rows, EDGES)
    a = {(r.graph_id, r.node): (r.authority, r.hub) for r in G.hits(e, 3, 0.0).collect()}
    b = {(r.graph_id, r.node): (r.authority, r.hub) for r in G.hits_rounds(e, 3, 0.0).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


def test_graph_too_large_for_a_task_says_so(spark, monkeypatch):
    monkeypatch.setattr(G, "MOST_EDGES", 1)
    with pytest.raises(Exception, match="relational form"):
        G.hits(spark.createDataFrame([("x", "a", "b", 1.0), ("x", "b", "c", 1.0)], EDGES)).collect()


def test_components_closure_and_empty_graphs(spark):
    e = spark.createDataFrame([("x", "a", "b", 1.0), ("x", "c", "b", 1.0), ("x", "d", "e", 1.0), ("x", "e", "d", 1.0)], EDGES)
    nodes = e.select("graph_id", F.explode(F.array("src", "dst")).alias("node")).distinct()
    assert {r.node: r.component for r in V.components(e, nodes).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d"}
    assert {(r.start, r.node) for r in V.reach(e).collect()} == {("a", "b"), ("c", "b"), ("d", "e"), ("e", "d"), ("d", "d"), ("e", "e")}
    none = e.limit(0)
    assert G.hits(none).count() == G.chokepoints(none).count() == V.closure(none).count() == E.instability(none.withColumn("is_type_only", F.lit(False))).count() == 0


@pytest.mark.parametrize(("n", "finish"), [(70, 0), (200, 20), (200, 2_000_000)])
def test_components_of_a_chain_whose_names_fall_away_from_the_least(spark, monkeypatch, n, finish):
    monkeypatch.setattr(V, "FINISH", finish)
    name = lambda i: f"{i:04d}"
    chain = [0, *range(n - 1, 0, -1)]
    rows = [("x", name(a), name(b), 1.0) for a, b in zip(chain, chain[1:], strict=False)] + [("y", "b", "a", 1.0), ("y", "b", "gone", 1.0)]
    nodes = spark.createDataFrame([("x", name(i)) for i in range(n)] + [("y", "a"), ("y", "b"), ("y", "c")], "graph_id string, node string")
    got = {(r.graph_id, r.node): r.component for r in V.components(spark.createDataFrame(rows, EDGES), nodes).collect()}
    assert got == {("x", name(i)): name(0) for i in range(n)} | {("y", "a"): "a", ("y", "b"): "a", ("y", "c"): "c"}


@pytest.mark.parametrize("finish", [0, 2_000_000])
def test_components_equal_a_search_on_random_trees(spark, monkeypatch, finish):
    monkeypatch.setattr(V, "FINISH", finish)
    rng = random.Random(5)
    names = {g: rng.sample(range(1000, 9999), 120) for g in "pq"}
    rows = [(g, str(v[i]), str(v[rng.randrange(max(i // 40 * 40, i - 3), i)]), 1.0) for g, v in names.items() for i in range(1, 120) if i % 40]
    want = {(g, str(v[i])): str(min(v[i // 40 * 40 : i // 40 * 40 + 40])) for g, v in names.items() for i in range(120)}
    nodes = spark.createDataFrame([(g, str(x)) for g, v in names.items() for x in v], "graph_id string, node string")
    assert {(r.graph_id, r.node): r.component for r in V.components(spark.createDataFrame(rows, EDGES), nodes).collect()} == want


COMMITS = "graph_id string, hash string, ts timestamp, message string, files array<string>"


def _log(spark, groups):
    return spark.createDataFrame([("g", str(i), datetime(2024, 1, 1) + timedelta(days=i), m, f) for i, (m, f) in enumerate(groups)], COMMITS)


def test_coupling_of_three_commits(spark):
    r = H.change_coupling(_log(spark, [("x", ["a", "b"])] * 3)).first()
    assert (r.file_a, r.file_b, r.co_changes, r.confidence) == ("a", "b", 3, 1.0)
    assert H.change_coupling(_log(spark, [("x", ["a"])] * 3)).count() == 0


def test_hidden_pairs_are_sought_beyond_the_ten_reported(spark):
    log = _log(spark, [("x", [f"a{i:02d}", f"b{i:02d}"]) for i in range(15) for _ in range(3)])
    rows = [("g", "b00", "a00"), ("g", "a01", "m"), ("g", "b01", "m"), ("g", "a14", "m"), ("g", "n", "m"), ("g", "n", "b14"), ("other", "a02", "b02")]
    hidden = H.hidden_coupling(H.change_coupling(log, top=None), spark.createDataFrame(rows, "graph_id string, src string, dst string"))
    assert {(r.file_a, r.file_b) for r in hidden.collect()} == {(f"a{i:02d}", f"b{i:02d}") for i in range(2, 15)}


def test_whole_coupling_queries_pass_the_ten_reported(spark, tmp_path):
    from sparkloom.plans import QUERIES

    names = [f"{x}{i:02d}" for x in "ab" for i in range(15)]
    log = _log(spark, [("x", [f"a{i:02d}", f"b{i:02d}"]) for i in range(15) for _ in range(3)]).withColumn("ingested_at", F.col("ts"))
    log.write.parquet(f"{tmp_path}/commits.parquet")
    files = spark.createDataFrame([("g", n, n[0], datetime(2024, 1, 1), "r", ["t"]) for n in names], "graph_id string, path string, layer string, updated_at timestamp, role string, test_files array<string>")
    files.write.parquet(f"{tmp_path}/files.parquet")
    run = lambda q: QUERIES[q](spark, str(tmp_path))
    assert run("hidden_coupling").count() == run("alive_pairs").count() == 10
    assert run("hidden_coupling_all").count() == run("alive_pairs_all").count() == 15
    assert run("graph_cards").where("co_changes <> ''").count() == 20 and run("graph_cards_all").where("co_changes <> ''").count() == 30


def test_hybrid_query_of_every_hundredth_vector(spark, tmp_path):
    from sparkloom.plans import QUERIES

    docs = [(i, "src/x", "alpha beta" if i in (100, 300) else "gamma delta", "log") for i in (100, 300, 401)]
    spark.createDataFrame(docs, "doc_id bigint, file_path string, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    vectors = [(i, [1.0, 0.0] if i < 250 else [0.0, 1.0]) for i in (200, 201, 300, 301)]
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.query, r.item): (r.score, r.rankers) for r in QUERIES["rrf_hybrid_all"](spark, str(tmp_path)).collect()}
    score = lambda *ranks: round(sum(1 / (60 + k) for k in ranks), 6)
    # 200 has no document and is ranked by vector alone; 300 is second to 100 by words, first by vector
    vector_only = {(200, 200): score(1), (200, 201): score(2), (200, 300): score(3), (200, 301): score(4)}
    assert got == {k: (v, 1) for k, v in vector_only.items()} | {(300, 100): (score(1), 1), (300, 300): (score(2, 1), 2), (300, 301): (score(2), 1), (300, 200): (score(3), 1), (300, 201): (score(4), 1)}


def test_noise_ranks_below_and_lags_need_nearness(spark):
    log = _log(spark, [("feat: x", ["a", "b"])] * 3 + [("chore: format", ["c", "d"])] * 3)
    assert [(r.file_a, r.rank) for r in H.change_coupling(log).orderBy("rank").collect()] == [("a", 1), ("c", 2)]
    near = _log(spark, [("x", ["a", "b"]), ("x", ["a", "b"]), ("x", ["a"]), ("x", ["b"])])
    assert H.lag_coupling(near, H.change_coupling(near, top=None), ["ts", "hash"]).first().lag_score > 1


def test_priors_equal_the_step_by_step_recurrence(spark):
    rng = random.Random(6)
    groups = [("x", sorted({rng.choice("abc") for _ in range(rng.randint(1, 2))})) for _ in range(25)]
    edges = spark.createDataFrame([("g", "a", "b", 0.7), ("g", "c", "a", 0.3), ("g", "z", "a", 0.5)], "graph_id string, src string, dst string, start double")
    got = {(r.src, r.dst): (r.alpha, r.beta) for r in H.edge_priors(edges, _log(spark, groups), ["ts", "hash"]).collect()}
    groups = [g for _, g in sorted(enumerate(groups), key=lambda x: x[0])]
    for s, d, p in (("a", "b", 0.7), ("c", "a", 0.3), ("z", "a", 0.5)):
        a, b = p * 15, (1 - p) * 15
        for _, files in groups:
            if s in files:
                a, b = a + (d in files), b + (d not in files)
            else:
                a, b = a * 0.995, b * 0.995
        assert got[s, d] == pytest.approx((a, b))


def test_layers_and_votes(spark):
    df = spark.createDataFrame([("src/api/x.ts",), ("a/types/b.ts",), ("plain",), (None,)], "path string")
    assert [r[0] for r in df.select(L.layer_of(F.col("path"))).collect()] == ["api", "types", None, None]
    votes = spark.createDataFrame([("d", "x")] * 3 + [("d", "y")] * 2 + [("e", "x"), ("e", "y"), ("f", None)], "g string, v string")
    assert {r.g: r.style for r in L.majority(votes, ["g"], "v").collect()} == {"d": "x", "e": "mixed"}


def test_knn_equals_brute_force_in_any_block_size(spark):
    rng = random.Random(7)
    vec = lambda: [rng.gauss(0, 1) for _ in range(4)]
    rows = [(i, vec()) for i in range(60)] + [(100, None), (101, [float("nan")] * 4), (102, [1.0])]
    v = spark.createDataFrame(rows, "id bigint, embedding array<float>")
    q = v.where("id % 20 = 0 AND id < 60").withColumnRenamed("id", "query")
    want = {}
    for i, a in rows[:60:20]:
        s = sorted(((-sum(x * y for x, y in zip(a, b, strict=True)), j) for j, b in rows[:60]))
        want[i] = [j for _, j in s[:3]]
    for block in (1, 100):
        got = {}
        for r in R.knn(q, v, 3, block).orderBy("query", "rank").collect():
            got.setdefault(r.query, []).append(r.id)
        assert got == want
    assert R.knn(q.limit(0), v, 3).count() == 0


def test_fusion_learns_and_falls_back(spark):
    rng = random.Random(8)
    rows = [("g", i % 2, float(i % 2) + rng.random() / 10, rng.random(), 0.0, 0.0) for i in range(80)] + [("one", 1, 1.0, 0.0, 0.0, 0.0), ("one", None, 1.0, 0.0, 0.0, 0.0)]
    ex = spark.createDataFrame(rows, "graph_id string, label int, lexical double, proximity double, coupling double, between double")
    got = {r.graph_id: r for r in M.fusion_weights(ex, "graph_id").collect()}
    assert got["g"].lexical > 0.8 and got["one"].lexical == 0.25 and got["one"].n_examples == 1


def test_latent_vectors_separate_groups(spark):
    rows = [("g", f"f{i}", f"n{(i % 2) * 10 + j}") for i in range(60) for j in range(6)]
    v = {r.item: r.vector for r in M.latent_vectors(spark.createDataFrame(rows, "graph_id string, item string, name string")).collect()}
    same = sum(a * b for a, b in zip(v["f0"], v["f2"], strict=True))
    apart = sum(a * b for a, b in zip(v["f0"], v["f1"], strict=True))
    assert same == pytest.approx(6, abs=1e-6) and apart == pytest.approx(0, abs=1e-6)


def test_partial_rebuild_equals_full(spark):
    old = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "src string, dst string")
    new = spark.createDataFrame([("a", "z"), ("c", "y"), ("d", "x")], "src string, dst string")
    h = lambda rows: spark.createDataFrame(rows, "path string, hash string")
    diff = T.hash_diff(h([("a", "1"), ("b", "1"), ("c", "1")]), h([("a", "2"), ("c", "1"), ("d", "1")]))
    assert {(r.path, r.status) for r in diff.collect()} == {("a", "changed"), ("b", "removed"), ("d", "added")}
    assert sorted(T.incremental(old, new, diff).collect()) == sorted(new.collect())
    files = h([("a", "2"), ("c", "1"), ("d", "1")])
    assert T.refresh_plan(diff, files, h([])).first().full and not T.refresh_plan(diff.limit(0), files, files).first().full


def test_budgets(spark):
    rows = spark.createDataFrame([("g", "a", 0, 5), ("g", "b", 3, 50), ("g", "c", 4, 20), ("g", "d", 9, 5)], "`group` string, section string, priority int, tokens int")
    assert {r.section for r in S.sections(rows, 30).collect() if r.kept} == {"a", "c", "d"}
    near = spark.createDataFrame([("g", "a", x, 0) for x in "xyz"] + [("g", "b", "x", 0)], "`group` string, item string, covered string, hops int")
    cost = spark.createDataFrame([("g", "a", 20), ("g", "b", 10)], "`group` string, item string, cost int")
    assert [r.item for r in S.greedy_cover(near, cost, 30).collect()] == ["a"]


def _taken(rows, budget):
    """Ids of the (id, must, tokens), in their order, that a plain loop takes."""
    left, out = budget, set()
    for i, must, n in rows:
        if must or n <= left:
            left -= n
            out.add(i)
    return out


def test_sections_of_large_groups(spark, monkeypatch):
    monkeypatch.setattr(S, "MOST_CANDIDATES", 10)
    rnd = random.Random(5)
    # g0 has sections that are always taken, in g1 they take more than there is, g3 is the group without a name
    first = {"g0": [0, 1, 2, 3, None], "g1": [1, 5], "g2": [3, 4], None: [3]}
    rows = [(g, f"{i:05d}", rnd.choice(p), rnd.choice([0, 1, 7, 30, 200, rnd.randint(1, 900)])) for i in range(3000) for g, p in first.items()]
    rows = [(g, s, 9 if g == "g0" and p in (0, 1, 2) and i % 160 else p, n) for i, (g, s, p, n) in enumerate(rows)]
    want = set()
    for g in first:
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[2] is None, r[2] or 0, r[1]))
        want |= {(g, s) for s in _taken([(s, p is not None and p <= 2, n) for _, s, p, n in mine], 20_000)}
    rnd.shuffle(rows)
    got = S.sections(spark.createDataFrame(rows, "`group` string, section string, priority int, tokens int").repartition(7), 20_000)
    assert got.dtypes == [("group", "string"), ("section", "string"), ("priority", "int"), ("tokens", "int"), ("kept", "boolean")]
    got = got.collect()
    assert sorted(map(str, rows)) == sorted(str((r.group, r.section, r.priority, r.tokens)) for r in got)
    assert {(r.group, r.section) for r in got if r.kept} == want
    zero = {g: {r.kept for r in got if r.group == g and r.tokens == 0 and (r.priority is None or r.priority > 2)} for g in first}
    assert zero == {"g0": {True}, "g1": {False}, "g2": {True}, None: {True}}


def test_budgets_of_odd_rows(spark):
    kinds = "`group` string, section string, priority int, tokens int"
    rows = [("g", "a", 0, None), ("g", "b", 3, None), ("g", "c", 3, 30), ("g", "d", 4, 1), ("h", "a", 3, 0), ("h", "b", 3, 31), ("i", "a", 2, 31), ("i", "b", 3, 0)]
    kept = lambda budget: {(r.group, r.section) for r in S.sections(spark.createDataFrame(rows, kinds), budget).collect() if r.kept}
    assert kept(30) == {("g", "a"), ("g", "c"), ("h", "a"), ("i", "a")}
    assert kept(0) == {("g", "a"), ("h", "a"), ("i", "a")}
    assert S.sections(spark.createDataFrame([], kinds), 30).count() == 0
    kinds = "`group` string, item string, file string, centrality double, is_type boolean, uses int, tokens int"
    assert S.knapsack(spark.createDataFrame([], kinds), 30).count() == 0
    items = spark.createDataFrame([("g", "a", "x", float("inf"), False, 1, 20), ("g", "b", "x", 9.0, False, 1, 11), ("g", "c", "y", 1.0, False, 1, 10)], kinds)
    assert {r.item: r.state for r in S.knapsack(items, 30).collect()} == {"a": "kept", "b": "deferred", "c": "kept"}


def test_knapsack_of_large_groups(spark, monkeypatch):
    monkeypatch.setattr(S, "MOST_CANDIDATES", 10)
    rnd = random.Random(6)
    # one file of g0 holds most items, values repeat, some are negative, lacking or no numbers
    rows = [(g, f"{i:05d}", rnd.choice(files), rnd.choice([None, float("nan"), -1.0, -0.0, 0.0, 0.5, 2.0, rnd.random()]), rnd.choice([True, False, None]), rnd.choice([1, 3]), rnd.choice([0, None, 10, 12, 40, rnd.randint(1, 3000)]))
            for i in range(2000) for g, files in (("g0", ["a"] * 20 + ["b", None]), ("g1", [f"{i % 500}"]), (None, ["c", "d"]))]
    want = set()
    for g in ("g0", "g1", None):
        ratio = {r[1]: (r[3] if r[3] is not None else float("nan")) * (1.3 if r[4] else 1.0) * (1 + 0.15 * (1 if r[5] == 1 else 2)) / r[6] for r in rows if r[0] == g and r[6]}
        place = lambda i: (ratio[i] != ratio[i], -ratio[i] if ratio[i] == ratio[i] else 0, i)
        file_of, tokens = {r[1]: r[2] for r in rows if r[0] == g}, {r[1]: r[6] for r in rows if r[0] == g}
        seen = set()
        for i in sorted(ratio, key=place):
            if file_of[i] in seen:
                ratio[i] *= 0.5
            seen.add(file_of[i])
        want |= {(g, i) for i in _taken([(i, False, tokens[i]) for i in sorted(ratio, key=place)], 4000)}
    rnd.shuffle(rows)
    items = spark.createDataFrame(rows, "`group` string, item string, file string, centrality double, is_type boolean, uses int, tokens int").repartition(7)
    got = S.knapsack(items, 4000)
    assert got.dtypes == [("group", "string"), ("item", "string"), ("file", "string"), ("tokens", "int"), ("state", "string")]
    got = got.collect()
    assert sorted(str((r[0], r[1], r[2], r[6])) for r in rows if r[6]) == sorted(str((r.group, r.item, r.file, r.tokens)) for r in got)
    assert {(r.group, r.item) for r in got if r.state == "kept"} == want and {r.state for r in got} == {"kept", "deferred"}


def test_barrels_and_exports(spark):
    e = spark.createDataFrame([("g", "m", "index", "a"), ("g", "m", "index", "b"), ("g", "m", "own", "c")], "graph_id string, src string, dst string, name string")
    re = spark.createDataFrame([("g", "index", "a", "real")], "graph_id string, node string, name string, target string")
    star = spark.createDataFrame([("g", "index", "rest")], "graph_id string, node string, target string")
    got = {(r.name, r.dst, r.is_barrel_routed) for r in E.route_barrels(e, re, star).collect()}
    assert got == {("a", "real", True), ("b", "rest", True), ("c", "own", False)}
