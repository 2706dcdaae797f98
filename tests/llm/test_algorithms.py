"""Problems 1 to 4 against brute force, with dirty, empty, tied and skewed inputs."""

from __future__ import annotations

import math
import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import cooccur, distinctive, ranking, runs
from sparkloom.shared import durable

pytestmark = pytest.mark.usefixtures("spark")
SYMBOLS = "id bigint, name string, body_tokens array<string>, import_names array<string>, indexed_at timestamp, term string, df int"


def _symbols(spark, rows):
    return spark.createDataFrame([(i, n, b, m, None, "clash", 0) for i, n, b, m in rows], SYMBOLS)


@pytest.mark.parametrize("hot", [False, True])
def test_tf_idf_equals_brute_force(spark, request, hot):
    if hot:
        request.getfixturevalue("no_broadcast")
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "omega"]
    rows = [(i, "theWord", [rng.choice(words) for _ in range(rng.randint(0, 9))], None if i % 3 else ["alpha", None, ""]) for i in range(40)]
    got = {(r.symbol_id, r.term): (r.tf, r.n_terms, r.df, r.score) for r in distinctive.tf_idf(distinctive.symbol_terms(_symbols(spark, rows)), "symbol_id", "terms").collect()}
    docs = {i: Counter(["the", "word", *b, *([x for x in m or [] if x])]) for i, _, b, m in rows}
    df = Counter(w for d in docs.values() for w in d)
    assert got.keys() == {(i, w) for i, d in docs.items() for w in d}
    for (i, w), (tf, n, f, score) in got.items():
        assert (tf, n, f) == (docs[i][w], docs[i].total(), df[w])
        assert score == pytest.approx(tf / n * (math.log((1 + len(docs)) / (1 + f)) + 1))


def test_words_break_at_case_changes_and_latest_row_holds(spark):
    from datetime import datetime

    rows = [(1, "old", ["x"], None, datetime(2020, 1, 1), "", 0), (1, "parseHTTPServer_v2", ["URLViya", "kebab-case", "é", "A", None, ""], None, datetime(2021, 1, 1), "", 0), (1, "undated", None, None, None, "", 0), (None, "gone", None, None, None, "", 0), (2, None, None, None, None, "", 0)]
    got = {r.symbol_id: sorted(r.terms) for r in distinctive.symbol_terms(spark.createDataFrame(rows, SYMBOLS)).collect()}
    assert got == {1: sorted(["parse", "http", "server", "url", "viya", "kebab", "case"]), 2: []}


def test_typical_terms_need_frequency_share_and_few_symbols(spark):
    rows = [(1, None, ["rare"] * 3, None), (2, None, ["rare"] * 2 + ["x1", "yy"], None), (3, None, ["own"] * 5, None), (4, None, ["rare"] * 3 + ["fill"] * 60, None)]
    got = {(r.symbol_id, r.term) for r in distinctive.typical_terms(_symbols(spark, rows)).collect()}
    assert got == {(1, "rare")}


def test_empty_tables_give_empty_results(spark):
    assert distinctive.typical_terms(_symbols(spark, [])).count() == 0
    baskets = spark.createDataFrame([], "graph_id string, hash string, items array<string>")
    assert cooccur.association(baskets, "graph_id", "hash", "items").count() == 0


@pytest.mark.parametrize(("chunk", "hot"), [(2, False), (3, True), (100, False)])
def test_association_equals_brute_force(spark, request, chunk, hot):
    if hot:
        request.getfixturevalue("no_broadcast")
    rng = random.Random(2)
    baskets = [("g" if i % 2 else "h", str(i), sorted({f"f{min(rng.randint(0, 30), rng.randint(0, 30))}" for _ in range(rng.randint(0, 40))})) for i in range(60)]
    df = spark.createDataFrame(baskets, "graph_id string, hash string, items array<string>")
    got = {(r.graph_id, r.a, r.b): r for r in cooccur.association(df, "graph_id", "hash", "items", chunk=chunk).collect()}
    together, single, n = Counter(), Counter(), Counter(g for g, _, _ in baskets)
    for g, _, items in baskets:
        single.update((g, x) for x in items)
        together.update((g, a, b) for a, b in combinations(items, 2))
    assert {k: r.together for k, r in got.items()} == dict(together)
    for (g, a, b), r in got.items():
        assert (r.n_a, r.n_b, r.n) == (single[g, a], single[g, b], n[g])
        assert r.lift == pytest.approx(r.together * n[g] / (r.n_a * r.n_b))
        assert -1.0001 <= r.npmi <= 1.0001


def test_commit_baskets_unite_spellings_and_repeats(spark):
    schema = "graph_id string, hash string, files array<string>, ingested_at timestamp, items string"
    rows = [("g", "1", ["a/b.ts", "/workspace/a//b.ts", " ./a/c.ts ", None, " ", ""], None, ""), ("g", "1", ["a\\b.ts", "a/x/../c.ts"], None, ""), ("g", "2", ["only.ts"], None, ""), ("g", None, ["a", "b"], None, ""), ("g", "3", None, None, ""), ("g", "4", [f"{i:02}" for i in range(31)], None, "")]
    got = {r.hash: r["items"] for r in cooccur.commit_baskets(spark.createDataFrame(rows, schema)).collect()}
    assert got["1"] == ["a/b.ts", "a/c.ts"] and got.keys() == {"1", "4"} and len(got["4"]) == 31
    assert [r.hash for r in cooccur.commit_baskets(spark.createDataFrame(rows, schema), most=30).collect()] == ["1"]


def test_a_huge_basket_is_dealt_out(spark):
    """One basket of 100,000 items: its products are complete and no task holds much more than its share."""
    n, chunk = 100_000, 1024
    one = spark.range(1).select(F.lit("g").alias("g"), F.sequence(F.lit(1), F.lit(n)).alias("ids"))
    pieces = durable(cooccur.basket_chunks(one, ["g"], "ids", chunk).repartition(16, "g", "i"))
    m = -(-n // chunk)
    products = cooccur.chunk_products(pieces.hint("merge"), ["g"])
    per = products.select(F.spark_partition_id().alias("p"), F.size("left").cast("long").alias("l"), F.size("right").cast("long").alias("r")).groupBy("p").agg(F.sum(F.col("l") * F.col("r")).alias("pairs"), F.count("*").alias("rows")).collect()
    inside = pieces.agg(F.sum(F.size("chunk") * (F.size("chunk") - 1) / 2)).first()[0]
    assert sum(r.rows for r in per) == m * (m - 1) // 2
    assert sum(r.pairs for r in per) + inside == n * (n - 1) // 2
    assert len(per) > 1 and max(r.pairs for r in per) < n * n / 4


def test_items_whose_hashes_collide_get_another_seed(spark, monkeypatch):
    baskets = spark.createDataFrame([("g", "1", ["a", "b", "c"]), ("g", "2", ["a", "c"])], "g string, h string, items array<string>")
    real = F.xxhash64
    monkeypatch.setattr(cooccur.F, "xxhash64", lambda seed, *c: F.when(seed == 0, F.lit(7).cast("long")).otherwise(real(seed, *c)))
    got = {(r.a, r.b): r.together for r in cooccur.association(baskets, "g", "h", "items").collect()}
    assert got == {("a", "b"): 1, ("a", "c"): 2, ("b", "c"): 1}


def test_report_is_read_in_either_order_and_latest(spark):
    from datetime import datetime

    pairs = spark.createDataFrame([("g", "a", "b", 4)], "graph_id string, a string, b string, together bigint")
    report = spark.createDataFrame([("g", "b", "./a", 3, 30.0, datetime(2020, 1, 1)), ("g", "a", "b", 4, float("nan"), datetime(2021, 1, 1)), ("g", "a", "a", 9, 1.0, None)], "graph_id string, file_a string, file_b string, co_changes int, confidence double, computed_at timestamp")
    r = cooccur.settle_report(pairs, report).first()
    assert (r.reported, r.agrees, r.reported_confidence) == (4, True, None)


def _brute_runs(rows):
    out, by = [], {}
    for s, p, sig in rows:
        by.setdefault(s, {})[p] = sig
    for s, at in by.items():
        run = []
        for p in sorted(at):
            if run and at[run[-1]] == at[p]:
                run.append(p)
            else:
                if run:
                    out.append((s, run[0], run[-1], len(run)))
                run = [p]
        out.append((s, run[0], run[-1], len(run)))
    return sorted(out)


@pytest.mark.parametrize(("chunks", "batch", "wide"), [(1, 7, 1), (3, 1, 1), (7, 1000, 10**15), (40, 5, -(10**12))])
def test_runs_equal_brute_force_at_every_chunk_width(spark, chunks, batch, wide):
    """Also with positions of 64 bits, runs longer than a chunk, batches of one row and repeated rows."""
    rng = random.Random(chunks)
    rows = [(rng.choice("sstu"), rng.randint(-9, 60) * wide, None) for _ in range(150)]
    rows = [(s, p, (p // wide // rng.choice([3, 5])) % 2 or None) for s, p, _ in dict.fromkeys(rows)] + [("long", p * wide, 1) for p in range(90)]
    twice = rows + rows[:40] + rows[-60:]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame([(s, p, g, None) for s, p, g in twice], "k string, pos bigint, sig int, at timestamp")
        got = sorted((r.k, r.first, r.last, r.events) for r in runs.collapse_runs(df, "k", "pos", ["sig"], "at", chunks).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    assert got == _brute_runs(rows)


def test_times_of_a_run_are_the_known_ones(spark):
    from datetime import datetime

    at = lambda h: datetime(2024, 1, 1, h)
    rows = [("s", 1, 1, at(3)), ("s", 1, 1, at(2)), ("s", 2, 1, None), ("s", 3, 1, at(5)), ("s", 4, 2, None), ("t", None, 1, at(1)), (None, 1, 1, at(1))]
    df = spark.createDataFrame(rows, "k string, pos int, sig int, at timestamp")
    for chunks in (1, 4):
        got = sorted((r.first, r.last, r.events, r.started_at, r.ended_at) for r in runs.collapse_runs(df, "k", "pos", ["sig"], "at", chunks).collect())
        assert got == [(1, 3, 3, at(2), at(5)), (4, 4, 1, None, None)]
    assert runs.collapse_runs(df.limit(0), "k", "pos", ["sig"], "at").count() == 0


def test_same_turns_whatever_spelling(spark):
    schema = "session_id string, turn_index int, ts timestamp, tools array<struct<name string, command string, path string>>, file_paths array<string>"
    rows = [
        ("s", 0, None, [("Bash", "CI=1 npm  run -q lint 2>&1 | tail", None)], None),
        ("s", 1, None, [], []),
        ("s", 2, None, [(" bash ", "npm run lint > /tmp/x; echo", None)], []),
        ("s", 3, None, None, None),
        ("s", 4, None, [("Read", None, " /workspace/a//b.ts")], None),
        ("s", 6, None, [("READ", None, None)], ["a/b.ts", "./a/b.ts"]),
        ("s", 7, None, [("read", None, None)], ["a/B.ts"]),
        ("s", None, None, [("read", None, None)], None),
        (None, 1, None, [("read", None, None)], None),
        ("t", 1, None, None, ["x"]),
        ("t", 2, None, None, ["x", None, " "]),
    ]
    got = {(r.session_id, r.first_turn, r.last_turn, r.turns) for r in runs.repeated_turns(spark.createDataFrame(rows, schema)).collect()}
    assert got == {("s", 0, 2, 2), ("s", 4, 6, 2), ("t", 1, 2, 2)}


def _ranking_tables(spark, rows):
    ex = spark.createDataFrame(rows, "example_id bigint, query_id bigint, graph_id string, candidate string, features array<double>, label int, n_items int")
    files = spark.createDataFrame([("a", 0.5, 1.0, None), ("b", float("nan"), 2.0, None), ("c", 0.1, -1.0, None), (None, 9.0, 9.0, None)], "path string, authority double, betweenness double, updated_at timestamp")
    return ex, files


@pytest.mark.parametrize("hot", [False, True])
def test_winners_equal_brute_force(spark, request, hot):
    if hot:
        request.getfixturevalue("no_broadcast")
    rng = random.Random(3)
    value = lambda: rng.choice([0.0, 1.0, 2.0, 3.0, 1e6, -1.0, float("nan"), float("inf"), None])
    rows = [(i, i // 3, "g", rng.choice(["a", "b", "c", "unknown", None]), rng.choice([None, [value() for _ in range(rng.randint(0, 4))], [5.0, 5.0 + i % 2, 5.0, 5.0]]), None, 7) for i in range(120)]
    ex, files = _ranking_tables(spark, rows + rows[:20])
    got = {(r.query_id, r.example_id) for r in ranking.clear_winners(ex, files).collect()}
    known = {"a": (0.5, 1.0), "b": (None, 2.0), "c": (0.1, None)}
    ok = lambda v: v if v is not None and math.isfinite(v) and v >= 0 else -1.0
    score = {e: [ok(v) for v in [*(((f or []) + [None] * 4)[:4]), *known.get(c, (None, None))]] for e, q, g, c, f, *_ in rows}
    want = set()
    for e, q, *_ in rows:
        others = [score[o] for o, p, *_ in rows if p == q and o != e]
        if all(sum(a > b for a, b in zip(score[e], o, strict=True)) > 3 for o in others):
            want.add((q, e))
    assert got == want and want


def _groups(seed, groups=150, items=20):
    """Groups with one item that is good at five of six scores, in scales a thousandfold apart, and anyhow at the other; it has the greatest id."""
    rng, rows = random.Random(seed), []
    for g in range(groups):
        bad = rng.randrange(6)
        for i in range(items):
            x = [rng.random() for _ in range(6)] if i < items - 1 else [rng.random() if k == bad else 0.9 + 0.1 * rng.random() for k in range(6)]
            rows.append((g, g * items + i, *[v * 10.0 ** (3 * k) for k, v in enumerate(x)]))
    return rows


def test_first_by_closeness_is_mostly_the_first_by_majority(spark):
    names = [f"s{k}" for k in range(6)]
    rows = _groups(11)
    df = spark.createDataFrame(rows, "g bigint, i bigint, " + ", ".join(f"{n} double" for n in names))
    near = ranking.ideal_point(df, "g", "i", names)
    got = {r.g: (r.i, r.tries) for r in ranking.majority_first(near, "g", "i", names).collect()}
    by = {}
    for g, i, *x in rows:
        by.setdefault(g, []).append((i, x))
    want = {g: i for g, m in by.items() for i, x in m if all(sum(a > b for a, b in zip(x, y, strict=True)) > 3 for j, y in m if j != i)}
    assert {g: i for g, (i, _) in got.items()} == want
    # the distances do the work: without them the first try would be the least id, which here is never the one
    assert len(want) > 100 and sum(t == 1 for _, t in got.values()) >= 0.8 * len(want)


def test_cycles_have_no_first_and_chains_end_in_theirs(spark):
    names = ["a", "b", "c"]
    cycle = [(1, 1, 3.0, 2.0, 1.0), (1, 2, 2.0, 1.0, 3.0), (1, 3, 1.0, 3.0, 2.0)]
    chain = [(2, i, float(i), float(i), 0.0) for i in range(30)]
    df = spark.createDataFrame(cycle + chain + [(3, 7, None, None, None)], "g bigint, i bigint, a double, b double, c double")
    against = df.withColumn("closeness", F.when(F.col("g") == 2, -F.col("i").cast("double")).otherwise(0.5))
    got = {r.g: r.i for r in ranking.majority_first(against, "g", "i", names).collect()}
    assert got == {2: 29, 3: 7}


def test_ranking_places_every_example_once_and_no_score_rules(spark):
    rows = [(1, 1, "g", "a", [1.0, 1.0, 1.0, 1.0], 1, 0), (2, 1, "g", "a", [1e9, 0.0, 0.0, 0.0], 0, 0), (3, 1, None, "b", [0.5, 0.5, 0.5, 0.5], 0, 0), (4, 2, "g", None, None, 0, 0)]
    ex, files = _ranking_tables(spark, rows)
    w = spark.createDataFrame([("g", 25.0, None, float("nan"), 0.0, 3, None)], "graph_id string, lambda_l double, lambda_g double, lambda_t double, lambda_b double, n_examples int, trained_at timestamp")
    got = {(r.query_id, r.place): r.example_id for r in ranking.ranked_candidates(ex, files, w).collect()}
    assert got[1, 0] == 1 and got[2, 0] == 4 and len(got) == 4


def test_ranking_of_nothing(spark):
    ex, files = _ranking_tables(spark, [])
    assert ranking.clear_winners(ex, files).count() == 0
