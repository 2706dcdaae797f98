"""Graph kernels against closed forms and brute-force twins on small random graphs."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from sparkloom.operators import kernels as K


def _graph(pairs, w=None):
    names = sorted({x for p in pairs for x in p})
    at = {v: i for i, v in enumerate(names)}
    return names, len(names), np.array([at[a] for a, _ in pairs]), np.array([at[b] for _, b in pairs]), np.array(w or [1.0] * len(pairs))


def _random(seed, n=9, p=0.25):
    rng = random.Random(seed)
    pairs = [(a, b) for a in range(n) for b in range(n) if a != b and rng.random() < p]
    return n, np.array([a for a, _ in pairs] or [0]), np.array([b for _, b in pairs] or [1]), pairs or [(0, 1)]


@pytest.mark.parametrize(("pairs", "want"), [
    ([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e")], {"a": 0, "b": 0.75, "c": 1, "d": 0.75, "e": 0}),
    ([("a", "m"), ("b", "m"), ("m", "x"), ("m", "y")], {"m": 1, "a": 0, "b": 0, "x": 0, "y": 0}),
    ([("a", "p"), ("p", "x"), ("a", "q"), ("q", "x")], {"p": 1, "q": 1, "a": 0, "x": 0}),
])
def test_betweenness_closed_forms(pairs, want):
    names, n, src, dst, _ = _graph(pairs)
    assert dict(zip(names, K.betweenness(n, src, dst).tolist(), strict=True)) == pytest.approx(want)


def test_bottleneck_project():
    pairs = [(f"f{i}", "handler") for i in range(1, 5)] + [("handler", "router"), ("router", "db"), ("router", "cache"), ("db", "utils"), ("cache", "utils")]
    names, n, src, dst, w = _graph(pairs)
    auth, _ = K.hits(n, src, dst, w)
    assert auth.argmax() == names.index("handler") or auth.max() == 1.0
    assert {(names[v], u) for v, u, _ in K.chokepoints(n, src, dst)} == {("handler", 4), ("router", 5), ("db", 6), ("cache", 6)}


def _reach(n, pairs):
    r = np.zeros((n, n), bool)
    for a, b in pairs:
        r[a, b] = True
    for k in range(n):
        r |= np.outer(r[:, k], r[k])
    return r


@pytest.mark.parametrize("seed", range(12))
def test_against_twins(seed):
    n, src, dst, pairs = _random(seed)
    r = _reach(n, pairs)
    label = K.strong_components(n, src, dst)
    for a, b in itertools.combinations(range(n), 2):
        assert (label[a] == label[b]) == bool(r[a, b] and r[b, a])
    off = r & ~np.eye(n, dtype=bool)
    assert K.reach_counts(n, src, dst) == off.sum(1).tolist()
    back = set(K.feedback_arcs(n, src, dst))
    left = _reach(n, [p for p in pairs if p not in back])
    assert not left.diagonal().any()
    for c in K.cycles(n, src, dst):
        assert all(b in K.neighbours(n, src, dst)[a] for a, b in zip(c, c[1:] + c[:1], strict=True)) and c[0] == min(c)
    idom = K.dominators(n, src, dst, 0)
    for v in idom:
        for d in range(n):
            if d not in (0, v):
                cut = _reach(n, [p for p in pairs if d not in p])
                chain, x = set(), v
                while x != 0:
                    x = idom[x]
                    chain.add(x)
                assert (d in chain) == (v != 0 and not cut[0, v])
    chain = K.critical_chain(n, src, dst)
    assert all(r[a, b] for a, b in zip(chain, chain[1:], strict=False))


@pytest.mark.parametrize("seed", range(6))
def test_paths_are_cheapest_and_unlike(seed):
    n, src, dst, pairs = _random(seed, 7, 0.35)
    rng = random.Random(seed)
    w = np.array([rng.uniform(0.1, 1) for _ in pairs])
    best = {}
    for k in range(2, n + 1):
        for p in itertools.permutations(range(n), k):
            if p[0] == 0 and p[-1] == n - 1 and all(x in pairs for x in zip(p, p[1:], strict=False)):
                best[p] = sum(-np.log(w[pairs.index(x)]) for x in zip(p, p[1:], strict=False))
    got = K.diverse_paths(n, src, dst, w, 0, n - 1)
    assert bool(got) == bool(best)
    if got:
        assert got[0][0] == pytest.approx(min(best.values()))
        assert all(best[tuple(p)] == pytest.approx(c) for c, p in got) and len({tuple(p) for _, p in got}) == len(got)


def test_flow_mass_is_kept():
    n, src, dst, pairs = _random(3)
    visits, absorbed, rest = K.absorbing_flow(n, src, dst, np.ones(len(pairs)), 0, {n - 1})
    assert absorbed.sum() + rest == pytest.approx(1.0, abs=1e-3) and visits[0] >= 1


def test_single_and_empty_graphs():
    none = np.array([], int)
    assert K.hits(1, none, none, none.astype(float))[0].tolist() == [0.5]
    assert K.betweenness(0, none, none).tolist() == [] and K.strong_components(0, none, none) == [] and K.critical_chain(0, none, none) == []
    assert K.topology(0, none, none)["components"] == 0 and K.feedback_arcs(0, none, none) == []


def test_communities_find_two_cliques():
    pairs = [(a, b) for g in (range(4), range(4, 8)) for a in g for b in g if a < b] + [(3, 4)]
    src, dst = np.array([a for a, _ in pairs]), np.array([b for _, b in pairs])
    assert K.communities(8, src, dst, list(range(8)), 1.0) == [0] * 4 + [4] * 4
