"""Problems 5 to 8 against brute force, reference tokenizers and round trips."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import bpe, conversations, lookalike, packing

ENTRIES = "entry_id bigint, session_id string, uuid string, parent_uuid string, entry_type string, role string, turn_index int, ts timestamp, is_sidechain boolean, content string, k int, n int"
T0 = datetime(2024, 1, 1)


def _brute_conversations(rows):
    by = {}
    for e, s, u, p, kind, role, t, ts, side, content, *_ in rows:
        kind, role = (kind or "").strip().lower(), (role or "").strip().lower()
        who = {"user": "user", "human": "user", "assistant": "assistant", "model": "assistant"}.get(role or kind)
        if s is None or side or kind not in ("", "user", "assistant", "message") or who is None:
            continue
        known = by.setdefault(s, {})
        if u not in known or known[u][0] > e:
            known[u] = (e, u, p, who, t, ts, content)
    out = []
    for s, msgs in by.items():
        m = list(msgs.values())
        turns = all(x[4] is not None for x in m)
        if not turns and any(x[5] is None for x in m):
            continue
        m.sort(key=lambda x: (x[4] if turns else x[5], x[0]))
        if turns and [x[4] for x in m] != list(range(len(m))):
            continue
        who = [x[3] for x in m]
        if who[0] != "user" or any(a == "user" and b != "assistant" for a, b in zip(who, [*who[1:], "end"], strict=True)):
            continue
        if any(not (x[6] or "").strip("​﻿\xa0 \n\t") for x in m) or any(x[2] and x[2] not in msgs for x in m):
            continue
        out += [(s, i, x[0]) for i, x in enumerate(m)]
    return sorted(out)


@pytest.mark.parametrize("hot", [False, True])
def test_conversations_equal_brute_force(spark, request, hot):
    if hot:
        request.getfixturevalue("no_broadcast")
    rng = random.Random(4)
    rows, e = [], 0
    for s in range(80):
        n, timed = rng.randint(1, 6), s % 3 == 0
        for i in range(n):
            e += 1
            role = rng.choice(["user", " User", "HUMAN"]) if i % 2 == 0 else rng.choice(["assistant", "Model "])
            if rng.random() < 0.03:
                role = rng.choice(["user", "assistant", "system"])
            kind = rng.choice([None, "message", role.strip().lower().replace("human", "user").replace("model", "assistant")])
            text = rng.choice(["hi"] * 30 + ["​", None, "", "\xa0"])
            parent = rng.choice([None, "", f"u{i - 1}" if i else None, "nowhere" if rng.random() < 0.05 else None])
            row = (e, f"s{s}", f"u{i}", parent, kind, role, None if timed and rng.random() < 0.5 else i, T0 + timedelta(seconds=i), rng.choice([None, False]), text, 1, 1)
            if rng.random() < 0.95:
                rows.append(row)
            if rng.random() < 0.2:
                rows.append((e + 10_000, *row[1:]))
            if rng.random() < 0.1:
                rows.append((e + 20_000, f"s{s}", f"side{i}", None, rng.choice(["summary", "user"]), "user", i, T0, True, "x", 1, 1))
    rng.shuffle(rows)
    got = sorted((r.session_id, r.msg_pos, r.entry_id) for r in conversations.conversations(spark.createDataFrame(rows, ENTRIES)).collect())
    assert got == _brute_conversations(rows) and got


def test_fold_log_drops_deleted_and_keeps_last_edit(spark):
    df = spark.createDataFrame([("a", 1, "first", False), ("a", 2, "second", None), ("b", 1, "x", False), ("b", 2, None, True), ("c", None, "y", False)], "key string, version int, text string, gone boolean")
    got = {r.key: r.text for r in conversations.fold_log(df, ["key"], "version", "gone").collect()}
    assert got == {"a": "second", "c": "y"}


def test_no_entries(spark):
    assert conversations.conversations(spark.createDataFrame([], ENTRIES)).count() == 0


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{bpe.TOKENIZERS}/{bpe.VOCABULARY}.json")
    t.encode_special_tokens = True
    return t


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet="abtheing  \n'sÀé日", max_size=200))
def test_ids_equal_the_reference_and_decode(reference, text):
    own = bpe.encoder()
    ids = own.encode(text)
    assert ids == reference.encode(text, add_special_tokens=False).ids
    assert own.decode(ids) == text


def test_very_long_pieces(reference):
    rng = random.Random(5)
    for text in ("a" * 50_000, "".join(rng.choice("abcdefgh") for _ in range(50_000)), "<|endoftext|>" * 3, " " * 5000):
        assert bpe.encoder().encode(text) == reference.encode(text, add_special_tokens=False).ids


def test_encoded_rows(spark):
    df = spark.createDataFrame([(1, "hello world", 0), (2, "", 0), (3, None, 0), (None, "x", 0), (1, "hello world", 0)], "doc_id bigint, text string, ids int")
    rows = bpe.encoded(df, "doc_id", "text")
    assert sorted((r.doc_id or 0, list(r.ids)) for r in rows.collect()) == [(0, [87]), (1, [31373, 995]), (1, [31373, 995]), (2, []), (3, [])]
    back = {r.doc_id: r.text for r in bpe.decoded(rows.where("doc_id IS NOT NULL"), "doc_id").collect()}
    assert back == {1: "hello world", 2: "", 3: ""}
    assert bpe.encoded(df.limit(0), "doc_id", "text").count() == 0


def _check_packing(rows, lengths, capacity):
    seen, fill = {}, {}
    for r in rows:
        seen.setdefault(r.doc_id, []).append((r.token_start, r.n_tokens))
        fill.setdefault(r.container, []).append((r.container_offset, r.n_tokens))
    assert seen.keys() == lengths.keys()
    for k, parts in seen.items():
        at = 0
        for start, n in sorted(parts):
            assert start == at and n <= capacity
            at += n
        assert at == (lengths[k] or 0) and len(parts) == max(1, -(-at // capacity))
    for parts in fill.values():
        at = 0
        for offset, n in sorted(p for p in parts if p[1]):
            assert offset == at
            at += n
        assert at <= capacity
    return len(fill)


@pytest.mark.parametrize("seed", range(4))
def test_packing_is_complete_and_tight(spark, seed):
    rng = random.Random(seed)
    lengths = {i: rng.choice([None, 0, rng.randint(1, 60), rng.randint(1, 20), rng.randint(1, 400), 100]) for i in range(400)}
    df = spark.createDataFrame(list(lengths.items()), "doc_id bigint, n_tokens bigint")
    rows = packing.packed(df, "doc_id", [("one", 100), ("two", 256), ("none", 0), ("null", None)]).collect()
    for name, capacity in (("one", 100), ("two", 256)):
        used = _check_packing([r for r in rows if r.budget_name == name], lengths, capacity)
        least = -(-sum(n or 0 for n in lengths.values()) // capacity)
        assert used <= 1.03 * least + 1
    assert {r.budget_name for r in rows} == {"one", "two"}


def test_packing_of_nothing_and_of_empty_texts(spark):
    schema = "doc_id bigint, n_tokens bigint"
    assert packing.packed(spark.createDataFrame([], schema), "doc_id", [("a", 10)]).count() == 0
    assert packing.packed(spark.createDataFrame([(1, 5)], schema), "doc_id", []).count() == 0
    assert packing.packed(spark.createDataFrame([(1, 0), (2, None)], schema), "doc_id", [("a", 10)]).count() == 2


def _plan_is_whole(plan, counts, capacity):
    placed = {}
    for items, times in plan:
        assert 0 < sum(s * n for s, n in items) <= capacity and times > 0
        for s, n in items:
            placed[s] = placed.get(s, 0) + n * times
    assert placed == counts


def test_plan_stays_small_for_many_items():
    counts = {s: 10**9 + s for s in range(1, 513)}
    plan = packing.plan_containers(counts, 512)
    _plan_is_whole(plan, counts, 512)
    assert len(plan) <= 3 * 512


def test_tiers_steer_the_plan():
    """Long windows are filled from shorter tiers; with one tier there is none to fill from, and the plan is another."""
    counts = {60: 3, 30: 2, 27: 2, 20: 3, 9: 4, 3: 5}
    plan = packing.plan_containers(counts, 100)
    _plan_is_whole(plan, counts, 100)
    assert [items[0][0] for items, _ in plan][:1] == [60]
    windows = packing.pack_tier(packing._Stock(counts, 50, 100), 100)
    assert windows == [([(60, 1)], 3, 40)]
    filled = packing.fill_gaps(windows, packing._Stock(counts, 0, 50))
    assert sum(t for _, t in filled) == 3 and all(sum(s * n for s, n in p) >= 99 for p, _ in filled)
    rng = random.Random(8)
    many = {s: rng.randint(1, 50) * (1000 // s) for s in range(1, 1001, 3)}
    plans = [packing.plan_containers(many, 1000, tiers) for tiers in (1, 4)]
    for p in plans:
        _plan_is_whole(p, many, 1000)
        assert sum(t for _, t in p) <= 1.01 * sum(s * n for s, n in many.items()) / 1000 + 1
    assert plans[0] != plans[1]


def test_layout_of_large_capacities():
    counts = {b: {700_000: 2, 1: 10, 3: 2} for b in range(4)}
    layout = packing.Layout(counts, [2_000_000] * 4)
    import numpy as np

    size, rank = np.array([700_000, 700_000, 1, 3]), np.array([0, 1, 9, 1])
    for b in range(4):
        container, offset, _ = layout.place(np.full(4, b), size, rank)
        assert container.tolist() == [0] * 4 and len(set(offset.tolist())) == 4


ALIKE = ["paypal", "pаypаl", "ｐａｙｐａｌ", "pay​pal", "p­aypal", "раураl"]
UNLIKE = ["Paypal", "paypál", "paypa1", "pay pal", "paypal.", "paypaⓛ", "paypaˡ"]


def test_canonical_forms():
    own = lookalike.Canonicaliser(lookalike.spellings())
    assert {own.canonical(x) for x in ALIKE} == {"paypal"}
    forms = [own.canonical(x) for x in UNLIKE]
    assert len({*forms, "paypal"}) == len(UNLIKE) + 1
    assert own.canonical("é ﬁ Ⅷ　x y") == own.canonical("é fi VIII x y")
    assert own.canonical("x²") != own.canonical("x2") and own.canonical("①") != own.canonical("1")


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_canonical_form_is_its_own(text):
    own = lookalike.Canonicaliser(lookalike.spellings())
    once = own.canonical(text)
    assert own.canonical(once) == once and lookalike.by_table(once) == lookalike.by_table(text)


PIECES = ["модуль", "мoдyль", "граф", "ｇｒａф", "вызов", "BЫЗOB", "paypal", "раураl", "e\u0301", "é", "ﬁ", "fi", "\u200b", "\xad", "\u0323", "\u0301", "\x01", " ", "\xa0", "-", "－", "≠", "=\u0338", "\ufe0f", "\U000e0001", "ΟΔΟΣ", "OΔOΣ", "q", "7", "Ⅷ", "ㅤ"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=6), st.lists(st.sampled_from(PIECES), max_size=6))
def test_canonical_forms_are_equal_exactly_if_looks_are(left, right):
    own = lookalike.Canonicaliser(lookalike.spellings())
    a, b = "".join(left), "".join(right)
    assert (own.canonical(a) == own.canonical(b)) == (lookalike.by_table(a) == lookalike.by_table(b))
    assert own.canonical(own.canonical(a)) == own.canonical(a)


def test_words_take_the_spelling_that_the_automaton_finds():
    """Without the trie the table would leave a mixture of scripts."""
    own = lookalike.Canonicaliser(lookalike.spellings())
    plain, mixed = "система была после", "cиcтeмa былa пo\u200bcлe"
    assert own.canonical(mixed) == own.canonical(plain) != lookalike.by_table(mixed)
    assert own.canonical(mixed) == plain
    assert lookalike.Canonicaliser(lookalike.SpellingTrie([])).canonical(mixed) == lookalike.by_table(mixed)


def test_trie_finds_nearest_spelling_within_budget():
    trie = lookalike.SpellingTrie(iter(["cat", "car", "cart"]))
    assert trie.match("сat") == "cat" and trie.match("cab") is None
    assert trie.match("cab", 1.0) == "car" and trie.match("carts", 1.0) == "cart"
    assert trie.match("ca", 1.0) == "car" and trie.match("crt", 1.0) == "cart" and trie.match("c", 1.0) is None


@pytest.mark.parametrize("hot", [False, True])
def test_classes_say_how_many_rows_look_alike(spark, request, monkeypatch, hot):
    if hot:
        request.getfixturevalue("no_broadcast")
        monkeypatch.setattr(lookalike, "CHUNK", 2)
    texts = [*ALIKE, *ALIKE[:2], *UNLIKE, UNLIKE[0], None, "", "  "]
    df = spark.createDataFrame([(i, t, b"x") for i, t in enumerate(texts)], "doc_id bigint, text string, look binary")
    got = {r.doc_id: (r.class_id, r.links) for r in lookalike.lookalike_classes(df, "doc_id", "text").collect()}
    pairs = lookalike.lookalike_pairs(df, "doc_id", "text").collect()
    alike = [i for i, t in enumerate(texts) if t in ALIKE]
    assert got == {i: (0, sum(texts[j] != texts[i] for j in alike)) for i in alike}
    assert sum(n for _, n in got.values()) == 2 * len(pairs) == 2 * len({(r.a, r.b) for r in pairs})
    assert lookalike.lookalike_classes(df.limit(0), "doc_id", "text").count() == 0


@pytest.mark.parametrize("hot", [False, True])
def test_pairs_differ_but_look_alike(spark, request, hot):
    if hot:
        request.getfixturevalue("no_broadcast")
    texts = [*ALIKE, *ALIKE[:2], *UNLIKE, None, "", "  ", "​", "\xa0​"]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, b"x") for i, t in rows], "doc_id bigint, text string, look binary")
    got = sorted((r.a, r.b) for r in lookalike.lookalike_pairs(df, "doc_id", "text").collect())
    alike = {i for i, t in rows if t in ALIKE}
    assert got == sorted((a, b) for a in alike for b in alike if a < b and texts[a] != texts[b])
    assert lookalike.lookalike_pairs(df.limit(0), "doc_id", "text").count() == 0
