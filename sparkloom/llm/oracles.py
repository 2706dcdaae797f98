"""DuckDB SQL for the queries that SQL can express, written apart from the operators."""

from __future__ import annotations

_PATH = """regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(regexp_replace({0}, '^\\s+|\\s+$', '', 'g'), chr(92), '/'), '/(\\.?/)+', '/', 'g'), '^(\\./)+|/\\.?$|^\\.$', '', 'g'), '^/workspace(/|$)', ''), '^/', '')"""


def _path(column: str) -> str:
    return "nullif(" + _PATH.replace("{0}", column) + ", '')"


_TERMS = """
held AS (SELECT id, name, body_tokens, import_names FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC NULLS LAST) rn FROM symbols WHERE id IS NOT NULL) WHERE rn = 1),
texts AS (SELECT id, unnest(list_concat([name], coalesce(body_tokens, []), coalesce(import_names, []))) s FROM held),
runs AS (SELECT id, unnest(regexp_extract_all(s, '[A-Za-z]+')) r FROM texts WHERE s IS NOT NULL),
words AS (SELECT id, lower(w) term FROM (SELECT id, unnest(string_split(regexp_replace(regexp_replace(r, '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g'), ' ')) w FROM runs) WHERE length(w) > 1),
tf AS (SELECT id, term, count(*) tf FROM words GROUP BY ALL),
n_terms AS (SELECT id, sum(tf)::BIGINT n_terms FROM tf GROUP BY id),
df AS (SELECT term, count(*) df FROM tf GROUP BY term)
"""

_BASKETS = f"""
spelled AS (SELECT graph_id, hash, ingested_at, files, row_number() OVER (PARTITION BY graph_id, hash ORDER BY ingested_at DESC NULLS LAST) rn FROM commits WHERE graph_id IS NOT NULL AND hash IS NOT NULL),
item AS (SELECT DISTINCT graph_id, hash, {_path('f')} f FROM (SELECT graph_id, hash, unnest(files) f FROM spelled WHERE rn = 1)),
counted AS (SELECT graph_id, hash FROM item WHERE f IS NOT NULL GROUP BY ALL HAVING count(*) BETWEEN 2 AND {{most}}),
i AS (SELECT item.* FROM item JOIN counted USING (graph_id, hash) WHERE f IS NOT NULL),
total AS (SELECT graph_id, count(*) n FROM counted GROUP BY 1),
one AS (SELECT graph_id, f, count(*) n FROM i GROUP BY ALL),
two AS (SELECT x.graph_id, x.f a, y.f b, count(*) together FROM i x JOIN i y ON x.graph_id = y.graph_id AND x.hash = y.hash AND x.f < y.f GROUP BY ALL),
pairs AS (SELECT two.*, p.n n_a, q.n n_b, total.n n FROM two JOIN one p ON two.graph_id = p.graph_id AND a = p.f JOIN one q ON two.graph_id = q.graph_id AND b = q.f JOIN total ON total.graph_id = two.graph_id)
"""

_TURNS = f"""
once AS (SELECT * FROM (SELECT session_id, turn_index, ts, tools, file_paths, row_number() OVER (PARTITION BY session_id, turn_index ORDER BY ts NULLS LAST) rn,
           min(ts) OVER (PARTITION BY session_id, turn_index) lo, max(ts) OVER (PARTITION BY session_id, turn_index) hi FROM turns WHERE session_id IS NOT NULL AND turn_index IS NOT NULL) WHERE rn = 1),
calls AS (SELECT session_id, turn_index, list((name, cmd) ORDER BY k) calls FROM (
  SELECT session_id, turn_index, k, lower(trim(coalesce(t.name, ''))) AS name,
    array_to_string(list_filter(string_split_regex(trim(regexp_replace(regexp_replace(regexp_replace(coalesce(t.command, ''), '(?s)(^|\\s)[0-9]+[<>].*$', ''), '(?s)(\\||&&|;|&?[<>]).*$', ''), '^\\s*([A-Za-z_][A-Za-z0-9_]*=\\S*(\\s+|$))+', '')), '\\s+'), lambda w: w <> '' AND w[1] <> '-'), ' ') cmd
  FROM (SELECT session_id, turn_index, unnest(tools) t, generate_subscripts(tools, 1) k FROM once) WHERE t IS NOT NULL) GROUP BY ALL),
paths AS (SELECT session_id, turn_index, list_sort(list(DISTINCT p)) files FROM (SELECT session_id, turn_index, {_path('p')} p FROM (
  SELECT session_id, turn_index, unnest(list_concat(coalesce(list_transform(list_filter(tools, lambda t: t IS NOT NULL), lambda t: t.path), []), coalesce(file_paths, []))) p FROM once)) WHERE p IS NOT NULL GROUP BY ALL),
does AS (SELECT session_id, turn_index, lo, hi, coalesce(calls, []) calls, coalesce(files, []) files FROM once LEFT JOIN calls USING (session_id, turn_index) LEFT JOIN paths USING (session_id, turn_index) WHERE calls IS NOT NULL OR files IS NOT NULL),
flagged AS (SELECT *, CASE WHEN lag(calls) OVER w = calls AND lag(files) OVER w = files THEN 0 ELSE 1 END new FROM does WINDOW w AS (PARTITION BY session_id ORDER BY turn_index)),
islands AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY turn_index) run FROM flagged),
found AS (SELECT session_id, min(turn_index) first_turn, max(turn_index) last_turn, count(*) turns, (epoch_us(max(hi)) - epoch_us(min(lo))) / 1e6 AS "seconds" FROM islands GROUP BY session_id, run HAVING count(*) >= 2)
"""

_SCORES = ["l", "g", "t", "b", "authority", "betweenness"]
_clean = lambda x: f"CASE WHEN {x} >= 0 AND NOT isnan({x}) AND {x} < 'inf'::DOUBLE THEN {x} ELSE -1 END"
_P4 = f"""
ex AS (SELECT DISTINCT ON (example_id) example_id, query_id, candidate, features FROM training_examples WHERE example_id IS NOT NULL AND query_id IS NOT NULL ORDER BY example_id),
fl AS (SELECT path, authority, betweenness FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY updated_at DESC NULLS LAST) rn FROM files) WHERE rn = 1),
sc AS (SELECT query_id, example_id, {', '.join(f'{_clean(f"features[{i + 1}]")} {s}' for i, s in enumerate(_SCORES[:4]))}, {', '.join(f'{_clean("fl." + s)} {s}' for s in _SCORES[4:])} FROM ex LEFT JOIN fl ON path = candidate)
"""

#: Ahead of each other example of the query, one after the other, on more than half of the six scores.
_FIRST = f"""SELECT query_id, example_id FROM sc x WHERE NOT EXISTS (SELECT 1 FROM sc y WHERE y.query_id = x.query_id AND y.example_id <> x.example_id
  AND {' + '.join(f'(x.{s} > y.{s})::INT' for s in _SCORES)} <= 3)"""
_part = lambda x: f"CASE WHEN {x} IS NULL OR isnan({x}) OR {x} <= 0 THEN 0.25 WHEN {x} > 1 THEN {x} / 100 ELSE {x} END"
_LAMBDAS = ["l", "g", "t", "b"]
#: The weighted ideal-point ranking: cut at the tenth and ninetieth hundredth of the known values, norms, distances, closeness.
_P4_RANKING = f"""
ex AS (SELECT DISTINCT ON (example_id) example_id, query_id, coalesce(graph_id, '') graph_id, candidate, features FROM training_examples WHERE example_id IS NOT NULL AND query_id IS NOT NULL ORDER BY example_id),
fl AS (SELECT path, authority, betweenness FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY updated_at DESC NULLS LAST) rn FROM files) WHERE rn = 1),
fw AS (SELECT graph_id, {', '.join(f'{_part("lambda_" + s)} {s}' for s in _LAMBDAS)} FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY trained_at DESC NULLS LAST) rn FROM fusion_weights WHERE graph_id IS NOT NULL) WHERE rn = 1),
long AS (SELECT query_id, example_id, graph_id, unnest([{', '.join(f"('{s}', {_clean(f'features[{i + 1}]')})" for i, s in enumerate(_SCORES[:4]))}, {', '.join(f"('{s}', {_clean('fl.' + s)})" for s in _SCORES[4:])}]) o FROM ex LEFT JOIN fl ON path = candidate),
v AS (SELECT query_id, example_id, graph_id, o[1] score, nullif(o[2], -1) v FROM long),
nth AS (SELECT query_id, score, v, row_number() OVER (PARTITION BY query_id, score ORDER BY v) rn, count(*) OVER (PARTITION BY query_id, score) n FROM v WHERE v IS NOT NULL),
cuts AS (SELECT query_id, score, max(v) FILTER (rn = greatest(1, ceil(0.1::DOUBLE * n))) lo, max(v) FILTER (rn = greatest(1, ceil(0.9::DOUBLE * n))) hi FROM nth GROUP BY ALL),
x AS (SELECT v.query_id, example_id, graph_id, score, coalesce(least(greatest(v, lo), hi), 0) x FROM v LEFT JOIN cuts USING (query_id, score)),
ends AS (SELECT query_id, score, sqrt(sum(x * x)) norm, max(x) best, min(x) worst FROM x GROUP BY ALL),
weighed AS (SELECT query_id, example_id, best, worst, x, norm, CASE WHEN fw.graph_id IS NULL THEN 1 / 6 ELSE CASE score WHEN 'l' THEN l WHEN 'g' THEN g WHEN 't' THEN t WHEN 'b' THEN b ELSE 0.25 END / (l + g + t + b + 0.5) END w
  FROM x JOIN ends USING (query_id, score) LEFT JOIN fw USING (graph_id)),
far AS (SELECT query_id, example_id, sqrt(sum(CASE WHEN norm > 0 THEN (w * (best - x) / norm) ** 2 ELSE 0 END)) up, sqrt(sum(CASE WHEN norm > 0 THEN (w * (worst - x) / norm) ** 2 ELSE 0 END)) down FROM weighed GROUP BY ALL),
near AS (SELECT query_id, example_id, CASE WHEN up + down > 0 THEN round(down / (up + down), 9) ELSE 0.5 END closeness FROM far)
"""

_P5 = """
kind AS (SELECT *, nullif(lower(trim(coalesce(entry_type, ''))), '') k, nullif(lower(trim(coalesce(role, ''))), '') r FROM session_entries WHERE session_id IS NOT NULL),
msg AS (SELECT *, CASE WHEN coalesce(r, k) IN ('user', 'human') THEN 'user' WHEN coalesce(r, k) IN ('assistant', 'model') THEN 'assistant' END speaker FROM kind WHERE NOT coalesce(is_sidechain, false) AND (k IS NULL OR k IN ('user', 'assistant', 'message'))),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, uuid ORDER BY entry_id) rn FROM msg WHERE speaker IS NOT NULL) WHERE rn = 1),
mode AS (SELECT *, count(turn_index) OVER (PARTITION BY session_id) = count(*) OVER (PARTITION BY session_id) by_turn FROM once),
ordered AS (SELECT *, row_number() OVER w - 1 msg_pos, lead(speaker) OVER w nxt FROM (SELECT *, CASE WHEN by_turn THEN turn_index ELSE epoch_us(ts) END o FROM mode) WINDOW w AS (PARTITION BY session_id ORDER BY o NULLS FIRST, entry_id)),
whole AS (SELECT session_id FROM ordered m GROUP BY session_id HAVING
  bool_or(msg_pos = 0 AND speaker = 'user') AND bool_and(speaker <> 'user' OR coalesce(nxt, '') = 'assistant') AND bool_and(o IS NOT NULL AND (NOT by_turn OR o = msg_pos))
  AND bool_and(length(regexp_replace(coalesce(content, ''), '[\\s\\p{Z}\\p{Cc}\\p{Cf}]', '', 'g')) > 0)
  AND bool_and(nullif(trim(coalesce(parent_uuid, '')), '') IS NULL OR EXISTS (SELECT 1 FROM once p WHERE p.session_id = m.session_id AND p.uuid = m.parent_uuid))),
kept AS (SELECT session_id, msg_pos::INT msg_pos, entry_id, speaker, content FROM ordered WHERE session_id IN (SELECT session_id FROM whole))
"""

ORACLES: dict[str, str] = {
    "p1_found": f"WITH {_TERMS} SELECT tf.id AS symbol_id, term FROM tf JOIN n_terms USING (id) JOIN df USING (term) WHERE tf >= 3 AND tf * 20 >= n_terms AND df BETWEEN 2 AND 12",
    "p1_tf_idf": f"WITH {_TERMS} SELECT tf.id AS symbol_id, term, tf, n_terms::INT AS n_terms, df, round(tf / n_terms * (ln((1 + (SELECT count(*) FROM held)) / (1 + df)) + 1), 9) AS score FROM tf JOIN n_terms USING (id) JOIN df USING (term)",
    "p2_found": f"WITH {_BASKETS.replace('{most}', '30')} SELECT a AS file_a, b AS file_b FROM pairs WHERE together >= 5 AND together * n >= 5 * n_a * n_b",
    "p2_pairs": f"""WITH {_BASKETS.replace('{most}', '1000000000')}, said AS (SELECT graph_id, least(x, y) a, greatest(x, y) b, co_changes, computed_at FROM (SELECT graph_id, {_path('file_a')} x, {_path('file_b')} y, co_changes, computed_at FROM change_coupling) WHERE x <> y),
      latest AS (SELECT graph_id, a, b, co_changes reported FROM (SELECT *, row_number() OVER (PARTITION BY graph_id, a, b ORDER BY computed_at DESC NULLS LAST, co_changes DESC NULLS LAST) rn FROM said) WHERE rn = 1)
      SELECT pairs.graph_id, pairs.a, pairs.b, together, n_a, n_b, n, round(together * n / (n_a * n_b), 9) lift, round(together / (n_a + n_b - together), 9) jaccard, round(together / n_a, 9) conf_ab, round(together / n_b, 9) conf_ba,
        round(CASE WHEN together >= n THEN 1.0 ELSE ln(together * n / (n_a * n_b)) / -ln(together / n) END, 9) npmi, reported, coalesce(reported = together, false) agrees
      FROM pairs LEFT JOIN latest USING (graph_id, a, b)""",
    "p3_found": f"WITH {_TURNS} SELECT session_id, first_turn, last_turn FROM found",
    "p3_runs": f'WITH {_TURNS} SELECT session_id, first_turn, last_turn, turns, "seconds" FROM found',
    "p4_found": f"WITH {_P4} {_FIRST}",
    "p4_ranking": f"WITH {_P4_RANKING} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY closeness DESC, example_id) - 1 AS place, example_id, closeness FROM near",
    "p5_found": f"WITH {_P5} SELECT session_id, msg_pos, entry_id FROM kept",
    "p5_transcripts": f"WITH {_P5} SELECT session_id, msg_pos, entry_id, speaker, content FROM kept",
}
