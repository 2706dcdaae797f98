"""Queries over agent sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sessions as S
from ..shared import durable
from ..shared import table as t
from .inputs import PLAIN
from .registry import query

_TEST = S.TEST_COMMAND
_FACTS = f"""
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, turn_index ORDER BY ts DESC NULLS LAST) rn FROM turns WHERE session_id IS NOT NULL AND turn_index IS NOT NULL) WHERE rn = 1),
calls AS (SELECT session_id, turn_index, bool_or(n IN ('edit', 'write', 'multiedit', 'notebookedit')) is_edit, bool_or(n IN ('read', 'grep', 'glob')) is_read, bool_or(n = 'bash' AND coalesce(regexp_matches(c, '{_TEST}'), false)) is_test, count(*) n_tools
  FROM (SELECT session_id, turn_index, lower(trim(coalesce(x.name, ''))) n, x.command c FROM (SELECT session_id, turn_index, unnest(tools) x FROM once) WHERE x IS NOT NULL) GROUP BY ALL),
facts AS (SELECT session_id, turn_index, ts, coalesce(is_edit, false) is_edit, coalesce(is_read, false) is_read, coalesce(is_test, false) is_test, coalesce(n_tools, 0) n_tools, coalesce(output_tokens, 0) output_tokens,
  ((coalesce(input_tokens, 0) + coalesce(cache_creation_tokens, 0)) * 30 + coalesce(cache_read_tokens, 0) * 3 + coalesce(output_tokens, 0) * 150)::BIGINT AS cost FROM once LEFT JOIN calls USING (session_id, turn_index)),
ends AS (SELECT session_id, min(turn_index) FILTER (WHERE is_edit) f, max(turn_index) FILTER (WHERE is_edit) l FROM facts GROUP BY 1),
phased AS (SELECT facts.*, CASE WHEN f IS NULL OR turn_index < f THEN 'explore' WHEN turn_index > l THEN 'tail' ELSE 'edit' END phase FROM facts JOIN ends USING (session_id)),
paths AS (SELECT DISTINCT session_id, turn_index, p FROM (SELECT session_id, turn_index, {PLAIN.replace('{0}', 'p')} p FROM (
  SELECT session_id, turn_index, unnest(list_concat(coalesce(list_transform(list_filter(tools, lambda x: x IS NOT NULL), lambda x: x.path), []), coalesce(file_paths, []))) p FROM once)) WHERE p IS NOT NULL)"""
_STREAKS = f"{_FACTS}, isl AS (SELECT *, sum((NOT is_test)::INT) OVER (PARTITION BY session_id ORDER BY turn_index) g FROM phased WHERE phase = 'tail'), streaks AS (SELECT session_id, min(turn_index) first_turn, max(turn_index) last_turn, count(*) runs, sum(cost) - arg_min(cost, turn_index) wasted_cost FROM isl WHERE is_test GROUP BY session_id, g HAVING count(*) >= 2)"
_REREADS = f"{_FACTS}, tch AS (SELECT phased.*, p FROM phased JOIN paths USING (session_id, turn_index)), fst AS (SELECT session_id, p, min(turn_index) FILTER (WHERE is_read) r, min(turn_index) FILTER (WHERE is_edit) e FROM tch GROUP BY ALL), again AS (SELECT session_id, turn_index, count(*) AS n_files, any_value(cost) AS cost FROM tch JOIN fst USING (session_id, p) WHERE phase = 'tail' AND r < turn_index AND (e IS NULL OR e >= turn_index) GROUP BY ALL)"
_BLOAT = "bloat AS (SELECT session_id, count(*) turns, sum(cost) AS cost FROM phased WHERE phase = 'tail' AND n_tools = 0 AND output_tokens > 0 GROUP BY 1)"
_METRICS = f"""{_REREADS}, {_BLOAT}, {_STREAKS.split(_FACTS)[1].lstrip(', ')}, fc AS (SELECT session_id, sum(r::INT) files_read, sum(e::INT) files_edited FROM (SELECT session_id, p, bool_or(is_read) r, bool_or(is_edit) e FROM tch WHERE is_read OR is_edit GROUP BY ALL) GROUP BY 1),
 m AS (SELECT session_id, count(*) turns, sum(cost) AS cost, sum((phase = 'explore')::INT) explore_turns, sum((phase = 'edit')::INT) edit_turns, sum((phase = 'tail')::INT) tail_turns, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS secs FROM phased GROUP BY 1),
 mm AS (SELECT m.*, coalesce(files_read, 0) files_read, coalesce(files_edited, 0) files_edited FROM m LEFT JOIN fc USING (session_id))"""


def _phased(spark: SparkSession, d: str) -> DataFrame:
    return durable(S.phases(S.turn_facts(t(spark, d, "turns"))))


@query(f"WITH {_FACTS} SELECT session_id, turn_index, phase FROM phased")
def session_phases(spark: SparkSession, d: str) -> DataFrame:
    """Phase of every turn."""
    return S.phases(S.turn_facts(t(spark, d, "turns"))).select("session_id", "turn_index", "phase")


@query(f"WITH {_STREAKS} SELECT session_id, first_turn, last_turn, runs, round(wasted_cost / 1e7, 7) wasted_cost FROM streaks")
def streaks(spark: SparkSession, d: str) -> DataFrame:
    """Repeated test runs after the last edit."""
    return S.test_streaks(_phased(spark, d)).withColumn("wasted_cost", F.round("wasted_cost", 7))


@query(f"WITH {_REREADS} SELECT session_id, turn_index, n_files AS files, round(cost / 1e7, 7) AS cost FROM again")
def rereads(spark: SparkSession, d: str) -> DataFrame:
    """Turns that read unchanged files again."""
    return S.rereads(_phased(spark, d)).withColumn("cost", F.round("cost", 7))


@query(f"WITH {_FACTS}, {_BLOAT} SELECT session_id, turns, round(cost / 1e7, 7) AS cost FROM bloat")
def summary_bloat(spark: SparkSession, d: str) -> DataFrame:
    """Text-only turns after the last edit."""
    return S.summary_bloat(_phased(spark, d)).withColumn("cost", F.round("cost", 7))


@query(f"WITH {_FACTS} SELECT session_id, turn_index, round(cost / 1e7, 7) AS cost FROM facts")
def turn_cost(spark: SparkSession, d: str) -> DataFrame:
    """Cost of every turn."""
    return S.turn_facts(t(spark, d, "turns")).select("session_id", "turn_index", F.round("cost", 7).alias("cost"))


@query(f"WITH {_METRICS} SELECT session_id, turns, round(cost / 1e7, 7) AS cost, explore_turns::BIGINT explore_turns, edit_turns::BIGINT edit_turns, tail_turns::BIGINT tail_turns, files_read::BIGINT files_read, files_edited::BIGINT files_edited, round(secs, 3) AS \"seconds\" FROM mm")
def session_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of every session."""
    m = S.metrics(_phased(spark, d)).select("session_id", "turns", "cost", "explore_turns", "edit_turns", "tail_turns", "files_read", "files_edited", "seconds")
    return m.withColumns({"cost": F.round("cost", 7), "seconds": F.round("seconds", 3)})


@query(f"WITH {_FACTS} SELECT session_id, lower(trim(coalesce(x.name, ''))) tool, count(*) calls FROM (SELECT session_id, unnest(tools) x FROM once) WHERE x IS NOT NULL GROUP BY ALL")
def tool_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Calls of each tool in each session."""
    return S.tool_histogram(S.turn_facts(t(spark, d, "turns")))


_AVG = ["turns", "cost", "explore_turns", "edit_turns", "tail_turns", "files_read", "files_edited"]


@query(f"WITH {_METRICS}, pat AS (SELECT session_id, 'streak' pattern FROM streaks UNION ALL SELECT session_id, 'reread' FROM again UNION ALL SELECT session_id, 'bloat' FROM bloat), every AS (SELECT 'sessions' measure, count(*)::DOUBLE AS val FROM mm {''.join(f" UNION ALL SELECT 'avg_{c}', avg({c}){' / 1e7' if c == 'cost' else ''} FROM mm" for c in _AVG)} UNION ALL SELECT 'sessions_with_' || pattern, count(DISTINCT session_id)::DOUBLE FROM pat GROUP BY pattern) SELECT measure, round(val, 6) AS \"value\" FROM every")
def aggregate_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Averages and patterns across sessions."""
    p = _phased(spark, d)
    found = {"streak": S.test_streaks(p), "reread": S.rereads(p), "bloat": S.summary_bloat(p)}
    patterns = None
    for name, df in found.items():
        part = df.select("session_id", F.lit(name).alias("pattern"))
        patterns = part if patterns is None else patterns.unionByName(part)
    return S.across(S.metrics(p), patterns).withColumn("value", F.round("value", 6))


@query("""WITH e AS (SELECT *, coalesce(lower(trim(entry_type)) = 'assistant' AND output_tokens > 50, false)::INT k FROM session_entries WHERE session_id IS NOT NULL),
  z AS (SELECT session_id, entry_id, (sum(k) OVER (PARTITION BY session_id ORDER BY ts NULLS FIRST, entry_id) - k)::BIGINT turn FROM e) SELECT session_id, turn, count(*) entries, min(entry_id) first_entry FROM z GROUP BY ALL""")
def turn_islands(spark: SparkSession, d: str) -> DataFrame:
    """Log entries grouped into turns that an assistant entry of more than 50 output tokens closes."""
    e = t(spark, d, "session_entries").where("session_id IS NOT NULL").select("session_id", "entry_id", "ts", "entry_type", "output_tokens")
    closes = (F.lower(F.trim("entry_type")) == "assistant") & (F.col("output_tokens") > 50)
    s = S.segment(e, [F.col("ts").asc_nulls_first(), F.col("entry_id").asc()], closes)
    return s.groupBy("session_id", "turn").agg(F.count("*").alias("entries"), F.min("entry_id").alias("first_entry"))


@query("""WITH o AS (SELECT user_id, event_id, event_type, event_type = 'purchase' is_edit, row_number() OVER w - 1 place, lag(event_type) OVER w pc FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  f AS (SELECT *, (is_edit OR coalesce(pc = 'purchase', true) OR event_type IS DISTINCT FROM pc)::INT fresh FROM o), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY place) isl FROM f), h AS (SELECT *, place - min(place) OVER (PARTITION BY user_id, isl) + 1 nth FROM g)
  SELECT user_id, event_id, place, CASE WHEN place >= 10 THEN 'budget' WHEN NOT is_edit AND nth >= 3 THEN 'streak' END blocked FROM h""")
def call_limits(spark: SparkSession, d: str) -> DataFrame:
    """Events as calls: which would be blocked by the streak or the budget rule, purchases being edits."""
    e = t(spark, d, "events").select(F.col("user_id").alias("session_id"), "event_id", "ts", F.col("event_type").alias("command"), (F.col("event_type") == "purchase").alias("is_edit"))
    return S.call_limits(e, [F.col("ts"), F.col("event_id")]).select(F.col("session_id").alias("user_id"), "event_id", "place", "blocked")
