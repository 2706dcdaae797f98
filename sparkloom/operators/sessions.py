"""Agent sessions: phases, waste, costs, metrics, turn segmentation, call limits.

Turns carry session_id, turn_index, tools (array of name, command, path), token counts and file_paths. A session may hold
any share of all rows: per-session facts are aggregates that are joined back, running counts are made over range partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import plain_paths
from ..shared import durable, join_stats, latest_by, running_sum

#: Tools that edit and that read, commands that run tests, prices a million tokens, streak and call limits.
EDIT, READ = ["edit", "write", "multiedit", "notebookedit"], ["read", "grep", "glob"]
TEST_COMMAND = r"(?i)\b(vitest|jest|pytest|mocha|go test|cargo test|npm (run )?test|mvn\b.*\b(test|verify)|gradle test)\b"
INPUT_PRICE, OUTPUT_PRICE, CACHE_PRICE, STREAK, BUDGET = 3.0, 15.0, 0.3, 3, 10


def turn_facts(turns: DataFrame) -> DataFrame:
    """One slim row per turn: session_id, turn_index, ts, tool names, paths, token counts, is_edit, is_read, is_test, cost.

    Each (session_id, turn_index) once; null tool entries skipped; names compared without case and blanks around.
    """
    empty = F.array().cast(turns.schema["tools"].dataType)
    tools = F.filter(F.coalesce("tools", empty), lambda x: x.isNotNull())
    names = F.transform(tools, lambda x: F.lower(F.trim(F.coalesce(x["name"], F.lit("")))))
    paths = plain_paths(F.concat(F.transform(tools, lambda x: x["path"]), F.coalesce("file_paths", F.array().cast("array<string>"))))
    runs_tests = F.exists(tools, lambda x: F.coalesce((F.lower(F.trim(x["name"])) == "bash") & x["command"].rlike(TEST_COMMAND), F.lit(False)))
    token = {c: F.coalesce(c, F.lit(0)) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")}
    # whole ten-millionths, so that sums do not depend on their order
    units = ((token["input_tokens"] + token["cache_creation_tokens"]) * int(10 * INPUT_PRICE) + token["cache_read_tokens"] * int(10 * CACHE_PRICE) + token["output_tokens"] * int(10 * OUTPUT_PRICE)).cast("bigint")
    any_of = lambda known: F.exists("names", lambda n: n.isin(known))
    slim = turns.where("session_id IS NOT NULL AND turn_index IS NOT NULL").select("session_id", "turn_index", "ts", names.alias("names"), paths.alias("paths"), token["output_tokens"].alias("output_tokens"), runs_tests.alias("is_test"), units.alias("units"))
    once = latest_by(slim, ["session_id", "turn_index"], ["ts"])
    return once.withColumns({"is_edit": any_of(EDIT), "is_read": any_of(READ), "cost": F.col("units") / 1e7})


def phases(facts: DataFrame) -> DataFrame:
    """``facts`` with phase: explore before the first edit (always without edits), tail after the last, edit between.

    The slim facts are written once: the wide turns are scanned and exchanged a single time, whatever reads the phases.
    """
    facts = durable(facts)
    ends = facts.groupBy("session_id").agg(F.count("*").alias("n_turns"), F.min(F.when(F.col("is_edit"), F.col("turn_index"))).alias("first_edit"), F.max(F.when(F.col("is_edit"), F.col("turn_index"))).alias("last_edit"))
    x = join_stats(facts, ends, ["session_id"], "n_turns", ["turn_index"])
    at = F.col("turn_index")
    phase = F.when(F.col("first_edit").isNull() | (at < F.col("first_edit")), "explore").when(at > F.col("last_edit"), "tail").otherwise("edit")
    return x.withColumn("phase", phase).drop("n_turns", "first_edit", "last_edit")


def test_streaks(phased: DataFrame, least: int = 2) -> DataFrame:
    """(session_id, first_turn, last_turn, runs, wasted_cost): runs of test turns in the tail; all but the first are waste.

    A streak is the test turns with the same number of other tail turns before them, a running count over range partitions.
    """
    tail = phased.where("phase = 'tail'").select("session_id", "turn_index", "is_test", "units")
    broken = running_sum(tail, ["session_id"], [F.col("turn_index")], (~F.col("is_test")).cast("bigint"), "island")
    s = broken.where("is_test").groupBy("session_id", "island").agg(F.min("turn_index").alias("first_turn"), F.max("turn_index").alias("last_turn"), F.count("*").alias("runs"), F.sum("units").alias("all_units"), F.min_by("units", "turn_index").alias("first_units"))
    return s.where(F.col("runs") >= least).select("session_id", "first_turn", "last_turn", "runs", ((F.col("all_units") - F.col("first_units")) / 1e7).alias("wasted_cost"))


def rereads(phased: DataFrame) -> DataFrame:
    """(session_id, turn_index, files, cost) of tail turns that touch files read in an earlier turn and not edited in one."""
    touched = phased.select("session_id", "turn_index", "phase", "is_read", "is_edit", "cost", F.explode("paths").alias("path"))
    first = touched.groupBy("session_id", "path").agg(F.count("*").alias("n"), F.min(F.when(F.col("is_read"), F.col("turn_index"))).alias("read"), F.min(F.when(F.col("is_edit"), F.col("turn_index"))).alias("edited"))
    x = join_stats(touched.where("phase = 'tail'"), first, ["session_id", "path"], "n", ["turn_index"])
    again = x.where((F.col("read") < F.col("turn_index")) & (F.col("edited").isNull() | (F.col("edited") >= F.col("turn_index"))))
    return again.groupBy("session_id", "turn_index").agg(F.count("*").alias("files"), F.first("cost").alias("cost"))


def summary_bloat(phased: DataFrame) -> DataFrame:
    """(session_id, turns, cost) of tail turns without tools that still produce output."""
    return phased.where((F.col("phase") == "tail") & (F.size("names") == 0) & (F.col("output_tokens") > 0)).groupBy("session_id").agg(F.count("*").alias("turns"), (F.sum("units") / 1e7).alias("cost"))


def metrics(phased: DataFrame) -> DataFrame:
    """One row per session: turns, cost and share of each phase, files read and edited, seconds from first to last known time."""
    of = lambda p: F.col("phase") == p
    m = phased.groupBy("session_id").agg(
        F.count("*").alias("turns"), (F.sum("units") / 1e7).alias("cost"),
        *[F.sum(of(p).cast("int")).alias(f"{p}_turns") for p in ("explore", "edit", "tail")],
        *[(F.sum(F.when(of(p), F.col("units")).otherwise(0)) / 1e7).alias(f"{p}_cost") for p in ("explore", "edit", "tail")],
        ((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6).alias("seconds"),
    )
    files = phased.where("is_read OR is_edit").select("session_id", "is_read", "is_edit", F.explode("paths").alias("path")).groupBy("session_id", "path").agg(F.bool_or("is_read").alias("r"), F.bool_or("is_edit").alias("e"))
    files = files.groupBy("session_id").agg(F.sum(F.col("r").cast("int")).alias("files_read"), F.sum(F.col("e").cast("int")).alias("files_edited"))
    out = m.join(files, "session_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("files_read", "files_edited")})
    return out.withColumns({f"{p}_share": F.col(f"{p}_turns") / F.col("turns") for p in ("explore", "edit", "tail")})


def tool_histogram(facts: DataFrame) -> DataFrame:
    """(session_id, tool, calls)."""
    return facts.select("session_id", F.explode("names").alias("tool")).groupBy("session_id", "tool").agg(F.count("*").alias("calls"))


def across(session_metrics: DataFrame, patterns: DataFrame) -> DataFrame:
    """(measure, value): averages over sessions, and in how many sessions each waste pattern occurs; patterns: session_id, pattern."""
    means = session_metrics.agg(F.count("*").cast("double").alias("sessions"), *[F.avg(c).alias(f"avg_{c}") for c in ("turns", "cost", "explore_turns", "edit_turns", "tail_turns", "files_read", "files_edited")])
    long = means.unpivot([], means.columns, "measure", "value")
    seen = patterns.groupBy(F.concat(F.lit("sessions_with_"), F.col("pattern")).alias("measure")).agg(F.countDistinct("session_id").cast("double").alias("value"))
    return long.unionByName(seen)


def segment(entries: DataFrame, order: list[Column], closes: Column) -> DataFrame:
    """``entries`` with turn: each entry that ``closes`` a turn is its last, what follows belongs to the next."""
    counted = running_sum(entries.withColumn("__closes", F.coalesce(closes, F.lit(False)).cast("bigint")), ["session_id"], order, F.col("__closes"), "__n")
    return counted.withColumn("turn", F.col("__n") - F.col("__closes")).drop("__closes", "__n")


def call_limits(calls: DataFrame, order: list[Column], streak: int = STREAK, budget: int = BUDGET) -> DataFrame:
    """``calls`` (session_id, command, is_edit, ...) with blocked: 'streak' from the ``streak``-th equal command since the last edit or
    other command on, 'budget' beyond ``budget`` calls of a session, else null.

    Islands of equal commands come from a running count of changes, which compares each call with the one before it
    through its position.
    """
    from ..shared import positions

    at = durable(positions(calls, ["session_id"], order, "place"))
    before = at.select("session_id", (F.col("place") + 1).alias("place"), F.col("command").alias("__c"), F.col("is_edit").alias("__e"))
    x = at.join(before, ["session_id", "place"], "left")
    fresh = F.coalesce("is_edit", F.lit(False)) | F.coalesce("__e", F.lit(True)) | ~F.col("command").eqNullSafe(F.col("__c"))
    x = running_sum(x.withColumn("__fresh", fresh.cast("bigint")).drop("__c", "__e"), ["session_id"], [F.col("place")], F.col("__fresh"), "__island")
    start = x.groupBy("session_id", "__island").agg(F.min("place").alias("__start"), F.count("*").alias("__n"))
    x = join_stats(x, start, ["session_id", "__island"], "__n", ["place"])
    nth = F.col("place") - F.col("__start") + 1
    blocked = F.when(F.col("place") >= budget, "budget").when(~F.coalesce("is_edit", F.lit(False)) & (nth >= streak), "streak")
    return x.withColumn("blocked", blocked).select(*calls.columns, "place", "blocked")
