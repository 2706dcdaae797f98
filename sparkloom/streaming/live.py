"""Live operators: session windows, call limits per session, hash-driven refresh."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.sessions import BUDGET, STREAK


def session_spans(events: DataFrame, key: str, at: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, started_at, ended_at, events, value) per session of a key: events closer than ``gap``; late ones up to ``late``."""
    w = F.session_window(at, gap)
    s = events.withWatermark(at, late).groupBy(key, w.alias("w")).agg(F.count("*").alias("events"))
    return s.select(key, F.col("w.start").alias("started_at"), F.col("w.end").alias("ended_at"), "events")


def activity(events: DataFrame, at: str, kind: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts of each kind in fixed windows."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), kind).agg(F.count("*").alias("events")).select(F.col("w.start").alias("window"), kind, "events")


def limit_calls(calls: DataFrame, streak: int = STREAK, budget: int = BUDGET, idle_ms: int = 3_600_000, late: str = "1 hour") -> DataFrame:
    """``session_id, call_id, blocked`` for a stream of (session_id, call_id, at, command, is_edit).

    State per session is four small values: last command, its streak, the number of calls and the time of last sight. An
    edit ends a streak. A session that in event time is idle for ``idle_ms`` beyond the lateness is forgotten. Calls of one trigger are taken in order of (at, call_id).
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, run, n = state.get if state.exists else ("", 0, 0)
        rows, seen = [], 0
        for _, c in pd.concat(list(frames)).sort_values(["at", "call_id"]).iterrows():
            edit = bool(c.is_edit)
            run = 0 if edit else run + 1 if c.command == last and run else 1
            last = "" if edit else c.command
            blocked = "budget" if n >= budget else "streak" if not edit and run >= streak else None
            n += 1
            rows.append((key[0], c.call_id, blocked))
            seen = max(seen, int(c["at"].timestamp() * 1000))
        state.update((last, run, n))
        state.setTimeoutTimestamp(max(seen, state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame(rows, columns=["session_id", "call_id", "blocked"])

    return calls.withWatermark("at", late).groupBy("session_id").applyInPandasWithState(step, "session_id string, call_id bigint, blocked string", "last string, run bigint, n bigint", "append", GroupStateTimeout.EventTimeTimeout)


def refresh(files: DataFrame, known: Callable[[], DataFrame], apply: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """A writer that hands only new and changed files (path, hash, ...) of each batch to ``apply``; ``known`` reads the present (path, hash)."""

    def batch(df: DataFrame, n: int) -> None:
        fresh = df.join(known().select("path", "hash"), ["path", "hash"], "left_anti")
        apply(fresh, n)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
