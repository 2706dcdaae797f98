"""Repeated consecutive events: runs are encoded inside range-sorted chunks, then a prefix merge joins runs across chunk borders."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.commands import plain_command
from ..functions.paths import plain_paths
from ..shared import durable, ship

_NEVER = (np.iinfo(np.int64).max, np.iinfo(np.int64).min)


def _differs(column: pa.Array, before: pa.Scalar) -> np.ndarray:
    """Whether each value differs from the one in front of it, null being equal to null; ``before`` is in front of the first."""
    shifted = pa.concat_arrays([pa.array([before.as_py()], column.type), column.slice(0, len(column) - 1)])
    same = pc.fill_null(pc.equal(column, shifted), False)
    both_null = pc.and_(pc.is_null(column), pc.is_null(shifted))
    return ~pc.or_(same, both_null).to_numpy(zero_copy_only=False)


def _encode_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one sorted chunk: columns key, pos, at (microseconds), signatures -> key, first, last, events, times, chunk ends, signatures.

    The first and the last run of the chunk are marked, as they alone can go on in another chunk. One run stays open between
    batches; equal positions of a key count once, and the first of them gives the signature.
    """
    tail: list[pa.Array] | None = None  # the open run as one row: key, first, last, events, lo, hi, is_first, signatures
    names: list[str] = []

    def rows(head: list[pa.Array], is_last: bool) -> pa.RecordBatch:
        key, first, last, events, lo, hi, is_first, *sig = head
        known = lambda x, empty: pa.array(np.asarray(x), mask=np.asarray(x) == empty)
        n = len(key)
        return pa.RecordBatch.from_arrays(
            [key, first, last, events, known(lo, _NEVER[0]), known(hi, _NEVER[1]), is_first, pa.array(np.full(n, is_last)), *sig], names=[names[0], "first", "last", "events", "started", "ended", "is_first", "is_last", *names[3:]]
        )

    seen = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.schema.names
        key, pos, at, *sig = batch.columns
        spot = pos.to_numpy()
        if tail is None:
            other, again = np.ones(len(key), bool), np.zeros(len(key), bool)
            other[1:] = _differs(key, key[0])[1:]
            again[1:] = ~other[1:] & (spot[1:] == spot[:-1])
        else:
            other = _differs(key, tail[0][0])
            again = ~other & (spot == np.concatenate([[tail[2][0].as_py()], spot[:-1]]))
        kept = np.flatnonzero(~again)
        new = np.zeros(len(key), bool)
        if len(kept):
            taken = pa.array(kept)
            change = other[kept].copy()
            for i, s in enumerate(sig):
                some = s.take(taken)
                change |= _differs(some, some[0] if tail is None else tail[7 + i][0])
            change[0] |= tail is None
            new[kept] = change
        starts = np.flatnonzero(new)
        micro = pc.cast(at, pa.int64())
        lo = pc.fill_null(micro, _NEVER[0]).to_numpy()
        hi = pc.fill_null(micro, _NEVER[1]).to_numpy()
        # what stands before the first new run belongs to the open one
        stop = starts[0] if len(starts) else len(key)
        if tail is not None:
            k, first, last, events, low, high, is_first, *own = (c[0].as_py() for c in tail)
            if stop:
                last, events = int(spot[stop - 1]), events + int((~again[:stop]).sum())
                low, high = min(low, int(lo[:stop].min())), max(high, int(hi[:stop].max()))
            tail = [pa.array([x], t) for x, t in zip([k, first, last, events, low, high, is_first, *own], [c.type for c in tail], strict=True)]
            if not len(starts):
                continue
            yield rows(tail, False)
        ends = np.append(starts[1:], len(key)) - 1
        at_start = pa.array(starts)
        counts = np.add.reduceat((~again).astype(np.int64), starts)
        head = [key.take(at_start), pa.array(spot[starts]), pa.array(spot[ends]), pa.array(counts), pa.array(np.minimum.reduceat(lo, starts)), pa.array(np.maximum.reduceat(hi, starts)), pa.array((np.arange(len(starts)) + seen) == 0)]
        head += [s.take(at_start) for s in sig]
        seen += len(starts)
        if len(starts) > 1:
            yield rows([c.slice(0, len(starts) - 1) for c in head], False)
        tail = [c.slice(len(starts) - 1) for c in head]
    if tail is not None:
        yield rows(tail, True)


def collapse_runs(events: DataFrame, key: str, position: str, sig: list[str], at: str, chunks: int | None = None) -> DataFrame:
    """(key, first, last, events, started_at, ended_at) of each longest run of events of a key with equal ``sig``.

    ``position`` is an integer of up to 64 bits that orders the events of a key; rows with equal key and position count as
    one event (the least signature holds, their times all enter). Rows with a null key or position are dropped.
    ``at`` may be null; the times of a run are the least and greatest known ones.

    Events are range-partitioned by key and position, so that chunks hold about equally many events whatever the keys and
    gaps between positions are. Each sorted chunk encodes its runs in one pass over Arrow batches. Only its first and its last
    run can go on in a neighbour: these at most two rows per chunk are merged by a running count of breaks over the
    chunks' summaries, and all others are final. ``chunks`` is their number, by default that of shuffle partitions.
    """
    spark = events.sparkSession
    ship(spark)
    own = [f"sig{i}" for i in range(len(sig))]
    base = events.where(F.col(key).isNotNull() & F.col(position).isNotNull())
    # written first: range partitioning reads its input twice
    slim = durable(base.select(key, F.col(position).cast("long").alias("pos"), F.col(at).cast("timestamp").alias("at"), *[F.col(s).alias(o) for s, o in zip(sig, own, strict=True)]))
    order = [F.col(key), F.col("pos")]
    laid = slim.repartitionByRange(*([chunks] if chunks else []), *order).sortWithinPartitions(*order, *own)
    kinds = {f.name: f.dataType.simpleString() for f in slim.schema}
    schema = f"`{key}` {kinds[key]}, first bigint, last bigint, events bigint, started bigint, ended bigint, is_first boolean, is_last boolean" + "".join(f", {o} {kinds[o]}" for o in own)
    local = durable(laid.mapInArrow(_encode_chunk, schema))
    times = [F.timestamp_micros("started").alias("started_at"), F.timestamp_micros("ended").alias("ended_at")]
    final = local.where("NOT is_first AND NOT is_last").select(key, "first", "last", "events", *times)
    # at most two rows per chunk: the prefix merge over all of them is small whatever a key holds
    across = W.partitionBy(key).orderBy("first")
    same = reduce(and_, [F.lag(o).over(across).eqNullSafe(F.col(o)) for o in own])
    joins = F.col("is_first") & F.lag("is_last").over(across) & (F.row_number().over(across) > 1) & same
    breaks = local.where("is_first OR is_last").withColumn("new", (~F.coalesce(joins, F.lit(False))).cast("int"))
    merged = breaks.withColumn("chain", F.sum("new").over(across.rowsBetween(W.unboundedPreceding, 0))).groupBy(key, "chain")
    merged = merged.agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("events").alias("events"), F.min("started").alias("started"), F.max("ended").alias("ended"))
    return final.unionByName(merged.select(key, "first", "last", "events", *times))


def turn_events(turns: DataFrame) -> DataFrame:
    """(session_id, turn_index, ts, s1, s2) of turns that do something, s1 and s2 a 128-bit signature of what.

    The signature covers the tools in order (name without case and blanks around, plain command) and the set of plain
    file paths of tools and file_paths. A null tool entry is skipped; turns without tools and files are left out.
    """
    tools = F.filter(F.coalesce("tools", F.array().cast(turns.schema["tools"].dataType)), lambda t: t.isNotNull())
    calls = F.transform(tools, lambda t: F.struct(F.lower(F.trim(F.coalesce(t["name"], F.lit("")))).alias("n"), plain_command(t["command"]).alias("c")))
    files = plain_paths(F.concat(F.transform(tools, lambda t: t["path"]), F.coalesce("file_paths", F.array().cast("array<string>"))))
    does = turns.select("session_id", "turn_index", "ts", calls.alias("calls"), files.alias("files")).where((F.size("calls") > 0) | (F.size("files") > 0))
    # sizes and separators go into the hash, since it runs over the flattened values
    what = [F.array_join(F.transform("calls", lambda c: F.concat_ws("\x1f", c["n"], c["c"])), "\x1e"), F.array_join("files", "\x1e")]
    return does.select("session_id", "turn_index", "ts", F.xxhash64(F.lit(1), *what).alias("s1"), F.xxhash64(F.lit(2), *what).alias("s2"))


def repeated_turns(turns: DataFrame, chunks: int | None = None) -> DataFrame:
    """(session_id, first_turn, last_turn, turns, seconds) of each longest run of at least two same turns."""
    runs = collapse_runs(turn_events(turns), "session_id", "turn_index", ["s1", "s2"], "ts", chunks).where("events >= 2")
    seconds = (F.unix_micros("ended_at") - F.unix_micros("started_at")) / 1e6
    return runs.select("session_id", F.col("first").cast("int").alias("first_turn"), F.col("last").cast("int").alias("last_turn"), F.col("events").alias("turns"), seconds.alias("seconds"))
