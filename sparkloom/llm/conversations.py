"""Rebuilding conversations from message rows: the rows are an event log that is folded by version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import blank_to_null, durable, join_stats, latest_by, positions

#: A character that shows: not a separator, control, format or surrogate character, nor one of those that are drawn as nothing
#: (combining joiner, Hangul and Mongolian fillers, variation selectors, braille blank, tags).
VISIBLE = r"[^\p{Z}\p{Cc}\p{Cf}\p{Cs}\x{34F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{2800}\x{3164}\x{FE00}-\x{FE0F}\x{FFA0}\x{E0000}-\x{E0FFF}]"
#: Names of the two speakers, and the entry types of messages besides a lacking one.
SPEAKERS = {"user": "user", "human": "user", "assistant": "assistant", "model": "assistant"}
MESSAGE_TYPES = ["user", "assistant", "message"]


def _plain(c: str) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"^\s+|\s+$", "")))


def messages_of(entries: DataFrame) -> DataFrame:
    """(session_id, uuid, entry_id, parent_uuid, turn_index, ts, speaker, visible) of the entries that are messages.

    Not sidechain (null: not), entry_type user, assistant, message or lacking, and a known speaker: the role or, where it
    lacks, the entry_type. Case and blanks around do not matter. An entry without uuid is a message of its own. Rows
    without session are dropped. Content is reduced to whether it shows anything, so texts are not shuffled.
    """
    kind, role = blank_to_null(_plain("entry_type")), blank_to_null(_plain("role"))
    speaker = F.create_map(*[F.lit(x) for pair in SPEAKERS.items() for x in pair])[F.coalesce(role, kind)]
    uuid = F.coalesce(blank_to_null(F.col("uuid")), F.concat(F.lit("\x00entry "), F.col("entry_id").cast("string")))
    return entries.where(F.col("session_id").isNotNull() & ~F.coalesce("is_sidechain", F.lit(False)) & (kind.isNull() | kind.isin(MESSAGE_TYPES)) & speaker.isNotNull()).select(
        "session_id", uuid.alias("uuid"), "entry_id", blank_to_null(F.col("parent_uuid")).alias("parent_uuid"), "turn_index", "ts",
        speaker.alias("speaker"), F.coalesce(F.col("content").rlike(VISIBLE), F.lit(False)).alias("visible"),
    )


def fold_log(events: DataFrame, keys: list[str], version: str, deleted: str | None = None) -> DataFrame:
    """The final state of each key: the event of the highest version; a key whose last event is a delete vanishes.

    Creates, edits and retries differ only in version. Null versions rank lowest; ties are settled by hash of the row.
    """
    last = latest_by(events, keys, [version])
    return last if deleted is None else last.where(~F.coalesce(F.col(deleted), F.lit(False)))


def conversations(entries: DataFrame) -> DataFrame:
    """(session_id, msg_pos, entry_id, speaker) of every message of every conversation that is whole.

    Entries of a session with equal uuid are retries of one message, of which the smallest entry_id is the final version.
    Where all messages of a session have a turn_index it gives the order, else ts; ties fall to entry_id, and a message
    without the time that orders its session breaks it. A session is kept if its first message is the user's, each user
    message is directly followed by an assistant's, every content shows something, each filled parent is a message of the
    session, and turn_index, where it orders, runs 0, 1, 2, ... Positions of long sessions are counted over many tasks.
    The folded messages and the placed ones, of which every check reads a few columns, are written once each.
    """
    turns = durable(fold_log(messages_of(entries).withColumn("version", -F.col("entry_id")), ["session_id", "uuid"], "version").drop("version"))
    sizes = turns.groupBy("session_id").agg(F.count("*").alias("n"), (F.count("turn_index") == F.count("*")).alias("by_turn"))
    keyed = join_stats(turns, sizes, ["session_id"], "n", ["uuid"])
    keyed = keyed.withColumn("k", F.when(F.col("by_turn"), F.col("turn_index").cast("long")).otherwise(F.unix_micros("ts")))
    placed = durable(positions(keyed.drop("n", "turn_index", "ts"), ["session_id"], [F.col("k"), F.col("entry_id"), F.col("uuid")], "msg_pos"))

    is_user = F.col("speaker") == "user"
    replies = placed.where(~is_user).select("session_id", (F.col("msg_pos") - 1).alias("msg_pos"))
    unanswered = placed.where(is_user).select("session_id", "msg_pos").join(replies, ["session_id", "msg_pos"], "left_anti").select("session_id")
    parents = placed.where(F.col("parent_uuid").isNotNull()).select("session_id", F.col("parent_uuid").alias("uuid")).distinct()
    orphaned = parents.join(placed.select("session_id", "uuid"), ["session_id", "uuid"], "left_anti").select("session_id")
    broken = unanswered.unionByName(orphaned).distinct()
    whole = placed.groupBy("session_id").agg(
        F.count("*").alias("n"),
        F.max((F.col("msg_pos") == 0) & is_user).alias("opens"),
        F.min("visible").alias("shown"),
        F.min(F.col("k").isNotNull() & (~F.col("by_turn") | (F.col("k") == F.col("msg_pos")))).alias("in_order"),
    ).where("opens AND shown AND in_order").join(broken, "session_id", "left_anti").select("session_id", "n")
    return join_stats(placed, whole, ["session_id"], "n", ["entry_id"]).select("session_id", F.col("msg_pos").cast("int").alias("msg_pos"), "entry_id", "speaker")


def transcripts(entries: DataFrame) -> DataFrame:
    """The kept conversations with their texts: (session_id, msg_pos, entry_id, speaker, content)."""
    texts = latest_by(entries.where(F.col("entry_id").isNotNull()).select("entry_id", "content"), ["entry_id"], [])
    return conversations(entries).join(texts, "entry_id").select("session_id", "msg_pos", "entry_id", "speaker", "content")
