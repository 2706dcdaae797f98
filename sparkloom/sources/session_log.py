"""Agent session logs, one JSON object a line, as turns."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sessions import segment

ENTRY = "type string, timestamp timestamp, sessionId string, isSidechain boolean, message struct<role: string, content: string, usage: struct<input_tokens: bigint, output_tokens: bigint, cache_read_input_tokens: bigint, cache_creation_input_tokens: bigint>>"
BLOCKS = "array<struct<type: string, name: string, input: struct<command: string, file_path: string, path: string, notebook_path: string, pattern: string>>>"
#: Smallest log, most logs, output tokens from which a text answer counts.
SMALLEST, NEWEST, COUNTABLE = 100, 20, 50
UNIT = {"m": "minutes", "h": "hours", "d": "days", "w": "weeks"}


def duration(text: str) -> timedelta:
    """7d, 3h, 15m or 2w."""
    m = re.fullmatch(r"\s*(\d+)([mhdw])\s*", text)
    if not m:
        raise ValueError(f"not a duration: {text!r}")
    return timedelta(**{UNIT[m[2]]: int(m[1])})


def discover(spark: SparkSession, folder: str, since: datetime | None = None, newest: int = NEWEST) -> DataFrame:
    """(path, modified, bytes) of the newest logs of over 100 bytes below a folder; contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").load(folder)
    x = f.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes")).where(F.col("bytes") > SMALLEST)
    if since is not None:
        x = x.where(F.col("modified") >= F.lit(since))
    return x.orderBy(F.col("modified").desc(), "path").limit(newest)


def entries(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Log lines as rows; lines that are no JSON objects of this form are dropped. A session is its id or else its file."""
    raw = spark.read.schema(ENTRY).option("mode", "DROPMALFORMED").json(paths)
    x = raw.select("*", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line")).where("type IS NOT NULL")
    blocks = F.filter(F.from_json("message.content", BLOCKS), lambda b: b["type"] == "tool_use")
    tools = F.transform(F.coalesce(blocks, F.array().cast(BLOCKS)), lambda b: F.struct(b["name"].alias("name"), b["input"]["command"].alias("command"), F.coalesce(b["input"]["file_path"], b["input"]["path"], b["input"]["notebook_path"]).alias("path")))
    u = "message.usage"
    tokens = {"input_tokens": "input_tokens", "output_tokens": "output_tokens", "cache_read_tokens": "cache_read_input_tokens", "cache_creation_tokens": "cache_creation_input_tokens"}
    return x.select(F.coalesce("sessionId", "file").alias("session_id"), "file", "line", F.col("type").alias("entry_type"), "message.role", F.col("timestamp").alias("ts"), F.coalesce("isSidechain", F.lit(False)).alias("is_sidechain"), tools.alias("tools"), *[F.coalesce(f"{u}.{b}", F.lit(0)).alias(a) for a, b in tokens.items()])


def turns(log: DataFrame) -> DataFrame:
    """Turns of a log: every assistant message with tools closes one; what text-only messages used before it is added to it.

    At the end of a session text-only messages form a turn of their own if they put out more than COUNTABLE tokens.
    """
    said = log.where((F.col("entry_type") == "assistant") & ~F.col("is_sidechain")).drop("is_sidechain", "role")
    cut = segment(said, [F.col("ts").asc_nulls_first(), F.col("file"), F.col("line")], F.size("tools") > 0)
    t = cut.groupBy("session_id", F.col("turn").cast("int").alias("turn_index")).agg(
        F.max("ts").alias("ts"), F.flatten(F.collect_list("tools")).alias("tools"),
        *[F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")],
    )
    paths = F.array_distinct(F.filter(F.transform("tools", lambda x: x["path"]), lambda p: p.isNotNull()))
    return t.where((F.size("tools") > 0) | (F.col("output_tokens") > COUNTABLE)).withColumn("file_paths", paths)
