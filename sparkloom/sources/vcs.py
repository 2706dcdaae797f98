"""Version-control logs as text files: commits, line counts, renames, blame."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import ship

#: Text before each commit of a log written with ``log --no-merges --name-only --format=<SEPARATOR>%H%x1f%aI%x1f%ar%x1f%s``.
SEPARATOR = "--commit--"


def commits(spark: SparkSession, path: str, separator: str = SEPARATOR) -> DataFrame:
    """(hash, ts, relative_date, message, files) of a log: the file is split at the separator by the text reader itself.

    Chunks without the four header fields or without files are dropped; a subject that holds the field mark is put together again.
    """
    chunks = spark.read.option("lineSep", separator).text(path).where("trim(value) <> ''")
    lines = F.filter(F.transform(F.split("value", "\n"), lambda x: F.trim(F.regexp_replace(x, "\r$", ""))), lambda x: x != "")
    head = F.split(lines[0], "\x1f")
    x = chunks.select(head.alias("h"), F.array_distinct(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))).alias("files")).where("size(h) >= 4 AND size(files) > 0")
    return x.select(F.col("h")[0].alias("hash"), F.expr("try_to_timestamp(h[1])").alias("ts"), F.col("h")[2].alias("relative_date"), F.array_join(F.expr("slice(h, 4, size(h))"), "\x1f").alias("message"), "files")


def line_counts(spark: SparkSession, path: str) -> DataFrame:
    """(file, added, deleted) of ``--numstat`` lines; binary files, whose counts are '-', keep null counts."""
    raw = spark.read.option("sep", "\t").schema("added string, deleted string, file string").csv(path)
    return raw.where("file IS NOT NULL").select("file", F.expr("try_cast(added AS bigint)").alias("added"), F.expr("try_cast(deleted AS bigint)").alias("deleted"))


def renames(spark: SparkSession, path: str) -> DataFrame:
    """(old, new, similarity) of the R rows of ``--name-status`` lines."""
    raw = spark.read.option("sep", "\t").schema("status string, old string, new string").csv(path)
    return raw.where(F.col("status").rlike("^R[0-9]*$") & F.col("new").isNotNull()).select("old", "new", F.expr("try_cast(substring(status, 2) AS int)").alias("similarity"))


def blame(spark: SparkSession, path: str, reference_seconds: int) -> DataFrame:
    """(file, line, days) of porcelain blame output, one text file per source file, named by ``file`` the output's path.

    A commit's author time is given once and holds for all its lines; time 0 means not yet committed and counts as 0 days.
    """
    ship(spark)
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for file, text in zip(b.file, b.value, strict=True):
                times: dict[str, int] = {}
                commit, line = "", 0
                for x in text.split("\n"):
                    word = x.split(" ")
                    if len(word) >= 3 and len(word[0]) == 40 and word[2].isdigit():
                        commit, line = word[0], int(word[2])
                    elif word[0] == "author-time" and len(word) == 2 and word[1].isdigit():
                        times[commit] = int(word[1])
                    elif x.startswith("\t") and line > 0:
                        at = times.get(commit, 0) or reference_seconds
                        rows.append((file, line, max(0.0, (reference_seconds - at) / 86400)))
            yield pd.DataFrame(rows, columns=["file", "line", "days"])

    return whole.mapInPandas(parse, "file string, line int, days double")
