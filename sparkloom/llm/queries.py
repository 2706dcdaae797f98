"""The queries of the training-data problems: each takes (spark, folder of tables) and runs over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import table as _t
from . import bpe, conversations, cooccur, distinctive, lookalike, packing, ranking, runs


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Terms typical of a symbol that only 2 to 12 symbols know."""
    return distinctive.typical_terms(_t(spark, d, "symbols")).select("symbol_id", "term")


def p1_tf_idf(spark: SparkSession, d: str) -> DataFrame:
    """Every term of every symbol with its score."""
    return distinctive.tf_idf(distinctive.symbol_terms(_t(spark, d, "symbols")), "symbol_id", "terms").withColumn("score", F.round("score", 9))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of files that change together at least 5 times and at least 5 times as often as chance."""
    pairs = cooccur.file_association(_t(spark, d, "commits"), least=5, most=30)
    return pairs.where(F.col("together") * F.col("n") >= 5 * F.col("n_a") * F.col("n_b")).select(F.col("a").alias("file_a"), F.col("b").alias("file_b"))


def p2_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of files over all commits with at least two, with its association and what the earlier report said."""
    pairs = cooccur.settle_report(cooccur.file_association(_t(spark, d, "commits")), _t(spark, d, "change_coupling"))
    rounded = {c: F.round(c, 9) for c in ("lift", "jaccard", "conf_ab", "conf_ba", "npmi")}
    return pairs.withColumns(rounded).drop("reported_confidence")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """First and last turn of each longest run of same turns."""
    return runs.repeated_turns(_t(spark, d, "turns")).select("session_id", "first_turn", "last_turn")


def p3_runs(spark: SparkSession, d: str) -> DataFrame:
    """The same with count and duration."""
    return runs.repeated_turns(_t(spark, d, "turns"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The example of each query that is ahead of each other one on more than half of the scores."""
    return ranking.clear_winners(_t(spark, d, "training_examples"), _t(spark, d, "files")).drop("tries")


def p4_ranking(spark: SparkSession, d: str) -> DataFrame:
    """All examples in the order of their query's weighted ideal-point ranking."""
    return ranking.ranked_candidates(_t(spark, d, "training_examples"), _t(spark, d, "files"), _t(spark, d, "fusion_weights"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Messages of the kept conversations in order."""
    return conversations.conversations(_t(spark, d, "session_entries")).select("session_id", "msg_pos", "entry_id")


def p5_transcripts(spark: SparkSession, d: str) -> DataFrame:
    """The same with speaker and text."""
    return conversations.transcripts(_t(spark, d, "session_entries"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encoded(_t(spark, d, "documents"), "doc_id", "text")


def p7_packing(spark: SparkSession, d: str) -> DataFrame:
    """Every document assigned to containers of each capacity."""
    return packing.packed_documents(_t(spark, d, "documents"), _t(spark, d, "token_budgets"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that differ as strings but look the same."""
    return lookalike.lookalike_pairs(_t(spark, d, "documents"), "doc_id", "text").select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p8_classes(spark: SparkSession, d: str) -> DataFrame:
    """Documents that look like others with a different text: their class and the number of such others."""
    return lookalike.lookalike_classes(_t(spark, d, "documents"), "doc_id", "text")


def p8_canonical(spark: SparkSession, d: str) -> DataFrame:
    """The canonical text of every document."""
    return lookalike.canonical_texts(_t(spark, d, "documents"), "doc_id", "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_tf_idf, p2_found, p2_pairs, p3_found, p3_runs, p4_found, p4_ranking, p5_found, p5_transcripts, p6_ids, p7_packing, p8_found, p8_classes, p8_canonical)
}
