"""How distinctive a term is per record: term frequency times smoothed logarithmic inverse document frequency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import identifier_words
from ..shared import durable, join_stats, latest_by


def term_counts(records: DataFrame, key: str, terms: str) -> DataFrame:
    """(key, term, tf, n_terms) of records whose ``terms`` is an array; one row per distinct term of a record, and one with a null term per record.

    ``key`` must be unique. When the input is already partitioned by key, as after ``latest_by``, counting the exploded
    terms needs no further exchange. The row with a null term stands for the record itself, also where it has no terms;
    null elements are not counted.
    """
    kept = records.select(key, F.filter(F.coalesce(terms, F.array().cast("array<string>")), lambda t: t.isNotNull()).alias("terms"))
    long = kept.select(key, F.size("terms").alias("n_terms"), F.explode(F.array_append("terms", F.lit(None).cast("string"))).alias("term"))
    return long.groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("n_terms").alias("n_terms"))


def tf_idf(records: DataFrame, key: str, terms: str) -> DataFrame:
    """(key, term, tf, n_terms, df, score) for every term of every record.

    score = tf / n_terms * (ln((1 + N) / (1 + df)) + 1), N the number of records, df the number of records with the term.
    The counts of terms in records are written once; N and df are aggregates of that table, and df is joined back to it, a
    term that fills a large share of the rows being salted. Records without terms count in N and give no rows; an empty
    input gives an empty result.
    """
    counts = durable(term_counts(records, key, terms))
    total = counts.where(F.col("term").isNull()).agg(F.count("*")).first()[0]
    used = counts.where(F.col("term").isNotNull())
    df = used.groupBy("term").agg(F.count("*").alias("df"))
    joined = join_stats(used, df, ["term"], "df", [key])
    idf = F.log((1 + total) / (1 + F.col("df"))) + 1
    return joined.select(key, "term", "tf", "n_terms", "df", (F.col("tf") / F.col("n_terms") * idf).alias("score"))


def symbol_terms(symbols: DataFrame) -> DataFrame:
    """(symbol_id, terms) of the latest row of each symbol: words of name, body tokens and imports.

    Rows without id are dropped; null arrays, null and empty elements add nothing; of equal ids the row with the latest
    indexed_at holds, a null one ranking lowest. The words are taken before the exchange, so texts are not shuffled twice.
    """
    text = F.concat_ws(" ", "name", "body_tokens", "import_names")
    words = symbols.where(F.col("id").isNotNull()).select(F.col("id").alias("symbol_id"), "indexed_at", identifier_words(text).alias("terms"))
    return latest_by(words, ["symbol_id"], ["indexed_at"]).select("symbol_id", "terms")


def typical_terms(symbols: DataFrame, least_tf: int = 3, least_share: int = 20, df_low: int = 2, df_high: int = 12) -> DataFrame:
    """Scored terms that a symbol uses often and that only a few other symbols know."""
    scored = tf_idf(symbol_terms(symbols), "symbol_id", "terms")
    often = (F.col("tf") >= least_tf) & (F.col("tf") * least_share >= F.col("n_terms"))
    return scored.where(often & F.col("df").between(df_low, df_high))
