"""Fuzzy seed search: labels ranked by the rarity of the trigrams that they share with a query."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.relations import trigrams


def seed_scores(nodes: DataFrame, query: str) -> DataFrame:
    """(id, label, score) of nodes that share a trigram with query, score rounded to six places.

    A trigram weighs ln((N + 1) / (df + 1)) + 1. Labels' trigrams are filtered to the query's before anything is
    grouped, and weights are a table of at most that many rows.
    """
    wanted = nodes.sparkSession.range(1).select(F.explode(trigrams(F.lit(query))).alias("gram"))
    grams = nodes.select("id", "label", F.explode(trigrams(F.col("label"))).alias("gram")).join(F.broadcast(wanted), "gram")
    n = nodes.agg(F.count("*").alias("total"))
    weights = grams.groupBy("gram").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n))
    weights = weights.select("gram", (F.log((F.col("total") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    return grams.join(F.broadcast(weights), "gram").groupBy("id", "label").agg(F.round(F.sum("idf"), 6).alias("score"))


def ranked(scores: DataFrame, limit: int) -> DataFrame:
    return scores.orderBy(F.desc("score"), "label", "id").limit(limit)
