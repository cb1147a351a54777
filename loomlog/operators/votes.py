"""Majorities and weighted votes over answers of several proposers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Types in order of precedence: these win if any vote names them.
PRECEDENCE = ("none_t", "composite_t")
RANK_WEIGHTS = (3, 2, 1)


def plurality(votes: DataFrame, key: str, choice: str) -> DataFrame:
    """(key, choice, n): the choice with most votes, ties to the smaller one."""
    n = votes.groupBy(key, choice).agg(F.count("*").alias("n"))
    w = Window.partitionBy(key).orderBy(F.desc("n"), choice)
    return n.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def agreed(votes: DataFrame, key: str, choice: str, more_than: int = 1) -> DataFrame:
    """(key, choice, n) of the choices with more votes than that."""
    return votes.groupBy(key, choice).agg(F.count("*").alias("n")).where(F.col("n") > more_than)


def type_vote(votes: DataFrame, key: str, choice: str = "type", default: str = "string_t") -> DataFrame:
    """(key, type): a type of precedence if anyone named it, else the most common one."""
    best = plurality(votes.where(~F.col(choice).isin(*PRECEDENCE)), key, choice).select(key, F.col(choice).alias("_best"))
    first: Column = F.lit(None).cast("string")
    for p in reversed(PRECEDENCE):
        first = F.when(F.col(f"_{p}"), F.lit(p)).otherwise(first)
    special = votes.groupBy(key).agg(*[F.bool_or(F.col(choice) == p).alias(f"_{p}") for p in PRECEDENCE])
    return special.join(best, key, "left").select(key, F.coalesce(first, F.col("_best"), F.lit(default)).alias("type"))


def ranked_vote(votes: DataFrame, key: str, choice: str, rank: str, k: int = 3) -> DataFrame:
    """(key, choice, score, place): ranked answers weighted 3, 2, 1; the k best, ties to the smaller choice."""
    weight = F.coalesce(*[F.when(F.col(rank) == i + 1, F.lit(w)) for i, w in enumerate(RANK_WEIGHTS)], F.lit(0))
    n = votes.groupBy(key, choice).agg(F.sum(weight).alias("score"))
    w = Window.partitionBy(key).orderBy(F.desc("score"), choice)
    return n.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
