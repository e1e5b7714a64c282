"""Votes and noise removal over repeated or doubtful readings."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import ordered


def majority_filter(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], votes: Column) -> DataFrame:
    """Rows holding the key's most voted value (ties: the one seen first), with how many were dropped."""
    counts = df.groupBy(*keys, value).agg(
        F.count_if(votes).alias("_n"), F.count("*").alias("_rows"), F.min(F.when(votes, F.struct(*order))).alias("_first")
    )
    best = counts.where("_n > 0").groupBy(*keys).agg(
        F.min_by(value, F.struct((-F.col("_n")).alias("n"), "_first")).alias("_v"),
        (F.sum("_n") - F.max("_n")).alias("dropped"),
    )
    return df.join(best.withColumnRenamed("_v", value), [*keys, value])


def consensus(df: DataFrame, keys: Sequence[str], reading: str) -> DataFrame:
    """The most frequent all-digit reading of each key; empty on a tie or when none is all digits."""
    digits = F.col(reading).rlike("^[0-9]+$")
    counts = df.groupBy(*keys, reading).agg(F.count_if(digits).alias("_n"))
    top = counts.groupBy(*keys).agg(F.max("_n").alias("_top"))
    best = counts.join(top, list(keys)).where((F.col("_n") == F.col("_top")) & (F.col("_n") > 0))
    won = best.groupBy(*keys).agg(F.count("*").alias("_ties"), F.min(reading).alias("_v"))
    agreed = F.when(F.col("_ties") == 1, F.col("_v"))
    return top.select(*keys).join(won.select(*keys, agreed.alias("agreed")), list(keys), "left").select(
        *keys, F.coalesce("agreed", F.lit("")).alias("agreed")
    )


def _level_step(value: str):
    def step(columns, state):
        tails = state
        levels = []
        for v in columns[value].tolist():
            at = bisect_left(tails, v)
            if at == len(tails):
                tails.append(v)
            else:
                tails[at] = v
            levels.append(at + 1)
        return {"_level": levels}, tails

    return step


def _choose_step(value: str):
    # state: level being chosen from (negated order), whether it is decided, value to stay below
    def step(columns, state):
        level, decided, below = state
        kept = []
        for rank, v in zip(columns["_rank"].tolist(), columns[value].tolist()):
            if rank != level:
                level, decided = rank, 0.0
            take = not decided and v < below
            if take:
                decided, below = 1.0, v
            kept.append(bool(take))
        return {"_kept": kept}, [level, decided, below]

    return step


def longest_increasing(df: DataFrame, keys: Sequence[str], pos: str, value: str) -> DataFrame:
    """Rows of the longest strictly increasing run of values in position order.

    The first scan gives each row the length of the best run ending there. Values of one length only fall
    with position, so the second scan, from the longest down, keeps the first row below the one kept before:
    the earliest predecessor and the first best end.
    """
    data = df.withColumn(value, F.col(value).cast("double"))
    levels = ordered(data, keys, [pos]).fold(_level_step(value), "_level int", []).df
    back = ordered(levels.withColumn("_rank", -F.col("_level")), keys, ["_rank", pos])
    chosen = back.fold(_choose_step(value), "_kept boolean", [0.0, 0.0, float("inf")]).df
    return chosen.where("_kept").drop("_kept", "_rank", "_level")


def repair_reading(text: Column) -> Column:
    """Look-alike letters as digits (O, o and the ideographic stop as 0; l, I and | as 1), then only digits, brackets, x."""
    return F.regexp_replace(F.translate(text, "Oo。lI|", "000111"), r"[^0-9()xX]", "")
