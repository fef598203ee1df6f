"""Splits, caps, balance and weights of a training set; orders come from md5, so any engine repeats them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F


def shuffled(group: list[str], key: str, seed: str) -> Column:
    """Place of a row in its group's seeded order, from 1."""
    return F.row_number().over(W.partitionBy(*group).orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key))


def split(df: DataFrame, group: list[str], key: str, share: float, seed: str = "s") -> DataFrame:
    """Adds ``part``: val for max(1, floor(n * share)) rows of each group with more than one row."""
    n = F.count("*").over(W.partitionBy(*group))
    return df.withColumn("part", F.when((n > 1) & (shuffled(group, key, seed) <= F.greatest(F.lit(1), F.floor(n * share))), "val").otherwise("train"))


def cap(df: DataFrame, group: list[str], key: str, most: int, seed: str = "s") -> DataFrame:
    return df.withColumn("_r", shuffled(group, key, seed)).filter(F.col("_r") <= most).drop("_r")


def balance(df: DataFrame, group: list[str], key: str, target: int, repeat: int = 3, seed: str = "s") -> DataFrame:
    """Trims groups to ``target`` rows or repeats rows up to min(target, n * repeat); adds ``copy``."""
    n = F.count("*").over(W.partitionBy(*group))
    ranked = df.withColumns({"_r": shuffled(group, key, seed), "_n": n})
    ceiling = F.least(F.lit(target), F.col("_n") * repeat)
    many = F.when(F.col("_r") <= ceiling, F.floor((ceiling - F.col("_r")) / F.col("_n")) + 1).otherwise(0).cast("int")
    return ranked.withColumn("_m", many).filter("_m > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_m")))).drop("_r", "_n", "_m")


def class_weights(counts: DataFrame, n: str = "n", most: float = 4.0) -> DataFrame:
    """Inverse square-root weights relative to the smallest, clamped."""
    every = W.partitionBy()
    raw = F.sqrt(F.sum(n).over(every) / (F.count("*").over(every) * F.col(n)))
    return counts.withColumn("_w", raw).withColumn("weight", F.least(F.col("_w") / F.min("_w").over(every), F.lit(most))).drop("_w")
