"""Decision rules: argmax, top-k with margin, votes, gates, fusion, caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F


def softmax(scores: Column) -> Column:
    """Array of scores to array of (p, c) with class numbers from 0."""
    top = F.array_max(scores)
    e = F.transform(scores, lambda x: F.exp(x.cast("double") - top.cast("double")))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x, i: F.struct((x / total).alias("p"), i.alias("c")))


def ranked(probs: Column) -> Column:
    """(p, c) pairs from likely to unlikely; of equal ones the higher class first."""
    return F.reverse(F.array_sort(probs))


def argmax(probs: Column, threshold: float | None = None, normal: int = 0) -> Column:
    """Class of the largest p, the lowest class on ties. With a threshold: null for normal and below it."""
    best = F.array_max(F.transform(probs, lambda x: F.struct(x["p"].alias("p"), (-x["c"]).alias("c"))))
    return -best["c"] if threshold is None else F.when((best["c"] != -normal) & (best["p"] >= threshold), -best["c"])


def top_margin(probs: Column, threshold: Column | float, k: Column | int, margin: Column | float, scale: Column | float, normal: int = 0) -> Column:
    """Classes to report: eligible ones at or above the threshold; the first must reach scale * p(normal), others lie
    within the margin of the first; at most k; none means normal."""
    return top_of_ranked(ranked(probs), background(probs, normal), threshold, k, margin, scale, normal)


def background(probs: Column, normal: int = 0) -> Column:
    return F.get(F.filter(probs, lambda x: x["c"] == normal), 0)["p"]


def top_of_ranked(order: Column, background: Column, threshold: Column | float, k: Column | int, margin: Column | float, scale: Column | float, normal: int = 0) -> Column:
    """``top_margin`` from what ``ranked`` and ``background`` give, so that many settings share one ranking."""
    able = F.filter(order, lambda x: (x["c"] != normal) & (x["p"] >= threshold))
    first = F.get(able, 0)["p"]
    near = F.slice(F.filter(able, lambda x: first - x["p"] <= margin), 1, k)
    none = F.array().cast("array<int>")
    return F.coalesce(F.when(first >= background * scale, F.transform(near, lambda x: x["c"])), none)


def gate(probs: Column, p1: float = 0.60, margin: float = 0.25) -> Column:
    """Whether the first class is accepted without a second opinion."""
    r = ranked(probs)
    return (F.get(r, 0)["p"] >= p1) & (F.get(r, 0)["p"] - F.get(r, 1)["p"] >= margin)


def slate(probs: Column, k: int = 3, least: float = 0.05, normal: int = 0) -> Column:
    """Candidates for the second opinion: up to k classes of p >= least, the first always, and normal at the end if it is not among them."""
    some = F.transform(F.filter(F.slice(ranked(probs), 1, k), lambda x: (x["p"] >= least) | (x["p"] == F.array_max(probs)["p"])), lambda x: x["c"])
    return F.array_distinct(F.concat(some, F.array(F.lit(normal))))


def vote(df: DataFrame, keys: list[str], label: str, order: str) -> DataFrame:
    """Most frequent label (first seen on ties): keys, label, votes, share."""
    n = df.groupBy(*keys, label).agg(F.count("*").alias("votes"), F.min(order).alias("_seen"))
    w = W.partitionBy(*keys)
    n = n.withColumns({"share": F.col("votes") / F.sum("votes").over(w), "_rank": F.row_number().over(w.orderBy(F.desc("votes"), "_seen"))})
    return n.filter("_rank = 1").select(*keys, label, "votes", "share")


def persistent(df: DataFrame, keys: list[str], label: str, hits: int = 2, share: float = 0.10) -> DataFrame:
    """Labels with enough hits and a large enough share of the key's rows."""
    n = df.groupBy(*keys, label).agg(F.count("*").alias("hits"))
    n = n.withColumn("share", F.col("hits") / F.sum("hits").over(W.partitionBy(*keys)))
    return n.filter((F.col("hits") >= hits) & (F.col("share") >= share))


def fuse(base: DataFrame, key: str, first: DataFrame, second: DataFrame, normal: str = "normal") -> DataFrame:
    """First source's labels wholesale where any is not normal, else the second's, else normal. Sources: key, label."""
    strong = first.filter(F.col("label") != normal).select(key, "label").distinct()
    rest = base.select(key).join(strong, key, "left_anti").join(second.select(key, "label"), key, "left")
    return strong.unionByName(rest.select(key, F.coalesce("label", F.lit(normal)).alias("label")))


def class_cap(df: DataFrame, key: str, label: str, conf: str, relative: float, most: int) -> DataFrame:
    """Rows of a key's best labels: those whose best confidence reaches relative * the key's best, at most ``most`` of them."""
    best = df.groupBy(key, label).agg(F.max(conf).alias("best"))
    w = W.partitionBy(key)
    best = best.withColumns({"top": F.max("best").over(w), "rank": F.row_number().over(w.orderBy(F.desc("best"), label))})
    return df.join(best.filter((F.col("rank") <= most) & (F.col("best") >= F.col("top") * relative)).select(key, label, "rank"), [key, label])
