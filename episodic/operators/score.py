"""Scores: confusion counts, label sets, interval overlap, one-to-one matching, marks by level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import f1, floored, iou_1d, ratio
from .rounds import checkpointed


def confusion(df: DataFrame, truth: Column, pred: Column, keys: list[str] = ()) -> DataFrame:
    c = lambda a, b: F.count_if((truth == F.lit(a)) & (pred == F.lit(b)))
    n = df.groupBy(*keys).agg(c(True, True).alias("tp"), c(False, True).alias("fp"), c(True, False).alias("fn"), c(False, False).alias("tn"))
    return n.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn")), "f1": f1(F.col("tp"), F.col("fp"), F.col("fn"))})


def label_set_scores(truth: DataFrame, pred: DataFrame, key: str, label: str) -> DataFrame:
    """tp, fp, fn, support, f1 of each label over distinct (key, label) pairs."""
    t, p = (d.select(key, label).distinct() for d in (truth, pred))
    both = t.withColumn("_t", F.lit(1)).join(p.withColumn("_p", F.lit(1)), [key, label], "full_outer")
    n = both.groupBy(label).agg(F.count_if(F.col("_t").isNotNull() & F.col("_p").isNotNull()).alias("tp"), F.count_if(F.col("_t").isNull()).alias("fp"), F.count_if(F.col("_p").isNull()).alias("fn"))
    return n.withColumns({"support": F.col("tp") + F.col("fn"), "f1": floored(f1(F.col("tp"), F.col("fp"), F.col("fn")), 3)})


def macro_f1(scores: DataFrame) -> DataFrame:
    """Mean of the rounded F1 over labels with support, rounded again."""
    return scores.agg(floored(F.avg(F.when(F.col("support") > 0, F.col("f1"))), 3).alias("macro_f1"))


def set_accuracy(truth: DataFrame, pred: DataFrame, key: str, label: str) -> DataFrame:
    gather = lambda d, name: d.groupBy(key).agg(F.array_sort(F.collect_set(label)).alias(name))
    both = gather(truth, "t").join(gather(pred, "p"), key, "left")
    return both.agg(F.count("*").alias("n"), F.count_if(F.col("t") == F.col("p")).alias("exact"))


def leveled(df: DataFrame, start: str, end: str, width: float, most: Column) -> DataFrame:
    """Deals intervals to an index of nested cells: adds level, cell and home.

    Cells of level k are ``width`` * 4^k long. An interval is at home on the first level whose cells are as long as it,
    where it touches two cells at most; it visits the levels above, up to ``most``, to meet longer ones. So a long
    interval makes no more rows than a short one.
    """
    own = F.greatest(F.lit(0), F.ceil(F.log(4.0, F.greatest((F.col(end) - F.col(start)) / width, F.lit(1.0))))).cast("int")
    size = lambda k: F.lit(width) * F.pow(F.lit(4.0), k)
    rows = df.withColumn("_own", own).withColumn("level", F.explode(F.sequence("_own", F.greatest(most, F.col("_own")))))
    rows = rows.withColumn("cell", F.explode(F.sequence(F.floor(F.col(start) / size(F.col("level"))), F.floor(F.col(end) / size(F.col("level"))))))
    return rows.withColumn("home", F.col("level") == F.col("_own")).drop("_own")


def overlaps(truth: DataFrame, pred: DataFrame, keys: list[str], least: float = 0.0, width: float = 24.0) -> DataFrame:
    """Pairs of intervals (id, start, end) of equal keys that overlap, with their iou.

    Both sides meet in nested time cells, on the level of the longer one; a pair counts in the cell of the later start.
    """
    t = truth.select(*keys, F.col("id").alias("t_id"), F.col("start").alias("t0"), F.col("end").alias("t1")).filter("t0 <= t1")
    p = pred.select(*keys, F.col("id").alias("p_id"), F.col("start").alias("p0"), F.col("end").alias("p1")).filter("p0 <= p1")
    span = lambda df, a, b: df.agg(F.coalesce(F.max(F.col(b) - F.col(a)), F.lit(0)).alias("_most"))
    level = F.greatest(F.lit(0), F.ceil(F.log(4.0, F.greatest(F.col("_most") / width, F.lit(1.0))))).cast("int")
    # What is longer than all of the other side is met at home: no interval visits further than the longest of the other side is.
    t = leveled(t.crossJoin(F.broadcast(span(p, "p0", "p1"))), "t0", "t1", width, level).drop("_most")  # one row on the right
    p = leveled(p.crossJoin(F.broadcast(span(truth.select(F.col("start").alias("t0"), F.col("end").alias("t1")), "t0", "t1"))), "p0", "p1", width, level).drop("_most")  # one row on the right
    t, p = t.withColumnRenamed("home", "_t"), p.withColumnRenamed("home", "_p")
    here = F.col("cell") == F.floor(F.greatest("t0", "p0") / (F.lit(width) * F.pow(F.lit(4.0), F.col("level"))))
    meet = t.join(p, [*keys, "level", "cell"]).filter((F.col("t0") < F.col("p1")) & (F.col("p0") < F.col("t1")) & (F.col("_t") | F.col("_p")) & here)
    return meet.drop("cell", "level", "_t", "_p").withColumn("iou", iou_1d(F.col("t0"), F.col("t1"), F.col("p0"), F.col("p1"))).filter(F.col("iou") >= least)


def _dominant(left: DataFrame, key: str) -> DataFrame:
    """Pairs that are the largest at both of their ends."""
    best = lambda side: left.groupBy(key, side).agg(F.max(F.struct("iou", "t_id", "p_id")).alias("b")).select(F.col(key), "b.*")
    return best("t_id").join(best("p_id"), [key, "t_id", "p_id", "iou"])


def greedy_match(pairs: DataFrame, key: str, small: int = 200) -> DataFrame:
    """One-to-one matches for each key: pairs from large to small (iou, t_id, p_id), taken if both are free.

    Keys with up to ``small`` pairs are walked through in one sorted array. Larger ones go in rounds over all their
    pairs: what is the largest pair at both its ends is taken, as nothing can come before it, and its neighbours
    drop out. That equals the order from large to small, and no task sees a whole key; a round goes through the
    checkpoint folder, and their number is the longest chain of neighbours with falling overlaps.
    """
    kind = dict(pairs.dtypes)
    rows = pairs.select(key, "t_id", "p_id", "iou").filter(F.col(key).isNotNull())
    size = rows.groupBy(key).agg(F.count("*").alias("_n"))
    pair = F.struct("iou", "t_id", "p_id")
    nothing = F.struct(*(F.array().cast(f"array<{kind[c]}>").alias(c) for c in ("t_id", "p_id")), F.array().cast(f"array<struct<iou:{kind['iou']},t_id:{kind['t_id']},p_id:{kind['p_id']}>>").alias("taken"))

    def walk(s: Column, x: Column) -> Column:
        free = ~F.array_contains(s["t_id"], x["t_id"]) & ~F.array_contains(s["p_id"], x["p_id"])
        return F.when(free, F.struct(F.array_append(s["t_id"], x["t_id"]).alias("t_id"), F.array_append(s["p_id"], x["p_id"]).alias("p_id"), F.array_append(s["taken"], x).alias("taken"))).otherwise(s)

    def walked(some: DataFrame) -> DataFrame:
        lists = some.groupBy(key).agg(F.sort_array(F.collect_list(pair), False).alias("all"))
        return lists.select(key, F.explode(F.aggregate("all", nothing, walk, lambda s: s["taken"])).alias("x")).select(key, "x.t_id", "x.p_id", "x.iou")

    large = size.filter(F.col("_n") > small).select(key)
    if large.isEmpty():
        return walked(rows)
    out = walked(rows.join(large, key, "left_anti"))
    left = checkpointed(rows.join(large, key, "left_semi"))
    while not left.isEmpty():
        taken = checkpointed(_dominant(left, key))
        out = out.unionByName(taken.select(key, "t_id", "p_id", "iou"))
        left = checkpointed(left.join(taken.select(key, "t_id"), [key, "t_id"], "left_anti").join(taken.select(key, "p_id"), [key, "p_id"], "left_anti"))
    return out


def level_one(df: DataFrame) -> DataFrame:
    """From arrays truth and pred of each video: half for the alarm, half for a class in common."""
    t, p = F.size("truth") > 0, F.size("pred") > 0
    alarm, cls = t == p, F.when(t, F.arrays_overlap("truth", "pred")).otherwise(~p)
    return df.withColumn("score", 0.5 * alarm.cast("int") + 0.5 * F.coalesce(cls, F.lit(False)).cast("int"))


def level_timed(n_truth: Column, n_pred: Column, matched: Column, mean_iou: Column, w_alert: float, w_match: float, w_timing: float) -> Column:
    normal = F.when(n_pred == 0, 1.0).otherwise(0.0)
    return F.when(n_truth == 0, normal).otherwise(w_alert * (n_pred > 0).cast("int") + w_match * matched / n_truth + w_timing * F.coalesce(mean_iou, F.lit(0.0)))


def paired(student: DataFrame, teacher: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of both sides with equal keys and a verdict on the student's; of a teacher's repeated keys the last row counts."""
    last = teacher.groupBy(key).agg(F.max_by("verdict", order).alias("teacher"))
    return student.filter("verdict is not null").select(key, F.col("verdict").alias("student")).join(last, key)
