"""Marks by level, tallies, label scores with undefined values, what-if of a patch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import floored, ratio
from .score import greedy_match, level_timed, overlaps

#: Marks of the levels and weights of alert, match and timing.
MARKS = {1: 25.0, 2: 35.0, 3: 40.0}
WEIGHTS = {2: (0.2, 0.5, 0.3), 3: (0.2, 0.4, 0.4)}
GATE = 0.5


def timed_counts(videos: DataFrame, truth: DataFrame, pred: DataFrame, video: str, keys: list[str], gate: float = GATE) -> DataFrame:
    """For each video: n_truth, n_pred, matched one to one at ``gate`` or more, false_alarms, mean_iou of the matches.

    truth and pred: ``keys`` (the video, and the class where it must agree), id, start, end. Truth without times is of
    another level and does not count; a prediction without times matches nothing and counts as a false alarm.
    """
    truth = truth.filter("start is not null and end is not null")
    match = greedy_match(overlaps(truth, pred.filter("start is not null and end is not null"), keys, gate), video)
    per = match.groupBy(video).agg(F.count("*").alias("matched"), F.avg("iou").alias("mean_iou"))
    n = lambda df, name: df.groupBy(video).agg(F.count("*").alias(name))
    all_ = videos.select(video).join(n(truth, "n_truth"), video, "left").join(n(pred, "n_pred"), video, "left").join(per, video, "left").fillna(0, ["n_truth", "n_pred", "matched"])
    return all_.withColumn("false_alarms", F.col("n_pred") - F.col("matched"))


def timed_score(level: int) -> Column:
    """Score of a row of ``timed_counts`` at level 2 or 3."""
    return level_timed(F.col("n_truth"), F.col("n_pred"), F.col("matched"), F.col("mean_iou"), *WEIGHTS[level])


def sheet(rows: DataFrame) -> DataFrame:
    """Marks of each level from rows level, score: level, videos, fraction, marks."""
    marks = F.create_map(*(F.lit(x) for kv in MARKS.items() for x in kv))[F.col("level")]
    out = rows.groupBy("level").agg(F.count("*").alias("videos"), F.avg("score").alias("fraction"))
    return out.withColumn("marks", F.col("fraction") * marks)


def tally(rows: DataFrame) -> DataFrame:
    """From arrays truth and pred: videos with anomalies, those found, false alarms (classes predicted that are not true)."""
    extra = F.size(F.array_except("pred", "truth"))
    return rows.agg(F.count_if(F.size("truth") > 0).alias("anomalous"), F.count_if(F.arrays_overlap("truth", "pred")).alias("found"), F.coalesce(F.sum(extra), F.lit(0)).alias("false_alarms"))


def label_scores(truth: DataFrame, pred: DataFrame, key: str, label: str) -> DataFrame:
    """Scores over distinct (key, label) pairs; precision and recall are null where undefined, f1 is 0 then."""
    t, p = (d.select(key, label).distinct().withColumn(name, F.lit(1)) for d, name in ((truth, "_t"), (pred, "_p")))
    n = t.join(p, [key, label], "full_outer").groupBy(label).agg(
        F.count_if(F.col("_t").isNotNull() & F.col("_p").isNotNull()).alias("tp"), F.count_if(F.col("_t").isNull()).alias("fp"), F.count_if(F.col("_p").isNull()).alias("fn"))
    n = n.withColumns({"precision": F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), "recall": F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))})
    f1 = F.coalesce(ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return n.withColumns({c: floored(F.col(c), 3) for c in ("precision", "recall")} | {"f1": floored(f1, 3), "support": F.col("tp") + F.col("fn")})


def severity_error(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Mean absolute difference, three digits; null without rows."""
    return pairs.agg(floored(F.avg(F.abs(F.col(a) - F.col(b))), 3).alias("severity_mae"), F.count("*").alias("n"))


def iou_summary(best: DataFrame, iou: str, gate: float = 0.3) -> DataFrame:
    """n, mean and recall at ``gate`` of the best overlaps; null without rows."""
    return best.agg(F.count("*").alias("n"), floored(F.avg(iou), 3).alias("mean_iou"), floored(F.avg((F.col(iou) >= gate).cast("double")), 3).alias("recall"))


def what_if(before: DataFrame, after: DataFrame, changed: DataFrame, video: str) -> DataFrame:
    """Rows of ``timed_counts`` before and after a patch for the changed videos, with ``worse``."""
    pick = lambda df, side: df.select(video, F.col("matched").alias(f"matched_{side}"), F.col("false_alarms").alias(f"false_alarms_{side}"))
    both = changed.select(video).distinct().join(pick(before, "before"), video).join(pick(after, "after"), video)
    return both.withColumn("worse", (F.col("matched_after") < F.col("matched_before")) | (F.col("false_alarms_after") > F.col("false_alarms_before")))


def stop(before: DataFrame, after: DataFrame) -> DataFrame:
    """Totals of two sheets and whether the patch must not be used."""
    total = lambda df, name: df.agg(floored(F.sum("marks"), 6).alias(name))
    return total(before, "total_before").crossJoin(total(after, "total_after")).withColumn("stop", F.col("total_after") < F.col("total_before"))  # one row by one row
