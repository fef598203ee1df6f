"""Where labels and verdicts come from: votes, clip means, gates and their replay, sources, decision modes, budgets, alerts."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.expr import floored, fused_verdict, verdict
from .assemble import complete

#: The settings that gates and votes are tried at.
GATE_P, GATE_MARGIN = (0.00, 0.10, 0.20, 0.30, 0.40, 0.50, 0.55, 0.60), (0.00, 0.05, 0.10, 0.15, 0.20, 0.25)
VOTE_FRAMES = (1, 2, 3, 4)


def votes(frames: DataFrame, video: str, label: str, least: int, order: str, multi: bool, normal: str = "normal") -> DataFrame:
    """Labels other than normal with ``least`` frames or more: all of them, or the most frequent (first seen on ties). Null labels do not vote."""
    n = frames.filter(F.col(label).isNotNull() & (F.col(label) != normal)).groupBy(video, label).agg(F.count("*").alias("n"), F.min(order).alias("_seen"))
    n = n.withColumn("_r", F.row_number().over(W.partitionBy(video).orderBy(F.desc("n"), "_seen")))
    return n.filter((F.col("n") >= least) & (F.lit(multi) | (F.col("_r") == 1))).select(video, label, "n")


def vote_histogram(frames: DataFrame, video: str, label: str) -> DataFrame:
    """A map label -> frames for each video."""
    n = frames.groupBy(video, label).agg(F.count("*").alias("n"))
    return n.groupBy(video).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(label, "n")))).alias("votes"))


def _macro(cfg: DataFrame, truth: DataFrame, keys: list[str], video: str, label: str) -> DataFrame:
    """Macro-F1 of every setting: distinct (settings, video, label) against the truth, over labels with support, without normal."""
    support = truth.select(video, label).distinct().groupBy(label).agg(F.count("*").alias("support"))
    n = cfg.select(*keys, video, label).distinct().join(truth.select(video, label).distinct().withColumn("_t", F.lit(1)), [video, label], "left")
    n = n.groupBy(*keys, label).agg(F.count("*").alias("selected"), F.count("_t").alias("tp"))
    every = cfg.select(*keys).distinct().crossJoin(F.broadcast(support))  # settings by labels, both fixed lists
    f1 = F.coalesce(2 * F.col("tp") / (F.col("selected") + F.col("support")), F.lit(0.0))
    return every.join(n, [*keys, label], "left").groupBy(*keys).agg(floored(F.avg(floored(f1, 3)), 3).alias("macro_f1"))


def vote_sweep(frames: DataFrame, truth: DataFrame, video: str, label: str, order: str, normal: str = "normal") -> DataFrame:
    """Macro-F1 of one or several labels a video at 1 to 4 frames. Votes are counted once; the settings ride along."""
    n = votes(frames, video, label, 1, order, True, normal).join(frames.groupBy(video, label).agg(F.min(order).alias("_seen")), [video, label])
    n = n.withColumn("_r", F.row_number().over(W.partitionBy(video).orderBy(F.desc("n"), "_seen")))
    grid = F.array(*(F.struct(F.lit(m).alias("multi"), F.lit(k).alias("least")) for m, k in product((False, True), VOTE_FRAMES)))
    rows = n.select("*", F.explode(grid).alias("g")).filter((F.col("n") >= F.col("g.least")) & (F.col("g.multi") | (F.col("_r") == 1)))
    return _macro(rows.select("g.*", video, label), truth.filter(F.col(label) != normal), ["multi", "least"], video, label)


def clip_means(frames: DataFrame, video: str, probs: str) -> DataFrame:
    """Mean probability of each class over a clip's frames, five digits: video, c, p, frames."""
    each = frames.select(video, F.explode(probs).alias("x")).groupBy(video, F.col("x.c").alias("c")).agg(F.avg("x.p").alias("p"), F.count("*").alias("frames"))
    return each.select(video, "c", floored(F.col("p"), 5).alias("p"), "frames")


def clip_macro_recall(frames: DataFrame, video: str, truth: str, probs: str) -> DataFrame:
    """Recall of each true class by the largest sum of a clip's probabilities (lowest class on ties): truth, clips, right, macro_recall."""
    sums = frames.select(video, truth, F.explode(probs).alias("x")).groupBy(video, truth, F.col("x.c").alias("c")).agg(F.sum("x.p").alias("p"))
    best = sums.groupBy(video, truth).agg((-F.max(F.struct(floored(F.col("p"), 9).alias("p"), (-F.col("c")).alias("c")))["c"]).alias("best"))
    each = best.groupBy(truth).agg(F.count("*").alias("clips"), F.count_if(F.col("best") == F.col(truth)).alias("right"))
    return each.withColumn("macro_recall", floored(F.avg(F.col("right") / F.col("clips")).over(W.partitionBy()), 6))  # one row for each class


def adjudicated(picked: Column, top1: Column) -> Column:
    """The second opinion, or the first class where there is none or it is off the list."""
    return F.coalesce(picked, top1)


def contested(p1: Column, margin: Column, least_p: Column | float, least_margin: Column | float) -> Column:
    return ~((p1 >= least_p) & (margin >= least_margin))


def replayed(label: Column, top1: Column, p1: Column, margin: Column, called: Column, picked: Column, least_p: Column | float, least_margin: Column | float) -> Column:
    """The label under another gate: a recorded second opinion where the row is contested, else the first class; rows without p1 keep theirs."""
    again = contested(p1, margin, least_p, least_margin) & F.coalesce(called, F.lit(False)) & picked.isNotNull()
    return F.when(p1.isNull() | margin.isNull(), label).when(again, picked).otherwise(top1)


def gate_sweep(trace: DataFrame, truth: DataFrame, video: str, label: str, normal: str = "normal") -> DataFrame:
    """Macro-F1 and number of contested rows of all 48 gates over a trace (label, top1, p1, margin, called, picked)."""
    grid = F.array(*(F.struct(F.lit(p).alias("least_p"), F.lit(m).alias("least_margin")) for p, m in product(GATE_P, GATE_MARGIN)))
    rows = trace.select("*", F.explode(grid).alias("g"))
    c = {k: F.col(k) for k in ("top1", "p1", "margin", "called", "picked")}
    rows = rows.select("g.*", video, contested(c["p1"], c["margin"], F.col("g.least_p"), F.col("g.least_margin")).alias("open"),
                       replayed(F.col(label), c["top1"], c["p1"], c["margin"], c["called"], c["picked"], F.col("g.least_p"), F.col("g.least_margin")).alias(label))
    keys = ["least_p", "least_margin"]
    n = rows.groupBy(*keys).agg(F.count_if("open").alias("contested"))
    return _macro(rows, truth.filter(F.col(label) != normal), keys, video, label).join(n, keys)


def best_first(report: DataFrame, by: list[str], most: int) -> DataFrame:
    """The top of a report: its first rows by descending columns."""
    return report.orderBy(*(F.desc(c) for c in by)).limit(most)


def sourced_labels(videos: DataFrame, appearance: DataFrame, rules: DataFrame, video: str, mode: str, rule_only: tuple[str, ...] = ("stalled_or_broken_down_vehicle",), emitted: tuple[str, ...] = (), short: float = 8.0, normal: str = "normal") -> DataFrame:
    """Labels of each video (video, duration) from the classifier's and the rules' rows (video, label).

    Clips below ``short`` seconds with rows of the classifier take these alone. Else, by mode: appearance: the classifier's;
    hybrid: also the rules' of classes that only rules can give; rules: both. A video left without rows is normal.
    """
    own = appearance.filter(F.col("label") != normal).select(video, "label").distinct()
    alone = videos.filter(F.col("duration") < short).select(video).join(own.select(video), video, "left_semi")
    may = {"appearance": F.lit(False), "hybrid": F.col("label").isin(*(c for c in rule_only if c not in emitted)), "rules": F.lit(True)}[mode]
    more = rules.filter((F.col("label") != normal) & may).select(video, "label").join(alone, video, "left_anti")
    return complete(videos, own.unionByName(more).distinct(), video, normal)


def anomalous_only(events: DataFrame, flag: str = "verdict.anomalous") -> DataFrame:
    """Events with an anomalous verdict; those without a verdict are dropped."""
    return events.filter(F.coalesce(F.col(flag), F.lit(False)))


def two_attempts(first: Column, second: Column) -> Column:
    """(verdict, attempts, parse_failed_once) of a free answer and a constrained retry; a failure of both is not anomalous."""
    a, b = verdict(first), verdict(second)
    good = a.isNotNull() & (F.length(F.trim(a["reason"])) > 0)
    safe = F.struct(F.lit(False).alias("anomalous"), F.lit(0.0).alias("severity"), F.lit("").alias("reason"))
    return F.struct(F.coalesce(F.when(good, a), b, safe).alias("verdict"), F.when(good, 1).otherwise(2).alias("attempts"), (~good).alias("parse_failed_once"))


def mock_verdict(context: Column) -> Column:
    """A stand-in for the model with the same contract: (anomalous, severity, reason) from words of the context."""
    text = F.lower(context)
    secs = F.nullif(F.regexp_extract(text, r"stationary for (\d+)s", 1), F.lit("")).cast("int")
    has = lambda w: F.contains(text, F.lit(w))
    out = lambda a, s, r: F.struct(F.lit(a).alias("anomalous"), (s if isinstance(s, Column) else F.lit(s)).alias("severity"), (r if isinstance(r, Column) else F.lit(r)).alias("reason"))
    return (F.when(has("person") & has("driving lane"), out(True, 0.85, "A person is in a live lane."))
            .when(has("wrong") | has("deviation"), out(True, 0.9, "A vehicle moves against its lane."))
            .when(secs.isNotNull() & has("congested"), out(False, 0.2, "A vehicle stands in a general jam."))
            .when(secs.isNotNull(), out(True, floored(F.least(F.lit(1.0), F.lit(0.4) + secs / F.lit(120.0)), 2), F.format_string("A vehicle has stood %d s while traffic flows.", secs)))
            .otherwise(out(False, 0.1, "Nothing unusual.")))


def decided(events: DataFrame, mode: str, keys: list[str], order: list[str], most_calls: int | None = None, queue: int | None = None) -> DataFrame:
    """Adds ``verdict`` (anomalous, severity) and ``route`` to events (rule_anomalous, rule_severity, observation, busy).

    rules: the rule's own; harvest: none; hybrid: the observation escalates the rule; vlm: the model's own. Calls count
    in ``order`` up to ``most_calls``; an event that meets ``queue`` or more pending calls (``busy``) is written without a
    verdict, like one past the budget. A call without a result falls back to the rule.
    """
    rule = F.struct(F.col("rule_anomalous").alias("anomalous"), F.col("rule_severity").alias("severity"))
    none = F.lit(None).cast("struct<anomalous:boolean,severity:double>")
    if mode in ("rules", "harvest"):
        return events.withColumns({"verdict": rule if mode == "rules" else none, "route": F.lit(mode)})
    free = F.lit(True) if queue is None else F.coalesce(F.col("busy") < queue, F.lit(True))
    nth = F.sum(free.cast("int")).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    rows = events.withColumns({"_free": free, "_nth": nth})
    called = F.col("_free") & (F.lit(True) if most_calls is None else F.col("_nth") <= most_calls)
    seen = F.col("observation")
    model = fused_verdict(F.col("rule_anomalous"), F.col("rule_severity"), seen["hazard_visible"], seen["hazard"]) if mode == "hybrid" else F.struct(seen["anomalous"].alias("anomalous"), seen["severity"].alias("severity"))
    done = F.when(seen.isNotNull(), model).otherwise(rule)
    route = F.when(~F.col("_free"), "queue full").when(~called, "budget spent").when(seen.isNull(), "failed, rule").otherwise(mode)
    return rows.withColumns({"route": route, "verdict": F.when(called, done)}).drop("_free", "_nth")


def alerts_shown(frames: DataFrame, alerts: DataFrame, keys: list[str], hold: float = 3.0) -> DataFrame:
    """For each frame (t) the number and the largest severity of alerts raised at most ``hold`` seconds before it.

    Both sides lie in one order, so the held alerts are a range window and no pairs are made.
    """
    both = frames.select(*keys, "t", F.lit(None).cast("double").alias("severity"), F.lit(1).alias("_frame")).unionByName(alerts.select(*keys, "t", F.col("severity").cast("double").alias("severity"), F.lit(0).alias("_frame")))
    micro = F.floor(F.col("t") * 1_000_000 + 0.5)
    w = W.partitionBy(*keys).orderBy("_t").rangeBetween(-int(hold * 1_000_000), 0)
    out = both.withColumn("_t", micro).withColumns({"alerts": F.count("severity").over(w), "most": F.max("severity").over(w)})
    return out.filter("_frame = 1").select(*keys, "t", "alerts", F.col("most").alias("severity"))


def log_line(t: Column, anomalous: Column, track: Column, name: Column, kind: Column, severity: Column, reason: Column) -> Column:
    """One line of a log for a verdict; events of the whole scene have no track."""
    return F.format_string("[%6.1fs] %s track %s %-10s %-18s sev=%.2f %s", t, F.when(anomalous, "ANOMALY").otherwise("benign "), F.coalesce(F.lpad(track.cast("string"), 3, " "), F.lit("  -")), name, kind, severity, reason)

