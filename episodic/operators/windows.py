"""Event windows from frame scores: hits or peaks, merging, sizing, confidence caps, persistence, and filling of timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .decide import persistent
from .intervals import clamped, gap_merge, padded

#: Classes whose state lasts once it has begun, and by class the least span in seconds, the gap in
#: sampling steps that is bridged, and the largest span as a share of the duration.
LASTING = ("traffic_congestion", "waterlogging_or_flood", "smoke", "fire")
SPANS = {
    "traffic_accident": (4.0, 1.6, 0.18), "traffic_congestion": (8.0, 2.2, 0.40), "loitering_or_suspicious_presence": (6.0, 1.6, 0.12), "vehicle_blocking_traffic": (4.0, 1.6, 0.15),
    "stalled_or_broken_down_vehicle": (6.0, 1.8, 0.20), "fighting_or_violence": (8.0, 2.0, 0.25), "road_spill_or_debris": (6.0, 1.6, 0.15), "wrong_way_driving": (4.0, 1.6, 0.15),
}
OTHER_SPAN = (4.0, 1.8, 0.20)


def with_spans(df: DataFrame, label: str, spans: dict[str, tuple[float, float, float]] = SPANS, other: tuple[float, float, float] = OTHER_SPAN) -> DataFrame:
    """Adds least_span, gap_steps and most_share of each row's class."""
    cfg = F.coalesce(F.create_map(*(x for k, v in spans.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))[F.col(label)] if spans else F.lit(None).cast("array<double>"), F.array(*map(F.lit, other)))
    return df.withColumns({"least_span": F.get(cfg, 0), "gap_steps": F.get(cfg, 1), "most_share": F.get(cfg, 2)})


def hits_or_peak(frames: DataFrame, keys: list[str], t: str, p: str, threshold: float, floor: float = 0.08, share: float = 0.5) -> DataFrame:
    """Frames at or above the threshold; a key without any keeps those at or above max(floor, share of its peak), at least its first peak."""
    w = W.partitionBy(*keys)
    peak = F.max(p).over(w)
    rows = frames.withColumns({"_peak": peak, "_first": F.row_number().over(w.orderBy(F.desc(p), t))})
    low = F.greatest(F.lit(floor), F.col("_peak") * share)
    keep = F.when(F.col("_peak") >= threshold, F.col(p) >= threshold).when(F.col("_peak") >= low, F.col(p) >= low).otherwise(F.col("_first") == 1)
    return rows.filter(keep).drop("_peak", "_first")


def argmax_windows(frames: DataFrame, keys: list[str], label: str, t: str, p: str, threshold: float, gap: float = 6.0, least: float = 1.0) -> DataFrame:
    """Windows of each label that wins frames at or above the threshold: end is start + ``least`` at least, conf the mean."""
    out = gap_merge(frames.filter(F.col(p) >= threshold), [*keys, label], t, t, gap, [F.avg(p).alias("conf")])
    return out.withColumn("end", F.greatest("end", F.col("start") + least))


def class_windows(frames: DataFrame, keys: list[str], t: str, p: str, threshold: float) -> DataFrame:
    """Windows of frames that are scored for a class they are known to hold: keys, island, start, end, n, conf.

    frames: also dt (sampling step), least_span, gap_steps, most_share and duration, alike in all rows of a key. Starts are
    clipped at 0, ends are not.
    """
    kept = hits_or_peak(frames, keys, t, p, threshold)
    fixed = [F.first(c).alias(c) for c in ("dt", "least_span", "most_share", "duration", "gap_steps")]
    out = gap_merge(kept, keys, t, t, F.col("dt") * F.col("gap_steps"), [F.avg(p).alias("conf"), *fixed])
    start, end = padded(F.col("start"), F.col("end"), F.col("dt") / 2, F.col("least_span"), F.col("most_share") * F.col("duration"))
    return out.withColumns({"start": start, "end": end})


def merge_windows(windows: DataFrame, keys: list[str], more: list[str] = ("dt", "gap_steps", "duration")) -> DataFrame:
    """A second pass over windows: those less than two bridged gaps apart become one, with the larger confidence."""
    gap = 2.0 * F.col("dt") * F.col("gap_steps")
    return gap_merge(windows, keys, "start", "end", gap, [F.max("conf").alias("conf"), *(F.first(c).alias(c) for c in more)], strict=True)


def cap_windows(windows: DataFrame, keys: list[str], relative: float, most: int) -> DataFrame:
    """Windows whose confidence reaches ``relative`` of the key's best, at most ``most`` of them (the most confident, then the earliest)."""
    w = W.partitionBy(*keys)
    rows = windows.withColumns({"_best": F.max("conf").over(w), "_r": F.row_number().over(w.orderBy(F.desc("conf"), "start"))})
    return rows.filter((F.col("conf") >= relative * F.col("_best")) & (F.col("_r") <= most)).drop("_best", "_r")


def persist_last(windows: DataFrame, keys: list[str], lasts: Column, share: float = 0.30) -> DataFrame:
    """The last window of a key whose class lasts grows to ``share`` of the duration, if that gains more than a second."""
    last = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("start"), F.desc("end"))) == 1
    to = F.least(F.col("duration") - 0.05, F.greatest(F.col("end"), F.col("start") + share * F.col("duration")))
    return windows.withColumn("_last", last).withColumn("end", F.when(F.col("_last") & lasts & (to > F.col("end") + 1.0), to).otherwise(F.col("end"))).drop("_last")


def submitted_windows(frames: DataFrame, keys: list[str], t: str, p: str, threshold: float, lasts: Column, relative: float = 0.0, most: int = 1_000_000) -> DataFrame:
    """The whole chain: windows, second merge, cap, persistence, clamp to [0, duration)."""
    out = merge_windows(class_windows(frames, keys, t, p, threshold), keys)
    out = persist_last(cap_windows(out, keys, relative, most), keys, lasts)
    start, end = clamped(F.col("start"), F.col("end"), F.col("duration"))
    return out.withColumns({"start": start, "end": end})


def fill_timeline(rows: DataFrame, frames: DataFrame, video: str, label: str, replace: bool = False, hits: int = 2, share: float = 0.10, spans: dict = SPANS, normal: str = "normal") -> DataFrame:
    """Prediction rows (video, level, label, start, end) with windows from frame labels where they are due.

    A video keeps its rows if its level is below 2, if it has no frames, if it has timed rows already (unless ``replace``),
    or if no class is seen in at least ``hits`` frames and ``share`` of them. frames: video, label, t, duration.
    """
    w = W.partitionBy(video)
    step = F.when(F.count("t").over(w) > 1, (F.max("t").over(w) - F.min("t").over(w)) / F.greatest(F.count("t").over(w) - 1, F.lit(1))).otherwise(5.0)
    seen = frames.withColumn("dt", step)
    lasting = persistent(seen, [video], label, hits, share).filter(F.col(label) != normal).select(video, label)
    hit = with_spans(seen.join(lasting, [video, label]), label, spans)
    made = gap_merge(hit, [video, label], "t", "t", F.col("dt") * F.col("gap_steps"), [F.first(c).alias(c) for c in ("dt", "least_span", "most_share", "duration")])
    start, end = padded(F.col("start"), F.col("end"), F.col("dt") / 2, F.col("least_span"), F.when(F.col("duration") > 0, F.col("most_share") * F.col("duration")).otherwise(1e9))
    end = F.when(F.col("duration") > 0, F.least(end, F.col("duration") - 0.05)).otherwise(end)
    made = made.withColumns({"start": start, "end": end}).filter("end > start")
    timed = F.max(F.col("start").isNotNull().cast("int")).over(w) == 1
    due = rows.withColumn("_due", (F.max("level").over(w) >= 2) & (F.lit(replace) | ~timed))
    videos = due.filter("_due").groupBy(video).agg(F.max("level").alias("level")).join(made.select(video).distinct(), video, "left_semi")
    kept = due.join(videos.select(video), video, "left_anti").select(video, "level", label, "start", "end")
    return kept.unionByName(videos.join(made.select(video, label, "start", "end"), video).select(video, "level", label, "start", "end"))
