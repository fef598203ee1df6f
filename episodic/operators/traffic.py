"""Speeds, view geometry, box overlaps, detection reports and zone calibration over tracked boxes."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.expr import iou_2d, metres_per_pixel
from .intervals import others_median, runs

#: Names of the detector's classes by role.
VEHICLES = ("car", "motorcycle", "bus", "truck", "van", "motor", "tricycle", "awning-tricycle")
PEOPLE = ("person", "pedestrian", "people")
GROUPS = {"car": "vehicle", "van": "vehicle", "truck": "vehicle", "bus": "vehicle", "person": "person", "pedestrian": "person", "people": "person",
          "bicycle": "twowheel", "motorcycle": "twowheel", "motor": "twowheel"}
ANNOTATED = {1: "person", 2: "person", 3: "twowheel", 4: "vehicle", 5: "vehicle", 6: "vehicle", 7: "tricycle", 8: "tricycle", 9: "vehicle", 10: "twowheel"}
TARGETS = (*VEHICLES, *PEOPLE, "bicycle")


def known_classes(detections: DataFrame, targets: tuple[str, ...], name: str = "class_name") -> DataFrame:
    """Detections whose class is a target, by name; where no detection has one, nothing is filtered.

    The test is an aggregate over the classes that occur, joined as one row.
    """
    hit = F.lower(F.col(name)).isin(*targets)
    some = detections.agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("_some"))
    return detections.crossJoin(F.broadcast(some)).filter(hit | ~F.col("_some")).drop("_some")  # one row on the right


def is_vehicle(name: Column) -> Column:
    return F.lower(name).isin(*VEHICLES)


def is_person(name: Column) -> Column:
    return F.lower(name).isin(*PEOPLE)


def judged(diag: Column, frame_diag: Column, least: float = 0.02) -> Column:
    """Whether a box is large enough to be judged; with no frame size every box is."""
    return (frame_diag <= 1) | (diag / frame_diag >= least)


def speed_kmh(px_per_s: Column, name: Column, w: Column, h: Column) -> Column:
    return px_per_s * metres_per_pixel(name, w, h) * 3.6


def traffic_speeds(tracks: DataFrame, frame: list[str], track: str, moving: float = 0.05, most_oblique: float = 2.5) -> DataFrame:
    """Adds obliquity (largest by smallest scale of a frame's tracks, null below 3), traffic_kmh (median speed of the
    other moving vehicles) and reliable. tracks: class_name, m_per_px, kmh, norm_speed."""
    w = W.partitionBy(*frame)
    scaled = F.col("m_per_px") > 0
    ratio = F.max(F.when(scaled, F.col("m_per_px"))).over(w) / F.min(F.when(scaled, F.col("m_per_px"))).over(w)
    rows = tracks.withColumn("obliquity", F.when(F.count_if(scaled).over(w) >= 3, ratio))
    peer = is_vehicle(F.col("class_name")) & (F.col("kmh") > 0) & (F.col("norm_speed") >= moving)
    rows = others_median(rows, frame, "kmh", track, 1, peer).withColumnRenamed("others_median", "traffic_kmh")
    return rows.withColumn("reliable", F.col("traffic_kmh").isNotNull() & F.coalesce(F.col("obliquity") <= most_oblique, F.lit(False)))


def box_overlaps(truth: DataFrame, pred: DataFrame, keys: list[str], id_: str, least: float, cell: int = 128) -> DataFrame:
    """Pairs of boxes (x1, y1, x2, y2) of equal keys with iou of ``least`` (above 0) or more: keys, t_id, p_id, iou.

    Boxes meet in the grid cells they touch; a pair counts in the cell of its common corner.
    """
    cells = lambda c: F.sequence(F.floor(F.col(f"{c}1") / cell).cast("int"), F.floor(F.col(f"{c}2") / cell).cast("int"))

    def dealt(df: DataFrame, side: str) -> DataFrame:
        rows = df.withColumn("cx", F.explode(cells("x"))).withColumn("cy", F.explode(cells("y")))
        return rows.select(*keys, "cx", "cy", F.col(id_).alias(f"{side}_id"), *(F.col(c).alias(f"{side}_{c}") for c in ("x1", "y1", "x2", "y2")))

    box = lambda side: [F.col(f"{side}_{c}") for c in ("x1", "y1", "x2", "y2")]
    meet = dealt(truth, "t").join(dealt(pred, "p"), [*keys, "cx", "cy"])
    meet = meet.filter((F.col("cx") == F.floor(F.greatest("t_x1", "p_x1") / cell)) & (F.col("cy") == F.floor(F.greatest("t_y1", "p_y1") / cell)))
    return meet.withColumn("iou", iou_2d(box("t"), box("p"))).filter(F.col("iou") >= least).select(*keys, "t_id", "p_id", "iou")


def detection_report(anomalies: DataFrame, alerts: DataFrame, keys: list[str], least: float = 0.1) -> DataFrame:
    """For each true anomaly (id, frame_idx, box): detected, first frame and latency in frames, best iou, hits, alerts before it
    existed and elsewhere after. alerts: id, frame_idx, box, only anomalous ones."""
    pairs = box_overlaps(anomalies, alerts, keys, "id", least).join(alerts.select(*keys, F.col("id").alias("p_id"), F.col("frame_idx").alias("p_frame")), [*keys, "p_id"])
    pairs = pairs.join(anomalies.select(*keys, F.col("id").alias("t_id"), F.col("frame_idx").alias("t_frame")), [*keys, "t_id"]).filter("p_frame >= t_frame")
    hits = pairs.groupBy(*keys, F.col("t_id").alias("id")).agg(F.count("*").alias("hits"), F.min("p_frame").alias("first_frame"), F.max("iou").alias("best_iou"))
    # Alerts before and after each anomaly by rank in one order, without pairs.
    both = anomalies.select(*keys, "id", "frame_idx", F.lit(0).alias("alert")).unionByName(alerts.select(*keys, "id", "frame_idx", F.lit(1).alias("alert")))
    order = W.partitionBy(*keys).orderBy("frame_idx").rangeBetween(W.unboundedPreceding, -1)
    both = both.withColumns({"before": F.coalesce(F.sum("alert").over(order), F.lit(0)), "all": F.sum("alert").over(W.partitionBy(*keys))}).filter("alert = 0")
    out = both.join(hits, [*keys, "id"], "left")
    n = F.coalesce("hits", F.lit(0))
    return out.select(*keys, "id", F.col("hits").isNotNull().alias("detected"), "first_frame", (F.col("first_frame") - F.col("frame_idx")).alias("late_frames"), F.coalesce("best_iou", F.lit(0.0)).alias("best_iou"),
                      n.alias("hits"), F.col("before"), (F.col("all") - F.col("before") - n).alias("elsewhere"))


def tiny_recall(truth: DataFrame, hits: DataFrame, keys: list[str], group: str, frame_diag: float, tiny: float = 0.02) -> DataFrame:
    """Recall of each group, and of boxes below ``tiny`` of the frame's diagonal. hits: keys, t_id."""
    found = truth.join(hits.select(*keys, F.col("t_id").alias("id")).distinct().withColumn("_hit", F.lit(1)), [*keys, "id"], "left")
    small = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) / frame_diag < tiny
    return found.groupBy(group).agg(F.count("*").alias("boxes"), F.count("_hit").alias("found"), F.count_if(small).alias("tiny"), F.count_if(small & F.col("_hit").isNotNull()).alias("tiny_found"))


def negative_samples(tracks: DataFrame, frame: list[str], track: str, n: int = 1, least_age: float = 1.0, moving: float = 0.05, seed: str = "n") -> DataFrame:
    """Up to n ordinary tracks of each frame: live, old enough, moving, without an event; the choice is by hash of the seed."""
    able = tracks.filter((F.col("age_s") >= least_age) & (F.col("norm_speed") >= moving) & ~F.coalesce(F.col("fired"), F.lit(False)))
    order = F.row_number().over(W.partitionBy(*frame).orderBy(F.md5(F.concat_ws("|", F.lit(seed), *frame, track)), track))
    return able.withColumn("_r", order).filter(F.col("_r") <= n).drop("_r")


def heat(detections: DataFrame, keys: list[str], track: str, order: str, move: float = 0.25, still: float = 0.05, scale: int = 8) -> DataFrame:
    """Cells (gy, gx) with counts of moving and still vehicles and sums of heading; steps between rows of one track."""
    w = W.partitionBy(*keys, track).orderBy(order)
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    rows = detections.filter(is_vehicle(F.col("class_name"))).withColumns({"cx": cx, "cy": cy, "diag": F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))})
    rows = rows.withColumns({"dx": F.col("cx") - F.lag("cx").over(w), "dy": F.col("cy") - F.lag("cy").over(w), "dt": F.col(order) - F.lag(order).over(w)}).filter("dt > 1e-6")
    speed = F.hypot("dx", "dy") / F.when(F.col("diag") > 0, F.col("diag")).otherwise(1.0) / F.col("dt")
    length = F.when(F.hypot("dx", "dy") > 0, F.hypot("dx", "dy")).otherwise(1.0)
    rows = rows.withColumns({"moves": speed >= move, "stands": speed < still})
    return rows.groupBy(*keys, F.floor(F.col("cy") / scale).alias("gy"), F.floor(F.col("cx") / scale).alias("gx")).agg(
        F.count_if("moves").alias("moving"), F.count_if("stands").alias("still"),
        F.sum(F.when(F.col("moves"), F.col("dy") / length).otherwise(0.0)).alias("flow_sin"), F.sum(F.when(F.col("moves"), F.col("dx") / length).otherwise(0.0)).alias("flow_cos"))


def _blur(a: np.ndarray, sigma: float) -> np.ndarray:
    k = np.exp(-0.5 * (np.arange(-int(3 * sigma + 0.5), int(3 * sigma + 0.5) + 1) / sigma) ** 2)
    k /= k.sum()
    for axis in (0, 1):
        a = np.apply_along_axis(lambda row: np.convolve(np.pad(row, len(k) // 2, mode="reflect" if len(row) > len(k) // 2 else "edge"), k, mode="valid"), axis, a)
    return a


def _grown(mask: np.ndarray, r: int) -> np.ndarray:
    out = np.pad(mask, r)
    windows = np.lib.stride_tricks.sliding_window_view(out, (2 * r + 1, 2 * r + 1))
    return windows.any(axis=(2, 3))


def _regions(mask: np.ndarray, least: float) -> Iterator[np.ndarray]:
    """Connected parts (8 neighbours) of at least ``least`` cells, from the top left on."""
    left = mask.copy()
    for y, x in np.argwhere(mask):
        if left[y, x]:
            part, queue = np.zeros_like(mask), deque([(y, x)])
            left[y, x] = False
            while queue:
                a, b = queue.popleft()
                part[a, b] = True
                for c in range(max(a - 1, 0), min(a + 2, mask.shape[0])):
                    for d in range(max(b - 1, 0), min(b + 2, mask.shape[1])):
                        if left[c, d]:
                            left[c, d] = False
                            queue.append((c, d))
            if part.sum() >= least:
                yield part


def _outline(part: np.ndarray, scale: int) -> list[list[int]]:
    """Convex outline of a region's cells, in pixels."""
    ys, xs = np.nonzero(part)
    points = sorted({(int(x + dx) * scale, int(y + dy) * scale) for x, y in zip(xs, ys, strict=True) for dx in (0, 1) for dy in (0, 1)})

    def half(ps: list[tuple[int, int]]) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return [list(p) for p in half(points) + half(points[::-1])]


ZONE_ROWS = "name string, kind string, polygon array<array<int>>, flow_deg double, flow_consistency double, flow_samples long"


def calibrate_zones(cells: DataFrame, key: str, height: int, width: int, scale: int = 8, lane: float = 0.06, park: float = 0.35, sigma: float = 2.0, dilate: int = 2, least_area: float = 0.002) -> DataFrame:
    """Zones of each camera from its heat map: lanes with flow, and parking areas.

    The map has a fixed size (frame size by ``scale``), so a camera is one small task however long it was watched.
    Outlines are convex hulls of the regions.
    """
    h, w = height // scale, width // scale
    kind = dict(cells.dtypes)[key]

    def zones(frame: pd.DataFrame) -> pd.DataFrame:
        grid = {c: np.zeros((h, w)) for c in ("moving", "still", "flow_sin", "flow_cos")}
        inside = frame[(frame.gy >= 0) & (frame.gy < h) & (frame.gx >= 0) & (frame.gx < w)]
        for c, a in grid.items():
            a[inside.gy.astype(int), inside.gx.astype(int)] = inside[c]
        out, moving, still = [], _blur(grid["moving"], sigma), _blur(grid["still"], sigma)
        if grid["moving"].max() > 0:
            lanes = moving > moving.max() * lane
            for i, part in enumerate(_regions(_grown(lanes, dilate) if dilate else lanes, h * w * least_area), 1):
                s, c, n = (float(grid[k][part].sum()) for k in ("flow_sin", "flow_cos", "moving"))
                out.append((f"lane{i}", "driving_lane", _outline(part, scale), float(np.degrees(np.arctan2(s, c)) % 360) if s or c else None, round(float(np.hypot(s, c)) / n, 4) if n else 0.0, int(n)))
            if grid["still"].max() > 0:
                for i, part in enumerate(_regions((still > still.max() * park) & ~lanes, h * w * least_area), 1):
                    out.append((f"parking{i}", "parking", _outline(part, scale), None, None, None))
        rows = pd.DataFrame(out, columns=[x.split()[0] for x in ZONE_ROWS.split(", ")])
        rows.insert(0, key, frame[key].iloc[0])
        return rows

    return cells.groupBy(key).applyInPandas(zones, f"`{key}` {kind}, {ZONE_ROWS}")


def whole_frame_zone(videos: DataFrame, width: str = "width", height: str = "height") -> DataFrame:
    """One driving lane over each video's whole frame."""
    w, h = F.col(width), F.col(height)
    corners = F.array(F.array(F.lit(0), F.lit(0)), F.array(w, F.lit(0)), F.array(w, h), F.array(F.lit(0), h))
    return videos.select("video_id", F.lit("whole").alias("name"), F.lit("driving_lane").alias("kind"), corners.alias("polygon"))


def throughput(runs: DataFrame) -> DataFrame:
    """Run summaries under one set of names; frames, stride and required_fps have fall-backs."""
    has = lambda c: F.col(c) if c in runs.columns else F.lit(None)
    same = ("video", "resolution", "stage1_ms_mean", "stage1_ms_p95", "warm_fps", "source_fps", "realtime", "vlm_calls", "vlm_ms_mean", "vlm_ms_p95", "trigger_rate_pct", "feeds_per_gpu_estimate")
    return runs.select(*(has(c).alias(c) for c in same), F.coalesce(has("frames_processed"), has("frames")).cast("long").alias("frames"),
                       F.coalesce(has("stride"), F.lit(1)).cast("long").alias("stride"), F.coalesce(has("required_fps"), has("source_fps")).cast("double").alias("required_fps"))


def latency(frames: DataFrame, keys: list[str], order: str, ms: str, warmup: int = 5) -> DataFrame:
    """cold_ms (first frame), mean_ms, p95_ms and warm_fps over the frames after ``warmup`` (all, where there are no more)."""
    w = W.partitionBy(*keys)
    rows = frames.withColumns({"_r": F.row_number().over(w.orderBy(order)), "_n": F.count("*").over(w)})
    warm = F.when((F.col("_n") <= warmup) | (F.col("_r") > warmup), F.col(ms))
    return rows.groupBy(*keys).agg(F.max(F.when(F.col("_r") == 1, F.col(ms))).alias("cold_ms"), F.avg(warm).alias("mean_ms"), F.percentile(warm, F.lit(0.95)).alias("p95_ms"),
                                   F.try_divide(F.count(warm) * 1000.0, F.sum(warm)).alias("warm_fps"))


def speed_profile(tracks: DataFrame, keys: list[str], frame: str, speed: str, cuts: tuple[float, ...], share: float = 0.6, dt: float = 1.0) -> DataFrame:
    """For each key and cut: mean share of tracks below it in a frame, frames where the share reaches ``share``, longest run of such frames in time."""
    below = F.array(*(F.struct(F.lit(c).alias("cut"), F.avg((F.col(speed) < c).cast("double")).alias("share")) for c in cuts))
    per = tracks.groupBy(*keys, frame).agg(below.alias("x")).select(*keys, frame, F.explode("x").alias("x")).select(*keys, frame, "x.*")
    mean = per.groupBy(*keys, "cut").agg(F.avg("share").alias("mean_share"), F.count_if(F.col("share") >= share).alias("frames"))
    long = runs(per, [*keys, "cut"], frame, F.col("share") >= share).groupBy(*keys, "cut").agg((F.max("length") * dt).alias("longest"))
    return mean.join(long, [*keys, "cut"], "left").withColumn("longest", F.coalesce("longest", F.lit(0.0)))


def speed_quantiles(tracks: DataFrame, frame: list[str], speed: str, sketch: int | None = None) -> DataFrame:
    """p10, p25, p50, p75 of the speeds of each frame; with ``sketch`` (its size) from mergeable sketches of bounded size in place of all values."""
    qs = (0.10, 0.25, 0.50, 0.75)
    if sketch:
        return quantiles_of(sketched(tracks, frame, speed, sketch), frame, qs)
    return tracks.groupBy(*frame).agg(*(F.percentile(speed, F.lit(q)).alias(f"p{round(100 * q)}") for q in qs))


def sketched(rows: DataFrame, keys: list[str], value: str, size: int = 400) -> DataFrame:
    """A quantile sketch of each key's values: rows keys, sketch. A sketch of size 400 is some KB, whatever it has seen, and off by about 0.7 % in rank."""
    return rows.groupBy(*keys).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(size)).alias("sketch"))


def quantiles_of(sketches: DataFrame, keys: list[str], qs: tuple[float, ...]) -> DataFrame:
    """Quantiles p<percent> of each key from one or more sketches of it (of days, of files: they merge)."""
    whole = sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    return whole.select(*keys, *(F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias(f"p{round(100 * q)}") for q in qs))
