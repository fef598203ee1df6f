"""Training sets: moments inside and outside of events, frame budgets, cached frames, chat rows, staging, loss traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .intervals import complement, runs, spread_points

#: What the model is told, in training as at inference.
INSTRUCTION = "Look at the frame and answer with one JSON object: is_anomaly, class_name and description_summary."


def linspace(low: Column, high: Column, n: Column | int) -> Column:
    """n evenly spaced numbers from low to high (one: low)."""
    last = (n if isinstance(n, Column) else F.lit(n)) - 1
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.when(last > 0, low + (high - low) * k / last).otherwise(low))


def inside_outside(videos: DataFrame, n_in: int = 5, n_out: int = 2) -> DataFrame:
    """Sample times of labelled videos (video_id, class_name, start, end, duration): video_id, label, part, k, t.

    An interval counts if it ends after it starts, covers less than 0.85 of the video, and the class is not normal: then
    ``n_in`` times lie inside, and ``n_out`` normal ones before it, if it starts at 3 s or later, else after it, if 3 s are left.
    Other videos get ``n_in`` times over the whole length (one less below 8 s, at least 3).
    """
    span = F.col("end") - F.col("start")
    timed = F.coalesce((span > 0) & (span < 0.85 * F.greatest("duration", F.lit(0.1))) & (F.col("class_name") != "normal"), F.lit(False))
    parts = videos.filter("duration > 0").withColumn("timed", timed)
    whole = F.when(F.col("duration") >= 8, n_in).otherwise(max(3, n_in - 1))
    part = lambda label, name, low, high, n: F.struct(label.alias("label"), F.lit(name).alias("part"), linspace(low, high, n).alias("ts"))
    outside = F.when(F.col("start") >= 3, part(F.lit("normal"), "outside", F.lit(0.0), F.col("start"), n_out)).when(F.col("duration") - F.col("end") >= 3, part(F.lit("normal"), "outside", F.col("end"), F.col("duration"), n_out))
    chosen = F.when(F.col("timed"), F.array(part(F.col("class_name"), "inside", F.col("start"), F.col("end"), n_in), outside)).otherwise(F.array(part(F.col("class_name"), "whole", F.lit(0.0), F.col("duration"), whole)))
    rows = parts.select("video_id", F.explode(F.array_compact(chosen)).alias("p")).select("video_id", "p.label", "p.part", F.posexplode("p.ts").alias("k", "t"))
    return rows


def moments(videos: DataFrame, events: DataFrame, per_event: int = 6, per_video: int = 6, per_normal: int = 8, margin: float = 1.5, least: float = 2.0) -> DataFrame:
    """Labelled moments: inside each event of a video, in the gaps that no event covers (hard negatives), and over videos without events.

    videos: video_id, duration. events: video_id, label, start, end. Rows video_id, label, source (event, gap, normal), t.
    """
    ev = events.join(videos, "video_id").withColumns({"start": F.greatest(F.lit(0.0), F.col("start")), "end": F.least("duration", "end")})
    inside = ev.filter("end > start").select("video_id", "label", F.lit("event").alias("source"), F.explode(linspace(F.col("start"), F.col("end"), per_event)).alias("t"))
    gaps = spread_points(complement(ev, ["video_id"], "start", "end", F.col("duration"), margin, least), ["video_id"], per_video)
    gaps = gaps.select("video_id", F.lit("normal").alias("label"), F.lit("gap").alias("source"), "t")
    quiet = videos.filter("duration > 0").join(events.select("video_id").distinct(), "video_id", "left_anti")
    quiet = quiet.select("video_id", F.lit("normal").alias("label"), F.lit("normal").alias("source"), F.explode(linspace(F.col("duration") * 0.05, F.col("duration") * 0.95, per_normal)).alias("t"))
    return inside.unionByName(gaps).unionByName(quiet)


def frame_budget(videos: DataFrame, label: str, per_video: int, few: int = 150, capped: str = "traffic_accident", cap: int = 150, seed: str = "f") -> DataFrame:
    """Adds ``n_frames``: twice ``per_video`` for labels with fewer than ``few`` videos; of ``capped`` only ``cap`` videos stay, by hash."""
    w = W.partitionBy(label)
    order = F.row_number().over(w.orderBy(F.md5(F.concat(F.lit(seed), F.col("video_id").cast("string"))), "video_id"))
    kept = videos.withColumn("_r", order).filter((F.col(label) != capped) | (F.col("_r") <= cap)).drop("_r")
    return kept.withColumn("n_frames", F.when(F.count("*").over(w) < few, 2 * per_video).otherwise(per_video))


def frame_pack(videos: DataFrame, step: float = 5.0, most: int = 120, level_one: int = 8) -> DataFrame:
    """Frames to show for each video (video_id, level, frame_count, fps): frame_idx and t.

    From level 2 on an even grid of min(most, max(8, duration / step)) frames; at level 1 ``level_one`` frames spread alike
    (where motion is known, ``motion.picked_frames`` chooses them).
    """
    n = F.when(F.col("level") >= 2, F.least(F.lit(most), F.greatest(F.lit(8), F.col("frame_count") / F.col("fps") / step)).cast("int")).otherwise(level_one)
    idx = F.transform(linspace(F.lit(0.0), (F.col("frame_count") - 1).cast("double"), n), lambda x: x.cast("long"))
    rows = videos.filter("frame_count > 0 and fps > 0").select("video_id", "level", "fps", F.explode(idx).alias("frame_idx"))
    return rows.select("video_id", "level", "frame_idx", F.round(F.col("frame_idx") / F.col("fps"), 2).alias("t"))


def chat_rows(samples: DataFrame, text: Column) -> DataFrame:
    """Fine-tuning rows of samples (image, video_id, class_name): messages of a user and an assistant turn, the target as JSON."""
    target = F.to_json(F.struct((F.col("class_name") != "normal").alias("is_anomaly"), F.col("class_name"), text.alias("description_summary")))
    part = lambda kind, said: F.struct(F.lit(kind).alias("type"), said.alias("text"))
    none = F.lit(None).cast("string")
    turn = lambda role, *parts: F.struct(F.lit(role).alias("role"), F.array(*parts).alias("content"))
    messages = F.array(turn("user", part("image", none), part("text", F.lit(INSTRUCTION))), turn("assistant", part("text", target)))
    return samples.select("image", "video_id", "class_name", messages.alias("messages"))


def cached_frames(frames: DataFrame, labels: DataFrame, file: str = "file") -> DataFrame:
    """Frames named folder__stem__k.ext joined with the labels of their stems (stem, label): folder, stem, k, label."""
    parts = F.split(F.regexp_extract(file, r"([^/]*?)(\.[^./]*)?$", 1), "__")
    named = frames.select("*", F.get(parts, 0).alias("folder"), F.get(parts, 1).alias("stem"), F.get(parts, 2).alias("k")).filter(F.size(parts) == 3)
    return named.join(labels, "stem")


def uncached(frames: DataFrame, labels: DataFrame, file: str = "file") -> DataFrame:
    """Labels whose stem has no cached frame."""
    return labels.join(cached_frames(frames, labels, file).select("stem").distinct(), "stem", "left_anti")


def restage(rows: DataFrame, needed: set[str], path: str, by: str = "class_name") -> None:
    """Writes new rows by class; missing columns stop it before anything is written."""
    if missing := needed - set(rows.columns):
        raise ValueError(f"columns missing: {sorted(missing)}")
    rows.repartition(by).write.partitionBy(by).mode("overwrite").parquet(path)


def stopped_at(losses: DataFrame, keys: list[str], step: str, loss: str, most: int = 5) -> DataFrame:
    """The step at which each run must stop: the ``most``-th of as many losses in a row that are not finite."""
    bad = F.col(loss).isNull() | F.isnan(loss) | (F.abs(loss) == float("inf"))
    long = runs(losses, keys, step, bad).filter(F.col("length") >= most)
    first = long.groupBy(*keys).agg(F.min("first").alias("first"))
    order = W.partitionBy(*keys).orderBy(step)
    rows = losses.join(first, keys).filter(F.col(step) >= F.col("first")).withColumn("_r", F.row_number().over(order))
    return rows.filter(F.col("_r") == most).select(*keys, F.col(step).alias("stop_step"))


def label_tasks(events: DataFrame, done: DataFrame, key: str, in_rate: float, out_rate: float, free: bool = False) -> DataFrame:
    """Frames still to label, with the expected cost of each (1300 tokens in, 90 out); rows that failed are due again."""
    todo = events.join(done.filter("error is null").select(key), key, "left_anti")
    return todo.withColumn("cost", F.lit(0.0 if free else (1300 * in_rate + 90 * out_rate) / 1_000_000))


def sample_times(duration: Column, n: int, motion: bool = False) -> Column:
    """n sample times over 5 to 95 % of a clip; with motion they begin at 4 s, if that is earlier than 5 % (a reference frame needs what lies before)."""
    low = F.least(F.lit(4.0), duration * 0.05) if motion else duration * 0.05
    return linspace(low, duration * 0.95, n)
