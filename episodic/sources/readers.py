"""Reading and writing of the engine's files with Spark's own sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS = T.StructType([T.StructField(n, T.StringType()) for n in ("video_id", "level", "is_anomaly", "class_name", "start_time_sec", "end_time_sec", "description_summary")])
NEEDED = {"video_id", "is_anomaly", "class_name"}
ZONES = "default_kind string, zones array<struct<name:string,kind:string,polygon:array<array<int>>,flow_deg:double,flow_consistency:double,flow_samples:int>>"


def read_json_lines(spark: SparkSession, path: str, schema: str, tolerant: bool = False) -> DataFrame:
    """Strict: a malformed line fails the read. Tolerant: it is dropped, and ``stem`` names the file."""
    df = spark.read.schema(schema).json(path, mode="DROPMALFORMED" if tolerant else "FAILFAST")
    return df.withColumn("stem", F.regexp_extract(F.input_file_name(), r"([^/]*?)(\.[^./]*)?$", 1)) if tolerant else df


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """Prediction or truth CSV; values stay strings until a column needs them. A byte order mark is ignored."""
    header = spark.read.csv(path, header=True)
    names = {c.lstrip("﻿"): c for c in header.columns}
    if missing := NEEDED - set(names):
        raise ValueError(f"columns missing: {sorted(missing)}")
    raw = header.select(*(F.col(f"`{c}`").alias(n) for n, c in names.items()))
    return raw.select("*", *(F.lit(None).cast("string").alias(f.name) for f in ROWS if f.name not in names))


def timed(rows: DataFrame) -> DataFrame:
    """Adds start and end as doubles: both or none."""
    s, e = (F.trim(F.col(c)).try_cast("double") for c in ("start_time_sec", "end_time_sec"))
    both = s.isNotNull() & e.isNotNull()
    return rows.withColumns({"start": F.when(both, s), "end": F.when(both, e)})


def last_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).filter("_r = 1").drop("_r")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """video_id, level from any of the four shapes; of repeated ids the last counts; an empty manifest is an error."""
    text = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    top = text.select(F.coalesce(*(F.try_variant_get("v", f"$.{k}", "variant") for k in ("videos", "predictions", "manifest", "items")), "v").alias("v"))
    kind = F.schema_of_variant("v")
    listed = top.filter(kind.startswith("ARRAY")).select(F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("pos", "x"))
    one = listed.select("pos", F.coalesce(*(F.try_variant_get("x", p, "string") for p in ("$.video_id", "$.id", "$.name")), F.when(F.schema_of_variant("x") == "STRING", F.try_variant_get("x", "$", "string"))).alias("video_id"), F.try_variant_get("x", "$.level", "int").alias("level"))
    mapped = top.filter(kind.startswith("OBJECT")).select(F.explode(F.try_variant_get("v", "$", "map<string,variant>")).alias("video_id", "x"))
    two = mapped.select(F.monotonically_increasing_id().alias("pos"), "video_id", F.coalesce(F.try_variant_get("x", "$.level", "int"), F.try_variant_get("x", "$", "int")).alias("level"))
    rows = one.unionByName(two.withColumn("pos", F.col("pos").cast("int"))).filter("video_id is not null")
    rows = last_of(rows, "video_id", "pos").select("video_id", F.coalesce("level", F.lit(1)).alias("level"))
    if rows.isEmpty():
        raise ValueError("the manifest has no videos")
    return rows


def read_zones(spark: SparkSession, path: str) -> DataFrame:
    z = spark.read.schema(ZONES).json(path, multiLine=True).withColumn("video_id", F.regexp_extract(F.input_file_name(), r"([^/]*?)(\.[^./]*)?$", 1))
    return z.select("video_id", "default_kind", F.posexplode_outer("zones").alias("ordinal", "zone")).select("video_id", "default_kind", "ordinal", "zone.*")


RUN = "video string, frames bigint, wall_ms double, model_runtimes array<struct<model_name:string,call_count:int,total_time_ms:double,average_time_ms:double>>"


def read_summaries(spark: SparkSession, path: str, overlay: str | None = None) -> DataFrame:
    """Run summaries (object or list), sidecar values over them where they are given."""
    df = spark.read.schema(RUN).json(path, multiLine=True)
    if not overlay:
        return df
    extra = spark.read.schema(RUN).json(overlay, multiLine=True)
    rest = [c for c in df.columns if c != "video"]
    both = df.join(extra.select("video", *(F.col(c).alias(f"_{c}") for c in rest)), "video", "left")
    return both.select("video", *(F.coalesce(f"_{c}", c).alias(c) for c in rest))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Truth rows grouped by video: video_id, level (of its last row), rows (is_anomaly, class_name, start, end)."""
    rows = timed(read_rows(spark, path)).withColumn("_at", F.monotonically_increasing_id())
    row = F.struct("_at", "is_anomaly", "class_name", "start", "end")
    return rows.groupBy("video_id").agg(F.max_by("level", "_at").try_cast("int").alias("level"), F.transform(F.sort_array(F.collect_list(row)), lambda r: F.struct(r["is_anomaly"], r["class_name"], r["start"], r["end"])).alias("rows"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Prediction rows of each video in the order of the file: video_id, rows."""
    rows = read_rows(spark, path).withColumn("_at", F.monotonically_increasing_id())
    fields = [f.name for f in ROWS if f.name != "video_id"]
    return rows.groupBy("video_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", *fields))), lambda r: F.struct(*(r[c] for c in fields))).alias("rows"))


def read_class_truth(spark: SparkSession, folder: str) -> DataFrame:
    """Truth of training folders <class>/ground_truth.csv with the file names of <class>/videos.csv; the folder stands in for a missing class."""
    named = lambda name: spark.read.csv(f"{folder}/*/{name}", header=True).withColumn("class_folder", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1))
    truth = named("ground_truth.csv")
    truth = truth.select("class_folder", *(F.col(c) if c in truth.columns else F.lit(None).cast("string").alias(c) for c in (f.name for f in ROWS)))
    files = id_map(named("videos.csv"), ["class_folder"])
    out = truth.join(files, ["class_folder", "video_id"], "left").withColumn("class_name", F.coalesce("class_name", "class_folder"))
    return timed(out).withColumn("description_summary", F.coalesce("description_summary", F.lit("")))


def id_map(listed: DataFrame, more: list[str] = ()) -> DataFrame:
    """video_id and file of a list of videos whose columns are guessed by name: an id column, else the file's stem."""
    find = lambda words, rest: next((c for w in words for c in listed.columns if w in c.lower() and c not in rest and c not in more), None)
    file = find(("file", "path", "video_name", "name"), ())
    key = find(("video_id", "id"), (file,))
    if not (file or key):
        raise ValueError(f"no id and no file among {listed.columns}")
    stem = F.regexp_extract(F.col(file or key), r"([^/\\]*?)(\.[^./\\]*)?$", 1)
    return listed.select(*more, (F.col(key) if key else stem).alias("video_id"), (F.col(file) if file else F.lit(None).cast("string")).alias("file"))


def read_intervals(spark: SparkSession, folder: str, known: tuple[str, ...]) -> DataFrame:
    """Events (video_id, label, start, end) of known classes with both times."""
    rows = read_class_truth(spark, folder).filter(F.col("class_name").isin(*known) & F.col("start").isNotNull())
    return rows.select("video_id", F.col("class_name").alias("label"), "start", "end")


def frame_labels(rows: DataFrame, known: tuple[str, ...]) -> DataFrame:
    """Frames with ``label``: the parsed class, null (no vote) where it is missing or unknown. rows: video_id, t_sec, parsed."""
    name = F.col("parsed.class_name")
    return rows.select("video_id", "t_sec", F.when(name.isin(*known), name).alias("label"), F.coalesce("parsed.description_summary", F.lit("")).alias("text"))


def read_boxes(spark: SparkSession, path: str, groups: dict[int, str]) -> DataFrame:
    """Boxes of annotation files with lines x,y,w,h,score,category,...: stem, group, x1, y1, x2, y2; empty boxes and unmapped categories are dropped."""
    text = spark.read.text(path).withColumn("stem", F.regexp_extract(F.input_file_name(), r"([^/]*?)(\.[^./]*)?$", 1))
    part = text.withColumn("p", F.filter(F.split("value", r"[,\s]+"), lambda x: x != "")).filter(F.size("p") >= 6)
    x, y, w, h = (F.get("p", k).try_cast("double") for k in range(4))
    group = F.create_map(*(F.lit(v) for kv in groups.items() for v in kv))[F.get("p", 5).try_cast("int")]
    return part.select("stem", group.alias("group"), x.alias("x1"), y.alias("y1"), (x + w).alias("x2"), (y + h).alias("y2")).filter("group is not null and x2 > x1 and y2 > y1")


VIDEO_FILES, IMAGE_FILES = ("mp4", "avi", "mov", "mkv", "webm"), ("jpg", "jpeg", "png", "bmp")


def video_files(spark: SparkSession, folder: str) -> DataFrame:
    """Videos below a folder, by name only (no content is read): video files, and folders of numbered images with their number of frames."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    ext = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    files = found.filter(ext.isin(*VIDEO_FILES)).select(F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1).alias("video_id"), F.col("path").alias("file"), F.lit(None).cast("long").alias("frame_count"))
    image = found.filter(ext.isin(*IMAGE_FILES)).withColumn("dir", F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).groupBy("dir").agg(F.count("*").alias("frame_count"))
    return files.unionByName(image.select(F.regexp_extract("dir", r"([^/]*)$", 1).alias("video_id"), F.col("dir").alias("file"), "frame_count"))


def probed(videos: DataFrame, default_fps: float = 25.0) -> DataFrame:
    """Adds fps (a default where it is not known) and duration from frame counts of headers."""
    fps = F.when(F.col("fps") > 0, F.col("fps")).otherwise(default_fps)
    return videos.withColumn("fps", fps).withColumn("duration", F.coalesce(F.col("frame_count") / F.col("fps"), F.lit(0.0)))


def discover(files: DataFrame, listed: DataFrame) -> DataFrame:
    """All listed videos, with or without a file, and files nobody lists: video_id, file, found. Videos without a file get a normal row later."""
    mine = files.select("video_id", F.col("file").alias("_file"))
    both = listed.select("video_id").distinct().join(mine, "video_id", "full_outer")
    return both.select("video_id", F.col("_file").alias("file"), F.col("_file").isNotNull().alias("found"))


def write_zones(zones: DataFrame, path: str, source: str, default_kind: str = "unknown") -> None:
    """One JSON object for each video: default_kind, source, zones in order."""
    rest = [c for c in zones.columns if c not in ("video_id", "ordinal", "default_kind")]
    nested = zones.groupBy("video_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", *rest))), lambda z: F.struct(*(z[c] for c in rest))).alias("zones"))
    nested.select("video_id", F.lit(default_kind).alias("default_kind"), F.lit(source).alias("source"), "zones").write.mode("overwrite").json(path)


def frame_indexes(videos: DataFrame, stride: int, most: int | None = None) -> DataFrame:
    n = F.floor((F.col("frame_count") - 1) / stride)
    last = n if most is None else F.least(n, F.lit(most - 1))
    rows = videos.filter("frame_count > 0").select("video_id", "fps", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("k"))
    return rows.select("video_id", (F.col("k") * stride).alias("frame_idx"), (F.col("k") * stride / F.col("fps")).alias("t"))


def not_done(tasks: DataFrame, output: DataFrame, key: str) -> DataFrame:
    """Tasks without a good row in the output."""
    return tasks.join(output.filter("error is null").select(key), key, "left_anti")


def write_rows(df: DataFrame, path: str) -> None:
    """CSV with the fixed columns; booleans in lower case."""
    out = df.withColumn("is_anomaly", F.lower(F.col("is_anomaly").cast("string")))
    out.select(*(F.col(f.name) for f in ROWS)).write.mode("overwrite").csv(path, header=True)


def write_json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def append_stream(stream: DataFrame, path: str, checkpoint: str, **options: str):
    """Starts a query that appends a stream to a folder of JSON lines; a batch that runs again replaces its own rows.

    Every batch has a folder of its own, named by its number: the folders are the ledger of batches, and writing one
    anew after a failure leaves neither half a batch nor rows twice. ``read_stream_folder`` reads them.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").json(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(options or {"availableNow": True})).start()


def read_stream_folder(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows that ``append_stream`` wrote, without the batch numbers."""
    return spark.read.schema(f"{schema}, batch bigint").json(path).drop("batch")
