"""Result documents: completion, overlay, nesting, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.expr import LABELS


def complete(ids: DataFrame, rows: DataFrame, key: str, normal: str = "normal") -> DataFrame:
    """rows (key, label) and a normal row for each id without any."""
    missing = ids.select(key).join(rows.select(key), key, "left_anti").withColumn("label", F.lit(normal))
    return rows.select(key, "label").unionByName(missing)


def patch(banked: DataFrame, candidate: DataFrame, key: str, chosen: DataFrame | None = None) -> DataFrame:
    """Rows of the candidate's ids replace the banked ones. With ``chosen`` only those ids; one that the candidate lacks is an error."""
    if chosen is not None:
        if some := unknown_ids(candidate, chosen, key).limit(8).collect():
            raise ValueError(f"the candidate has no rows for {[r[0] for r in some]}")
        candidate = candidate.join(chosen.select(key).distinct(), key, "left_semi")
    return banked.join(candidate.select(key).distinct(), key, "left_anti").unionByName(candidate)


def unknown_ids(banked: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """Chosen ids that the banked rows do not have: a patch with any of these is an error."""
    return chosen.select(key).distinct().join(banked.select(key), key, "left_anti")


def overlay(base: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """Columns of extra, where they are not null, over those of base."""
    both = [c for c in base.columns if c in extra.columns and c != key]
    e = extra.select(key, *(F.col(c).alias(f"_{c}") for c in both))
    return base.join(e, key, "left").select(*(F.coalesce(f"_{c}", c).alias(c) if c in both else c for c in base.columns))


def documents(ids: DataFrame, events: DataFrame, more: list[str] = ()) -> DataFrame:
    """One row for each id with its events nested in order of start; ids without events get an empty array."""
    item = F.struct("start", "class_name", "end", *more)
    nested = events.groupBy("video_id").agg(F.sort_array(F.collect_list(item)).alias("events"))
    kind = nested.schema["events"].dataType.simpleString()
    return ids.join(nested, "video_id", "left").withColumn("events", F.coalesce("events", F.array().cast(kind)))


def to_json(docs: DataFrame, model: str, run: Column | None = None) -> DataFrame:
    """One JSON text for each document row."""
    return docs.select(F.to_json(F.struct(F.lit("1.0").alias("schema_version"), F.lit(model).alias("model_name"), *([run.alias("run_metadata")] if run is not None else []), F.struct(*docs.columns).alias("prediction"))).alias("value"))


def first_of_same(events: DataFrame, digits: int = 3) -> DataFrame:
    """Events that agree in id, label and rounded times: one stays."""
    near = [F.floor(F.col(c) * 10**digits + 0.5) for c in ("start", "end")]
    return events.withColumn("_r", F.row_number().over(W.partitionBy("id", "label", *near).orderBy("start", "end"))).filter("_r = 1").drop("_r")


def violations(pred: DataFrame, ids: DataFrame) -> DataFrame:
    """Number of breaches of each rule, over predictions (id, label, start, end) and the ids that must be there."""
    count = {
        "unknown_class": F.count_if(~F.col("label").isin(*LABELS)), "normal_as_class": F.count_if(F.col("label") == "normal"),
        "end_before_start": F.count_if(F.col("end") <= F.col("start")), "negative_start": F.count_if(F.col("start") < 0),
    }
    flat = pred.agg(*(c.alias(k) for k, c in count.items())).unpivot([], list(count), "rule", "n")
    missing = ids.select("id").distinct().join(pred.select("id"), "id", "left_anti").agg(F.lit("missing_id").alias("rule"), F.count("*").alias("n"))
    near = [F.floor(F.col(c) * 1000 + 0.5) for c in ("start", "end")]
    same = pred.groupBy("id", "label", *near).count().agg(F.lit("duplicate_event").alias("rule"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n"))
    return flat.unionByName(missing).unionByName(same)


def explained(phrase: Column, where: Column, note: Column, caption: Column, again: Column, most: int = 500) -> Column:
    """Sentences joined; cut at the last full stop within ``most`` characters."""
    text = F.concat_ws(" ", phrase, where, note, caption, again)
    head = F.substring(text, 1, most)
    at = most - F.locate(" .", F.reverse(head)) - 1
    return F.when(F.length(text) <= most, text).when(F.contains(head, F.lit(". ")), F.substring(text, F.lit(1), at + 1)).otherwise(head)
