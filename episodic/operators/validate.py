"""Submission documents: rows to events, runtimes, all rules of the validator, roll-ups, writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.expr import LABELS, floored

LIMIT_BYTES = 5_000_000


def events_from_rows(ids: DataFrame, rows: DataFrame, least_conf: float = 0.0) -> DataFrame:
    """Rows (id, level, label, start, end, conf, row) that make events of the ids (id, level, duration).

    Level 1: the most confident row (the first on ties), without times, if it reaches ``least_conf``. Above: rows with
    times, starts from 0, ends inside the duration, ends after starts, and of equal (label, times to 3 digits) the first.
    """
    known = rows.filter(F.col("label").isin(*LABELS) & (F.col("label") != "normal")).drop("level").join(ids, "id")
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.desc("conf"), "row"))
    one = known.filter("level = 1").withColumn("_r", rank).filter((F.col("_r") == 1) & (F.col("conf") >= least_conf))
    one = one.select("id", "level", "label", F.lit(None).cast("double").alias("start"), F.lit(None).cast("double").alias("end"), "conf", "row")
    s = F.greatest(F.lit(0.0), F.col("start"))
    e = F.when((F.col("duration") > 0) & (F.col("end") > F.col("duration")), F.col("duration") - 0.05).otherwise(F.col("end"))
    more = known.filter("level >= 2 and start is not null and end is not null").withColumns({"start": s, "end": e}).filter("end > start")
    more = more.withColumns({c: floored(F.col(c), 3) for c in ("start", "end")})
    first = F.row_number().over(W.partitionBy("id", "label", "start", "end").orderBy(F.desc("conf"), "row"))
    more = more.withColumn("_r", first).filter("_r = 1").select("id", "level", "label", "start", "end", "conf", "row")
    return one.unionByName(more)


def breaches(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Every breach of the document's rules: id, rule.

    docs: id, events array<struct<label, start, end, explanation>> (null: missing), runtimes array<struct<total_ms,
    calls, average_ms, call_times array>> (null: no runtime). ids: id, level.
    """
    wide = docs.join(ids.withColumn("_known", F.lit(True)), "id", "left").withColumn("level", F.coalesce("level", F.lit(1)))
    when = lambda c, rule: F.when(F.coalesce(c, F.lit(False)), F.lit(rule))
    whole = wide.select("id", F.explode(F.array_compact(F.array(
        when(F.col("_known").isNull(), "not in the manifest"), when(F.col("events").isNull(), "events missing"), when(F.col("runtimes").isNull(), "runtime missing")))).alias("rule"))
    ev = wide.select("id", "level", F.explode("events").alias("e"))
    label, s, e, said = (F.col(f"e.{c}") for c in ("label", "start", "end", "explanation"))
    none = s.isNull() | e.isNull()
    events = ev.select("id", F.explode(F.array_compact(F.array(
        when(label == "normal", "normal as a class"), when((label != "normal") & ~label.isin(*LABELS) | label.isNull(), "unknown class"),
        when((F.col("level") == 1) & (s.isNotNull() | e.isNotNull()), "times at level 1"), when((F.col("level") >= 2) & none, "times missing"),
        when((F.col("level") >= 2) & ~none & ((s < 0) | (e <= s)), "times out of order"), when(~F.length(said).between(20, 500), "explanation length")))).alias("rule"))
    rt = wide.select("id", F.explode("runtimes").alias("r"))
    mean = F.try_divide(F.col("r.total_ms"), F.col("r.calls"))
    runs = rt.select("id", F.explode(F.array_compact(F.array(
        when((F.col("r.total_ms") > 0) & (F.col("r.average_ms") > 0) & (F.abs(mean - F.col("r.average_ms")) > 0.02 * F.greatest(mean, F.lit(1e-9))), "average is not total by calls"),
        when(F.col("r.call_times").isNotNull() & (F.size("r.call_times") != F.col("r.calls")), "call times do not match calls")))).alias("rule"))
    again = docs.groupBy("id").count().filter("count > 1").select("id", F.lit("appears more than once").alias("rule"))
    absent = ids.select("id").distinct().join(docs.select("id"), "id", "left_anti").select("id", F.lit("absent").alias("rule"))
    return whole.unionByName(events).unionByName(runs).unionByName(again).unionByName(absent)


def filled_runtimes(runtimes: Column) -> Column:
    """Runtimes with p50, p95 and max: the total of a single call, else the average."""
    def one(r: Column) -> Column:
        calls, total = F.coalesce(F.nullif(r["calls"], F.lit(0)), F.lit(1)), F.coalesce(r["total_ms"], F.lit(0.0))
        v = floored(F.when(calls <= 1, total).otherwise(F.coalesce(F.nullif(r["average_ms"], F.lit(0.0)), total / calls)), 1)
        return F.struct(r["calls"].alias("calls"), total.alias("total_ms"), r["average_ms"].alias("average_ms"), *(v.alias(f"{k}_ms") for k in ("p50", "p95", "max")))
    return F.transform(runtimes, one)


def rollup(docs: DataFrame) -> DataFrame:
    """By level (0: all): videos, events, videos without events, wall time. docs: id, level, events, wall_ms."""
    n = F.size("events")
    return docs.rollup("level").agg(F.count("*").alias("videos"), F.sum(n.cast("long")).alias("events"), F.count_if(n == 0).alias("normal"), F.round(F.sum("wall_ms"), 1).alias("wall_ms")).withColumn("level", F.coalesce("level", F.lit(0)))


def write_document(predictions: DataFrame, path: str, head: dict[str, object], errors: DataFrame | None = None, limit: int = LIMIT_BYTES) -> int:
    """Writes one JSON document of the predictions; returns its size.

    The file is written even if it is too large or has errors, so that it can be looked at; those are raised after.
    Rows stream to the file one partition at a time, so the driver never holds the document.
    """
    import json

    size, first = 0, True
    with open(path, "w", encoding="utf-8") as f:
        def put(text: str) -> None:
            nonlocal size
            f.write(text)
            size += len(text.encode())

        put(json.dumps(head, indent=2, ensure_ascii=False)[:-1].rstrip() + (",\n" if head else "\n") + '  "predictions": [')
        for r in predictions.select(F.to_json(F.struct("*")).alias("v")).toLocalIterator():
            put(("\n" if first else ",\n") + "    " + json.dumps(json.loads(r.v), indent=2, ensure_ascii=False).replace("\n", "\n    "))
            first = False
        put("\n  ]\n}" if not first else "]\n}")
    said = [f"{size} bytes: a submission may have {limit}"] if size > limit else []
    if errors is not None:
        said += [f"{r.id}: {r.rule}" for r in errors.limit(20).collect()]
    if said:
        raise ValueError("; ".join(said))
    return size
