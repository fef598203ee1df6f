"""Camera motion and frame picks: running affine products, a moving-camera flag, motion-aware samples, shards, pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .rounds import checkpointed


def _times(m: Column, c: Column) -> Column:
    """Product of two 2x3 affine matrices stored by row: first c, then m."""
    at = lambda r, k: F.get(m, 3 * r) * F.get(c, k) + F.get(m, 3 * r + 1) * F.get(c, 3 + k) + (F.get(m, 3 * r + 2) if k == 2 else F.lit(0.0))
    return F.array(*(at(r, k) for r in range(2) for k in range(3)))


IDENTITY = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)


def cumulative_affine(frames: DataFrame, key: str, order: str, matrix: str, block: int = 256) -> DataFrame:
    """For each frame the product of all its key's matrices so far; null matrices (failed frames) are passed over.

    The product is associative, so it is a scan: blocks of ``block`` frame numbers are multiplied apart, blocks of
    blocks in the same way, and what lies before a block is multiplied into its frames. No array is longer than
    ``block`` frames (the last one: frames / block^2), and a long video spreads over the tasks.
    """
    one = F.array(*map(F.lit, IDENTITY))
    rows = frames.select(key, F.col(order).cast("long").alias("_at"), F.coalesce(F.col(matrix).cast("array<double>"), one).alias("_m"))
    return _scan(rows, key, block, 2).select(key, F.col("_at").alias(order), F.col("_m").alias("total"))


def _scan(rows: DataFrame, key: str, block: int, levels: int) -> DataFrame:
    """Running products of rows key, _at, _m."""
    blocks = rows.withColumn("_b", F.floor(F.col("_at") / block) if levels else F.lit(0).cast("long"))
    lists = blocks.groupBy(key, "_b").agg(F.sort_array(F.collect_list(F.struct("_at", "_m"))).alias("_l"))
    step = lambda s, x: F.array_append(s, F.struct(x["_at"].alias("_at"), _times(x["_m"], F.coalesce(F.element_at(s, F.lit(-1))["_m"], F.array(*map(F.lit, IDENTITY)))).alias("_m")))
    none = F.array().cast("array<struct<_at:bigint,_m:array<double>>>")
    first = lambda l: F.array(F.struct(F.get(l, 0)["_at"].alias("_at"), F.get(l, 0)["_m"].alias("_m")))
    done = lists.withColumn("_l", F.when(F.size("_l") > 0, F.aggregate(F.slice("_l", 2, F.size("_l")), first(F.col("_l")), step)).otherwise(none))
    if not levels:
        return done.select(key, F.explode("_l").alias("x")).select(key, "x._at", "x._m")
    total = done.select(key, (F.col("_b") + 1).alias("_at"), F.element_at("_l", -1)["_m"].alias("_m"))
    # The product up to a block stands at the number of the next block that the key has.
    before = _scan(total, key, block, levels - 1)
    order = W.partitionBy(key).orderBy("_b")
    marked = done.unionByName(before.select(key, F.col("_at").alias("_b"), F.col("_m").alias("_p")), allowMissingColumns=True)
    carried = marked.withColumn("_c", F.last("_p", True).over(order.rangeBetween(W.unboundedPreceding, 0))).filter("_l is not null")
    return carried.select(key, F.explode("_l").alias("x"), "_c").select(key, "x._at", F.when(F.col("_c").isNull(), F.col("x._m")).otherwise(_times(F.col("x._m"), F.col("_c"))).alias("_m"))


def stabilised(points: DataFrame, totals: DataFrame, key: str, order: str, x: str, y: str) -> DataFrame:
    """Adds rx, ry: points of each frame mapped back to the key's first frame by the inverse of its running product."""
    a, b, tx, c, d, ty = (F.get("total", k) for k in range(6))
    dx, dy, det = F.col(x) - tx, F.col(y) - ty, a * d - b * c
    both = points.join(totals, [key, order], "left")
    still = F.col("total").isNull() | (det == 0)
    return both.withColumns({"rx": F.when(still, F.col(x)).otherwise(F.try_divide(d * dx - b * dy, det)), "ry": F.when(still, F.col(y)).otherwise(F.try_divide(a * dy - c * dx, det))}).drop("total")


def camera_moves(frames: DataFrame, key: str, order: str, shift: str, rows: int = 30, least: float = 1.0) -> DataFrame:
    """Adds ``camera_moving``: the median of the last shifts, in pixels, reaches ``least``."""
    w = W.partitionBy(key).orderBy(order).rowsBetween(1 - rows, 0)
    return frames.withColumn("camera_moving", F.coalesce(F.percentile(shift, F.lit(0.5)).over(w) >= least, F.lit(False)))


def picked_frames(frames: DataFrame, key: str, order: str, motion: str, n: int) -> DataFrame:
    """At most n frames of each key: both ends, evenly spaced ones for about half, those with most motion, evenly spaced ones for what is left."""
    w = W.partitionBy(key)
    ranked = frames.withColumns({"_k": F.row_number().over(w.orderBy(order)) - 1, "_m": F.count("*").over(w)})
    spots = lambda many: F.exists(F.transform(F.sequence(F.lit(0), F.lit(many - 1)), lambda i: F.floor(i * (F.col("_m") - 1) / max(many - 1, 1))), lambda x: x == F.col("_k"))
    half, top = max(2, n // 2), max(1, n // 4)
    ranked = ranked.withColumn("_even", spots(half)).withColumn("_top", F.row_number().over(w.orderBy(F.col("_even"), F.desc(motion), order)) <= top)
    turn = F.when(F.col("_even"), 0).when(F.col("_top"), 1).when(spots(n), 2).otherwise(3)
    ranked = ranked.withColumn("_p", F.row_number().over(w.orderBy(turn, F.desc(motion), order)))
    return ranked.filter(F.col("_p") <= n).drop("_k", "_m", "_p", "_even", "_top")


def shard(rows: DataFrame, order: str, n: int, index: int) -> DataFrame:
    """Every n-th row in the given order, from ``index``; the shards are disjoint and hold all rows.

    Places come from the sizes of sorted ranges, so no task sees the whole list. The bounds of ranges are sampled, anew for
    each plan: so the rows are written once with their range, and sizes and places are of the same ranges. Rows equal in
    ``order`` stand in the order of their other columns (maps aside).
    """
    rest = [f.name for f in rows.schema if f.name != order and "map<" not in f.dataType.simpleString()]
    part = checkpointed(rows.repartitionByRange(F.col(order)).withColumn("_part", F.spark_partition_id()))
    part = part.withColumn("_own", F.row_number().over(W.partitionBy("_part").orderBy(order, *rest)) - 1)
    sizes = part.groupBy("_part").agg(F.count("*").alias("_size"))
    before = sizes.select("_part", (F.sum("_size").over(W.orderBy("_part")) - F.col("_size")).alias("_before"))  # one row for each range
    return part.join(F.broadcast(before), "_part").filter(F.pmod(F.col("_before") + F.col("_own"), F.lit(n)) == index).drop("_part", "_own", "_before")


def stale(cached: DataFrame, allowed: DataFrame, keys: list[str]) -> DataFrame:
    """Cached rows whose provenance is no longer allowed."""
    return cached.join(allowed.select(*keys).distinct(), keys, "left_anti")
