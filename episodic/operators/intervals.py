"""Islands, gaps and windows over ordered rows, as window expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .rounds import checkpointed

#: Rows of a key that are ordered in one piece.
SLICE_ROWS = 500_000


def slices(df: DataFrame, keys: list[str], at: str, rows: int = SLICE_ROWS) -> DataFrame:
    """Adds ``_slice``: keys with more than ``rows`` rows are cut along ``at`` into that many even parts.

    Equal values stay in one slice, and slices of a key are in the order of ``at``. The cut follows from the
    key's rows, least and largest value alone, so every run of the plan makes the same one.
    """
    size = df.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(F.count("*").alias("_rows"), F.min(at).alias("_least"), F.max(at).alias("_most")).filter(F.col("_rows") > rows)
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    parts = F.ceil(F.col("_rows") / rows)
    place = F.floor((F.col(at) - F.col("_least")) / F.nullif(F.col("_most") - F.col("_least"), F.lit(0)) * parts)
    return df.join(size, same, "left").withColumn("_slice", F.coalesce(F.least(place, parts - 1), F.lit(0)).cast("long")).select(*df.columns, "_slice")


def islands(df: DataFrame, keys: list[str], start: str, end: str, gap: Column | float, strict: bool = False, tie: tuple[str, ...] = (), rows: int = SLICE_ROWS) -> DataFrame:
    """Adds ``island``: rows of a key in order of start; a new island begins where a start lies more than
    ``gap`` (strict: ``gap`` or more) after every end so far.

    A key with more than ``rows`` rows is cut into slices of time that are ordered apart: each slice finds its own
    running end, and one row of each (its largest end, then its number of islands) carries on to the slices behind.
    """
    cut = slices(df, keys, start, rows)
    own, order = [*keys, "_slice"], W.partitionBy(*keys, "_slice").orderBy(start, end, *tie)
    upto = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)

    def carried(frame: DataFrame, name: str, one: Column, all_: Callable[[str], Column]) -> DataFrame:
        """Joins to each row what the slices before its own give."""
        each = frame.groupBy(*own).agg(one.alias(name)).withColumn(name, all_(name).over(upto)).filter(F.col(name).isNotNull())
        each = each.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(own)), name)
        return frame.join(each, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(own)], "left").select(*frame.columns, name)

    cut = carried(cut, "_reach", F.max(end), F.max)
    before = F.greatest(F.max(end).over(order.rowsBetween(W.unboundedPreceding, -1)), F.col("_reach"))
    apart = (F.col(start) - before >= gap) if strict else (F.col(start) - before > gap)
    cut = cut.withColumn("_new", F.coalesce(apart, F.lit(True)).cast("int"))
    cut = carried(cut, "_past", F.sum("_new"), F.sum)
    island = F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)) + F.coalesce("_past", F.lit(0))
    return cut.withColumn("island", island).select(*df.columns, "island")


def gap_merge(df: DataFrame, keys: list[str], start: str, end: str, gap: Column | float, aggs: list[Column] = (), strict: bool = False, tie: tuple[str, ...] = ()) -> DataFrame:
    """Episodes: one row for each island with start, end, n and ``aggs``."""
    return islands(df, keys, start, end, gap, strict, tie).groupBy(*keys, "island").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n"), *aggs)


def ordered_distinct(order: str, value: str) -> Column:
    """Aggregate: the distinct values of a group in the order in which they first come."""
    return F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct(order, value))), lambda x: x[value]))


def runs(df: DataFrame, keys: list[str], order: str, flag: Column) -> DataFrame:
    """Unbroken runs of rows whose flag holds: keys, first, last, length."""
    w = W.partitionBy(*keys).orderBy(order)
    marked = df.withColumns({"_flag": F.coalesce(flag, F.lit(False)), "_n": F.row_number().over(w)})
    run = F.col("_n") - F.row_number().over(W.partitionBy(*keys, "_flag").orderBy(order))
    return marked.withColumn("_run", run).filter("_flag").groupBy(*keys, "_run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length")).drop("_run")


def look_back(df: DataFrame, keys: list[str], t_us: str, span_us: int, columns: list[str]) -> DataFrame:
    """Adds ref_<c>: values of the oldest own row not older than ``span_us``."""
    w = W.partitionBy(*keys).orderBy(t_us).rangeBetween(-span_us, 0)
    return df.withColumns({f"ref_{c}": F.first(c).over(w) for c in columns})


def others_median(df: DataFrame, keys: list[str], value: str, tie: str, least: int = 3, peer: Column | None = None, rows: int = SLICE_ROWS) -> DataFrame:
    """Adds ``others_median``: median of the group's other peers (null below ``least`` of them); ``tie`` is not needed.

    The middle is found by selection: a large group is cut into slices of values, their sizes tell which slices hold
    the few middle ranks, and only the rows of those are ordered. With those values at hand a row's own value tells
    what its absence moves: of all but one, the k-th is the next one of all, if the one left out is no larger.
    """
    is_peer = F.lit(True) if peer is None else F.coalesce(peer, F.lit(False))
    marked = df.withColumn("_peer", is_peer & F.col(value).isNotNull())
    cut, group = slices(marked.filter("_peer").select(*keys, value), keys, value, rows), W.partitionBy(*keys)
    sizes = cut.groupBy(*keys, "_slice").agg(F.count("*").alias("_c"))
    sizes = sizes.withColumns({"_before": F.sum("_c").over(group.orderBy("_slice")) - F.col("_c"), "_n": F.sum("_c").over(group)})
    low = F.floor(F.col("_n") / 2)  # of all n or of n - 1, the middle ones lie at ranks low - 1 to low + 2 of the whole group
    wanted = sizes.filter((F.col("_before") < low + 2) & (F.col("_before") + F.col("_c") >= low - 1)).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, "_slice"])), "_before", "_n")
    near = cut.join(wanted, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate([*keys, "_slice"])])
    near = near.withColumn("_r", F.row_number().over(W.partitionBy(*keys, "_slice").orderBy(value)) + F.col("_before"))
    stats = near.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(F.first("_n").alias("_n"), *(F.max(F.when(F.col("_r") == low + k, F.col(value))).alias(f"_v{k}") for k in (-1, 0, 1, 2)))
    both = marked.join(stats, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], "left").withColumn("_low", low)
    others = F.coalesce(F.col("_n"), F.lit(0)) - F.col("_peer").cast("int")

    def kth(k: Column) -> Column:
        at = lambda place: F.when(place == -1, F.col("_v-1")).when(place == 0, F.col("_v0")).when(place == 1, F.col("_v1")).when(place == 2, F.col("_v2"))
        place = k - F.col("_low")
        return F.when(F.col("_peer") & (F.col(value) <= at(place)), at(place + 1)).otherwise(at(place))

    median = (kth(F.floor((others + 1) / 2)) + kth(F.floor(others / 2) + 1)) / 2
    return both.withColumn("others_median", F.when(others >= least, median)).select(*df.columns, "others_median")


def cooldown(df: DataFrame, keys: list[str], t: str, c: float, rows: int = SLICE_ROWS, most: int = 1000) -> DataFrame:
    """Rows keys, t: of each key's times, in order, those that lie ``c`` or more after the last one kept.

    A time that lies ``c`` or more behind the one before it is kept whatever came earlier, so times fall into islands that do
    not depend on each other. Small ones are folded as one sorted array. Those with more than ``rows`` times, or of a span
    that may keep more than ``most``, are walked by pointers: each time points to the first one ``c`` or more behind it
    (found in slices of time), and each round doubles both the stretch that a pointer spans and the times known to be kept,
    so the joins spread a hot key over all tasks. Null times are left out, null keys are one key. Whole numbers (such as
    microseconds) are exact; for doubles the two ways may round the sum t + c in different ways.
    """
    times = df.select(*keys, t).filter(F.col(t).isNotNull())
    if c <= 0:
        return times
    own = [*keys, "island"]
    same = lambda names: [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(names)]
    renamed = lambda names: [F.col(k).alias(f"_k{i}") for i, k in enumerate(names)]
    marked = islands(times.distinct(), keys, t, t, c, strict=True, rows=rows)
    size = marked.groupBy(*renamed(own)).agg(F.count("*").alias("_n"), F.min(t).alias("_least"), ((F.max(t) - F.min(t)) / c).alias("_steps"))
    large = checkpointed(size.filter((F.col("_n") > rows) | (F.col("_steps") >= most)))
    steps = large.agg(F.max("_steps")).first()[0]
    small = marked if steps is None else marked.join(large, same(own), "left_anti")
    fold = F.aggregate(F.sort_array(F.collect_list(t)), F.array().cast(f"array<{dict(times.dtypes)[t]}>"), lambda kept, x: F.when((F.size(kept) == 0) | (x - F.get(kept, F.size(kept) - 1) >= c), F.array_append(kept, x)).otherwise(kept))
    kept = small.groupBy(*own).agg(fold.alias("_kept")).select(*keys, F.explode("_kept").alias(t))
    if steps is None:
        return kept
    walked = marked.join(large.select(*(f"_k{i}" for i in range(len(own)))), same(own), "left_semi")
    # Times and the places that they look from lie in one order; the first time at or behind a place is the least one seen from the end.
    places = walked.select(*own, F.col(t).alias("_at"), F.col(t).alias("_time"), F.lit(None).cast(dict(times.dtypes)[t]).alias("_from"))
    places = slices(places.unionByName(walked.select(*own, (F.col(t) + c).alias("_at"), F.lit(None).cast(dict(times.dtypes)[t]).alias("_time"), F.col(t).alias("_from"))), own, "_at", rows)
    behind = places.groupBy(*own, "_slice").agg(F.min("_time").alias("_first"))
    behind = behind.withColumn("_first", F.min("_first").over(W.partitionBy(*own).orderBy(F.desc("_slice")).rowsBetween(W.unboundedPreceding, -1)))
    seen = F.min("_time").over(W.partitionBy(*own, "_slice").orderBy(F.desc("_at")).rangeBetween(W.unboundedPreceding, 0))
    found = places.withColumn("_seen", seen).filter("_from is not null").join(behind.select(*renamed([*own, "_slice"]), "_first"), same([*own, "_slice"]), "left")
    jumps = checkpointed(found.select(*own, F.col("_from").alias(t), F.coalesce("_seen", "_first").alias("_next")))
    reached = large.select(*(F.col(f"_k{i}").alias(k) for i, k in enumerate(own)), F.col("_least").alias(t))

    def jumped(frame: DataFrame, by: str) -> DataFrame:
        """Adds ``_to``, where the pointer of the time ``by`` leads."""
        to = jumps.select(*renamed(own), F.col(t).alias("_t"), F.col("_next").alias("_to"))
        return frame.join(to, [*same(own), F.col(by) == F.col("_t")], "left").select(*frame.columns, "_to")

    for _ in range(max(1, math.ceil(math.log2(steps + 2)))):
        reached = checkpointed(reached.unionByName(jumped(reached, t).filter("_to is not null").select(*own, F.col("_to").alias(t))))
        jumps = checkpointed(jumped(jumps.filter("_next is not null"), "_next").select(*own, t, F.col("_to").alias("_next")))
    return kept.unionByName(reached.select(*keys, t))


def nearest(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str, within: int) -> DataFrame:
    """Rows of ``left`` with the nearest row of ``right`` of equal keys: adds ``near_<at>`` and ``near_<value>``; of two
    equally near the earlier one counts, and rows with none at most ``within`` away are dropped.

    Both sides lie in one order and each row takes the last row of the right side before it and the first one behind,
    so no pairs are made. ``at`` is a whole number (such as microseconds).
    """
    one = lambda df, mark: df.select(*keys, at, F.struct(*df.columns).alias("_row") if mark else F.lit(None).alias("_row"), (F.lit(None) if mark else F.struct(F.col(at).alias("t"), F.col(value).alias("v"))).alias("_seen"))
    both = one(left, True).unionByName(one(right.filter(F.col(at).isNotNull()), False))
    # Both windows grow from one end, so a key takes time in proportion to its rows.
    seen = lambda order: F.last("_seen", True).over(W.partitionBy(*keys).orderBy(order).rangeBetween(W.unboundedPreceding, 0))
    low, high = seen(F.asc(at)), seen(F.desc(at))
    met = both.withColumns({"_low": low, "_high": high}).filter("_row is not null")
    before, behind = F.col(at) - F.col("_low.t"), F.col("_high.t") - F.col(at)
    best = F.when(F.coalesce(before <= behind, behind.isNull()), F.col("_low")).otherwise(F.col("_high"))
    rows = met.withColumn("_best", best).filter(F.abs(F.col("_best.t") - F.col(at)) <= within)
    return rows.select("_row.*", F.col("_best.t").alias(f"near_{at}"), F.col("_best.v").alias(f"near_{value}"))


def padded(start: Column, end: Column, pad: Column | float, least: float, most: Column | float) -> tuple[Column, Column]:
    """Pads an interval, then grows or trims it about its centre; the start is clipped at 0, the end is not."""
    s, e = start - pad, end + pad
    mid, span = (s + e) / 2, F.least(F.greatest(e - s, F.lit(least)), most if isinstance(most, Column) else F.lit(most))
    return F.greatest(F.lit(0.0), mid - span / 2), mid + span / 2


def clamped(start: Column, end: Column, duration: Column) -> tuple[Column, Column]:
    """Inside [0, duration - 0.05]; an interval left empty gets up to 4 s."""
    last = duration - 0.05
    s, e = F.greatest(F.lit(0.0), start), F.least(end, last)
    return s, F.when(e <= s, F.least(last, s + 4)).otherwise(e)


def complement(df: DataFrame, keys: list[str], start: str, end: str, duration: Column, margin: float, least: float) -> DataFrame:
    """Uncovered parts of [0, duration] longer than ``least``; covered intervals grow by ``margin`` first."""
    grown = df.select(*keys, (F.col(start) - margin).alias("s"), (F.col(end) + margin).alias("e"), duration.alias("duration"))
    order = W.partitionBy(*keys).orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(W.unboundedPreceding, -1))
    inner = grown.select(*keys, F.greatest(F.lit(0.0), F.coalesce(reach, F.lit(0.0))).alias("gap_start"), F.least("s", "duration").alias("gap_end"))
    tail = grown.groupBy(*keys).agg(F.greatest(F.lit(0.0), F.max("e")).alias("gap_start"), F.max("duration").alias("gap_end"))
    return inner.unionByName(tail).filter(F.col("gap_end") - F.col("gap_start") > least)


def spread_points(gaps: DataFrame, keys: list[str], n: int) -> DataFrame:
    """n points at (k + 0.5) / n of the gaps' total length, placed in the gaps they fall into."""
    w = W.partitionBy(*keys)
    long = F.col("gap_end") - F.col("gap_start")
    g = gaps.withColumns({"_upto": F.sum(long).over(w.orderBy("gap_start")), "_all": F.sum(long).over(w)})
    at = (F.col("point") + 0.5) / n * F.col("_all")
    points = g.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("point"))
    mine = points.filter((at < F.col("_upto")) & (at >= F.col("_upto") - long))
    return mine.select(*keys, "point", (F.col("gap_start") + at - (F.col("_upto") - long)).alias("t"))


def grid(n: Column, low: Column, high: Column) -> Column:
    """n whole numbers from low to high, evenly spaced and cut off."""
    step = lambda k: (low + (high - low) * k / F.greatest(n - 1, F.lit(1))).cast("long")
    return F.transform(F.sequence(F.lit(0), n - 1), step)
