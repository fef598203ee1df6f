"""Parameter search: grids over decision rules, threshold calibration, coordinate ascent, held-out folds."""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.expr import floored, ratio
from .decide import background, ranked, top_of_ranked
from .rounds import checkpointed


def rule_grid() -> list[tuple[float, int, float, float]]:
    """252 settings (threshold, k, margin, scale)."""
    thresholds, scales = [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6], [0.5, 0.8, 1.0, 1.5]
    ks = [(1, 0.0), *product((2, 3), (0.05, 0.15, 0.3))]
    return [(t, k, m, z) for t, (k, m), z in product(thresholds, ks, scales)]


def sweep(clips: DataFrame, grid: list[tuple[float, int, float, float]], classes: int, normal: int = 0) -> DataFrame:
    """Macro-F1 of every setting; the settings ride along as a literal array, so nothing is joined."""
    cfg = F.array(*(F.struct(F.lit(i).alias("cfg"), F.lit(t).alias("thr"), F.lit(k).alias("k"), F.lit(m).alias("margin"), F.lit(z).alias("scale")) for i, (t, k, m, z) in enumerate(grid)))
    rows = clips.select("truth", ranked(F.col("probs")).alias("order"), background(F.col("probs"), normal).alias("low")).select("*", F.explode(cfg).alias("g"))
    rows = rows.select("truth", "g.*", top_of_ranked(F.col("order"), F.col("low"), F.col("g.thr"), F.col("g.k"), F.col("g.margin"), F.col("g.scale"), normal).alias("chosen"))
    some = [c for c in range(classes) if c != normal]
    aggs = []
    for c in some:
        has, is_ = F.array_contains("chosen", c), F.col("truth") == c
        aggs += [F.count_if(has & is_).alias(f"tp{c}"), F.count_if(has).alias(f"sel{c}"), F.count_if(is_).alias(f"sup{c}")]
    n = rows.groupBy("cfg", "thr", "k", "margin", "scale").agg(*aggs)
    f1 = F.array(*(F.when(F.col(f"sup{c}") > 0, ratio(2 * F.col(f"tp{c}"), F.col(f"sel{c}") + F.col(f"sup{c}"))) for c in some))
    seen = F.array_compact(f1)
    return n.select("cfg", "thr", "k", "margin", "scale", floored(F.aggregate(seen, F.lit(0.0), lambda a, x: a + x) / F.size(seen), 6).alias("macro_f1"))


def calibrate(clips: DataFrame, grid: list[float]) -> DataFrame:
    """For each class the threshold of the best one-against-rest F1, the highest one on ties."""
    p = clips.select("truth", F.explode("probs").alias("x")).select("truth", F.col("x.c").alias("c"), "x.p")
    rows = p.select("c", (F.col("truth") == F.col("c")).alias("is_"), "p", F.explode(F.array(*map(F.lit, grid))).alias("thr"))
    hit = F.col("p") >= F.col("thr")
    n = rows.groupBy("c", "thr").agg(F.count_if(hit & F.col("is_")).alias("tp"), F.count_if(hit & ~F.col("is_")).alias("fp"), F.count_if(~hit & F.col("is_")).alias("fn"))
    n = n.withColumn("f1", ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))
    best = n.withColumn("r", F.row_number().over(W.partitionBy("c").orderBy(F.desc("f1"), F.desc("thr")))).filter("r = 1")
    return best.select("c", floored(F.col("thr"), 2).alias("thr"), floored(F.col("f1"), 6).alias("f1"), "tp", "fp", "fn")


def ascend(start: dict[str, float], values: list[float], objective: Callable[[list[dict[str, float]]], list[float]], passes: int = 3) -> tuple[dict[str, float], float]:
    """Coordinate ascent: for each class all values in one batch; a change must gain more than 1e-9."""
    best, (value,) = dict(start), objective([start])
    for _ in range(passes):
        before = value
        for name in best:
            tried = [best | {name: v} for v in values]
            scores = objective(tried)
            k = max(range(len(tried)), key=lambda i: scores[i])
            if scores[k] > value + 1e-9:
                best, value = tried[k], scores[k]
        if value <= before + 1e-9:
            break
    return best, value


def held_out(rows: DataFrame, key: str, setting: str, good: str) -> DataFrame:
    """Leave-one-group-out: for each key the setting that does best on all other keys, and how it does on the key.

    rows: key, setting, good (summed). Totals minus own parts give the others, without a join of folds.
    """
    own = rows.groupBy(key, setting).agg(F.sum(good).alias("own"))
    others = F.sum("own").over(W.partitionBy(setting)) - F.col("own")
    ranked = own.withColumn("others", others).withColumn("r", F.row_number().over(W.partitionBy(key).orderBy(F.desc("others"), setting)))
    return ranked.filter("r = 1").select(key, setting, "own", "others")


def _stepped(probs: Column, values: list[float], k: int, margin: float, normal: int) -> Column:
    """What of a video decides its picks under thresholds out of ``values``: its classes from likely to unlikely with the
    largest value they reach, whether they reach the normal class (ok), and the end of those within the margin.

    Classes that reach no value, or stand behind all that can be reported, are left out: so most videos share few of these.
    """
    low = background(probs, normal)
    # The largest value up to p; null where there is none.
    able = F.transform(ranked(probs), lambda x: F.struct(x["p"].alias("p"), x["c"].alias("c"), F.array_max(F.filter(F.array(*map(F.lit, values)), lambda v: x["p"] >= v)).alias("step")))
    able = F.filter(able, lambda x: (x["c"] != normal) & x["step"].isNotNull())

    def entry(x: Column, i: Column, every: Column) -> Column:
        end = i + F.size(F.filter(every, lambda y, j: (j >= i) & (x["p"] - y["p"] <= margin)))
        return F.struct(x["step"].alias("step"), x["c"].alias("c"), F.coalesce(x["p"] >= low, F.lit(False)).alias("ok"), i.alias("at"), (F.least(end, i + 1) if k == 1 else end).alias("end"))

    last = lambda l: F.coalesce(F.array_max(F.transform(F.filter(l, lambda x: x["ok"]), lambda x: F.greatest(x["at"] + 1, x["end"]))), F.lit(0))
    return _let(_let(able, lambda l: F.transform(l, lambda x, i: entry(x, i, l))), lambda l: F.slice(l, F.lit(1), last(l)))


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x worked out once; a column used in several places, or in a lambda, is worked out in each."""
    return F.get(F.transform(F.array(x), f), 0)


def _picked(order: Column, thresholds: Column, k: int, normal: int) -> Column:
    """Classes to report of ``_stepped`` ones under one threshold for each class, normal where there is none."""

    def report(able: Column) -> Column:
        first = F.get(able, 0)
        near = F.slice(F.filter(able, lambda x: x["at"] < first["end"]), 1, k)
        return F.coalesce(F.when(first["ok"], F.transform(near, lambda x: x["c"])), F.array(F.lit(normal)))

    return _let(F.filter(order, lambda x: x["step"] >= F.get(thresholds, x["c"])), report)


def _counts(picked: Column, truth: Column, classes: int) -> tuple[Column, Column]:
    """Right and reported classes of one video, as arrays of 0 and 1."""
    every = F.sequence(F.lit(0), F.lit(classes - 1))
    return F.transform(every, lambda c: (F.array_contains(picked, c) & F.array_contains(truth, c)).cast("long")), F.transform(every, lambda c: F.array_contains(picked, c).cast("long"))


def _macro(right: Column, reported: Column, support: Column) -> Column:
    """Mean of the rounded F1 over classes with support, rounded again."""
    f1 = F.array_compact(F.transform(support, lambda s, i: F.when(s > 0, floored(2 * F.get(right, i) / (F.get(reported, i) + s), 3))))
    mean = lambda f: F.when(F.size(f) > 0, floored(F.aggregate(f, F.lit(0.0), lambda a, x: a + x) / F.size(f), 3))
    return F.coalesce(_let(f1, mean), F.lit(0.0))


def retuned(videos: DataFrame, key: str, classes: int, grid: list[float], start: float, passes: int = 2, k: int = 1, margin: float = 0.0, normal: int = 0) -> DataFrame:
    """Leave-one-video-out tuning of one threshold for each class: rows key, truth, thresholds, picked (for the video, under
    thresholds tuned without it).

    videos: key, truth (array of classes, null: none), probs. Every fold climbs by coordinates, from ``start`` for all classes: a
    value of the grid is taken where it gains more than 1e-9 of macro-F1 over the other videos. Videos with one truth
    that pick alike under all thresholds of the grid (``_stepped``) are one row with its number: they count alike and
    their folds climb alike. Folds that stand at the same thresholds share one count over all rows, from which each
    takes its own video's part away; so a step is one aggregate over different videos, and the driver holds different
    thresholds and counts, no videos.
    """
    floats = lambda values: F.array(*(F.lit(float(v)) for v in values))
    values = sorted({float(v) for v in (start, *grid)})
    known = F.array_sort(F.array_distinct(F.coalesce("truth", F.array().cast("array<int>"))))
    alike = checkpointed(videos.select(key, F.col("truth").alias("_truth"), known.alias("truth"), _stepped(F.col("probs"), values, k, margin, normal).alias("order")))
    rows = checkpointed(alike.groupBy("truth", "order").agg(F.count("*").alias("n")))
    every = F.sequence(F.lit(0), F.lit(classes - 1))
    own_support = F.transform(every, lambda c: F.array_contains("truth", c).cast("long"))
    support = rows.agg(*(F.sum(F.col("n") * F.get(own_support, c)).alias(f"s{c}") for c in range(classes))).first()
    support = F.array(*(F.lit(int(s or 0)).cast("long") for s in support))
    minus = lambda a, b: F.zip_with(a, b, lambda x, y: x - y)

    def step(folds: DataFrame, c: int | None) -> DataFrame:
        """All folds try the grid for class c (None: only what they have)."""
        settings = [list(r.thr) for r in folds.select("thr").distinct().collect()]
        tries = lambda thr: [thr] if c is None else [[*thr[:c], g, *thr[c + 1:]] for g in grid]
        cfg = F.array(*(F.struct(F.lit(i).alias("sid"), F.lit(j).alias("at"), floats(t).alias("thr")) for i, thr in enumerate(settings) for j, t in enumerate(tries(thr))))
        each = rows.select("truth", "order", "n", F.explode(cfg).alias("g")).select("truth", "n", "g.sid", "g.at", "g.thr", _picked(F.col("order"), F.col("g.thr"), k, normal).alias("picked"))
        right, reported = _counts(F.col("picked"), F.col("truth"), classes)
        each = each.select("sid", "at", "thr", "n", right.alias("right"), reported.alias("reported"))
        sums = [F.sum(F.col("n") * F.get(n, i)).alias(f"{n}{i}") for n in ("right", "reported") for i in range(classes)]
        total = each.groupBy("sid", "at", "thr").agg(*sums)
        total = total.select("sid", F.struct("at", "thr", *(F.array(*(f"{n}{i}" for i in range(classes))).alias(n) for n in ("right", "reported"))).alias("t"))
        total = total.groupBy("sid").agg(F.sort_array(F.collect_list("t")).alias("tried"))
        here = folds.withColumn("sid", (F.array_position(F.array(*map(floats, settings)), F.col("thr")) - 1).cast("int")).join(F.broadcast(total), "sid")  # a row for each setting

        def score(t: Column) -> Column:
            part = lambda own: F.struct(*(minus(t[n], x).alias(n) for n, x in zip(("right", "reported"), _counts(own, F.col("truth"), classes), strict=True)), minus(support, own_support).alias("support"))
            return _let(_let(_picked(F.col("order"), t["thr"], k, normal), part), lambda n: _macro(n["right"], n["reported"], n["support"]))

        scored = here.withColumn("tried", F.transform("tried", lambda t: F.struct(score(t).alias("m"), t["thr"].alias("thr"))))
        better = F.aggregate("tried", F.struct(F.col("best").alias("m"), F.col("thr").alias("thr")), lambda s, t: F.when(t["m"] > s["m"] + 1e-9, t).otherwise(s))
        return checkpointed(scored.select("truth", "order", better.alias("b")).select("truth", "order", F.col("b.thr").alias("thr"), F.col("b.m").alias("best")))

    folds = step(rows.select("truth", "order", floats([start] * classes).alias("thr"), F.lit(-1.0).alias("best")), None)
    for _ in range(passes):
        before = folds.agg(F.sum("best")).first()[0]
        for c in range(classes):
            if c != normal:
                folds = step(folds, c)
        if folds.agg(F.sum("best")).first()[0] == before:
            break
    folds = folds.select("truth", "order", F.col("thr").alias("thresholds"), _picked(F.col("order"), F.col("thr"), k, normal).alias("picked"))
    return alike.join(folds, ["truth", "order"]).select(key, F.col("_truth").alias("truth"), "thresholds", "picked")


def pooled_score(rows: DataFrame, classes: int) -> DataFrame:
    """All held-out predictions (truth, picked) scored together: class, support, right, reported, f1 and macro_f1."""
    right, reported = _counts(F.col("picked"), F.col("truth"), classes)
    held = F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: F.array_contains("truth", c).cast("long"))
    each = rows.select(F.posexplode(F.arrays_zip(right.alias("right"), reported.alias("reported"), held.alias("support"))).alias("class", "n"))
    n = each.groupBy("class").agg(*(F.sum(f"n.{c}").alias(c) for c in ("support", "right", "reported")))
    n = n.withColumn("f1", floored(F.coalesce(F.try_divide(2 * F.col("right"), F.col("reported") + F.col("support")), F.lit(0.0)), 3))
    macro = n.agg(floored(F.avg(F.when(F.col("support") > 0, F.col("f1"))), 3).alias("macro_f1"))
    return n.crossJoin(F.broadcast(macro))  # one row on the right
