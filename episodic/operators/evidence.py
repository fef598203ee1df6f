"""Evidence for explanations: tracker events inside a window, vetted captions, recurrence, statistics of the texts."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.expr import ZONE_PHRASE, contains_any, lookup

#: Rules that speak for a class, words that belong to a class, marks of machine texts, of normality, and stock captions.
CLASS_RULES = {
    "traffic_accident": ("collision_signature", "stopped_vehicle"), "stalled_or_broken_down_vehicle": ("stopped_vehicle",), "vehicle_blocking_traffic": ("stopped_vehicle", "collision_signature"),
    "traffic_congestion": ("traffic_congestion", "stopped_vehicle"), "wrong_way_driving": ("wrong_way_vehicle",), "loitering_or_suspicious_presence": ("person_in_roadway", "loiter", "crowd_density"),
    "fighting_or_violence": ("crowd_density", "person_in_roadway"),
}
CLASS_WORDS = {
    "traffic_accident": ("collide", "collision", "crash", "rear-end", "head-on", "overturn"), "fire": ("fire", "flame", "burning", "blaze"), "smoke": ("smoke", "plume"),
    "waterlogging_or_flood": ("flood", "waterlog", "standing water", "submerged", "inundat"), "road_spill_or_debris": ("debris", "spill", "scattered", "obstruction on the road"),
    "fighting_or_violence": ("fight", "assault", "violent", "brawl", "punch"), "wrong_way_driving": ("wrong way", "wrong-way", "against the flow", "oncoming"),
    "traffic_congestion": ("congest", "queue", "jam", "slow-moving", "bumper"), "loitering_or_suspicious_presence": ("loiter", "lingering", "prolonged period"),
}
MACHINE = ("classifier", "confidence", "identified by", "appearance", "stage 2", "rule)", "separate windows of this class", "flagged by", "tracked a")
NORMALITY = ("standard flow", "typical", "normal", "no incident", "adhere", "orderly", "uneventful", "steady speeds", "without incident", "lane discipline", "routine")
STOCK = (
    "a traffic collision occurs.", "a traffic collision is visible.", "traffic is densely queued and moving slowly.", "a vehicle is stationary in a live lane.", "a stationary vehicle is blocking the lane.",
    "a vehicle is moving against the flow of traffic.", "debris or a spill is visible on the roadway.", "flooding or standing water is visible.", "active fire is visible.", "a smoke plume is visible.",
    "a physical fight is visible.", "a person is lingering without an obvious purpose.", "routine activity, no incident visible in this frame.",
)


def strongest_event(windows: DataFrame, events: DataFrame, video: str, label: str, rules: dict[str, tuple[str, ...]] = CLASS_RULES, cell: float = 60.0) -> DataFrame:
    """windows (video, id, label, start, end) with the most severe event (first on ties) that speaks for the class inside them.

    Windows without times take all events of the video. events: video, event_id, t, kind, severity. Timed windows and
    events meet in time cells, so no window is held against a whole video.
    """
    speaks = F.create_map(*(x for k, v in rules.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    wanted = windows.withColumn("_kinds", speaks[F.col(label)]).filter("_kinds is not null")
    spread = wanted.withColumn("_cell", F.when(F.col("start").isNull() | F.col("end").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(F.when(F.col("start") <= F.col("end"), F.sequence(F.floor(F.col("start") / cell), F.floor(F.col("end") / cell)))))
    spread = spread.withColumn("_cell", F.explode("_cell")).select(video, "id", "start", "end", "_kinds", "_cell")
    placed = events.filter("t >= 0").withColumn("_cell", F.explode(F.array(F.floor(F.col("t") / cell), F.lit(-1).cast("long"))))
    inside = F.col("start").isNull() | F.col("end").isNull() | F.col("t").between(F.col("start"), F.col("end"))
    met = spread.join(placed, [video, "_cell"]).filter(F.array_contains("_kinds", F.col("kind")) & inside)
    best = met.groupBy(video, "id").agg(F.max(F.struct(F.coalesce("severity", F.lit(0.0)).alias("severity"), (-F.col("t")).alias("_t"), (-F.col("event_id")).alias("event_id"))).alias("_b"), F.count("*").alias("events"))
    best = best.select(video, "id", "events", (-F.col("_b.event_id")).alias("event_id"), F.col("_b.severity").alias("severity"))
    return windows.join(best, [video, "id"], "left").withColumn("events", F.coalesce("events", F.lit(0)))


def recurrence(windows: DataFrame, video: str, label: str) -> DataFrame:
    """Adds ``recurs``: the number of windows of the same video and class."""
    return windows.withColumn("recurs", F.count("*").over(W.partitionBy(video, label)))


def conflicts(label: Column, caption: Column, words: dict[str, tuple[str, ...]] = CLASS_WORDS) -> Column:
    """Whether a caption has words of another class and none of its own."""
    text = F.lower(caption)
    own = reduce(or_, ((label == k) & contains_any(text, v) for k, v in words.items()), F.lit(False))
    other = reduce(or_, ((label != k) & contains_any(text, v) for k, v in words.items()), F.lit(False))
    return other & ~own


def vetted(label: Column, caption: Column, own: tuple[str, ...] = (), least: int = 60) -> Column:
    """The caption where it is a real observation of its class, else null: long enough, no stock text, no machine or
    normality marks, none of our own phrases, no other class."""
    text = F.trim(F.coalesce(caption, F.lit("")))
    low = F.lower(text)
    good = ~low.isin(*STOCK) & (F.length(text) >= least) & ~contains_any(low, (*MACHINE, *NORMALITY, *(p.lower() for p in own))) & ~conflicts(label, text)
    return F.when(good, text)


def tracker_note(name: Column, zone: Column, age: Column, speed: Column, stopped: Column, total: Column) -> Column:
    """What was measured, as a sentence: place, stay of 5 s or more, no motion, others moving on."""
    thing = F.trim(F.replace(F.coalesce(name, F.lit("")), F.lit("_"), F.lit(" ")))
    subject = F.when(thing.isin("", "object"), "The tracked object").otherwise(F.concat(F.lit("The "), thing))
    place = lookup(zone, {k: v for k, v in ZONE_PHRASE.items() if k != "unknown"})
    return F.concat_ws(" ", F.when(place.isNotNull(), F.concat(subject, F.lit(" is in "), place)).otherwise(F.concat(subject, F.lit(" stays in view"))),
                       F.when(age >= 5, F.format_string("and remains there for %.0f seconds", age.cast("double"))), F.when(speed < 0.05, "without moving"),
                       F.when((total > 0) & (stopped == 0), F.format_string("while the other %d vehicles keep moving", total.cast("int"))))


def text_statistics(df: DataFrame, text: str) -> DataFrame:
    """Texts, distinct texts, least, middle (the upper one of two) and largest length, texts outside 20 to 500 characters.

    The middle comes from a count of lengths, so only lengths are ordered.
    """
    n = F.length(F.coalesce(F.col(text), F.lit("")))
    by_length = df.groupBy(n.alias("n")).agg(F.count("*").alias("rows"))
    upto = by_length.withColumns({"_upto": F.sum("rows").over(W.orderBy("n")), "_all": F.sum("rows").over(W.partitionBy())})  # one row for each length
    sizes = upto.agg(F.min("n").alias("shortest"), F.min(F.when(F.col("_upto") > F.floor(F.col("_all") / 2), F.col("n"))).alias("middle"), F.max("n").alias("longest"), F.coalesce(F.sum("rows"), F.lit(0)).alias("texts"),
                     F.coalesce(F.sum(F.when(~F.col("n").between(20, 500), F.col("rows"))), F.lit(0)).alias("outside"))
    return sizes.crossJoin(df.agg(F.count_distinct(F.coalesce(F.col(text), F.lit(""))).alias("distinct")))  # one row by one row
