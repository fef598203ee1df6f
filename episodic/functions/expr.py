"""Column expressions: intervals, boxes, angles, text, verdicts. No UDFs; all stay in the JVM."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The label set, kinds and hazard words with their labels in order, feature keys of onsets, lengths, zone phrases.
LABELS = ("normal", "traffic_accident", "traffic_congestion", "stalled_or_broken_down_vehicle", "vehicle_blocking_traffic", "wrong_way_driving",
          "road_spill_or_debris", "waterlogging_or_flood", "fire", "smoke", "fighting_or_violence", "loitering_or_suspicious_presence")
KIND_LABEL = {"collision_signature": "traffic_accident", "stopped_vehicle": "stalled_or_broken_down_vehicle", "slow_vehicle": "vehicle_blocking_traffic",
              "wrong_way_vehicle": "wrong_way_driving", "traffic_congestion": "traffic_congestion", "loitering": "loitering_or_suspicious_presence"}
HAZARD_LABEL = {"fire": "fire", "smoke": "smoke", "flood": "waterlogging_or_flood", "water": "waterlogging_or_flood", "waterlog": "waterlogging_or_flood", "submerg": "waterlogging_or_flood",
                "debris": "road_spill_or_debris", "spill": "road_spill_or_debris", "collision": "traffic_accident", "crash": "traffic_accident", "explosion": "traffic_accident",
                "fight": "fighting_or_violence", "violence": "fighting_or_violence", "assault": "fighting_or_violence"}
REAL_HAZARDS = ("fire", "smoke", "collision", "crash", "explosion", "debris", "crowd", "flood", "water", "spill", "waterlog", "submerg", "drain", "fight", "violence", "assault")
ONSET_KEY = {"collision_signature": "age_s", "stopped_vehicle": "stationary_s", "loitering": "stationary_s", "traffic_congestion": "sustained_s", "person_in_roadway": "age_s"}
LENGTH_M = {"car": 4.4, "truck": 8.0, "bus": 11.0, "motorcycle": 2.1, "bicycle": 1.8, "person": 0.6, "van": 5.5, "motor": 2.1, "tricycle": 2.8, "awning-tricycle": 3.0, "pedestrian": 0.6, "people": 0.6}
ZONE_PHRASE = {"driving_lane": "a live driving lane", "shoulder": "the hard shoulder", "parking": "a parking area", "sidewalk": "a sidewalk", "restricted": "a restricted area", "unknown": "an unmapped part of the scene"}


def floored(x: Column, digits: int) -> Column:
    """Half-up rounding in a form that engines agree on."""
    return F.floor(x * 10**digits + 0.5).cast("double") / 10**digits


def lookup(key: Column, values: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[key]


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(F.try_divide(a.cast("double"), b.cast("double")))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return ratio(2 * p * r, p + r)


def iou_1d(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    inter = F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))
    return ratio(inter, (a1 - a0) + (b1 - b0) - inter)


def iou_2d(a: list[Column], b: list[Column]) -> Column:
    """Boxes as [x1, y1, x2, y2]."""
    inter = F.greatest(F.lit(0), F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * F.greatest(F.lit(0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda c: F.greatest(F.lit(0), c[2] - c[0]) * F.greatest(F.lit(0), c[3] - c[1])
    return ratio(inter, area(a) + area(b) - inter)


def angle_apart(a: Column, b: Column) -> Column:
    return F.abs(F.pmod(a - b + 180, F.lit(360)) - 180)


def in_polygon(x: Column, y: Column, polygon: list[tuple[int, int]]) -> Column:
    """Even-odd rule; points on the border are inside."""
    odd, border = F.lit(0), F.lit(False)
    for (ax, ay), (bx, by) in zip(polygon, polygon[1:] + polygon[:1], strict=True):
        cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        border = border | ((cross == 0) & x.between(min(ax, bx), max(ax, bx)) & y.between(min(ay, by), max(ay, by)))
        if ay != by:
            spans = ((F.lit(ay) > y) != (F.lit(by) > y))
            odd = odd + (spans & (x < (bx - ax) * (y - ay) / float(by - ay) + ax)).cast("int")
    return border | (odd % 2 == 1)


def zone_of(x: Column, y: Column, zones: list[tuple[str, list[tuple[int, int]]]], default: str = "unknown") -> Column:
    """Kind of the first zone, in order, that holds the point."""
    return reduce(lambda rest, z: F.when(in_polygon(x, y, z[1]), F.lit(z[0])).otherwise(rest), reversed(zones), F.lit(default))


def metres_per_pixel(name: Column, w: Column, h: Column) -> Column:
    long_side = F.greatest(w, h)
    return F.when(long_side > 2, lookup(F.lower(name), LENGTH_M) / long_side)


def flow_trusted(flow: Column, consistency: Column, samples: Column) -> Column:
    return (F.when(flow.isNull(), False).when(consistency.isNull() & samples.isNull(), True)
            .when(consistency < 0.55, False).when(samples < 40, False).otherwise(True))


def onset(t: Column, kind: Column, features: Column) -> Column:
    return F.greatest(F.lit(0.0), t - F.coalesce(F.try_element_at(features, lookup(kind, ONSET_KEY)), F.lit(0.0)))


def contains_any(text: Column, words: tuple[str, ...] | list[str]) -> Column:
    return reduce(lambda a, w: a | F.contains(text, F.lit(w)), words, F.lit(False))


def label_of(kind: Column, hazard: Column) -> Column:
    """The first hazard word in the text decides, else the kind; null: no label."""
    text = F.lower(F.coalesce(hazard, F.lit("")))
    chain = lookup(kind, KIND_LABEL)
    for word, label in reversed(HAZARD_LABEL.items()):
        chain = F.when(F.contains(text, F.lit(word)), label).otherwise(chain)
    return chain


def real_hazard(hazard: Column, watch: tuple[str, ...] = ()) -> Column:
    text = F.lower(F.trim(F.coalesce(hazard, F.lit(""))))
    some = contains_any(text, REAL_HAZARDS)
    for term in watch:
        some = some | F.contains(text, F.lit(term)) | F.contains(F.lit(term), text)
    return F.when(text.isin("", "none", "n/a", "nothing"), False).otherwise(some)


def tolerant_bool(x: Column) -> Column:
    return F.coalesce(F.lower(F.trim(x.cast("string"))).isin("true", "1", "yes"), F.lit(False))


def number(x: Column) -> Column:
    return F.nullif(F.trim(x.cast("string")), F.lit("")).try_cast("double")


def confidence(text: Column, default: float = 0.0) -> Column:
    """First number after the word confidence."""
    return F.coalesce(F.regexp_extract(text, r"confidence[ :]*([0-9.]*)", 1).try_cast("double"), F.lit(default))


def confidence_in_brackets(text: Column, default: float = 1.0) -> Column:
    """What stands between the word confidence and the next closing bracket."""
    return F.coalesce(F.trim(F.regexp_extract(text, r"confidence[ (]*([^)]*)", 1)).try_cast("double"), F.lit(default))


def explanation(text: Column) -> Column:
    s = F.trim(text)
    return F.when(F.length(s).between(20, 500), s)


def clean_description(text: Column, fallback: Column, least: int = 20, most: int = 500, earliest: int = 40) -> Column:
    """Short texts give the fallback; long ones end at the last sentence mark that stands late enough."""
    s = F.trim(text)
    head = F.substring(s, 1, most)
    cut = F.concat(F.rtrim(F.substring(s, 1, most - 1)), F.lit("."))
    for mark in ("? ", "! ", ". "):
        at = most - F.locate(mark[::-1], F.reverse(head)) - 1  # place of the mark, from 0
        cut = F.when((F.locate(mark, head) > 0) & (at >= earliest), F.substring(s, F.lit(1), at + 1)).otherwise(cut)
    return F.when(F.length(s) < least, fallback).when(F.length(s) <= most, s).otherwise(cut)


def whole(x: Column) -> Column:
    """Rounded to a whole number, halves to the even one."""
    return F.bround(x.cast("double"), 0).cast("long")


def where_phrase(start: Column, end: Column, duration: Column) -> Column:
    """Where an interval lies in its clip, in whole seconds with its span; no part without a known duration, empty without times."""
    share = start / F.when(duration > 0, duration)
    part = F.when(share < 0.33, "early in the clip").when(share < 0.66, "midway through the clip").when(share.isNotNull(), "late in the clip")
    times = F.format_string("from %ds to %ds (%ds)", whole(start), whole(end), whole(F.greatest(end - start, F.lit(0.0))))
    return F.when(start.isNull() | end.isNull(), "").otherwise(F.concat_ws(", ", part, times))


def picked_phrase(key: Column, variants: list[str]) -> Column:
    """A variant chosen by the sum of the key's code points."""
    total = F.aggregate(F.split(key, ""), F.lit(0), lambda a, c: a + F.ascii(c))
    return F.get(F.array(*map(F.lit, variants)), total % len(variants))


def _json_object(c: Column) -> Column:
    """The text as a JSON object, else null; parsed once."""
    return F.get(F.transform(F.array(c), lambda t: F.when(F.trim(t).startswith("{"), F.try_parse_json(t))), 0)


def _fits(v: Column, kinds: dict[str, str]) -> Column:
    """Whether the fields are there with their types."""
    good = F.lit(True)
    for name, kind in kinds.items():
        good = good & F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")) == kind, F.lit(False))
    return good


def salvaged_json(text: Column, schema: str) -> Column:
    """Whole text, else its first {...} block that is a JSON object, else first { to last }."""
    blocks = F.concat(F.array(text), F.regexp_extract_all(text, F.lit(r"(?s)(\{.*?\})"), 1), F.array(F.regexp_extract(text, r"(?s)\{.*\}", 0)))
    good = F.filter(blocks, lambda b: F.trim(b).startswith("{") & F.try_parse_json(b).isNotNull())
    return F.from_json(F.get(good, 0), schema, {"mode": "PERMISSIVE"})


#: The fields of an observation and their types.
OBSERVATION = {"hazard_visible": "BOOLEAN", "hazard_type": "STRING", "surroundings": "STRING"}


def observation(text: Column) -> Column:
    """(hazard_visible, hazard_type, surroundings) of a model's answer with prose around it, or null.

    The whole text and then each {...} block is tried, and the first whose fields have their types counts; last, the
    text from the first { to the last } is read as it comes: missing fields are false, none and empty, the
    surroundings end after 300 characters.
    """
    blocks = F.concat(F.array(F.trim(text)), F.regexp_extract_all(text, F.lit(r"(?s)(\{.*?\})"), 1))
    tried = F.transform(blocks, _json_object)
    strict = F.get(F.filter(tried, lambda v: v.isNotNull() & _fits(v, OBSERVATION)), 0)
    loose = _json_object(F.regexp_extract(text, r"(?s)\{.*\}", 0))
    field = lambda v, name: F.try_variant_get(v, f"$.{name}", "string")
    read = lambda v: F.struct(tolerant_bool(field(v, "hazard_visible")).alias("hazard_visible"), F.coalesce(field(v, "hazard_type"), F.lit("none")).alias("hazard_type"),
                              F.coalesce(field(v, "surroundings"), F.lit("")).alias("surroundings"))
    short = read(loose).withField("surroundings", F.substring(read(loose)["surroundings"], 1, 300))
    return F.when(strict.isNotNull(), read(strict)).when(loose.isNotNull(), short)


def verdict(text: Column) -> Column:
    """(anomalous, severity in 0..1, reason up to 300 characters) or null; parsed once."""
    return F.get(F.transform(F.array(salvaged_json(text, "anomalous string, severity string, reason string")), _bounded), 0)


def _bounded(v: Column) -> Column:
    return F.when(v.isNotNull(), F.struct(tolerant_bool(v["anomalous"]).alias("anomalous"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(v["severity"].try_cast("double"), F.lit(0.0)))).alias("severity"),
                                          F.substring(F.coalesce(v["reason"], F.lit("")), 1, 300).alias("reason")))


def fused_verdict(rule_anomalous: Column, rule_severity: Column, hazard_visible: Column, hazard: Column, watch: tuple[str, ...] = ()) -> Column:
    """An observed real hazard escalates, never lowers, what the rule says."""
    seen = F.coalesce(hazard_visible, F.lit(False)) & real_hazard(hazard, watch)
    floor = F.when(real_hazard(hazard), 0.9).otherwise(0.6)
    return F.struct((seen | rule_anomalous).alias("anomalous"), F.when(seen, F.greatest(floor, rule_severity)).otherwise(rule_severity).alias("severity"))


#: What a verdict says of an event, by kind and by whether its rule holds.
VERDICT_LEADS = {"stopped_vehicle": "Vehicle stopped in live traffic while surrounding vehicles keep moving.", "person_in_roadway": "Person detected in a live traffic lane.",
                 "wrong_way_vehicle": "Vehicle travelling against the direction of its lane."}
ANY_LEAD = "Tracker rule flagged this object."
NORMAL_LEADS = {"stopped_vehicle": "Vehicle stopped, but surrounding traffic is stopped too - congestion, not an incident."}
ANY_NORMAL = "Behaviour consistent with normal traffic."


def fused_reason(kind: Column, rule_anomalous: Column, hazard_visible: Column, hazard: Column, surroundings: Column, watch: tuple[str, ...] = ()) -> Column:
    """The text of a fused verdict: the hazard seen, else what the rule says of the kind, then the surroundings."""
    seen = F.coalesce(hazard_visible, F.lit(False)) & real_hazard(hazard, watch)
    named = F.concat(F.upper(F.substring(hazard, 1, 1)), F.lower(F.substring(hazard, 2, 1_000_000)), F.lit(" visible at the scene."))
    lead = F.when(seen, named).when(rule_anomalous, F.coalesce(lookup(kind, VERDICT_LEADS), F.lit(ANY_LEAD))).otherwise(F.coalesce(lookup(kind, NORMAL_LEADS), F.lit(ANY_NORMAL)))
    return F.trim(F.concat(lead, F.lit(" "), F.coalesce(surroundings, F.lit(""))))


def first_option(prompt: Column) -> Column:
    """Stand-in of the second opinion: the first listed option of the prompt (a line "- name: ..."), else normal."""
    return F.coalesce(F.nullif(F.rtrim(F.regexp_extract(prompt, r"(?m)^[ \t]*- ([^:\r\n]*)", 1)), F.lit("")), F.lit("normal"))


def closed_choice(answer: Column, options: list[str]) -> Column:
    """The longest option named in the first line, else the longest whose part before "_or_" is; else the same in the whole answer."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[-_\s]+", " "))
    flat = lambda s: re.sub(r"[-_\s]+", " ", s.lower()).strip()
    by_length = sorted(options, key=len, reverse=True)
    names = [(flat(o), o) for o in by_length] + [(flat(o.split("_or_")[0]), o) for o in by_length if flat(o.split("_or_")[0])]
    pick = lambda text: F.coalesce(*(F.when(F.contains(text, F.lit(said)), o) for said, o in names))
    first = F.get(F.split(F.regexp_replace(answer, r"^\s+", ""), r"\r\n|[\n\r]"), 0)
    return F.coalesce(pick(plain(first)), pick(plain(answer)))


def thresholds_for(duration: Column) -> Column:
    """Settings by clip length; below 8 s they are shares of it."""
    pick = lambda short, mid, long: F.when(duration < 8, short).when(duration < 30, F.lit(mid)).otherwise(F.lit(long))
    at_least = lambda low, share: F.greatest(F.lit(low), duration * share)
    return F.struct(pick(at_least(1.5, 0.35), 5.0, 8.0).alias("stop_s"), pick(at_least(2.0, 0.45), 8.0, 10.0).alias("loiter_s"), pick(at_least(2.0, 0.40), 8.0, 12.0).alias("congestion_s"),
                    pick(duration, 30.0, 60.0).alias("congestion_cooldown_s"), pick(F.least(F.lit(4.0), duration * 0.5), 4.0, 4.0).alias("duplicate_s"), pick(at_least(1.0, 0.3), 6.0, 6.0).alias("cooldown_s"))


def stride_for(fps: Column, wanted: Column) -> Column:
    return F.when(fps < 5, 1).when(fps < 15, F.least(wanted, F.lit(2))).otherwise(wanted)


def checked_label(label: Column) -> Column:
    """The label; one that is not in the set fails the query."""
    return F.when(label.isin(*LABELS), label).otherwise(F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(label, F.lit("null")))))


#: Shape of a model's verdict as JSON schema, as it is sent along with a request.
VERDICT_SCHEMA = {"type": "object", "required": ["anomalous", "severity", "reason"], "properties": {"anomalous": {"type": "boolean"}, "severity": {"type": "number", "minimum": 0, "maximum": 1}, "reason": {"type": "string"}}}


def strict_verdict(text: Column) -> Column:
    """The verdict of a text that is wholly one JSON object of the right types with a severity in 0..1, else null."""
    v = F.try_parse_json(text)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    severity = F.try_variant_get(v, "$.severity", "double")
    good = (kind("$.anomalous") == "BOOLEAN") & (kind("$.reason") == "STRING") & severity.between(0.0, 1.0) & (kind("$.severity") != "STRING")
    return F.when(good, F.struct(F.try_variant_get(v, "$.anomalous", "boolean").alias("anomalous"), severity.alias("severity"), F.try_variant_get(v, "$.reason", "string").alias("reason")))
