"""The stateful fold over one video's frames, shared by batch and Structured Streaming.

``Tracker.update`` takes one frame's detections and gives the events they raise. State is kept
per track (dwell latch, speed, heading) and per scene (cooldowns, congestion run). Rules look at
neighbours, so a video is the unit of work; videos spread over the cluster. State is bounded:
120 positions for each track, tracks unseen for 30 s are dropped.
"""

from __future__ import annotations

import math
import json
from collections import deque
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, fields
from itertools import groupby
from statistics import median

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.expr import LENGTH_M, ZONE_PHRASE
from ..operators import traffic

VEHICLES, PEOPLE = frozenset(traffic.VEHICLES), frozenset(traffic.PEOPLE)


@dataclass(frozen=True)
class Config:
    """Default settings of the rules."""

    stop_s: float = 20; still: float = 0.05; person_s: float = 2; loiter_s: float = 25  # noqa: E702
    crowd: int = 8; crowd_cool: float = 45; jam_n: int = 5; jam_share: float = 0.6; jam_s: float = 12; jam_cool: float = 60; crawl: float = 0.18  # noqa: E702
    hit_n: int = 2; hit_window: float = 2.5; hit_settle: float = 4; hit_moving: float = 0.8; hit_near: float = 4; hit_cool: float = 15; sweep_s: float = 0  # noqa: E702
    wrong_deg: float = 135; wrong_speed: float = 0.3; cool: float = 30; calls: int = 3; look_back: float = 1; least_age: float = 1; release: float = 0.6  # noqa: E702
    dup_iou: float = 0.55; dup_s: float = 20; small: float = 0.02; scale_rate: float = 0.04; expire: float = 30  # noqa: E702
    slow: bool = False; slow_ratio: float = 0.35; slow_n: int = 3; slow_obs: int = 6; slow_share: float = 0.7; slow_small: float = 0.05  # noqa: E702


LANE = {"default": "unknown", "zones": [("lane", "driving_lane", [(0, 0), (1000, 0), (1000, 600), (0, 600)], 0.0, None, None)]}


@dataclass
class Track:
    first: float
    name: str
    last: float = 0
    box: tuple = ()
    diag: float = 1
    frame_diag: float = 0
    zone: tuple = ("unknown", None, None, None)
    history: deque = field(default_factory=lambda: deque(maxlen=120))
    scales: deque = field(default_factory=lambda: deque(maxlen=15))
    slow: deque = field(default_factory=lambda: deque(maxlen=20))
    speed: float = 0.0
    scale: float = 0.0
    heading: float | None = None
    m_per_px: float | None = None
    since: float | None = None
    anchor: tuple = ()
    slow_since: float | None = None
    calls: int = 0
    fired: float = -1e18

    @property
    def dwell(self) -> float:
        return max(0.0, self.last - self.since) if self.since is not None else 0.0

    @property
    def vehicle(self) -> bool:
        return self.name in VEHICLES

    @property
    def person(self) -> bool:
        return self.name in PEOPLE


def _inside(x: float, y: float, polygon: list) -> bool:
    odd = False
    for (ax, ay), (bx, by) in zip(polygon, polygon[1:] + polygon[:1], strict=True):
        if (bx - ax) * (y - ay) == (by - ay) * (x - ax) and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
            return True
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            odd = not odd
    return odd


def _iou(a: tuple, b: tuple) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(0, w) * max(0, h)
    total = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return both / total if total > 0 else 0.0


class Tracker:
    def __init__(self, zones: dict | None = None, config: Config = Config()):
        self.zones, self.c = zones or {"default": "unknown", "zones": []}, config
        self.tracks: dict[int, Track] = {}
        self.recent: list[tuple[float, tuple, str]] = []
        self.cooled = {"crowd": -1e18, "jam": -1e18, "hit": -1e18, "sweep": -1e18}
        self.jam_since: float | None = None

    def dump(self, last: float, held: list[tuple]) -> str:
        tracks = {k: asdict(t) | {c: list(getattr(t, c)) for c in ("history", "scales", "slow")} for k, t in self.tracks.items()}
        return json.dumps({"version": STATE, "last": last, "held": held, "tracks": tracks, "recent": self.recent, "cooled": self.cooled, "jam_since": self.jam_since})

    @classmethod
    def load(cls, text: str, zones: dict | None, config: Config) -> tuple[Tracker, float, list]:
        """The tracker, the time of its last frame and the rows held back; fields that a later version adds get their defaults."""
        v = json.loads(text)
        if v["version"] > STATE:
            raise ValueError(f"state of version {v['version']}: this code reads up to {STATE}")
        out, known = cls(zones, config), {f.name for f in fields(Track)}
        for k, t in v["tracks"].items():
            deques = {c: deque(map(tuple, t[c]) if c == "history" else t[c], n) for c, n in (("history", 120), ("scales", 15), ("slow", 20))}
            tuples = {c: tuple(t[c]) for c in ("box", "zone", "anchor")}
            out.tracks[int(k)] = Track(**{c: x for c, x in t.items() if c in known} | deques | tuples)
        out.recent = [(t, tuple(b), k) for t, b, k in v["recent"]]
        out.cooled |= v["cooled"]
        out.jam_since = v["jam_since"]
        return out, v["last"], v["held"]

    def _zone(self, x: float, y: float) -> tuple:
        for _, kind, polygon, *flow in self.zones["zones"]:
            if _inside(x, y, polygon):
                return (kind, *flow)
        return (self.zones["default"], None, None, None)

    def _move(self, t: Track, now: float) -> None:
        """Speed against the oldest own place within the look-back; a lone place leaves all but the speed as it was."""
        at = next(h for h in t.history if h[0] >= now - self.c.look_back)
        _, x, y, diag = t.history[-1]
        dt = now - at[0]
        if dt <= 1e-6:
            t.speed = 0.0
            return
        far = math.hypot(x - at[1], y - at[2])
        t.speed = far / max(t.diag, 1e-6) / dt
        t.scales.append(abs(diag - at[3]) / max(at[3], 1e-6) / dt)
        t.scale = median(t.scales)
        if far > 0.5 * t.diag:
            t.heading = math.degrees(math.atan2(y - at[2], x - at[1])) % 360

    def _latch(self, t: Track, now: float) -> None:
        _, x, y, _ = t.history[-1]
        deep = t.scale >= self.c.scale_rate
        if t.since is None:
            if t.speed < self.c.still and not deep:
                t.since, t.anchor = now, (x, y)
        elif math.hypot(x - t.anchor[0], y - t.anchor[1]) / max(t.diag, 1e-6) > self.c.release or deep:
            t.since = None

    def _peers(self, me: int, now: float) -> list[Track]:
        return [t for k, t in sorted(self.tracks.items()) if k != me and t.vehicle and now - t.last <= 1.0]

    def update(self, frame_idx: int, now: float, rows: list[tuple]) -> list[dict]:
        """rows: (track_id, class, x1, y1, x2, y2, frame_diag, rx, ry); rx, ry: the centre without the camera's motion, or None."""
        live = []
        for key, name, x1, y1, x2, y2, frame_diag, rx, ry in sorted(rows, key=lambda r: r[0]):
            t = self.tracks.get(key)
            if t is not None and now - t.last > self.c.expire:
                t = None
            if t is None:
                t = self.tracks[key] = Track(now, name)
            w, h = x2 - x1, y2 - y1
            x, y = ((x1 + x2) / 2, (y1 + y2) / 2) if rx is None or ry is None else (rx, ry)
            t.last, t.name, t.box, t.diag, t.frame_diag = now, name, (x1, y1, x2, y2), math.hypot(w, h), frame_diag
            t.m_per_px = LENGTH_M[name] / max(w, h) if name in LENGTH_M and max(w, h) > 2 else None
            t.history.append((now, x, y, t.diag))
            t.zone = self._zone(x, y)
            self._move(t, now)
            self._latch(t, now)
            live.append(key)
        if self.c.slow:
            for key in live:
                self._slow(key, now)
        out = []
        for key in live:
            t = self.tracks[key]
            if now - t.first < self.c.least_age or t.calls >= self.c.calls or now - t.fired < self.c.cool:
                continue
            if found := self._rule(key, t, now):
                kind, anomalous, severity, features, context = found
                t.fired = now
                self.recent = [r for r in self.recent if now - r[0] <= self.c.dup_s]
                family = lambda k: "impeded_vehicle" if k in ("stopped_vehicle", "slow_vehicle") else k
                if any(family(k) == family(kind) and _iou(b, t.box) >= self.c.dup_iou for _, b, k in self.recent):
                    continue
                t.calls += 1
                self.recent.append((now, t.box, kind))
                out.append(self._event(frame_idx, now, kind, key, t.name, t.zone[0], t.box, anomalous, severity, features, context))
        out += self._scene(frame_idx, now)
        self.tracks = {k: t for k, t in self.tracks.items() if now - t.last <= self.c.expire}
        return out

    def _slow(self, key: int, now: float) -> None:
        t, peers = self.tracks[key], [p for p in self._peers(key, now) if p.since is None]
        if not t.vehicle or len(peers) < self.c.slow_n:
            return
        ambient = median(p.speed + p.scale for p in peers)
        crawling = ambient > 0 and (t.speed + t.scale) / ambient < self.c.slow_ratio
        t.slow.append(crawling)
        if crawling and t.slow_since is None:
            t.slow_since = now
        elif not crawling and sum(t.slow) / len(t.slow) < self.c.slow_share:
            t.slow_since = None

    def _rule(self, key: int, t: Track, now: float) -> tuple | None:
        c, zone, age = self.c, t.zone[0], now - t.first
        big = t.frame_diag <= 1 or t.diag / t.frame_diag >= c.small
        place = ZONE_PHRASE.get(zone, "a " + zone.replace("_", " "))
        if t.vehicle and zone in ("driving_lane", "unknown") and big and t.dwell >= c.stop_s:
            peers = self._peers(key, now)
            stopped = sum(p.since is not None for p in peers)
            jam = len(peers) >= 3 and stopped / len(peers) >= 0.6
            flow = "most vehicles around it have stopped too" if jam else "traffic around it is still flowing"
            severity = 0.2 if jam else min(0.85, 0.55 + t.dwell / 120)
            return "stopped_vehicle", not jam, severity, {"stationary_s": t.dwell, "neighbours": float(len(peers)), "stopped": float(stopped)}, f"A {t.name} has stood for {t.dwell:.0f} s in {place}; {flow}."
        share = sum(t.slow) / len(t.slow) if t.slow else 0.0
        if c.slow and t.vehicle and len(t.slow) >= c.slow_obs and share >= c.slow_share and (t.frame_diag <= 1 or t.diag / t.frame_diag >= c.slow_small):
            return "slow_vehicle", True, min(0.55, 0.3 + 0.25 * share), {"slow_fraction": share}, f"A {t.name} moves far slower than the traffic around it in {place}."
        if t.person and zone == "driving_lane" and age >= c.person_s:
            return "person_in_roadway", True, 0.85, {"age_s": age}, f"A person has been in {place} for {age:.0f} s."
        if t.person and t.dwell >= c.loiter_s and zone != "sidewalk":
            severe = zone in ("driving_lane", "restricted")
            return "loitering", severe, 0.7 if severe else 0.35, {"stationary_s": t.dwell}, f"A person has stayed in {place} for {t.dwell:.0f} s."
        flow, consistency, samples = t.zone[1:]
        trusted = flow is not None and (consistency is None and samples is None or (consistency is None or consistency >= 0.55) and (samples is None or samples >= 40))
        if t.vehicle and t.heading is not None and t.speed >= c.wrong_speed and trusted:
            apart = abs((t.heading - flow + 180) % 360 - 180)
            if apart >= c.wrong_deg:
                return "wrong_way_vehicle", True, 0.9, {"apart_deg": apart}, f"A {t.name} moves against the flow of {place}, {apart:.0f} degrees off."
        return None

    def _scene(self, frame_idx: int, now: float) -> list[dict]:
        c, out = self.c, []
        whole = lambda ts: (min(t.box[0] for t in ts), min(t.box[1] for t in ts), max(t.box[2] for t in ts), max(t.box[3] for t in ts))
        add = lambda kind, box, anomalous, severity, features, context: out.append(self._event(frame_idx, now, kind, None, "scene", "unknown", box, anomalous, severity, features, context))
        people = [t for t in self.tracks.values() if t.person and now - t.last <= 0.5]
        if len(people) >= c.crowd and now - self.cooled["crowd"] >= c.crowd_cool:
            self.cooled["crowd"] = now
            add("crowd_density", whole(people), False, 0.3, {"people": float(len(people))}, f"{len(people)} people are in view.")
        cars = [t for _, t in sorted(self.tracks.items()) if t.vehicle and now - t.last <= 1.0]
        share = sum(t.speed < c.still for t in cars) / len(cars) if cars else 1.0
        fresh = sorted((t for t in cars if t.since is not None and now - t.first >= c.least_age and now - t.since <= c.hit_settle and t.since - t.first >= c.hit_moving), key=lambda t: t.since)
        if len(cars) >= c.hit_n and len(fresh) >= c.hit_n and share < c.jam_share and now - self.cooled["hit"] >= c.hit_cool:
            groups = [[t for t in fresh[i:] if t.since - a.since <= c.hit_window] for i, a in enumerate(fresh)]
            group = max(groups, key=len)
            reach = c.hit_near * median(t.diag for t in group)
            centre = lambda t: ((t.box[0] + t.box[2]) / 2, (t.box[1] + t.box[3]) / 2)
            near = [t for t in group if math.dist(centre(t), centre(group[0])) <= reach]
            if len(near) >= c.hit_n:
                self.cooled["hit"] = now
                xs, ys = zip(*(centre(t) for t in near), strict=True)
                box = (min(xs) - reach / 2, min(ys) - reach / 2, max(xs) + reach / 2, max(ys) + reach / 2)
                onset, zone = min(t.since for t in near), near[0].zone[0]
                place = ZONE_PHRASE.get(zone, "a " + zone.replace("_", " "))
                said = f"{len(near)} vehicles ({', '.join(sorted({t.name for t in near}))}) stopped within {c.hit_window:.0f} s of each other and close together in {place}; only {100 * share:.0f}% of the traffic in view stands."
                features = {"vehicles_stopped_together": float(len(near)), "stopped_share": round(share, 2), "onset_s": round(onset, 2), "age_s": round(now - onset, 2)}
                out.append(self._event(frame_idx, now, "collision_signature", None, "vehicle", zone, box, True, 0.85, features, said))
        if len(cars) >= c.jam_n and sum(t.speed < c.crawl for t in cars) / len(cars) >= c.jam_share:
            self.jam_since = now if self.jam_since is None else self.jam_since
            held = now - self.jam_since
            if held >= c.jam_s and now - self.cooled["jam"] >= c.jam_cool:
                self.cooled["jam"] = now
                add("traffic_congestion", whole(cars), True, min(0.6, 0.35 + held / 120), {"sustained_s": held, "vehicles": float(len(cars))}, f"Most of {len(cars)} vehicles have crawled for {held:.0f} s.")
        else:
            self.jam_since = None
        if c.sweep_s > 0 and now - self.cooled["sweep"] >= c.sweep_s:
            self.cooled["sweep"] = now
            add("scene_sweep", whole(list(self.tracks.values())) if self.tracks else (0, 0, 0, 0), False, 0.0, {}, "Regular look at the whole scene.")
        return out

    @staticmethod
    def _event(frame_idx: int, now: float, kind: str, key: int | None, name: str, zone: str, box: tuple, anomalous: bool, severity: float, features: dict, context: str) -> dict:
        return {"frame_idx": frame_idx, "t": round(now, 3), "kind": kind, "track_id": key, "class_name": name, "zone_kind": zone, "bbox": [round(float(v), 1) for v in box],
                "anomalous": anomalous, "severity": round(severity, 2), "features": {k: float(v) for k, v in features.items()}, "context": context}


EVENTS = "video_id string, frame_idx long, t double, kind string, track_id long, class_name string, zone_kind string, bbox array<double>, anomalous boolean, severity double, features map<string,double>, context string"
_COLUMNS = [x.strip().split(" ")[0] for x in EVENTS.split(", ")]


_INPUT = ("video_id", "frame_idx", "t", "track_id", "class_name", "x1", "y1", "x2", "y2", "frame_diag", "rx", "ry")


def _columns(detections: DataFrame) -> DataFrame:
    return detections.select(*(F.col(c) if c in detections.columns else F.lit(None).cast("double").alias(c) for c in _INPUT))


def _detection(r: dict) -> tuple | None:
    return None if r["track_id"] is None else (int(r["track_id"]), r["class_name"], r["x1"], r["y1"], r["x2"], r["y2"], r["frame_diag"], r["rx"], r["ry"])


def run(detections: DataFrame, zones: dict | None = None, config: Config = Config()) -> DataFrame:
    """Events of all videos; detections: video_id, frame_idx, t, track_id, class_name, x1, y1, x2, y2, frame_diag,
    and rx, ry where the camera moves (``motion.stabilised``).

    Videos are spread over the cluster and sorted there (on disk where they must be); a task streams through them with
    the state of one video and the detections of one frame at a time.
    """

    schema = to_arrow_schema(T._parse_datatype_string(EVENTS))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        video, frame, tracker, held = object(), None, None, []

        def flush() -> list[dict]:
            return [{"video_id": video, **e, "features": list(e["features"].items())} for e in tracker.update(int(frame[0]), float(frame[1]), held)] if frame is not None else []

        out: list[dict] = []
        for batch in batches:
            for r in batch.to_pylist():
                if r["video_id"] != video:
                    out += flush()
                    video, frame, tracker, held = r["video_id"], None, Tracker(zones, config), []
                if (r["frame_idx"], r["t"]) != frame:
                    out += flush()
                    frame, held = (r["frame_idx"], r["t"]), []
                if (found := _detection(r)) is not None:
                    held.append(found)
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out = []
        yield pa.RecordBatch.from_pylist(flush(), schema=schema)

    rows = _columns(detections).repartition("video_id").sortWithinPartitions("video_id", "t", "frame_idx", "track_id")
    return rows.mapInArrow(fold, EVENTS)


IDLE_MS, STATE = 10 * 60 * 1000, 1  # STATE: version of what is kept between micro-batches


def run_stream(detections: DataFrame, zones: dict | None = None, config: Config = Config(), idle_ms: int | None = IDLE_MS) -> DataFrame:
    """The same fold over a stream, with state for each video.

    The last frame of a micro-batch may still get rows, so it is held back until a later one is seen or the video has
    been idle for ``idle_ms`` (processing time); then the held frame is read and the state is freed. Rows older than the
    last frame read come too late and are dropped. With ``idle_ms`` None state is kept for good and a trigger that ends
    (availableNow) does end; the timer of idle videos would keep it running. State is JSON of plain values under a version, so it outlives an upgrade.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        tracker, last, held = Tracker.load(state.get[0], zones, config) if state.exists else (Tracker(zones, config), -math.inf, [])
        ended = state.hasTimedOut
        new = [] if ended else [tuple(None if pd.isna(v) else v for v in row) for f in frames for row in f[list(_INPUT[1:])].itertuples(index=False)]
        rows = sorted((r for r in [*map(tuple, held), *new] if r[1] > last), key=lambda r: (r[1], r[0], -1 if r[2] is None else r[2]))
        newest = max((r[1] for r in rows), default=-math.inf)
        ready = rows if ended else [r for r in rows if r[1] < newest]
        events: list[dict] = []
        for frame, group in groupby(ready, key=lambda r: r[:2]):
            found = (_detection(dict(zip(_INPUT[1:], r, strict=True))) for r in group)
            events += tracker.update(int(frame[0]), float(frame[1]), [x for x in found if x is not None])
            last = float(frame[1])
        if ended:
            state.remove()
        else:
            state.update((tracker.dump(last, [r for r in rows if r[1] == newest]),))
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
        if events:
            yield pd.DataFrame([{"video_id": key[0], **e} for e in events], columns=_COLUMNS).astype({"track_id": "Int64"})

    return _columns(detections).groupBy("video_id").applyInPandasWithState(step, EVENTS, "state string", "append", "NoTimeout" if idle_ms is None else "ProcessingTimeTimeout")


def scenarios(spark: SparkSession) -> DataFrame:
    """Made-up detections, 10 frames a second: a stop, a wrong way, a jam, free flow, two boxes for one car, a gap."""
    rows = spark.range(400).select(F.col("id").alias("frame_idx"), (F.col("id") / 10).alias("t"))

    def track(video: str, key: int, x: str, y: str, frames: str, name: str = "car") -> DataFrame:
        x1, y1 = F.expr(x).cast("double"), F.expr(y).cast("double")
        return rows.filter(frames).select(F.lit(video).alias("video_id"), "frame_idx", "t", F.lit(key).cast("long").alias("track_id"), F.lit(name).alias("class_name"), x1.alias("x1"), y1.alias("y1"), (x1 + 60).alias("x2"), (y1 + 40).alias("y2"), F.lit(0.0).alias("frame_diag"))

    parts = [track("stop", 1, "100", "300", "true"), track("stop", 2, "200 + 3 * frame_idx", "400", "true"), track("wrong", 1, "900 - 14 * frame_idx", "300", "frame_idx < 60"),
             track("twice", 1, "100", "300", "true"), track("twice", 2, "102", "301", "true"), track("gap", 1, "100", "300", "frame_idx < 50 or frame_idx > 370"), track("walk", 1, "500", "300", "true", "person")]
    parts += [track("jam", k, f"{120 * k}", "300", "frame_idx < 260") for k in range(6)] + [track("flow", k, f"{120 * k} + 14 * frame_idx", "300", "frame_idx < 260") for k in range(6)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def scenarios_truth(spark: SparkSession) -> DataFrame:
    """What the made-up detections hold: video_id, kind, start (s), box; videos without a row are normal."""
    rows = [("stop", "stopped_vehicle", 0.0, [100.0, 300.0, 160.0, 340.0]), ("wrong", "wrong_way_vehicle", 0.0, [900.0, 300.0, 960.0, 340.0]), ("twice", "stopped_vehicle", 0.0, [100.0, 300.0, 160.0, 340.0]),
            ("walk", "person_in_roadway", 0.0, [500.0, 300.0, 560.0, 340.0]), ("jam", "traffic_congestion", 0.0, [0.0, 300.0, 660.0, 340.0])]
    listed = F.array(*(F.struct(F.lit(v).alias("video_id"), F.lit(k).alias("kind"), F.lit(s).alias("start"), F.array(*map(F.lit, b)).alias("box")) for v, k, s, b in rows))
    return spark.range(1).select(F.explode(listed).alias("x")).select("x.*")
