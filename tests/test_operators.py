"""Operators whose results are worked out by hand, sources and sinks, the tracker in batch and stream."""

import json
import math

import pytest
from pyspark.sql import functions as F

from episodic.functions import expr as X
from episodic.operators import assemble, decide, intervals, sample, score, search
from episodic.sources import readers
from episodic.streaming import tracker


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_text_expressions(spark):
    lit = F.lit
    assert one(spark, X.confidence(lit("confidence: 0.85 x"))) == 0.85
    assert one(spark, X.confidence(lit("none"))) == 0.0 and one(spark, X.confidence_in_brackets(lit("none"))) == 1.0
    assert one(spark, X.confidence_in_brackets(lit("fire (confidence 0.8)."))) == 0.8
    assert one(spark, X.tolerant_bool(lit(" TRUE "))) and not one(spark, X.tolerant_bool(lit("no")))
    assert one(spark, X.number(lit(" 1.5 "))) == 1.5 and one(spark, X.number(lit("x"))) is None and one(spark, X.number(lit(""))) is None
    assert one(spark, X.label_of(lit("loitering"), lit("thick Smoke"))) == "smoke" and one(spark, X.label_of(lit("crowd_density"), lit(None).cast("string"))) is None
    assert one(spark, X.real_hazard(lit("N/A"))) is False and one(spark, X.real_hazard(lit("tree"), ("tree",))) is True
    assert one(spark, X.closed_choice(lit("Fire_or_smoke\nnothing"), ["fire", "smoke"])) == "smoke" and one(spark, X.closed_choice(lit("a stalled car\nfire"), ["stalled_or_broken_down_vehicle", "fire"])) == "stalled_or_broken_down_vehicle" and one(spark, X.closed_choice(lit("?\nroad spill"), ["road_spill"])) == "road_spill"
    v = one(spark, X.verdict(lit('ok {"anomalous": "true", "severity": 3, "reason": "r"} bye')))
    assert v.anomalous is True and v.severity == 1.0 and v.reason == "r" and one(spark, X.verdict(lit("broken {"))) is None
    f = one(spark, X.fused_verdict(lit(False), lit(0.2), lit(True), lit("smoke")))
    assert f.anomalous and f.severity == 0.9
    assert one(spark, X.where_phrase(lit(1.0), lit(2.0), lit(10.0))).startswith("early")
    assert one(spark, X.picked_phrase(lit("ab"), ["x", "y", "z"])) == ["x", "y", "z"][(97 + 98) % 3]
    assert one(spark, X.onset(lit(10.0), lit("loitering"), F.create_map(lit("stationary_s"), lit(4.0)))) == 6.0
    assert one(spark, X.angle_apart(lit(350), lit(10))) == 20 and one(spark, X.stride_for(lit(10.0), lit(4))) == 2
    assert one(spark, X.explanation(lit("short"))) is None and tuple(one(spark, X.thresholds_for(lit(5.0)))) == (1.75, 2.25, 2.0, 5.0, 2.5, 1.5) and tuple(one(spark, X.thresholds_for(lit(40.0)))) == (8.0, 10.0, 12.0, 60.0, 4.0, 6.0)
    long = "word " * 20 + "end. " + "tail" * 200
    assert one(spark, X.clean_description(lit(long), lit("f"))) == ("word " * 20 + "end.") and one(spark, X.clean_description(lit("x"), lit("f"))) == "f"


def test_flow_trust(spark):
    rows = spark.createDataFrame([(None, 0.9, 50), (1.0, None, None), (1.0, 0.5, 50), (1.0, 0.9, 39), (1.0, None, 50)], "f double, c double, n int")
    assert [r.v for r in rows.select(X.flow_trusted(F.col("f"), F.col("c"), F.col("n")).alias("v")).collect()] == [False, True, False, False, True]


def test_intervals(spark):
    e = spark.createDataFrame([("a", 0.0, 1.0), ("a", 3.0, 4.0), ("a", 9.0, 9.5), ("b", 0.0, 10.0), ("b", 2.0, 3.0), ("b", 11.0, 12.0)], "k string, s double, e double")
    got = sorted((r.k, r.start, r.end, r.n) for r in intervals.gap_merge(e, ["k"], "s", "e", 2.0).collect())
    assert got == [("a", 0.0, 4.0, 2), ("a", 9.0, 9.5, 1), ("b", 0.0, 12.0, 3)]
    assert intervals.gap_merge(e.filter("k = 'a'"), ["k"], "s", "e", 2.0, strict=True).count() == 3
    gaps = intervals.complement(e.filter("k = 'a'"), ["k"], "s", "e", F.lit(20.0), 0.5, 2.0)
    assert sorted((r.gap_start, r.gap_end) for r in gaps.collect()) == [(4.5, 8.5), (10.0, 20.0)]
    assert [round(r.t, 3) for r in intervals.spread_points(gaps, ["k"], 2).orderBy("k", "t").collect()] == [8.0, 16.5]
    r = one(spark, F.array(*intervals.clamped(F.lit(9.99), F.lit(12.0), F.lit(10.0))))
    assert r == [9.99, 9.95]
    assert one(spark, F.array(*intervals.padded(F.lit(1.0), F.lit(2.0), 0.0, 8.0, 100.0))) == [0.0, 5.5]
    times = spark.createDataFrame([("a", t) for t in (12, 0, 10, 5, None)] + [("b", 3)], "k string, t long")
    assert sorted((r.k, r.t) for r in intervals.cooldown(times, ["k"], "t", 10).collect()) == [("a", 0), ("a", 10), ("b", 3)]


def test_scores(spark):
    pairs = spark.createDataFrame([("v", 1, 1, 0.9), ("v", 1, 2, 0.8), ("v", 2, 1, 0.7), ("v", 2, 2, 0.1), ("w", 1, 1, 0.5), ("w", 1, 2, 0.5)], "k string, t_id int, p_id int, iou double")
    got = sorted((r.k, r.t_id, r.p_id) for r in score.greedy_match(pairs, "k").collect())
    assert got == [("v", 1, 1), ("v", 2, 2), ("w", 1, 2)]
    t = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("c", "z")], "k string, l string")
    p = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "k string, l string")
    each = {r.l: (r.tp, r.fp, r.fn, r.f1) for r in score.label_set_scores(t, p, "k", "l").collect()}
    assert each == {"x": (1, 0, 1, 0.667), "y": (0, 1, 1, 0.0), "z": (1, 0, 0, 1.0)}
    assert score.macro_f1(score.label_set_scores(t, p, "k", "l")).first().macro_f1 == 0.556
    assert one(spark, score.level_timed(F.lit(2), F.lit(3), F.lit(1), F.lit(0.5), 0.2, 0.5, 0.3)) == pytest.approx(0.6)


def test_decisions(spark):
    rows = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("a", "y", 3), ("a", "x", 4), ("b", "z", 1)], "k string, l string, o int")
    assert sorted((r.k, r.l, r.votes) for r in decide.vote(rows, ["k"], "l", "o").collect()) == [("a", "x", 2), ("b", "z", 1)]
    assert {(r.k, r.l) for r in decide.persistent(rows, ["k"], "l").collect()} == {("a", "x"), ("a", "y")}
    probs = decide.softmax(F.array(*map(F.lit, (0.0, 2.0, 2.0, -1.0))))
    assert one(spark, decide.argmax(probs)) == 1 and one(spark, F.transform(decide.ranked(probs), lambda x: x["c"])) == [2, 1, 0, 3]
    assert one(spark, decide.top_margin(probs, 0.1, 2, 0.2, 1.0)) == [2, 1] and one(spark, decide.top_margin(probs, 0.9, 2, 0.2, 1.0)) == []
    value = lambda ps: [-(p["a"] - 3) ** 2 - (p["b"] - 1) ** 2 for p in ps]
    assert search.ascend({"a": 0.0, "b": 0.0}, [0.0, 1.0, 2.0, 3.0], value)[0] == {"a": 3.0, "b": 1.0}
    folds = spark.createDataFrame([("v1", 0, 1), ("v1", 1, 0), ("v2", 0, 1), ("v2", 1, 0), ("v3", 0, 0), ("v3", 1, 5)], "v string, s int, g int")
    assert {r.v: r.s for r in search.held_out(folds, "v", "s", "g").collect()} == {"v1": 1, "v2": 1, "v3": 0}


def test_samples(spark):
    rows = spark.range(20).select(F.when(F.col("id") < 18, "big").otherwise("few").alias("g"), F.col("id"))
    n = {r.g: r["count"] for r in sample.balance(rows, ["g"], "id", 10).groupBy("g").count().collect()}
    assert n == {"big": 10, "few": 6}
    assert sample.split(rows, ["g"], "id", 0.2).filter("part = 'val'").count() == 4 and sample.cap(rows, ["g"], "id", 5).count() == 7


def test_assembly(spark):
    ids = spark.createDataFrame([("a",), ("b",)], "video_id string")
    ev = spark.createDataFrame([("a", "fire", 5.0, 6.0), ("a", "smoke", 1.0, 2.0)], "video_id string, class_name string, start double, end double")
    docs = {r.video_id: [e.class_name for e in r.events] for r in assemble.documents(ids, ev).collect()}
    assert docs == {"a": ["smoke", "fire"], "b": []}
    text = json.loads(assemble.to_json(assemble.documents(ids, ev), "m").filter("value like '%\"a\"%'").first().value)
    assert text["prediction"]["events"][0]["class_name"] == "smoke"
    base, extra = spark.createDataFrame([("a", 1, 2)], "k string, x int, y int"), spark.createDataFrame([("a", None, 9)], "k string, x int, y int")
    assert tuple(assemble.overlay(base, extra, "k").first()) == ("a", 1, 9)
    assert [r.k for r in assemble.unknown_ids(base, spark.createDataFrame([("q",)], "k string"), "k").collect()] == ["q"]
    same = spark.createDataFrame([("a", "fire", 1.0001, 2.0), ("a", "fire", 1.0, 2.0)], "id string, label string, start double, end double")
    assert assemble.first_of_same(same).count() == 1
    s = one(spark, assemble.explained(F.lit("One. "), F.lit("Two."), F.lit(None).cast("string"), F.lit("x" * 600), F.lit("")))
    assert s.startswith("One.") and len(s) <= 500


def test_files(spark, tmp_path):
    (tmp_path / "rows.csv").write_text("﻿video_id,is_anomaly,class_name,start_time_sec,end_time_sec\nT1,TRUE,fire,1,2\nT2,false,normal,,\n", encoding="utf-8")
    rows = readers.timed(readers.read_rows(spark, str(tmp_path / "rows.csv")))
    assert [(r.video_id, r.start, r.end) for r in rows.collect()] == [("T1", 1.0, 2.0), ("T2", None, None)]
    readers.write_rows(rows.withColumn("is_anomaly", X.tolerant_bool(F.col("is_anomaly"))), str(tmp_path / "out"))
    assert sorted(r.is_anomaly for r in readers.read_rows(spark, str(tmp_path / "out")).collect()) == ["false", "true"]
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="columns missing"):
        readers.read_rows(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "e.jsonl").write_text('{"a": 1}\n\n{"a": 2\n')
    assert [(r.a, r.stem) for r in readers.read_json_lines(spark, str(tmp_path / "e.jsonl"), "a int", tolerant=True).collect()] == [(1, "e")]
    with pytest.raises(Exception):
        readers.read_json_lines(spark, str(tmp_path / "e.jsonl"), "a int").collect()
    shapes = ['["T1", "T2"]', '[{"video_id": "T1", "level": 2}, {"id": "T2"}]', '{"videos": [{"name": "T1", "level": 3}]}', '{"T1": 1, "T2": {"level": 3}}']
    want = [{"T1": 1, "T2": 1}, {"T1": 2, "T2": 1}, {"T1": 3}, {"T1": 1, "T2": 3}]
    for k, (text, levels) in enumerate(zip(shapes, want, strict=True)):
        (tmp_path / f"m{k}.json").write_text(text)
        assert {r.video_id: r.level for r in readers.read_manifest(spark, str(tmp_path / f"m{k}.json")).collect()} == levels
    (tmp_path / "z.json").write_text('{"default_kind": "unknown", "zones": [{"name": "a", "kind": "shoulder", "polygon": [[0, 0], [1, 0], [1, 1]]}]}')
    assert readers.read_zones(spark, str(tmp_path / "z.json")).first().kind == "shoulder"
    videos = spark.createDataFrame([("v", 10.0, 5), ("w", 10.0, 0)], "video_id string, fps double, frame_count long")
    assert [r.frame_idx for r in readers.frame_indexes(videos, 2).collect()] == [0, 2, 4] and readers.frame_indexes(videos, 2, 1).count() == 1


def kinds(rows, video):
    return [(r.kind, r.t, r.track_id) for r in rows if r.video_id == video]


def test_tracker_scenarios(spark):
    rows = sorted(tracker.run(tracker.scenarios(spark), tracker.LANE).collect(), key=lambda r: (r.video_id, r.t, r.track_id or 0))
    assert kinds(rows, "stop")[0] == ("stopped_vehicle", 20.0, 1) and all(k[2] == 1 for k in kinds(rows, "stop"))
    assert kinds(rows, "wrong")[0][0] == "wrong_way_vehicle"
    jam = [r for r in rows if r.video_id == "jam" and r.kind == "traffic_congestion"]
    assert jam and jam[0].t == 12.0 and not [r for r in rows if r.video_id == "flow" and r.kind == "traffic_congestion"]
    assert [k[2] for k in kinds(rows, "twice") if k[0] == "stopped_vehicle"][0] == 1 and len({k[2] for k in kinds(rows, "twice")}) == 1
    assert kinds(rows, "gap") == [] and kinds(rows, "walk")[0][:2] == ("person_in_roadway", 2.0)


def test_collision_and_expiry():
    t = tracker.Tracker(tracker.LANE)
    seen = []
    for f in range(80):
        x = min(f, 25) * 12
        rows = [(1, "car", x, 100, x + 60, 140, 0.0, None, None), (2, "car", x + 70, 100, x + 130, 140, 0.0, None, None)] + [(k, "car", f * 12, 60 * k, f * 12 + 60, 60 * k + 40, 0.0, None, None) for k in (4, 5, 6, 7)]
        seen += t.update(f, f / 10, rows)
    assert [e["kind"] for e in seen] == ["collision_signature"] and math.isclose(seen[0]["severity"], 0.85)
    assert seen[0]["zone_kind"] == "driving_lane" and seen[0]["class_name"] == "vehicle" and seen[0]["features"]["vehicles_stopped_together"] == 2.0 and seen[0]["features"]["stopped_share"] < 0.6
    again, last, held = tracker.Tracker.load(t.dump(7.9, [(79, 7.9, 1, "car", 0.0, 0.0, 1.0, 1.0, 0.0, None, None)]), tracker.LANE, tracker.Config())
    assert again.tracks == t.tracks and again.recent == t.recent and again.cooled == t.cooled and last == 7.9 and held[0][2] == 1
    t.update(900, 90.0, [])
    assert not t.tracks


def test_stream_gives_what_batch_gives(spark, tmp_path):
    detections = tracker.scenarios(spark)
    for low, high in ((0, 131), (131, 215), (215, 999)):  # the frames at the borders come in two parts
        part = F.col("frame_idx") + F.when(F.col("track_id") % 2 == 0, 1).otherwise(0)
        detections.filter((part >= low) & (part < high)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(detections.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = tracker.run_stream(stream, tracker.LANE, idle_ms=None).writeStream.format("memory").queryName("tracked").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    key = lambda r: (r.video_id, r.t, r.kind, r.track_id, r.severity)
    want = {key(r) for r in tracker.run(detections, tracker.LANE).collect()}
    got = sorted(map(key, spark.sql("select * from tracked").collect()), key=repr)
    last = {r.video_id: r.t for r in detections.groupBy("video_id").agg(F.max("t").alias("t")).collect()}  # held back until the video is idle
    assert got == sorted((k for k in want if k[1] < last[k[0]]), key=repr) and len(got) > 10
