"""Operators of windows, policies, evidence, validation, traffic and training sets, worked out by hand."""

import json
import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from episodic.functions import expr as X
from episodic.operators import assemble, dataset, decide, evidence, intervals, marks, motion, policy, score, traffic, validate, windows
from episodic.sources import readers
from episodic.streaming import tracker


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_others_median(spark):
    rng = random.Random(2)
    rows = [(f"g{g}", i, rng.choice((None, *(float(x) for x in range(9)))), rng.random() < 0.7) for g in range(12) for i in range(g)]
    df = spark.createDataFrame(rows, "g string, i int, v double, p boolean")
    for peer in (None, F.col("p")):
        for r in intervals.others_median(df, ["g"], "v", "i", 2, peer).collect():
            others = [v for g, i, v, p in rows if g == r.g and i != r.i and v is not None and (peer is None or p)]
            assert r.others_median == (median(others) if len(others) >= 2 else None)


def test_overlap_cells(spark):
    rng = random.Random(3)
    make = lambda n: [(rng.choice("ab"), i, *sorted((rng.uniform(0, 100), rng.uniform(0, 100)))) for i in range(n)]
    t, p = make(40), make(40)
    frame = lambda rows: spark.createDataFrame(rows, "k string, id int, start double, end double")
    got = sorted((r.k, r.t_id, r.p_id) for r in score.overlaps(frame(t), frame(p), ["k"], 0.0, 7.0).collect())
    assert got == sorted((a[0], a[1], b[1]) for a in t for b in p if a[0] == b[0] and a[2] < b[3] and b[2] < a[3])
    box = lambda n: [(i, *(v for a in (sorted((rng.uniform(0, 300), rng.uniform(0, 300))) for _ in "xy") for v in a)) for i in range(n)]
    t, p = box(30), box(30)
    frame = lambda rows: spark.createDataFrame([("v", i, x1, y1, x2, y2) for i, x1, x2, y1, y2 in rows], "v string, id int, x1 double, y1 double, x2 double, y2 double")
    got = {(r.t_id, r.p_id) for r in traffic.box_overlaps(frame(t), frame(p), ["v"], "id", 1e-6, 40).collect()}
    assert got == {(a[0], b[0]) for a in t for b in p if min(a[2], b[2]) - max(a[1], b[1]) > 1e-3 and min(a[4], b[4]) - max(a[3], b[3]) > 1e-3}


def test_windows(spark):
    rows = [("v", float(t), p) for t, p in ((0, 0.2), (10, 0.95), (20, 0.9), (90, 0.97), (300, 0.1))] + [("w", 5.0, 0.04), ("w", 15.0, 0.05)]
    f = windows.with_spans(spark.createDataFrame(rows, "k string, t double, p double").withColumns({"dt": F.lit(10.0), "duration": F.lit(400.0), "label": F.lit("fire")}), "label")
    got = {(r.k, r.start, r.end) for r in windows.class_windows(f, ["k"], "t", "p", 0.9).collect()}
    assert got == {("v", 5.0, 25.0), ("v", 85.0, 95.0), ("w", 10.0, 20.0)}
    out = windows.submitted_windows(f, ["k"], "t", "p", 0.9, F.lit(True), 0.0, 5)
    assert {(r.k, r.start, r.end) for r in out.collect()} == {("v", 5.0, 25.0), ("v", 85.0, 205.0), ("w", 10.0, 130.0)}
    assert [r.end for r in windows.argmax_windows(f.filter("t = 90"), ["k"], "label", "t", "p", 0.5).collect()] == [91.0]
    assert windows.cap_windows(windows.class_windows(f, ["k"], "t", "p", 0.9), ["k"], 0.97, 1).count() == 2


def test_timeline(spark):
    rows = spark.createDataFrame([("a", 1, "fire", None, None), ("b", 2, "fire", None, None), ("c", 3, "fire", 1.0, 2.0), ("d", 2, "normal", None, None), ("e", 2, "fire", None, None)], "v string, level int, label string, start double, end double")
    frames = spark.createDataFrame([(v, label, float(t), 100.0) for v in "abcd" for t, label in ((0, "smoke"), (10, "smoke"), (20, "normal"))], "v string, label string, t double, duration double")
    fill = {(r.v, r.label, r.start, r.end) for r in windows.fill_timeline(rows, frames, "v", "label").collect()}
    assert fill == {("a", "fire", None, None), ("b", "smoke", 0.0, 15.0), ("c", "fire", 1.0, 2.0), ("d", "smoke", 0.0, 15.0), ("e", "fire", None, None)}
    assert ("c", "smoke", 0.0, 15.0) in {(r.v, r.label, r.start, r.end) for r in windows.fill_timeline(rows, frames, "v", "label", replace=True).collect()}


def test_marks(spark):
    kind = "v string, c string, id int, start double, end double"
    t = spark.createDataFrame([("a", "x", 1, 0.0, 10.0), ("a", "x", 2, 20.0, 30.0), ("b", "x", 1, 0.0, 5.0)], kind)
    p = spark.createDataFrame([("a", "x", 1, 0.0, 10.0), ("a", "x", 2, 1.0, 10.0), ("a", "y", 3, 20.0, 30.0), ("a", "x", 4, None, None), ("c", "x", 1, 0.0, 1.0)], kind)
    videos = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "v string")
    n = marks.timed_counts(videos, t, p, "v", ["v", "c"])
    got = {r.v: (r.matched, r.false_alarms, round(r.s, 4)) for r in n.withColumn("s", marks.timed_score(2)).collect()}
    assert got == {"a": (1, 3, 0.2 + 0.25 + 0.3), "b": (0, 0, 0.0), "c": (0, 1, 0.0), "d": (0, 0, 1.0)}
    sheet = marks.sheet(n.select(F.lit(2).alias("level"), marks.timed_score(2).alias("score")))
    assert sheet.first().marks == pytest.approx((0.75 + 1.0) / 4 * 35)
    assert marks.stop(sheet, sheet.withColumn("marks", F.col("marks") - 1)).first().stop is True


def test_policies(spark):
    assert one(spark, policy.adjudicated(F.lit(None).cast("string"), F.lit("fire"))) == "fire"
    assert one(spark, F.transform(decide.ranked(decide.softmax(F.array(F.lit(0.0), F.lit(9.0)))), lambda x: x["c"])) == [1, 0]
    assert one(spark, decide.slate(decide.softmax(F.array(*map(F.lit, (0.0, 9.0, 8.0)))))) == [1, 2, 0]
    assert one(spark, policy.log_line(F.lit(3.25), F.lit(True), F.lit(None).cast("long"), F.lit("car"), F.lit("stopped"), F.lit(0.5), F.lit("why"))).startswith("[   3.3s] ANOMALY track   - car")
    videos = spark.createDataFrame([("a", 5.0), ("b", 20.0), ("c", 20.0)], "v string, duration double")
    own = spark.createDataFrame([("a", "fire"), ("b", "smoke")], "v string, label string")
    rules = spark.createDataFrame([("a", "stalled_or_broken_down_vehicle"), ("b", "stalled_or_broken_down_vehicle"), ("b", "loitering"), ("c", "loitering")], "v string, label string")
    labels = lambda mode: {(r.v, r.label) for r in policy.sourced_labels(videos, own, rules, "v", mode).collect()}
    assert labels("appearance") == {("a", "fire"), ("b", "smoke"), ("c", "normal")}
    assert labels("hybrid") == {("a", "fire"), ("b", "smoke"), ("b", "stalled_or_broken_down_vehicle"), ("c", "normal")}
    assert ("c", "loitering") in labels("rules") and ("a", "stalled_or_broken_down_vehicle") not in labels("rules")
    e = spark.createDataFrame([("v", 1, True, 0.4, None), ("v", 2, False, 0.1, (True, 0.7))], "v string, t int, rule_anomalous boolean, rule_severity double, observation struct<anomalous:boolean,severity:double>")
    got = {r.t: (r.route, r.verdict and tuple(r.verdict)) for r in policy.decided(e, "vlm", ["v"], ["t"]).collect()}
    assert got == {1: ("failed, rule", (True, 0.4)), 2: ("vlm", (True, 0.7))}
    assert policy.decided(e, "harvest", ["v"], ["t"]).filter("verdict is null").count() == 2 and policy.anomalous_only(policy.decided(e, "rules", ["v"], ["t"])).count() == 1


def test_evidence(spark):
    note = evidence.tracker_note(F.lit("big_truck"), F.lit("shoulder"), F.lit(7.6), F.lit(0.01), F.lit(0), F.lit(4))
    assert one(spark, note) == "The big truck is in the hard shoulder and remains there for 8 seconds without moving while the other 4 vehicles keep moving"
    assert one(spark, evidence.conflicts(F.lit("fire"), F.lit("Flames after a crash"))) is False and one(spark, evidence.conflicts(F.lit("smoke"), F.lit("A crash"))) is True
    long = "A grey lorry burns at the side of the road and the wind carries the flames to the trees."
    assert one(spark, evidence.vetted(F.lit("fire"), F.lit(long))) == long and one(spark, evidence.vetted(F.lit("fire"), F.lit(long), ("grey lorry",))) is None


def test_documents(spark, tmp_path):
    pred = spark.createDataFrame([("a", 1), ("b", 2)], "video_id string, level int")
    size = validate.write_document(pred, str(tmp_path / "s.json"), {"model_name": "m"})
    assert json.loads((tmp_path / "s.json").read_text())["predictions"][1]["video_id"] == "b" and size == len((tmp_path / "s.json").read_text())
    errors = spark.createDataFrame([("a", "absent")], "id string, rule string")
    with pytest.raises(ValueError, match="a: absent"):
        validate.write_document(pred, str(tmp_path / "t.json"), {}, errors)
    assert (tmp_path / "t.json").exists()
    with pytest.raises(ValueError, match="bytes"):
        validate.write_document(pred, str(tmp_path / "u.json"), {}, limit=10)
    docs = spark.createDataFrame([("a", [("fire", None, None, None)], [(10.0, 2, 5.0, [5.0, 5.0])])] * 2, "id string, events array<struct<label:string,start:double,end:double,explanation:string>>, runtimes array<struct<total_ms:double,calls:int,average_ms:double,call_times:array<double>>>")
    got = sorted((r.id, r.rule) for r in validate.breaches(docs, pred.selectExpr("video_id id", "level")).collect())
    assert got == [("a", "appears more than once"), ("b", "absent")]
    missing = assemble.unknown_ids(pred, spark.createDataFrame([("z",)], "video_id string"), "video_id")
    assert missing.count() == 1


def test_training_sets(spark, tmp_path):
    v = spark.createDataFrame([("a", "fire", 5.0, 10.0, 100.0), ("b", "fire", 1.0, 2.0, 3.5), ("c", "normal", None, None, 20.0), ("d", "fire", 0.0, 95.0, 100.0)], "video_id string, class_name string, start double, end double, duration double")
    got = {}
    for r in dataset.inside_outside(v, 3, 2).collect():
        got.setdefault((r.video_id, r.label, r.part), []).append(r.t)
    assert got == {("a", "fire", "inside"): [5.0, 7.5, 10.0], ("a", "normal", "outside"): [0.0, 5.0], ("b", "fire", "inside"): [1.0, 1.5, 2.0], ("c", "normal", "whole"): [0.0, 10.0, 20.0], ("d", "fire", "whole"): [0.0, 50.0, 100.0]}
    frames = spark.createDataFrame([("/x/cam__s1__3.jpg",), ("/x/cam__s2__4.jpg",), ("/x/odd.jpg",)], "file string")
    labels = spark.createDataFrame([("s1", "fire"), ("s9", "smoke")], "stem string, label string")
    assert [(r.folder, r.stem, r.k, r.label) for r in dataset.cached_frames(frames, labels).collect()] == [("cam", "s1", "3", "fire")] and [r.stem for r in dataset.uncached(frames, labels).collect()] == ["s9"]
    dataset.restage(v, {"video_id", "class_name"}, str(tmp_path / "staged"))
    assert spark.read.parquet(str(tmp_path / "staged")).filter("class_name = 'fire'").count() == 3
    with pytest.raises(ValueError, match="missing"):
        dataset.restage(v, {"video_file"}, str(tmp_path / "no"))
    tasks = dataset.label_tasks(spark.createDataFrame([("f1",), ("f2",)], "f string"), spark.createDataFrame([("f1", None), ("f2", "late")], "f string, error string"), "f", 5.0, 25.0)
    assert [(r.f, r.cost) for r in tasks.collect()] == [("f2", pytest.approx((1300 * 5 + 90 * 25) / 1e6))]
    few = dataset.frame_budget(v.withColumn("n", F.lit(1)), "class_name", 4, few=2, capped="fire", cap=2)
    assert sorted((r.class_name, r.n_frames) for r in few.collect()) == [("fire", 4), ("fire", 4), ("normal", 8)]


def test_traffic(spark):
    d = spark.createDataFrame([("cat",), ("dog",)], "class_name string")
    assert traffic.known_classes(d, traffic.TARGETS).count() == 2 and traffic.known_classes(d.union(spark.createDataFrame([("Car",)], "class_name string")), traffic.TARGETS).count() == 1
    runs = spark.createDataFrame([("v", 10, 25.0)], "video string, frames int, source_fps double")
    r = traffic.throughput(runs).first()
    assert (r.frames, r.stride, r.required_fps, r.warm_fps) == (10, 1, 25.0, None) and len(r) == 15
    assert traffic.whole_frame_zone(spark.createDataFrame([("v", 4, 3)], "video_id string, width int, height int")).first().polygon == [[0, 0], [4, 0], [4, 3], [0, 3]]
    t = F.col("id") / 10.0
    car = lambda k, x, y: spark.range(400).select(F.lit("cam").alias("v"), F.lit(k).alias("k"), t.alias("t"), F.lit("car").alias("class_name"), F.expr(x).alias("x1"), F.lit(y).alias("y1"), (F.expr(x) + 40).alias("x2"), F.lit(y + 24.0).alias("y2"))
    boxes = car(1, "2.0 * (id % 200)", 100.0).union(car(2, "300.0D", 300.0))
    zones = {r.name: r for r in traffic.calibrate_zones(traffic.heat(boxes, ["v"], "k", "t"), "v", 400, 480).collect()}
    assert zones["lane1"].kind == "driving_lane" and min(abs(zones["lane1"].flow_deg), 360 - zones["lane1"].flow_deg) < 5 and zones["lane1"].flow_consistency > 0.9
    assert zones["parking1"].kind == "parking" and all(290 <= p[0] <= 360 and 280 <= p[1] <= 350 for p in zones["parking1"].polygon)


def test_stabilised_points(spark):
    frames = spark.createDataFrame([("v", 0, [1.0, 0.0, 2.0, 0.0, 1.0, 3.0]), ("v", 1, [1.0, 0.0, 1.0, 0.0, 1.0, 0.0])], "v string, k long, m array<double>")
    points = spark.createDataFrame([("v", 0, 12.0, 13.0), ("v", 1, 13.0, 13.0), ("w", 0, 5.0, 6.0)], "v string, k long, x double, y double")
    got = sorted((r.v, r.k, r.rx, r.ry) for r in motion.stabilised(points, motion.cumulative_affine(frames, "v", "k", "m"), "v", "k", "x", "y").collect())
    assert got == [("v", 0, 10.0, 10.0), ("v", 1, 10.0, 10.0), ("w", 0, 5.0, 6.0)]


def test_more_sources(spark, tmp_path):
    for c in ("fire", "smoke"):
        (tmp_path / "train" / c).mkdir(parents=True)
        (tmp_path / "train" / c / "videos.csv").write_text(f"Video_ID,file_name\n{c}1,{c}_a.mp4\n")
    (tmp_path / "train/fire/ground_truth.csv").write_text("video_id,is_anomaly,class_name,start_time_sec,end_time_sec\nfire1,true,fire,1,2\nfire2,true,,x,3\n")
    (tmp_path / "train/smoke/ground_truth.csv").write_text("video_id,is_anomaly,class_name,start_time_sec,end_time_sec\nsmoke1,true,mist,4,5\n")
    rows = sorted((r.video_id, r.class_folder, r.class_name, r.file, r.start) for r in readers.read_class_truth(spark, str(tmp_path / "train")).collect())
    assert rows == [("fire1", "fire", "fire", "fire_a.mp4", 1.0), ("fire2", "fire", "fire", None, None), ("smoke1", "smoke", "mist", "smoke_a.mp4", 4.0)]
    assert [tuple(r) for r in readers.read_intervals(spark, str(tmp_path / "train"), ("fire", "smoke")).collect()] == [("fire1", "fire", 1.0, 2.0)]
    (tmp_path / "gt.csv").write_text("video_id,level,is_anomaly,class_name,start_time_sec,end_time_sec\na,1,true,fire,,\na,2,true,smoke,3,4\n")
    truth = readers.read_truth(spark, str(tmp_path / "gt.csv")).first()
    assert truth.level == 2 and [(x.class_name, x.start) for x in truth.rows] == [("fire", None), ("smoke", 3.0)]
    assert [x.class_name for x in readers.read_predictions(spark, str(tmp_path / "gt.csv")).first().rows] == ["fire", "smoke"]
    (tmp_path / "boxes").mkdir()
    (tmp_path / "boxes/img1.txt").write_text("10,20,30,40,1,4,0,0\n1,2,0,5,1,4,0,0\n1 2 3 4 1 1\n1,2,3,4,1,99\nshort\n")
    assert sorted((r.stem, r.group, r.x1, r.x2, r.y2) for r in readers.read_boxes(spark, str(tmp_path / "boxes"), traffic.ANNOTATED).collect()) == [("img1", "person", 1.0, 4.0, 6.0), ("img1", "vehicle", 10.0, 40.0, 60.0)]
    (tmp_path / "media/seq").mkdir(parents=True)
    for name in ("a.mp4", "b.txt", "seq/1.jpg", "seq/2.jpg"):
        (tmp_path / "media" / name).write_text("x")
    files = readers.video_files(spark, str(tmp_path / "media"))
    assert sorted((r.video_id, r.frame_count) for r in files.collect()) == [("a", None), ("seq", 2)]
    found = readers.discover(files, spark.createDataFrame([("a",), ("lost",)], "video_id string"))
    assert sorted((r.video_id, r.found) for r in found.collect()) == [("a", True), ("lost", False), ("seq", True)]
    assert sorted(r.duration for r in readers.probed(spark.createDataFrame([(50, 25.0), (50, None)], "frame_count int, fps double")).collect()) == [2.0, 2.0]
    zones = spark.createDataFrame([("cam", 1, "b", "parking", [[0, 0]]), ("cam", 0, "a", "driving_lane", [[1, 1]])], "video_id string, ordinal int, name string, kind string, polygon array<array<int>>")
    readers.write_zones(zones, str(tmp_path / "zones"), "auto")
    assert [z.name for z in spark.read.json(str(tmp_path / "zones")).first().zones] == ["a", "b"]
    (tmp_path / "s.json").write_text('[{"video": "v", "frames": 3, "wall_ms": 1.5, "model_runtimes": [{"model_name": "m", "call_count": 2}]}]')
    (tmp_path / "o.json").write_text('{"video": "v", "wall_ms": 9.0}')
    r = readers.read_summaries(spark, str(tmp_path / "s.json"), str(tmp_path / "o.json")).first()
    assert (r.frames, r.wall_ms, r.model_runtimes[0].call_count) == (3, 9.0, 2)
    labels = readers.frame_labels(spark.createDataFrame([("v", 1.0, ("fire", "d")), ("v", 2.0, ("odd", None)), ("v", 3.0, None)], "video_id string, t_sec double, parsed struct<class_name:string,description_summary:string>"), ("fire",))
    assert [(r.label, r.text) for r in labels.orderBy("t_sec").collect()] == [("fire", "d"), (None, ""), (None, "")]


def test_guards(spark):
    assert one(spark, X.checked_label(F.lit("fire"))) == "fire"
    with pytest.raises(Exception, match="unknown label: ufo"):
        one(spark, X.checked_label(F.lit("ufo")))
    good = one(spark, X.strict_verdict(F.lit('{"anomalous": true, "severity": 0.5, "reason": "r"}')))
    assert tuple(good) == (True, 0.5, "r")
    for bad in ('{"anomalous": "true", "severity": 0.5, "reason": "r"}', '{"anomalous": true, "severity": 2, "reason": "r"}', '{"anomalous": true, "severity": 1}', 'x {"anomalous": true, "severity": 1, "reason": "r"}', "{"):
        assert one(spark, X.strict_verdict(F.lit(bad))) is None, bad
    a, b = spark.createDataFrame([("x", 1)], "k string, v int"), spark.createDataFrame([("x", 2), ("y", 3)], "k string, v int")
    assert [r.v for r in assemble.patch(a, b, "k", a).collect()] == [2]
    with pytest.raises(ValueError, match="y"):
        assemble.patch(b, a, "k", b)
    t = spark.createDataFrame([("i", 1, True), ("i", 2, False)], "k string, o int, verdict boolean")
    assert [(r.student, r.teacher) for r in score.paired(spark.createDataFrame([("i", True), ("j", None)], "k string, verdict boolean"), t, "k", "o").collect()] == [(True, False)]
    assert one(spark, dataset.sample_times(F.lit(200.0), 3, True)) == [4.0, 97.0, 190.0] and one(spark, dataset.sample_times(F.lit(20.0), 2)) == [1.0, 19.0]


def test_scenarios_hold_their_truth(spark):
    truth = {(r.video_id, r.kind) for r in tracker.scenarios_truth(spark).collect()}
    found = {(r.video_id, r.kind) for r in tracker.run(tracker.scenarios(spark), tracker.LANE).collect() if r.anomalous}
    assert truth <= found and {v for v, _ in found} == {v for v, _ in truth}
