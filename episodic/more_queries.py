"""Queries over windows, marks, sources of labels, evidence, validation and training sets, with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import expr as X
from .operators import assemble, dataset, decide, evidence, intervals, marks, motion, policy, sample, score, search, traffic, validate, windows
from .plans import carriers as C
from .queries import _S, DAY, q41_level_scores, query
from .sources import readers

_T0 = "(SELECT min(t_us) FROM ev)"
_HOURS = f"(t_us - {_T0})/3600000000.0"


def _hours(s, d):
    """Events with t, hours since the first event of the table, and p in 0..0.99."""
    e = C.events(s, d)
    first = e.agg(F.min("t_us").alias("_t0"))
    e = e.crossJoin(F.broadcast(first))  # one row on the right
    return e.withColumns({"t": (F.col("t_us") - F.col("_t0")) / float(C.HOUR), "p": (F.col("event_id") * 37 % 100) / F.lit(100.0)}).drop("_t0")


def _pick(values, key, n=None):
    return F.get(F.array(*map(F.lit, values)), (F.col(key) % (n or len(values))).cast("int"))


def _sql_list(values):
    return "[" + ",".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


@query(f"""WITH {C.EV}, f AS (SELECT user_id, event_type, event_id, {_HOURS} AS t, (event_id*37 % 100)/100.0 AS p FROM ev WHERE event_type IN ('click','error')),
m AS (SELECT *, max(p) OVER k AS mp, row_number() OVER (PARTITION BY user_id, event_type ORDER BY p DESC, t) AS fr FROM f WINDOW k AS (PARTITION BY user_id, event_type)),
h AS (SELECT * FROM m WHERE CASE WHEN mp >= 0.9 THEN p >= 0.9 WHEN mp >= greatest(0.08, mp*0.5) THEN p >= greatest(0.08, mp*0.5) ELSE fr = 1 END),
b AS (SELECT *, CASE WHEN t - lag(t) OVER o > 6.0*1.8 OR lag(t) OVER o IS NULL THEN 1 ELSE 0 END AS brk FROM h WINDOW o AS (PARTITION BY user_id, event_type ORDER BY t)),
i AS (SELECT *, sum(brk) OVER (PARTITION BY user_id, event_type ORDER BY t ROWS UNBOUNDED PRECEDING) AS isl FROM b),
w AS (SELECT user_id, event_type, isl, avg(p) AS conf, min(t)-3.0 AS s, max(t)+3.0 AS e FROM i GROUP BY 1,2,3), w2 AS (SELECT *, (s+e)/2 AS mid, least(greatest(e-s,4.0),0.2*720.0) AS span FROM w),
w3 AS (SELECT user_id, event_type, conf, greatest(0, mid-span/2) AS s, mid+span/2 AS e FROM w2), r AS (SELECT *, max(e) OVER (PARTITION BY user_id, event_type ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM w3),
r2 AS (SELECT *, sum(CASE WHEN reach IS NULL OR s - reach >= 2.0*6.0*1.8 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_type ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isl FROM r),
g AS (SELECT user_id, event_type, isl, min(s) AS s, max(e) AS e, max(conf) AS conf FROM r2 GROUP BY 1,2,3), c AS (SELECT *, max(conf) OVER (PARTITION BY user_id, event_type) AS best, row_number() OVER (PARTITION BY user_id, event_type ORDER BY conf DESC, s) AS k FROM g),
l AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY s DESC, e DESC) AS last, least(719.95, greatest(e, s+0.3*720.0)) AS till FROM c WHERE conf >= 0.5*best AND k <= 3),
z AS (SELECT user_id, event_type, s, CASE WHEN last=1 AND event_type='click' AND till > e+1.0 THEN till ELSE e END AS e FROM l)
SELECT user_id, event_type, floor(greatest(0,s)*10000+0.5)/10000 AS start_h, floor(CASE WHEN least(e,719.95) <= greatest(0,s) THEN least(719.95, greatest(0,s)+4) ELSE least(e,719.95) END*10000+0.5)/10000 AS end_h FROM z""")
def q43_window_chain(s, d):
    f = _hours(s, d).filter("event_type in ('click', 'error')").withColumns({"dt": F.lit(6.0), "duration": F.lit(720.0)})
    f = windows.with_spans(f, "event_type", {}, (4.0, 1.8, 0.20))
    out = windows.submitted_windows(f, ["user_id", "event_type"], "t", "p", 0.9, F.col("event_type") == "click", 0.5, 3)
    return out.select("user_id", "event_type", X.floored(F.col("start"), 4).alias("start_h"), X.floored(F.col("end"), 4).alias("end_h"))


@query(f"""WITH {C.EV}, f AS (SELECT user_id, event_id, {_HOURS} AS t, CASE WHEN event_type='view' THEN 'normal' ELSE event_type END AS label FROM ev),
rw AS (SELECT user_id, 1 + user_id % 3 AS level, max(event_type) AS label, CASE WHEN user_id % 4 = 0 THEN 1.0 END AS s, CASE WHEN user_id % 4 = 0 THEN 2.0 END AS e FROM ev GROUP BY 1),
q AS (SELECT *, CASE WHEN count(*) OVER u > 1 THEN (max(t) OVER u - min(t) OVER u)/greatest(count(*) OVER u - 1, 1) ELSE 5.0 END AS dt FROM f WINDOW u AS (PARTITION BY user_id)),
k AS (SELECT user_id, label, count(*) AS n FROM f GROUP BY 1,2), kk AS (SELECT *, n / CAST(sum(n) OVER (PARTITION BY user_id) AS DOUBLE) AS share FROM k), keep AS (SELECT user_id, label FROM kk WHERE n >= 2 AND share >= 0.1 AND label <> 'normal'),
b AS (SELECT q.*, CASE WHEN t - lag(t) OVER o > dt*1.8 OR lag(t) OVER o IS NULL THEN 1 ELSE 0 END AS brk FROM q JOIN keep USING (user_id, label) WINDOW o AS (PARTITION BY user_id, label ORDER BY t)),
i AS (SELECT *, sum(brk) OVER (PARTITION BY user_id, label ORDER BY t ROWS UNBOUNDED PRECEDING) AS isl FROM b), w AS (SELECT user_id, label, isl, any_value(dt) AS dt, min(t) - any_value(dt)/2 AS s, max(t) + any_value(dt)/2 AS e FROM i GROUP BY 1,2,3),
w2 AS (SELECT *, (s+e)/2 AS mid, least(greatest(e-s,4.0),0.2*720.0) AS span FROM w), w3 AS (SELECT user_id, label, greatest(0, mid-span/2) AS s, least(mid+span/2, 719.95) AS e FROM w2), made AS (SELECT * FROM w3 WHERE e > s),
due AS (SELECT user_id, level FROM rw WHERE level >= 2 AND s IS NULL AND user_id IN (SELECT user_id FROM made))
SELECT user_id, level, label, s AS start_h, e AS end_h FROM rw WHERE user_id NOT IN (SELECT user_id FROM due) UNION ALL SELECT user_id, level, label, floor(s*10000+0.5)/10000, floor(e*10000+0.5)/10000 FROM due JOIN made USING (user_id)""")
def q44_timeline_fill(s, d):
    f = _hours(s, d).withColumns({"label": F.when(F.col("event_type") == "view", "normal").otherwise(F.col("event_type")), "duration": F.lit(720.0)}).select("user_id", "label", "t", "duration")
    time = lambda v: F.when(F.col("user_id") % 4 == 0, F.lit(v))
    rows = C.events(s, d).groupBy("user_id").agg(F.max("event_type").alias("label")).select("user_id", (1 + F.col("user_id") % 3).alias("level"), "label", time(1.0).alias("start"), time(2.0).alias("end"))
    out = windows.fill_timeline(rows, f, "user_id", "label", spans={})
    return out.select("user_id", "level", "label", X.floored(F.col("start"), 4).alias("start_h"), X.floored(F.col("end"), 4).alias("end_h"))


_TWO = C.GREEDY.format(gate=0.1)
_THREE = _TWO.replace("pk", "qk").replace("mt", "nt").replace("done", "done2").replace("FROM ov", "FROM ov2")


@query(f"""WITH RECURSIVE {C.IVS}, {_TWO}, pr2 AS (SELECT * FROM pr WHERE user_id % 5 <> 0 UNION ALL SELECT user_id, island, s/3600000000.0, e/3600000000.0 FROM epi WHERE event_type='view' AND n > 1 AND user_id % 5 = 0),
ov2 AS (SELECT g.user_id, g.id AS t_id, p.id AS p_id, greatest(0, least(g.e,p.e)-greatest(g.s,p.s)) / nullif((g.e-g.s)+(p.e-p.s)-greatest(0, least(g.e,p.e)-greatest(g.s,p.s)),0) AS iou FROM gt g JOIN pr2 p USING (user_id)), {_THREE},
a AS (SELECT u.user_id, coalesce(len(done.ts),0) AS m1, (SELECT count(*) FROM pr WHERE pr.user_id=u.user_id) - coalesce(len(done.ts),0) AS f1, coalesce(len(done2.ts),0) AS m2, (SELECT count(*) FROM pr2 WHERE pr2.user_id=u.user_id) - coalesce(len(done2.ts),0) AS f2
FROM (SELECT DISTINCT user_id FROM ev WHERE user_id % 5 = 0) u LEFT JOIN done USING (user_id) LEFT JOIN done2 ON done2.user_id=u.user_id)
SELECT user_id, m1 AS matched_before, f1 AS false_alarms_before, m2 AS matched_after, f2 AS false_alarms_after, m2 < m1 OR f2 > f1 AS worse FROM a""")
def q45_patch_what_if(s, d):
    users, g, p = C.events(s, d).select("user_id").distinct(), C.intervals(s, d, "purchase"), C.intervals(s, d, "click")
    after = p.filter("user_id % 5 <> 0").unionByName(C.intervals(s, d, "view").filter("user_id % 5 = 0"))
    one, two = (marks.timed_counts(users, g, x, "user_id", ["user_id"], 0.1) for x in (p, after))
    return marks.what_if(one, two, users.filter("user_id % 5 = 0"), "user_id")


@query(f"""SELECT level, count(*) AS videos, floor(avg(score)*1000000+0.5)/1000000 AS fraction, floor(avg(score)*CASE level WHEN 1 THEN 25 WHEN 2 THEN 35 ELSE 40 END*10000+0.5)/10000 AS marks
FROM (SELECT 1 + user_id % 3 AS level, CASE user_id % 3 WHEN 0 THEN level1 WHEN 1 THEN level2 ELSE level3 END AS score FROM ({_S["q41_level_scores"]})) GROUP BY 1""")
def q46_marks_sheet(s, d):
    rows = q41_level_scores(s, d)
    k = F.col("user_id") % 3
    rows = rows.select((1 + k).cast("int").alias("level"), F.when(k == 0, F.col("level1")).when(k == 1, F.col("level2")).otherwise(F.col("level3")).alias("score"))
    return marks.sheet(rows).select(F.col("level").cast("long").alias("level"), "videos", X.floored(F.col("fraction"), 6).alias("fraction"), X.floored(F.col("marks"), 4).alias("marks"))


@query(f"""WITH {C.TRUE}, u AS (SELECT DISTINCT user_id FROM ev), a AS (SELECT u.user_id, coalesce((SELECT list(label) FROM tl WHERE tl.user_id=u.user_id), []) AS t, coalesce((SELECT list(label) FROM pl WHERE pl.user_id=u.user_id), []) AS p FROM u)
SELECT count(*) FILTER (len(t) > 0) AS anomalous, count(*) FILTER (len(list_intersect(t, p)) > 0) AS found, CAST(sum(len(p) - len(list_intersect(t, p))) AS BIGINT) AS false_alarms FROM a""")
def q47_label_tally(s, d):
    users = C.events(s, d).select("user_id").distinct()
    gather = lambda x, name: x.groupBy("user_id").agg(F.collect_set("label").alias(name))
    none = F.array().cast("array<string>")
    rows = users.join(gather(C.truth_labels(s, d), "truth"), "user_id", "left").join(gather(C.predicted_labels(s, d), "pred"), "user_id", "left")
    return marks.tally(rows.withColumns({c: F.coalesce(c, none) for c in ("truth", "pred")}))


@query(f"""WITH {C.TRUE}, j AS (SELECT coalesce(t.label,p.label) AS label, t.user_id AS t, p.user_id AS p FROM (SELECT * FROM tl WHERE label <> 'view') t FULL JOIN (SELECT * FROM pl WHERE label <> 'signup') p ON t.user_id=p.user_id AND t.label=p.label),
c AS (SELECT label, count(*) FILTER (t IS NOT NULL AND p IS NOT NULL) AS tp, count(*) FILTER (t IS NULL) AS fp, count(*) FILTER (p IS NULL) AS fn FROM j GROUP BY 1), q AS (SELECT *, tp/nullif(CAST(tp+fp AS DOUBLE),0) AS a, tp/nullif(CAST(tp+fn AS DOUBLE),0) AS b FROM c)
SELECT label, tp, fp, fn, tp+fn AS support, floor(a*1000+0.5)/1000 AS precision, floor(b*1000+0.5)/1000 AS recall, floor(coalesce(2*a*b/nullif(a+b,0),0)*1000+0.5)/1000 AS f1 FROM q""")
def q48_label_scores(s, d):
    return marks.label_scores(C.truth_labels(s, d).filter("label <> 'view'"), C.predicted_labels(s, d).filter("label <> 'signup'"), "user_id", "label")


@query(f"""WITH {C.PROBS}, m AS (SELECT vec_id % 40 AS clip, c, avg(p) AS p, count(*) AS frames FROM pb GROUP BY 1, 2), r AS (SELECT clip, c, floor(p*100000+0.5)/100000 AS p, frames FROM m),
b AS (SELECT clip, arg_max(c, (p, -c)) AS c, max(p) AS p, any_value(frames) AS frames FROM r GROUP BY 1) SELECT clip, CASE WHEN c <> 0 AND p >= 0.12 THEN c END AS label, p, frames FROM b""")
def q49_clip_means(s, d):
    f = C.clips(s, d).select((F.col("vec_id") % 40).alias("clip"), "probs")
    m = policy.clip_means(f, "clip", "probs").groupBy("clip").agg(F.sort_array(F.collect_list(F.struct(F.col("c"), F.col("p")))).alias("cp"), F.first("frames").alias("frames"))
    probs = F.transform("cp", lambda x: F.struct(x["p"].alias("p"), x["c"].alias("c")))
    return m.select("clip", decide.argmax(probs, 0.12).cast("long").alias("label"), F.array_max(F.transform(probs, lambda x: x["p"])).alias("p"), "frames")


@query(f"""WITH {C.PROBS}, m AS (SELECT vec_id % 40 AS clip, (vec_id % 40) % 10 AS truth, c, floor(sum(p)*1000000000+0.5)/1000000000 AS p FROM pb GROUP BY 1, 2, 3), b AS (SELECT clip, truth, arg_max(c, (p, -c)) AS best FROM m GROUP BY 1, 2),
e AS (SELECT truth, count(*) AS clips, count(*) FILTER (best = truth) AS "right" FROM b GROUP BY 1) SELECT *, (SELECT floor(avg("right"/CAST(clips AS DOUBLE))*1000000+0.5)/1000000 FROM e) AS macro_recall FROM e""")
def q50_clip_macro_recall(s, d):
    clip = F.col("vec_id") % 40
    return policy.clip_macro_recall(C.clips(s, d).select(clip.alias("clip"), (clip % 10).alias("truth"), "probs"), "clip", "truth", "probs")


_VOTE = f"""WITH {C.TRUE}, f AS (SELECT user_id, event_id, CASE WHEN event_type='view' THEN 'normal' WHEN event_type='error' THEN NULL ELSE event_type END AS label FROM ev),
n AS (SELECT user_id, label, count(*) AS n, min(event_id) AS seen FROM f WHERE label IS NOT NULL AND label <> 'normal' GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, seen) AS r FROM n)"""


def _vote_frames(s, d):
    label = F.when(F.col("event_type") == "view", "normal").when(F.col("event_type") != "error", F.col("event_type"))
    return C.events(s, d).select("user_id", "event_id", label.alias("label"))


@query(f"""{_VOTE}, g(multi, least) AS (VALUES {",".join(f"({str(m).lower()},{k})" for m, k in product((False, True), policy.VOTE_FRAMES))}), t AS (SELECT user_id, label FROM tl WHERE label NOT IN ('view','error')), sup AS (SELECT label, count(*) AS support FROM t GROUP BY 1),
c AS (SELECT multi, least, user_id, label FROM r JOIN g ON n >= least AND (multi OR r.r = 1)), x AS (SELECT multi, least, c.label, count(*) AS sel, count(t.user_id) AS tp FROM c LEFT JOIN t ON t.user_id=c.user_id AND t.label=c.label GROUP BY 1, 2, 3),
y AS (SELECT g.multi, g.least, sup.label, floor(coalesce(2.0*tp/(sel+support),0)*1000+0.5)/1000 AS f1 FROM g CROSS JOIN sup LEFT JOIN x ON x.multi=g.multi AND x.least=g.least AND x.label=sup.label) SELECT multi, least, floor(avg(f1)*1000+0.5)/1000 AS macro_f1 FROM y GROUP BY 1, 2""")
def q51_vote_sweep(s, d):
    return policy.vote_sweep(_vote_frames(s, d), C.truth_labels(s, d).filter("label not in ('view', 'error')"), "user_id", "label", "event_id")


@query(f"""{_VOTE}, m AS (SELECT user_id, label FROM r WHERE n >= 3), u AS (SELECT DISTINCT user_id FROM ev), h AS (SELECT user_id, string_agg(event_type || ':' || n, ',' ORDER BY event_type) AS votes FROM (SELECT user_id, event_type, count(*) AS n FROM ev GROUP BY 1, 2) GROUP BY 1)
SELECT user_id, coalesce(string_agg(m.label, ',' ORDER BY m.label), 'normal') AS labels, any_value(votes) AS votes FROM u LEFT JOIN m USING (user_id) LEFT JOIN h USING (user_id) GROUP BY 1""")
def q52_multi_label_votes(s, d):
    from .operators.assemble import complete

    users = C.events(s, d).select("user_id").distinct()
    rows = complete(users, policy.votes(_vote_frames(s, d), "user_id", "label", 3, "event_id", True), "user_id")
    h = policy.vote_histogram(C.events(s, d), "user_id", "event_type")
    listed = F.array_join(F.transform(F.map_entries("votes"), lambda x: F.concat_ws(":", x["key"], x["value"].cast("string"))), ",")
    return rows.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list("label")), ",").alias("labels")).join(h.select("user_id", listed.alias("votes")), "user_id")


_GATES = ",".join(f"({p},{m})" for p, m in product(policy.GATE_P, policy.GATE_MARGIN))


@query(f"""WITH {C.PROBS}, o AS (SELECT vec_id, truth, c, p, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, c DESC) AS r FROM pb), t AS (SELECT vec_id, any_value(truth) AS truth, max(c) FILTER (r=1) AS top1, CASE WHEN vec_id % 17 <> 0 THEN 2*max(p) FILTER (r=1) END AS p1, 4*(max(p) FILTER (r=1) - max(p) FILTER (r=2)) AS margin FROM o GROUP BY 1),
tr AS (SELECT *, vec_id % 4 <> 0 AS called, CASE WHEN vec_id % 3 = 0 THEN CAST(truth AS BIGINT) WHEN vec_id % 3 = 2 THEN 0 END AS picked, top1 AS label FROM t), g(lp, lm) AS (VALUES {_GATES}),
gx AS (SELECT lp, lm, vec_id, NOT (p1 >= lp AND margin >= lm) AS op, CASE WHEN p1 IS NULL THEN label WHEN NOT (p1 >= lp AND margin >= lm) AND called AND picked IS NOT NULL THEN picked ELSE top1 END AS label FROM tr CROSS JOIN g),
tt AS (SELECT vec_id, label FROM embeddings WHERE label <> 0), sup AS (SELECT label, count(*) AS support FROM tt GROUP BY 1), n AS (SELECT lp, lm, gx.label, count(*) AS sel, count(tt.vec_id) AS tp FROM gx LEFT JOIN tt ON tt.vec_id=gx.vec_id AND tt.label=gx.label GROUP BY 1, 2, 3),
y AS (SELECT g.lp, g.lm, sup.label, floor(coalesce(2.0*tp/(sel+support),0)*1000+0.5)/1000 AS f1 FROM g CROSS JOIN sup LEFT JOIN n ON n.lp=g.lp AND n.lm=g.lm AND n.label=sup.label),
z AS (SELECT lp, lm, floor(avg(f1)*1000+0.5)/1000 AS macro_f1 FROM y GROUP BY 1, 2), k AS (SELECT lp, lm, count(*) FILTER (op) AS contested FROM gx GROUP BY 1, 2)
SELECT CAST(lp AS DOUBLE) AS least_p, CAST(lm AS DOUBLE) AS least_margin, contested, macro_f1 FROM z JOIN k USING (lp, lm) ORDER BY macro_f1 DESC, least_p DESC, least_margin DESC LIMIT 12""")
def q53_gate_replay_sweep(s, d):
    r = decide.ranked(F.col("probs"))
    top = lambda k: F.get(r, k)["p"]
    k = F.col("vec_id")
    t = C.clips(s, d).select("vec_id", F.get(r, 0)["c"].cast("long").alias("top1"), F.when(k % 17 != 0, 2 * top(0)).alias("p1"), (4 * (top(0) - top(1))).alias("margin"), (k % 4 != 0).alias("called"),
                             F.when(k % 3 == 0, F.col("truth").cast("long")).when(k % 3 == 2, F.lit(0).cast("long")).alias("picked"))
    truth = C.table(s, d, "embeddings").filter("label <> 0").select("vec_id", F.col("label").cast("long").alias("label"))
    out = policy.gate_sweep(t.withColumn("label", F.col("top1")), truth, "vec_id", "label", "-1")
    return policy.best_first(out, ["macro_f1", "least_p", "least_margin"], 12).select("least_p", "least_margin", "contested", "macro_f1")


@query(f"""WITH {C.TRUE}, u AS (SELECT DISTINCT user_id FROM ev), al AS (SELECT DISTINCT user_id FROM pl WHERE user_id % 20 < 8), r AS (SELECT user_id, label FROM pl UNION SELECT user_id, label FROM tl WHERE label = 'click' AND user_id NOT IN (SELECT user_id FROM al))
SELECT user_id, coalesce(label, 'normal') AS label FROM u LEFT JOIN r USING (user_id)""")
def q54_label_source_policy(s, d):
    videos = C.events(s, d).select("user_id").distinct().withColumn("duration", (F.col("user_id") % 20).cast("double"))
    return policy.sourced_labels(videos, C.predicted_labels(s, d), C.truth_labels(s, d), "user_id", "hybrid", ("click", "error"), ("error",))


_TRACKS = f"""WITH {C.OBS}, la AS (SELECT *, t_us // {DAY} AS day, row_number() OVER (PARTITION BY stream_id, t_us // {DAY}, track_id ORDER BY event_id DESC) AS r, count(*) OVER (PARTITION BY stream_id, t_us // {DAY}, track_id) AS seen FROM obs),
tr AS (SELECT stream_id, day, track_id, class_name, v, seen, CASE WHEN class_name='car' THEN 4.4 ELSE 0.6 END / greatest(w,h) AS mpp, v*(CASE WHEN class_name='car' THEN 4.4 ELSE 0.6 END / greatest(w,h))*3.6 AS kmh, v/100.0 AS ns FROM la WHERE r = 1)"""


def _tracks(s, d):
    o = C.observations(s, d).withColumn("day", F.expr(f"t_us div {DAY}"))
    w = W.partitionBy("stream_id", "day", "track_id")
    o = o.withColumns({"r": F.row_number().over(w.orderBy(F.desc("event_id"))), "seen": F.count("*").over(w)}).filter("r = 1")
    return o.select("stream_id", "day", "track_id", "class_name", "v", "seen", X.metres_per_pixel(F.col("class_name"), F.col("w"), F.col("h")).alias("m_per_px"), traffic.speed_kmh(F.col("v"), F.col("class_name"), F.col("w"), F.col("h")).alias("kmh"), (F.col("v") / 100.0).alias("norm_speed"))


@query(f"""{_TRACKS}, q AS (SELECT t.*, (SELECT median(o.kmh) FROM tr o WHERE o.stream_id=t.stream_id AND o.day=t.day AND o.track_id<>t.track_id AND o.class_name='car' AND o.kmh > 0 AND o.ns >= 0.05) AS med,
CASE WHEN count(*) OVER f >= 3 THEN max(mpp) OVER f / min(mpp) OVER f END AS ob FROM tr t WINDOW f AS (PARTITION BY stream_id, day))
SELECT stream_id, day, track_id, floor(kmh*1000000+0.5)/1000000 AS kmh, floor(ob*1000000+0.5)/1000000 AS obliquity, floor(med*1000000+0.5)/1000000 AS traffic_kmh, med IS NOT NULL AND coalesce(ob <= 2.5, false) AS reliable FROM q""")
def q55_traffic_speed(s, d):
    out = traffic.traffic_speeds(_tracks(s, d), ["stream_id", "day"], "track_id")
    return out.select("stream_id", "day", "track_id", *(X.floored(F.col(c), 6).alias(c) for c in ("kmh", "obliquity", "traffic_kmh")), "reliable")


_KINDS = ("collision_signature", "stopped_vehicle", "wrong_way_vehicle")


@query(f"""WITH {C.EPI}, w AS (SELECT user_id, island AS id, CASE WHEN user_id % 2 = 0 THEN 'traffic_accident' WHEN user_id % 5 = 0 THEN 'fire' ELSE 'wrong_way_driving' END AS label, CASE WHEN island % 3 <> 0 THEN (s - {_T0})/3600000000.0 END AS a, CASE WHEN island % 3 <> 0 THEN (e - {_T0})/3600000000.0 END AS b FROM epi WHERE event_type='purchase' AND n > 1),
x AS (SELECT user_id, event_id, {_HOURS} AS t, ({_sql_list(_KINDS)})[event_id % 3 + 1] AS kind, (event_id*7 % 10)/10.0 AS sev FROM ev WHERE event_type IN ('click','error')),
m AS (SELECT w.user_id, w.id, x.event_id, x.sev, count(*) OVER (PARTITION BY w.user_id, w.id) AS n, row_number() OVER (PARTITION BY w.user_id, w.id ORDER BY x.sev DESC, x.t, x.event_id) AS r FROM w JOIN x ON x.user_id=w.user_id AND (w.a IS NULL OR x.t BETWEEN w.a AND w.b) AND ((label='traffic_accident' AND kind IN ('collision_signature','stopped_vehicle')) OR (label='wrong_way_driving' AND kind='wrong_way_vehicle')))
SELECT w.user_id, w.id, w.label, coalesce(n, 0) AS events, m.event_id, m.sev AS severity, count(*) OVER (PARTITION BY w.user_id, w.label) AS recurs FROM w LEFT JOIN m ON m.user_id=w.user_id AND m.id=w.id AND m.r=1""")
def q56_evidence_join(s, d):
    h = _hours(s, d)
    first = C.events(s, d).agg(F.min("t_us").alias("t0"))
    e = C.episodes(s, d).filter("event_type = 'purchase' and n > 1").crossJoin(F.broadcast(first))  # one row on the right
    at = lambda c: F.when(F.col("island") % 3 != 0, (F.col(c) - F.col("t0")) / float(C.HOUR))
    u = F.col("user_id")
    w = e.select("user_id", F.col("island").alias("id"), F.when(u % 2 == 0, "traffic_accident").when(u % 5 == 0, "fire").otherwise("wrong_way_driving").alias("label"), at("start").alias("start"), at("end").alias("end"))
    x = h.filter("event_type in ('click', 'error')").select("user_id", "event_id", "t", _pick(_KINDS, "event_id").alias("kind"), ((F.col("event_id") * 7 % 10) / F.lit(10.0)).alias("severity"))
    return evidence.recurrence(evidence.strongest_event(w, x, "user_id", "label"), "user_id", "label").select("user_id", "id", "label", "events", "event_id", "severity", "recurs")


_CAPTIONS = ("A white car collides head-on with a dark van near the crossing while rain falls.", "Short note.", "A smoke plume is visible.", "Identified by the appearance classifier with high confidence over several frames here.",
             "Traffic in both lanes is orderly and drivers adhere to the lane discipline of the road.", "Flames rise from the engine of a lorry at the roadside and thick smoke drifts over the lanes.", "Two men brawl on the pavement and a third person tries to pull them apart at the kerb.")
_LABELS = ("traffic_accident", "fire", "smoke", "fighting_or_violence", "wrong_way_driving")


def _any(words, text="h"):
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


_OWN = " OR ".join(f"(label='{k}' AND {_any(v)})" for k, v in evidence.CLASS_WORDS.items())
_OTHER = " OR ".join(f"(label<>'{k}' AND {_any(v)})" for k, v in evidence.CLASS_WORDS.items())


@query(f"""WITH {C.EV}, c AS (SELECT event_id, ({_sql_list(_CAPTIONS)})[event_id % 7 + 1] AS t, ({_sql_list(_LABELS)})[event_id % 5 + 1] AS label FROM ev), h AS (SELECT *, lower(t) AS h FROM c)
SELECT event_id, (({_OTHER}) AND NOT ({_OWN})) AS conflict, CASE WHEN h NOT IN ({",".join("'" + x + "'" for x in evidence.STOCK)}) AND length(t) >= 60 AND NOT {_any(evidence.MACHINE)} AND NOT {_any(evidence.NORMALITY)} AND NOT (({_OTHER}) AND NOT ({_OWN})) THEN t END AS caption FROM h""")
def q57_caption_vetting(s, d):
    c = C.events(s, d).select("event_id", _pick(_CAPTIONS, "event_id").alias("t"), _pick(_LABELS, "event_id").alias("label"))
    return c.select("event_id", evidence.conflicts(F.col("label"), F.col("t")).alias("conflict"), evidence.vetted(F.col("label"), F.col("t")).alias("caption"))


@query("""WITH n AS (SELECT coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents), o AS (SELECT list_sort(list(n)) AS l FROM n)
SELECT count(*) AS texts, count(DISTINCT t) AS "distinct", min(n) AS shortest, (SELECT l[len(l)//2 + 1] FROM o) AS middle, max(n) AS longest, count(*) FILTER (n NOT BETWEEN 20 AND 500) AS outside FROM n""")
def q58_text_statistics(s, d):
    return evidence.text_statistics(C.table(s, d, "documents"), "text")


@query(f"""WITH {C.EPI}, dc AS (SELECT DISTINCT user_id AS id FROM ev), ids AS (SELECT id, 1 + id % 3 AS level FROM dc WHERE id % 17 <> 0 UNION ALL SELECT 100000 + id, 1 FROM dc WHERE id % 19 = 0),
e AS (SELECT user_id AS id, coalesce(level, 1) AS level, CASE WHEN island % 7 = 0 THEN 'normal' WHEN island % 11 = 0 THEN 'ufo' ELSE 'fire' END AS label, CASE WHEN island % 5 = 0 THEN NULL ELSE s//1000000 END AS s, CASE WHEN island % 5 = 0 THEN NULL ELSE e//1000000 END AS e, CASE WHEN island % 4 = 0 THEN 'short' END AS x FROM epi LEFT JOIN ids ON ids.id = user_id WHERE n > 1 AND user_id % 11 <> 0),
r AS (SELECT id, id % 4 AS calls, 12.0 AS total, CASE WHEN id % 5 = 0 THEN 12.0 ELSE 12.0 / nullif(id % 4, 0) END AS average, 2 AS times FROM dc WHERE id % 13 <> 0),
al AS (SELECT 'not in the manifest' AS rule, count(*) AS n FROM dc WHERE id % 17 = 0 UNION ALL SELECT 'events missing', count(*) FROM dc WHERE id % 11 = 0 UNION ALL SELECT 'runtime missing', count(*) FROM dc WHERE id % 13 = 0 UNION ALL SELECT 'normal as a class', count(*) FROM e WHERE label='normal' UNION ALL SELECT 'unknown class', count(*) FROM e WHERE label='ufo'
UNION ALL SELECT 'times at level 1', count(*) FROM e WHERE level=1 AND (s IS NOT NULL OR e IS NOT NULL) UNION ALL SELECT 'times missing', count(*) FROM e WHERE level>=2 AND s IS NULL UNION ALL SELECT 'times out of order', count(*) FROM e WHERE level>=2 AND s IS NOT NULL AND (s < 0 OR e <= s) UNION ALL SELECT 'explanation length', count(*) FROM e WHERE x IS NOT NULL
UNION ALL SELECT 'average is not total by calls', count(*) FROM r WHERE calls > 0 AND abs(total/calls - average) > 0.02*(total/calls) UNION ALL SELECT 'call times do not match calls', count(*) FROM r WHERE times <> calls UNION ALL SELECT 'absent', count(*) FROM ids WHERE id NOT IN (SELECT id FROM dc))
SELECT * FROM al WHERE n > 0""")
def q59_validator_rules(s, d):
    users = C.events(s, d).select(F.col("user_id").alias("id")).distinct()
    i, k = F.col("island"), F.col("id")
    time = lambda c: F.when(i % 5 != 0, F.expr(f"{c} div 1000000").cast("double"))
    e = C.episodes(s, d).filter("n > 1").select(F.col("user_id").alias("id"), F.struct(F.when(i % 7 == 0, "normal").when(i % 11 == 0, "ufo").otherwise("fire").alias("label"), time("start").alias("start"), time("end").alias("end"), F.when(i % 4 == 0, "short").alias("explanation")).alias("e"))
    docs = users.join(e.groupBy("id").agg(F.collect_list("e").alias("events")), "id", "left")
    kind = docs.schema["events"].dataType.simpleString()
    run = F.struct(F.lit(12.0).alias("total_ms"), (k % 4).alias("calls"), F.when(k % 5 == 0, 12.0).otherwise(F.try_divide(F.lit(12.0), (k % 4).cast("double"))).alias("average_ms"), F.array(F.lit(6.0), F.lit(6.0)).alias("call_times"))
    docs = docs.select("id", F.when(k % 11 != 0, F.coalesce("events", F.array().cast(kind))).alias("events"), F.when(k % 13 != 0, F.array(run)).alias("runtimes"))
    ids = users.filter("id % 17 <> 0").select("id", (1 + k % 3).alias("level")).unionByName(users.filter("id % 19 = 0").select((k + 100000).alias("id"), F.lit(1).cast("long").alias("level")))
    return validate.breaches(docs, ids).groupBy("rule").agg(F.count("*").alias("n"))


@query(f"""WITH {C.EPI}, u AS (SELECT DISTINCT user_id FROM ev), c AS (SELECT user_id, count(*) AS n, sum(n) AS wall FROM epi WHERE n > 3 GROUP BY 1)
SELECT CAST(coalesce(1 + user_id % 3, 0) AS BIGINT) AS level, count(*) AS videos, CAST(coalesce(sum(n),0) AS BIGINT) AS events, count(*) FILTER (n IS NULL) AS normal, CAST(coalesce(sum(wall),0) AS DOUBLE) AS wall_ms FROM u LEFT JOIN c USING (user_id) GROUP BY 1
UNION ALL SELECT 0, count(*), CAST(coalesce(sum(n),0) AS BIGINT), count(*) FILTER (n IS NULL), CAST(coalesce(sum(wall),0) AS DOUBLE) FROM u LEFT JOIN c USING (user_id)""")
def q60_run_rollup(s, d):
    e = C.episodes(s, d).filter("n > 3").groupBy("user_id").agg(F.collect_list("n").alias("events"), F.sum("n").cast("double").alias("wall_ms"))
    docs = C.events(s, d).select("user_id").distinct().join(e, "user_id", "left").select((1 + F.col("user_id") % 3).alias("level"), F.coalesce("events", F.array().cast("array<bigint>")).alias("events"), F.coalesce("wall_ms", F.lit(0.0)).alias("wall_ms"))
    return validate.rollup(docs)


@query(f"""WITH {C.EV}, r AS (SELECT user_id, count(*) % 3 AS calls, floor(sum(value)*10)/10 AS total FROM ev GROUP BY 1), v AS (SELECT *, floor(CASE WHEN calls <= 1 THEN total ELSE total/calls END*10+0.5)/10 AS v FROM r) SELECT user_id, v AS p50_ms, v AS p95_ms, v AS max_ms FROM v""")
def q61_runtime_defaults(s, d):
    r = C.events(s, d).groupBy("user_id").agg((F.count("*") % 3).alias("calls"), (F.floor(F.sum("value") * 10) / 10).alias("total_ms"))
    r = r.select("user_id", F.get(validate.filled_runtimes(F.array(F.struct("calls", "total_ms", F.lit(None).cast("double").alias("average_ms")))), 0).alias("x"))
    return r.select("user_id", "x.p50_ms", "x.p95_ms", "x.max_ms")


_LIN = "CASE WHEN {n} > 1 THEN {a} + ({b} - {a})*k/CAST({n}-1 AS DOUBLE) ELSE {a} END"


@query(f"""WITH {C.EPI}, v AS (SELECT user_id*1000 + island AS video_id, CASE WHEN island % 4 = 0 THEN 'normal' ELSE 'fire' END AS cn, (s - {_T0})/3600000000.0 AS a, (e - {_T0})/3600000000.0 AS b, CAST(CASE WHEN island % 6 = 5 THEN 5 ELSE 720 END AS DOUBLE) AS dur FROM epi WHERE event_type='purchase'),
t AS (SELECT *, b > a AND b - a < 0.85*dur AND cn <> 'normal' AS timed FROM v), p AS (SELECT video_id, cn AS label, 'inside' AS part, a, b, 5 AS n FROM t WHERE timed UNION ALL SELECT video_id, 'normal', 'outside', CASE WHEN a >= 3 THEN 0.0 ELSE b END, CASE WHEN a >= 3 THEN a ELSE dur END, 2 FROM t WHERE timed AND (a >= 3 OR dur - b >= 3)
UNION ALL SELECT video_id, cn, 'whole', 0.0, dur, CASE WHEN dur >= 8 THEN 5 ELSE 4 END FROM t WHERE NOT timed)
SELECT video_id, label, part, CAST(k AS BIGINT) AS k, floor(({_LIN.format(n="n", a="a", b="b")})*10000+0.5)/10000 AS t FROM (SELECT *, unnest(range(n)) AS k FROM p)""")
def q62_inside_outside(s, d):
    first = C.events(s, d).agg(F.min("t_us").alias("t0"))
    e = C.episodes(s, d).filter("event_type = 'purchase'").crossJoin(F.broadcast(first))  # one row on the right
    i = F.col("island")
    v = e.select((F.col("user_id") * 1000 + i).alias("video_id"), F.when(i % 4 == 0, "normal").otherwise("fire").alias("class_name"), ((F.col("start") - F.col("t0")) / float(C.HOUR)).alias("start"), ((F.col("end") - F.col("t0")) / float(C.HOUR)).alias("end"), F.when(i % 6 == 5, 5.0).otherwise(720.0).alias("duration"))
    return dataset.inside_outside(v).select("video_id", "label", "part", F.col("k").cast("long").alias("k"), X.floored(F.col("t"), 4).alias("t"))


@query(f"""WITH {C.EPI}, vd AS (SELECT DISTINCT user_id, 720.0 AS dur FROM ev), e AS (SELECT user_id, greatest(0,(s - {_T0})/3600000000.0) AS a, least(720.0,(e - {_T0})/3600000000.0) AS b FROM epi WHERE event_type='signup' AND n > 1),
ins AS (SELECT user_id, 'fire' AS label, 'event' AS source, a + (b-a)*k/5.0 AS t FROM (SELECT *, unnest(range(6)) AS k FROM e WHERE b > a)), r AS (SELECT user_id, a-1.5 AS s, b+1.5 AS e, max(b+1.5) OVER (PARTITION BY user_id ORDER BY a-1.5, b+1.5 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e),
g AS (SELECT user_id, greatest(0, coalesce(reach, 0)) AS a, least(s, 720.0) AS b FROM r UNION ALL SELECT user_id, greatest(0, max(e)), 720.0 FROM r GROUP BY 1), gg AS (SELECT *, sum(b-a) OVER (PARTITION BY user_id ORDER BY a) AS upto, sum(b-a) OVER (PARTITION BY user_id) AS total FROM g WHERE b - a > 2),
p AS (SELECT user_id, 'normal' AS label, 'gap' AS source, a + (k+0.5)/6*total - (upto-(b-a)) AS t FROM (SELECT *, unnest(range(6)) AS k FROM gg) WHERE (k+0.5)/6*total < upto AND (k+0.5)/6*total >= upto-(b-a)),
q AS (SELECT user_id, 'normal' AS label, 'normal' AS source, dur*0.05 + (dur*0.95-dur*0.05)*k/7.0 AS t FROM (SELECT *, unnest(range(8)) AS k FROM vd WHERE user_id NOT IN (SELECT user_id FROM e)))
SELECT user_id AS video_id, label, source, floor(t*1000+0.5)/1000 AS t FROM (SELECT * FROM ins UNION ALL SELECT * FROM p UNION ALL SELECT * FROM q)""")
def q63_moment_labels(s, d):
    first = C.events(s, d).agg(F.min("t_us").alias("t0"))
    e = C.episodes(s, d).filter("event_type = 'signup' and n > 1").crossJoin(F.broadcast(first))  # one row on the right
    e = e.select(F.col("user_id").alias("video_id"), F.lit("fire").alias("label"), ((F.col("start") - F.col("t0")) / float(C.HOUR)).alias("start"), ((F.col("end") - F.col("t0")) / float(C.HOUR)).alias("end"))
    videos = C.events(s, d).select(F.col("user_id").alias("video_id")).distinct().withColumn("duration", F.lit(720.0))
    return dataset.moments(videos, e).select("video_id", "label", "source", X.floored(F.col("t"), 3).alias("t"))


@query(f"""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('f' || doc_id), doc_id) AS r FROM documents), k AS (SELECT * FROM r WHERE source <> (SELECT min(source) FROM documents) OR r <= 20), c AS (SELECT *, count(*) OVER (PARTITION BY source) AS n FROM k),
p AS (SELECT doc_id, n_chars + 1 AS fc, CASE WHEN 1 + doc_id % 3 >= 2 THEN CAST(trunc(least(120, greatest(8, (n_chars+1)/25.0/5.0))) AS INTEGER) ELSE 8 END AS n FROM documents), x AS (SELECT doc_id, n, CAST(trunc({_LIN.format(n="n", a="0.0", b="CAST(fc-1 AS DOUBLE)")}) AS BIGINT) AS idx FROM (SELECT *, unnest(range(n)) AS k FROM p)),
a AS (SELECT doc_id, count(*) AS packed, CAST(sum(idx) AS BIGINT) AS idx_sum FROM x GROUP BY 1) SELECT doc_id, CASE WHEN c.n < 60 THEN 12 ELSE 6 END AS n_frames, packed, idx_sum FROM c JOIN a USING (doc_id)""")
def q64_frame_budget_and_pack(s, d):
    docs = C.table(s, d, "documents").select(F.col("doc_id").alias("video_id"), "source", "n_chars")
    least = docs.agg(F.min("source")).first()[0]
    b = dataset.frame_budget(docs, "source", 6, 60, least, 20)
    p = dataset.frame_pack(docs.select("video_id", (1 + F.col("video_id") % 3).alias("level"), (F.col("n_chars") + 1).alias("frame_count"), F.lit(25.0).alias("fps")))
    p = p.groupBy("video_id").agg(F.count("*").alias("packed"), F.sum("frame_idx").alias("idx_sum"))
    return b.join(p, "video_id").select(F.col("video_id").alias("doc_id"), "n_frames", "packed", "idx_sum")


@query("""SELECT vec_id, 2 AS messages, '{"is_anomaly":' || CASE WHEN label=0 THEN 'false' ELSE 'true' END || ',"class_name":"' || CASE WHEN label=0 THEN 'normal' ELSE 'c' || label END || '","description_summary":"seen ' || vec_id || '"}' AS target FROM embeddings""")
def q65_chat_rows(s, d):
    v = C.table(s, d, "embeddings").select(F.concat(F.lit("images/"), F.col("vec_id").cast("string")).alias("image"), F.col("vec_id").alias("video_id"), F.when(F.col("label") == 0, "normal").otherwise(F.concat(F.lit("c"), F.col("label").cast("string"))).alias("class_name"))
    out = dataset.chat_rows(v, F.concat(F.lit("seen "), F.col("video_id").cast("string")))
    return out.select(F.col("video_id").alias("vec_id"), F.size("messages").alias("messages"), F.get(F.get("messages", 1)["content"], 0)["text"].alias("target"))


@query(f"""WITH {C.EV}, f AS (SELECT user_id, event_id FROM ev WHERE event_id % 9 <> 0) SELECT 'cam' || (user_id % 5) AS folder, 'l' || (user_id % 7) AS label, count(*) AS frames, count(DISTINCT user_id) AS stems FROM f WHERE user_id % 2 = 0 GROUP BY 1, 2""")
def q66_frame_cache_join(s, d):
    e = C.events(s, d)
    name = F.concat(F.lit("/cache/cam"), (F.col("user_id") % 5).cast("string"), F.lit("__v"), F.col("user_id").cast("string"), F.when(F.col("event_id") % 9 == 0, "").otherwise(F.concat(F.lit("__"), F.col("event_id").cast("string"))), F.lit(".jpg"))
    labels = e.select("user_id").distinct().filter("user_id % 2 = 0").select(F.concat(F.lit("v"), F.col("user_id").cast("string")).alias("stem"), F.concat(F.lit("l"), (F.col("user_id") % 7).cast("string")).alias("label"))
    return dataset.cached_frames(e.select(name.alias("file")), labels).groupBy("folder", "label").agg(F.count("*").alias("frames"), F.count_distinct("stem").alias("stems"))


_HAZ = ("none", "dense smoke", "a crowd", "idle", "fire")


@query(f"""WITH {C.EV}, e AS (SELECT event_id, user_id, t_us, event_id % 2 = 0 AS ra, (event_id % 10)/10.0 AS rs, event_id % 7 <> 0 AS has, event_id % 3 = 0 AS vis, ({_sql_list(_HAZ)})[event_id % 5 + 1] AS hz, event_id % 6 AS busy FROM ev),
n AS (SELECT *, busy < 5 AS free, sum(CASE WHEN busy < 5 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t_us, event_id ROWS UNBOUNDED PRECEDING) AS nth FROM e), c AS (SELECT *, free AND nth <= 20 AS called, vis AND hz IN ('dense smoke','a crowd','fire') AS seen FROM n)
SELECT event_id, CASE WHEN NOT free THEN 'queue full' WHEN NOT called THEN 'budget spent' WHEN NOT has THEN 'failed, rule' ELSE 'hybrid' END AS route, CASE WHEN called THEN CASE WHEN has THEN seen OR ra ELSE ra END END AS anomalous,
CASE WHEN called THEN CASE WHEN has AND seen THEN greatest(0.9, rs) ELSE rs END END AS severity, coalesce(CASE WHEN called THEN CASE WHEN has THEN seen OR ra ELSE ra END END, false) AS survives FROM c""")
def q67_decision_modes(s, d):
    k = F.col("event_id")
    seen = F.when(k % 7 != 0, F.struct((k % 3 == 0).alias("hazard_visible"), _pick(_HAZ, "event_id").alias("hazard")))
    e = C.events(s, d).select("event_id", "user_id", "t_us", (k % 2 == 0).alias("rule_anomalous"), ((k % 10) / F.lit(10.0)).alias("rule_severity"), seen.alias("observation"), (k % 6).alias("busy"))
    out = policy.decided(e, "hybrid", ["user_id"], ["t_us", "event_id"], 20, 5)
    kept = policy.anomalous_only(out).select("event_id", F.lit(True).alias("survives"))
    return out.join(kept, "event_id", "left").select("event_id", "route", F.col("verdict.anomalous").alias("anomalous"), F.col("verdict.severity").alias("severity"), F.coalesce("survives", F.lit(False)).alias("survives"))


@query(f"""WITH {C.EV}, a AS (SELECT user_id, t_us, value FROM ev WHERE event_type='error'), f AS (SELECT event_id, user_id, t_us FROM ev WHERE event_type='view')
SELECT f.user_id, f.t_us/1000000.0 AS t, count(a.value) AS alerts, max(a.value) AS severity FROM f LEFT JOIN a ON a.user_id=f.user_id AND a.t_us BETWEEN f.t_us - 86400000000 AND f.t_us GROUP BY f.user_id, f.event_id, f.t_us""")
def q68_alert_hold(s, d):
    e = C.events(s, d).withColumn("t", F.col("t_us") / 1e6)
    return policy.alerts_shown(e.filter("event_type = 'view'"), e.filter("event_type = 'error'").withColumn("severity", F.col("value")), ["user_id"], 86400.0)


@query(f"""{_TRACKS}, a AS (SELECT *, row_number() OVER (PARTITION BY stream_id, day ORDER BY md5('n|' || stream_id || '|' || day || '|' || track_id), track_id) AS r FROM tr WHERE seen >= 2 AND ns >= 0.05 AND v <= 100) SELECT stream_id, day, track_id FROM a WHERE r <= 2""")
def q69_negative_sampling(s, d):
    t = _tracks(s, d).withColumns({"age_s": F.col("seen").cast("double"), "fired": F.col("v") > 100})
    return traffic.negative_samples(t, ["stream_id", "day"], "track_id", 2, 2.0).select("stream_id", "day", "track_id")


@query(f"""WITH {C.EV}, r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM ev), w AS (SELECT *, n <= 5 OR r > 5 AS warm FROM r)
SELECT event_type, max(value) FILTER (r=1) AS cold_ms, floor(avg(value) FILTER (warm)*10000+0.5)/10000 AS mean_ms, floor(quantile_cont(value, 0.95) FILTER (warm)*10000+0.5)/10000 AS p95_ms, floor(count(*) FILTER (warm)*1000.0/sum(value) FILTER (warm)*10000+0.5)/10000 AS warm_fps FROM w GROUP BY 1""")
def q70_latency_cold_warm(s, d):
    out = traffic.latency(C.events(s, d), ["event_type"], "event_id", "value")
    return out.select("event_type", "cold_ms", *(X.floored(F.col(c), 4).alias(c) for c in ("mean_ms", "p95_ms", "warm_fps")))


_CTX = ("A person walks in the driving lane", "deviation from lane", "car stationary for 30s", "car stationary for 90s, congested", "clear road")


@query(f"""WITH {C.EV}, c AS (SELECT event_id, lower(({_sql_list(_CTX)})[event_id % 5 + 1]) AS h FROM ev), x AS (SELECT *, CAST(nullif(regexp_extract(h, 'stationary for (\\d+)s', 1), '') AS INTEGER) AS secs FROM c)
SELECT event_id, CASE WHEN contains(h,'person') AND contains(h,'driving lane') THEN true WHEN contains(h,'wrong') OR contains(h,'deviation') THEN true WHEN secs IS NOT NULL THEN NOT contains(h,'congested') ELSE false END AS anomalous,
CAST(CASE WHEN contains(h,'person') AND contains(h,'driving lane') THEN 0.85 WHEN contains(h,'wrong') OR contains(h,'deviation') THEN 0.9 WHEN secs IS NOT NULL AND contains(h,'congested') THEN 0.2 WHEN secs IS NOT NULL THEN floor(least(1.0, 0.4+secs/120.0)*100+0.5)/100 ELSE 0.1 END AS DOUBLE) AS severity FROM x""")
def q71_mock_verdict(s, d):
    v = policy.mock_verdict(_pick(_CTX, "event_id"))
    return C.events(s, d).select("event_id", v.alias("v")).select("event_id", "v.anomalous", "v.severity")


@query(f"""WITH {C.EV} SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 2 END AS attempts, event_id % 3 <> 0 AS parse_failed_once, event_id % 3 = 0 OR event_id % 2 = 0 AS anomalous, CAST(CASE WHEN event_id % 3 = 0 THEN 0.5 WHEN event_id % 2 = 0 THEN 0.25 ELSE 0 END AS DOUBLE) AS severity FROM ev""")
def q72_two_attempts(s, d):
    k = F.col("event_id")
    first = F.when(k % 3 == 0, '{"anomalous": true, "severity": 0.5, "reason": "seen"}').when(k % 3 == 1, '{"anomalous": true, "severity": 0.5, "reason": " "}').otherwise("no idea")
    second = F.when(k % 2 == 0, 'x {"anomalous": true, "severity": 0.25, "reason": "again"}').otherwise("{")
    return C.events(s, d).select("event_id", policy.two_attempts(first, second).alias("x")).select("event_id", "x.attempts", "x.parse_failed_once", "x.verdict.anomalous", "x.verdict.severity")


@query(f"""WITH {C.EV}, r AS (SELECT user_id, event_id, value > 20 AS bad, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM ev), g AS (SELECT *, k - row_number() OVER (PARTITION BY user_id, bad ORDER BY event_id) AS run FROM r),
b AS (SELECT user_id, run, min(k) AS k0 FROM g WHERE bad GROUP BY 1, 2 HAVING count(*) >= 4), f AS (SELECT user_id, min(k0) AS k0 FROM b GROUP BY 1) SELECT r.user_id, r.event_id AS stop_step FROM r JOIN f ON f.user_id=r.user_id AND r.k = f.k0 + 3""")
def q73_loss_guard(s, d):
    loss = F.when(F.col("value") > 20, F.when(F.col("event_id") % 2 == 0, float("nan")).otherwise(float("inf"))).otherwise(F.col("value"))
    return dataset.stopped_at(C.events(s, d).select("user_id", "event_id", loss.alias("loss")), ["user_id"], "event_id", "loss", 4)


_BOXES = f"""WITH {C.OBS}, a AS (SELECT *, t_us // {DAY} AS day FROM obs), t AS (SELECT * FROM a WHERE event_type='signup'), p AS (SELECT * FROM a WHERE event_type='click' AND v > 20),
ov AS (SELECT t.event_id AS id, p.event_id AS pid, p.t_us AS pt, t.t_us AS tt, greatest(0,least(t.x+t.w,p.x+p.w)-greatest(t.x,p.x))*greatest(0,least(t.y+t.h,p.y+p.h)-greatest(t.y,p.y)) AS i, t.w*t.h+p.w*p.h AS areas FROM t JOIN p ON t.stream_id=p.stream_id AND t.day=p.day), io AS (SELECT *, i/CAST(areas-i AS DOUBLE) AS iou FROM ov)"""


def _boxes(s, d):
    o = C.observations(s, d).withColumn("day", F.expr(f"t_us div {DAY}"))
    o = o.select("stream_id", "day", F.col("event_id").alias("id"), F.col("t_us").alias("frame_idx"), F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2"), "event_type", "v")
    return o.filter("event_type = 'signup'"), o.filter("event_type = 'click' and v > 20")


@query(f"""{_BOXES}, h AS (SELECT id, count(*) AS hits, min(pt) AS ff, max(iou) AS best FROM io WHERE iou >= 0.1 AND pt >= tt GROUP BY 1), n AS (SELECT t.event_id AS id, count(p.event_id) FILTER (p.t_us < t.t_us) AS bf, count(p.event_id) AS al FROM t LEFT JOIN p ON t.stream_id=p.stream_id AND t.day=p.day GROUP BY 1)
SELECT t.event_id AS id, h.id IS NOT NULL AS detected, ff AS first_frame, ff - t.t_us AS late_frames, floor(coalesce(best,0)*1000000+0.5)/1000000 AS best_iou, coalesce(hits,0) AS hits, bf AS before, al - bf - coalesce(hits,0) AS elsewhere FROM t LEFT JOIN h ON h.id=t.event_id JOIN n ON n.id=t.event_id""")
def q74_detection_report(s, d):
    t, p = _boxes(s, d)
    out = traffic.detection_report(t.drop("event_type", "v"), p.drop("event_type", "v"), ["stream_id", "day"])
    return out.select("id", "detected", "first_frame", "late_frames", X.floored(F.col("best_iou"), 6).alias("best_iou"), "hits", "before", "elsewhere")


@query(f"""{_BOXES}, h AS (SELECT DISTINCT id FROM io WHERE iou >= 0.05) SELECT stream_id AS "group", count(*) AS boxes, count(h.id) AS found, count(*) FILTER (sqrt(w*w+h*h)/1166.0 < 0.04) AS tiny, count(h.id) FILTER (sqrt(w*w+t.h*t.h)/1166.0 < 0.04) AS tiny_found FROM t LEFT JOIN h ON h.id=t.event_id GROUP BY 1""".replace("w*w+h*h)/1166.0", "w*w+t.h*t.h)/1166.0"))
def q75_tiny_recall(s, d):
    t, p = _boxes(s, d)
    hits = traffic.box_overlaps(t, p, ["stream_id", "day"], "id", 0.05)
    return traffic.tiny_recall(t, hits, ["stream_id", "day"], "stream_id", 1166.0, 0.04).withColumnRenamed("stream_id", "group")


@query(f"""WITH {C.EV}, o AS (SELECT event_id, (['Car','cat','people','Van','tree'])[event_id % 5 + 1] AS cn, (event_id % 60)/1.0 AS diag, CASE WHEN event_id % 8 = 0 THEN 0.0 ELSE 1000.0 END AS fd FROM ev), k AS (SELECT * FROM o WHERE lower(cn) IN ('car','people','van'))
SELECT cn AS class_name, count(*) AS n, count(*) FILTER (lower(cn) IN ('car','van')) AS vehicles, count(*) FILTER (lower(cn)='people') AS people, count(*) FILTER (fd <= 1 OR diag/fd >= 0.02) AS judged FROM k GROUP BY 1""")
def q76_class_filter(s, d):
    k = F.col("event_id")
    o = C.events(s, d).select("event_id", _pick(("Car", "cat", "people", "Van", "tree"), "event_id").alias("class_name"), (k % 60).cast("double").alias("diag"), F.when(k % 8 == 0, 0.0).otherwise(1000.0).alias("frame_diag"))
    c = F.col("class_name")
    return traffic.known_classes(o, traffic.TARGETS).groupBy("class_name").agg(F.count("*").alias("n"), F.count_if(traffic.is_vehicle(c)).alias("vehicles"), F.count_if(traffic.is_person(c)).alias("people"), F.count_if(traffic.judged(F.col("diag"), F.col("frame_diag"))).alias("judged"))


@query(f"""WITH {C.IVS}, bb AS (SELECT g.user_id, g.id, coalesce(max(iou), 0) AS iou FROM gt g LEFT JOIN ov ON ov.user_id=g.user_id AND ov.t_id=g.id GROUP BY 1, 2)
SELECT (SELECT floor(avg(abs(value/500.0 - (event_id % 100)/100.0))*1000+0.5)/1000 FROM ev) AS severity_mae, count(*) AS n, floor(avg(iou)*1000+0.5)/1000 AS mean_iou, floor(avg(CASE WHEN iou >= 0.3 THEN 1.0 ELSE 0.0 END)*1000+0.5)/1000 AS recall FROM bb""")
def q77_severity_and_iou(s, d):
    e = C.events(s, d).select((F.col("value") / 500.0).alias("a"), ((F.col("event_id") % 100) / F.lit(100.0)).alias("b"))
    g = C.intervals(s, d, "purchase")
    best = score.overlaps(g, C.intervals(s, d, "click"), ["user_id"]).groupBy("user_id", F.col("t_id").alias("id")).agg(F.max("iou").alias("iou"))
    best = g.join(best, ["user_id", "id"], "left").select(F.coalesce("iou", F.lit(0.0)).alias("iou"))
    return marks.severity_error(e, "a", "b").select("severity_mae").crossJoin(marks.iou_summary(best, "iou"))  # one row by one row


@query(f"""WITH {C.EPI}, ids AS (SELECT DISTINCT user_id AS id, 1 + user_id % 3 AS level, 600.0 AS dur FROM ev), rw AS (SELECT user_id AS id, CASE event_type WHEN 'click' THEN 'fire' WHEN 'error' THEN 'smoke' WHEN 'view' THEN 'normal' ELSE 'ufo' END AS label, CASE WHEN island % 4 = 0 THEN NULL ELSE (s - {_T0})/3600000000.0 - 1 END AS a, (e - {_T0})/3600000000.0 AS b, (n % 10)/10.0 AS conf, island*2 + CASE WHEN event_type='error' THEN 1 ELSE 0 END AS row FROM epi),
k AS (SELECT ids.*, label, a, b, conf, row FROM rw JOIN ids USING (id) WHERE label IN ('fire','smoke')), one AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY conf DESC, row) AS r FROM k WHERE level = 1),
m AS (SELECT id, level, label, conf, row, greatest(0.0, a) AS s, CASE WHEN b > dur THEN dur - 0.05 ELSE b END AS e FROM k WHERE level >= 2 AND a IS NOT NULL), mm AS (SELECT id, level, label, conf, row, floor(s*1000+0.5)/1000 AS s, floor(e*1000+0.5)/1000 AS e FROM m WHERE e > s), d AS (SELECT *, row_number() OVER (PARTITION BY id, label, s, e ORDER BY conf DESC, row) AS r FROM mm)
SELECT id, level, label, CAST(NULL AS DOUBLE) AS start, CAST(NULL AS DOUBLE) AS "end" FROM one WHERE r = 1 AND conf >= 0.2 UNION ALL SELECT id, level, label, s, e FROM d WHERE r = 1""")
def q78_rows_to_events(s, d):
    first = C.events(s, d).agg(F.min("t_us").alias("t0"))
    e = C.episodes(s, d).crossJoin(F.broadcast(first))  # one row on the right
    ids = C.events(s, d).select(F.col("user_id").alias("id")).distinct().select("id", (1 + F.col("id") % 3).alias("level"), F.lit(600.0).alias("duration"))
    t, at = F.col("event_type"), lambda c: (F.col(c) - F.col("t0")) / float(C.HOUR)
    rows = e.select(F.col("user_id").alias("id"), F.lit(1).alias("level"), F.when(t == "click", "fire").when(t == "error", "smoke").when(t == "view", "normal").otherwise("ufo").alias("label"), F.when(F.col("island") % 4 != 0, at("start") - 1).alias("start"), at("end").alias("end"),
                    ((F.col("n") % 10) / F.lit(10.0)).alias("conf"), (F.col("island") * 2 + (t == "error").cast("int")).alias("row"))
    return validate.events_from_rows(ids, rows, 0.2).select("id", "level", "label", "start", "end")


_CUTS = (0.1, 0.3, 0.6)


@query(f"""{_TRACKS}, s AS (SELECT stream_id, day, cut, avg(CASE WHEN ns < cut THEN 1.0 ELSE 0.0 END) AS share FROM tr CROSS JOIN (VALUES {",".join(f"(CAST({c} AS DOUBLE))" for c in _CUTS)}) c(cut) GROUP BY 1, 2, 3), f AS (SELECT *, share >= 0.6 AS ok, row_number() OVER (PARTITION BY stream_id, cut ORDER BY day) AS k FROM s),
g AS (SELECT stream_id, cut, k - row_number() OVER (PARTITION BY stream_id, cut ORDER BY day) AS run FROM f WHERE ok), r AS (SELECT stream_id, cut, run, count(*) AS n FROM g GROUP BY 1, 2, 3), l AS (SELECT stream_id, cut, max(n) AS n FROM r GROUP BY 1, 2)
SELECT f.stream_id, f.cut, floor(avg(share)*1000000+0.5)/1000000 AS mean_share, count(*) FILTER (ok) AS frames, CAST(coalesce(any_value(l.n), 0) AS DOUBLE) AS longest FROM f LEFT JOIN l ON l.stream_id=f.stream_id AND l.cut=f.cut GROUP BY 1, 2""")
def q80_speed_profile(s, d):
    out = traffic.speed_profile(_tracks(s, d), ["stream_id"], "day", "norm_speed", _CUTS)
    return out.withColumn("mean_share", X.floored(F.col("mean_share"), 6))


@query(f"""{_TRACKS} SELECT stream_id, day, floor(quantile_cont(ns,0.1)*1000000+0.5)/1000000 AS p10, floor(quantile_cont(ns,0.25)*1000000+0.5)/1000000 AS p25, floor(quantile_cont(ns,0.5)*1000000+0.5)/1000000 AS p50, floor(quantile_cont(ns,0.75)*1000000+0.5)/1000000 AS p75 FROM tr GROUP BY 1, 2""")
def q81_speed_quantiles(s, d):
    out = traffic.speed_quantiles(_tracks(s, d), ["stream_id", "day"], "norm_speed")
    return out.select("stream_id", "day", *(X.floored(F.col(c), 6).alias(c) for c in ("p10", "p25", "p50", "p75")))


@query(f"""WITH {C.EV}, r AS (SELECT user_id, event_id, t_us, (['slow','stopped','near','slow'])[event_id % 4 + 1] AS reason, CASE WHEN t_us - lag(t_us) OVER w > 48*3600000000 OR lag(t_us) OVER w IS NULL THEN 1 ELSE 0 END AS brk FROM ev WHERE event_type='error' WINDOW w AS (PARTITION BY user_id ORDER BY t_us)),
k AS (SELECT *, CAST(sum(brk) OVER (PARTITION BY user_id ORDER BY t_us ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM r), f AS (SELECT user_id, island, reason, min(t_us) AS first FROM k GROUP BY 1, 2, 3) SELECT user_id, island, string_agg(reason, ',' ORDER BY first) AS reasons FROM f GROUP BY 1, 2""")
def q82_episode_reasons(s, d):
    from .operators.intervals import gap_merge, ordered_distinct

    e = C.events(s, d).filter("event_type = 'error'").withColumn("reason", _pick(("slow", "stopped", "near", "slow"), "event_id"))
    out = gap_merge(e, ["user_id"], "t_us", "t_us", 48 * C.HOUR, [ordered_distinct("t_us", "reason").alias("reasons")])
    return out.select("user_id", "island", F.array_join("reasons", ",").alias("reasons"))


@query()
def q79_zone_calibration(s, d):
    o = C.observations(s, d)
    boxes = o.select("stream_id", "track_id", (F.col("t_us") / 6e9).alias("t"), F.lit("car").alias("class_name"), F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2"))
    return traffic.calibrate_zones(traffic.heat(boxes, ["stream_id"], "track_id", "t", 0.05, 0.02, 32), "stream_id", 640, 1056, 32, sigma=1.0, dilate=1, least_area=0.004)


_GRID7 = (0.05, 0.10, 0.15, 0.20, 0.30, 0.45, 0.60)
_CLASSES = 6


def _retuned_sql() -> str:
    """Coordinate ascent for every fold at once; a step keeps the first of the best grid values where it gains."""
    out = [f"""WITH x AS (SELECT vec_id, unnest(range({_CLASSES})) AS c, CAST(unnest(embedding[1:{_CLASSES}]) AS DOUBLE) AS z FROM embeddings),
ex AS (SELECT vec_id, c, exp(z - max(z) OVER (PARTITION BY vec_id)) AS e FROM x), pb AS (SELECT vec_id // 25 AS vid, c, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM ex),
pv AS MATERIALIZED (SELECT vid, c, floor(avg(p)*1000000+0.5)/1000000 AS p FROM pb GROUP BY 1, 2), v AS MATERIALIZED (SELECT vec_id // 25 AS vid, arg_min(label, vec_id) % {_CLASSES} AS truth FROM embeddings GROUP BY 1),
nrm AS (SELECT vid, p AS p0 FROM pv WHERE c = 0), st0 AS MATERIALIZED (SELECT vid, [{", ".join(["CAST(0.2 AS DOUBLE)"] * _CLASSES)}] AS thr, CAST(-1 AS DOUBLE) AS best FROM v)"""]
    steps = [None, *(c for _ in range(2) for c in range(1, _CLASSES))]
    for i, c in enumerate(steps):
        tries = f"SELECT vid AS fold, 0 AS gi, thr, best FROM st{i}" if c is None else f"SELECT vid AS fold, gi, list_concat(list_append(thr[1:{c}], g), thr[{c + 2}:]) AS thr, best FROM st{i} CROSS JOIN (SELECT unnest({list(_GRID7)}::DOUBLE[]) AS g, unnest(range({len(_GRID7)})) AS gi)"
        out.append(f"""tr{i} AS MATERIALIZED ({tries}),
ok{i} AS MATERIALIZED (SELECT fold, gi, pv.vid, arg_max(c, (p, c)) AS c, max(p) AS p FROM tr{i} JOIN pv ON pv.c > 0 AND pv.vid <> fold AND p >= thr[c + 1] GROUP BY 1, 2, 3),
pk{i} AS MATERIALIZED (SELECT tr{i}.fold, tr{i}.gi, v.vid, v.truth, CASE WHEN o.p >= p0 THEN o.c ELSE 0 END AS pick FROM tr{i} JOIN v ON v.vid <> fold JOIN nrm ON nrm.vid = v.vid LEFT JOIN ok{i} o ON o.fold=tr{i}.fold AND o.gi=tr{i}.gi AND o.vid=v.vid),
cc{i} AS (SELECT fold, gi, k, count(*) FILTER (truth = k) AS sup, count(*) FILTER (pick = k) AS rep, count(*) FILTER (pick = k AND truth = k) AS hit FROM pk{i} CROSS JOIN (SELECT unnest(range({_CLASSES})) AS k) GROUP BY 1, 2, 3),
mm{i} AS MATERIALIZED (SELECT fold, gi, floor(avg(floor(2*hit/CAST(rep+sup AS DOUBLE)*1000+0.5)/1000) FILTER (sup > 0)*1000+0.5)/1000 AS m FROM cc{i} GROUP BY 1, 2),
bb{i} AS (SELECT fold, max(m) AS m, arg_min(gi, (-m, gi)) AS gi FROM mm{i} GROUP BY 1),
st{i + 1} AS MATERIALIZED (SELECT st{i}.vid, CASE WHEN b.m > st{i}.best + 1e-9 THEN t.thr ELSE st{i}.thr END AS thr, greatest(b.m, st{i}.best) AS best FROM st{i} JOIN bb{i} b ON b.fold = st{i}.vid JOIN (SELECT fold, gi, thr FROM tr{i}) t ON t.fold = b.fold AND t.gi = b.gi)""")
    return ", ".join(out) + f""", own AS (SELECT v.vid, any_value(v.truth) AS truth, arg_max(pv.c, (pv.p, pv.c)) FILTER (pv.c > 0 AND pv.p >= thr[pv.c + 1]) AS c, max(pv.p) FILTER (pv.c > 0 AND pv.p >= thr[pv.c + 1]) AS p FROM v JOIN st{len(steps)} s ON s.vid = v.vid JOIN pv ON pv.vid = v.vid GROUP BY 1),
fin AS (SELECT own.vid, truth, CASE WHEN p >= p0 THEN own.c ELSE 0 END AS pick FROM own JOIN nrm ON nrm.vid = own.vid),
n AS (SELECT k, count(*) FILTER (truth = k) AS support, count(*) FILTER (pick = k AND truth = k) AS hit, count(*) FILTER (pick = k) AS reported FROM fin CROSS JOIN (SELECT unnest(range({_CLASSES})) AS k) GROUP BY 1),
f AS (SELECT *, CASE WHEN reported + support = 0 THEN 0.0 ELSE floor(2*hit/CAST(reported+support AS DOUBLE)*1000+0.5)/1000 END AS f1 FROM n)
SELECT CAST(k AS INTEGER) AS class, support, hit AS "right", reported, f1, (SELECT floor(avg(f1) FILTER (support > 0)*1000+0.5)/1000 FROM f) AS macro_f1 FROM f"""


@query(_retuned_sql())
def q83_held_out_retuning(s, d):
    e = C.table(s, d, "embeddings").select(F.expr("vec_id div 25").alias("vid"), "vec_id", "label", decide.softmax(F.slice("embedding", 1, _CLASSES)).alias("probs"))
    truth = e.groupBy("vid").agg(F.array((F.min_by("label", "vec_id") % _CLASSES).cast("int")).alias("truth"))
    p = e.select("vid", F.explode("probs").alias("x")).groupBy("vid", "x.c").agg(X.floored(F.avg("x.p"), 6).alias("p"))
    videos = truth.join(p.groupBy("vid").agg(F.array_sort(F.collect_list(F.struct("p", "c"))).alias("probs")), "vid")
    return search.pooled_score(search.retuned(videos, "vid", _CLASSES, list(_GRID7), 0.2), _CLASSES)


@query(f"""WITH {C.EV}, k AS (SELECT user_id, event_id, t_us FROM ev WHERE event_type = 'click'), v AS (SELECT user_id, event_id, t_us FROM ev WHERE event_type = 'view'),
j AS (SELECT k.event_id, k.t_us, v.t_us AS near, row_number() OVER (PARTITION BY k.event_id ORDER BY abs(v.t_us - k.t_us), v.t_us) AS r FROM k JOIN v ON v.user_id = k.user_id AND abs(v.t_us - k.t_us) <= {6 * C.HOUR})
SELECT event_id, near AS near_us, near - t_us AS shift_us FROM j WHERE r = 1""")
def q84_nearest_frames(s, d):
    e = C.events(s, d).select("user_id", "event_id", "event_type", "t_us")
    met = intervals.nearest(e.filter("event_type = 'click'").drop("event_type"), e.filter("event_type = 'view'").drop("event_type"), ["user_id"], "t_us", "event_id", 6 * C.HOUR)
    return met.select("event_id", F.col("near_t_us").alias("near_us"), (F.col("near_t_us") - F.col("t_us")).alias("shift_us"))


@query(f"""WITH {C.EV}, m AS (SELECT user_id, event_id, (event_id % 3) - 1 AS b, (event_id % 5) - 2 AS tx, (event_id * 7 % 11) - 5 AS ty FROM ev),
c AS (SELECT *, sum(ty) OVER w AS y, sum(b) OVER w AS bs, sum(ty) OVER w - ty AS y0 FROM m WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, CAST(bs AS DOUBLE) AS shear, CAST(sum(b * y0 + tx) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM c""")
def q85_running_camera_products(s, d):
    """Shears and shifts by whole numbers, so that the products are exact: x' = x + b y + tx, y' = y + ty."""
    k = F.col("event_id")
    matrix = F.array(F.lit(1.0), ((k % 3) - 1).cast("double"), ((k % 5) - 2).cast("double"), F.lit(0.0), F.lit(1.0), ((k * 7 % 11) - 5).cast("double"))
    total = motion.cumulative_affine(C.events(s, d).select("user_id", "event_id", matrix.alias("m")), "user_id", "event_id", "m")
    return total.select("event_id", F.get("total", 1).alias("shear"), F.get("total", 2).alias("x"), F.get("total", 5).alias("y"))


@query(r"""WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[{}"\\\x00-\x1F]', ' ', 'g') AS t FROM documents),
a AS (SELECT doc_id, t[41:60] AS seen, length(t) % 4 AS k, length(t) % 3 = 0 AS flag FROM d)
SELECT doc_id, CASE WHEN k = 3 THEN false ELSE flag END AS visible, CASE WHEN k = 3 THEN 'none' ELSE 'smoke ' || seen END AS hazard FROM a WHERE k <> 2""")
def q86_observations_in_prose(s, d):
    """Answers with prose and other blocks before the object: each block is tried; of a third kind the whole from { to } is read loosely."""
    t = F.regexp_replace(F.coalesce("text", F.lit("")), r'[{}"\\\x00-\x1F]', " ")
    docs = C.table(s, d, "documents").select("doc_id", F.substring(t, 1, 40).alias("prose"), F.substring(t, 41, 20).alias("seen"), F.length(t).alias("n"))
    flag, kind = F.when(F.col("n") % 3 == 0, "true").otherwise("false"), F.col("n") % 4
    whole = F.concat(F.lit('{"hazard_visible": '), flag, F.lit(', "hazard_type": "smoke '), "seen", F.lit('", "surroundings": "'), "prose", F.lit('"}'))
    said = (F.when(kind == 0, whole).when(kind == 1, F.concat("prose", F.lit(' {"note": 1} then {x} '), whole, F.lit(" {done}")))
            .when(kind == 2, F.concat("prose", F.lit(" {no object here"))).otherwise(F.concat(F.lit("Sure: "), F.lit('{"inner": {"a": 1}}'))))
    return docs.select("doc_id", X.observation(said).alias("o")).filter("o is not null").select("doc_id", F.col("o.hazard_visible").alias("visible"), F.col("o.hazard_type").alias("hazard"))


_WHERE = "CAST(o_orderkey % 97 AS DOUBLE) / 4"


@query(f"""WITH o AS (SELECT o_orderkey, {_WHERE} AS a, {_WHERE} + (o_custkey % 41) / 4.0 AS b, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN 0.0 ELSE 30.0 END AS d FROM orders)
SELECT o_orderkey, CASE WHEN d > 0 THEN CASE WHEN a/d < 0.33 THEN 'early in the clip, ' WHEN a/d < 0.66 THEN 'midway through the clip, ' ELSE 'late in the clip, ' END ELSE '' END || 'from ' || CAST(round_even(a, 0) AS BIGINT) || 's to ' || CAST(round_even(b, 0) AS BIGINT) || 's (' || CAST(round_even(b - a, 0) AS BIGINT) || 's)' AS said FROM o""")
def q87_where_phrases(s, d):
    o = C.table(s, d, "orders")
    a = (F.col("o_orderkey") % 97).cast("double") / 4
    b = a + (F.col("o_custkey") % 41) / F.lit(4.0)
    span = F.when(F.col("o_orderkey") % 5 == 1, 0.0).when(F.col("o_orderkey") % 5 > 1, 30.0)
    return o.select("o_orderkey", X.where_phrase(a, b, span).alias("said"))


_SAID_SQL = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.VERDICT_LEADS.items()) + f" ELSE '{X.ANY_LEAD}' END"
_CALM_SQL = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.NORMAL_LEADS.items()) + f" ELSE '{X.ANY_NORMAL}' END"


@query(f"""WITH d AS (SELECT doc_id, lang, trim(substr(coalesce(text, ''), 1, 30), ' ') AS t, length(coalesce(text, '')) AS n FROM documents),
k AS (SELECT *, ({_sql_list([*X.VERDICT_LEADS, "loitering"])})[n % 4 + 1] AS kind, n % 2 = 0 AS rule, n % 7 = 0 AS seen FROM d)
SELECT doc_id, trim((CASE WHEN seen THEN 'Smoke ' || lower(lang) || ' visible at the scene.' WHEN rule THEN {_SAID_SQL} ELSE {_CALM_SQL} END) || ' ' || t, ' ') AS reason, CASE WHEN seen THEN 'yes' ELSE 'no' END AS first FROM k""")
def q88_verdict_texts(s, d):
    """Verdict texts by kind, and the stand-in of the second opinion on a prompt of options."""
    docs = C.table(s, d, "documents").select("doc_id", "lang", F.trim(F.substring(F.coalesce("text", F.lit("")), 1, 30)).alias("t"), F.length(F.coalesce("text", F.lit(""))).alias("n"))
    kind = _pick([*X.VERDICT_LEADS, "loitering"], "n")
    seen = F.col("n") % 7 == 0
    reason = X.fused_reason(kind, F.col("n") % 2 == 0, seen, F.when(seen, F.concat(F.lit("sMOKE "), F.upper("lang"))).otherwise("none"), F.col("t"))
    prompt = F.concat(F.lit("Which one?\n"), F.when(seen, "  - yes: something burns\n- no: nothing").otherwise("- no\n- yes: it burns"))
    return docs.select("doc_id", reason.alias("reason"), X.first_option(prompt).alias("first"))


@query(f"""WITH {C.EV}, f AS (SELECT user_id, event_type, event_id, {_HOURS} AS t, (event_id*37 % 100)/100.0 AS p FROM ev), k AS (SELECT * FROM f WHERE p >= 0.4),
b AS (SELECT *, CASE WHEN t - lag(t) OVER w > 6.0 OR lag(t) OVER w IS NULL THEN 1 ELSE 0 END AS brk FROM k WINDOW w AS (PARTITION BY user_id, event_type ORDER BY t)),
i AS (SELECT *, CAST(sum(brk) OVER (PARTITION BY user_id, event_type ORDER BY t ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM b)
SELECT user_id, event_type, island, floor(min(t)*10000+0.5)/10000 AS start_h, floor(greatest(max(t), min(t)+1)*10000+0.5)/10000 AS end_h, count(*) AS n, floor(avg(p)*10000+0.5)/10000 AS conf FROM i GROUP BY 1, 2, 3""")
def q89_argmax_windows(s, d):
    out = windows.argmax_windows(_hours(s, d), ["user_id"], "event_type", "t", "p", 0.4)
    return out.select("user_id", "event_type", "island", X.floored(F.col("start"), 4).alias("start_h"), X.floored(F.col("end"), 4).alias("end_h"), "n", X.floored(F.col("conf"), 4).alias("conf"))


@query("""WITH todo AS (SELECT o_orderkey, o_custkey FROM orders WHERE NOT (o_orderkey % 3 = 0 AND o_custkey % 2 = 0)), r AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS k FROM todo)
SELECT o_orderkey, o_custkey FROM r WHERE k % 4 = 1""")
def q90_resumed_shard(s, d):
    """One worker of four takes up what is left: rows that are done (without an error) are out, the rest is dealt in order."""
    o = C.table(s, d, "orders").select("o_orderkey", "o_custkey")
    done = o.filter("o_orderkey % 3 = 0").select("o_orderkey", F.when(F.col("o_custkey") % 2 == 1, "timeout").alias("error"))
    return motion.shard(readers.not_done(o, done, "o_orderkey"), "o_orderkey", 4, 1)


@query("""WITH ok AS (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer WHERE c_custkey % 7 = 0), b AS (SELECT o_custkey AS c_custkey, CASE WHEN count(*) > 10 THEN CAST(count(*) AS DOUBLE) END AS c_acctbal FROM orders GROUP BY 1)
SELECT c.c_custkey, coalesce(b.c_acctbal, CAST(c.c_acctbal AS DOUBLE)) AS c_acctbal, NOT EXISTS (SELECT 1 FROM ok WHERE ok.c_nationkey = c.c_nationkey AND ok.c_mktsegment = c.c_mktsegment) AS stale FROM customer c LEFT JOIN b USING (c_custkey)""")
def q91_overlay_and_stale(s, d):
    """Columns of a second source over those of the first where it has them, and rows whose provenance is no longer allowed."""
    c = C.table(s, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", F.col("c_acctbal").cast("double").alias("c_acctbal"))
    n = F.count("*")
    more = C.table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.when(n > 10, n.cast("double")).alias("c_acctbal"))
    old = motion.stale(c, c.filter("c_custkey % 7 = 0"), ["c_nationkey", "c_mktsegment"]).select("c_custkey", F.lit(True).alias("stale"))
    return assemble.overlay(c, more, "c_custkey").join(old, "c_custkey", "left").select("c_custkey", "c_acctbal", F.coalesce("stale", F.lit(False)).alias("stale"))


@query("""WITH o AS (SELECT o_orderkey, CAST(o_orderkey % 50 AS DOUBLE) + 0.5 AS d, CAST(o_custkey % 30 AS DOUBLE) AS fps FROM orders)
SELECT o_orderkey, CASE WHEN d < 8 THEN greatest(1.5, d*0.35) WHEN d < 30 THEN 5.0 ELSE 8.0 END AS stop_s, CASE WHEN d < 8 THEN greatest(2.0, d*0.45) WHEN d < 30 THEN 8.0 ELSE 10.0 END AS loiter_s,
CASE WHEN d < 8 THEN greatest(2.0, d*0.40) WHEN d < 30 THEN 8.0 ELSE 12.0 END AS congestion_s, CASE WHEN d < 8 THEN d WHEN d < 30 THEN 30.0 ELSE 60.0 END AS congestion_cooldown_s,
CASE WHEN d < 8 THEN least(4.0, d*0.5) ELSE 4.0 END AS duplicate_s, CASE WHEN d < 8 THEN greatest(1.0, d*0.3) ELSE 6.0 END AS cooldown_s, CASE WHEN fps < 5 THEN 1 WHEN fps < 15 THEN 2 ELSE 3 END AS stride FROM o""")
def q92_settings_by_length(s, d):
    o = C.table(s, d, "orders").select("o_orderkey", ((F.col("o_orderkey") % 50).cast("double") + 0.5).alias("d"), (F.col("o_custkey") % 30).cast("double").alias("fps"))
    return o.select("o_orderkey", X.thresholds_for(F.col("d")).alias("x"), X.stride_for(F.col("fps"), F.lit(3)).alias("stride")).select("o_orderkey", "x.*", "stride")


@query("""WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('s'||doc_id), doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents),
m AS (SELECT *, least(60, n * 3) AS most FROM r), k AS (SELECT *, CASE WHEN r <= most THEN CAST(floor((most - r) / CAST(n AS DOUBLE)) AS INTEGER) + 1 ELSE 0 END AS many FROM m) SELECT doc_id, lang, CAST(unnest(range(1, many + 1)) AS INTEGER) AS copy FROM k WHERE many > 0""")
def q93_balanced_languages(s, d):
    return sample.balance(C.table(s, d, "documents").select("doc_id", "lang"), ["lang"], "doc_id", 60)
