"""The named queries over the driver's tables, and DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from .functions import expr as X
from .operators import assemble, decide, intervals, marks, sample, score, search, traffic
from .plans import carriers as C
from .streaming import tracker

Query = Callable[[SparkSession, str], DataFrame]
DAY = 24 * C.HOUR
ZONES = [("driving_lane", [(0, 200), (700, 200), (700, 400), (0, 400)]), ("shoulder", [(100, 350), (900, 350), (900, 450), (100, 450)]),
         ("sidewalk", [(0, 450), (1000, 450), (500, 600)]), ("parking", [(750, 0), (1000, 0), (1000, 300)])]
_Q: dict[str, Query] = {}
_S: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _Q[f.__name__] = f
        if sql:
            _S[f.__name__] = sql
        return f
    return add


@query(f"WITH {C.EPI} SELECT user_id, event_type, island, s AS start_us, e AS end_us, n, floor(mean*10000+0.5)/10000 AS mean FROM epi")
def q01_episodes_gap_merge(s, d):
    return C.episodes(s, d).select("user_id", "event_type", "island", F.col("start").alias("start_us"), F.col("end").alias("end_us"), "n", X.floored(F.col("mean"), 4).alias("mean"))


@query(f"WITH {C.EPI} SELECT user_id, event_type, island, e - s AS length_us FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY e-s DESC, s) AS r FROM epi) WHERE r = 1")
def q02_episode_longest_per_label(s, d):
    w = W.partitionBy("user_id", "event_type").orderBy(F.desc(F.col("end") - F.col("start")), "start")
    return C.episodes(s, d).withColumn("r", F.row_number().over(w)).filter("r = 1").select("user_id", "event_type", "island", (F.col("end") - F.col("start")).alias("length_us"))


@query(f"""WITH {C.EV}, day AS (SELECT event_type, t_us // {DAY} AS day, count(*) AS n, count(*) FILTER (value >= 35) AS hi FROM ev GROUP BY 1, 2),
f AS (SELECT *, 2*hi >= n AND n >= 5 AS ok, row_number() OVER (PARTITION BY event_type ORDER BY day) AS k FROM day),
g AS (SELECT event_type, day, k - row_number() OVER (PARTITION BY event_type ORDER BY day) AS run FROM f WHERE ok),
r AS (SELECT event_type, run, count(*) AS length FROM g GROUP BY 1, 2) SELECT event_type, count(*) AS runs, max(length) AS longest FROM r GROUP BY 1""")
def q03_sustained_run(s, d):
    day = C.events(s, d).groupBy("event_type", F.expr(f"t_us div {DAY}").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("value") >= 35).alias("hi"))
    r = intervals.runs(day, ["event_type"], "day", (2 * F.col("hi") >= F.col("n")) & (F.col("n") >= 5))
    return r.groupBy("event_type").agg(F.count("*").alias("runs"), F.max("length").alias("longest"))


@query(f"""WITH {C.OBS}, r AS (SELECT *, first_value(x) OVER w AS rx, first_value(y) OVER w AS ry, first_value(t_us) OVER w AS rt FROM obs
WINDOW w AS (PARTITION BY track_id ORDER BY t_us RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW))
SELECT event_id, floor((CASE WHEN t_us > rt THEN sqrt((x-rx)*(x-rx)+(y-ry)*(y-ry)) / sqrt(w*w+h*h) / ((t_us-rt)/3600000000.0) ELSE 0 END)*1000000+0.5)/1000000 AS norm_speed,
floor(CASE WHEN class_name='car' THEN 4.4 ELSE 0.6 END / greatest(w,h)*1000000+0.5)/1000000 AS m_per_px FROM r""")
def q04_lookback_speed(s, d):
    r = intervals.look_back(C.observations(s, d), ["track_id"], "t_us", DAY, ["x", "y", "t_us"])
    dx, dy, dt = F.col("x") - F.col("ref_x"), F.col("y") - F.col("ref_y"), (F.col("t_us") - F.col("ref_t_us")) / float(C.HOUR)
    speed = F.when(dt > 0, F.sqrt(dx * dx + dy * dy) / F.sqrt(F.col("w") * F.col("w") + F.col("h") * F.col("h")) / dt).otherwise(0.0)
    return r.select("event_id", X.floored(speed, 6).alias("norm_speed"), X.floored(X.metres_per_pixel(F.col("class_name"), F.col("w"), F.col("h")), 6).alias("m_per_px"))


@query(f"WITH {C.EV} SELECT event_id, floor(quantile_cont(value, 0.5) OVER (PARTITION BY user_id ORDER BY t_us ROWS 14 PRECEDING)*10000+0.5)/10000 AS median FROM ev")
def q05_rolling_median_15(s, d):
    w = W.partitionBy("user_id").orderBy("t_us").rowsBetween(-14, 0)
    return C.events(s, d).select("event_id", X.floored(F.percentile("value", F.lit(0.5)).over(w), 4).alias("median"))


@query(f"WITH {C.EV} SELECT event_id, count(*) FILTER (value < 50) OVER w / CAST(count(*) OVER w AS DOUBLE) AS slow_fraction FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t_us ROWS 19 PRECEDING)")
def q06_rolling_fraction_20(s, d):
    w = W.partitionBy("user_id").orderBy("t_us").rowsBetween(-19, 0)
    return C.events(s, d).select("event_id", (F.count_if(F.col("value") < 50).over(w) / F.count("*").over(w)).alias("slow_fraction"))


@query(f"WITH {C.EV} SELECT event_id, last_value(CASE WHEN event_id % 3 = 0 THEN event_id*7 % 360 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t_us ROWS UNBOUNDED PRECEDING) AS heading FROM ev")
def q07_last_heading(s, d):
    heading = F.when(F.col("event_id") % 3 == 0, F.col("event_id") * 7 % 360)
    return C.events(s, d).select("event_id", F.last(heading, ignorenulls=True).over(W.partitionBy("user_id").orderBy("t_us").rowsBetween(W.unboundedPreceding, 0)).alias("heading"))


@query(f"""WITH {C.OBS}, g AS (SELECT *, t_us // {DAY} AS day FROM obs) SELECT a.event_id, CASE WHEN count(b.v) >= 3 THEN floor(quantile_cont(b.v, 0.5)*10000+0.5)/10000 END AS ambient
FROM g a LEFT JOIN g b ON a.stream_id = b.stream_id AND a.day = b.day AND a.event_id <> b.event_id GROUP BY 1""")
def q08_leave_one_out_median(s, d):
    o = C.observations(s, d).withColumn("day", F.expr(f"t_us div {DAY}"))
    return intervals.others_median(o, ["stream_id", "day"], "v", "event_id").select("event_id", X.floored(F.col("others_median"), 4).alias("ambient"))


@query(f"WITH {C.OBS}, g AS (SELECT *, t_us // {DAY} AS day FROM obs) SELECT event_id, count(*) OVER w - 1 AS others, count(*) FILTER (v < 40) OVER w - CASE WHEN v < 40 THEN 1 ELSE 0 END AS stopped FROM g WINDOW w AS (PARTITION BY stream_id, day)")
def q09_neighbour_stopped_ratio(s, d):
    w = W.partitionBy("stream_id", F.expr(f"t_us div {DAY}"))
    still = F.col("v") < 40
    return C.observations(s, d).select("event_id", (F.count("*").over(w) - 1).alias("others"), (F.count_if(still).over(w) - F.when(still, 1).otherwise(0)).alias("stopped"))


@query(f"""WITH {C.OBS}, c AS (SELECT stream_id, x // 100 AS cx, radians(event_id*7 % 360) AS a FROM obs), g AS (SELECT stream_id, cx, count(*) AS n, sum(sin(a)) AS s, sum(cos(a)) AS c FROM c GROUP BY 1, 2)
SELECT stream_id, cx, n, floor(sqrt(s*s+c*c)/n*1000000+0.5)/1000000 AS resultant, floor(((degrees(atan2(s,c))+360) - 360*floor((degrees(atan2(s,c))+360)/360))*10000+0.5)/10000 AS flow_deg, sqrt(s*s+c*c)/n >= 0.55 AND n >= 40 AS trusted FROM g""")
def q10_circular_flow(s, d):
    a = F.radians(F.col("event_id") * 7 % 360)
    g = C.observations(s, d).groupBy("stream_id", F.expr("x div 100").alias("cx")).agg(F.count("*").alias("n"), F.sum(F.sin(a)).alias("s"), F.sum(F.cos(a)).alias("c"))
    r, deg = F.sqrt(F.col("s") * F.col("s") + F.col("c") * F.col("c")) / F.col("n"), F.degrees(F.atan2("s", "c")) + 360
    return g.select("stream_id", "cx", "n", X.floored(r, 6).alias("resultant"), X.floored(deg - 360 * F.floor(deg / 360), 4).alias("flow_deg"), X.flow_trusted(deg, r, F.col("n")).alias("trusted"))


@query(f"WITH {C.OBS} SELECT y // 8 AS cy, x // 8 AS cx, count(*) FILTER (v >= 40) AS moving, count(*) FILTER (v < 40) AS still FROM obs GROUP BY 1, 2")
def q11_heatmap(s, d):
    return C.observations(s, d).groupBy(F.expr("y div 8").alias("cy"), F.expr("x div 8").alias("cx")).agg(F.count_if(F.col("v") >= 40).alias("moving"), F.count_if(F.col("v") < 40).alias("still"))


def _zone_sql() -> str:
    rows = [f"({i},'{k}',{a[0]},{a[1]},{b[0]},{b[1]})" for i, (k, p) in enumerate(ZONES) for a, b in zip(p, p[1:] + p[:1], strict=True)]
    return f"""WITH {C.OBS}, edge(o, kind, ax, ay, bx, by_) AS (VALUES {','.join(rows)}),
t AS (SELECT event_id, o, kind, count(*) FILTER ((ay > y) <> (by_ > y) AND x < (bx-ax)*(y-ay)/CAST(by_-ay AS DOUBLE)+ax) % 2 = 1 OR bool_or((bx-ax)*(y-ay)-(by_-ay)*(x-ax) = 0 AND x BETWEEN least(ax,bx) AND greatest(ax,bx) AND y BETWEEN least(ay,by_) AND greatest(ay,by_)) AS inside FROM obs CROSS JOIN edge GROUP BY 1, 2, 3),
z AS (SELECT event_id, arg_min(kind, o) AS kind FROM t WHERE inside GROUP BY 1) SELECT event_id, coalesce(kind, 'unknown') AS zone_kind FROM obs LEFT JOIN z USING (event_id)"""


@query(_zone_sql())
def q12_zone_lookup_first_match(s, d):
    return C.observations(s, d).select("event_id", X.zone_of(F.col("x"), F.col("y"), ZONES).alias("zone_kind"))


@query("""WITH c AS (SELECT source, count(*) FILTER (quality=1 AND n_chars>=1500) AS tp, count(*) FILTER (quality=0 AND n_chars>=1500) AS fp, count(*) FILTER (quality=1 AND n_chars<1500) AS fn, count(*) FILTER (quality=0 AND n_chars<1500) AS tn
FROM labels JOIN documents USING (doc_id) GROUP BY 1), p AS (SELECT *, coalesce(tp/nullif(CAST(tp+fp AS DOUBLE),0),0) AS precision, coalesce(tp/nullif(CAST(tp+fn AS DOUBLE),0),0) AS recall FROM c) SELECT *, coalesce(2*precision*recall/nullif(precision+recall,0),0) AS f1 FROM p""")
def q13_confusion_prf(s, d):
    both = C.table(s, d, "labels").join(C.table(s, d, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    return score.confusion(both, F.col("quality") == 1, F.col("n_chars") >= 1500, ["source"])


_F1 = """j AS (SELECT coalesce(t.label,p.label) AS label, t.user_id AS t, p.user_id AS p FROM tl t FULL JOIN pl p ON t.user_id=p.user_id AND t.label=p.label),
c AS (SELECT label, count(*) FILTER (t IS NOT NULL AND p IS NOT NULL) AS tp, count(*) FILTER (t IS NULL) AS fp, count(*) FILTER (p IS NULL) AS fn FROM j GROUP BY 1),
f AS (SELECT *, tp+fn AS support, CASE WHEN tp=0 THEN 0.0 ELSE floor(2*(tp/CAST(tp+fp AS DOUBLE))*(tp/CAST(tp+fn AS DOUBLE))/(tp/CAST(tp+fp AS DOUBLE)+tp/CAST(tp+fn AS DOUBLE))*1000+0.5)/1000 END AS f1 FROM c)"""


@query(f"""WITH {C.TRUE}, {_F1}, a AS (SELECT user_id, list_sort(list(DISTINCT label)) AS ls FROM tl GROUP BY 1), b AS (SELECT user_id, list_sort(list(DISTINCT label)) AS ls FROM pl GROUP BY 1)
SELECT f.label, tp, fp, fn, support, f1, (SELECT floor(avg(f1) FILTER (support>0)*1000+0.5)/1000 FROM f) AS macro_f1, (SELECT count(*) FROM a JOIN b USING (user_id) WHERE a.ls = b.ls) AS exact, (SELECT count(*) FROM a) AS n FROM f""")
def q14_macro_f1_label_sets(s, d):
    t, p = C.truth_labels(s, d), C.predicted_labels(s, d)
    each = score.label_set_scores(t, p, "user_id", "label")
    one = score.macro_f1(each).crossJoin(score.set_accuracy(t, p, "user_id", "label"))  # one row by one row
    return each.crossJoin(F.broadcast(one))


@query(f"""WITH {C.TRUE}, u AS (SELECT DISTINCT user_id FROM ev), r AS (SELECT user_id, label FROM tl UNION ALL SELECT user_id, 'normal' FROM u WHERE user_id NOT IN (SELECT user_id FROM tl)),
k AS (SELECT r.*, CASE WHEN label='normal' THEN user_id NOT IN (SELECT user_id FROM pl) ELSE EXISTS (SELECT 1 FROM pl WHERE pl.user_id=r.user_id AND pl.label=r.label) END AS ok FROM r)
SELECT count(*) FILTER (label<>'normal' AND ok) AS tp, count(*) FILTER (label<>'normal' AND NOT ok) AS fn, count(*) FILTER (label='normal' AND ok) AS tn, count(*) FILTER (label='normal' AND NOT ok) AS fp FROM k""")
def q15_binary_row_accuracy(s, d):
    t, p = C.truth_labels(s, d), C.predicted_labels(s, d)
    rows = assemble.complete(C.events(s, d).select("user_id").distinct(), t, "user_id", "normal")
    hit = rows.join(p.withColumn("same", F.lit(True)), ["user_id", "label"], "left").join(p.select("user_id").distinct().withColumn("any", F.lit(True)), "user_id", "left")
    normal = F.col("label") == "normal"
    ok = F.when(normal, F.col("any").isNull()).otherwise(F.col("same").isNotNull())
    c = lambda n, k: F.count_if((normal == n) & (ok == k))
    return hit.agg(c(False, True).alias("tp"), c(False, False).alias("fn"), c(True, True).alias("tn"), c(True, False).alias("fp"))


@query(f"WITH {C.IVS}, bb AS (SELECT user_id, t_id, max(iou) AS iou FROM ov GROUP BY 1, 2) SELECT g.user_id, g.id, floor(coalesce(bb.iou,0)*1000000+0.5)/1000000 AS best_iou, coalesce(bb.iou,0) >= 0.3 AS recalled FROM gt g LEFT JOIN bb ON g.user_id=bb.user_id AND g.id=bb.t_id")
def q16_temporal_iou_best(s, d):
    g, p = C.intervals(s, d, "purchase"), C.intervals(s, d, "click")
    best = score.overlaps(g, p, ["user_id"]).groupBy("user_id", F.col("t_id").alias("id")).agg(F.max("iou").alias("iou"))
    iou = F.coalesce("iou", F.lit(0.0))
    return g.join(best, ["user_id", "id"], "left").select("user_id", "id", X.floored(iou, 6).alias("best_iou"), (iou >= 0.3).alias("recalled"))


@query(f"""WITH RECURSIVE {C.IVS}, {C.GREEDY.format(gate=0.1)}
SELECT user_id, unnest(ts) AS t_id, unnest(ps) AS p_id, floor(unnest(ious)*1000000+0.5)/1000000 AS iou FROM done""")
def q17_greedy_match(s, d):
    pairs = score.overlaps(C.intervals(s, d, "purchase"), C.intervals(s, d, "click"), ["user_id"], 0.1)
    return score.greedy_match(pairs, "user_id").select("user_id", "t_id", "p_id", X.floored(F.col("iou"), 6).alias("iou"))


@query(f"""WITH {C.IVS}, o AS (SELECT * FROM ov WHERE iou > 0), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, t_id ORDER BY iou DESC, p_id) AS k FROM o), c AS (SELECT user_id, count(*) AS options FROM pr GROUP BY 1)
SELECT g.user_id, g.id, r.p_id, coalesce(options, 0) AS options, CASE WHEN options IS NULL THEN 'no class' WHEN iou >= 0.5 THEN 'match' WHEN iou >= 0.25 THEN 'near' ELSE 'miss' END AS verdict FROM gt g LEFT JOIN r ON g.user_id=r.user_id AND g.id=r.t_id AND k=1 LEFT JOIN c ON c.user_id=g.user_id""")
def q18_iou_gap_diag(s, d):
    g, p = C.intervals(s, d, "purchase"), C.intervals(s, d, "click")
    best = score.overlaps(g, p, ["user_id"]).groupBy("user_id", F.col("t_id").alias("id")).agg(F.max(F.struct("iou", (-F.col("p_id")).alias("minus"))).alias("b"))
    iou = F.col("b.iou")
    said = F.when(F.col("options").isNull(), "no class").when(iou >= 0.5, "match").when(iou >= 0.25, "near").otherwise("miss")
    rows = g.join(best, ["user_id", "id"], "left").join(p.groupBy("user_id").agg(F.count("*").alias("options")), "user_id", "left")
    return rows.select("user_id", "id", (-F.col("b.minus")).alias("p_id"), F.coalesce("options", F.lit(0)).alias("options"), said.alias("verdict"))


_BOX = f"""WITH {C.OBS}, a AS (SELECT *, t_us // {DAY} AS day FROM obs), t AS (SELECT * FROM a WHERE event_type='purchase'), p AS (SELECT * FROM a WHERE event_type='click'),
m AS (SELECT t.event_id AS id, t.stream_id, greatest(0,least(t.x+t.w,p.x+p.w)-greatest(t.x,p.x))*greatest(0,least(t.y+t.h,p.y+p.h)-greatest(t.y,p.y)) AS i, t.w*t.h+p.w*p.h AS areas, p.t_us - t.t_us AS late FROM t JOIN p ON t.stream_id=p.stream_id AND t.day=p.day),
h AS (SELECT id, max(i/CAST(areas-i AS DOUBLE)) AS best, count(*) AS hits FROM m WHERE i/CAST(areas-i AS DOUBLE) >= 0.1 GROUP BY 1)
SELECT stream_id, count(*) AS boxes, count(h.id) AS found, CAST(coalesce(sum(hits),0) AS BIGINT) AS hits, floor(coalesce(max(best),0)*1000000+0.5)/1000000 AS best_iou FROM t LEFT JOIN h ON t.event_id=h.id GROUP BY 1"""


@query(_BOX)
def q19_box_overlap_recall(s, d):
    o = C.observations(s, d).withColumn("day", F.expr(f"t_us div {DAY}"))
    boxes = o.select("event_id", "event_type", "stream_id", "day", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2"))
    t, p = boxes.filter("event_type = 'purchase'"), boxes.filter("event_type = 'click'")
    hits = traffic.box_overlaps(t, p, ["stream_id", "day"], "event_id", 0.1).groupBy("t_id").agg(F.max("iou").alias("best"), F.count("*").alias("n"))
    return t.join(hits, F.col("event_id") == F.col("t_id"), "left").groupBy("stream_id").agg(
        F.count("*").alias("boxes"), F.count("n").alias("found"), F.coalesce(F.sum("n"), F.lit(0)).alias("hits"), X.floored(F.coalesce(F.max("best"), F.lit(0.0)), 6).alias("best_iou"))


@query(f"WITH {C.PROBS} SELECT vec_id, arg_max(c, (p, -c)) AS label, floor(max(p)*1000000+0.5)/1000000 AS p FROM pb GROUP BY 1")
def q20_clip_argmax(s, d):
    return C.clips(s, d).select("vec_id", decide.argmax(F.col("probs")).cast("long").alias("label"), X.floored(F.array_max("probs")["p"], 6).alias("p"))


def _rule_sql(cfg: str) -> str:
    """Chosen classes (vec_id, cfg, c) for each row of a table cfg(cfg, thr, k, margin, scale)."""
    return f"""able AS (SELECT pb.*, {cfg}.cfg, k, margin, scale, row_number() OVER (PARTITION BY vec_id, {cfg}.cfg ORDER BY p DESC, c DESC) AS r, max(p) OVER (PARTITION BY vec_id, {cfg}.cfg) AS p1 FROM pb JOIN {cfg} ON c <> 0 AND p >= thr),
nrm AS (SELECT vec_id, p AS p0 FROM pb WHERE c = 0), chosen AS (SELECT able.* FROM able JOIN nrm USING (vec_id) WHERE r <= k AND p1 >= p0*scale AND p1 - p <= margin)"""


@query(f"WITH {C.PROBS}, cfg AS (SELECT 0 AS cfg, 0.2 AS thr, 2 AS k, 0.15 AS margin, 1.0 AS scale), {_rule_sql('cfg')} SELECT v.vec_id, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY r), '') AS labels FROM embeddings v LEFT JOIN chosen USING (vec_id) GROUP BY 1")
def q21_topk_margin_rule(s, d):
    return C.clips(s, d).select("vec_id", F.array_join(decide.top_margin(F.col("probs"), 0.2, 2, 0.15, 1.0).cast("array<string>"), ",").alias("labels"))


@query(f"""WITH {C.PROBS}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, c DESC) AS r FROM pb)
SELECT vec_id, max(p) FILTER (r=1) >= 0.3 AND max(p) FILTER (r=1) - max(p) FILTER (r=2) >= 0.1 AS accepted, string_agg(CAST(c AS VARCHAR), ',' ORDER BY r) FILTER (r <= 3 AND (p >= 0.05 OR r=1)) || CASE WHEN bool_or(c = 0 AND r <= 3 AND (p >= 0.05 OR r=1)) THEN '' ELSE ',0' END AS candidates FROM r GROUP BY 1""")
def q22_cascade_gate(s, d):
    return C.clips(s, d).select("vec_id", decide.gate(F.col("probs"), 0.3, 0.1).alias("accepted"), F.array_join(decide.slate(F.col("probs")).cast("array<string>"), ",").alias("candidates"))


_GRID = ",".join(f"({i},CAST({t} AS DOUBLE),{k},CAST({m} AS DOUBLE),CAST({z} AS DOUBLE))" for i, (t, k, m, z) in enumerate(search.rule_grid()))


@query(f"""WITH {C.PROBS}, cfg(cfg, thr, k, margin, scale) AS (VALUES {_GRID}), {_rule_sql('cfg')}, tru AS (SELECT vec_id, label AS c FROM embeddings WHERE label <> 0),
a AS (SELECT cfg, c, count(*) AS sel, count(*) FILTER (c = truth) AS tp FROM chosen GROUP BY 1, 2), s AS (SELECT c, count(*) AS support FROM tru GROUP BY 1),
f AS (SELECT g.cfg, s.c, CASE WHEN coalesce(tp,0)=0 THEN 0.0 ELSE 2.0*tp/(sel+support) END AS f1 FROM cfg g CROSS JOIN s LEFT JOIN a ON a.cfg=g.cfg AND a.c=s.c)
SELECT f.cfg, thr, k, margin, scale, floor(avg(f1)*1000000+0.5)/1000000 AS macro_f1 FROM f JOIN cfg USING (cfg) GROUP BY ALL""")
def q23_grid_sweep(s, d):
    return search.sweep(C.clips(s, d), search.rule_grid(), classes=10)


@query(f"""WITH {C.PROBS}, g AS (SELECT unnest(range(1, 43)) * 0.02 AS thr), n AS (SELECT c, thr, count(*) FILTER (p >= thr AND truth = c) AS tp, count(*) FILTER (p >= thr AND truth <> c) AS fp, count(*) FILTER (p < thr AND truth = c) AS fn FROM pb CROSS JOIN g GROUP BY 1, 2),
f AS (SELECT *, CASE WHEN tp=0 THEN 0.0 ELSE 2.0*tp/(2*tp+fp+fn) END AS f1 FROM n), r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY f1 DESC, thr DESC) AS r FROM f) SELECT CAST(c AS INTEGER) AS c, floor(thr*100+0.5)/100 AS thr, floor(f1*1000000+0.5)/1000000 AS f1, tp, fp, fn FROM r WHERE r = 1""")
def q24_threshold_calibration(s, d):
    return search.calibrate(C.clips(s, d), [0.02 * k for k in range(1, 43)])


@query(f"""WITH {C.EV}, g AS (SELECT user_id, t_us // {DAY} AS day, event_type AS label, count(*) AS votes, min(event_id) AS seen FROM ev GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER w AS r, votes / CAST(sum(votes) OVER (PARTITION BY user_id, day) AS DOUBLE) AS share FROM g WINDOW w AS (PARTITION BY user_id, day ORDER BY votes DESC, seen))
SELECT user_id, day, label, votes, share FROM r WHERE r = 1""")
def q25_majority_vote(s, d):
    e = C.events(s, d).select("user_id", F.expr(f"t_us div {DAY}").alias("day"), F.col("event_type").alias("label"), "event_id")
    return decide.vote(e, ["user_id", "day"], "label", "event_id")


@query(f"""WITH {C.TRUE}, u AS (SELECT DISTINCT user_id FROM ev), c AS (SELECT user_id, max(label) AS label FROM pl GROUP BY 1), s AS (SELECT * FROM tl WHERE user_id % 3 = 0), r AS (SELECT user_id FROM u WHERE user_id NOT IN (SELECT user_id FROM s))
SELECT user_id, CASE WHEN label = 'purchase' AND user_id % 2 = 0 THEN 'gated' ELSE label END AS label FROM (SELECT user_id, label FROM s UNION ALL SELECT r.user_id, coalesce(c.label, 'normal') FROM r LEFT JOIN c USING (user_id))""")
def q26_priority_fusion(s, d):
    users = C.events(s, d).select("user_id").distinct()
    second = C.predicted_labels(s, d).groupBy("user_id").agg(F.max("label").alias("label"))
    out = decide.fuse(users, "user_id", C.truth_labels(s, d).filter("user_id % 3 = 0"), second)
    return out.withColumn("label", F.when((F.col("label") == "purchase") & (F.col("user_id") % 2 == 0), "gated").otherwise(F.col("label")))


@query(f"""WITH {C.EPI}, e AS (SELECT *, floor(mean*10000+0.5)/10000 AS conf FROM epi), bb AS (SELECT user_id, event_type, max(conf) AS best FROM e GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY best DESC, event_type) AS rank, max(best) OVER (PARTITION BY user_id) AS top FROM bb)
SELECT user_id, event_type, island, conf, rank FROM e JOIN k USING (user_id, event_type) WHERE rank <= 2 AND best >= top*0.5 AND conf >= 10""")
def q27_class_cap(s, d):
    e = C.episodes(s, d).withColumn("conf", X.floored(F.col("mean"), 4))
    return decide.class_cap(e, "user_id", "event_type", "conf", 0.5, 2).filter("conf >= 10").select("user_id", "event_type", "island", "conf", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {C.EV}, c AS (SELECT user_id, (t_us - min(t_us) OVER ())/3600000000.0 AS t FROM ev WHERE event_type = 'click'), b AS (SELECT *, CASE WHEN t - lag(t) OVER w > 24 OR lag(t) OVER w IS NULL THEN 1 ELSE 0 END AS brk FROM c WINDOW w AS (PARTITION BY user_id ORDER BY t)),
i AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS isl FROM b), m AS (SELECT user_id, isl, min(t)-0.5 AS s, max(t)+0.5 AS e FROM i GROUP BY 1, 2), z AS (SELECT *, (s+e)/2 AS mid, least(greatest(e-s,4),72.0) AS span FROM m),
q AS (SELECT user_id, isl, greatest(0, mid-span/2) AS s, least(mid+span/2, 720-0.05) AS e FROM z) SELECT user_id, CAST(isl AS BIGINT) AS island, floor(s*10000+0.5)/10000 AS start_h, floor(CASE WHEN e <= s THEN least(720-0.05, s+4) ELSE e END*10000+0.5)/10000 AS end_h FROM q""")
def q28_pad_resize_windows(s, d):
    e = C.events(s, d).filter("event_type = 'click'")
    first = e.agg(F.min("t_us").alias("t0"))
    e = e.crossJoin(F.broadcast(first)).select("user_id", ((F.col("t_us") - F.col("t0")) / float(C.HOUR)).alias("t"))  # one row on the right
    m = intervals.gap_merge(e, ["user_id"], "t", "t", 24)
    a, b = intervals.padded(F.col("start"), F.col("end"), 0.5, 4.0, 72.0)
    a, b = intervals.clamped(a, b, F.lit(720.0))
    return m.select("user_id", "island", X.floored(a, 4).alias("start_h"), X.floored(b, 4).alias("end_h"))


@query(f"""WITH {C.EPI}, z AS (SELECT min(t_us) AS t0 FROM ev), c AS (SELECT user_id, (s-t0)/3600000000.0-1.5 AS s, (e-t0)/3600000000.0+1.5 AS e FROM epi, z WHERE n > 1), r AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c),
g AS (SELECT user_id, greatest(0, coalesce(reach, 0)) AS a, least(s, 720) AS b FROM r UNION ALL SELECT user_id, greatest(0, max(e)), 720 FROM c GROUP BY 1) SELECT user_id, floor(a*10000+0.5)/10000 AS gap_start, floor(b*10000+0.5)/10000 AS gap_end FROM g WHERE b - a > 2""")
def q29_interval_complement(s, d):
    first = C.events(s, d).agg(F.min("t_us").alias("t0"))
    e = C.episodes(s, d).filter("n > 1").crossJoin(F.broadcast(first))  # one row on the right
    e = e.select("user_id", ((F.col("start") - F.col("t0")) / float(C.HOUR)).alias("s0"), ((F.col("end") - F.col("t0")) / float(C.HOUR)).alias("e0"))
    g = intervals.complement(e, ["user_id"], "s0", "e0", F.lit(720.0), 1.5, 2.0)
    return g.select("user_id", X.floored(F.col("gap_start"), 4).alias("gap_start"), X.floored(F.col("gap_end"), 4).alias("gap_end"))


@query("""WITH c AS (SELECT o_custkey, epoch_us(min(o_orderdate))//86400000000 AS lo, epoch_us(max(o_orderdate))//86400000000 AS hi FROM orders GROUP BY 1), n AS (SELECT *, CAST(floor(least(160, greatest(3, (hi-lo)/300.0))) AS INTEGER) AS n FROM c)
SELECT o_custkey, n, k, CAST(trunc(lo + (hi-lo)*k/CAST(greatest(n-1,1) AS DOUBLE)) AS BIGINT) AS day FROM (SELECT *, unnest(range(n)) AS k FROM n)""")
def q30_uniform_grid_samples(s, d):
    day = F.expr("unix_micros(cast(o_orderdate as timestamp)) div 86400000000")
    c = C.table(s, d, "orders").groupBy("o_custkey").agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
    c = c.withColumn("n", F.least(F.lit(160), F.greatest(F.lit(3), (F.col("hi") - F.col("lo")) / 300)).cast("int"))
    step = intervals.grid(F.col("n"), F.col("lo").cast("double"), F.col("hi").cast("double"))
    return c.select("o_custkey", "n", F.posexplode(step).alias("k", "day")).withColumn("k", F.col("k").cast("long"))


@query("""WITH r AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY md5('s'||doc_id), doc_id) AS r, count(*) OVER (PARTITION BY source, lang) AS n FROM documents),
c AS (SELECT source, count(*) AS m FROM documents GROUP BY 1), w AS (SELECT source, sqrt(sum(m) OVER () / CAST(count(*) OVER () * m AS DOUBLE)) AS w FROM c)
SELECT r.doc_id, CASE WHEN n > 1 AND r <= greatest(1, floor(n*0.2)) THEN 'val' ELSE 'train' END AS part, r <= 30 AS capped, floor(least(w / (SELECT min(w) FROM w), 4)*1000000+0.5)/1000000 AS weight FROM r JOIN w USING (source)""")
def q31_group_split_balance(s, d):
    docs = C.table(s, d, "documents").select("doc_id", "source", "lang")
    out = sample.split(docs, ["source", "lang"], "doc_id", 0.2).withColumn("capped", sample.shuffled(["source", "lang"], "doc_id", "s") <= 30)
    w = sample.class_weights(docs.groupBy("source").agg(F.count("*").alias("n")))
    return out.join(w, "source").select("doc_id", "part", "capped", X.floored(F.col("weight"), 6).alias("weight"))


_CAP = "CASE WHEN event_id % 7 = 0 THEN event_type || ' seen.' ELSE event_type || ' identified (confidence ' || CAST(floor(value)/500 AS DECIMAL(10,2)) || ').' END"


@query(f"WITH {C.EV}, c AS (SELECT event_id, {_CAP} AS t FROM ev) SELECT event_id, coalesce(TRY_CAST(nullif(regexp_extract(t, 'confidence[ :]*([0-9.]*)', 1), '') AS DOUBLE), 0) AS c0, coalesce(TRY_CAST(nullif(trim(regexp_extract(t, 'confidence[ (]*([^)]*)', 1)), '') AS DOUBLE), 1) AS c1, length(t) >= 20 AS explains FROM c")
def q32_conf_from_text(s, d):
    e = C.events(s, d)
    t = F.when(F.col("event_id") % 7 == 0, F.concat("event_type", F.lit(" seen."))).otherwise(F.concat("event_type", F.lit(" identified (confidence "), (F.floor("value") / 500).cast("decimal(10,2)").cast("string"), F.lit(").")))
    return e.select("event_id", t.alias("t")).select("event_id", X.confidence(F.col("t")).alias("c0"), X.confidence_in_brackets(F.col("t")).alias("c1"), X.explanation(F.col("t")).isNotNull().alias("explains"))


@query(r"""WITH s AS (SELECT doc_id, lang, trim(text, chr(32)) AS t FROM documents), h AS (SELECT *, substr(t,1,500) AS h FROM s),
p AS (SELECT *, CASE WHEN contains(h,'. ') THEN 500 - strpos(reverse(h),' .') - 1 ELSE -1 END AS a, CASE WHEN contains(h,'! ') THEN 500 - strpos(reverse(h),' !') - 1 ELSE -1 END AS b, CASE WHEN contains(h,'? ') THEN 500 - strpos(reverse(h),' ?') - 1 ELSE -1 END AS c FROM h)
SELECT doc_id, CASE WHEN length(t) < 20 THEN 'a '||lang||' text' WHEN length(t) <= 500 THEN t WHEN a >= 40 THEN substr(t,1,a+1) WHEN b >= 40 THEN substr(t,1,b+1) WHEN c >= 40 THEN substr(t,1,c+1) ELSE rtrim(substr(t,1,499), chr(32)) || '.' END AS description FROM p""")
def q33_clean_description(s, d):
    docs = C.table(s, d, "documents")
    return docs.select("doc_id", X.clean_description(F.col("text"), F.concat(F.lit("a "), "lang", F.lit(" text"))).alias("description"))


def _label_sql() -> str:
    chain = " ".join(f"WHEN contains(h,'{w}') THEN '{label}'" for w, label in X.HAZARD_LABEL.items())
    kinds = " ".join(f"WHEN kind='{k}' THEN '{v}'" for k, v in X.KIND_LABEL.items())
    real = " OR ".join(f"contains(h,'{w}')" for w in X.REAL_HAZARDS)
    names = ",".join(f"'{k}'" for k in X.KIND_LABEL)
    return f"""WITH {C.EV}, k AS (SELECT event_id, ([{names}])[event_id % 6 + 1] AS kind, lower(([' ','Dense smoke','none','a FIGHT near water','drain blocked','idle'])[event_id % 5 + 1]) AS h FROM ev)
SELECT event_id, CASE {chain} {kinds} END AS label, CASE WHEN trim(h) IN ('','none','n/a','nothing') THEN false ELSE {real} END AS hazard FROM k"""


@query(_label_sql())
def q34_keyword_conflict_hazard(s, d):
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), (F.col("event_id") % n).cast("int"))
    k = C.events(s, d).select("event_id", pick(list(X.KIND_LABEL), 6).alias("kind"), pick([" ", "Dense smoke", "none", "a FIGHT near water", "drain blocked", "idle"], 5).alias("h"))
    return k.select("event_id", X.label_of(F.col("kind"), F.col("h")).alias("label"), X.real_hazard(F.col("h")).alias("hazard"))


@query(f"WITH {C.EV} SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM ev")
def q35_json_salvage(s, d):
    raw = F.when(F.col("event_id") % 11 == 0, F.concat(F.lit("no "), F.expr("replace(props, '}', '')"))).otherwise(F.concat(F.lit("Sure: "), "props", F.lit(" done")))
    return C.events(s, d).select("event_id", X.salvaged_json(raw, "k bigint")["k"].alias("k"))


@query(f"""WITH RECURSIVE {C.EV}, o AS (SELECT user_id, t_us FROM ev), f AS (SELECT user_id, min(t_us) AS t FROM o GROUP BY 1 UNION ALL SELECT f.user_id, (SELECT min(t_us) FROM o WHERE o.user_id=f.user_id AND o.t_us - f.t >= {12 * C.HOUR}) FROM f WHERE f.t IS NOT NULL)
SELECT user_id, count(t) AS fired, CAST(sum(t // 1000000) AS BIGINT) AS checksum FROM f GROUP BY 1""")
def q36_cooldown_fold(s, d):
    kept = intervals.cooldown(C.events(s, d), ["user_id"], "t_us", 12 * C.HOUR)
    return kept.groupBy("user_id").agg(F.count("*").alias("fired"), F.sum(F.floor(F.col("t_us") / 1000000)).alias("checksum"))


@query()
def q37_tracker_events(s, d):
    return tracker.run(tracker.scenarios(s), tracker.LANE).select("video_id", "frame_idx", "t", "kind", "track_id", "anomalous", "severity", "context")


@query("""WITH o AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT c_custkey, 1 + c_custkey % 3 AS level, coalesce(n, 0) AS orders, CASE WHEN c_custkey % 10 = 0 THEN 'patched' WHEN n IS NULL THEN 'normal' ELSE 'ordered' END AS label FROM customer LEFT JOIN o ON c_custkey = o_custkey""")
def q38_default_completion_patch(s, d):
    base = C.table(s, d, "customer").select("c_custkey", (1 + F.col("c_custkey") % 3).alias("level"))
    n = C.table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    rows = base.join(n, "c_custkey", "left").select("c_custkey", "level", F.coalesce("orders", F.lit(0)).alias("orders"), F.when(F.col("orders").isNull(), "normal").otherwise("ordered").alias("label"))
    return assemble.patch(rows, rows.filter("c_custkey % 10 = 0").withColumn("label", F.lit("patched")), "c_custkey")


@query(f"""WITH {C.EV}, p AS (SELECT user_id AS id, CASE WHEN event_id % 50=0 THEN 'ufo' WHEN event_id % 60=0 THEN 'normal' ELSE 'fire' END AS label, value AS s, CASE WHEN event_id % 40=0 THEN value-1 ELSE value+5 END AS e FROM ev WHERE event_type='click')
SELECT 'unknown_class' AS rule, count(*) AS n FROM p WHERE label='ufo' UNION ALL SELECT 'normal_as_class', count(*) FROM p WHERE label='normal' UNION ALL SELECT 'end_before_start', count(*) FROM p WHERE e <= s UNION ALL SELECT 'negative_start', count(*) FROM p WHERE s < 0
UNION ALL SELECT 'missing_id', count(DISTINCT user_id) FROM ev WHERE user_id NOT IN (SELECT id FROM p) UNION ALL SELECT 'duplicate_event', CAST(coalesce(sum(c-1),0) AS BIGINT) FROM (SELECT count(*) AS c FROM p GROUP BY id, label, floor(s*1000+0.5), floor(e*1000+0.5))""")
def q39_validator(s, d):
    e = C.events(s, d)
    k = F.col("event_id")
    p = e.filter("event_type = 'click'").select(F.col("user_id").alias("id"), F.when(k % 50 == 0, "ufo").when(k % 60 == 0, "normal").otherwise("fire").alias("label"), F.col("value").alias("start"), F.when(k % 40 == 0, F.col("value") - 1).otherwise(F.col("value") + 5).alias("end"))
    return assemble.violations(p, e.select(F.col("user_id").alias("id")).distinct())


@query(f"WITH {C.EV} SELECT event_type, count(*) AS n, floor(avg(value)*10000+0.5)/10000 AS mean_ms, floor(quantile_cont(value,0.5)*10000+0.5)/10000 AS p50_ms, floor(quantile_cont(value,0.95)*10000+0.5)/10000 AS p95_ms, max(value) AS max_ms, floor(100.0*count(*) FILTER (value > 100)/count(*)*100+0.5)/100 AS trigger_rate FROM ev GROUP BY 1")
def q40_latency_summary(s, d):
    pct = lambda q: X.floored(F.percentile("value", F.lit(q)), 4)
    return C.events(s, d).groupBy("event_type").agg(F.count("*").alias("n"), X.floored(F.avg("value"), 4).alias("mean_ms"), pct(0.5).alias("p50_ms"), pct(0.95).alias("p95_ms"), F.max("value").alias("max_ms"), X.floored(100.0 * F.count_if(F.col("value") > 100) / F.count("*"), 2).alias("trigger_rate"))


@query(f"""WITH RECURSIVE {C.IVS}, {C.GREEDY.format(gate=0.5)}, u AS (SELECT DISTINCT user_id FROM ev), tl AS (SELECT user_id, count(*) AS t FROM gt GROUP BY 1), pl AS (SELECT user_id, count(*) AS p FROM pr GROUP BY 1), m AS (SELECT user_id, len(ts) AS m, list_avg(ious) AS iou FROM done),
a AS (SELECT user_id, coalesce(t,0) AS t, coalesce(p,0) AS p, coalesce(m,0) AS m, coalesce(iou,0) AS iou FROM u LEFT JOIN tl USING (user_id) LEFT JOIN pl USING (user_id) LEFT JOIN m USING (user_id))
SELECT user_id, t AS n_truth, p AS n_pred, m AS matched, p - m AS false_alarms, floor(CASE WHEN t=0 THEN CASE WHEN p=0 THEN 1 ELSE 0 END ELSE 0.2*CASE WHEN p>0 THEN 1 ELSE 0 END + 0.5*m/t + 0.3*iou END*1000000+0.5)/1000000 AS level2,
floor(CASE WHEN t=0 THEN CASE WHEN p=0 THEN 1 ELSE 0 END ELSE 0.2*CASE WHEN p>0 THEN 1 ELSE 0 END + 0.4*m/t + 0.4*iou END*1000000+0.5)/1000000 AS level3,
CAST(CASE WHEN (t>0) = (p>0) THEN 0.5 ELSE 0.0 END + CASE WHEN t>0 THEN CASE WHEN m>0 THEN 0.5 ELSE 0.0 END ELSE CASE WHEN p=0 THEN 0.5 ELSE 0.0 END END AS DOUBLE) AS level1 FROM a""")
def q41_level_scores(s, d):
    users = C.events(s, d).select("user_id").distinct()
    all_ = marks.timed_counts(users, C.intervals(s, d, "purchase"), C.intervals(s, d, "click"), "user_id", ["user_id"])
    some = lambda c, label: F.when(c, F.array(F.lit(label))).otherwise(F.array().cast("array<string>"))
    pred = F.when(F.col("n_pred") > 0, F.when(F.col("matched") > 0, F.array(F.lit("hit"))).otherwise(F.array(F.lit("other")))).otherwise(F.array().cast("array<string>"))
    one = score.level_one(all_.withColumns({"truth": some(F.col("n_truth") > 0, "hit"), "pred": pred}))
    return one.select("user_id", "n_truth", "n_pred", "matched", "false_alarms", *(X.floored(marks.timed_score(k), 6).alias(f"level{k}") for k in (2, 3)), F.col("score").alias("level1"))


@query(f"""WITH {C.EPI}, u AS (SELECT DISTINCT user_id FROM ev) SELECT u.user_id, count(epi.n) AS events, coalesce(string_agg(event_type || '@' || (s // 1000000), ';' ORDER BY s, event_type), '') AS listed, CAST(coalesce(sum(n),0) AS BIGINT) AS frames FROM u LEFT JOIN epi ON u.user_id=epi.user_id AND n > 2 GROUP BY 1""")
def q42_nested_submission(s, d):
    ids = C.events(s, d).select(F.col("user_id").alias("video_id")).distinct()
    ev = C.episodes(s, d).filter("n > 2").select(F.col("user_id").alias("video_id"), F.col("event_type").alias("class_name"), "start", "end", "n")
    doc = assemble.documents(ids, ev, more=["n"])  # ordered by microseconds, so seconds are cut behind it
    flat = F.transform("events", lambda e: F.concat_ws("@", e["class_name"], F.call_function("div", e["start"], F.lit(1_000_000)).cast("string")))
    return doc.select(F.col("video_id").alias("user_id"), F.size("events").cast("long").alias("events"), F.array_join(flat, ";").alias("listed"), F.aggregate("events", F.lit(0).cast("long"), lambda a, e: a + e["n"]).alias("frames"))


def queries() -> dict[str, Query]:
    from . import more_queries  # noqa: F401

    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    from . import more_queries  # noqa: F401

    return dict(_S)
