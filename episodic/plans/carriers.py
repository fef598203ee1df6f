"""Stand-ins for the engine's inputs, derived from the driver's tables; SQL holds the same for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.decide import softmax
from ..operators.intervals import gap_merge

HOUR = 3_600_000_000
TYPES = ("click", "error", "purchase", "signup", "view")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("t_us", F.unix_micros(F.col("ts").cast("timestamp"))).drop("ts")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return e.select("event_id", (F.col("user_id") % 8).alias("stream_id"), F.col("user_id").alias("track_id"), "t_us", (F.col("event_id") * 37 % 1000).alias("x"), (F.col("event_id") * 53 % 600).alias("y"),
                    (20 + F.col("user_id") % 41).alias("w"), (20 + F.col("event_id") % 31).alias("h"), F.when(F.col("event_type").isin("view", "click"), "car").otherwise("person").alias("class_name"), F.col("value").alias("v"), "event_type")


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gap_merge(events(spark, sf_dir), ["user_id", "event_type"], "t_us", "t_us", 48 * HOUR, [F.avg("value").alias("mean")], tie=("event_id",))


def intervals(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Episodes of one type with more than one row, in hours."""
    e = episodes(spark, sf_dir).filter((F.col("event_type") == kind) & (F.col("n") > 1))
    return e.select("user_id", F.col("island").alias("id"), (F.col("start") / HOUR).alias("start"), (F.col("end") / HOUR).alias("end"))


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("truth"), softmax(F.slice("embedding", 1, 10)).alias("probs"))


def truth_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user, type) pairs with more than 11 events."""
    return events(spark, sf_dir).groupBy("user_id", F.col("event_type").alias("label")).count().filter("count > 11").select("user_id", "label")


def predicted_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types picked by the value of an event, for large values."""
    pick = F.get(F.array(*map(F.lit, TYPES)), (F.floor("value") % 5).cast("int"))
    return events(spark, sf_dir).filter("value > 150").select("user_id", pick.alias("label")).distinct()


EV = "ev AS (SELECT event_id, user_id, event_type, value, props, epoch_us(ts) AS t_us FROM events)"
OBS = EV + ", obs AS (SELECT event_id, user_id % 8 AS stream_id, user_id AS track_id, t_us, event_id*37 % 1000 AS x, event_id*53 % 600 AS y, 20 + user_id % 41 AS w, 20 + event_id % 31 AS h, CASE WHEN event_type IN ('view','click') THEN 'car' ELSE 'person' END AS class_name, value AS v, event_type FROM ev)"
EPI = EV + """, b AS (SELECT *, CASE WHEN t_us - lag(t_us) OVER w > 48*3600000000 OR lag(t_us) OVER w IS NULL THEN 1 ELSE 0 END AS brk FROM ev WINDOW w AS (PARTITION BY user_id, event_type ORDER BY t_us, event_id)),
i AS (SELECT *, CAST(sum(brk) OVER (PARTITION BY user_id, event_type ORDER BY t_us, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM b),
epi AS (SELECT user_id, event_type, island, min(t_us) AS s, max(t_us) AS e, count(*) AS n, avg(value) AS mean FROM i GROUP BY 1, 2, 3)"""
IVS = EPI + """, gt AS (SELECT user_id, island AS id, s/3600000000.0 AS s, e/3600000000.0 AS e FROM epi WHERE event_type='purchase' AND n > 1),
pr AS (SELECT user_id, island AS id, s/3600000000.0 AS s, e/3600000000.0 AS e FROM epi WHERE event_type='click' AND n > 1),
ov AS (SELECT g.user_id, g.id AS t_id, p.id AS p_id, g.s AS t0, g.e AS t1, greatest(0, least(g.e,p.e)-greatest(g.s,p.s)) / nullif((g.e-g.s)+(p.e-p.s)-greatest(0, least(g.e,p.e)-greatest(g.s,p.s)),0) AS iou FROM gt g JOIN pr p USING (user_id))"""
#: One-to-one matches by rank, with the used ids carried along: done(user_id, ts, ps, ious).
GREEDY = """pk AS (SELECT user_id, t_id, p_id, iou, row_number() OVER (PARTITION BY user_id ORDER BY iou DESC, t_id DESC, p_id DESC) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM ov WHERE iou >= {gate}),
mt AS (SELECT user_id, CAST(0 AS BIGINT) AS r, CAST([] AS BIGINT[]) AS ts, CAST([] AS BIGINT[]) AS ps, CAST([] AS DOUBLE[]) AS ious, any_value(n) AS n FROM pk GROUP BY 1 UNION ALL
SELECT mt.user_id, pk.r, CASE WHEN list_contains(ts, t_id) OR list_contains(ps, p_id) THEN ts ELSE list_append(ts, t_id) END, CASE WHEN list_contains(ts, t_id) OR list_contains(ps, p_id) THEN ps ELSE list_append(ps, p_id) END,
CASE WHEN list_contains(ts, t_id) OR list_contains(ps, p_id) THEN ious ELSE list_append(ious, pk.iou) END, mt.n FROM mt JOIN pk ON pk.user_id=mt.user_id AND pk.r=mt.r+1), done AS (SELECT * FROM mt WHERE r = n)"""
PROBS = """x AS (SELECT vec_id, label AS truth, unnest(range(10)) AS c, CAST(unnest(embedding[1:10]) AS DOUBLE) AS z FROM embeddings),
ex AS (SELECT vec_id, truth, c, exp(z - max(z) OVER (PARTITION BY vec_id)) AS e FROM x), pb AS (SELECT vec_id, truth, c, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM ex)"""
TRUE = EV + ", tl AS (SELECT user_id, event_type AS label FROM ev GROUP BY 1, 2 HAVING count(*) > 11), pl AS (SELECT DISTINCT user_id, (['click','error','purchase','signup','view'])[CAST(floor(value) AS BIGINT) % 5 + 1] AS label FROM ev WHERE value > 150)"
