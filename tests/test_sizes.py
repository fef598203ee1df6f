"""What shows only on larger tables: order within a second, ranges that are sampled."""

import datetime

from pyspark.sql import functions as F

from episodic.operators import motion, search
from episodic.queries import queries


def test_listed_by_microseconds(spark, tmp_path):
    at = lambda us: datetime.datetime(2024, 1, 1) + datetime.timedelta(microseconds=us)
    rows = [(k, at(us), 1, kind, 1.0, "{}") for k, (us, kind) in enumerate([(900_000, "click"), (900_001, "click"), (900_002, "click"), (100_000, "view"), (100_001, "view"), (100_002, "view")])]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    first = int((datetime.datetime(2024, 1, 1) - datetime.datetime(1970, 1, 1)).total_seconds())
    got = queries()["q42_nested_submission"](spark, str(tmp_path)).collect()
    assert [tuple(r[c] for c in ("user_id", "events", "listed", "frames")) for r in got] == [(1, 2, f"view@{first};click@{first}", 6)]


def test_shards_of_sampled_ranges(spark, tmp_path):
    """Of many rows the bounds of ranges are sampled, and sizes and places must come from the same sample."""
    n = 1_500_000
    spark.range(n).select(F.col("id").alias("o_orderkey"), (F.col("id") * 7919 % 15_000).alias("o_custkey")).write.parquet(f"{tmp_path}/orders.parquet")
    got = queries()["q90_resumed_shard"](spark, str(tmp_path)).toPandas()["o_orderkey"]
    assert sorted(got) == [k for k in range(n) if k % 3 or k * 7919 % 15_000 % 2][1::4]


def test_shards_of_equal_rows(spark):
    rows = spark.range(0, 5000, 1, 4).select((F.col("id") % 7).alias("k"), F.col("id").alias("other"))
    assert sorted(r.other for i in range(3) for r in motion.shard(rows, "k", 3, i).collect()) == list(range(5000))


def test_alike_videos_climb_once(spark, monkeypatch):
    """A thousand videos of four kinds: each step counts and moves four rows, and each video gets its kind's thresholds."""
    kinds = spark.range(1000).select(F.col("id").alias("v"), (F.col("id") % 4).cast("int").alias("kind"), (F.col("id") / 1e6).alias("e"))
    p = F.when(F.col("kind") < 2, F.array(F.lit(0.1), 0.6 + F.col("e"), F.lit(0.2))).otherwise(F.array(F.lit(0.5), 0.22 + F.col("e"), F.lit(0.28)))
    videos = kinds.select("v", "kind", F.array(F.when(F.col("kind") % 2 == 0, 1).otherwise(2)).alias("truth"), F.transform(p, lambda x, i: F.struct(x.alias("p"), i.alias("c"))).alias("probs"))
    sizes, kept = [], search.checkpointed
    monkeypatch.setattr(search, "checkpointed", lambda df: sizes.append(df.count()) or kept(df))
    got = search.retuned(videos, "v", 3, [0.2, 0.4], 0.2, 1).collect()
    assert sizes[0] == 1000 and set(sizes[1:]) == {4}
    assert len(got) == 1000 and {(r.v % 4, tuple(r.truth), tuple(r.picked)) for r in got} == {(0, (1,), (1,)), (1, (2,), (1,)), (2, (1,), (0,)), (3, (2,), (0,))}
