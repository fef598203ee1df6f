from pyspark.sql import functions as F

from episodic.operators import motion


def test_affine_products(spark):
    rows = [("v", 0, [1.0, 0.0, 2.0, 0.0, 1.0, 3.0]), ("v", 1, None), ("v", 2, [0.0, -1.0, 0.0, 1.0, 0.0, 0.0]), ("w", 5, [2.0, 0.0, 0.0, 0.0, 2.0, 1.0])]
    frames = spark.createDataFrame(rows, "v string, k long, m array<double>")
    got = {(r.v, r.k): r.total for r in motion.cumulative_affine(frames, "v", "k", "m").collect()}
    assert got == {("v", 0): [1, 0, 2, 0, 1, 3], ("v", 1): [1, 0, 2, 0, 1, 3], ("v", 2): [0, -1, -3, 1, 0, 2], ("w", 5): [2, 0, 0, 0, 2, 1]}


def test_camera_and_picks(spark):
    frames = spark.range(20).select(F.lit("v").alias("v"), F.col("id").alias("k"), F.when(F.col("id") < 10, 0.0).otherwise(3.0).alias("s"), (F.col("id") == 7).cast("double").alias("m"))
    flags = [r.camera_moving for r in motion.camera_moves(frames, "v", "k", "s", rows=3).orderBy("k").collect()]
    assert flags == [False] * 11 + [True] * 9
    picked = {r.k for r in motion.picked_frames(frames, "v", "k", "m", 5).collect()}
    assert len(picked) == 5 and {0, 7, 19} <= picked
    assert sum(motion.shard(frames, "k", 3, i).count() for i in range(3)) == 20
    assert motion.stale(frames, frames.filter("k > 3"), ["v", "k"]).count() == 4
