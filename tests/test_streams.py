"""Cooldowns by pointers against a plain fold, and ordered folds over streams against the batch."""

import random

import pytest
from pyspark.sql import functions as F

from episodic.operators import intervals, policy
from episodic.streaming import ordered

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def plain(rows, c):
    out, last = [], {}
    for k, t in sorted((r for r in rows if r[1] is not None), key=lambda r: (str(r[0]), r[1])):
        if k not in last or t - last[k] >= c:
            out.append((k, t))
            last[k] = t
    return sorted(out, key=repr)


def test_cooldown_by_pointers(spark):
    rng = random.Random(5)
    rows = [(k, rng.randrange(wide)) for k, n, wide in (("hot", 400, 900), (None, 60, 200), ("one", 1, 1), ("same", 30, 1), ("thin", 40, 9000)) for _ in range(n)] + [("one", None)]
    df = spark.createDataFrame(rows, "k string, t long")
    for c, size, most in ((1, 500_000, 1000), (10, 500_000, 1000), (10, 9, 1000), (64, 500_000, 3)):
        got = intervals.cooldown(df, ["k"], "t", c, size, most)
        assert sorted(((r.k, r.t) for r in got.collect()), key=repr) == plain(rows, c), (c, size, most)
    assert intervals.cooldown(df, ["k"], "t", 0).count() == len(rows) - 1
    assert intervals.cooldown(df.limit(0), ["k"], "t", 5).count() == 0
    assert "Python" not in intervals.cooldown(df.select("k", F.col("t")), ["k"], "t", 10)._jdf.queryExecution().toString()


def test_cooldown_of_a_hot_key(spark):
    """One key with nine rows in ten, too long for one array: rounds of joins, each pointer a row of its own."""
    df = spark.range(300_000).select(F.when(F.col("id") % 10 < 9, 0).otherwise(F.col("id")).alias("k"), (F.col("id") * 7919 % 300_007).alias("t"))
    got = intervals.cooldown(df, ["k"], "t", 1000, 20_000).filter("k = 0").agg(F.count("*"), F.min("t"), F.max("t")).first()
    times = sorted(t for k, t in plain([(0, r.t) for r in df.filter("k = 0").select("t").collect()], 1000))
    assert tuple(got) == (len(times), times[0], times[-1])


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    yield spark
    spark.conf.set(name, old)


def arrive(spark, path, parts, schema):
    """A stream that reads one part after the other."""
    import os
    for i, part in enumerate(parts):
        df = spark.createDataFrame(part, schema).withColumn("at", F.timestamp_micros("us")).drop("us").coalesce(1)
        df.write.mode("append").parquet(path)
        for f in os.listdir(path):
            if f.endswith(".parquet") and os.path.getmtime(os.path.join(path, f)) > 10**9:
                os.utime(os.path.join(path, f), (10**6 + i, 10**6 + i))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def ran(stream, tmp_path):
    name = "s" + str(abs(hash(str(tmp_path))))
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return q, stream.sparkSession.sql(f"select * from {name}").collect()


def shuffled(rows, rng, reach):
    """Parts of rows that arrive out of order by less than ``reach`` microseconds."""
    rows = sorted(rows, key=lambda r: r[-1] + rng.randrange(reach))
    return [rows[i:i + 40] for i in range(0, len(rows), 40)]


S = 1_000_000


def test_cooldown_stream(rocks, tmp_path):
    rng = random.Random(6)
    rows = [(rng.choice("aab"), 10**9 * S + rng.randrange(600 * S)) for _ in range(160)]
    parts = [*shuffled(rows, rng, 20 * S), [("end", 10**9 * S + 10_000 * S)], [("a", 10**9 * S), ("b", 10**9 * S + 5)], [("end", 10**9 * S + 20_000 * S)]]
    stream = ordered.cooldown_stream(arrive(rocks, str(tmp_path / "in"), parts, "k string, us long"), ["k"], "at", 7, "30 seconds")
    q, got = ran(stream, tmp_path)
    assert sorted((r.k, r.t_us) for r in got if not r.late and r.k != "end") == plain(rows, 7 * S)
    assert sorted((r.k, r.t_us) for r in got if r.late) == [("a", 10**9 * S), ("b", 10**9 * S + 5)]
    assert len(got) - 2 > 40 and q.lastProgress["stateOperators"][0]["customMetrics"]["numValueStateVars"] >= 0


def test_alerts_stream(rocks, tmp_path):
    rng = random.Random(7)
    frames = [("v", True, None, 10**9 * S + i * S // 2) for i in range(80)]
    alerts = [("v", False, rng.random(), 10**9 * S + rng.randrange(80) * S // 2) for _ in range(30)]
    parts = [*shuffled(frames + alerts, rng, 6 * S), [("end", True, None, 10**9 * S + 10_000 * S)], [("v", False, 0.5, 10**9 * S)], [("end", True, None, 10**9 * S + 20_000 * S)]]
    stream = ordered.alerts_shown_stream(arrive(rocks, str(tmp_path / "in"), parts, "k string, is_frame boolean, severity double, us long"), ["k"], "at", "10 seconds")
    _, got = ran(stream, tmp_path)
    frame = rocks.createDataFrame([(k, us / S - 10**9) for k, _, _, us in frames], "k string, t double")
    alert = rocks.createDataFrame([(k, us / S - 10**9, s) for k, _, s, us in alerts], "k string, t double, severity double")
    want = sorted((r.k, round(r.t * S) + 10**9 * S, r.alerts, r.severity) for r in policy.alerts_shown(frame, alert, ["k"]).collect())
    assert sorted((r.k, r.t_us, r.alerts, r.severity) for r in got if not r.late and r.k == "v") == want
    assert [(r.k, r.t_us, r.alerts) for r in got if r.late] == [("v", 10**9 * S, None)]
