"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

A target is given to every source: weights share ``share`` times all words, a source stops at
``cap`` times its own words, and what it leaves is shared again by weight. Each source is cut
into blocks of documents by a seeded hash, and every pass over a source (epoch) permutes its
blocks. A source gives whole epochs and then blocks of one more epoch until its target is
reached; the document at that point is cut between two words, so the words taken meet the
target exactly (rounded to a word), and no document exceeds ``cap`` times its size.

The blocks a source gives are its exact quota. A binary tree deals the quotas out to the
output shards: a node gives half of its blocks to its left child, and how many of each source
these are is a multivariate hypergeometric draw, made by selecting blocks one after another
with the chance (still wanted) / (still left). At the leaves each source's permuted blocks
are cut by the quotas, so shards hold disjoint blocks; inside a shard documents are ordered
by a hash. All draws are hashes of the seed, so a rerun gives the same mix.

Sources are ordered by code point, null last. Null text has no words. Documents without words
take part with size 0. Rows that repeat doc_id and text are alike: which of them is cut at the
target is open, how many are is not. An empty table gives an empty result. Columns beyond doc_id,
source and text are not read; the shards carry them, but for epoch, shard, place and words. Of a
long text only the number of its words is kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .common import KEYS, checkpoint, keyed, text_of, unpacked, words_of

MOST_UNITS = 1 << 20  # blocks grow with the corpus so that no more than about so many exist
BROADCAST_ROWS = 100_000


def _unit(*parts: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def sized(df: DataFrame) -> DataFrame:
    """doc_id, row key, source and number of words of each row."""
    return keyed(df).select(F.col("row")["doc_id"].alias("doc_id"), *KEYS, F.col("row")["source"].alias("source"), F.size(words_of(text_of())).cast("long").alias("size"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, block_words: int = 1 << 16) -> DataFrame:
    """One row for each source: sid (rank), source, source_size, target, n_blocks.

    With sources ordered by cap / weight, the level that k full sources leave to the others is
    (budget - their caps) / (other weights); the largest such level is the one at which none is above.
    """
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    every, order = W.partitionBy(), W.orderBy(F.col("source").asc_nulls_last())
    each = each.withColumn("sid", F.row_number().over(order))
    each = each.withColumn("weight", F.get(F.array(*(F.lit(float(w)) for w in weights)), (F.col("sid") - 1) % len(weights)))
    each = each.withColumns({"full": F.col("source_size") * cap, "total": F.sum("source_size").over(every)})
    before = W.orderBy(F.col("full") / F.col("weight"), "sid").rowsBetween(W.unboundedPreceding, -1)
    left = F.col("total") * share - F.coalesce(F.sum("full").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    each = each.withColumn("level", left / open_weight).withColumn("level", F.max("level").over(every))
    block = F.greatest(F.lit(block_words), F.ceil(F.col("total") / MOST_UNITS))
    return each.select("sid", "source", "source_size", F.least("full", F.col("level") * F.col("weight")).alias("target"),
                       F.greatest(F.lit(1), F.ceil(F.greatest("source_size", "docs") / block)).cast("long").alias("n_blocks"), "total")


def split_quotas(quotas: DataFrame, levels: int, seed: int) -> DataFrame:
    """Deals quotas (sid, n) out to 2**levels shards: rows shard, sid, n."""
    nodes = quotas.filter("n > 0").select(F.lit(0).cast("long").alias("node"), "sid", "n")
    for level in range(levels):
        kin = nodes.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("sid", "n"))).alias("kin"), F.sum("n").alias("all"))
        none = F.array().cast("array<struct<sid:int,n:bigint,left:bigint>>")
        start = F.struct(F.col("all").alias("all"), F.floor(F.col("all") / 2).alias("want"), none.alias("out"))

        def choose(state: Column, x: Column) -> Column:
            first = F.struct(state["all"].alias("all"), state["want"].alias("want"), F.lit(0).cast("long").alias("k"))
            drawn = F.aggregate(F.sequence(F.lit(1).cast("long"), x["n"]), first, lambda s, j: F.when(
                _unit(F.lit(seed), F.lit(level), F.col("node"), x["sid"], j) * s["all"] < s["want"],
                F.struct((s["all"] - 1).alias("all"), (s["want"] - 1).alias("want"), (s["k"] + 1).alias("k")))
                .otherwise(F.struct((s["all"] - 1).alias("all"), s["want"].alias("want"), s["k"].alias("k"))))
            return F.struct(drawn["all"].alias("all"), drawn["want"].alias("want"), F.array_append(
                state["out"], F.struct(x["sid"].alias("sid"), x["n"].alias("n"), drawn["k"].alias("left"))).alias("out"))

        split = kin.select("node", F.explode(F.aggregate("kin", start, choose, lambda s: s["out"])).alias("x"))
        side = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("x.sid").alias("sid"), F.col("x.left").alias("n")),
                       F.struct((F.col("node") * 2 + 1).alias("node"), F.col("x.sid").alias("sid"), (F.col("x.n") - F.col("x.left")).alias("n")))
        nodes = split.select(F.explode(side).alias("y")).select("y.*").filter("n > 0")
    return nodes.select(F.col("node").alias("shard"), "sid", "n")


def mix(df: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0,
        block_words: int = 1 << 16, shard_words: int = 1 << 24, seed: int = 17) -> DataFrame:
    """Rows doc_id, d, t, u (row keys), source, size, source_size, target, taken, places.

    ``places``: for each time the document is taken the epoch, shard, place in the shard's order, and words.
    """
    base = checkpoint(sized(df))
    plan = checkpoint(targets(base, weights, share, cap, block_words))
    n_sources, words = plan.agg(F.count("*"), F.max("total")).first()
    levels = max(0, math.ceil(math.log2(max(1, share * (words or 0) / shard_words))))
    wanted = F.floor(F.col("target") + 0.5).cast("long")
    plan = plan.withColumn("epochs", F.coalesce(F.floor(F.try_divide(wanted, "source_size")), F.lit(0)).cast("long"))
    plan = plan.withColumn("rest", wanted - F.col("epochs") * F.col("source_size"))
    few = F.broadcast(plan) if n_sources <= BROADCAST_ROWS else plan
    docs = base.join(few.select(F.col("source").alias("_s"), "sid", "source_size", "target", "n_blocks", "epochs", "rest"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    place = F.xxhash64(F.lit(seed), *KEYS)
    docs = docs.withColumns({"h": place, "block": F.floor((F.shiftrightunsigned(place, 11) / F.lit(float(1 << 53))) * F.col("n_blocks")).cast("long")})
    run = W.partitionBy("sid", "block").orderBy("h").rowsBetween(W.unboundedPreceding, -1)
    docs = docs.withColumn("before", F.coalesce(F.sum("size").over(run), F.lit(0)))
    blocks = docs.groupBy("sid", "block").agg(F.sum("size").alias("words"), F.first("epochs").alias("epochs"), F.first("rest").alias("rest"))
    turn = lambda e: F.xxhash64(F.lit(seed), F.lit("epoch"), e, "sid", "block")
    last = W.partitionBy("sid").orderBy(turn(F.col("epochs")), "block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumn("offset", F.coalesce(F.sum("words").over(last), F.lit(0)))
    part = F.greatest(F.lit(0), F.least(F.col("words"), F.col("rest") - F.col("offset")))
    blocks = blocks.withColumn("epochs_in", F.when(F.col("words") > 0, F.col("epochs") + (part > 0).cast("long")).otherwise(0))
    units = blocks.filter("epochs_in > 0").select("sid", "block", F.explode(F.sequence(F.lit(1).cast("long"), F.col("epochs_in"))).alias("epoch"))
    dealt = W.partitionBy("sid").orderBy("epoch", turn(F.col("epoch") - 1), "block")
    units = units.withColumn("i", F.row_number().over(dealt).cast("long"))
    leaves = split_quotas(units.groupBy("sid").agg(F.count("*").alias("n")), levels, seed)
    upto = F.sum("n").over(W.partitionBy("sid").orderBy("shard"))
    leaves = leaves.withColumn("to", upto).select("sid", "shard", F.explode(F.sequence(F.col("to") - F.col("n") + 1, F.col("to"))).alias("i"))
    shards = units.join(leaves, ["sid", "i"]).groupBy("sid", "block").agg(F.sort_array(F.collect_list(F.struct("epoch", "shard"))).alias("shards"))
    blocks = blocks.select("sid", "block", "offset").join(shards, ["sid", "block"], "left")
    docs = docs.join(blocks, ["sid", "block"], "left")
    rest = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("offset") - F.col("before")))
    took = lambda e: F.when(e <= F.col("epochs"), F.col("size")).otherwise(rest)
    places = F.filter(F.transform(F.coalesce("shards", F.array().cast("array<struct<epoch:bigint,shard:bigint>>")), lambda x: F.struct(
        x["epoch"].alias("epoch"), x["shard"].alias("shard"), F.xxhash64(F.lit(seed), x["shard"], x["epoch"], *KEYS).alias("place"),
        took(x["epoch"]).alias("words"))), lambda x: x["words"] > 0)
    return docs.select("doc_id", *KEYS, "source", "size", "source_size", "target",
                       (F.col("epochs") * F.col("size") + F.when(F.col("size") > 0, rest).otherwise(0)).cast("long").alias("taken"), places.alias("places"))


def write_shards(df: DataFrame, mixed: DataFrame, path: str) -> None:
    """Writes the mix: a folder for each shard, documents in the shard's shuffled order, cut where the mix cuts them."""
    each = mixed.select(*KEYS, F.explode("places").alias("p")).select(*KEYS, "p.*")
    full = keyed(df).dropDuplicates(list(KEYS)).join(each, list(KEYS))
    cut = F.array_join(F.slice(words_of(text_of()), 1, F.col("words").cast("int")), " ")
    whole = F.size(words_of(text_of())) == F.col("words")
    out = full.select(*unpacked(df.columns, text=F.when(whole, F.col("text")).otherwise(cut), **{c: c for c in ("epoch", "shard", "place", "words")}))
    out.repartition("shard").sortWithinPartitions("shard", "place").write.partitionBy("shard").parquet(path)


def digest(df: DataFrame) -> DataFrame:
    shards = F.transform("places", lambda p: p["shard"])
    return mix(df).select("doc_id", "size", "source_size", "target", "taken", shards.alias("shards"))
