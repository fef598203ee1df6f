"""A corpus pipeline: quality rules, line dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. Stages hand
over Parquet in the shared folder, so a lost executor never costs more than its stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from episodic.llm import decontamination, linedup, mixing, nearcopies, quality
from episodic.llm.common import KEYS, keyed, shared_folder, unpacked


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base or a certified rule."""
    return quality.filter_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that are similar to an earlier line; a document left without lines stays, empty."""
    out = linedup.remove_similar_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return nearcopies.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that cover a benchmark item."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix with the words taken from each and the shards they go to."""
    shards = F.transform("places", lambda p: p["shard"]).alias("shards")
    parts = F.sort_array(F.collect_list(F.struct("source", "size", "source_size", "target", "taken", shards))).alias("_parts")
    mixed = mixing.mix(docs).groupBy(*KEYS).agg(parts).filter(F.exists("_parts", lambda p: p["taken"] > 0))
    # Rows that repeat id and text are dealt the parts of their copies one by one, in the order of the sources on both sides.
    copy = F.row_number().over(W.partitionBy(*KEYS).orderBy(F.col("row")["source"]))
    dealt = keyed(docs).join(mixed, list(KEYS)).withColumn("_part", F.element_at("_parts", copy)).filter("_part.taken > 0")
    return dealt.select(*unpacked(docs.columns, **{c: F.col("_part")[c] for c in ("size", "source_size", "target", "taken", "shards")}))


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near dedup", near_dedup), ("decontamination", decontaminate), ("mixing", mix)]

#: SQL cannot express these stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
