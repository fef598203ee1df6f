"""The queries of this folder and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontamination, html, lexical, licenses, linedup, middles, mixing, quality, repeats, secrets, simhash, suffixes

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Query]:
    return {
        "op1_line_dedup": lambda s, d: linedup.digest(table(s, d, "documents")),
        "op2_secret_scan": lambda s, d: secrets.digest(table(s, d, "documents")),
        "op3_mix_sources": lambda s, d: mixing.digest(table(s, d, "documents")),
        "op4_repeated_passages": lambda s, d: repeats.digest(table(s, d, "documents")),
        "op5_chat_format": lambda s, d: chat.digest(table(s, d, "conversations")),
        "op6_quality_rules": lambda s, d: quality.digest(table(s, d, "documents"), table(s, d, "labels")),
        "op7_decontaminate": lambda s, d: decontamination.digest(table(s, d, "documents"), table(s, d, "benchmark")),
        "op10_license_scan": lambda s, d: licenses.digest(table(s, d, "documents")),
        "op8_main_text": lambda s, d: html.digest(table(s, d, "pages")),
        "op9_simhash_groups": lambda s, d: simhash.digest(table(s, d, "documents")),
        "op11_fill_middle": lambda s, d: middles.digest(table(s, d, "documents")),
        "op12_suffix_dedup": lambda s, d: suffixes.digest(table(s, d, "documents")),
        "op13_ranked_search": lambda s, d: lexical.digest(table(s, d, "documents"), table(s, d, "benchmark")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_chat_format": chat.ORACLE, "op11_fill_middle": middles.ORACLE, "op13_ranked_search": lexical.ORACLE}
