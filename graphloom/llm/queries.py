"""The queries of this subpackage and, where SQL can express them, their DuckDB counterparts.

Each query covers its whole tables and whole texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import anchors, decontaminate, mixing, neardup, phrases, quality, secrets, shards, suffixes, toxicity
from .base import read


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_benchmark_leaks": lambda spark, d: decontaminate.leaks(read(spark, d, "documents"), read(spark, d, "benchmark")),
        "op2_toxicity_neighbours": lambda spark, d: toxicity.flagged(read(spark, d, "documents"), read(spark, d, "labels")),
        "op3_mix_sources": lambda spark, d: mixing.query(read(spark, d, "documents")),
        "op4_secret_ownership": lambda spark, d: secrets.scan(read(spark, d, "documents")),
        "op5_quality_ranking": lambda spark, d: quality.ranked(read(spark, d, "documents"), read(spark, d, "labels")),
        "op6_near_duplicates": lambda spark, d: neardup.groups(read(spark, d, "documents")),
        "op7_jump_shards": lambda spark, d: shards.query(read(spark, d, "documents")),
        "op8_phrase_fingerprints": lambda spark, d: phrases.alike(read(spark, d, "documents")),
        "op9_suffix_repeats": lambda spark, d: suffixes.repeated(read(spark, d, "documents")),
        "op10_anchor_repeats": lambda spark, d: anchors.repeated(read(spark, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_mix_sources": mixing.sql(), "op4_secret_ownership": secrets.sql(), "op7_jump_shards": shards.sql()}
