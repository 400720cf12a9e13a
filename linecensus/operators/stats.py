"""Aggregates over per-file counts and the orders they are reported in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COUNTS = ("lines", "code", "comments", "blanks", "bytes")


def _sums():
    return [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in COUNTS]


def language_stats(file_stats: DataFrame) -> DataFrame:
    """name, files, lines, code, comments, blanks, bytes per language.

    Partial aggregation leaves at most 51 rows per task for the shuffle, so a language that holds
    most files costs no more than a rare one.
    """
    return file_stats.groupBy(F.col("language").alias("name")).agg(
        F.count("*").alias("files"), *_sums()
    )


def grand_total(language_stats: DataFrame) -> DataFrame:
    """Per-language rows and the total row (name = 'Total', is_total = 1) in one rollup.

    It runs on the language rows, not on the files, so the rollup doubles 51 rows only.
    """
    rolled = language_stats.rollup("name").agg(
        F.grouping("name").cast("int").alias("is_total"),
        F.coalesce(F.sum("files"), F.lit(0)).cast("bigint").alias("files"),
        *_sums(),
    )
    name = F.when(F.col("is_total") == 1, "Total").otherwise(F.col("name"))
    return rolled.withColumn("name", name)


def total(language_stats: DataFrame) -> DataFrame:
    """One row: files and counts over all languages (zeros when there are none)."""
    return language_stats.agg(
        F.coalesce(F.sum("files"), F.lit(0)).cast("bigint").alias("files"), *_sums()
    )


def merge_stats(left: DataFrame, right: DataFrame) -> DataFrame:
    """Element-wise sum of two per-language results, e.g. of two separately counted corpora."""
    return (
        left.unionByName(right)
        .groupBy("name")
        .agg(F.sum("files").cast("bigint").alias("files"), *_sums())
    )


def stats_delta(removed: DataFrame, added: DataFrame) -> DataFrame:
    """What per-language results gain by files `added` and lose by files `removed`; numbers may be negative."""
    gained = added.select("language", F.lit(1).alias("files"), *COUNTS)
    lost = removed.select("language", F.lit(-1).alias("files"), *[F.negative(c).alias(c) for c in COUNTS])
    both = gained.unionByName(lost).groupBy(F.col("language").alias("name"))
    return both.agg(F.coalesce(F.sum("files"), F.lit(0)).cast("bigint").alias("files"), *_sums())


def fold_totals(totals: DataFrame, delta: DataFrame) -> DataFrame:
    """Per-language totals after a `stats_delta`; a language without files left is gone."""
    return merge_stats(totals, delta).filter("files <> 0")


def langs_by_code(language_stats: DataFrame) -> DataFrame:
    return language_stats.orderBy(F.desc("code"), "name")


def langs_by_files(language_stats: DataFrame) -> DataFrame:
    return language_stats.orderBy(F.desc("files"), "name")


def files_by_path(file_stats: DataFrame) -> DataFrame:
    return file_stats.orderBy("path")


def files_by_size(manifest: DataFrame) -> DataFrame:
    """Biggest file first."""
    return manifest.orderBy(F.desc("size"), "path")
