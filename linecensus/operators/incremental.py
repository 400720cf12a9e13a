"""Reuse of earlier per-file results: only new or changed files are counted again.

Cache rows: root_id, path, mtime (whole seconds), size, language, stats (struct), cached_at,
version. `path` is relative to the root and unique per root on both sides of every join here, so
no key is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linecensus.operators.stats import COUNTS, stats_delta

CACHE_VERSION = 1

CACHE_SCHEMA = (
    "root_id string, path string, mtime bigint, size bigint, language string, "
    "stats struct<lines: bigint, code: bigint, comments: bigint, blanks: bigint, bytes: bigint>, "
    "cached_at bigint, version int"
)

_KEY = ["root_id", "path"]


def root_id(root: Column) -> Column:
    """Identity of a corpus: md5 of its canonical root path."""
    return F.md5(root.cast("binary"))


def empty_cache(spark: SparkSession) -> DataFrame:
    """No entries. The limit lets the optimizer see that, and drop the join with them."""
    return spark.createDataFrame([], CACHE_SCHEMA).limit(0)


def cache_entries(file_stats: DataFrame, cached_at: int) -> DataFrame:
    """Cache rows for counted files; needs root_id, path, mtime, size and the counts, and keeps a `digest`."""
    return file_stats.select(
        "root_id",
        "path",
        "mtime",
        "size",
        "language",
        F.struct(*COUNTS).alias("stats"),
        F.lit(cached_at).cast("bigint").alias("cached_at"),
        F.lit(CACHE_VERSION).alias("version"),
        *[c for c in file_stats.columns if c == "digest"],
    )


def cache_validate(cache: DataFrame, root: str | Column) -> DataFrame:
    """Entries of the current version and of this root; anything else counts as no cache."""
    return cache.filter((F.col("version") == CACHE_VERSION) & (F.col("root_id") == root))


def cache_mode(cache: DataFrame, mode: str) -> DataFrame:
    """The cache a run starts from: all of it (reuse, verify), or nothing (fresh, rebuild)."""
    if mode not in ("reuse", "verify", "fresh", "rebuild"):
        raise ValueError(f"mode {mode!r}: expected reuse, verify, fresh or rebuild")
    return cache if mode in ("reuse", "verify") else cache.limit(0)


def cache_probe(manifest: DataFrame, cache: DataFrame, replaced: bool = False) -> DataFrame:
    """Manifest with `hit` and, for hits, the stored `cached_language` and `cached_stats`.

    With `replaced`, misses have the language and counts of their outdated entry as `replaced_language` and
    `replaced_stats`.

    A hit needs the same size and the same modification second, and where the manifest has a `digest`, the
    same digest: an entry or a file without one is a miss then.
    """
    checked = "digest" in manifest.columns
    digest = F.col("digest") if "digest" in cache.columns else F.lit(None).cast("string")
    stored = cache.select(
        *_KEY,
        F.col("size").alias("_size"),
        F.col("mtime").alias("_mtime"),
        F.col("language").alias("cached_language"),
        F.col("stats").alias("cached_stats"),
        *([digest.alias("_digest")] if checked else []),
    )
    same = (F.col("size") == F.col("_size")) & (F.col("mtime") == F.col("_mtime"))
    if checked:
        same = same & (F.col("digest") == F.col("_digest"))
    hit = F.coalesce(same, F.lit(False))
    outdated = {f"replaced_{c}": F.when(~hit, F.col(f"cached_{c}")) for c in ("language", "stats")}
    return (
        manifest.join(stored, _KEY, "left")
        .withColumns(
            {
                "hit": hit,
                **(outdated if replaced else {}),
                "cached_language": F.when(hit, F.col("cached_language")),
                "cached_stats": F.when(hit, F.col("cached_stats")),
            }
        )
        .drop("_size", "_mtime", "_digest")
    )


def cache_hits(probed: DataFrame) -> DataFrame:
    """Stored results of the hits; the language is the stored one, whatever detection says now."""
    return probed.filter("hit").select(
        *_KEY, "mtime", "size", F.col("cached_language").alias("language"), "cached_stats.*"
    )


def cache_misses(manifest: DataFrame, cache: DataFrame) -> DataFrame:
    """Manifest rows to be counted again, when only these are wanted."""
    return manifest.join(cache, [*_KEY, "size", "mtime"], "left_anti")


def combine_results(cached: DataFrame, counted: DataFrame) -> DataFrame:
    return cached.unionByName(counted)


def cache_upsert(cache: DataFrame, entries: DataFrame) -> DataFrame:
    """Cache with `entries` inserted or overwriting by path; other entries stay."""
    return cache.join(entries, _KEY, "left_anti").unionByName(entries)


def entry_counts(entries: DataFrame) -> DataFrame:
    """Language and counts of each entry."""
    return entries.select("language", "stats.*")


def cache_delta(cache: DataFrame, entries: DataFrame) -> DataFrame:
    """Change of the per-language totals of `cache` by `cache_upsert` of `entries`."""
    outdated = cache.join(entries.select(*_KEY), _KEY, "left_semi")
    return stats_delta(entry_counts(outdated), entry_counts(entries))


def cache_cleanup(cache: DataFrame, manifest: DataFrame) -> DataFrame:
    """Cache without the entries whose file is gone."""
    return cache.join(manifest, _KEY, "left_semi")


def cache_hit_rate(probed: DataFrame) -> DataFrame:
    """One row: hits, misses, new_files (always the misses) and hit_rate in percent."""
    hits, misses = F.count_if("hit"), F.count_if(~F.col("hit"))
    rate = F.coalesce(hits * 100.0 / F.nullif(hits + misses, F.lit(0)), F.lit(0.0))
    return probed.agg(
        hits.alias("hits"),
        misses.alias("misses"),
        misses.alias("new_files"),
        rate.cast("double").alias("hit_rate"),
    )
