"""Whole runs: a table of files, or a file tree with reuse of earlier results."""

from __future__ import annotations

import hashlib
import os
import time
import warnings
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linecensus.functions.paths import readable
from linecensus.operators import detect as D
from linecensus.operators import incremental as C
from linecensus.operators import lines as O
from linecensus.operators import stats as S
from linecensus.session import posix_path, write_table
from linecensus.sinks import cache_table, reports
from linecensus.sources.content import LONG_LINE_BYTES, PIECE_BYTES, content_digest, count_files, read_errors
from linecensus.sources.tree import scan_tree


@contextmanager
def _cache_errors_only_warn(what: str) -> Iterator[None]:
    """A cache that cannot be used costs time, not the results of a run."""
    try:
        yield
    except (OSError, PySparkException, Py4JError) as error:
        warnings.warn(f"cache could not be {what}: {error}", stacklevel=3)


@dataclass
class Census:
    """Result of a run; `errors` and `reuse` are None for a table of files."""

    files: DataFrame  # path, language, lines, code, comments, blanks, bytes
    errors: DataFrame | None = None  # path, message
    reuse: DataFrame | None = None  # hits, misses, new_files, hit_rate
    root: str = ""
    elapsed_ms: int = 0

    @property
    def languages(self) -> DataFrame:
        return S.language_stats(self.files)

    def report(self, fmt: str = "table", files: bool = False) -> DataFrame:
        """Report lines in order; `files` adds the per-file part."""
        empty = self.files.isEmpty()
        if empty and (self.errors is None or self.errors.isEmpty()):
            text = reports.NOTHING_FOUND.format(self.root)
            return self.files.sparkSession.createDataFrame([(text,)], "line string")
        details = self.files if files and not empty else None
        built = reports.report(fmt, self.languages, self.elapsed_ms, self.errors, details)
        return reports.ordered(built)


def analyze_table(files: DataFrame, languages: str | Iterable[str] = ()) -> Census:
    """Files held as rows (path, content, size).

    The content is read once, without a shuffle; the counts are written and every aggregate and
    report starts from them.
    """
    known = D.detect_language(files).filter(D.is_code_file())
    counted = O.file_stats(D.language_filter(known, languages))
    return Census(write_table(counted, "counted"))


def analyze_tree(
    spark: SparkSession,
    root: str,
    hidden: bool = False,
    follow_links: bool = False,
    exclude: str | Iterable[str] = (),
    languages: str | Iterable[str] = (),
    cache_dir: str | None = None,
    mode: str = "reuse",
    piece_bytes: int = PIECE_BYTES,
    long_line_bytes: int = LONG_LINE_BYTES,
) -> Census:
    """Count a directory or a single file.

    With `cache_dir`, unchanged files are taken from earlier runs (mode reuse), or all are counted
    and stored anew (rebuild); fresh neither reads nor writes the cache. Unchanged means same size and
    second of modification; with verify every file is read for a digest, which must be the same, too.
    """
    start = time.monotonic()
    root = posix_path(root)
    canonical = os.path.realpath(root)
    base = os.path.dirname(root) or "." if os.path.isfile(root) else root
    identity = hashlib.md5(os.fsencode(canonical)).hexdigest()
    manifest = scan_tree(spark, root, hidden, follow_links, exclude, languages)
    manifest = manifest.withColumn("root_id", F.lit(identity))

    if cache_dir and mode == "verify":
        manifest = write_table(content_digest(manifest, base), "digests")

    cached, seen = C.empty_cache(spark), None
    if cache_dir and mode in ("reuse", "verify"):
        with _cache_errors_only_warn("read"):
            seen = cache_table.state(spark, cache_dir, identity)
            cached = cache_table.load(spark, cache_dir, identity)
    # Written once: hits, misses and the hit rate all read it.
    probed = write_table(C.cache_probe(manifest, C.cache_mode(cached, mode), replaced=True), "probed")
    probing = ("hit", "cached_language", "cached_stats", "replaced_language", "replaced_stats")
    misses = probed.filter(~F.col("hit")).drop(*probing)
    counted = write_table(count_files(misses, base, piece_bytes, long_line_bytes), "counted")
    counted_well = counted.filter(F.col("error").isNull()).drop("error")
    if cache_dir and mode != "fresh":
        entries = C.cache_entries(counted_well, int(time.time()))
        outdated = probed.filter("replaced_language IS NOT NULL").select(
            "root_id", "path", F.col("replaced_language").alias("language"), F.col("replaced_stats").alias("stats")
        )
        with _cache_errors_only_warn("saved"):
            cache_table.save(spark, cache_dir, identity, entries, mode == "rebuild", outdated, seen)

    columns = ("root_id", "path", "mtime", "size", "language", *S.COUNTS)
    combined = C.combine_results(C.cache_hits(probed), counted_well.select(*columns))
    prefix = "" if base in ("", "/") else base.rstrip("/")
    shown = F.concat(F.lit(prefix + "/"), readable(F.col("path")))
    if os.path.isfile(root):
        shown = F.lit(root)
    files = combined.select(shown.alias("path"), "language", *S.COUNTS)
    errors = read_errors(counted.withColumn("path", shown))
    elapsed_ms = int((time.monotonic() - start) * 1000)
    return Census(files, errors, C.cache_hit_rate(probed), root, elapsed_ms)
