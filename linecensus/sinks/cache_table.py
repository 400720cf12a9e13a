"""Per-file results kept between runs as Parquet.

`<cache_dir>/<root_id>/<number>-base` holds all entries, `<number>-delta` those of one later run, so
a run writes in proportion to what changed, and nothing when nothing did. The last two bases and what came
after them are kept, older folders go.

Runs may save at the same time. Each writes to a folder of its own and claims a number by renaming it, which
fails where the name is taken. A run that loses a claim looks at the folders again and takes the next number.
A base that merges has the number after what it has read, and a delta of that number counts after it, so
entries saved while it was written stay. The cache needs a file system with atomic renames.

Every folder also holds the totals by language of all entries up to it: those of the folder before it, less the entries
it replaces, plus its own. The name of that folder is part of the name of the totals, so totals that were made after
another one, since runs saved at the same time, are not used; then all entries are counted.
"""

from __future__ import annotations

import re
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linecensus.operators import incremental as C
from linecensus.operators import stats as S

# After this many deltas the next run writes a new base.
MAX_DELTAS = 16

# Folders of runs that never claimed a number go after this time.
ABANDONED_SECONDS = 7 * 24 * 3600

_SCHEMA = C.CACHE_SCHEMA + ", digest string"
_TOTALS_SCHEMA = "name string, files bigint, " + ", ".join(f"{c} bigint" for c in S.COUNTS)
_STAGED = "_run-"


def _folders(spark: SparkSession, cache_dir: str, root: str) -> list[tuple[int, str, str, bool]]:
    """Number, kind, path and committed flag of the run folders, in order."""
    path_class = spark._jvm.org.apache.hadoop.fs.Path
    folder = path_class(f"{cache_dir.rstrip('/')}/{root}")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    found = []
    for status in fs.listStatus(folder):
        path = status.getPath()
        named = re.fullmatch(r"(\d+)-(base|delta)", path.getName())
        if named:
            committed = fs.exists(path_class(path, "_SUCCESS"))
            found.append((int(named[1]), named[2], path.toString(), committed))
    return sorted(found)


def _current(folders: list[tuple[int, str, str, bool]]) -> list[str]:
    """Paths of the last committed base and the committed deltas after it."""
    paths: list[str] = []
    for _, kind, path, committed in folders:
        if committed:
            paths = [path] if kind == "base" else [*paths, path]
    return paths


def state(spark: SparkSession, cache_dir: str, root: str) -> list[str]:
    """The folders that `load` would read now."""
    return _current(_folders(spark, cache_dir, root))


def totals(spark: SparkSession, cache_dir: str, root: str) -> DataFrame:
    """Files and counts by language of all entries saved; reads one row per language where it can."""
    current = state(spark, cache_dir, root)
    return _totals(spark, cache_dir, root, current)


def _totals(spark: SparkSession, cache_dir: str, root: str, current: list[str]) -> DataFrame:
    if current:
        stored = _totals_path(current[-1], current[:-1])
        mark = spark._jvm.org.apache.hadoop.fs.Path(f"{stored}/_SUCCESS")
        if mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
            return spark.read.schema(_TOTALS_SCHEMA).parquet(stored)
    return S.language_stats(C.entry_counts(load(spark, cache_dir, root)))


def _totals_path(folder: str, before: list[str]) -> str:
    """Where `folder` has its totals, if it was made after the folders `before`; readers of entries skip the name."""
    after = before[-1].rsplit("/", 1)[-1] if before else "nothing"
    return f"{folder}/_totals-{C.CACHE_VERSION}-after-{after}"


def load(spark: SparkSession, cache_dir: str, root: str, skip_damaged: bool = True) -> DataFrame:
    """Latest valid entry per path; no rows when there is no cache."""
    paths = _current(_folders(spark, cache_dir, root))
    if not paths:
        return C.empty_cache(spark)
    stored = spark.read.schema(_SCHEMA).option("ignoreCorruptFiles", skip_damaged).parquet(*paths)
    columns = stored.columns
    # The order of the folders; a delta comes after the base of its number.
    named = F.regexp_extract("_metadata.file_path", r"/(\d+-(?:base|delta))/[^/]*$", 1)
    stored = C.cache_validate(stored.select("*", named.alias("run")), root)
    if len(paths) == 1:
        return stored.select(*columns)
    # The probe joins on the same key, so it reuses this partitioning.
    entry = F.struct(*[c for c in columns if c not in ("root_id", "path")])
    latest = stored.groupBy("root_id", "path").agg(F.max_by(entry, "run").alias("entry"))
    return latest.select("root_id", "path", "entry.*").select(*columns)


def save(
    spark: SparkSession,
    cache_dir: str,
    root: str,
    entries: DataFrame,
    rebuild: bool,
    replaced: DataFrame | None = None,
    seen: list[str] | None = None,
) -> None:
    """Insert or overwrite `entries`; with `rebuild` they replace everything stored.

    `replaced` may name the stored entries `(root_id, path, language, stats)` of the paths of `entries`, as of the `state`
    `seen`; otherwise, or if another run has saved since, the totals need a look at all stored entries.
    """
    home = f"{cache_dir.rstrip('/')}/{root}"
    if "digest" not in entries.columns:
        entries = entries.withColumn("digest", F.lit(None).cast("string"))
    staged = None
    while True:
        folders = _folders(spark, cache_dir, root)
        current = _current(folders)
        if not rebuild and current and entries.isEmpty():
            return
        number = folders[-1][0] + 1 if folders else 0
        if not rebuild and len(current) > MAX_DELTAS:
            # A file that cannot be read now must not be lost for good.
            stored = load(spark, cache_dir, root, skip_damaged=False)
            merged = _stage(C.cache_upsert(stored, entries), home)
            _write_totals(S.language_stats(C.entry_counts(_staged_entries(spark, merged))), merged, [])
            if _claim(spark, merged, f"{home}/{number:08d}-base"):
                _remove_superseded(spark, _folders(spark, cache_dir, root))
                break
            _delete(spark, merged)
            continue
        staged = staged or _stage(entries, home)
        kind = "base" if rebuild or not current else "delta"
        target = f"{home}/{number:08d}-{kind}"
        added = _staged_entries(spark, staged)
        if kind == "base":
            _write_totals(S.language_stats(C.entry_counts(added)), staged, [])
        else:
            known = replaced if replaced is not None and seen == current else load(spark, cache_dir, root)
            try:
                before = _totals(spark, cache_dir, root, current)
                _write_totals(S.fold_totals(before, C.cache_delta(known, added)), staged, current)
            except (PySparkException, Py4JJavaError):
                # Another run may just have removed an old folder; without totals, entries are counted when asked for.
                pass
        if not _claim(spark, staged, target):
            continue
        folders = _folders(spark, cache_dir, root)
        if kind == "delta" and any(n > number and k == "base" for n, k, *_ in folders):
            # Replaced before it was there: this is the folder of no run any more, so claim anew.
            if _claim(spark, target, staged):
                continue
        staged = None
        _remove_superseded(spark, folders)
        break
    if staged:
        _delete(spark, staged)


def _stage(entries: DataFrame, home: str) -> str:
    """Write `entries` to a folder of no number."""
    target = f"{home}/{_STAGED}{uuid.uuid4().hex}"
    entries.write.parquet(target)
    return target


def _staged_entries(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_SCHEMA).parquet(folder)


def _write_totals(totals: DataFrame, folder: str, before: list[str]) -> None:
    """Save the totals of `folder`; at most one row per language, so one file."""
    totals.coalesce(1).write.mode("overwrite").parquet(_totals_path(folder, before))


def _claim(spark: SparkSession, folder: str, target: str) -> bool:
    """Rename `folder` to `target` unless that exists, and whether this was done."""
    jvm = spark._jvm
    path_class = jvm.org.apache.hadoop.fs.Path
    source, wanted = path_class(folder), path_class(target)
    conf = spark._jsc.hadoopConfiguration()
    fs = source.getFileSystem(conf)
    mark = f"_by-{uuid.uuid4().hex}"
    fs.create(path_class(source, mark), True).close()
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
    try:
        context.rename(fs.makeQualified(source), fs.makeQualified(wanted), options)
    except Py4JJavaError as error:
        if fs.exists(source) and fs.exists(wanted):
            fs.delete(path_class(source, mark), False)
            return False
        raise error
    if fs.exists(path_class(wanted, mark)):
        fs.delete(path_class(wanted, mark), False)
        return True
    # Some file systems move a folder into one that was made at the same moment.
    nested = path_class(wanted, source.getName())
    if fs.exists(nested):
        fs.rename(nested, source)
    return False


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _remove_superseded(spark: SparkSession, folders: list[tuple[int, str, str, bool]]) -> None:
    bases = [number for number, kind, _, committed in folders if kind == "base" and committed]
    for number, _, path, _ in folders:
        if len(bases) > 1 and number < bases[-2]:
            _delete(spark, path)
    home = spark._jvm.org.apache.hadoop.fs.Path(folders[0][2]).getParent()
    for status in home.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(home):
        age = time.time() - status.getModificationTime() / 1000
        if status.getPath().getName().startswith(_STAGED) and age > ABANDONED_SECONDS:
            _delete(spark, status.getPath().toString())
