"""Tables of files `(path, content, size, mtime)` read from, or derived from, Parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linecensus.functions import languages as L
from linecensus.operators.detect import detect_language

# Fixed values of the derived tables below.
CORPUS_EXTENSIONS = ["rs", "py", "sql", "lua", "hs", "css", "xml", "jl", "rb", "sh", "md", "lisp"]
SNAPSHOT_DAY = "2024-01-28"

# Fixed values. File names that exercise the look-up order of language detection.
SPECIAL_NAMES = [
    "Dockerfile", "Dockerfile.dev", "Makefile.am", "makefile.py", "matlab.txt", "Gemfile.lock",
    "Rakefile", "Cargo.toml", "Cargo.toml.orig", "Cargo.lock", "CMakeLists.txt", "build.CMAKE",
    "a.tar.gz", "foo.", ".rs", ".env.py", "README", "x.M", "a.b.c.PY", "..rs",
]


def _scan(spark: SparkSession, table: str) -> DataFrame:
    """The table, spread over all cores when its files give fewer scan tasks than there are cores.

    That happens for small inputs only (at most one scan split per core), where moving the rows is
    cheap next to classifying them; larger tables are never shuffled.
    """
    rows = spark.read.parquet(table)
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def read_files(
    spark: SparkSession, table: str, path: Column, content: Column, mtime: Column | None = None
) -> DataFrame:
    """Files held as rows of a Parquet table: only the columns used by the expressions are read."""
    files = _scan(spark, table).select(path.alias("path"), content.alias("content"))
    return files.select(
        "path",
        "content",
        F.octet_length("content").cast("bigint").alias("size"),
        (F.lit(0) if mtime is None else mtime).cast("bigint").alias("mtime"),
    )


def html_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as HTML files, with a line break between adjoining tags."""
    return read_files(
        spark,
        f"{sf_dir}/pages.parquet",
        F.concat(F.lit("pages/"), F.col("page_id"), F.lit(".html")),
        F.replace(F.col("html"), F.lit("><"), F.lit(">\n<")),
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as source files of twelve languages, with comment tokens put into their lines."""
    pick = (F.col("doc_id") % len(CORPUS_EXTENSIONS)).cast("int").alias("pick")
    documents = _scan(spark, f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", pick)
    listed = ", ".join(f"'{ext}'" for ext in CORPUS_EXTENSIONS)
    documents = documents.withColumn("ext", F.expr(f"element_at(array({listed}), pick + 1)"))
    decorated = """
        transform(split(text, '\\n', -1), (x, i) -> CASE
            WHEN i % 11 = 6 THEN concat(bs, ' ', x)
            WHEN i % 11 = 8 THEN concat(x, ' ', be)
            WHEN i % 11 = 10 THEN concat(bs, ' ', x, ' ', be)
            WHEN i % 7 = 3 THEN '  '
            WHEN i % 5 = 0 THEN concat('  ', lc, ' ', x)
            ELSE x END)"""
    path = F.concat(
        F.lit("corpus/"), F.col("source"), F.lit("/doc_"), F.col("doc_id"), F.lit("."), F.col("ext")
    )
    documents = detect_language(documents.withColumn("path", path))
    tokens = L.syntax_columns()
    documents = documents.withColumns(
        {
            "lc": F.coalesce(tokens["line_tok"], F.lit("")),
            "bs": F.coalesce(tokens["block_start"], F.lit("*")),
            "be": F.coalesce(tokens["block_end"], F.lit("*")),
        }
    )
    content = F.expr(f"array_join({decorated}, '\\n')")
    files = documents.select("path", content.alias("content"))
    return files.select(
        "path",
        "content",
        F.octet_length("content").cast("bigint").alias("size"),
        F.lit(0).cast("bigint").alias("mtime"),
    )


def event_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per event: a path with every known extension and special name in turn."""
    names = SPECIAL_NAMES + [f"f.{ext}" for ext, _ in L.EXTENSIONS]
    name = F.element_at(
        F.array(*[F.lit(n) for n in names]), (F.col("event_id") % len(names) + 1).cast("int")
    )
    folder = F.when(F.col("event_id") % 23 == 0, ".cache").otherwise(F.col("event_type"))
    path = F.concat(
        F.lit("u"), F.col("user_id"), F.lit("/"), folder, F.lit("/e"), F.col("event_id"),
        F.lit("/"), name,
    )
    size = F.round(F.col("value") * 100).cast("bigint")
    return _scan(spark, f"{sf_dir}/events.parquet").select(
        path.alias("path"), size.alias("size"), _epoch_seconds(F.col("ts")).alias("mtime")
    )


def _epoch_seconds(ts: Column) -> Column:
    """Whole seconds of a zone-less timestamp, whatever the session time zone is."""
    since = ts - F.lit("1970-01-01").cast("timestamp_ntz")
    seconds = F.lit(0).cast("bigint")
    for unit, length in (("DAY", 86400), ("HOUR", 3600), ("MINUTE", 60), ("SECOND", 1)):
        seconds = seconds + F.floor(F.extract(F.lit(unit), since)).cast("bigint") * length
    return seconds


def _snapshot(events: DataFrame) -> DataFrame:
    path = F.concat(F.lit("u"), F.col("user_id"), F.lit("/"), F.col("event_type"), F.lit(".rs"))
    latest = events.groupBy(path.alias("path")).agg(
        F.max_by(F.struct("value", "ts"), "event_id").alias("last")
    )
    return latest.select(
        "path",
        F.round(F.col("last.value") * 100).cast("bigint").alias("size"),
        _epoch_seconds(F.col("last.ts")).alias("mtime"),
    )


def snap_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File listing of an earlier day, without some users."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    early = F.col("ts") < F.lit(SNAPSHOT_DAY).cast("timestamp_ntz")
    return _snapshot(events.filter(early & (F.col("user_id") % 19 != 5)))


def snap_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File listing at the end of the events, without some other users."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return _snapshot(events.filter(F.col("user_id") % 17 != 3))
