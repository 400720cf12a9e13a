"""Registered queries: every operator over the given tables, each `(spark, sf_dir) -> DataFrame`."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linecensus.functions import languages as L
from linecensus.functions import lines as N
from linecensus.operators import detect as D
from linecensus.operators import ignore as I
from linecensus.operators import incremental as C
from linecensus.operators import line_pieces as LP
from linecensus.operators import lines as O
from linecensus.operators import stats as S
from linecensus.plans import analyze as A
from linecensus.session import posix_path, scratch_path, write_table
from linecensus.sinks import cache_table as CA
from linecensus.sinks import reports as R
from linecensus.sinks.tree_files import write_tree
from linecensus.sources import content as CT
from linecensus.sources import tables as T
from linecensus.sources import tree as TR
from linecensus.sources import tree_source as TS

Query = Callable[[SparkSession, str], DataFrame]

# Root lines of the ignore_rules query, and the lines of every fifth user's own folder.
ROOT_RULES = ["error/", "*.md", "!u1*/**/f.md", "/u2*/click/", "f.t?ml", "*.[ch]"]
USER_RULES = ["view/", "!*.md"]
EXCLUDES = ["*.js", "view/", "/u1/**", "f.{ts,css}"]


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.detect_language(T.event_paths(spark, sf_dir))


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.detect_language(T.corpus(spark, sf_dir))


def _html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.detect_language(T.html_corpus(spark, sf_dir))


def _corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.file_stats(_corpus(spark, sf_dir))


def _corpus_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.language_stats(_corpus_stats(spark, sf_dir))


# Added to the lines of stored results in `combine_results`.
STORED_MARK = 1000


# Detection -----------------------------------------------------------------------------------


def path_parts(spark, sf_dir):
    return D.path_parts(T.event_paths(spark, sf_dir)).select("path", "name", "stem", "ext")


def detect_language(spark, sf_dir):
    return _paths(spark, sf_dir).select("path", "language")


def detect_language_counts(spark, sf_dir):
    return _paths(spark, sf_dir).groupBy("language").agg(F.count("*").alias("files"))


def is_code_file(spark, sf_dir):
    return _paths(spark, sf_dir).filter(D.is_code_file()).select("path")


def language_filter_files(spark, sf_dir):
    # Display names decide: 'cpp' and 'c' name no language.
    wanted = ["RUST", "c++", "cpp", "c"]
    return D.language_filter(_paths(spark, sf_dir), wanted).select("path", "language")


def comment_syntax(spark, sf_dir):
    columns = ("path", "language", "line_tok", "block_start", "block_end")
    return D.comment_syntax(_paths(spark, sf_dir)).select(*columns)


def display_name(spark, sf_dir):
    """Every language with the number of corpus files it has."""
    counted = (
        D.detect_language(T.corpus(spark, sf_dir).select("path"))
        .groupBy("language")
        .agg(F.count("*").alias("documents"))
    )
    return (
        L.dim_language(spark)
        .join(F.broadcast(counted), F.col("display_name") == F.col("language"), "left")
        .select("lang_key", "display_name", F.coalesce("documents", F.lit(0)).alias("documents"))
    )


# Path filters --------------------------------------------------------------------------------


def hidden_filter(spark, sf_dir):
    return I.hidden_filter(T.event_paths(spark, sf_dir)).select("path")


def ignore_rules(spark, sf_dir):
    """Rules of the root and of every fifth user's folder, as ignore files there would give."""
    user = F.col("user_id")
    folders = (
        spark.read.parquet(f"{sf_dir}/events.parquet").filter(user % 5 == 0).select(user).distinct()
    )
    # The constant rules of each folder, as an array to keep this a projection.
    rows = I.rule_rows(USER_RULES, "", I.RANK_GITIGNORE)
    rules = [
        F.struct(*[F.lit(v).alias(n) for n, v in zip(I.RULE_FIELDS.names[1:], row[1:])]) for row in rows
    ]
    base_dir = F.concat(F.lit("u"), user).alias("base_dir")
    per_user = folders.select(base_dir, F.inline(F.array(*rules)))
    root_rules = I.parse_rules(spark, ROOT_RULES, source_rank=I.RANK_GITIGNORE)
    return I.ignore_rules(T.event_paths(spark, sf_dir), root_rules.unionByName(per_user)).select("path")


def exclude_globs(spark, sf_dir):
    return I.exclude_globs(T.event_paths(spark, sf_dir), EXCLUDES).select("path")


# Lines ---------------------------------------------------------------------------------------


def split_lines(spark, sf_dir):
    return O.split_lines(T.corpus(spark, sf_dir))


def line_split_counts(spark, sf_dir):
    return O.fast_stats(_corpus(spark, sf_dir)).select("path", "lines")


def count_newlines(spark, sf_dir):
    return O.count_newlines(T.corpus(spark, sf_dir))


def blank_lines(spark, sf_dir):
    return O.blank_lines(T.corpus(spark, sf_dir))


def ltrim_ws(spark, sf_dir):
    lines = O.split_lines(T.corpus(spark, sf_dir))
    return lines.select("path", "line_no", N.ltrim_ws(F.col("raw")).alias("trimmed"))


def find_token(spark, sf_dir):
    """Where the block end of the file's language first occurs in each line."""
    files = D.comment_syntax(_corpus(spark, sf_dir))
    content = F.col("content")
    lines = files.select(
        "path",
        "block_end",
        N.is_bytewise(content).alias("bytewise"),
        F.posexplode(N.split_lines(N.as_text(content))).alias("line_no", "raw"),
    )
    position = N.find_token(F.col("raw"), F.col("block_end"), F.col("bytewise"))
    return lines.select("path", "line_no", position.alias("position"))


def fast_stats(spark, sf_dir):
    return O.fast_stats(_corpus(spark, sf_dir))


def classify_lines_html(spark, sf_dir):
    return O.classify_lines(_html(spark, sf_dir)).select("path", "line_no", "cls")


def classify_lines_corpus(spark, sf_dir):
    return O.classify_lines(_corpus(spark, sf_dir)).select("path", "line_no", "cls")


def block_state(spark, sf_dir):
    return O.block_state(_corpus(spark, sf_dir))


# The same with texts over this many bytes cut into pieces.
SMALL_PIECE = 200


def split_lines_pieces(spark, sf_dir):
    return O.split_lines(T.corpus(spark, sf_dir), SMALL_PIECE)


def classify_lines_pieces(spark, sf_dir):
    return O.classify_lines(_corpus(spark, sf_dir), SMALL_PIECE).select("path", "line_no", "cls")


def block_state_pieces(spark, sf_dir):
    return O.block_state(_corpus(spark, sf_dir), SMALL_PIECE)


# Aggregates and orders -----------------------------------------------------------------------


def language_stats_html(spark, sf_dir):
    return S.language_stats(O.file_stats(_html(spark, sf_dir)))


def grand_total_rollup(spark, sf_dir):
    return S.grand_total(_corpus_languages(spark, sf_dir))


def merge_stats(spark, sf_dir):
    return S.merge_stats(_corpus_languages(spark, sf_dir), language_stats_html(spark, sf_dir))


def langs_by_code(spark, sf_dir):
    return S.langs_by_code(_corpus_languages(spark, sf_dir))


def langs_by_files(spark, sf_dir):
    return S.langs_by_files(_corpus_languages(spark, sf_dir))


def files_by_path(spark, sf_dir):
    return S.files_by_path(_corpus_stats(spark, sf_dir))


def files_by_size(spark, sf_dir):
    return S.files_by_size(T.event_paths(spark, sf_dir).select("path", "size"))


# Incremental reuse ---------------------------------------------------------------------------


def _keyed(manifest: DataFrame) -> DataFrame:
    return manifest.withColumn("root_id", C.root_id(F.lit("events")))


def _counted(manifest: DataFrame) -> DataFrame:
    """Stand-in counts for listed files: the snapshots have sizes but no content."""
    zero = F.lit(0).cast("bigint")
    lines = F.col("size") % 100
    return manifest.select(
        "*", F.lit("Rust").alias("language"), lines.alias("lines"), lines.alias("code"),
        zero.alias("comments"), zero.alias("blanks"), F.col("size").alias("bytes"),
    )


def _old_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cache_entries(_counted(_keyed(T.snap_old(spark, sf_dir))), cached_at=0)


def _probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cache_probe(_keyed(T.snap_new(spark, sf_dir)), _old_cache(spark, sf_dir))


def cache_probe(spark, sf_dir):
    lines = F.col("cached_stats.lines").alias("cached_lines")
    return _probed(spark, sf_dir).select("path", "size", "mtime", "hit", lines)


def cache_misses(spark, sf_dir):
    manifest = _keyed(T.snap_new(spark, sf_dir))
    return C.cache_misses(manifest, _old_cache(spark, sf_dir)).select("path", "size", "mtime")


def cache_hit_rate(spark, sf_dir):
    rate = C.cache_hit_rate(_probed(spark, sf_dir))
    return rate.withColumn("hit_rate", F.round("hit_rate", 4))


def cache_upsert(spark, sf_dir):
    new = C.cache_entries(_counted(_keyed(T.snap_new(spark, sf_dir))), cached_at=1)
    columns = ("path", "size", "mtime", "language", "stats.lines", "stats.bytes", "cached_at")
    return C.cache_upsert(_old_cache(spark, sf_dir), new).select(*columns)


def cache_cleanup(spark, sf_dir):
    manifest = _keyed(T.snap_new(spark, sf_dir))
    return C.cache_cleanup(_old_cache(spark, sf_dir), manifest).select("path", "size", "mtime")


def cache_validate(spark, sf_dir):
    """Entries of another version (every fifth size) or root (every seventh) are not used."""
    mixed = _old_cache(spark, sf_dir).withColumns(
        {
            "version": F.when(F.col("size") % 5 == 0, 0).otherwise(F.col("version")),
            "root_id": F.when(F.col("size") % 7 == 0, "other").otherwise(F.col("root_id")),
        }
    )
    return C.cache_validate(mixed, C.root_id(F.lit("events"))).select("path", "size", "mtime")


def cache_modes(spark, sf_dir):
    manifest, cache = _keyed(T.snap_new(spark, sf_dir)), _old_cache(spark, sf_dir)
    result = None
    for mode in ("reuse", "fresh", "rebuild"):
        rate = C.cache_hit_rate(C.cache_probe(manifest, C.cache_mode(cache, mode)))
        rate = rate.select(F.lit(mode).alias("mode"), "hits", "misses")
        result = rate if result is None else result.unionByName(rate)
    return result


def combine_results(spark, sf_dir):
    probed = write_table(_probed(spark, sf_dir), "probed")  # read for the hits and for the misses
    counted = _counted(probed.filter(~F.col("hit")))
    cached = C.cache_hits(probed)
    # Stored counts are told apart from those counted now.
    cached = cached.withColumn("lines", F.col("lines") + STORED_MARK)
    combined = C.combine_results(cached, counted.select(*cached.columns))
    return combined.select("path", "size", "mtime", "lines")


def root_id(spark, sf_dir):
    sources = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source").distinct()
    root = F.concat(F.lit("corpus/"), "source")
    return sources.select(root.alias("root"), C.root_id(root).alias("root_id"))


# Reports -------------------------------------------------------------------------------------


def summary(spark, sf_dir):
    """Totals with a given number of errors and a given time, and the rates."""
    found = R.summary(_corpus_languages(spark, sf_dir), error_count=3, elapsed_ms=2000)
    rates = {name: F.round(name, 4) for name in ("files_per_sec", "lines_per_sec")}
    return found.withColumns(rates)


def report_table(spark, sf_dir):
    return R.ordered(R.report_table(_corpus_languages(spark, sf_dir)))


def report_full(spark, sf_dir):
    """The table with all sections: errors of files that are not there, files, and the rates of two seconds."""
    stats = write_table(_corpus_stats(spark, sf_dir), "stats")
    errors = write_table(_unreadable(spark, sf_dir), "errors")
    return R.ordered(R.report_table(S.language_stats(stats), 2000, errors, stats))


def report_files(spark, sf_dir):
    return R.ordered(R.report_files(_corpus_stats(spark, sf_dir)))


def report_csv(spark, sf_dir):
    stats = write_table(_corpus_stats(spark, sf_dir), "stats")
    return R.ordered(R.report_csv(S.language_stats(stats), stats))


def report_json(spark, sf_dir):
    stats = write_table(_corpus_stats(spark, sf_dir), "stats")
    return R.ordered(R.report_json(S.language_stats(stats), file_stats=stats))


def _report_tables(spark: SparkSession, sf_dir: str, fmt: str) -> DataFrame:
    """Counts by file, saved as tables and read again."""
    stats = write_table(_corpus_stats(spark, sf_dir), "stats")
    folder = scratch_path(spark, f"report-{fmt}")
    R.write_files(S.language_stats(stats), stats, folder, fmt)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stats.schema)
    return R.read_files(spark, folder, "files", schema, fmt)


def report_csv_tables(spark, sf_dir):
    return _report_tables(spark, sf_dir, "csv")


def report_json_tables(spark, sf_dir):
    return _report_tables(spark, sf_dir, "json")


# File trees, written from the corpus into the shared folder ------------------------------------

# Lines of the ignore files in every third source folder, and the globs excluded besides.
TREE_RULES = ["*.py", "doc_1*", "!doc_12*"]
TREE_EXCLUDES = ["*.css"]


def _corpus_tree(spark: SparkSession, sf_dir: str) -> str:
    root = posix_path(scratch_path(spark, "tree"))
    write_tree(T.corpus(spark, sf_dir), root)
    return root


def scan_tree(spark, sf_dir):
    return TR.scan_tree(spark, _corpus_tree(spark, sf_dir)).select("path", "language", "size")


def scan_tree_filtered(spark, sf_dir):
    """Ignore files below the root, exclude globs and hidden names in one walk."""
    root = _corpus_tree(spark, sf_dir)
    folders = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source").distinct()
    third = folders.filter(F.regexp_replace("source", "[^0-9]", "").cast("int") % 3 == 0)
    folder = F.concat(F.lit("corpus/"), "source")
    rules = third.select(
        F.concat(folder, F.lit("/.ignore")).alias("path"), F.lit("\n".join(TREE_RULES)).alias("content")
    )
    hidden = folders.select(
        F.concat(folder, F.lit("/.cache/x.rs")).alias("path"), F.lit("x").alias("content")
    )
    write_tree(rules.unionByName(hidden), root)
    return TR.scan_tree(spark, root, exclude=TREE_EXCLUDES).select("path", "language", "size")


def tree_source(spark, sf_dir):
    """The corpus tree as a table of a data source, with ignore files and the content of each file."""
    columns = "path string, size bigint, content binary"
    found = D.detect_language(TS.read_tree(spark, _corpus_tree(spark, sf_dir), columns)).filter(D.is_code_file())
    return found.select("path", "language", "size", F.md5("content").alias("digest"))


def read_content(spark, sf_dir):
    root = _corpus_tree(spark, sf_dir)
    read = CT.read_content(TR.scan_tree(spark, root), root)
    return read.select("path", "size", "offset", F.md5("content").alias("digest"))


def classify_lines_tree(spark, sf_dir):
    """Lines of the files of a tree, read and classified in small pieces."""
    root = _corpus_tree(spark, sf_dir)
    read = CT.read_content(TR.scan_tree(spark, root), root, piece_bytes=SMALL_PIECE)
    return O.classify_pieces(LP.cut_files(read)).select("path", "line_no", "cls")


def analyze_tree(spark, sf_dir):
    return A.analyze_tree(spark, _corpus_tree(spark, sf_dir)).languages


def analyze_tree_pieces(spark, sf_dir):
    """The same with every file cut into small pieces."""
    return A.analyze_tree(spark, _corpus_tree(spark, sf_dir), piece_bytes=256).languages


def analyze_tree_long_lines(spark, sf_dir):
    """The same with lines over 64 bytes reduced while they are read, in files of several pieces."""
    root = _corpus_tree(spark, sf_dir)
    return A.analyze_tree(spark, root, piece_bytes=1024, long_line_bytes=64).languages


def analyze_tree_rerun(spark, sf_dir):
    """A first run that fills the cache and a second one that reads no file; hits of both."""
    root, cache = _corpus_tree(spark, sf_dir), scratch_path(spark, "cache")
    runs = []
    for name in ("first", "second"):
        census = A.analyze_tree(spark, root, cache_dir=cache)
        reuse = census.reuse.select("hits", "misses")
        runs.append(census.languages.withColumn("run", F.lit(name)).crossJoin(F.broadcast(reuse)))
    return runs[0].unionByName(runs[1])


def scan_single(spark, sf_dir):
    """The first file of the corpus tree as a single-file argument, filters notwithstanding."""
    root = _corpus_tree(spark, sf_dir)
    path = T.corpus(spark, sf_dir).agg(F.min("path")).first()[0]
    found = TR.scan_tree(spark, f"{root}/{path}", exclude=["*"], languages=["C++"])
    return found.select("path", "language", "size")


def follow_links(spark, sf_dir):
    """A tree with links to its folders, one back to the top: not followed, then followed."""
    root = _corpus_tree(spark, sf_dir)
    names = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source").distinct()
    for row in names.orderBy("source").limit(2).collect():
        os.symlink(f"{root}/corpus/{row.source}", f"{root}/link-{row.source}")
    os.symlink(root, f"{root}/corpus/back")
    scans = []
    for follow in (False, True):
        found = TR.scan_tree(spark, root, follow_links=follow).select("path", "language", "size")
        scans.append(found.withColumn("followed", F.lit(follow)))
    return scans[0].unionByName(scans[1])


def cache_sink(spark, sf_dir):
    """What a run leaves in the cache."""
    root, cache = _corpus_tree(spark, sf_dir), scratch_path(spark, "cache")
    A.analyze_tree(spark, root, cache_dir=cache)
    identity = spark.range(1).select(C.root_id(F.lit(os.path.realpath(root)))).first()[0]
    return CA.load(spark, cache, identity).select("path", "size", "language", "stats.lines")


def running_totals(spark, sf_dir):
    """Totals kept by the cache after a first run, and after a second one that finds emptied and new files."""
    root, cache = _corpus_tree(spark, sf_dir), scratch_path(spark, "cache")
    identity = spark.range(1).select(C.root_id(F.lit(os.path.realpath(root)))).first()[0]
    third = T.corpus(spark, sf_dir).select("path").filter(
        F.regexp_extract("path", "doc_([0-9]+)", 1).cast("bigint") % 3 == 0
    )
    emptied = third.withColumn("content", F.lit(""))
    new = third.select(F.concat(F.lit("new/"), F.col("path"), F.lit(".rs")).alias("path"), F.lit("x\n").alias("content"))
    runs = []
    for name, changes in (("first", None), ("second", emptied.unionByName(new))):
        if changes is not None:
            write_tree(changes, root)
        A.analyze_tree(spark, root, cache_dir=cache)
        runs.append(CA.totals(spark, cache, identity).withColumn("run", F.lit(name)))
    return runs[0].unionByName(runs[1])


def _unreadable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of reading listed files that are not there."""
    manifest = _paths(spark, sf_dir).filter(D.is_code_file())
    manifest = manifest.withColumns(
        {"raw_path": F.lit(None).cast("binary"), "size": F.greatest("size", F.lit(1))}
    )
    # Written once: the weights and the reading both go over it, and making the paths costs more than either.
    manifest = write_table(manifest, "manifest")
    return CT.read_errors(CT.read_content(manifest, posix_path(scratch_path(spark, "missing"))))


def error_sample(spark, sf_dir):
    return R.error_sample(_unreadable(spark, sf_dir))


def error_count(spark, sf_dir):
    return R.error_count(_unreadable(spark, sf_dir))


def queries() -> dict[str, Query]:
    named = (
        path_parts, detect_language, detect_language_counts, is_code_file, language_filter_files,
        comment_syntax, display_name, hidden_filter, ignore_rules, exclude_globs, split_lines,
        line_split_counts, count_newlines, blank_lines, ltrim_ws, find_token, fast_stats,
        classify_lines_html, classify_lines_corpus, block_state, split_lines_pieces,
        classify_lines_pieces, block_state_pieces, classify_lines_tree, language_stats_html,
        grand_total_rollup, merge_stats, langs_by_code, langs_by_files, files_by_path,
        files_by_size, cache_probe, cache_misses, cache_hit_rate, cache_upsert, cache_cleanup,
        cache_validate, cache_modes, combine_results, root_id, summary, report_table, report_full,
        report_files, report_csv, report_json, report_csv_tables, report_json_tables, scan_tree, scan_tree_filtered, tree_source, read_content,
        analyze_tree, analyze_tree_pieces, analyze_tree_long_lines, analyze_tree_rerun, scan_single,
        follow_links, cache_sink, running_totals, error_sample, error_count,
    )
    return {
        "file_stats": _corpus_stats,
        "language_stats": _corpus_languages,
        **{query.__name__: query for query in named},
    }
