"""Reports as DataFrames of text lines, laid out like the command-line output.

Every report has the columns section, rank, path and line: sorted by the first three, `line` is the
report. The language part is at most 51 rows; the per-file part is as long as the corpus, so it is
sorted and written by the executors and never gathered into one row. The per-file counts given are
read several times, so they should come from a written table.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from linecensus.operators import stats as S

# The texts, headings and widths of the reports below.
NOTHING_FOUND = "No code files found in '{}'"

_ERROR_SAMPLE = 5


def _text_rows(spark: SparkSession, section: int, lines: list[str]) -> DataFrame:
    n = len(lines)
    table = pa.table(
        {
            "section": pa.array([section] * n, pa.int32()),
            "rank": pa.array(range(n), pa.int64()),
            "path": pa.array([""] * n),
            "line": pa.array(lines),
        }
    )
    return spark.createDataFrame(table)


def _row(df: DataFrame, section: int, line: Column, rank="0", path="''") -> DataFrame:
    return df.select(
        F.lit(section).alias("section"),
        F.expr(rank).cast("bigint").alias("rank"),
        F.expr(path).alias("path"),
        line.alias("line"),
    )


def _ranked(language_stats: DataFrame) -> DataFrame:
    """Language rows with their report position; one window over at most 51 rows."""
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("code"), "name")
    return language_stats.withColumn("rank", F.row_number().over(order))


def _union(parts: list[DataFrame]) -> DataFrame:
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report


def summary(language_stats: DataFrame, error_count: int = 0, elapsed_ms: int = 0) -> DataFrame:
    """One row: totals, elapsed_ms, error_count and the rates (NULL at zero seconds)."""
    seconds = F.nullif(F.lit(elapsed_ms / 1000.0), F.lit(0.0))
    return S.total(language_stats).select(
        F.col("files").alias("total_files"),
        F.col("lines").alias("total_lines"),
        F.col("code").alias("total_code"),
        F.col("comments").alias("total_comments"),
        F.col("blanks").alias("total_blanks"),
        F.col("bytes").alias("total_bytes"),
        F.lit(elapsed_ms).cast("bigint").alias("elapsed_ms"),
        F.lit(error_count).cast("bigint").alias("error_count"),
        (F.col("files") / seconds).alias("files_per_sec"),
        (F.col("lines") / seconds).alias("lines_per_sec"),
    )


def error_count(errors: DataFrame) -> DataFrame:
    return errors.agg(F.count("*").alias("error_count"))


def error_sample(errors: DataFrame) -> DataFrame:
    """The first errors by path."""
    return errors.orderBy("path").limit(_ERROR_SAMPLE)


def _rate_text(total: Column, elapsed_ms: int) -> Column:
    if elapsed_ms == 0:
        return F.when(total > 0, "inf").otherwise("NaN")
    return F.format_string("%.0f", F.rint(total / F.lit(elapsed_ms / 1000.0)))


def display_path(path: Column) -> Column:
    """Paths over 48 bytes as '...' and their last 45 bytes."""
    tail = F.substr(path.cast("binary"), F.lit(-45)).cast("string")
    return F.when(F.octet_length(path) > 48, F.concat(F.lit("..."), F.make_valid_utf8(tail))).otherwise(
        path
    )


def report_files(file_stats: DataFrame, section: int = 5) -> DataFrame:
    """The 100-column table of files by path."""
    layout = " %-50s %-15s %10s %10s"
    spark = file_stats.sparkSession
    head = ["", "=" * 100, layout % ("File", "Language", "Lines", "Code"), "-" * 100]
    line = F.format_string(layout, display_path(F.col("path")), "language", "lines", "code")
    return _union(
        [
            _text_rows(spark, section, head),
            _row(file_stats, section + 1, line, path="path"),
            _text_rows(spark, section + 2, ["=" * 100]),
        ]
    )


def report_table(
    language_stats: DataFrame,
    elapsed_ms: int = 0,
    errors: DataFrame | None = None,
    file_stats: DataFrame | None = None,
) -> DataFrame:
    """The 80-column table by language, the total, the timing line, errors and files if given."""
    layout = " %-20s %10s %10s %10s %10s %10s"
    spark = language_stats.sparkSession
    header = layout % ("Language", "Files", "Lines", "Code", "Comments", "Blanks")
    counts = ("files", "lines", "code", "comments", "blanks")
    total = S.total(language_stats)
    seconds = f"{elapsed_ms / 1000.0:.3f}"
    timing = F.concat(
        F.lit(f" Statistics completed in {seconds}s ("),
        _rate_text(F.col("files"), elapsed_ms),
        F.lit(" files/s, "),
        _rate_text(F.col("lines"), elapsed_ms),
        F.lit(" lines/s)"),
    )
    parts = [
        _text_rows(spark, 0, ["", "=" * 80, header, "-" * 80]),
        _row(_ranked(language_stats), 1, F.format_string(layout, "name", *counts), rank="rank"),
        _text_rows(spark, 2, ["-" * 80]),
        _row(total, 3, F.format_string(layout, F.lit("Total"), *counts)),
        _row(total, 3, F.lit("=" * 80), rank="1"),
        _text_rows(spark, 3, ["", ""]).withColumn("rank", F.col("rank") + 2),
        _row(total, 3, timing, rank="4"),
    ]
    if errors is not None:
        parts.append(_report_errors(errors))
    if file_stats is not None:
        parts.append(report_files(file_stats))
    return _union(parts)


def _report_errors(errors: DataFrame) -> DataFrame:
    n = F.col("error_count")
    counted = error_count(errors).filter(n > 0)
    order = Window.partitionBy(F.lit(1)).orderBy("path")  # over the sample only
    sample = error_sample(errors).withColumn("rank", F.row_number().over(order))
    more = counted.filter(n > _ERROR_SAMPLE)
    return _union(
        [
            _row(counted, 4, F.lit("")),
            _row(counted, 4, F.format_string(" %s errors occurred:", n), rank="1"),
            _row(sample, 4, F.format_string("   %s. %s", "rank", "message"), rank="rank + 1"),
            _row(more, 4, F.format_string("   ... and %s more", n - _ERROR_SAMPLE), rank="99"),
        ]
    )


def _json_string(text: Column) -> Column:
    """JSON string literal of a column, quotes included."""
    wrapped = F.to_json(F.struct(text.alias("s")))
    return F.substr(wrapped, F.lit(6), F.length(wrapped) - 6)


def _json_object(indent: int, fields: dict[str, Column]) -> Column:
    """Pretty-printed JSON object with its keys in alphabetical order."""
    pad = " " * indent
    pairs = [F.concat(F.lit(f'{pad}  "{key}": '), fields[key].cast("string")) for key in sorted(fields)]
    return F.concat(F.lit("{\n"), F.concat_ws(",\n", *pairs), F.lit(f"\n{pad}}}"))


def report_json(
    language_stats: DataFrame,
    elapsed_ms: int = 0,
    error_count: int = 0,
    file_stats: DataFrame | None = None,
) -> DataFrame:
    """{summary, languages, files} as pretty-printed JSON, one row per array element.

    The comma after an element depends on whether it is the last one, found by one aggregate. Paths that
    look the same, of which only one is the last, are told apart by their number.
    """
    spark = language_stats.sparkSession
    totals = summary(language_stats, error_count, elapsed_ms).drop("files_per_sec", "lines_per_sec")
    keys = ("files", "lines", "code", "comments", "blanks", "bytes")
    element = _json_object(
        4, {"name": _json_string(F.col("name")), **{k: F.col(k) for k in keys}}
    )
    ranked = _ranked(language_stats)
    following = F.lead("rank").over(Window.partitionBy(F.lit(1)).orderBy("rank"))
    ranked = ranked.withColumn("comma", F.when(following.isNull(), "").otherwise(","))
    head = F.concat(
        F.lit('{\n  "summary": '),
        _json_object(2, {k: F.col(k) for k in totals.columns}),
        F.lit(',\n  "languages": ['),
    )
    parts = [
        _row(totals, 0, head),
        _row(ranked, 1, F.concat(F.lit("    "), element, F.col("comma")), rank="rank"),
    ]
    if file_stats is None:
        return _union([*parts, _text_rows(spark, 2, ["  ],", '  "files": null', "}"])])
    keys = ("lines", "code", "comments", "blanks", "bytes")
    element = _json_object(
        4,
        {
            "path": _json_string(F.col("path")),
            "language": _json_string(F.col("language")),
            **{k: F.col(k) for k in keys},
        },
    )
    last_path = F.col("path").eqNullSafe(F.lit(file_stats.agg(F.max("path")).first()[0]))
    alike = Window.partitionBy("path").orderBy(*[F.desc(key) for key in ("language", *keys)])
    lasts = file_stats.filter(last_path).withColumn("nth", F.row_number().over(alike))
    line = F.concat(F.lit("    "), element)
    return _union(
        [
            *parts,
            _text_rows(spark, 2, ["  ],", '  "files": [']),
            _row(file_stats.filter(~last_path), 3, F.concat(line, F.lit(",")), path="path"),
            _row(lasts.filter("nth > 1"), 3, F.concat(line, F.lit(",")), path="path"),
            _row(lasts.filter("nth = 1"), 3, line, rank="1", path="path"),
            _text_rows(spark, 4, ["  ]", "}"]),
        ]
    )


def report_csv(language_stats: DataFrame, file_stats: DataFrame | None = None) -> DataFrame:
    """Language rows and total, then file rows if given; values are not quoted."""
    spark = language_stats.sparkSession
    counts = ("lines", "code", "comments", "blanks", "bytes")
    total = S.total(language_stats)
    parts = [
        _text_rows(spark, 0, ["Type,Name,Files,Lines,Code,Comments,Blanks,Bytes"]),
        _row(
            _ranked(language_stats),
            1,
            F.concat_ws(",", F.lit("Language"), "name", "files", *counts),
            rank="rank",
        ),
        _row(total, 2, F.concat_ws(",", F.lit("Total"), F.lit("Total"), "files", *counts)),
    ]
    if file_stats is not None:
        head = ["", "File,Language,Lines,Code,Comments,Blanks,Bytes"]
        parts.append(_text_rows(spark, 3, head))
        line = F.concat_ws(",", "path", "language", *counts)
        parts.append(_row(file_stats, 4, line, path="path"))
    return _union(parts)


def report(
    fmt: str,
    language_stats: DataFrame,
    elapsed_ms: int = 0,
    errors: DataFrame | None = None,
    file_stats: DataFrame | None = None,
) -> DataFrame:
    """Report in format table, json or csv; any other name means table."""
    if fmt == "json":
        n_errors = 0 if errors is None else errors.count()
        return report_json(language_stats, elapsed_ms, n_errors, file_stats)
    if fmt == "csv":
        return report_csv(language_stats, file_stats)
    return report_table(language_stats, elapsed_ms, errors, file_stats)


def ordered(report: DataFrame) -> DataFrame:
    """The lines of a report in order."""
    return report.orderBy("section", "rank", "path").select("line")


def write_report(report: DataFrame, path: str) -> None:
    """Write a report as text; the part files in name order are the report."""
    ordered(report).write.text(path)


# Quotes are doubled and nothing is trimmed, so that any text comes back as it was.
_CSV = {"header": True, "quoteAll": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_files(language_stats: DataFrame, file_stats: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write the counts as tables, `languages` and `files` under `path`: csv with quotes, or json lines.

    Unlike the report layouts these are in no order, and each part file can be read by itself.
    """
    for table, name in ((language_stats, "languages"), (file_stats, "files")):
        if fmt == "csv":
            table.write.options(**_CSV).csv(f"{path}/{name}")
        elif fmt == "json":
            table.write.json(f"{path}/{name}", ignoreNullFields=False)
        else:
            raise ValueError(f"{fmt}: csv or json")


def read_files(spark: SparkSession, path: str, name: str, schema: str, fmt: str = "csv") -> DataFrame:
    """A table that `write_files` has written; `schema` as it was."""
    if fmt == "json":
        return spark.read.schema(schema).json(f"{path}/{name}")
    return spark.read.schema(schema).options(**_CSV, multiLine=True, lineSep="\n").csv(f"{path}/{name}")
