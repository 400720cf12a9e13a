"""Line rows of texts of any length, piece by piece.

A text is cut every `piece_bytes` bytes, wherever that falls. What a piece holds of its first and last line
goes to the rows of these lines, which are put together from all pieces they reach into; the lines between
stay in the piece, as a run. Two prefix scans over the pieces of a text, of a few numbers each, place them:

- the newlines before a piece give the number of its first line,
- the last line before a run that opens or closes a block comment tells whether the run starts inside one.

So a task holds one piece or one line, and only the lines that pieces share are shuffled as text. All text
is handled as one character per byte until a line is complete; then a text that is valid UTF-8 as a whole is
decoded, line by line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linecensus.functions import lines as N
from linecensus.operators.detect import comment_syntax
from linecensus.session import write_table

PIECE_BYTES = 4 * 1024 * 1024

_KEY = ["text_id", "path"]


def is_long(piece_bytes: int) -> Column:
    return F.octet_length("content") > piece_bytes


def cut_texts(files: DataFrame, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """`(text_id, path, language, bytewise, piece, bytes)` of files held as rows, written.

    `language` is null where the files have none. Texts of equal path are told apart.
    """
    language = F.col("language") if "language" in files.columns else F.lit(None).cast("string")
    pieces = F.floor((F.octet_length("content") - 1) / piece_bytes)
    numbered = files.select(
        F.monotonically_increasing_id().alias("text_id"),
        "path",
        language.alias("language"),
        N.is_bytewise(F.col("content")).alias("bytewise"),
        F.col("content").cast("binary").alias("content"),
    )
    cut = numbered.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), pieces)).alias("piece"))
    content = F.substr("content", (F.col("piece") * piece_bytes + 1).cast("int"), F.lit(piece_bytes))
    return write_table(cut.select(*_KEY, "language", "bytewise", "piece", content.alias("bytes")), "text-pieces")


def cut_files(read: DataFrame) -> DataFrame:
    """The same of the pieces of a tree (`path, language, offset, content`, see `sources.content`).

    Whether a file is valid UTF-8 is not known from a piece: each line is decoded by itself.
    """
    pieces = read.filter("error IS NULL AND octet_length(content) > 0").select(
        F.lit(0).cast("bigint").alias("text_id"),
        "path",
        "language",
        F.lit(None).cast("boolean").alias("bytewise"),
        F.col("offset").alias("piece"),
        F.col("content").alias("bytes"),
    )
    return write_table(pieces, "file-pieces")


def line_runs(pieces: DataFrame) -> DataFrame:
    """`(text_id, path, language, bytewise, first_line, text)`: complete lines, one byte a character.

    A run is the lines of a piece between its first and last newline, or one line that pieces share.
    """
    text = F.decode("bytes", "ISO-8859-1")
    named = [*_KEY, "language", "bytewise"]
    # Every piece in two steps: its newlines, then where its lines are numbered from.
    counts = pieces.select(*_KEY, "piece", N.count_newlines(text).alias("newlines"))
    counts = write_table(counts, "piece-newlines")
    text_pieces = Window.partitionBy(*_KEY)
    earlier = text_pieces.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.select(
        *_KEY, "piece", "newlines",
        F.coalesce(F.sum("newlines").over(earlier), F.lit(0)).alias("first_line"),
        F.sum("newlines").over(text_pieces).alias("last_line"),
    )
    joined = pieces.join(placed.hint("merge"), [*_KEY, "piece"])
    parted = joined.select(*named, "piece", "newlines", "first_line", "last_line", text.alias("text")).withColumns(
        {"first": F.position(F.lit("\n"), F.col("text")), "last": F.length("text") - F.expr("position('\n', reverse(text))")}
    )
    # last: characters before the last newline.
    parted = write_table(parted, "placed-pieces")
    runs = parted.filter("newlines > 1").select(
        *named,
        (F.col("first_line") + 1).alias("first_line"),
        F.expr("substr(text, first + 1, last - first + 1)").alias("text"),
    )
    some = F.col("newlines") > 0
    head = F.struct(
        F.col("first_line").alias("line"), F.when(some, F.expr("left(text, first - 1)")).otherwise(F.col("text")).alias("part")
    )
    tail = F.when(
        some, F.struct((F.col("first_line") + F.col("newlines")).alias("line"), F.expr("substr(text, last + 2)").alias("part"))
    )
    ends = parted.select(*named, "piece", "last_line", F.posexplode(F.array_compact(F.array(head, tail))).alias("at", "end"))
    parts = F.sort_array(F.collect_list(F.struct("piece", "at", "end.part")))
    shared = ends.groupBy(*named, "end.line", "last_line").agg(F.array_join(parts["part"], "").alias("text"))
    # Nothing after the last newline is no line.
    shared = shared.filter("line < last_line OR text <> ''")
    return runs.unionByName(shared.select(*named, F.col("line").alias("first_line"), F.concat("text", F.lit("\n")).alias("text")))


def _decoded(line: Column) -> Column:
    data = F.encode(line, "ISO-8859-1")
    return F.when(F.col("bytewise"), line).otherwise(N.as_text(data))


def split_lines(pieces: DataFrame) -> DataFrame:
    """One row per line: path, line_no (from 0), raw."""
    lines = line_runs(pieces).select("path", "bytewise", "first_line", F.posexplode(N.split_lines(F.col("text"))))
    return lines.select("path", (F.col("first_line") + F.col("pos")).cast("int").alias("line_no"), _decoded(F.col("col")).alias("raw"))


def lettered_lines(pieces: DataFrame, outside: Column, inside: Column) -> DataFrame:
    """`(path, line_no, raw, letter)`: letters of expressions over `codes` for runs that start outside
    and inside a block comment."""
    runs = comment_syntax(line_runs(pieces)).withColumnRenamed("bytewise", "valid").withColumn("bytewise", F.lit(True))
    coded = runs.select(*_KEY, F.col("valid").alias("bytewise"), "first_line", "text", N.line_codes().alias("codes"))
    coded = write_table(coded, "coded-runs")
    events = coded.select(*_KEY, "first_line", N.last_event(F.col("codes")).alias("event"))
    earlier = Window.partitionBy(*_KEY).orderBy("first_line").rowsBetween(Window.unboundedPreceding, -1)
    carried = F.coalesce(F.last("event", ignorenulls=True).over(earlier), F.lit(False)).alias("starts_inside")
    starts = events.select(*_KEY, "first_line", carried)
    joined = coded.join(starts.hint("merge"), [*_KEY, "first_line"])
    letters = F.when(F.col("starts_inside"), inside).otherwise(outside)
    rows = F.arrays_zip(N.split_lines(F.col("text")).alias("raw"), F.split(letters, "").alias("letter"))
    lines = joined.select("path", "bytewise", "first_line", F.posexplode(rows))
    return lines.select(
        "path", (F.col("first_line") + F.col("pos")).cast("int").alias("line_no"),
        _decoded(F.col("col.raw")).alias("raw"), "col.letter",
    )
