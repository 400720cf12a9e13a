"""Line operators over a table of files `(path, language, content, ...)`.

None of them shuffles: a file is split, classified and counted within its row. The operators that return
lines take `piece_bytes`: texts longer than that are cut into pieces first (see `line_pieces`), which
costs one more scan of the table for their sake.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linecensus.functions import lines as N
from linecensus.operators import line_pieces as LP
from linecensus.operators.detect import comment_syntax


def _text() -> Column:
    return N.as_text(F.col("content"))


def _once(column: Column) -> Column:
    """The column through a generator of one row.

    A filter on what is computed from it stays above, where it would else be pushed below with the
    whole expression copied into it.
    """
    return F.explode(F.array(column))


def with_codes(files: DataFrame, *keep: str) -> DataFrame:
    """Columns `keep` of the files with their `text` and code string `codes`."""
    text = comment_syntax(files).select(
        *keep,
        "line_tok",
        "block_start",
        "block_end",
        _text().alias("text"),
        N.is_bytewise(F.col("content")).alias("bytewise"),
    )
    return text.select(*keep, "text", _once(N.line_codes()).alias("codes"))


def _with_long(files: DataFrame, piece_bytes: int | None, whole, by_piece) -> DataFrame:
    """`whole` of the files, but `by_piece` of the pieces of those over `piece_bytes`."""
    if piece_bytes is None:
        return whole(files)
    is_long = F.coalesce(LP.is_long(piece_bytes), F.lit(False))
    pieces = LP.cut_texts(files.filter(is_long), piece_bytes)
    short = whole(files.filter(~is_long))
    return short if pieces.isEmpty() else short.unionByName(by_piece(pieces))


def split_lines(files: DataFrame, piece_bytes: int | None = None) -> DataFrame:
    """One row per line: path, line_no (from 0), raw."""

    def whole(rows):
        return rows.select("path", F.posexplode(N.split_lines(_text())).alias("line_no", "raw"))

    return _with_long(files, piece_bytes, whole, LP.split_lines)


def count_newlines(files: DataFrame) -> DataFrame:
    return files.select("path", N.count_newlines(_text()).alias("newlines"))


def _blank_codes(files: DataFrame, *keep: str) -> DataFrame:
    text = files.select(*keep, _text().alias("text"))
    return text.select(*keep, _once(N.blank_codes()).alias("codes"))


def blank_lines(files: DataFrame) -> DataFrame:
    blanks = N.class_count(F.col("codes"), N.BLANK)
    return _blank_codes(files, "path").select("path", blanks.alias("blanks"))


def fast_stats(files: DataFrame) -> DataFrame:
    """Lines and blanks without comment parsing: everything else counts as code."""
    codes = F.col("codes")
    return _blank_codes(files, "path", "language", "size").select(
        "path",
        "language",
        F.length(codes).cast("bigint").alias("lines"),
        N.class_count(codes, N.CODE).alias("code"),
        F.lit(0).cast("bigint").alias("comments"),
        N.class_count(codes, N.BLANK).alias("blanks"),
        F.col("size").alias("bytes"),
    )


def _explode_letters(files: DataFrame, letters: Column, name: str) -> DataFrame:
    """One row per line of the file with its letter of `letters`, an expression over `codes`."""
    coded = with_codes(files, "path").filter("codes <> ''")
    rows = F.arrays_zip(
        N.split_lines(F.col("text")).alias("raw"), F.split(letters, "").alias("letter")
    )
    lettered = coded.select("path", F.posexplode(rows))
    return lettered.select(
        "path", F.col("pos").alias("line_no"), "col.raw", F.col("col.letter").alias(name)
    )


def _line_classes(lettered: DataFrame) -> DataFrame:
    cls = (
        F.when(F.col("letter") == N.CODE, "code")
        .when(F.col("letter") == N.COMMENT, "comment")
        .otherwise("blank")
    )
    return lettered.select("path", "line_no", "raw", cls.alias("cls"))


def classify_lines(files: DataFrame, piece_bytes: int | None = None) -> DataFrame:
    """One row per line: path, line_no (from 0), raw, cls (code / comment / blank)."""

    def whole(rows):
        return _line_classes(_explode_letters(rows, N.line_classes(F.col("codes")), "letter"))

    return _with_long(files, piece_bytes, whole, classify_pieces)


def classify_pieces(pieces: DataFrame) -> DataFrame:
    """The same of pieces of texts or files."""
    codes = F.col("codes")
    return _line_classes(LP.lettered_lines(pieces, N.line_classes(codes), N.line_classes_inside(codes)))


def block_state(files: DataFrame, piece_bytes: int | None = None) -> DataFrame:
    """One row per line: path, line_no (from 0), in_block (the line starts inside a block)."""
    in_block = (F.col("letter") == "1").alias("in_block")

    def whole(rows):
        lettered = _explode_letters(rows, N.block_states(F.col("codes")), "letter")
        return lettered.select("path", "line_no", in_block)

    def by_piece(pieces):
        codes = F.col("codes")
        lettered = LP.lettered_lines(pieces, N.block_states(codes), N.block_states_inside(codes))
        return lettered.select("path", "line_no", in_block)

    return _with_long(files, piece_bytes, whole, by_piece)


def file_stats(files: DataFrame) -> DataFrame:
    """path, language, lines, code, comments, blanks, bytes; an empty file has zeros."""
    classed = with_codes(files, "path", "language", "size").select(
        "path", "language", "size", N.line_classes(F.col("codes")).alias("classes")
    )
    classes = F.col("classes")
    return classed.select(
        "path",
        "language",
        F.length(classes).cast("bigint").alias("lines"),
        N.class_count(classes, N.CODE).alias("code"),
        N.class_count(classes, N.COMMENT).alias("comments"),
        N.class_count(classes, N.BLANK).alias("blanks"),
        F.col("size").alias("bytes"),
    )
