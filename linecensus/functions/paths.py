"""Column expressions over '/'-separated paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# SQL expressions over the column `path`.
NAME = "substring_index(path, '/', -1)"

# Text after the last dot; NULL when there is none or the only dot leads ('.gitignore').
EXTENSION = f"if(position('.', {NAME}, 2) > 0, substring_index({NAME}, '.', -1), NULL)"

# The name without the last dot and extension.
STEM = f"left({NAME}, length({NAME}) - coalesce(length({EXTENSION}) + 1, 0))"


def file_name(path: Column) -> Column:
    """Last segment of the path."""
    return F.substring_index(path, "/", -1)


def is_hidden(path: Column) -> Column:
    """Any segment of the (root-relative) path starts with a dot."""
    return path.startswith(".") | path.contains("/.")


def folders_above(rows: DataFrame, path: str, name: str, root: bool = False) -> DataFrame:
    """One row for each directory above `path`, as column `name`; the root ('') only if asked for."""
    slashes = F.length(path) - F.length(F.replace(F.col(path), F.lit("/")))
    steps = F.sequence(F.lit(0 if root else 1), slashes)
    if not root:
        steps = F.when(slashes > 0, steps)
    stepped = rows.select("*", F.explode(steps).alias("_steps"))
    return stepped.withColumn(name, F.expr(f"substring_index({path}, '/', _steps)")).drop("_steps")


def parent(path: Column) -> Column:
    """Directory of the path; '' = the root."""
    length = F.length(path) - F.length(file_name(path)) - 1
    return F.when(length > 0, F.left(path, length)).otherwise("")


# How bytes of a name that are not UTF-8 stand in a path. No name has a zero byte, so two names
# never get the same path.
ESCAPED = r"\x00[0-9a-f]+\x00"


def readable(path: Column) -> Column:
    """The path for people: a replacement character for bytes that are not UTF-8."""
    return F.regexp_replace(path, ESCAPED, "\ufffd")
