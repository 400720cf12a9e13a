"""Language detection from the path, language filter and comment syntax."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linecensus.functions import languages as L
from linecensus.functions import paths as P


def path_parts(df: DataFrame) -> DataFrame:
    """Add `name`, `stem` and `ext` of `path`."""
    return df.withColumns(
        {"name": F.expr(P.NAME), "stem": F.expr(P.STEM), "ext": F.expr(P.EXTENSION)}
    )


def detect_language(df: DataFrame) -> DataFrame:
    """Add `language`: the lower-cased stem looked up first, then the lower-cased extension.

    A third look-up of the full name could never decide: a dotless special name equals its own
    stem, and 'cargo.toml' is found by its extension.
    """
    return df.withColumn(
        "language",
        F.coalesce(
            L.language_of_filename(f"lower({P.STEM})"),
            L.language_of_extension(f"lower({P.EXTENSION})"),
            F.lit(L.UNKNOWN),
        ),
    )


def is_code_file() -> Column:
    """Filter condition: the language is known."""
    return F.col("language") != L.UNKNOWN


def option_list(values: str | Iterable[str]) -> list[str]:
    """Values of an option given as a list or as one comma-separated text."""
    return [v for v in values.split(",") if v] if isinstance(values, str) else list(values)


def language_filter(df: DataFrame, languages: str | Iterable[str]) -> DataFrame:
    """Keep rows whose display name equals one of `languages`, ignoring case; empty = keep all."""
    wanted = [name.lower() for name in option_list(languages)]
    return df.filter(F.lower("language").isin(wanted)) if wanted else df


def comment_syntax(df: DataFrame) -> DataFrame:
    """Add `line_tok`, `block_start` and `block_end` of `language`."""
    return df.withColumns(L.syntax_columns())


def language_filter_entries(listing: DataFrame, languages: str | Iterable[str]) -> DataFrame:
    """`language_filter` for a listing that also has rows other than files."""
    wanted = [name.lower() for name in option_list(languages)]
    if not wanted:
        return listing
    return listing.filter((F.col("kind") != "file") | F.lower("language").isin(wanted))
