"""Helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linecensus.session import write_table

FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """One fold in five, by the checksum of the identifier; a row without one is not held out."""
    checksum = F.crc32(doc_id.cast("string").cast("binary"))
    return F.coalesce(checksum % FOLDS == 0, F.lit(False))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def located(docs: DataFrame) -> DataFrame:
    """`docs` with a hidden `_metadata` column that names the file and row of each document.

    Rows that do not come straight from files are written to the shared folder first.
    """
    try:
        docs.select("_metadata.file_path", "_metadata.row_index")
        return docs
    except AnalysisException:
        return write_table(docs, "documents")


def place_columns() -> list[Column]:
    """`file` and `row` of each row of a `located` table."""
    return [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]


def named_by_row(docs: DataFrame) -> DataFrame:
    """`(doc_id, text)` of a `located` table, where `doc_id` is a struct that names the row.

    Rows of one `doc_id`, and rows without, are different documents then. Structs are in the order of
    `doc_id`, rows without one last.
    """
    unnamed = F.col("doc_id").isNull().alias("unnamed")
    return docs.select(F.struct(unnamed, "doc_id", *place_columns()).alias("doc_id"), "text")


# A key with more rows than this, and than one in HEAVY_KEYS of all rows, is joined apart.
HEAVY_ROWS, HEAVY_KEYS = 256, 10_000


def join_by_weight(rows: DataFrame, table: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """`rows` joined with `table`, which has one row for each value of `on`, none of them null.

    Rows whose key is common stay where they are and meet a broadcast of the few rows of `table` with
    these keys: fewer than `HEAVY_KEYS`, whatever the size of the input, as each has more than that share of
    all rows. The others meet in a merge join, where no key has many rows. `rows` is read several times and
    should be a written table.
    """
    common = max(HEAVY_ROWS, rows.count() // HEAVY_KEYS)
    heavy = rows.groupBy(*on).count().filter(F.col("count") > common).select(*on)
    heavy = write_table(heavy, "heavy-keys")
    if heavy.isEmpty():
        return rows.join(table.hint("merge"), on, how)
    few = table.join(F.broadcast(heavy), on, "left_semi")
    apart = rows.join(F.broadcast(heavy), on, "left_semi").join(F.broadcast(few), on, how)
    others = rows.join(F.broadcast(heavy), on, "left_anti").join(table.hint("merge"), on, how)
    return apart.unionByName(others)
