"""Exact deduplication with the keyed state of a structured stream.

Fingerprints flow through a streaming aggregation whose state lives on disk (RocksDB), is kept
in the shared folder and never expires. Per digest the state retains the number of rows and the
document that stays: its length, identifier and content locator (file and row). A digest that
was met more than once is a hit; the full bytes of every hit are fetched by locator and compared
with those of the document that stays, so equal digests of different texts are told apart.

Two texts are equal when they are identical after deleting ASCII white space. Of equal texts the
row with the most code points stays, then the smallest `doc_id`, then a fixed row of several with
the same `doc_id`.

- A null text counts as empty; all empty texts (also those of white space only) are one group.
- A null `doc_id` loses every tie; its row is still counted, kept or dropped.
- Repeated rows are copies of each other: one of them stays.
- Only `doc_id` and `text` are read; other columns may have any name.
- An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linecensus.llm.common import located, text_or_empty
from linecensus.session import scratch_path, write_table

# Rows of a group of copies that one key of the byte comparison has, about.
COMPARED_ROWS = 256
# Settings of the state: on disk, with one memory bound for all stores of an executor.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
_LOCATOR = ("file", "row")


def normalised(text: Column) -> Column:
    """The text without ASCII white space (space, and tab to carriage return)."""
    return F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", "")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def fingerprints(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """`(doc_id, digest, chars, file, row)` of each document, without its text."""
    return located(docs).select(
        "doc_id",
        digest(normalised(text_or_empty())).alias("digest"),
        F.char_length(text_or_empty()).cast("bigint").alias("chars"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
    )


def update_state(spark: SparkSession, prints: DataFrame, folder: str, checkpoint: str) -> None:
    """Run the fingerprint files of `folder` that the state has not seen through the stream.

    Calling it again after more files have arrived continues from the retained state.
    """
    stream = spark.readStream.schema(prints.schema).parquet(folder)
    seen = stream.groupBy("digest").agg(_stays().alias("stays"), F.count("*").alias("rows"))
    before = {key: spark.conf.get(key, None) for key in STATE_SETTINGS}
    for key, value in STATE_SETTINGS.items():
        spark.conf.set(key, value)
    try:
        query = (
            seen.writeStream.format("noop")
            .outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def _stays() -> Column:
    unnamed = F.col("doc_id").isNull().alias("unnamed")
    return F.min(F.struct(F.negative("chars").alias("shorter"), unnamed, "doc_id", *_LOCATOR))


def read_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The retained state: `(digest, rows, keep_id, keep_file, keep_row)`, one row per digest."""
    state = spark.read.format("statestore").load(checkpoint)
    stays, rows = state.schema["value"].dataType.fieldNames()
    return state.select(
        "key.digest",
        F.col(f"value.{rows}").alias("group_size"),
        F.col(f"value.{stays}.doc_id").alias("keep_id"),
        F.col(f"value.{stays}.file").alias("keep_file"),
        F.col(f"value.{stays}.row").alias("keep_row"),
    )


def exact_dedup(
    docs: DataFrame,
    digest: Callable[[Column], Column] = sha256,
    checkpoint: str | None = None,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, digest and its locator."""
    spark = docs.sparkSession
    docs = located(docs)
    folder = scratch_path(spark, "fingerprints")
    fingerprints(docs, digest).write.parquet(folder)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, digest binary, chars bigint, file string, row bigint"
    prints = spark.read.schema(schema).parquet(folder)
    checkpoint = checkpoint or scratch_path(spark, "dedup-state")
    if prints.isEmpty():
        groups = prints.select(
            "digest",
            F.col("row").alias("group_size"),
            F.col("doc_id").alias("keep_id"),
            F.col("file").alias("keep_file"),
            F.col("row").alias("keep_row"),
        )
    else:
        update_state(spark, prints, folder, checkpoint)
        groups = write_table(read_state(spark, checkpoint), "dedup-groups")
    other = _unequal(docs, prints, groups)
    grouped = prints.join(groups, "digest")
    if other is None:
        return _labelled(grouped)
    moved = other.groupBy("digest").agg(F.count("*").alias("moved"))
    rest = grouped.join(other.select(*_LOCATOR), list(_LOCATOR), "left_anti")
    rest = rest.join(moved, "digest", "left").withColumn(
        "group_size", F.col("group_size") - F.coalesce("moved", F.lit(0))
    )
    key = ["digest", "content"]
    own = other.groupBy(*key).agg(_stays().alias("stays"), F.count("*").alias("group_size"))
    own = other.join(own, key).withColumns(
        {
            "keep_id": F.col("stays.doc_id"),
            "keep_file": F.col("stays.file"),
            "keep_row": F.col("stays.row"),
        }
    )
    return _labelled(rest).unionByName(_labelled(own))


def _labelled(grouped: DataFrame) -> DataFrame:
    kept = (F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row"))
    columns = ("doc_id", "keep_id", "group_size", kept.alias("kept"), "digest", *_LOCATOR)
    return grouped.select(*columns)


def _unequal(docs: DataFrame, prints: DataFrame, groups: DataFrame) -> DataFrame | None:
    """Hits whose full text differs from that of their group's document; None if there are none.

    Texts are moved by locator, a unique key, by a merge join at every size. A group is then compared in
    parts of about `COMPARED_ROWS` rows, each with a copy of the text that stays.
    """
    hits = prints.join(groups.filter("group_size > 1"), "digest")
    hits = write_table(hits, "dedup-hits")
    texts = docs.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
        normalised(text_or_empty()).alias("content"),
    )
    same_row = (F.col("keep_file") == F.col("file")) & (F.col("keep_row") == F.col("row"))
    parts = F.ceil(F.col("group_size") / COMPARED_ROWS).alias("parts")
    kept = hits.filter(same_row).select(*_LOCATOR, parts)
    kept = texts.join(kept.hint("merge"), list(_LOCATOR)).select(
        F.col("file").alias("keep_file"),
        F.col("row").alias("keep_row"),
        F.col("content").alias("kept_content"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"),
    )
    dealt = hits.filter(~same_row).withColumn("part", F.pmod(F.xxhash64(*_LOCATOR), parts))
    members = texts.join(dealt.hint("merge"), list(_LOCATOR))
    differing = members.join(kept, ["keep_file", "keep_row", "part"]).filter("content <> kept_content")
    columns = ("doc_id", "digest", "chars", *_LOCATOR, "content")
    found = write_table(differing.select(*columns), "dedup-unequal")
    return None if found.isEmpty() else found


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its group of equal texts."""
    result = exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return result.select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


OP10_SQL = """
WITH norm AS (
    SELECT doc_id, length(coalesce(text, '')) AS chars,
           sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
    FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER g AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER g = 1 AS kept,
       text_sha256
FROM norm
WINDOW g AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id)
"""
