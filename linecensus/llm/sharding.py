"""Sharding by histogram sort.

Every document gets a 63-bit key: 40 bits from its text, so that equal texts are neighbours, and 23
bits from its identifier, so that a group of copies of any size can still be divided. The shards
are consecutive key ranges of near equal bytes. Their boundaries (splitters) are found without
sorting: each round counts the exact bytes of the buckets that hold an unsettled splitter (one
aggregate of at most `BUCKETS` rows per splitter), takes the bucket edge next below and above the
wanted byte position, and probes only inside that bucket in the next round. A splitter is settled
when an edge is within the tolerance or the bucket cannot be divided any more. Rows are then exchanged once,
to number the places in each shard. Edges of the first rounds never part equal texts; only a
splitter that cannot meet the tolerance there is refined inside a group of copies.

- A null text has no bytes and counts as empty; a null `doc_id` is hashed as a value of its own.
- Repeated rows have the same key; they stay together, with successive places.
- An empty table gives an empty result; fewer rows than shards leave shards empty.
- The columns added are `size`, `text_crc32`, `shard` and `slot`; columns of these names are replaced.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linecensus.llm.common import text_or_empty
from linecensus.session import write_table

SHARDS = 40
ROW_BYTES = 16
# A boundary may be off by this part of a shard's share; within it, equal texts are not parted.
TOLERANCE = 0.005
# Widths of the digits of a key, from the top: 40 bits of the text, 23 bits of the identifier.
DIGITS = (10, 10, 10, 10, 12, 11)
KEY_BITS = sum(DIGITS)
BUCKETS = 1 << max(DIGITS)
# Rows of a shard are numbered in this many parts, so that no task holds a whole shard.
PARTS = 64
_TEXT_BITS, _ID_BITS = sum(DIGITS[:4]), sum(DIGITS[4:])


def shard_key() -> Column:
    text = F.shiftrightunsigned(F.xxhash64(text_or_empty()), 64 - _TEXT_BITS)
    identifier = F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - _ID_BITS)
    return F.shiftleft(text, _ID_BITS).bitwiseOR(identifier)


def row_size() -> Column:
    return F.octet_length(text_or_empty()).cast("bigint") + ROW_BYTES


def splitters(keyed: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[int]:
    """Lower key bounds of shards 1 to `shards - 1` for rows `(key, size)`.

    Only bucket counts reach the driver: at most `shards * BUCKETS` rows a round, whatever the input.
    """
    total = keyed.agg(F.sum("size")).first()[0] or 0
    allowed = tolerance * total / shards
    found: dict[int, int] = {}
    # Bucket prefix -> (bytes below it, splitters inside it).
    open_buckets = {0: (0, list(range(1, shards)))}
    shift = KEY_BITS
    for width in DIGITS:
        rows = keyed
        if shift < KEY_BITS:
            rows = rows.filter(F.shiftright("key", shift).isin(*open_buckets))
        shift -= width
        counted = rows.groupBy(F.shiftright("key", shift).alias("bucket")).agg(F.sum("size").alias("size"))
        sizes: dict[int, list[tuple[int, int]]] = {}
        for bucket, size in counted.collect():
            sizes.setdefault(bucket >> width, []).append((bucket, size))
        refined: dict[int, tuple[int, list[int]]] = {}
        for prefix, (below, inside) in open_buckets.items():
            buckets = sorted(sizes.get(prefix, []))
            ends = list(accumulate((size for _, size in buckets), initial=below))
            for i in inside:
                wanted = total * i / shards
                at = next((k for k in range(len(buckets)) if ends[k + 1] > wanted), None)
                if at is None:  # nothing lies above
                    found[i] = (1 << KEY_BITS) - 1
                    continue
                bucket = buckets[at][0]
                off, edge = min((wanted - ends[at], bucket), (ends[at + 1] - wanted, bucket + 1))
                if off <= allowed or shift == 0:
                    found[i] = edge << shift
                else:
                    refined.setdefault(bucket, (ends[at], []))[1].append(i)
        open_buckets = refined
        if not open_buckets:
            break
    return [found[i] for i in range(1, shards)]


def histogram_shards(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """`docs` with size, text_crc32, shard and slot (gapless from 0 in each shard).

    The sizes and keys that the rounds read are written once, without the texts.
    """
    key, size = shard_key(), row_size()
    keyed = write_table(docs.select(key.alias("key"), size.alias("size")), "shard-keys")
    bounds = splitters(keyed, shards, tolerance)
    crc = F.crc32(text_or_empty().cast("binary"))
    # One comparison per splitter; equal bounds (empty shards) are passed together.
    shard = sum((F.when(key >= bound, 1).otherwise(0) for bound in bounds), F.lit(0))
    part = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(PARTS))
    # The key is a struct of internal columns, so that no column of `docs` can clash with it.
    placed = docs.withColumns({"size": size, "text_crc32": crc, "shard": shard}).withColumn(
        _PLACE, F.struct(part.alias("part"), key.alias("key"))
    )
    counts = (
        docs.select(shard.alias("shard"), part.alias("part"))
        .groupBy("shard", "part")
        .agg(F.count("*").alias("rows"))
    )
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # At most shards * PARTS rows.
    starts = counts.select(
        F.col("shard").alias("of_shard"),
        F.col("part").alias("of_part"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias(_START),
    )
    numbered = placed.withColumn(
        "slot",
        F.row_number().over(
            Window.partitionBy("shard", f"{_PLACE}.part").orderBy(f"{_PLACE}.key", "doc_id")
        ),
    )
    joined = numbered.join(
        F.broadcast(starts),
        (F.col("shard") == F.col("of_shard")) & (F.col(f"{_PLACE}.part") == F.col("of_part")),
    )
    slot = (F.col("slot") - 1 + F.col(_START)).cast("bigint")
    return joined.withColumn("slot", slot).drop(_PLACE, _START, "of_shard", "of_part")


_PLACE, _START = "__place", "__start"


def op4_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return histogram_shards(docs).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
