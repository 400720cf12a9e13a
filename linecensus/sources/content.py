"""Reading the files of a manifest and counting their lines.

A file is read in pieces of at most `PIECE_BYTES` (a little longer to finish the line at the end of
a piece), so the work of one task is bounded even if one file holds most of the bytes. A line over
`LONG_LINE_BYTES` is reduced, while it is read, to a short line of the same class.
"""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from linecensus.functions import lines as N
from linecensus.functions.languages import LANGUAGES
from linecensus.functions.long_lines import LongLine
from linecensus.operators.lines import with_codes
from linecensus.operators.stats import COUNTS

PIECE_BYTES = 8 * 1024 * 1024

# Work per task, more when that would give too many tasks for one job. Opening a file is charged
# like reading OPEN_COST_BYTES.
TASK_BYTES = 256 * 1024 * 1024
MAX_TASKS = 100_000
OPEN_COST_BYTES = 64 * 1024

# Lines longer than this are reduced; files are read in blocks of this size too.
LONG_LINE_BYTES = 1024 * 1024

_BATCH_BYTES = 16 * 1024 * 1024
# Contents that a worker holds before it sends them on, to within one piece.
_HELD_BYTES = 4 * 1024 * 1024
_SCAN_BYTES = 64 * 1024

_BLOCK_TOKENS = {language[1]: language[3:5] for language in LANGUAGES}


# Parts over which the running weight of a manifest is summed; their totals are added up on the driver.
WEIGHT_PARTS = 256


def pack_by_size(manifest: DataFrame) -> DataFrame:
    """Spread the manifest over tasks of equal total size, to within one piece.

    All rows lie on one line, each as long as its weight, and the tasks are equal sections of it. The place of
    a row is the running weight within its part, by hash of its path, after the total of the parts before.
    """
    size = F.col("size")
    if "offset" in manifest.columns:
        size = F.coalesce(F.col("length"), size - F.col("offset"))
    weighed = manifest.withColumns(
        {
            "weight": F.least(size, F.lit(PIECE_BYTES)) + OPEN_COST_BYTES,
            "part": F.pmod(F.xxhash64("path", *(c for c in ("piece", "offset") if c in manifest.columns)), F.lit(WEIGHT_PARTS)),
        }
    )
    sums = {r.part: r for r in weighed.groupBy("part").agg(F.sum("weight").alias("w"), F.count("*").alias("n")).collect()}
    if not sums:
        return manifest
    total, rows = sum(r.w for r in sums.values()), sum(r.n for r in sums.values())
    least = min(rows, manifest.sparkSession.sparkContext.defaultParallelism)
    tasks = max(least, min(MAX_TASKS, -(-total // TASK_BYTES)))
    before = [sum(r.w for part, r in sums.items() if part < at) for at in range(WEIGHT_PARTS)]
    order = Window.partitionBy("part").orderBy("path", *(c for c in ("offset",) if c in manifest.columns))
    running = F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # The middle of a row decides.
    starts = F.array(*[F.lit(weight).cast("bigint") for weight in before])
    middle = F.get(starts, F.col("part").cast("int")) + running - F.col("weight") / 2
    placed = weighed.withColumn("task", F.least(F.floor(middle * tasks / total), F.lit(tasks - 1)).cast("int"))
    return placed.repartitionById(tasks, "task").drop("weight", "part", "task")


def _find_newline(file, start: int, stop: int | None) -> int | None:
    """Position of the first newline in [start, stop), None when there is none."""
    file.seek(start)
    while stop is None or start < stop:
        size = _SCAN_BYTES if stop is None else min(_SCAN_BYTES, stop - start)
        block = file.read(size)
        if not block:
            return None
        at = block.find(b"\n")
        if at >= 0:
            return start + at
        start += len(block)
    return None


def _read_lines(
    name: bytes, offset: int, length: int | None, language: str | None, long_line: int
) -> bytes:
    """The lines that start in [offset, offset + length); length None = up to the end."""
    with open(name, "rb", buffering=0) as file:
        at, stop = offset, None if length is None else offset + length
        if offset:
            before = _find_newline(file, offset - 1, None if stop is None else stop - 1)
            if before is None:
                return b""
            at = before + 1
        file.seek(at)
        return b"".join(_lines_from(file, at, stop, _BLOCK_TOKENS.get(language, (None, None)), long_line))


def _lines_from(file, at: int, stop: int | None, tokens: tuple, long_line: int) -> Iterator[bytes]:
    """Lines from position `at` on that start before `stop`, the long ones reduced."""
    held, reduced = b"", None  # what was read of the line that is not finished
    while block := file.read(long_line):
        ended = block.find(b"\n")
        if ended < 0:
            if reduced is None and len(held) + len(block) > long_line:
                reduced = LongLine(*tokens)
                reduced.feed(held)
                held = b""
            if reduced is None:
                held += block
            else:
                reduced.feed(block)
            at += len(block)
            continue
        if reduced is None:
            yield held + block[: ended + 1]
        else:
            reduced.feed(block[:ended])
            yield reduced.finish() + b"\n"
        held, reduced = b"", None
        ended += 1
        if stop is not None and at + ended >= stop:
            return
        # Lines within a block are never long; those that start before `stop` end the piece.
        last = block.rfind(b"\n") + 1
        if stop is not None and stop <= at + last:
            last = block.index(b"\n", stop - at - 1) + 1
            yield block[ended:last]
            return
        yield block[ended:last]
        held = block[last:]
        at += len(block)
    yield held if reduced is None else reduced.finish()


def _read_bytes(name: bytes, offset: int, length: int | None) -> bytes:
    """The bytes [offset, offset + length) as they are; length None = up to the end."""
    with open(name, "rb", buffering=0) as file:
        file.seek(offset)
        parts, left = [], length
        while left != 0 and (block := file.read(_BATCH_BYTES if left is None else left)):
            parts.append(block)
            left = None if left is None else left - len(block)
        return b"".join(parts)


_READ_BY = ("path", "raw_path", "size", "offset", "length", "language")


def _reader(root: bytes, long_line: int | None):
    """Adds the content of pieces: reduced lines, or the bytes as they are without `long_line`."""

    def content_of(columns: dict, i: int) -> bytes:
        raw = columns["raw_path"][i]
        name = os.path.join(root, columns["path"][i].encode("utf-8") if raw is None else raw)
        piece = name, columns["offset"][i], columns["length"][i]
        if not columns["size"][i]:
            return b""
        if long_line is None:
            return _read_bytes(*piece)
        return _read_lines(*piece, columns["language"][i], long_line)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {name: batch.column(name).to_pylist() for name in _READ_BY if name in batch.schema.names}
            contents, errors, held, first = [], [], 0, 0
            for i in range(batch.num_rows):
                content, error = b"", None
                try:
                    content = content_of(columns, i)
                except OSError as failed:
                    reason = os.strerror(failed.errno) if failed.errno else str(failed)
                    error = f"{reason} (os error {failed.errno})"
                contents.append(content)
                errors.append(error)
                held += len(content)
                if held >= _HELD_BYTES or i == batch.num_rows - 1:
                    part = batch.slice(first, i + 1 - first)
                    added = pa.array(contents, pa.binary()), pa.array(errors, pa.string())
                    # Nothing is kept twice while the batch is sent.
                    contents, errors, held, first, content = [], [], 0, i + 1, b""
                    part = pa.RecordBatch.from_arrays(
                        [*part.columns, *added], [*batch.schema.names, "content", "error"]
                    )
                    del added
                    yield part
                    del part

    return read


def _read(pieces: DataFrame, root: str, long_line: int | None) -> DataFrame:
    """Adds content and error to rows with path, raw_path, size, offset and length."""
    added = [StructField("content", BinaryType()), StructField("error", StringType())]
    schema = StructType([*pieces.schema.fields, *added])
    return pack_by_size(pieces).mapInArrow(_reader(os.fsencode(root), long_line), schema)


def _pieces(manifest: DataFrame, piece_bytes: int) -> DataFrame:
    """One row per piece, with `piece`, `offset` and `length` (NULL for the last one)."""
    last = F.greatest(F.floor((F.col("size") - 1) / piece_bytes), F.lit(0)).cast("bigint")
    return manifest.select("*", F.explode(F.sequence(F.lit(0), last)).alias("piece")).withColumns(
        {
            "offset": F.col("piece") * piece_bytes,
            "length": F.when(F.col("piece") < last, F.lit(piece_bytes).cast("bigint")),
        }
    )


def read_content(manifest: DataFrame, root: str, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Manifest with `offset`, `content` and `error`: one row per `piece_bytes` of a file.

    The contents of a file, by offset, are its bytes; a file that cannot be read has an error.
    """
    return _read(_pieces(manifest, piece_bytes), root, None).drop("piece", "length")


def _digester(root: bytes):
    """Four numbers for each piece: SHA-256 of its offset and bytes, read block by block; nulls if it cannot be read."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, found = batch.to_pydict(), []
            for i in range(batch.num_rows):
                raw, left = columns["raw_path"][i], columns["length"][i]
                name = os.path.join(root, columns["path"][i].encode("utf-8") if raw is None else raw)
                state = hashlib.sha256(struct.pack(">q", columns["offset"][i]))
                try:
                    with open(name, "rb", buffering=0) as file:
                        file.seek(columns["offset"][i])
                        while left != 0 and (block := file.read(min(left or LONG_LINE_BYTES, LONG_LINE_BYTES))):
                            state.update(block)
                            left = None if left is None else left - len(block)
                    found.append(struct.unpack(">4q", state.digest()))
                except OSError:
                    found.append((None,) * 4)
            numbers = [pa.array(column, pa.int64()) for column in zip(*found)] or [pa.array([], pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([*batch.columns, *numbers], [*batch.schema.names, *_DIGEST])

    return digest


_DIGEST = ("digest0", "digest1", "digest2", "digest3")


def content_digest(manifest: DataFrame, root: str) -> DataFrame:
    """Manifest with `digest` of the bytes of each file, null where it cannot be read.

    It is the exclusive or of the SHA-256 values of all pieces with their offsets, so pieces are read by any
    task and in any order, and no file's pieces are gathered.
    """
    pieces = _pieces(manifest, PIECE_BYTES).drop("piece")
    schema = StructType([*pieces.schema.fields, *[StructField(name, LongType()) for name in _DIGEST]])
    read = pack_by_size(pieces).mapInArrow(_digester(os.fsencode(root)), schema)
    others = [F.first(c).alias(c) for c in manifest.columns if c != "path"]
    whole = [F.lpad(F.hex(F.bit_xor(name)), 16, "0") for name in _DIGEST]
    digest = F.when(F.count(_DIGEST[0]) == F.count("*"), F.lower(F.concat(*whole)))
    return read.groupBy("path").agg(*others, digest.alias("digest")).select(*manifest.columns, "digest")


def read_errors(read: DataFrame) -> DataFrame:
    """path and message of the files that could not be read."""
    message = F.concat("path", F.lit(": "), "error")
    # A file read in pieces has an error for each.
    return read.filter(F.col("error").isNotNull()).select("path", message.alias("message")).distinct()


def _counts(classes):
    return {
        "lines": F.length(classes).cast("bigint"),
        "code": N.class_count(classes, N.CODE),
        "comments": N.class_count(classes, N.COMMENT),
        "blanks": N.class_count(classes, N.BLANK),
    }


def _count_whole(manifest: DataFrame, root: str, long_line: int) -> DataFrame:
    """Files of one piece: read, classified and counted without a further shuffle."""
    keep = [c for c in manifest.columns if c != "raw_path"]
    whole = manifest.withColumns(
        {"offset": F.lit(0).cast("bigint"), "length": F.lit(None).cast("bigint")}
    )
    coded = with_codes(_read(whole, root, long_line), *keep, "error")
    classed = coded.select(*keep, "error", N.line_classes(F.col("codes")).alias("classes"))
    counts = [column.alias(name) for name, column in _counts(F.col("classes")).items()]
    return classed.select(*keep, *counts, F.col("size").alias("bytes"), "error")


def _count_pieces(manifest: DataFrame, root: str, piece_bytes: int, long_line: int) -> DataFrame:
    """Files of several pieces.

    A piece is reduced to its counts for both states it may start in and to the state it ends in;
    only those few numbers are shuffled and ordered per file.
    """
    keep = [c for c in manifest.columns if c != "raw_path"]
    read = _read(_pieces(manifest, piece_bytes), root, long_line)
    coded = with_codes(read, *keep, "piece", "error")
    classed = coded.select(
        *keep,
        "piece",
        "error",
        N.line_classes(F.col("codes")).alias("outside"),
        N.line_classes_inside(F.col("codes")).alias("inside"),
        N.last_event(F.col("codes")).alias("event"),
    )
    reduced = classed.select(
        *keep,
        "piece",
        "error",
        "event",
        F.struct(*[c.alias(n) for n, c in _counts(F.col("outside")).items()]).alias("outside"),
        F.struct(*[c.alias(n) for n, c in _counts(F.col("inside")).items()]).alias("inside"),
    )
    before = (
        Window.partitionBy("path").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts_inside = F.coalesce(F.last("event", ignorenulls=True).over(before), F.lit(False))
    placed = reduced.withColumn(
        "counts", F.when(starts_inside, F.col("inside")).otherwise(F.col("outside"))
    )
    sums = [F.sum(f"counts.{name}").alias(name) for name in COUNTS if name != "bytes"]
    others = [F.first(c).alias(c) for c in keep if c != "path"]
    summed = placed.groupBy("path").agg(*others, *sums, F.max("error").alias("error"))
    return summed.select(*keep, *COUNTS[:-1], F.col("size").alias("bytes"), "error")


def count_files(
    manifest: DataFrame,
    root: str,
    piece_bytes: int = PIECE_BYTES,
    long_line_bytes: int = LONG_LINE_BYTES,
) -> DataFrame:
    """Manifest with lines, code, comments, blanks, bytes and error per file."""
    small = _count_whole(manifest.filter(F.col("size") <= piece_bytes), root, long_line_bytes)
    large = manifest.filter(F.col("size") > piece_bytes)
    if large.isEmpty():
        return small
    return small.unionByName(_count_pieces(large, root, piece_bytes, long_line_bytes))
