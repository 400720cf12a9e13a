"""Best-fit packing of tokenised documents with exact-complement hashing.

Documents become token pieces of at most `capacity` ids. Packing needs only how many pieces of each
length there are: a table of at most `capacity` counts, whatever the size of the corpus. On it, from
the longest length down, the gap that a length leaves is looked up among the available single
lengths, then the pair sums, then the triple sums (the index is a bit set of the available lengths;
one shift and one intersection answer all pairs of a sum). A combination that fills the gap exactly is consumed as often
as its lengths are available. What has no exact complement is placed best-fit, longest first.

The plan is a list of patterns with multiplicities. The pieces of a length are numbered (in salted
parts, so that a length that a third of all pieces has is no single task), and a pattern takes a
range of numbers of each of its lengths, so that every piece finds its sequence and offset by one
search in a table that the executors share.

Tokenising: the word tokenizer never joins characters across white space, so the ids of a text are
those of its white-space separated chunks, which workers remember. Text of Latin letters, digits,
ASCII white space and punctuation (but apostrophes and angle brackets) is cut further into the runs
that are tokens of their own, of which there are fewer. Texts with special tokens or control characters that count as white space in one
library only are encoded whole, and so is everything if a tokenizer does not split this way.

- A null text counts as empty; an empty text is the end id alone.
- A document longer than the capacity is cut into full pieces and a last one; nothing is dropped.
- A null `doc_id` and repeated rows are packed like any other; only `doc_id` and `text` are read.
- An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linecensus.llm.token_counts import blocks
from linecensus.session import write_table

CAPACITY = 4096
END_ID = 1
# Distinct runs and chunks in each of the two generations that a worker remembers.
REMEMBERED_RUNS, REMEMBERED_CHUNKS = 400_000, 100_000
# The pieces of one length are numbered in this many parts.
SALTS = 32
_ID_BYTES = 4
_LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-/:;=?@\[-`{-~"
_PLAIN = re.compile(f"[{_LETTERS}{_MARKS}0-9 \\t-\\r]*")
_RUNS = re.compile(f"[{_LETTERS}]+|[0-9]|[{_MARKS}]+")
# How byte-level models show the bytes of UTF-8 letters that are no printable Latin-1 characters.
_HIDDEN_BYTES = [b for b in range(256) if not (33 <= b < 127 or 161 <= b < 173 or b >= 174)]
_BYTE_LETTERS = {byte: 256 + n for n, byte in enumerate(_HIDDEN_BYTES)}
# Texts on which a tokenizer shows whether it splits as described above.
_PROBES = ("Une élève, naïve;  STRASSE straße!! a|b\nÀ ÿ.", "The end... *** (x) über&co $1 don't", "ÃÐÑÞßàíøðþ ïŷ")
_ENCODE_WHOLE = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Remembered(dict):
    """Values made once; when there are `limit`, those not met again until the next time go."""

    def __init__(self, limit: int, make: Callable[[str], bytes]):
        self.limit, self.make, self.older = limit, make, {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class Encoder:
    """Ids of texts as little-endian 32-bit numbers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.runs = Remembered(REMEMBERED_RUNS, self._run)
        self.chunks = Remembered(REMEMBERED_CHUNKS, self.whole)
        self.splits = all(self._block(text) == self.whole(text) for text in _PROBES)

    def whole(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _run(self, run: str) -> bytes:
        if not run.isalpha():
            return self.whole(run)
        # A lower-case word of Latin-1 letters is one token sequence of the byte-level model.
        shown = run if run.isascii() else run.encode().decode("latin-1").translate(_BYTE_LETTERS)
        return _packed([token.id for token in self.tokenizer.model.tokenize(shown)])

    def _block(self, block: str) -> bytes:
        if _PLAIN.fullmatch(block):
            return b"".join(map(self.runs.__getitem__, _RUNS.findall(block.lower())))
        return b"".join(map(self.chunks.__getitem__, block.split()))

    def encode(self, text: str) -> Iterator[bytes]:
        if not self.splits or any(mark in text for mark in _ENCODE_WHOLE):
            yield self.whole(text)
            return
        for block in blocks(text):
            yield self._block(block)

    def pieces(self, text: str, capacity: int) -> Iterator[bytes]:
        """The ids of a document, with the end id, cut at the capacity."""
        size = capacity * _ID_BYTES
        rest = bytearray()
        for ids in self.encode(text):
            rest += ids
            whole = (len(rest) - 1) // size * size if rest else 0
            for start in range(0, whole, size):
                yield bytes(rest[start : start + size])
            del rest[:whole]
        rest += END_ID.to_bytes(_ID_BYTES, "little")
        for start in range(0, len(rest), size):
            yield bytes(rest[start : start + size])


_LOADED: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def token_pieces(
    docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False
) -> DataFrame:
    """`(doc_id, piece, start, length, ids_crc32)` of each piece, and `ids` (binary) on request."""
    path = tokenizer or default_tokenizer()

    def cut(batches):
        import pyarrow as pa

        encoder = _encoder(path)
        for batch in batches:
            owner, piece, start, length, crc, ids = [], [], [], [], [], []
            for row, text in enumerate(batch.column("text")):
                place = 0
                for k, part in enumerate(encoder.pieces(text.as_py() or "", capacity)):
                    owner.append(row)
                    piece.append(k)
                    start.append(place)
                    length.append(len(part) // _ID_BYTES)
                    crc.append(zlib.crc32(part))
                    place += length[-1]
                    if with_ids:
                        ids.append(part)
            columns = [
                batch.column("doc_id").take(pa.array(owner, pa.int32())),
                pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(length, pa.int64()),
                pa.array(crc, pa.int64()),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(ids, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    schema += ", ids binary" if with_ids else ""
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


class Lengths:
    """Available pieces by length, with the index of single, pair and triple sums."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.counts = dict(counts)
        self.have = self.mirrored = 0
        for length, count in counts.items():
            if count:
                self._mark(length)

    def _mark(self, length: int) -> None:
        self.have ^= 1 << length
        self.mirrored ^= 1 << (self.capacity - length)

    def times(self, lengths: tuple[int, ...]) -> int:
        """How often all of `lengths` can be taken together."""
        return min(self.counts.get(x, 0) // lengths.count(x) for x in set(lengths))

    def take(self, lengths: tuple[int, ...], times: int) -> None:
        for length in lengths:
            self.counts[length] -= times
            if not self.counts[length]:
                self._mark(length)

    def pairs(self, total: int) -> int:
        """Bit set of the lengths `a` for which `a` and `total - a` are available."""
        return self.have & (self.mirrored >> (self.capacity - total)) if total > 0 else 0

    def complement(self, length: int) -> tuple[tuple[int, ...], int] | None:
        """A combination of up to three lengths that fills the gap of `length`, and its times."""
        gap = self.capacity - length
        if self.have >> gap & 1 and (n := self.times((length, gap))):
            return (length, gap), n
        for a in _highest_first(self.pairs(gap)):
            if n := self.times((length, a, gap - a)):
                return (length, a, gap - a), n
        for a in _highest_first(self.have & ((1 << max(0, gap - 1)) - 1)):
            for b in _highest_first(self.pairs(gap - a)):
                if n := self.times((length, a, b, gap - a - b)):
                    return (length, a, b, gap - a - b), n
        return None


def _highest_first(bits: int) -> Iterator[int]:
    while bits:
        top = bits.bit_length() - 1
        yield top
        bits ^= 1 << top


def pack_lengths(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Patterns `(lengths, times)` that use every piece; no pattern exceeds the capacity."""
    patterns = [([capacity], counts[capacity])] if counts.get(capacity) else []
    lengths = Lengths({k: v for k, v in counts.items() if k < capacity}, capacity)
    for length in sorted(lengths.counts, reverse=True):
        while lengths.counts[length] and (found := lengths.complement(length)):
            lengths.take(*found)
            patterns.append((list(found[0]), found[1]))
    return patterns + _best_fit(lengths.counts, capacity)


def _best_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Best-fit decreasing, with equal pieces and equal sequences handled together."""
    open_by_gap: dict[int, list[tuple[list[int], int]]] = {}
    gaps: list[int] = []

    def put(lengths: list[int], times: int) -> None:
        gap = capacity - sum(lengths)
        if gap not in open_by_gap:
            open_by_gap[gap] = []
            gaps.insert(bisect_left(gaps, gap), gap)
        open_by_gap[gap].append((lengths, times))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                each = capacity // length
                if left >= each:
                    put([length] * each, left // each)
                    left %= each
                else:
                    put([length] * left, 1)
                    left = 0
                continue
            gap = gaps[at]
            lengths, times = open_by_gap[gap].pop()
            if not open_by_gap[gap]:
                del open_by_gap[gap], gaps[at]
            used = min(times, left)
            if times > used:
                put(lengths, times - used)
            put([*lengths, length], used)
            left -= used
    return [pattern for patterns in open_by_gap.values() for pattern in patterns]


class Places:
    """Sequence and offset of the n-th piece of a length, as sorted arrays."""

    _SHIFT = 45  # pieces of one length are numbered below this power of two

    def __init__(self, patterns: list[tuple[list[int], int]]):
        taken: dict[int, int] = {}
        rows, sequence = [], 0
        for lengths, times in patterns:
            offset = 0
            for length in lengths:
                first = taken.get(length, 0)
                rows.append((length << self._SHIFT | first, sequence - first, offset))
                taken[length] = first + times
                offset += length
            sequence += times
        table = np.array(sorted(rows), np.int64).reshape(-1, 3)
        self.keys, self.shift, self.offsets = table.T.copy()

    def find(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = length.astype(np.int64) << self._SHIFT | number.astype(np.int64)
        at = np.searchsorted(self.keys, key, "right") - 1
        return self.shift[at] + number, self.offsets[at]


def numbered(pieces: DataFrame) -> DataFrame:
    """`pieces` with `number`, gapless from 0 within each length."""
    salt = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS))
    salted = pieces.withColumn("salt", salt)
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    # At most CAPACITY * SALTS rows.
    starts = (
        salted.groupBy("length", "salt")
        .agg(F.count("*").alias("rows"))
        .select("length", "salt", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    )
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("number", F.row_number().over(order) - 1)
    return ranked.join(F.broadcast(starts), ["length", "salt"]).select(
        *pieces.columns, (F.col("number") + F.col("first")).alias("number")
    )


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`pieces` (doc_id, piece, length, ids_crc32 and more) with sequence_id and offset."""
    spark = pieces.sparkSession
    counted = pieces.groupBy("length").agg(F.count("*").alias("rows"))
    counts = {row.length: row.rows for row in counted.collect()}  # at most `capacity` rows
    places = spark.sparkContext.broadcast(Places(pack_lengths(counts, capacity)))

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            length = batch.column("length").to_numpy()
            number = batch.column("number").to_numpy()
            sequence, offset = places.value.find(length, number)
            kept = [name for name in batch.schema.names if name != "number"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(name) for name in kept] + [pa.array(sequence), pa.array(offset)],
                [*kept, "sequence_id", "offset"],
            )

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema]
    schema = ", ".join([*fields, "sequence_id bigint", "offset bigint"])
    return numbered(pieces).mapInArrow(place, schema)


def pack_documents(
    docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False
) -> DataFrame:
    """Token pieces of all documents with their places; tokenised once, in the shared folder."""
    return pack(write_table(token_pieces(docs, tokenizer, capacity, with_ids), "pieces"), capacity)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
