"""Benchmark decontamination by template windows.

Text is canonicalised: numbers, units after a number, and names (capitalised words inside a
sentence) become typed placeholders, everything else lower-case words. Windows of `WINDOW`
canonical words of the benchmark are joined by hash with those at every place of the documents,
so a question is found again with other numbers and names. Matching windows of a document and an item
with the same shift form an alignment. It counts as contamination when it holds `MIN_WINDOWS`
windows, half of the item's, or half of its windows that are templates, and its slots are consistent: of the values that the item has in
the matched placeholders, at least `CONSISTENT` always stand for the same value in the document.

A window is a template when it has `PLAIN` ordinary words. Others say too little by their form and are
looked for with the values of their placeholders. An item of fewer than `WINDOW` words is one window of
its full length, found wherever these words follow each other. `coverage` is the larger of both shares.

- A null text counts as empty; a text or item without words has no window and is never reported.
- Repeated rows, and rows with the same `doc_id`, are reported once per identifier and item; a null
  `doc_id` or `item_id` is reported as null.
- Equal benchmark items are all reported. An empty benchmark or table gives an empty result.
- Only `doc_id`, `text` and `item_id` are read; other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linecensus.llm.common import located, named_by_row
from linecensus.session import write_table

WINDOW = 8
MIN_WINDOWS = 6
COVERAGE = 0.5
PLAIN = 4
CONSISTENT = 0.5
# The benchmark's windows are broadcast up to this number (16 bytes each), else joined by a shuffle.
BROADCAST_WINDOWS = 1_000_000

# Units in lower case.
UNITS = (
    "mm cm dm m km in inch inches ft foot feet yd yard yards mile miles mg g kg lb lbs pound pounds oz ounce "
    "ounces ton tons tonne tonnes ml cl dl l liter liters litre litres gallon gallons s sec second seconds min "
    "minute minutes h hr hour hours day days week weeks month months year years cent cents dollar "
    "dollars euro euros percent degree degrees mph kmh kwh watt watts volt volts"
).split()

_APART = r"(?![\p{L}\p{N}])"
_NUMBER = r"(?<![\p{L}\p{N}])[0-9]+(?:[.,][0-9]+)*+" + _APART
_UNIT = r"(?<=[0-9] )(?:" + "|".join(UNITS) + ")" + _APART
_NAME = r"(?<=[\p{Ll}\p{N},;] )\p{Lu}\p{Ll}++" + _APART
_SLOT = f"{_NUMBER}|{_UNIT}|{_NAME}"
# Placeholders are words with a digit, which no ordinary word with all its digits replaced is.
_NUMBER_MARK, _UNIT_MARK, _NAME_MARK = "0", "0u", "0n"
_WORD = r"[\p{L}\p{N}]+"


def _text(text: Column) -> Column:
    # The one letter that becomes two characters in lower case, of which one is none.
    return F.replace(F.coalesce(text, F.lit("")), F.lit("\u0130"), F.lit("I"))


def canonical(text: Column) -> Column:
    """The text with typed placeholders, in lower case."""
    marked = F.regexp_replace(_text(text), _NUMBER, _NUMBER_MARK)
    marked = F.regexp_replace(marked, _UNIT, _UNIT_MARK)
    return F.lower(F.regexp_replace(marked, _NAME, _NAME_MARK))


def words(canonical_text: Column) -> Column:
    return F.regexp_extract_all(canonical_text, F.lit(_WORD), 0)


def _is_slot(word: Column) -> Column:
    return word.isin(_NUMBER_MARK, _UNIT_MARK, _NAME_MARK)


def values(text: Column) -> Column:
    """The words, in lower case, with the values of placeholders; as many as there are canonical words."""
    return F.transform(F.regexp_extract_all(_text(text), F.lit(f"{_SLOT}|{_WORD}"), 0), F.lower)


def _hash(window: list[Column], valued: list[Column]) -> Column:
    """Hash of the words of a window, null behind its end."""
    return F.when(_is_template(window), F.xxhash64(*window)).otherwise(F.xxhash64(F.lit(PLAIN), *valued))


def _is_template(window: list[Column]) -> Column:
    plain = [F.when(word.isNull() | _is_slot(word), 0).otherwise(1) for word in window]
    return sum(plain, F.lit(0)) >= PLAIN


def _parts(window: Column, length: int = WINDOW, start: Column | int = 0) -> list[Column]:
    """So many words of an array, one column each: generated code hashes them without a copy."""
    return [F.get(window, F.lit(i) + start) for i in range(length)]


def windows(table: DataFrame, key: str, lengths: tuple[int, ...] = (WINDOW,)) -> DataFrame:
    """`(key, place, hash)` of every window of these lengths of the texts of `table`."""
    # The words go through an explode of one row, so that they are computed once and not per window.
    split = table.select(key, "text", F.explode(F.array(words(canonical(F.col("text"))))).alias("words"))
    split = split.filter(F.size("words") >= min(lengths))
    # Without a placeholder the words are the values.
    valued = F.when(F.exists("words", _is_slot), values(F.col("text"))).otherwise(F.col("words"))
    split = split.select(key, "words", F.explode(F.array(valued)).alias("values"))
    last = F.size("words") - min(lengths)
    placed = split.select(key, "words", "values", F.explode(F.sequence(F.lit(0), last)).alias("place"))

    def window_hash(length: int) -> Column:
        found = _hash(*[_parts(F.col(name), length, F.col("place")) for name in ("words", "values")])
        return F.when(F.col("place") + length <= F.size("words"), found)

    if len(lengths) == 1:
        return placed.select(key, "place", window_hash(lengths[0]).alias("hash"))
    every = F.array(*[window_hash(length) for length in lengths])
    return placed.select(key, "place", F.explode(every).alias("hash")).filter("hash IS NOT NULL")


def benchmark_index(benchmark: DataFrame) -> DataFrame:
    """`(item_id, at, hash, template, n_windows, n_templates, length)` of every window."""
    # An item put inside a sentence has its first word read as a name, if it is capitalised.
    inner = F.concat(F.lit("x, "), F.coalesce("text", F.lit("")))
    split = benchmark.select(
        "item_id",
        words(canonical(F.col("text"))).alias("words"),
        values(F.col("text")).alias("values"),
        F.slice(words(canonical(inner)), 2, WINDOW).alias("inside"),
        F.slice(values(inner), 2, WINDOW).alias("inside_values"),
    )
    split = write_table(split.filter(F.size("words") > 0), "benchmark-words")
    length = F.least(F.size("words"), F.lit(WINDOW))
    split = split.withColumn("length", length).withColumn("n_windows", F.size("words") - F.col("length") + 1)
    every = F.transform(
        F.sequence(F.lit(1), F.col("n_windows")),
        lambda i: F.struct(
            F.slice("words", i, F.col("length")).alias("window"),
            F.slice("values", i, F.col("length")).alias("valued"),
        ),
    )
    kept = ("item_id", "length", "n_windows", "n_templates")
    templates = F.filter(every, lambda w: _is_template(_parts(w["window"])))
    split = split.withColumn("n_templates", F.size(templates))
    found = split.select(*kept, F.posexplode(every).alias("at", "w")).select(*kept, "at", "w.*")
    begun = split.filter(F.col("inside") != F.slice("words", 1, WINDOW))
    begun = begun.select(
        *kept, F.lit(0).alias("at"), F.col("inside").alias("window"), F.col("inside_values").alias("valued")
    )
    found = found.unionByName(begun)
    return found.select(
        *kept,
        "at",
        _is_template(_parts(F.col("window"))).alias("template"),
        _hash(_parts(F.col("window")), _parts(F.col("valued"))).alias("hash"),
    )


def alignments(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`(doc_id, item_id, shift, windows, coverage, first, last)` (among others) with enough matching windows."""
    index = write_table(benchmark_index(benchmark), "benchmark-windows")
    known = index.select("hash").distinct()
    # The size is checked; a larger benchmark is joined by a shuffle on the hash.
    known = F.broadcast(known) if index.count() <= BROADCAST_WINDOWS else known
    # At most WINDOW lengths.
    lengths = tuple(row.length for row in index.select("length").distinct().orderBy("length").collect())
    hits = windows(docs.select("doc_id", "text"), "doc_id", lengths or (WINDOW,)).join(known, "hash", "left_semi")
    matched = write_table(hits, "benchmark-hits").join(index, "hash")
    aligned = matched.groupBy("doc_id", "item_id", (F.col("place") - F.col("at")).alias("shift")).agg(
        F.count_distinct("at").alias("windows"),
        F.max("n_windows").alias("n_windows"),
        F.count_distinct(F.when(F.col("template"), F.col("at"))).alias("templates"),
        F.max("n_templates").alias("n_templates"),
        F.min("at").alias("first"),
        F.max("at").alias("last"),
    )
    part = F.col("windows") / F.col("n_windows")
    of_templates = F.when(F.col("n_templates") > 0, F.col("templates") / F.col("n_templates")).otherwise(0.0)
    # The first window may be a template only as it stands, or only inside a sentence.
    aligned = aligned.withColumn("coverage", F.least(F.greatest(part, of_templates), F.lit(1.0)))
    enough = (F.col("windows") >= MIN_WINDOWS) | (F.col("coverage") >= COVERAGE)
    return aligned.filter(enough)


def _slots(text: str, prefix: str) -> list[Column]:
    """Values of the placeholders of a text and the number of the word that each one is."""
    marks = words(canonical(F.col(text)))
    places = F.filter(F.transform(marks, lambda w, i: F.when(_is_slot(w), i)), lambda i: i.isNotNull())
    valued = F.regexp_extract_all(_text(F.col(text)), F.lit(_SLOT), 0)
    return [places.alias(f"{prefix}_places"), valued.alias(f"{prefix}_values")]


def consistent_slots(found: DataFrame, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`found` with `slots`, `changed` and `consistent`, counted over the item's values in the alignment."""
    items = benchmark.select("item_id", *_slots("text", "item"))
    # Items without a placeholder need no look at the documents.
    items = items.filter(F.size("item_places") > 0)
    # `found` has no order of its own; the alignment is its own key.
    key = ("doc_id", "item_id", "shift", "first", "last")
    with_slots = found.select(*key).join(items, "item_id")
    value_pairs = F.filter(
        F.transform(
            F.arrays_zip("item_places", "item_values"),
            lambda s: F.struct(
                s["item_values"].alias("item"),
                s["item_places"].alias("place"),
            ),
        ),
        lambda s: s["place"].between(F.col("first"), F.col("last") + WINDOW - 1),
    )
    with_slots = write_table(with_slots.select(*key, F.explode(value_pairs).alias("s")), "benchmark-slots")
    if with_slots.isEmpty():
        none = F.lit(0).cast("bigint")
        return found.withColumns({"slots": none, "changed": none, "consistent": none})
    wanted = with_slots.select("doc_id").distinct()
    texts = docs.select("doc_id", "text").join(wanted.hint("merge"), "doc_id", "left_semi")
    valued = texts.select("doc_id", *_slots("text", "doc"))
    valued = valued.select("doc_id", F.explode(F.arrays_zip("doc_places", "doc_values")).alias("d"))
    valued = valued.select("doc_id", F.col("d.doc_places").alias("doc_place"), F.col("d.doc_values").alias("value"))
    placed = with_slots.withColumn("doc_place", F.col("s.place") + F.col("shift"))
    met = placed.join(valued, ["doc_id", "doc_place"]).groupBy(*key, F.col("s.item").alias("item")).agg(
        F.count_distinct("value").alias("values"),
        F.max((F.col("value") != F.col("s.item")).cast("int")).alias("differs"),
    )
    counted = met.groupBy("doc_id", "item_id", "shift").agg(
        F.count("*").alias("slots"),
        F.sum("differs").alias("changed"),
        F.sum((F.col("values") == 1).cast("int")).alias("consistent"),
    )
    joined = found.join(counted, ["doc_id", "item_id", "shift"], "left")
    return joined.na.fill(0, ["slots", "changed", "consistent"])


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`(doc_id, item_id, windows, coverage, slots, changed)` of each document and item found in it."""
    found = write_table(alignments(docs, benchmark), "benchmark-alignments")
    checked = consistent_slots(found, docs, benchmark)
    checked = checked.filter(F.col("consistent") >= CONSISTENT * F.col("slots"))
    best = F.max(F.struct("windows", "slots", "changed", "coverage"))
    return checked.groupBy("doc_id", "item_id").agg(best.alias("best")).select(
        "doc_id",
        "item_id",
        F.col("best.windows").alias("windows"),
        F.col("best.coverage").alias("coverage"),
        F.col("best.slots").alias("slots"),
        F.col("best.changed").alias("changed"),
    )


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item; rows that share a `doc_id` are judged apart."""
    docs = located(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    found = contaminated(named_by_row(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.withColumn("doc_id", F.col("doc_id.doc_id"))
