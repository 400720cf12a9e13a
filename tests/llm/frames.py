"""Small tables with the awkward rows that every operator must take."""

from __future__ import annotations

import random

CLASHING = (
    "size shard slot digest file row bucket node component score kind start end base number piece "
    "length offset sequence_id hash place words elements bands set_key class_id held_out part key"
).split()
LONG_TEXT = " ".join(f"word{i % 977} und" for i in range(20_000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today.", "en"),
    (2, None, "en"),
    (3, "", None),
    (4, " \t\n\r\x0b\x0c ", "de"),
    (5, "The quick brown fox jumps over the lazy dog near the river bank today.", "en"),
    (5, "The quick brown fox jumps over the lazy dog near the river bank today.", "en"),
    (None, "The quick  brown fox jumps over the lazy dog near the river bank today.", "en"),
    (None, None, None),
    (6, LONG_TEXT, "de"),
    (7, "12345 67890 !!! ???", "en"),
    (8, "x", "fr"),
]


def docs(spark, rows=None, clashing: bool = True):
    schema = "doc_id bigint, text string, lang string"
    frame = spark.createDataFrame(ROWS if rows is None else rows, schema)
    if not clashing:
        return frame
    return frame.selectExpr("*", *[f"'{name}' AS `{name}`" for name in CLASHING])


def empty(spark):
    return docs(spark, []).limit(0)


def invented(words: int, seed: int, stems: str = "ka lo mi ter un vas pri do sen gal") -> str:
    """Prose of invented words, the same for the same seed."""
    chance = random.Random(seed)
    parts = stems.split()
    return " ".join(
        "".join(chance.choice(parts) for _ in range(chance.randint(1, 3))) for _ in range(words)
    )
