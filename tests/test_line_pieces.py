import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from linecensus.operators import detect as D
from linecensus.operators import line_pieces as LP
from linecensus.operators import lines as O
from linecensus.sources import content as CT
from linecensus.sources import tree as TR

PARTS = [b"\n", b"\n", b"\n\n", b"/*", b"*/", b"//", b"x", b" ", b"\t\r", "é€".encode(), "𝄞".encode(), b'"""', b"<!--", b"-->"]
NAMES = ["a.rs", "b.py", "c.html", "d.css", "e.sql", "f.rb", "g.md", "h.lua"]


def texts(seed, count, invalid):
    chance = random.Random(seed)
    parts = PARTS + ([b"\xff", b"\xc3"] if invalid else [])
    made = [b"".join(chance.choices(parts, k=chance.randint(0, 60))) for _ in range(count)]
    made += [b"", b"\n", b"\n\n\n", b"x" * 50, b"x" * 50 + b"\n", b"ab\n" * 20, b"/*" + b"\n" * 40 + b"*/ x", b"\n" + b"y" * 40]
    return [(f"{i}/{NAMES[i % len(NAMES)]}", text) for i, text in enumerate(made)]


def files(spark, rows):
    frame = spark.createDataFrame(rows, "path string, content binary")
    return D.detect_language(frame.withColumn("size", F.octet_length("content").cast("bigint"))).repartition(4)


def rows(frame):
    return Counter(tuple(r) for r in frame.collect())


@pytest.mark.parametrize("piece_bytes", [1, 13])
def test_pieces_give_the_rows_of_whole_texts(spark, piece_bytes):
    known = files(spark, texts(piece_bytes, 150, invalid=True)).cache()
    for operator in (O.split_lines, O.classify_lines, O.block_state):
        assert rows(operator(known, piece_bytes)) == rows(operator(known))
    known.unpersist()


def test_texts_held_as_strings_repeated_paths_and_nulls(spark):
    same = [("same.rs", text.decode()) for _, text in texts(3, 20, invalid=False)] + [("none.rs", None)]
    frame = spark.createDataFrame(same, "path string, content string").withColumn("size", F.lit(1).cast("bigint"))
    known = D.detect_language(frame).cache()
    for operator in (O.split_lines, O.classify_lines, O.block_state):
        assert rows(operator(known, 5)) == rows(operator(known))
    known.unpersist()
    assert rows(O.split_lines(known.limit(0), 5)) == Counter()


def test_pieces_of_a_tree(spark, tmp_path):
    made = texts(8, 80, invalid=False)
    for path, text in made:
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_bytes(text)
    manifest = TR.scan_tree(spark, str(tmp_path))
    whole = rows(O.classify_lines(files(spark, made)))
    for piece_bytes in (11, 10_000):
        read = CT.read_content(manifest, str(tmp_path), piece_bytes=piece_bytes)
        assert rows(O.classify_pieces(LP.cut_files(read))) == whole


def test_text_of_many_megabytes_and_a_line_over_several_pieces(spark):
    """50 MB in one row; each task holds a piece of it."""
    block = "/* a comment\n  goes on\n*/ let x = 1; // one\n\n"
    # Not constant, or the planner would make the text.
    lines = f"repeat(concat('{block}', if(id = 0, '', 'x')), 850000)".replace("\n", "\\n")
    text = spark.range(1).selectExpr(
        "'big.rs' AS path", f"concat({lines}, repeat(if(id = 0, 'y', 'x'), 9000000), '\\n/* open') AS content", "1L AS size"
    )
    found = O.classify_lines(D.detect_language(text), LP.PIECE_BYTES)
    counted = found.groupBy("cls").agg(F.count("*").alias("n"), F.max("line_no").alias("last"), F.max(F.length("raw")).alias("longest"))
    got = {r.cls: (r.n, r.last, r.longest) for r in counted.collect()}
    n = 850_000
    assert got == {
        "comment": (2 * n + 1, 4 * n + 1, 12), "code": (n + 1, 4 * n, 9_000_000), "blank": (n, 4 * n - 1, 0)
    }


def test_pieces_are_cut_by_bytes_and_lines_placed_by_counts(spark):
    known = files(spark, [("a.rs", b"one\ntwo\nthree\n")])
    pieces = LP.cut_texts(known, 6)
    assert [bytes(r.bytes) for r in pieces.orderBy("piece").collect()] == [b"one\ntw", b"o\nthre", b"e\n"]
    runs = {(r.first_line, r.text) for r in LP.line_runs(pieces).collect()}
    assert runs == {(0, "one\n"), (1, "two\n"), (2, "three\n")}
