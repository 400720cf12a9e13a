import os
import random
import tracemalloc

import pytest

from linecensus.functions.languages import LANGUAGES
from linecensus.functions.long_lines import KEEP, RUN, LongLine
from linecensus.plans.analyze import analyze_tree
from linecensus.sources import content as CT
from tests.brute_force import TOKENS, classify

SYNTAXES = sorted({row[2:5]: row[1] for row in LANGUAGES}.values())


def reduced(line, language, blocks):
    start, end = CT._BLOCK_TOKENS[language]
    long, at = LongLine(start, end), 0
    for size in blocks:
        long.feed(line[at : at + size])
        at += size
    long.feed(line[at:])
    return long.finish()


def effects(line, language):
    """Class of the line outside and inside a block, and of the line after it in both cases."""
    outside = classify(line + b"\nx", language)
    if not TOKENS[language][1]:
        return outside
    return outside, classify(TOKENS[language][1] + b"\n" + line + b"\nx", language)


def test_tokens_fit_what_is_kept():
    tokens = [t.encode() for row in LANGUAGES for t in row[2:5] if t]
    assert max(map(len, tokens)) * 4 + RUN < KEEP
    assert not any(set(token) & set(b" \t\r\x01") for token in tokens)


@pytest.mark.parametrize("language", SYNTAXES)
def test_reduced_lines_keep_their_class(language):
    chance = random.Random(language)
    tokens = [t for t in TOKENS[language] if t]
    for _ in range(400):
        parts = []
        for _ in range(chance.randint(0, 7)):
            parts.append(
                chance.choice(
                    [*tokens, *tokens, b"x" * chance.choice([1, 30, 190, 400]), b" " * chance.choice([1, 31, 33, 300]),
                     b"\t", b"\xff", "é".encode(), b"/", b"*"]
                )
            )
        line = b"".join(parts)
        blocks = [chance.choice([1, 2, 3, 7, 64, 1000]) for _ in range(chance.randint(0, 60))]
        short = reduced(line, language, blocks)
        assert effects(short, language) == effects(line, language), (line, short)
        assert len(short) <= 2 * KEEP + 3 * (KEEP + 8) + 8


@pytest.mark.parametrize("piece", [1, 3, 50, 10**6])
def test_pieces_of_reduced_lines(tmp_path, piece):
    chance = random.Random(piece)
    lines = [b"x" * chance.choice([0, 1, 5, 40, 700]) + chance.choice([b"", b" /* y", b"*/"]) for _ in range(60)]
    text = b"\n".join(lines)
    name = os.fsencode(tmp_path / "f")
    with open(name, "wb") as file:
        file.write(text)
    starts = range(0, len(text), piece)
    parts = [
        CT._read_lines(name, at, None if at == starts[-1] else piece, "Rust", 16) for at in starts
    ]
    assert classify(b"".join(parts), "Rust") == classify(text, "Rust")


def test_a_line_of_many_blocks_is_not_held(tmp_path):
    name = os.fsencode(tmp_path / "long")
    with open(name, "wb") as file:
        file.write(b"/* a\n")
        for _ in range(200):
            file.write(b"y" * (1 << 20))
        file.write(b"*/\nx\n")
    tracemalloc.start()
    content = CT._read_lines(name, 0, None, "Rust", CT.LONG_LINE_BYTES)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert classify(content, "Rust") == ["comment", "comment", "code"]
    assert peak < 16 << 20


def test_long_lines_in_files_of_pieces(spark, tmp_path):
    root = tmp_path / "root"
    root.mkdir()
    body = b"// c\n/* " + b"z" * 3_000_000 + b"\n" + b" " * 2_500_000 + b"\nq */\n" + b"w" * 5_000_000 + b"/*\nend"
    (root / "a.rs").write_bytes(body)
    expected = classify(body, "Rust")
    for piece_bytes in (CT.PIECE_BYTES, 1 << 20, 1 << 26):
        row = analyze_tree(spark, str(root), piece_bytes=piece_bytes).files.first()
        counts = [row.lines, row.code, row.comments, row.blanks, row.bytes]
        assert counts == [len(expected), *map(expected.count, ("code", "comment", "blank")), len(body)]


def test_content_in_byte_ranges(spark, tmp_path):
    from linecensus.sources import tree as TR

    data = bytes(range(256)) * 40
    (tmp_path / "a.rs").write_bytes(data)
    read = CT.read_content(TR.scan_tree(spark, str(tmp_path)), str(tmp_path), piece_bytes=1000)
    rows = sorted(read.collect(), key=lambda row: row.offset)
    assert b"".join(row.content for row in rows) == data
    assert [row.offset for row in rows] == list(range(0, len(data), 1000))
