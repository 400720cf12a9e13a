import random

import pytest
from pyspark.sql import functions as F

from linecensus.functions import lines as N
from linecensus.functions.languages import LANGUAGES
from linecensus.operators import detect as D
from linecensus.operators import lines as O
from tests.brute_force import TOKENS, classify


def files_of(spark, rows):
    """Files from (path, language, content bytes)."""
    df = spark.createDataFrame(rows, "path string, language string, content binary")
    return df.withColumn("size", F.octet_length("content").cast("bigint"))


def classes_of(spark, language, content):
    rows = O.classify_lines(files_of(spark, [("f", language, content)])).orderBy("line_no").collect()
    assert [r.line_no for r in rows] == list(range(len(rows)))
    return [r.cls for r in rows]


# Language, content, classes of its lines.
QUIRKS = {
    "code before a block start opens nothing": (
        "Rust", "x(); /* open\nstill\n*/", "code code code"),
    "block start in a line comment": ("Rust", "// see /* x */", "code"),
    "equal tokens never stay open": (
        "Python", '"""Summary line\nmore\n"""\n"""abc', "code code comment comment"),
    "overlapping close": ("Rust", "/*/\nx", "comment code"),
    "blank inside a block": ("Rust", "/*\n\n*/", "comment blank comment"),
    "positions are bytes": ("Python", '"""éab\n"""abz', "code comment"),
    "empty line token": ("CSS", "a { color: red; }\n/* x */\nb { } /* y */", "comment comment code"),
    "reopening after a close": ("Rust", "/* a\n*/ /* b\nc\n*/", "comment code code code"),
    "lua": ("Lua", "-- x --[[ y\n--[[ a\nb\n]]", "code comment comment comment"),
    "html": ("HTML", "<!-- a -->x\n<!--\nq\n--> y", "code comment comment code"),
    "form feed is code": ("Rust", "\f", "code"),
    "blank characters": ("Rust", "\n   \n\t\n\r\n", "blank blank blank blank"),
    "line comment after a close": ("Rust", "/* a */ // b\n/*\n*/ // c", "comment comment comment"),
    "no syntax": ("Markdown", "# x\n\n<!-- y", "code blank code"),
    "all kinds of rust": (
        "Rust",
        "// greeting\npub const N: u8 = 3;\n\n/* closed at once */\n/* opened\nstill\nclosed */\n"
        "let y = N; // after code\n",
        "comment code blank comment comment comment comment code"),
    "all kinds of python": (
        "Python",
        '# heading\nimport os\n\nx = os.sep  # after code\n"""\nwords\n"""\n',
        "comment code blank code comment code comment"),
}


@pytest.mark.parametrize("name", QUIRKS)
def test_quirks(spark, name):
    language, content, expected = QUIRKS[name]
    assert classes_of(spark, language, content.encode()) == expected.split()
    assert classify(content.encode(), language) == expected.split()


def test_empty_file_has_no_lines_but_counts(spark):
    files = files_of(spark, [("e", "Rust", b"")])
    assert O.classify_lines(files).count() == 0
    assert O.split_lines(files).count() == 0
    assert O.block_state(files).count() == 0
    expected = ("e", "Rust", 0, 0, 0, 0, 0)
    assert [tuple(r) for r in O.file_stats(files).collect()] == [expected]
    assert [tuple(r) for r in O.fast_stats(files).collect()] == [expected]


def random_files(seed, n_files):
    rng = random.Random(seed)
    rows = []
    languages = [row[1] for row in LANGUAGES]
    for i in range(n_files):
        language = rng.choice(languages)
        tokens = [t for t in TOKENS[language] if t]
        atoms = [*tokens, *tokens, b"x", b" ", b"\t", b"\r", b"\f", b"/", b"*", b"-", b"]", b"'",
                 b"\"", "é".encode(), b"\xff", b"\xe2\x82", b"\xc2\xa0"]
        if i % 2:
            atoms = [a for a in atoms if a.isascii() or a == "é".encode()]
        lines = [
            b"".join(rng.choice(atoms) for _ in range(rng.choice([0, 0, 1, 2, 3, 5])))
            for _ in range(rng.randrange(12))
        ]
        rows.append((f"f{i}", language, b"\n".join(lines) + rng.choice([b"", b"\n"])))
    return rows


@pytest.mark.parametrize("piece_bytes", [N.PIECE_BYTES, 3])
def test_random_files_against_brute_force(spark, monkeypatch, piece_bytes):
    monkeypatch.setattr(N, "PIECE_BYTES", piece_bytes)
    rows = random_files(seed=7, n_files=4000)
    files = files_of(spark, rows)
    got = {}
    for r in O.classify_lines(files).collect():
        got.setdefault(r.path, {})[r.line_no] = r.cls
    stats = {r.path: r for r in O.file_stats(files).collect()}
    fast = {r.path: r for r in O.fast_stats(files).collect()}
    for path, language, content in rows:
        expected = classify(content, language)
        assert [got.get(path, {})[i] for i in range(len(expected))] == expected, (language, content)
        s = stats[path]
        assert (s.lines, s.bytes) == (len(expected), len(content))
        for cls, count in (("code", s.code), ("comment", s.comments), ("blank", s.blanks)):
            assert count == expected.count(cls)
        assert (fast[path].lines, fast[path].blanks) == (s.lines, s.blanks)
        assert fast[path].code == s.lines - s.blanks


def test_block_state_matches_a_window_over_the_lines(spark):
    """The in-row carry equals the last opening or closing line above, taken with a window."""
    from pyspark.sql import Window

    files = files_of(spark, random_files(seed=11, n_files=1500))
    coded = O.with_codes(files, "path").filter("codes <> ''")
    lines = coded.select("path", F.posexplode(F.split("codes", "")).alias("line_no", "code"))
    event = F.when(F.col("code") == "O", True).when(F.col("code").isin(*"ABCD"), False)
    above = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    window = lines.select(
        "path", "line_no", F.coalesce(F.last(event, True).over(above), F.lit(False)).alias("in_block")
    )
    assert window.exceptAll(O.block_state(files)).count() == 0
    assert O.block_state(files).exceptAll(window).count() == 0


def test_many_open_lines_stay_linear(spark):
    content = b"/* a\n" * 200_000
    row = O.file_stats(files_of(spark, [("f", "Rust", content)])).first()
    assert (row.lines, row.comments) == (200_000, 200_000)


def test_raw_lines_keep_their_text(spark):
    files = files_of(spark, [("u", "Rust", "é\nü".encode()), ("l", "Rust", b"\xe9\n\xfc")])
    raw = [(r.path, r.raw) for r in O.split_lines(files).orderBy("path", "line_no").collect()]
    assert raw == [("l", "é"), ("l", "ü"), ("u", "é"), ("u", "ü")]


@pytest.mark.parametrize(
    "text, newlines",
    [("line1\nline2\n\nline4\n", 4), ("no newlines here", 0), ("\n\n\n", 3), ("", 0),
     ("".join("\n" if i % 10 == 0 else "a" for i in range(1000)), 100)],
)
def test_count_newlines(spark, text, newlines):
    assert O.count_newlines(files_of(spark, [("f", "Rust", text.encode())])).first().newlines == newlines


@pytest.mark.parametrize(
    "text, token, at",
    [("hello world", "world", 6), ("hello world", "foo", None), ("", "foo", None), ("hello", "", 0),
     ("éa", "a", 2)],
)
def test_find_token(spark, text, token, at):
    row = spark.range(1).select(N.find_token(F.lit(text), F.lit(token)).alias("at")).first()
    assert row.at == at


def test_find_token_counts_bytes_of_any_text(spark):
    rng = random.Random(4)
    atoms = [b"*/", b"*", b"/", b"\xe9", "é".encode(), "日".encode(), b"\xff", b"a", b" "]
    lines = [b"".join(rng.choice(atoms) for _ in range(rng.randrange(12))) for _ in range(800)]
    rows = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "i int, raw binary")
    raw = F.col("raw")
    at = N.find_token(N.as_text(raw), F.lit("*/"), N.is_bytewise(raw))
    newlines = N.count_newlines(N.as_text(F.concat(raw, F.lit(b"\n"), raw, F.lit(b"\n"))))
    for row in rows.select("i", at.alias("at"), newlines.alias("n")).collect():
        found = lines[row.i].find(b"*/")
        assert row.at == (None if found < 0 else found), lines[row.i]
        assert row.n == 2


def test_generated_rust_file(spark):
    lines = ["// This is a test file"]
    for i in range(1000):
        if i % 5 == 0:
            lines.append(f"// Comment line {i}")
        elif i % 7 == 0:
            lines.append("")
        else:
            lines.append(f'fn function_{i}() {{ println!("test"); }}')
    content = ("\n".join(lines) + "\n").encode()
    row = O.file_stats(files_of(spark, [("f", "Rust", content)])).first()
    assert (row.lines, row.code, row.comments, row.blanks, row.bytes) == (1001, 686, 201, 114, 31480)


def test_counting_does_not_shuffle(spark):
    from linecensus.operators.stats import language_stats

    df = D.detect_language(files_of(spark, [("a.rs", "Rust", b"x")]).drop("language"))
    plan = O.file_stats(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hash" not in plan and "Window" not in plan and "Sort" not in plan
    plan = language_stats(O.file_stats(df))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_sum" in plan
