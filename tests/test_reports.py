import json
import os

import pytest

from linecensus.operators import stats as S
from linecensus.plans.analyze import analyze_table, analyze_tree
from linecensus.sinks import reports as R

COLUMNS = (
    "path string, language string, lines bigint, code bigint, comments bigint, blanks bigint, "
    "bytes bigint"
)
LONG = "/very/long/folder/name/that/goes/on/and/on/for/ever/main.rs"


@pytest.fixture
def stats(spark):
    rows = [
        ("a.py", "Python", 10, 5, 3, 2, 100), (LONG, "Rust", 20, 15, 3, 2, 400),
        ('q",.rs', "Rust", 1, 1, 0, 0, 2), ("z.sh", "Shell", 6, 5, 1, 0, 30),
    ]
    return spark.createDataFrame(rows, COLUMNS)


def text(report):
    return [r.line for r in R.ordered(report).collect()]


def test_aggregates(stats):
    languages = S.language_stats(stats)
    assert [r.name for r in S.langs_by_code(languages).collect()] == ["Rust", "Python", "Shell"]
    assert [r.name for r in S.langs_by_files(languages).collect()] == ["Rust", "Python", "Shell"]
    total = [tuple(r) for r in S.grand_total(languages).filter("is_total = 1").collect()]
    assert total == [("Total", 1, 4, 37, 26, 7, 4, 532)]
    doubled = {r.name: r.lines for r in S.merge_stats(languages, languages).collect()}
    assert doubled == {"Rust": 42, "Python": 20, "Shell": 12}
    assert [r.path for r in S.files_by_path(stats).collect()] == sorted(["a.py", LONG, 'q",.rs', "z.sh"])


def test_total_of_nothing(stats):
    none = S.language_stats(stats.limit(0))
    assert tuple(S.total(none).first()) == (0, 0, 0, 0, 0, 0)
    assert R.summary(none).first().total_files == 0


def test_table(stats):
    errors = stats.sparkSession.createDataFrame(
        [(f"p{i}", f"p{i}: failed") for i in range(7)], "path string, message string"
    )
    lines = text(R.report_table(S.language_stats(stats), 500, errors, stats))
    assert lines == [
        "",
        "=" * 80,
        " Language                  Files      Lines       Code   Comments     Blanks",
        "-" * 80,
        " Rust                          2         21         16          3          2",
        " Python                        1         10          5          3          2",
        " Shell                         1          6          5          1          0",
        "-" * 80,
        " Total                         4         37         26          7          4",
        "=" * 80,
        "",
        "",
        " Statistics completed in 0.500s (8 files/s, 74 lines/s)",
        "",
        " 7 errors occurred:",
        "   1. p0: failed",
        "   2. p1: failed",
        "   3. p2: failed",
        "   4. p3: failed",
        "   5. p4: failed",
        "   ... and 2 more",
        "",
        "=" * 100,
        f" {'File':<50} {'Language':<15} {'Lines':>10} {'Code':>10}",
        "-" * 100,
        f" {'...' + LONG[-45:]:<50} {'Rust':<15} {20:>10} {15:>10}",
        f" {'a.py':<50} {'Python':<15} {10:>10} {5:>10}",
        f" {chr(113) + chr(34) + ',.rs':<50} {'Rust':<15} {1:>10} {1:>10}",
        f" {'z.sh':<50} {'Shell':<15} {6:>10} {5:>10}",
        "=" * 100,
    ]


def test_json(stats):
    lines = text(R.report_json(S.language_stats(stats), 7, 2))
    document = "\n".join(lines)
    expected = {
        "summary": {
            "elapsed_ms": 7, "error_count": 2, "total_blanks": 4, "total_bytes": 532,
            "total_code": 26, "total_comments": 7, "total_files": 4, "total_lines": 37,
        },
        "languages": [
            {"blanks": 2, "bytes": 402, "code": 16, "comments": 3, "files": 2, "lines": 21, "name": "Rust"},
            {"blanks": 2, "bytes": 100, "code": 5, "comments": 3, "files": 1, "lines": 10, "name": "Python"},
            {"blanks": 0, "bytes": 30, "code": 5, "comments": 1, "files": 1, "lines": 6, "name": "Shell"},
        ],
        "files": None,
    }
    assert document == json.dumps(expected, indent=2)
    with_files = json.loads("\n".join(text(R.report_json(S.language_stats(stats), file_stats=stats))))
    assert [f["path"] for f in with_files["files"]] == sorted(["a.py", LONG, 'q",.rs', "z.sh"])
    assert with_files["files"][1]["bytes"] == 100


def test_csv(stats):
    assert text(R.report_csv(S.language_stats(stats), stats.filter("path = 'a.py'"))) == [
        "Type,Name,Files,Lines,Code,Comments,Blanks,Bytes",
        "Language,Rust,2,21,16,3,2,402",
        "Language,Python,1,10,5,3,2,100",
        "Language,Shell,1,6,5,1,0,30",
        "Total,Total,4,37,26,7,4,532",
        "",
        "File,Language,Lines,Code,Comments,Blanks,Bytes",
        "a.py,Python,10,5,3,2,100",
    ]


def test_summary_rates(stats):
    row = R.summary(S.language_stats(stats), 1, 2000).first()
    assert (row.files_per_sec, row.lines_per_sec, row.error_count) == (2.0, 18.5, 1)
    assert R.summary(S.language_stats(stats)).first().files_per_sec is None


def test_written_report_reads_back_in_order(spark, stats, tmp_path):
    report = R.report_csv(S.language_stats(stats), stats)
    R.write_report(report, str(tmp_path / "out"))
    parts = sorted((tmp_path / "out").glob("part-*"))
    assert "".join(p.read_text() for p in parts).splitlines() == text(report)


def test_unknown_format_is_the_table(stats):
    languages = S.language_stats(stats)
    assert text(R.report("other", languages)) == text(R.report("table", languages))


def test_nothing_found(spark, tmp_path):
    census = analyze_tree(spark, str(tmp_path))
    expected = [f"No code files found in '{tmp_path}'"]
    assert [r.line for r in census.report("json").collect()] == expected


def test_analyze_table(spark):
    rows = [("a.rs", "// x\ny\n", 7), ("b.unknown", "z", 1), ("c.py", "#\n", 2)]
    files = spark.createDataFrame(rows, "path string, content string, size bigint")
    got = {r.name: (r.code, r.comments) for r in analyze_table(files).languages.collect()}
    assert got == {"Rust": (1, 1), "Python": (0, 1)}
    assert analyze_table(files, languages=["python"]).files.count() == 1


def test_json_of_paths_that_look_the_same(spark, tmp_path):
    """Names that are not UTF-8 are shown alike, also those that come last."""
    for name in (b"\xff.rs", b"\xfe.rs", b"\xfd.rs", b"a.rs"):
        with open(os.path.join(os.fsencode(tmp_path), name), "wb") as file:
            file.write(b"fn main() {}\n" * (1 + name[0] % 3))
    census = analyze_tree(spark, str(tmp_path))
    document = json.loads("\n".join(r.line for r in census.report("json", files=True).collect()))
    shown = [f["path"].rpartition("/")[2] for f in document["files"]]
    assert shown == ["a.rs", "\ufffd.rs", "\ufffd.rs", "\ufffd.rs"]
    assert sorted(f["lines"] for f in document["files"]) == sorted([1 + b % 3 for b in (0xFF, 0xFE, 0xFD, 97)])


def test_json_of_repeated_rows(spark):
    rows = [("p", "Rust", 1, 1, 0, 0, 9)] * 3 + [("a", "Rust", 1, 1, 0, 0, 9)]
    frame = spark.createDataFrame(rows, "path string, language string, lines bigint, code bigint, comments bigint, blanks bigint, bytes bigint")
    lines = R.ordered(R.report_json(S.language_stats(frame), file_stats=frame)).collect()
    assert len(json.loads("\n".join(r.line for r in lines))["files"]) == 4


@pytest.mark.parametrize("fmt", ["csv", "json"])
def test_tables_bring_any_path_back(spark, tmp_path, fmt):
    paths = ['a,b"c\nd.rs', "plain.rs", " led and trailed ", '"', "\\", 'x\\"y', "caf\u00e9\t", "two\n\nlines", ""]
    rows = [(path, "Rust", i, i, 0, 0, 10**12) for i, path in enumerate(paths)]
    frame = spark.createDataFrame(rows, COLUMNS).repartition(3)
    R.write_files(S.language_stats(frame), frame, str(tmp_path / fmt), fmt)
    back = R.read_files(spark, str(tmp_path / fmt), "files", COLUMNS, fmt)
    expected = rows if fmt == "json" else [(row[0] or None, *row[1:]) for row in rows]
    assert sorted((tuple(r) for r in back.collect()), key=lambda r: r[2]) == expected
    languages = R.read_files(spark, str(tmp_path / fmt), "languages", "name string, files bigint", fmt)
    assert languages.select("files").first()[0] == len(paths)
