import os

import pytest
from pyspark.sql import functions as F

from linecensus.operators import detect as D
from linecensus.sources import tree as TR
from linecensus.sources import tree_source as TS


@pytest.fixture
def tree(tmp_path):
    files = {
        "a.rs": "fn main() {}\n", "b.py": "", "notes.txt": "no language", ".hid/x.rs": "x", "src/.y.rs": "y",
        "src/deep/er/z.c": "int x;\n" * 50, "src/gen/g.rs": "g", "src/gen/keep.rs": "k", "build/out.rs": "o",
        "src/a.tmp.py": "t", "__init__.py": "", "other/build/in.rs": "i", "other/z.sql": "select 1;\n",
        ".ignore": "build/\n*.tmp.py\n!/other/build/", "src/.ignore": "gen/*\n!keep.rs\n",
        "repo/.git/HEAD": "", "repo/.gitignore": "*.sql\n", "repo/q.sql": "q", "repo/r.sh": "r", ".gitignore": "*.rs\n",
    }
    for path, text in files.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    with open(os.path.join(os.fsencode(tmp_path), b"\xff.rs"), "wb") as file:
        file.write(b"bytes")
    os.symlink(tmp_path / "src", tmp_path / "link")
    os.symlink(tmp_path / "a.rs", tmp_path / "alias.rs")
    return str(tmp_path)


def listed(frame):
    return {(r.path, None if r.raw_path is None else bytes(r.raw_path), r.size, r.mtime) for r in frame.collect()}


@pytest.mark.parametrize("options", [{}, {"hidden": True}, {"follow_links": True}, {"exclude": "*.c,!x,other/"}])
def test_source_equals_scan(spark, tree, options, monkeypatch):
    known = D.detect_language(TS.read_tree(spark, tree, **options)).filter(D.is_code_file())
    assert listed(known) == listed(TR.scan_tree(spark, tree, **options))


def test_format_with_content(spark, tree):
    TS.register(spark)
    rows = spark.read.format("source_tree").option("ignore", "false").load(tree).collect()
    found = {r.path: bytes(r.content) for r in rows}
    assert found["a.rs"] == b"fn main() {}\n" and found["b.py"] == b"" and found["src/gen/g.rs"] == b"g"
    assert "notes.txt" in found and ".hid/x.rs" not in found
    assert {bytes(r.content) for r in rows if r.raw_path is not None} == {b"bytes"}


def test_files_are_opened_only_for_their_content(spark, tree):
    os.chmod(f"{tree}/a.rs", 0)
    os.unlink(f"{tree}/alias.rs")
    sizes = TS.read_tree(spark, tree, "size bigint, path string", ignore=False)
    assert sizes.columns == ["size", "path"]
    assert sizes.filter("path = 'a.rs'").first().size == 13


def pushed(spark, tree):
    return TS.read_tree(spark, tree, ignore=False, pushdown=True)


def test_filters_are_pushed(spark, tree):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        frame = TS.read_tree(spark, tree, ignore=False)
        wanted = pushed(spark, tree).filter((F.col("path").startswith("src/")) & (F.col("size") > 2) & (F.col("size") % 2 == 0))
        plan = wanted._jdf.queryExecution().executedPlan().toString()
        expected = {r.path for r in frame.collect() if r.path.startswith("src/") and r.size > 2 and r.size % 2 == 0}
        assert {r.path for r in wanted.collect()} == expected == {"src/deep/er/z.c"}
        # Only what the source cannot compare is left to Spark.
        assert "StartsWith" not in plan.split("BatchScan")[0] and "%" in plan.split("BatchScan")[0]
        several = pushed(spark, tree).filter(F.col("path").isin("a.rs", "b.py") | F.col("path").isNull())
        assert {r.path for r in several.collect()} == {"a.rs", "b.py"}
        for condition in ("path = 'a.rs'", "path IN ('a.rs')", "size <= 0 AND path LIKE '%.py'", "mtime < 5", "size >= 350"):
            found = {r.path for r in pushed(spark, tree).filter(condition).collect()}
            assert found == {r.path for r in frame.collect() if _matches(r, condition)}
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def _matches(row, condition):
    return {
        "path = 'a.rs'": row.path == "a.rs", "path IN ('a.rs')": row.path == "a.rs",
        "size <= 0 AND path LIKE '%.py'": row.size <= 0 and row.path.endswith(".py"), "mtime < 5": row.mtime < 5,
        "size >= 350": row.size >= 350,
    }[condition]


def test_single_file_missing_root_and_many_directories(spark, tree, tmp_path, monkeypatch):
    assert [r.path for r in TS.read_tree(spark, f"{tree}/src/gen/g.rs").collect()] == ["g.rs"]
    with pytest.raises(Exception, match="does not exist"):
        TS.read_tree(spark, f"{tree}/none").collect()
    reader = TS.TreeReader({"path": tree, "ignore": "false"}, ["path"])
    whole = sorted(v for part in reader.partitions() for v in reader.read(part))
    for listed_at_most in (1, 2, 5):
        monkeypatch.setattr(TS, "LISTED", listed_at_most)
        monkeypatch.setattr(TS, "PARTITIONS", 3)
        assert sorted(v for part in reader.partitions() for v in reader.read(part)) == whole
