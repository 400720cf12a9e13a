import pytest
from pyspark.sql import functions as F

from linecensus.functions import languages as L
from linecensus.operators import detect as D

# Path and expected language.
DETECTED = {
    "test.rs": "Rust", "test.py": "Python", "test.js": "JavaScript", "Dockerfile": "Dockerfile",
    "Dockerfile.dev": "Dockerfile", "prod.dockerfile": "Dockerfile", "Makefile.am": "Makefile",
    "makefile.py": "Makefile", "matlab.txt": "MATLAB", "Gemfile.lock": "Ruby",
    "Cargo.toml": "TOML", "Cargo.toml.orig": "TOML", "Cargo.lock": "Unknown",
    "CMakeLists.txt": "Unknown", "build.CMAKE": "CMake", "a.c": "C Header", "a.h": "C Header",
    "a.S": "Assembly", "a.s": "Assembly", "x.m": "Objective-C", "x.mm": "Objective-C",
    "x.less": "CSS", "x.styl": "CSS", "x.vue": "HTML", "x.razor": "HTML", "x.ps1": "Shell",
    "x.fish": "Shell", "x.bash": "Bash", ".rs": "Unknown", ".gitignore": "Unknown",
    "a.tf": "Unknown", "foo.": "Unknown", "a.tar.gz": "Unknown", "dir.rs/README": "Unknown",
    "deep/er/x.PY": "Python", "..rs": "Rust", "a\nb.rs": "Rust",
}


def test_dimension_sizes(spark):
    assert L.dim_language(spark).count() == 51
    assert L.dim_extension(spark).select("ext").distinct().count() == 139
    assert L.dim_filename(spark).count() == 7


def test_detection(spark):
    df = spark.createDataFrame([(p,) for p in DETECTED], "path string")
    found = {r.path: r.language for r in D.detect_language(df).collect()}
    assert found == DETECTED


def test_path_parts(spark):
    df = spark.createDataFrame([("a/b.tar.gz",), (".env",), ("foo.",), ("x",)], "path string")
    parts = {r.name: (r.stem, r.ext) for r in D.path_parts(df).collect()}
    assert parts == {
        "b.tar.gz": ("b.tar", "gz"), ".env": (".env", None), "foo.": ("foo", ""), "x": ("x", None),
    }


@pytest.mark.parametrize(
    "wanted, kept",
    [(["RUST"], {"Rust"}), (["c", "cpp", "csharp"], set()), (["c header", "C++"], {"C Header", "C++"})],
)
def test_language_filter_uses_display_names(spark, wanted, kept):
    df = D.detect_language(spark.createDataFrame([("a.rs",), ("a.c",), ("a.cc",)], "path string"))
    assert {r.language for r in D.language_filter(df, wanted).collect()} == kept


def test_lookups_are_broadcast(spark):
    plan = D.detect_language(spark.range(1).select(F.lit("a.rs").alias("path")))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in text and "Exchange hash" not in text


def test_tables_are_pinned():
    """Literal values, as the statements that check the queries take the tables from the engine."""
    from linecensus.functions import languages as L

    assert (len(L.LANGUAGES), len(L.EXTENSIONS), len(L.FILENAMES)) == (51, 139, 7)
    by_key = {row[0]: row for row in L.LANGUAGES}
    assert by_key["rust"] == ("rust", "Rust", "//", "/*", "*/", "rs")
    assert by_key["julia"] == ("julia", "Julia", "#", "#=", "=#", "jl jls")
    assert by_key["fortran"] == ("fortran", "Fortran", "!", None, None, "f90 f95 f03")
    assert by_key["lua"][2:5] == ("--", "--[[", "]]") and by_key["haskell"][2:5] == ("--", "{-", "-}")
    assert by_key["html"][2:5] == (None, "<!--", "-->") and by_key["python"][2:5] == ("#", '"""', '"""')
    assert dict(L.EXTENSIONS)["mm"] == "objectivec" and dict(L.EXTENSIONS)["tf"] == "unknown"
