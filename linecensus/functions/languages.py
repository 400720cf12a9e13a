"""Language dimension: names, comment tokens, extensions and special file names.

The tables have a fixed size (51, 139 and 7 rows). Look-ups go through constant maps inside
the projection: no join, no broadcast job, and nothing that grows with the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UNKNOWN = "Unknown"

# Fixed values. One row per language:
# key, display name, line comment, block start, block end, file extensions.
# None = the language has no such token; '' (CSS) = every line starts with it.
LANGUAGES = [
    ("rust", "Rust", "//", "/*", "*/", "rs"),
    ("python", "Python", "#", '"""', '"""', "py"),
    ("javascript", "JavaScript", "//", "/*", "*/", "js mjs cjs jsx"),
    ("typescript", "TypeScript", "//", "/*", "*/", "ts mts cts tsx"),
    ("java", "Java", "//", "/*", "*/", "java"),
    ("c", "C Header", "//", "/*", "*/", "c h"),
    ("cpp", "C++", "//", "/*", "*/", "cpp cc cxx hpp hh hxx"),
    ("go", "Go", "//", "/*", "*/", "go"),
    ("ruby", "Ruby", "#", "=begin", "=end", "rb erb"),
    ("php", "PHP", "//", "/*", "*/", "php phtml"),
    ("swift", "Swift", "//", "/*", "*/", "swift"),
    ("kotlin", "Kotlin", "//", "/*", "*/", "kt kts ktx"),
    ("scala", "Scala", "//", "/*", "*/", "scala sc"),
    ("html", "HTML", None, "<!--", "-->", "html htm vue svelte cshtml razor hbs handlebars pug jade"),
    ("css", "CSS", "", "/*", "*/", "css less styl"),
    ("scss", "SCSS", "//", "/*", "*/", "scss sass"),
    ("shell", "Shell", "#", None, None, "sh zsh fish ps1 psm1 psd1"),
    ("bash", "Bash", "#", None, None, "bash"),
    ("sql", "SQL", "--", "/*", "*/", "sql"),
    ("markdown", "Markdown", None, None, None, "md markdown mdx"),
    ("json", "JSON", None, None, None, "json jsonc"),
    ("yaml", "YAML", "#", None, None, "yaml yml"),
    ("xml", "XML", None, "<!--", "-->", "xml"),
    ("toml", "TOML", "#", None, None, "toml"),
    ("vimscript", "Vim Script", None, None, None, "vim"),
    ("lua", "Lua", "--", "--[[", "]]", "lua"),
    ("perl", "Perl", "#", None, None, "pl pm"),
    ("r", "R", "#", None, None, "r"),
    ("matlab", "MATLAB", "%", "%{", "}%", "matlab"),
    ("dart", "Dart", "//", "/*", "*/", "dart"),
    ("elixir", "Elixir", "#", None, None, "ex exs"),
    ("erlang", "Erlang", "%", None, None, "erl hrl"),
    ("haskell", "Haskell", "--", "{-", "-}", "hs lhs"),
    ("clojure", "Clojure", ";", "#|", "|#", "clj cljs cljc"),
    ("lisp", "Lisp", ";", "#|", "|#", "lisp lsp"),
    ("fsharp", "F#", None, None, None, "fs fsx fsi"),
    ("csharp", "C#", "//", "/*", "*/", "cs csx"),
    ("objectivec", "Objective-C", "//", "/*", "*/", "m mm"),
    ("groovy", "Groovy", None, None, None, "groovy gvy gradle"),
    ("dockerfile", "Dockerfile", "#", None, None, "dockerfile"),
    ("makefile", "Makefile", "#", None, None, "mk makefile"),
    ("cmake", "CMake", None, None, None, "cmake"),
    ("zig", "Zig", "//", "/*", "*/", "zig"),
    ("nim", "Nim", None, None, None, "nim"),
    ("crystal", "Crystal", None, None, None, "cr"),
    ("julia", "Julia", "#", "#=", "=#", "jl jls"),
    ("fortran", "Fortran", "!", None, None, "f90 f95 f03"),
    ("cobol", "COBOL", None, None, None, "cob cbl"),
    ("pascal", "Pascal", None, None, None, "pas pp"),
    # 'S' is listed but never found: look-ups are lower-cased.
    ("assembly", "Assembly", ";", None, None, "asm s S"),
    # Recognised and deliberately not counted.
    ("unknown", "Unknown", None, None, None,
     "vb proto graphql gql nix dhall j2 v purs elm sv vhd vhdl thy gd inko nimble sol move cairo "
     "seed7 ada adb ads tf tfvars dockerignore gitattributes gitignore conf"),
]

# Fixed values. Special file names, compared with the lower-cased stem.
# 'cmakeLists.txt' is listed but never found: look-ups are lower-cased.
FILENAMES = [
    ("dockerfile", "dockerfile"),
    ("makefile", "makefile"),
    ("gemfile", "ruby"),
    ("rakefile", "ruby"),
    ("cargo.toml", "toml"),
    ("cmakeLists.txt", "cmake"),
    ("matlab", "matlab"),
]

EXTENSIONS = [(ext, lang[0]) for lang in LANGUAGES for ext in lang[5].split()]


def _frame(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    def literal(value: str | None) -> str:
        return "CAST(NULL AS STRING)" if value is None else f"r'{value}'"  # no value has a quote

    values = ", ".join(f"({', '.join(map(literal, row))})" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(names)})")


def dim_language(spark: SparkSession) -> DataFrame:
    """lang_key, display_name, line_tok, block_start, block_end."""
    names = ["lang_key", "display_name", "line_tok", "block_start", "block_end"]
    return _frame(spark, names, [row[:5] for row in LANGUAGES])


def dim_extension(spark: SparkSession) -> DataFrame:
    """ext, lang_key."""
    return _frame(spark, ["ext", "lang_key"], EXTENSIONS)


def dim_filename(spark: SparkSession) -> DataFrame:
    """name, lang_key."""
    return _frame(spark, ["name", "lang_key"], FILENAMES)


def _lookup(pairs: dict[str, str | None], key: str) -> Column:
    """Constant map indexed by a column; NULL for an absent key."""

    def listed(values):
        return ", ".join("CAST(NULL AS STRING)" if v is None else f"r'{v}'" for v in values)

    entries = f"map_from_arrays(array({listed(pairs)}), array({listed(pairs.values())}))"
    return F.expr(f"{entries}[{key}]")


_DISPLAY = {row[0]: row[1] for row in LANGUAGES}


def language_of_filename(key: str) -> Column:
    """Display name for a special file name given by the SQL expression `key`."""
    return _lookup({name: _DISPLAY[lang] for name, lang in FILENAMES}, key)


def language_of_extension(key: str) -> Column:
    """Display name for a file extension given by the SQL expression `key`."""
    return _lookup({ext: _DISPLAY[lang] for ext, lang in EXTENSIONS}, key)


def syntax_columns(language: str = "language") -> dict[str, Column]:
    """Comment tokens of the display name in column `language`."""
    return {
        token: _lookup({row[1]: row[i] for row in LANGUAGES}, language)
        for i, token in enumerate(("line_tok", "block_start", "block_end"), start=2)
    }
