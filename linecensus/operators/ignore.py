"""Hidden-file filter, ignore rules and exclude globs as filters and joins on paths.

`rules`: base_dir ('' = root), seq (line number), source_rank (a higher rank wins over a lower
one), the columns of a parsed rule, prefix. The last matching line of the deepest directory
within the highest rank decides about a file or directory; a file is dropped when it, or any
directory above it, is ignored. Rules of directories above the root have base_dir '' and as prefix
the way from there to the root, e.g. 'x/root/'.

A path meets a rule through an equi-join on the folder and on what its name has in common with all
matching ones: the whole name, the text after the last dot, or the first characters. Folders at the
beginning of a pattern belong to the folder of the join ('src/gen/*.o' is found in 'src/gen'). So a
path meets the few rules that can match it, however many there are, and no pattern is tested for names,
endings and beginnings; for other patterns, only where the key agrees.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linecensus.functions import paths as P
from linecensus.functions.globs import ANY, EXTENSION, NAME, PREFIX, PREFIX_KEY, parse_rule
from linecensus.session import write_table

RULE_FIELDS = pa.schema(
    [
        ("base_dir", pa.string()),
        ("seq", pa.int32()),
        ("source_rank", pa.int32()),
        ("pattern_regex", pa.string()),
        ("literal", pa.string()),
        ("negated", pa.bool_()),
        ("dir_only", pa.bool_()),
        ("folder", pa.string()),
        ("way", pa.string()),
        ("key", pa.string()),
        ("part", pa.string()),
        ("direct", pa.bool_()),
        ("tested", pa.bool_()),
        ("prefix", pa.string()),
    ]
)

RULES_DDL = (
    "base_dir string, seq int, source_rank int, pattern_regex string, literal string, negated boolean, "
    "dir_only boolean, folder string, way string, key string, part string, direct boolean, "
    "tested boolean, prefix string"
)

# Order of the sources: per-directory .ignore, .gitignore, repository exclude file, global file.
RANK_GLOBAL, RANK_EXCLUDE, RANK_GITIGNORE, RANK_IGNORE = 1, 2, 3, 4


def parse_rules(
    spark: SparkSession, lines: Iterable[str], base_dir: str = "", source_rank: int = RANK_IGNORE
) -> DataFrame:
    """Rules of ignore-file lines given by the caller."""
    return rules_table(spark, rule_rows(lines, base_dir, source_rank))


def rules_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    table = pa.Table.from_pylist([dict(zip(RULE_FIELDS.names, row)) for row in rows], RULE_FIELDS)
    return spark.createDataFrame(table)


def rule_rows(
    lines: Iterable[str], base_dir: str, source_rank: int, prefix: str = ""
) -> list[tuple]:
    parsed = [(seq, parse_rule(line)) for seq, line in enumerate(lines)]
    return [(base_dir, seq, source_rank, *rule, prefix) for seq, rule in parsed if rule]


def hidden_filter(manifest: DataFrame, hidden: bool = False) -> DataFrame:
    """Drop files with a dot name anywhere below the root unless `hidden`."""
    return manifest if hidden else manifest.filter(~P.is_hidden(F.col("path")))


# Rules from above the root are a handful: their patterns are tested, from the outer folder on.
_BASE = """
    CASE WHEN prefix <> '' OR folder = '' THEN base_dir
         WHEN base_dir = '' THEN folder ELSE concat(base_dir, '/', folder) END AS base"""
_LEVEL = """
    length(base_dir) - length(replace(base_dir, '/')) + if(base_dir = '', 0, 1)
      - length(prefix) + length(replace(prefix, '/')) AS level"""
_KEYED = (
    _BASE, "way", "key", "part", "direct AND prefix = '' AS direct", "tested OR prefix <> '' AS tested",
    _LEVEL, "base_dir", "prefix", "pattern_regex", "literal", "negated", "dir_only", "seq", "source_rank",
)

# Whether a rule `{r}` that was found by folder and key matches an entry. A pattern that comes from a
# column is compiled for every test, so few paths get there.
_FULL = "concat({r}prefix, if({r}base_dir = '', path, substr(path, length({r}base_dir) + 2)))"
_MATCHES = f"""
    (is_dir OR NOT {{r}}dir_only)
    AND if({{r}}way = '{EXTENSION}', endswith(name, {{r}}part), startswith(name, {{r}}part))
    AND (NOT {{r}}direct OR length(path) - length(name) = length({{r}}base) + if({{r}}base = '', 0, 1))
    AND (NOT {{r}}tested OR (contains({_FULL}, {{r}}literal) AND rlike({_FULL}, {{r}}pattern_regex)))"""

# With `repo_depth`, the depth of the repository a path is in (NULL = none), rules of the git sources
# count only inside a repository, and per-directory ones not from above it.
_IN_REPOSITORY = f"""
    ({{r}}source_rank = {RANK_IGNORE} OR (repo_depth IS NOT NULL
      AND ({{r}}source_rank = {RANK_GLOBAL} OR {{r}}level >= repo_depth))) AND"""

_LAST_MATCH = """
    array_max(transform(filter(root_rules, r -> {applies}),
      r -> struct(r.source_rank, r.level, r.seq, r.negated)))"""


def _probes() -> str:
    """The keys by which an entry looks for rules, of the kinds that its folder has."""
    probes = [
        f"if(by_{NAME}, struct('{NAME}' AS way, name AS key), NULL)",
        f"if(by_{ANY}, struct('{ANY}' AS way, '' AS key), NULL)",
        f"if(by_{EXTENSION} AND contains(name, '.'), struct('{EXTENSION}' AS way, substring_index(name, '.', -1) AS key), NULL)",
    ]
    for n in range(1, PREFIX_KEY + 1):
        probes.append(f"if(by_{PREFIX}{n} AND length(name) >= {n}, struct('{PREFIX}' AS way, left(name, {n}) AS key), NULL)")
    return f"explode(array({', '.join(probes)})) AS probe"


def decisions(entries: DataFrame, rules: DataFrame, in_repositories: bool = False) -> DataFrame:
    """`(path, is_dir, negated)` of the entries about which a rule decides.

    `entries` has `path` and `is_dir`, and `repo_depth` if rules of git sources depend on repositories. Both
    tables are read several times and should be written ones.
    The root's rules that every path meets are looked at in the row, without a join key.
    """
    applies = (_IN_REPOSITORY if in_repositories else "") + _MATCHES
    own = ["path", "is_dir", *(["repo_depth"] if in_repositories else [])]
    rules = rules.selectExpr(*_KEYED)
    keyed = rules.filter(f"base <> '' OR way <> '{ANY}'")
    root = rules.filter(f"base = '' AND way = '{ANY}'").select(F.struct("*").alias("rule"))
    root = root.agg(F.collect_list("rule").alias("root_rules"))
    # How a folder's rules are looked up: by which kinds of keys, and prefixes of which lengths.
    ways = {way: f"way = '{way}'" for way in (NAME, EXTENSION, ANY)}
    ways |= {f"{PREFIX}{n}": f"way = '{PREFIX}' AND length(key) = {n}" for n in range(1, PREFIX_KEY + 1)}
    found_by = keyed.groupBy("base").agg(*[F.expr(f"bool_or({way}) AS by_{name}") for name, way in ways.items()])
    named = entries.selectExpr(*own, f"{P.NAME} AS name")
    # One row for each folder with rules that the entry is in; the root's are one row for all, or none.
    within = P.folders_above(named, "path", "base").join(found_by.filter("base <> ''"), "base")
    levels = within.unionByName(named.crossJoin(F.broadcast(found_by.filter("base = ''"))))
    met = levels.selectExpr(*own, "name", "base", _probes()).filter("probe IS NOT NULL")
    met = met.select(*own, "name", "base", "probe.*").join(keyed, ["base", "way", "key"])
    match = "struct(source_rank, level, seq, negated) AS match"
    matched = met.filter(applies.format(r="")).selectExpr("path", "is_dir", match)
    # Through a generator of one row or none, which tests each rule once: a filter would be pushed below.
    last = _LAST_MATCH.format(applies=applies.format(r="r."))
    every = named.crossJoin(F.broadcast(root)).selectExpr(
        "path", "is_dir", f"explode(array_compact(array({last}))) AS match"
    )
    best = matched.unionByName(every).groupBy("path", "is_dir").agg(F.max("match").alias("match"))
    return best.selectExpr("path", "is_dir", "match.negated AS negated")


def ignore_rules(manifest: DataFrame, rules: DataFrame) -> DataFrame:
    """Manifest without the files that the rules drop.

    Every file and every distinct directory is judged once. Directories below an ignored one and
    files in these are dropped by anti-joins on the folder.
    """
    rules = write_table(rules, "rules")
    directories = P.folders_above(manifest.select("path"), "path", "folder")
    directories = directories.select(F.col("folder").alias("path")).distinct()
    entries = manifest.select("path", F.lit(False).alias("is_dir")).unionByName(
        directories.withColumn("is_dir", F.lit(True))
    )
    entries = write_table(entries, "entries")
    judged = decisions(entries, rules).filter("NOT negated")
    ignored = write_table(judged.select("path", "is_dir"), "ignored")
    # A directory is closed if it or one above it is ignored.
    ways = entries.filter("is_dir").selectExpr("path AS folder", "concat(path, '/') AS way")
    ways = P.folders_above(ways, "way", "above")
    closed = ways.join(ignored.filter("is_dir").select(F.col("path").alias("above")), "above", "left_semi")
    closed = closed.select("folder").distinct()
    kept = manifest.join(ignored.filter("NOT is_dir").select("path"), "path", "left_anti")
    return kept.join(closed, P.parent(F.col("path")) == F.col("folder"), "left_anti").select(*manifest.columns)


def excluded(path: Column, globs: Iterable[str], is_dir: bool = False) -> Column:
    """Condition: the file or directory, or a directory above it, matches one of the globs.

    The globs are known when the query is built, so this is a plain filter with constant patterns.
    A glob starting with '!' takes back what the ones before it match.
    """
    condition = F.lit(False)
    for glob in globs:
        rule = parse_rule(glob)
        if rule is None:
            continue
        body = rule.pattern_regex.removeprefix("(?s)^").removesuffix(r"\z")
        # The glob matches the path itself or a leading part of it that is a directory.
        tail = "/.+" if rule.dir_only and not is_dir else "(?:/.+)?"
        matches = path.rlike(f"(?s)^(?:{body}){tail}\\z")
        condition = (condition & ~matches) if rule.negated else (condition | matches)
    return condition


def exclude_globs(manifest: DataFrame, globs: Iterable[str]) -> DataFrame:
    """Manifest without the files that the exclude globs name, relative to the root."""
    return manifest.filter(~excluded(F.col("path"), globs))
