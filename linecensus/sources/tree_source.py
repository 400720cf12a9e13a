"""File trees as a Spark data source: `spark.read.format("source_tree").load(root)`.

Rows are `(path, raw_path, size, mtime, content)`, as in a manifest (see `sources.tree`) with the bytes of each file.
The schema asked for decides what is read: files are opened only if `content` is in it. Options:
`hidden`, `follow_links` and `ignore` ("true" or "false"; ignore files apply unless "false") and `exclude`,
a comma-separated list of globs.

The planner lists directories, the nearest ones first, until there are enough of them for all tasks; each task
then walks the subtrees it was dealt. With `pushdown` "true", comparisons of path, size and mtime are handed to
the walk, where they drop entries before a file is opened, and directories that a path cannot be in are not entered.
Spark does so only if `spark.sql.python.filterPushdown.enabled` is set, and refuses a reader that offers it
otherwise. It also keeps what it has handed over with the loaded relation, so load the tree anew for each query
with filters of its own; therefore the option is off unless asked for. `scan_tree` spreads lopsided trees better; this
source reads a tree in one job and takes part in larger queries like a table.
"""

from __future__ import annotations

import operator
import os
import re
from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds

from linecensus.functions.globs import parse_rule
from linecensus.operators import detect as D
from linecensus.operators import ignore as I
from linecensus.session import posix_path
from linecensus.sources import tree as T

NAME = "source_tree"
SCHEMA = "path string, raw_path binary, size bigint, mtime bigint, content binary"

# Directories that the planner lists before it deals out their subtrees, and partitions made of them.
LISTED, PARTITIONS = 2_000, 512

_COMPARED = {
    ds.EqualTo: operator.eq,
    ds.GreaterThan: operator.gt,
    ds.GreaterThanOrEqual: operator.ge,
    ds.LessThan: operator.lt,
    ds.LessThanOrEqual: operator.le,
    ds.StringStartsWith: str.startswith,
    ds.StringEndsWith: str.endswith,
    ds.StringContains: str.__contains__,
}
_FILTERED = {"path", "size", "mtime"}


class TreePart(ds.InputPartition):
    """Directories of one task: their rows, the rules above them, and whether to go down from there."""

    def __init__(self, starts: list[tuple[dict, list[dict], bool]]):
        super().__init__(len(starts))
        self.starts = starts


class TreeSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        pushes = self.options.get("pushdown", "false").lower() == "true"
        return (PushingTreeReader if pushes else TreeReader)(dict(self.options), list(schema.names))


class TreeReader(ds.DataSourceReader):
    def __init__(self, options: dict, names: list[str]):
        if "path" not in options:
            raise ValueError("name the root of the tree: .load(root)")
        self.names = names
        self.root = posix_path(options["path"])
        if not os.path.exists(self.root):
            raise FileNotFoundError(f"Path '{self.root}' does not exist")

        def is_true(name: str, default: str) -> bool:
            return options.get(name, default).lower() == "true"

        self.hidden, self.follow_links = is_true("hidden", "false"), is_true("follow_links", "false")
        self.ignore = is_true("ignore", "true")
        globs = D.option_list(options.get("exclude", ""))
        self.excludes = [rule._asdict() | {"base_dir": "", "prefix": ""} for rule in map(parse_rule, globs) if rule]
        self.conditions: list[tuple[str, object, object]] = []
        self.prefixes: list[str] = []

    def partitions(self) -> list[TreePart]:
        if os.path.isfile(self.root):
            return [TreePart([])]
        rules, repo_depth = T._outer_rules(self.root) if self.ignore else ([], None)
        if self.ignore:
            rules += I.rule_rows(T._rule_lines(os.fsencode(T.global_ignore_file())), "", I.RANK_GLOBAL)
        info = os.stat(self.root)
        top = {"path": "", "raw_path": None, "repo_depth": repo_depth, "chain": [f"{info.st_dev}:{info.st_ino}"]}
        queue = deque([(top, [dict(zip(I.RULE_FIELDS.names, rule)) for rule in rules])])
        starts = []
        while queue and len(starts) < LISTED:
            row, above = queue.popleft()
            known = list(above)
            folders = [entry for entry in self._entries(row, known) if entry["kind"] == "dir"]
            queue.extend((folder, known) for folder in folders)
            starts.append((row, above, False))
        starts += [(row, above, True) for row, above in queue]
        return [TreePart(starts[i::PARTITIONS]) for i in range(min(PARTITIONS, len(starts)))]

    def read(self, partition: TreePart) -> Iterator[tuple]:
        if os.path.isfile(self.root):
            path, raw = T._path_and_raw(os.fsencode(os.path.basename(self.root)))
            info = os.stat(self.root)
            row = {"path": path, "raw_path": raw, "size": info.st_size, "mtime": info.st_mtime_ns // 10**9}
            if self._wanted(row):
                yield self._values(row, os.path.dirname(self.root))
            return
        for row, rules, deep in partition.starts:
            stack = [(row, rules)]
            while stack:
                folder, above = stack.pop()
                known = list(above)
                for entry in self._entries(folder, known):
                    if entry["kind"] == "file":
                        if self._wanted(entry):
                            yield self._values(entry, self.root)
                    elif deep:
                        stack.append((entry, known))

    def _entries(self, folder: dict, rules: list[dict]) -> Iterator[dict]:
        """The files and directories of one directory that are kept; its rules are added to `rules`."""
        for entry in T._list_directory(os.fsencode(self.root), folder, self.follow_links):
            if entry["kind"] == "rule":
                if self.ignore:
                    rules.append(entry)
                continue
            is_dir, path = entry["kind"] == "dir", entry["path"]
            if is_dir and not self._may_hold(path):
                continue
            entry = {"chain": None, **entry}
            excluded = _decision([dict(r, seq=i, source_rank=0) for i, r in enumerate(self.excludes)], path, is_dir)
            if excluded is False:
                continue
            taken = _decision([r for r in rules if _counts(r, entry["repo_depth"])], path, is_dir)
            hidden = path.rpartition("/")[2].startswith(".")
            if (self.hidden or not hidden) if taken is None else taken:
                yield entry

    def _may_hold(self, folder: str) -> bool:
        return all(folder.startswith(p) or p.startswith(folder + "/") for p in self.prefixes)

    def _wanted(self, row: dict) -> bool:
        return all(compare(row[name], value) for name, compare, value in self.conditions)

    def _values(self, row: dict, base: str) -> tuple:
        if "content" in self.names:
            raw = row["raw_path"] if row["raw_path"] is not None else row["path"].encode("utf-8")
            try:
                with open(os.path.join(os.fsencode(base), raw), "rb") as file:
                    row = {**row, "content": file.read()}
            except OSError:
                row = {**row, "content": None}
        return tuple(row[name] for name in self.names)


class PushingTreeReader(TreeReader):
    def pushFilters(self, filters: list[ds.Filter]):
        """Takes the comparisons of path, size and mtime; gives back the others."""
        for f in filters:
            column = getattr(f, "attribute", ())
            compare = _COMPARED.get(type(f))
            if isinstance(f, ds.IsNotNull) and column in {("path",), ("size",), ("mtime",)}:
                continue
            if compare is None and isinstance(f, ds.In):
                compare = lambda value, values: value in values
            if compare is None or len(column) != 1 or column[0] not in _FILTERED or f.value is None:
                yield f
                continue
            self.conditions.append((column[0], compare, f.value))
            if column[0] == "path" and isinstance(f, (ds.StringStartsWith, ds.EqualTo)):
                self.prefixes.append(f.value)


def _counts(rule: dict, repo_depth: int | None) -> bool:
    """Whether a rule of a git source counts for an entry of this repository."""
    if rule["source_rank"] == I.RANK_IGNORE:
        return True
    return repo_depth is not None and (rule["source_rank"] == I.RANK_GLOBAL or _level(rule) >= repo_depth)


def _level(rule: dict) -> int:
    base = rule["base_dir"]
    return (base.count("/") + 1 if base else 0) - rule["prefix"].count("/")


def _decision(rules: list[dict], path: str, is_dir: bool) -> bool | None:
    """`negated` of the rule that decides about a path, None when no rule matches."""
    matching = [rule for rule in rules if _matches(rule, path, is_dir)]
    if not matching:
        return None
    return max(matching, key=lambda r: (r["source_rank"], _level(r), r["seq"]))["negated"]


def _matches(rule: dict, path: str, is_dir: bool) -> bool:
    base = rule["base_dir"]
    if (rule["dir_only"] and not is_dir) or (base and not path.startswith(base + "/")):
        return False
    full = rule["prefix"] + (path[len(base) + 1 :] if base else path)
    # Java's end of input is written otherwise here.
    return rule["literal"] in full and re.match(rule["pattern_regex"].replace(r"\z", r"\Z"), full) is not None


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TreeSource)


def read_tree(
    spark: SparkSession, root: str, columns: str = "path string, raw_path binary, size bigint, mtime bigint", **options
) -> DataFrame:
    """The tree as a table of these columns of the source."""
    register(spark)
    named = {name: str(value).lower() if isinstance(value, bool) else str(value) for name, value in options.items()}
    return spark.read.format(NAME).schema(columns).options(**named).load(root)
