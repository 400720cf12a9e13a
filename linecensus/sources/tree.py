"""File trees as a manifest `(path, raw_path, size, mtime, language)`; no file is opened.

The tree is listed level by level: the directories of one level are spread evenly over the tasks,
each lists its directories, and the sub-directories that survive the filters are the next level.
So neither the driver nor one task ever walks a whole subtree, however lopsided the tree is, and
ignored directories are not entered. Each level is written to the shared folder before the next.

`path` is relative to the root and tells all files apart. `raw_path` is NULL unless the name is not
valid UTF-8; then it holds the bytes to open the file with, and `path` has the undecodable ones in
hexadecimal between zero bytes (see `paths.readable` for people).
"""

from __future__ import annotations

import os
import re
import stat
from collections import deque
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linecensus.functions import paths as P
from linecensus.operators import detect as D
from linecensus.operators import ignore as I
from linecensus.session import posix_path, write_table

MANIFEST_SCHEMA = "path string, raw_path binary, size bigint, mtime bigint, language string"

_FRONTIER_SCHEMA = "path string, raw_path binary, repo_depth int, chain array<string>"

# kind is file, dir or rule; a rule row has the columns of a rule, the others those of an entry.
_LISTING_SCHEMA = pa.schema(
    [
        ("kind", pa.string()),
        ("path", pa.string()),
        ("raw_path", pa.binary()),
        ("size", pa.int64()),
        ("mtime", pa.int64()),
        ("repo_depth", pa.int32()),
        ("chain", pa.list_(pa.string())),
        *I.RULE_FIELDS,
    ]
)
_LISTING_DDL = (
    "kind string, path string, raw_path binary, size bigint, mtime bigint, repo_depth int, "
    f"chain array<string>, {I.RULES_DDL}"
)

_ENTRY_COLUMNS = ("kind", "path", "raw_path", "size", "mtime", "repo_depth", "chain", "language")

_DIRS_PER_TASK = 256
_ROWS_PER_BATCH = 10_000

_RULE_FILES = (
    (b".ignore", I.RANK_IGNORE),
    (b".gitignore", I.RANK_GITIGNORE),
    (b".git/info/exclude", I.RANK_EXCLUDE),
)


_CONTROL_NAMES = {b".git", b".ignore", b".gitignore"}


def _control_names(folder: bytes) -> set[bytes]:
    return {name for name in _CONTROL_NAMES if os.path.lexists(os.path.join(folder, name))}


def _rule_lines(path: bytes) -> list[str]:
    try:
        with open(path, "rb") as file:
            return file.read().decode("utf-8", "replace").removeprefix("\ufeff").split("\n")
    except OSError:
        return []


def _path_and_raw(raw: bytes) -> tuple[str, bytes | None]:
    parts, rest = [], raw
    while True:
        try:
            parts.append(rest.decode("utf-8"))
            return "".join(parts), raw if len(parts) > 1 else None
        except UnicodeDecodeError as error:
            parts.append(rest[: error.start].decode("utf-8"))
            parts.append(f"\0{rest[error.start : error.end].hex()}\0")
            rest = rest[error.end :]


def _rules_of(folder: bytes, path: str, names: set[bytes], prefix: str = "") -> Iterator[dict]:
    """Rule rows of the ignore files in one directory."""
    for name, rank in _RULE_FILES:
        if name.split(b"/")[0] in names:
            lines = _rule_lines(os.path.join(folder, name))
            for row in I.rule_rows(lines, path, rank, prefix):
                yield {"kind": "rule", "path": path, **dict(zip(I.RULE_FIELDS.names, row))}


def _list_directory(root: bytes, row: dict, follow_links: bool) -> Iterator[dict]:
    """Rows for the entries and rules of one directory; unreadable ones are left out silently."""
    path = row["path"]
    raw = row["raw_path"] if row["raw_path"] is not None else path.encode("utf-8")
    folder = os.path.join(root, raw) if raw else root
    entries = deque()
    try:
        with os.scandir(folder) as found:
            for entry in found:
                entries.append(entry)
                if len(entries) == _ROWS_PER_BATCH:
                    break  # the rest of a very large directory is not held in memory
            if len(entries) < _ROWS_PER_BATCH:
                names = _CONTROL_NAMES & {entry.name for entry in entries}
            else:
                names = _control_names(folder)
            yield from _rules_of(folder, path, names)
            depth = path.count("/") + 1 if path else 0
            shared = {"repo_depth": depth if b".git" in names else row["repo_depth"]}
            # An entry holds what its file system says of it, so it goes when its row is made.
            for entry in chain((entries.popleft() for _ in range(len(entries))), found):
                listed = _entry_row(entry, raw, row["chain"], follow_links)
                if listed:
                    yield {**listed, **shared}
    except OSError:
        return


def _entry_row(entry, parent: bytes, chain: list[str] | None, follow_links: bool) -> dict | None:
    try:
        info = entry.stat()  # of the target: a link to a file counts as that file
    except OSError:
        return None
    path, raw_path = _path_and_raw(parent + b"/" + entry.name if parent else entry.name)
    row = {"path": path, "raw_path": raw_path}
    if stat.S_ISREG(info.st_mode):
        return {"kind": "file", **row, "size": info.st_size, "mtime": info.st_mtime_ns // 10**9}
    if not stat.S_ISDIR(info.st_mode):
        return None
    if not follow_links:
        return None if entry.is_symlink() else {"kind": "dir", **row}
    identity = f"{info.st_dev}:{info.st_ino}"
    if entry.is_symlink() and identity in (chain or []):
        return None  # a link back to a directory above
    return {"kind": "dir", **row, "chain": [*(chain or []), identity]}


def _lister(root: bytes, follow_links: bool):
    def list_directories(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for directory in batch.to_pylist():
                for row in _list_directory(root, directory, follow_links):
                    rows.append(row)
                    if len(rows) == _ROWS_PER_BATCH:
                        listed = pa.RecordBatch.from_pylist(rows, _LISTING_SCHEMA)
                        rows = []
                        yield listed
                        del listed
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _LISTING_SCHEMA)

    return list_directories


def global_ignore_file() -> str | None:
    """The user's global ignore file, as the git configuration names it."""
    config_home = os.environ.get("XDG_CONFIG_HOME") or os.path.expanduser("~/.config")
    for config in (os.path.expanduser("~/.gitconfig"), os.path.join(config_home, "git/config")):
        for line in _rule_lines(os.fsencode(config)):
            named = re.match(r'\s*excludesfile\s*=\s*"?([^"]+?)"?\s*$', line, re.IGNORECASE)
            if named:
                return os.path.expanduser(named[1])
    return os.path.join(config_home, "git/ignore")


def _outer_rules(root: str) -> tuple[list[tuple], int | None]:
    """Rules of the directories above the root (a handful), and the depth of its repository."""
    rows = []
    repo_depth = None
    prefix, folder, steps = "", os.path.realpath(root), 0
    while folder != os.path.dirname(folder):
        prefix = f"{os.path.basename(folder)}/{prefix}"
        folder, steps = os.path.dirname(folder), steps + 1
        raw = os.fsencode(folder)
        names = _control_names(raw)
        for rule in _rules_of(raw, "", names, prefix):
            rows.append(tuple(rule[name] for name in I.RULE_FIELDS.names))
        if b".git" in names and repo_depth is None:
            repo_depth = -steps
    return rows, repo_depth


def _judged(entries: DataFrame, rules: DataFrame) -> DataFrame:
    """The entries of one level with `negated` of the rule that decides about them, or NULL."""
    placed = entries.select("path", (F.col("kind") == "dir").alias("is_dir"), "repo_depth")
    judged = I.decisions(placed, rules, in_repositories=True)
    return entries.join(judged.select("path", "negated"), "path", "left")


def scan_single(spark: SparkSession, path: str) -> DataFrame:
    """Manifest of one file, relative to its folder: no filter but a known language applies."""
    info = os.stat(path)
    readable, raw = _path_and_raw(os.fsencode(os.path.basename(path)))
    row = (readable, raw, info.st_size, info.st_mtime_ns // 10**9)
    manifest = spark.createDataFrame([row], "path string, raw_path binary, size bigint, mtime bigint")
    return D.detect_language(manifest).filter(D.is_code_file())


def scan_tree(
    spark: SparkSession,
    root: str,
    hidden: bool = False,
    follow_links: bool = False,
    exclude: str | Iterable[str] = (),
    languages: str | Iterable[str] = (),
    global_ignore: str | None = None,
) -> DataFrame:
    """Manifest of the files under `root` whose language is known.

    Ignore files (.ignore everywhere; .gitignore, the exclude file and the global file inside
    repositories) apply, also those in directories above the root.
    """
    root = posix_path(root)
    if not os.path.exists(root):
        raise FileNotFoundError(f"Path '{root}' does not exist")
    if os.path.isfile(root):
        return scan_single(spark, root)
    exclude = D.option_list(exclude)
    outer, repo_depth = _outer_rules(root)
    global_file = global_ignore or global_ignore_file()
    outer += I.rule_rows(_rule_lines(os.fsencode(global_file)), "", I.RANK_GLOBAL)
    rules = I.rules_table(spark, outer) if outer else None

    info = os.stat(root)
    start = [("", None, repo_depth, [f"{info.st_dev}:{info.st_ino}"])]
    frontier, n_dirs = spark.createDataFrame(start, _FRONTIER_SCHEMA), 1
    parallelism = spark.sparkContext.defaultParallelism
    lister = _lister(os.fsencode(root), follow_links)
    is_hidden = P.file_name(F.col("path")).startswith(".")
    found = None
    while n_dirs:
        tasks = min(n_dirs, max(parallelism, -(-n_dirs // _DIRS_PER_TASK)))
        listed = D.detect_language(frontier.repartition(tasks).mapInArrow(lister, _LISTING_DDL))
        kept = (F.col("kind") != "file") | D.is_code_file()
        listed = write_table(D.language_filter_entries(listed.filter(kept), languages), "listing")

        new_rules = listed.filter("kind = 'rule'").select(*I.RULE_FIELDS.names)
        if not new_rules.isEmpty():
            # Kept apart, so that no later level scans this one's listing for them.
            new_rules = write_table(new_rules, "rules")
            rules = new_rules if rules is None else rules.unionByName(new_rules)
        entries = listed.filter("kind <> 'rule'").select(*_ENTRY_COLUMNS)
        if exclude:
            is_dir = F.col("kind") == "dir"
            entries = entries.filter(
                ~F.when(is_dir, I.excluded(F.col("path"), exclude, is_dir=True)).otherwise(
                    I.excluded(F.col("path"), exclude)
                )
            )
        if rules is not None:
            # A rule that takes an entry back also lifts the hidden-name filter for it.
            keep = F.coalesce("negated", F.lit(hidden) | ~is_hidden)
            entries = write_table(_judged(entries, rules).filter(keep).drop("negated"), "entries")
        elif not hidden:
            entries = entries.filter(~is_hidden)

        files = entries.filter("kind = 'file'").select("path", "raw_path", "size", "mtime", "language")
        found = files if found is None else found.unionByName(files)
        frontier = entries.filter("kind = 'dir'").select("path", "raw_path", "repo_depth", "chain")
        n_dirs = frontier.count()
    return found
