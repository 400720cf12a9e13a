"""Translation of one ignore-file line into a rule (a few lines per directory, not per file)."""

from __future__ import annotations

import re
from typing import NamedTuple


# How a rule is found by the last segment of a path: by the whole name, by the text after its last
# dot, by its first characters, or not at all, so that every path meets the rule.
NAME, EXTENSION, PREFIX, ANY = "name", "extension", "prefix", "any"

# Characters of a prefix that are a key; what a prefix has beyond them is compared apart.
PREFIX_KEY = 8


class Rule(NamedTuple):
    pattern_regex: str  # matched against the whole path relative to the rule's directory
    literal: str  # text that every matching path contains; spares most paths the regex
    negated: bool
    dir_only: bool
    folder: str  # the directory, below the rule's own, in which all matching paths lie
    way: str
    key: str
    part: str  # the ending (EXTENSION) or beginning (PREFIX) of all matching names
    direct: bool  # whether the path lies in that directory itself
    tested: bool  # whether the pattern must be tested where folder and key agree


def _bracket(glob: str, start: int) -> tuple[str, int] | None:
    """Regex of the class opening at `start` and the position after it; None when unclosed."""
    i = start + 1
    negate = i < len(glob) and glob[i] in "!^"
    if negate:
        i += 1
    body = i
    if i < len(glob) and glob[i] == "]":  # a leading ] is a member
        i += 1
    while i < len(glob) and glob[i] != "]":
        i += 2 if glob[i] == "\\" else 1
    if i >= len(glob):
        return None
    members = []
    j = body
    while j < i:
        if glob[j] == "\\" and j + 1 < i:
            j += 1
            members.append("\\" + glob[j])
        elif glob[j] == "-" and body < j < i - 1:
            members.append("-")
        else:
            members.append(re.sub(r"[\\\[\]&~^-]", r"\\\g<0>", glob[j]))
        j += 1
    return f"[{'^' if negate else ''}{''.join(members)}]", i + 1


def glob_to_regex(glob: str) -> str | None:
    """Java regex of a '/'-separated glob; None when it is malformed.

    `*` and `?` stay within a path segment, `**` spans segments, `{a,b}` is a choice.
    """
    out = []
    depth = 0
    i = 0
    while i < len(glob):
        char = glob[i]
        at_segment = i == 0 or glob[i - 1] == "/"
        if char == "*" and at_segment and glob[i : i + 3] == "**/":
            out.append("(?:.*/)?")
            i += 3
            continue
        if char == "*" and at_segment and glob[i:] == "**":
            out.append(".*")
            break
        if char == "*":
            while glob[i + 1 : i + 2] == "*":
                i += 1
            out.append("[^/]*")
        elif char == "?":
            out.append("[^/]")
        elif char == "[":
            found = _bracket(glob, i)
            if found is None:
                return None
            out.append(f"(?!/){found[0]}")
            i = found[1]
            continue
        elif char == "{":
            depth += 1
            out.append("(?:")
        elif char == "}" and depth:
            depth -= 1
            out.append(")")
        elif char == "}":
            return None
        elif char == "," and depth:
            out.append("|")
        elif char == "\\":
            i += 1
            if i >= len(glob):
                return None
            out.append(_literal(glob[i]))
        else:
            out.append(_literal(char))
        i += 1
    return None if depth else "".join(out)


def _literal(char: str) -> str:
    return "\\" + char if char in r"\.^$|?*+()[]{}" else char


def required_literal(glob: str) -> str:
    """Longest text without any special character in the glob, '' when it has a choice."""
    if "{" in glob or "\\" in glob:
        return ""
    # Each special piece, with the slash of '**/', ends a run of plain characters.
    runs = re.split(r"\*\*/|\[[!^]?\]?[^\]]*\]|[*?]", glob)
    return max(runs, key=len)


_SPECIAL = re.compile(r"[*?\[\]{}\\]")


class _Place(NamedTuple):
    folder: str
    way: str
    key: str
    part: str
    direct: bool
    tested: bool


def _last_segment(last: str) -> tuple[str, str, str, bool]:
    """`(way, key, rest, decided)` of the last segment of a glob.

    `rest` is the whole ending or beginning that a name must have; `decided` tells whether that is all.
    """
    if not _SPECIAL.search(last):
        return NAME, last, "", True
    if last == "*":
        return ANY, "", "", True
    first, final = _SPECIAL.search(last).start(), max(last.rfind(c) for c in "*?]")
    beginning, ending = last[:first], last[final + 1 :]
    if "." in ending:
        return EXTENSION, ending.rpartition(".")[2], ending, first == 0 and last[:final] == "" and last[0] == "*"
    if beginning:
        return PREFIX, beginning[:PREFIX_KEY], beginning, first == len(last) - 1 and last[-1] == "*"
    return ANY, "", "", False


def _placed(glob: str) -> _Place:
    """Where the paths that match a glob lie and what their names have in common."""
    segments = glob.split("/")
    if any(c in glob for c in "{}\\") or any(not part or part.count("[") != part.count("]") for part in segments):
        return _Place("", ANY, "", "", False, True)
    folders = 0
    while folders < len(segments) - 1 and not _SPECIAL.search(segments[folders]):
        folders += 1
    rest = segments[folders:]
    way, key, part, decided = _last_segment(rest[-1]) if rest[-1] != "**" else (ANY, "", "", False)
    direct, below = len(rest) == 1, len(rest) == 2 and rest[0] == "**"
    tested = not (decided and (direct or below))
    return _Place("/".join(segments[:folders]), way, key, part, direct, tested)


def parse_rule(line: str) -> Rule | None:
    """Rule of one ignore-file line; None for blank lines, comments and malformed globs."""
    line = line.rstrip("\r\n")
    if line.startswith("#"):
        return None
    stripped = line.rstrip(" \t")
    if stripped.endswith("\\") and stripped != line:  # an escaped trailing space counts
        stripped += line[len(stripped)]
    line = stripped
    negated = line.startswith("!")
    if negated:
        line = line[1:]
    elif line.startswith(("\\!", "\\#")):
        line = line[1:]
    dir_only = line.endswith("/")
    if dir_only:
        line = line[:-1]
    anchored = "/" in line
    if line.startswith("/"):
        line = line[1:]
    if not line:
        return None
    if not anchored:
        line = "**/" + line
    elif line.endswith("/**"):  # the contents, not the directory itself
        line += "/*"
    regex = glob_to_regex(line)
    if regex is None:
        return None
    return Rule(rf"(?s)^{regex}\z", required_literal(line), negated, dir_only, *_placed(line))
