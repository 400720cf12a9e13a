"""Line classes of one file, line by line in plain Python: what the Spark expressions must give."""

from __future__ import annotations

from linecensus.functions.languages import LANGUAGES

TOKENS = {
    row[1]: tuple(None if t is None else t.encode() for t in row[2:5]) for row in LANGUAGES
}
BLANKS = b" \t\r"


def _is_comment_rest(rest: bytes, line_tok: bytes | None) -> bool:
    rest = rest.lstrip(BLANKS)
    return not rest or (line_tok is not None and rest.startswith(line_tok))


def classify(content: bytes, language: str) -> list[str]:
    line_tok, start, end = TOKENS[language]
    lines = content.split(b"\n")
    if lines[-1] == b"":
        lines.pop()
    inside = False
    classes = []
    for raw in lines:
        line = raw.lstrip(BLANKS)
        if not line:
            classes.append("blank")
            continue
        comment = None
        if start is not None:
            if inside:
                at = line.find(end)
                inside = at < 0
                comment = inside or _is_comment_rest(line[at + len(end) :], line_tok)
            elif line.startswith(start):
                at = line.find(end, len(start))
                if at >= 0:
                    comment = _is_comment_rest(line[at + len(end) :], line_tok)
                else:
                    overlap = line.find(end)
                    inside = overlap < 0
                    skipped = len(start) + overlap + len(end)
                    comment = inside or _is_comment_rest(line[skipped:], line_tok)
            elif start in line:
                comment = False
        if comment is None:
            comment = line_tok is not None and line.startswith(line_tok)
        classes.append("comment" if comment else "code")
    return classes
