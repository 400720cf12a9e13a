"""Column expressions that turn file text into one class letter per line.

A file goes through three values, all inside its own row:

1. `split_lines`  its lines,
2. `line_codes`   one letter per line: what the line is on its own, outside and
   inside a block comment, and whether it opens or closes one,
3. `line_classes` one letter per line after the open/closed state has been
   carried down the file: x = code, c = comment, b = blank.

A line either opens a block, closes it, or leaves the state alone, so the state
of a line is set by the nearest opening or closing line above it. That makes the
carry a few linear regular-expression passes over the code string (one byte per
line), and no row has to be moved, sorted or grouped to classify its lines.

Code letters (class outside a block / inside a block):

    b  blank / blank
    x  code / comment           c  comment / comment
    O  comment / comment, opens a block that the line does not close
    A  code / code              B  code / comment       A-D hold the block end,
    C  comment / code           D  comment / comment    so the block is closed after
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITESPACE = " \t\r"

_WS_SQL = r"' \t\r'"

CODE, COMMENT, BLANK = "x", "c", "b"


def as_text(content: Column) -> Column:
    """Binary or string content as text.

    Content that is not valid UTF-8 is read as ISO-8859-1, one character per byte, so that no byte
    is lost or replaced.
    """
    return F.coalesce(
        F.try_validate_utf8(content.cast("string")), F.decode(content.cast("binary"), "ISO-8859-1")
    )


def is_bytewise(content: Column) -> Column:
    """Whether `as_text` gives one character per byte for this content."""
    return ~F.is_valid_utf8(content.cast("string"))


def ltrim_ws(text: Column) -> Column:
    """Strip leading space, tab and CR only (a form feed or NBSP is content)."""
    return F.ltrim(text, F.lit(WHITESPACE))


def find_token(text: Column, token: Column, bytewise: Column | None = None) -> Column:
    """0-based byte position of `token`, NULL when absent; an empty token is at 0.

    `bytewise` tells whether the text has one character per byte (see `is_bytewise`).
    """
    position = F.position(token, text)
    before = F.octet_length(F.left(text, position - 1))
    if bytewise is not None:
        before = F.when(bytewise, position - 1).otherwise(before)
    return F.when(token == "", 0).when(position > 0, before)


def count_newlines(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).cast("bigint")


def split_lines(text: Column) -> Column:
    """Lines of the text as an array: a last line without newline counts, a final newline adds
    none, and an empty text has none."""
    body = F.when(text.endswith("\n"), F.left(text, F.length(text) - 1)).otherwise(text)
    lines = F.split(body, "\n", -1)
    return F.when(text != "", lines).otherwise(F.array().cast("array<string>"))


# A longer text is split and classified in pieces of about this size, cut at line ends, so that the
# lines of one piece are in memory at a time and not those of the whole text.
PIECE_BYTES = 1_000_000


def _codes_by_piece(codes_of_piece: str) -> Column:
    """Code string of `text` from the SQL expression for the codes of one `piece` of it."""
    cut = rf"(?s).{{1,{PIECE_BYTES}}}[^\n]*+\n?+"
    pieces = (
        f"if(octet_length(text) > {PIECE_BYTES}, regexp_extract_all(text, r'{cut}', 0), array(text))"
    )
    return F.expr(f"if(text <> '', array_join(transform({pieces}, piece -> {codes_of_piece}), ''), '')")


# Lines of a non-empty piece: only a newline that ends it is dropped before splitting.
_PIECE_LINES = r"""
    split(if(endswith(piece, '\n'), left(piece, length(piece) - 1), piece), '\n', -1)"""


def blank_codes() -> Column:
    """One letter per line of `text`: b for lines of space, tab and CR only, x for all others."""
    letter = f"line -> if(ltrim({_WS_SQL}, line) = '', '{BLANK}', '{CODE}')"
    return _codes_by_piece(f"array_join(transform({_PIECE_LINES}, {letter}), '')")


# The classification of a line is SQL text over the columns text, bytewise, line_tok, block_start
# and block_end; `line` is one left-trimmed line of the text. NULL tokens never match.


def _comment_tail(rest: str) -> str:
    """After a block end: comment when nothing or a line comment follows."""
    tail = f"ltrim({_WS_SQL}, {rest})"
    return f"({tail} = '' OR coalesce(startswith({tail}, line_tok), false))"


_FIRST_END = "position(block_end, line)"

# The line from byte {0} (1-based) on, which may be inside a multi-byte character.
_BYTES_FROM = """
    if(bytewise, substr(line, {0}), cast(substr(cast(line AS BINARY), {0}) AS STRING))"""

# What follows the end of a block that this line opens and closes. The end is looked for after the
# start token. If it is not there, the whole line is searched again, and an end that overlaps the
# start closes too; the bytes skipped are then those of start, position and end together.
_AFTER_OPENED = f"""
    if(contains(substr(line, length(block_start) + 1), block_end),
       substr(line, length(block_start) + length(block_end)
                    + position(block_end, substr(line, length(block_start) + 1))),
       {_BYTES_FROM.format(f"length(block_start) + length(block_end) + {_FIRST_END}")})"""

_AFTER_END = f"substr(line, {_FIRST_END} + length(block_end))"

# The class of a line with a block end, if it starts outside a block: is it a comment?
_COMMENT_OUTSIDE = f"""
    CASE WHEN startswith(line, block_start) THEN {_comment_tail(_AFTER_OPENED)}
         WHEN contains(line, block_start) THEN false
         ELSE coalesce(startswith(line, line_tok), false) END"""

_LINE_CODE = f"""
    CASE WHEN line = '' THEN 'b'
         WHEN contains(line, block_end) THEN
           if({_COMMENT_OUTSIDE},
              if({_comment_tail(_AFTER_END)}, 'D', 'C'),
              if({_comment_tail(_AFTER_END)}, 'B', 'A'))
         WHEN startswith(line, block_start) THEN 'O'
         WHEN contains(line, block_start) THEN 'x'  -- a token after code does not open a block
         WHEN startswith(line, line_tok) THEN 'c'
         ELSE 'x' END"""

# Trimming a set of characters is slow next to trimming spaces, so only lines that need it get it.
_TRIMMED = rf"""
    transform(transform({_PIECE_LINES}, line -> ltrim(line)),
              line -> if(startswith(line, '\t') OR startswith(line, '\r'), ltrim({_WS_SQL}, line), line))"""


def line_codes() -> Column:
    """Code string of `text`: one letter per line, before the block state is known."""
    return _codes_by_piece(f"array_join(transform({_TRIMMED}, line -> {_LINE_CODE}), '')")


def _mark_blocks(codes: Column) -> Column:
    """Code string in which every block is `O [bc]* (X|Y)`: X / Y = closes as code / comment."""
    # Lines inside a block become comments; \G continues where the last match ended.
    marked = F.regexp_replace(codes, r"((?:\G(?!^)|O)[bc]*+)[xO]", "$1c")
    marked = F.regexp_replace(marked, r"(O[bc]*+)[AC]", "$1X")
    return F.regexp_replace(marked, r"(O[bc]*+)[BD]", "$1Y")


def line_classes(codes: Column) -> Column:
    """Class string (x / c / b per line) of a file whose first line is outside any block."""
    marked = F.when(codes.contains("O"), _mark_blocks(codes)).otherwise(codes)
    return F.translate(marked, "OABCDXY", "cxxccxc")


def line_classes_inside(codes: Column) -> Column:
    """Class string of a piece of a file whose first line is inside a block."""
    return F.substr(line_classes(F.concat(F.lit("O"), codes)), F.lit(2))


def block_states(codes: Column) -> Column:
    """1 / 0 per line: does the line start inside a block comment?"""
    inside = F.regexp_replace(_mark_blocks(codes), r"(\G(?!^)|O)[bc]", "$1I")
    return F.translate(inside, "IXYObcxABCD", "11100000000")


def block_states_inside(codes: Column) -> Column:
    """The same for a piece of a file whose first line is inside a block."""
    return F.substr(block_states(F.concat(F.lit("O"), codes)), F.lit(2))


def last_event(codes: Column) -> Column:
    """Effect of the lines on the block state: true = left open, false = left closed, NULL = none."""
    events = F.translate(codes, "bxc", "")
    return F.when(events != "", events.endswith("O"))


def class_count(classes: Column, letter: str) -> Column:
    """Number of lines of one class in a class string."""
    return (F.length(classes) - F.length(F.replace(classes, F.lit(letter)))).cast("bigint")
