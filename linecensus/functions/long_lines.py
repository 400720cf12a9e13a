"""A line of any length reduced to a short one of the same class.

The class of a line depends on its first bytes, on the first block start, on the first block end
(and the first one after a start token), and on what follows that end. These parts are kept; what
lies between is replaced by one byte that no token has, and long runs of blanks are shortened. So
a line is read in blocks and never held as a whole.
"""

from __future__ import annotations

import re

# Bytes kept after each token, and at the beginning twice as many; blanks kept of a run. Tokens are
# far shorter, so a token after a run of blanks is kept whole.
KEEP = 96
RUN = 32

_BLANKS = b" \t\r"
_LONG_RUN = re.compile(rb"[ \t\r]{%d,}" % (RUN + 1))
_FILLER = b"\x01"


class LongLine:
    """Takes the blocks of one line in turn; `start` and `end` are the block tokens or None."""

    def __init__(self, start: str | None, end: str | None):
        begin, close = (start or "").encode(), (end or "").encode()
        # Tokens still to be found, each from a position on.
        self.wanted = [(begin, 0), (close, 0), (close, len(begin))] if begin and close else []
        self.overlap = max(len(begin), len(close), 1) - 1
        self.read = 0  # bytes of the line so far, without leading and surplus blanks
        self.run = 0
        self.last = b""  # the bytes before, for tokens across blocks
        self.open = [(0, 2 * KEEP)]
        self.kept: list[tuple[int, bytes]] = []

    def feed(self, block: bytes) -> None:
        block = self._shortened(block)
        if not block:
            return
        window, at = self.last + block, self.read - len(self.last)
        for token, lowest in list(self.wanted):
            found = window.find(token, max(0, lowest - at))
            if found >= 0:
                self.wanted.remove((token, lowest))
                self.open.append((at + found, at + found + len(token) + KEEP))
        end = at + len(window)
        for first, stop in self.open:
            part = window[max(0, first - at) : max(0, stop - at)]
            if part:
                self.kept.append((max(first, at), part))
        self.open = [(first, stop) for first, stop in self.open if stop > end]
        self.read = end
        self.last = window[len(window) - self.overlap :] if self.overlap else b""

    def _shortened(self, block: bytes) -> bytes:
        if not self.read:
            return _LONG_RUN.sub(b" " * RUN, self._counted(block.lstrip(_BLANKS)))
        blanks = len(block) - len(block.lstrip(_BLANKS))
        surplus = max(0, self.run + blanks - RUN)
        return _LONG_RUN.sub(b" " * RUN, self._counted(block[min(blanks, surplus) :]))

    def _counted(self, block: bytes) -> bytes:
        """Keeps the length of the run of blanks at the end of what was read."""
        trailing = len(block) - len(block.rstrip(_BLANKS))
        self.run = min(RUN, trailing + (self.run if trailing == len(block) else 0))
        return block

    def finish(self) -> bytes:
        """The short line."""
        line, end = [], 0
        for first, part in sorted(self.kept, key=lambda kept: kept[0]):
            if first > end:
                line.append(_FILLER)
            line.append(part[max(0, end - first) :])
            end = max(end, first + len(part))
        if self.read > end:
            line.append(_FILLER)
        return b"".join(line)
