"""Cutting of texts where no match of a byte-level BPE split pattern can go across.

Each alternative of the pattern is white space alone, or an optional single space before characters
that are no white space (contractions have none). So no match goes on from a character that is no
white space to one that is, and a text may be cut before any white space that follows another
character. What a cut leaves behind starts with all its white space, as look-ahead needs.
"""

from __future__ import annotations

import re

#: Unicode White_Space. Python's own \s holds four control characters more.
WHITE = " \t\n\x0b\x0c\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CHUNK = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
_RUN = re.compile(f"[{WHITE}] ")


def chunks(text: str) -> list[str]:
    """The text in parts that can be split and encoded alone; they join to the text."""
    if _RUN.search(text):
        return _CHUNK.findall(text)
    # Each space follows a character that is no white space, or starts the text.
    first, *rest = text.split(" ")
    rest = [" " + x for x in rest]
    return [first, *rest] if first else rest


class Memory(dict):
    """What ``make`` gave for a key. Beyond ``most`` keys it starts anew, with what it held as an older
    generation from which keys that come again are taken; so it holds 2 * ``most`` keys at most."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key, self)
        if value is self:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
