"""Splitting text into the pre-tokens of a byte-level BPE vocabulary.

The split rule is the public one of byte-level BPE models: contractions, an
optional space before a run of letters, of digits or of other characters, then
white space.  It is compiled for ``re`` with explicit character classes,
because ``re`` has no ``\\p{L}`` and is several times faster than the libraries
that do.
"""

from __future__ import annotations

import functools
import operator
import re
import unicodedata

#: The code points of Unicode's White_Space property.
WHITE_SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The one string that the vocabulary treats as a token of its own inside texts.
SPECIAL = "<|endoftext|>"


#: Code points from here on are unassigned, private or tags: neither letters nor digits.
_LAST = 0x40000


@functools.cache
def _ranges() -> dict[str, str]:
    """Character classes of letters (``L``) and digits (``N``)."""
    kinds = "".join(map(operator.itemgetter(0), map(unicodedata.category, map(chr, range(_LAST)))))
    return {k: "".join(f"\\U{m.start():08x}-\\U{m.end() - 1:08x}" for m in re.finditer(f"{k}+", kinds)) for k in "LN"}


@functools.cache
def splitter() -> re.Pattern:
    """The compiled rule; ``findall`` gives the pre-tokens, which join to the text."""
    letter, digit, space = _ranges()["L"], _ranges()["N"], WHITE_SPACE
    return re.compile(f" ?[{letter}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{digit}]+| ?[^{space}{letter}{digit}]+|[{space}]+(?![^{space}])|[{space}]+")


#: White space of ASCII, and the rest of it.
_PLAIN = "\t\n\x0b\x0c\r "
_OTHER = "\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
_PAIRS = sorted({p for c in _PLAIN for p in (f" {c}", f"{c} ")})


def chunks(text: str) -> list[str] | None:
    """``text`` cut at its spaces, if every cut is also one between pre-tokens.

    Then each chunk but the first, with a space before it, can be tokenized
    apart from its neighbours.  None where a space touches other white space,
    where white space is at an end, or where it is not of ASCII.
    """
    if text[0] in _PLAIN or text[-1] in _PLAIN or any(p in text for p in _PAIRS) or (not text.isascii() and any(c in text for c in _OTHER)):
        return None
    return text.split(" ")


class Memo(dict):
    """What ``make`` gives, by string; emptied when it holds ``entries``."""

    def __init__(self, make, entries: int):
        super().__init__()
        self.make, self.entries = make, entries

    def __missing__(self, key: str):
        if len(self) >= self.entries:
            self.clear()
        value = self.make(key)
        if len(key) <= 64:
            self[key] = value
        return value
