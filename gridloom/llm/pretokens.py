"""Cuts a text where no match of the byte-level pre-tokenizers can cross, so that work is done once per distinct piece.

Such a place is every single space between two characters that are not white space: a match starts at that space.
A text where white space follows a space, or that ends with a space, is not cut.
"""

from __future__ import annotations

import re

_UNCUT = re.compile(r" (?:\s|\Z)")


def can_be_cut(text: str) -> bool:
    """Whether text may be cut before each of its spaces."""
    return _UNCUT.search(text) is None


def pieces(text: str) -> list[str] | None:
    """The pieces of text in order (their concatenation is the text), or None where it can't be cut this way."""
    if not can_be_cut(text):
        return None
    first, *rest = text.split(" ")
    cut = [" " + word for word in rest]
    return [first, *cut] if first else cut
