"""Letter words of whole texts, in slices that bound memory whatever the length of a text."""

from __future__ import annotations

import re
from collections.abc import Iterator

#: Runs of letters, in lower case.
_WORD = re.compile(r"[^\W\d_]+")
SLICE = 1 << 20


def slices(text: str, size: int = SLICE) -> Iterator[str]:
    """Consecutive parts of ``text`` that together are the text, cut at white space where there is any near the limit."""
    at = 0
    while len(text) - at > size:
        to = at + size
        space = max(text.rfind(" ", at + size // 2, to), text.rfind("\n", at + size // 2, to))
        to = space + 1 if space > 0 else to
        yield text[at:to]
        at = to
    yield text[at:] if at else text


def words(text: str) -> list[str]:
    found = _WORD.findall(text.lower())
    if not "".join(found).isalpha() and found:  # number signs such as a half or a circled one are no letters
        found = "".join(c if c.isalpha() else " " for c in " ".join(found)).split()
    return found
