"""How a text falls into units that no piece crosses, for vocabularies that mark white space with U+2581."""

from __future__ import annotations

import re

MARK = "▁"
_UNIT = re.compile(f"{MARK}+[^{MARK}]*")


def separable(pieces: list[str]) -> bool:
    """Whether no piece has a marker behind another character, so that units can be taken alone."""
    return not any(MARK in p.lstrip(MARK) for p in pieces)


def units(text: str) -> list[str]:
    """Units of a text, each without its first marker; the text begins with a marker that it lacks.

    A unit is a run of markers and the characters up to the next; single blanks, the usual case, need
    no pattern. An empty text has no unit.
    """
    if not text:
        return []
    found = text.split(" ")
    if "" in found or MARK in text:
        return [u[1:] for u in _UNIT.findall(MARK + text.replace(" ", MARK))]
    return found
