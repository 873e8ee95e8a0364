"""Cutting texts into units whose tokens do not depend on their surroundings, and caching what is known about a unit.

The pre-token pattern of byte-level BPE lets a pre-token span a space only as its first character. A single space between two
other characters is therefore always a boundary, and the piece from one such space up to the next (a unit) has the same tokens
in every text. Running text repeats its units, so each worker works out a unit once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from itertools import chain

_DOUBLE = re.compile(r"\s\s")
_SINGLE = re.compile(r"(?<=\S) (?=\S)")


def pieces(text: str) -> list[str]:
    """A text cut at single spaces; joined by spaces the pieces give the text again."""
    return _SINGLE.split(text) if _DOUBLE.search(text) else text.split(" ")


def is_plain(unit: str) -> bool:
    """No white space but perhaps a space in front: set apart by line breaks, such units keep their tokens."""
    return unit.split() == [unit[1:] if unit[:1] == " " else unit]


class UnitCache:
    """What is known about units, worked out in batches.

    A unit is the first piece of a text as it is, or another piece behind its space. ``limit`` units are held at most; beyond
    that the cache starts anew, which costs time but bounds the memory.
    """

    def __init__(self, work_out: Callable[[list[str]], Iterable], limit: int = 1_000_000):
        self.work_out, self.limit = work_out, limit
        self.first: dict = {}
        self.later: dict = {}

    def _resolve(self, known: dict, wanted: Iterable[str], lead: str) -> None:
        missing = list(set(wanted).difference(known))
        if missing:
            known.update(zip(missing, self.work_out([lead + m for m in missing]), strict=True))

    def look_up(self, texts: list[list[str]]) -> list[list]:
        """What is known of the units of each text (given as pieces), in order."""
        if len(self.first) + len(self.later) > self.limit:
            self.first.clear()
            self.later.clear()
        self._resolve(self.first, (t[0] for t in texts), "")
        self._resolve(self.later, chain.from_iterable(t[1:] for t in texts), " ")
        first, later = self.first, self.later.__getitem__
        return [[first[t[0]], *map(later, t[1:])] for t in texts]


def segments(text: str, special: str | None) -> list[str]:
    """The text around its special strings; each gap between two segments is one special token."""
    return text.split(special) if special and special in text else [text]
