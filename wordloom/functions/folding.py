"""Case, accent and space folding, one code point at a time.

``translate`` with a generated map stays inside the JVM.  It is narrower than
``lower`` or a collation: one code point becomes one code point.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The code points that count as spaces.
SPACES = (0x20, 0xA0, 0x1680, 0x180E, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A, 0x200B, 0x202F, 0x205F, 0x3000)
#: Scripts written with case or accents end below these; Hangul syllables are composed by rule and stay as they are.
RANGES = ((0x80, 0x2000), (0x2C00, 0x2E00), (0xA640, 0xA800), (0xFB00, 0xFB50), (0xFF21, 0xFF5B))


@cache
def _map(one: Callable[[str], str]) -> tuple[str, str]:
    pairs = [(chr(c), one(chr(c))) for a, b in RANGES for c in range(a, b)]
    pairs = [(x, y) for x, y in pairs if x != y and len(y) == 1]
    return "".join(x for x, _ in pairs), "".join(y for _, y in pairs)


def _lower(c: str) -> str:
    low = c.lower()
    return low if len(low) == 1 else low[0]


def _base(c: str) -> str:
    """The first code point of the full canonical decomposition."""
    return unicodedata.normalize("NFD", c)[0]


def fold_case(text: Column) -> Column:
    """Each code point in lower case, whatever stands beside it."""
    source, target = _map(_lower)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper + source, upper.lower() + target)


def fold_accents(text: Column) -> Column:
    """Each code point's base letter; ligatures such as æ stay."""
    return F.translate(text, *_map(_base))


def fold_spaces(text: Column) -> Column:
    wide = "".join(map(chr, SPACES[1:]))
    return F.translate(text, wide, " " * len(wide))


def fold_custom(text: Column, changes: dict[str, str]) -> Column:
    """Further replacements of one code point each by a string."""
    for one, other in changes.items():
        text = F.replace(text, F.lit(one), F.lit(other))
    return text


def fold(text: Column, case: bool = True, accents: bool = True, spaces: bool = False, changes: dict[str, str] | None = None) -> Column:
    """Case, then accents, then spaces, then custom changes."""
    if case:
        text = fold_case(text)
    if accents:
        text = fold_accents(text)
    if spaces:
        text = fold_spaces(text)
    return fold_custom(text, changes) if changes else text


def fold_text(text: str) -> str:
    """The case and accent fold of a query's literal."""
    lowered = "".join(map(_lower, text))
    return "".join(_base(c) if any(a <= ord(c) < b for a, b in RANGES) else c for c in lowered)


def same_folded(a: Column, b: Column) -> Column:
    return fold(a) == fold(b)


def compare_folded(a: Column, b: Column, changes: dict[str, str] | None = None) -> Column:
    """-1, 0 or 1: the order of two texts by their folds, in which one code
    point may have become several (``changes``).  The fold itself is the key
    to sort, join or look up by in this order."""
    return compared(fold(a, changes=changes), fold(b, changes=changes))


def compared(a: Column, b: Column) -> Column:
    return F.when(a < b, -1).when(a > b, 1).when(a == b, 0)


def sloppy_capitals(word: Column, wanted: str) -> Column:
    """Whether a word equals ``wanted`` where an unaccented capital on either
    side may stand for the same letter with an accent."""
    source, target = _map(_base)
    accented: dict[str, str] = {}
    for x, y in zip(source, target, strict=True):
        accented[y] = accented.get(y, "") + x
    pattern = ""
    for c in wanted:
        others = accented.get(c, "") if c.isupper() else ""
        bare = _base(c)
        pattern += "[" + c + others + (bare.upper() if bare != c else "") + "]" if others or bare != c else "\\Q" + c + "\\E"
    return word.rlike(f"^(?:{pattern})$")
