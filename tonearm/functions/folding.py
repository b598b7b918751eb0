"""Case, accent and width folding as one JVM expression."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

_RANGES = [(0x00C0, 0x024F), (0x0370, 0x04FF), (0x1E00, 0x1FFF), (0xFF01, 0xFF5E)]


def _pairs() -> tuple[str, str]:
    """Every letter of the ranges whose decomposition starts with a single base letter, and that letter."""
    src, dst = [], []
    for low, high in _RANGES:
        for code in range(low, high + 1):
            ch = chr(code)
            base = unicodedata.normalize("NFKD", ch)
            if base != ch and base and (len(base) == 1 or all(unicodedata.combining(c) for c in base[1:])):
                src.append(ch)
                dst.append(base[0].lower())
    for a, b in zip("øØđĐłŁħĦŧŦıς", "oodd" "llhhtt" "iσ", strict=True):
        src.append(a)
        dst.append(b)
    return "".join(src), "".join(dst)


_FROM, _TO = _pairs()


def fold(text: Column) -> Column:
    """Lower case without accents, combining marks, invisible characters and width differences; null stays null."""
    return F.translate(F.lower(F.regexp_replace(text, r"[\p{M}\p{Cf}]", "")), _FROM, _TO)


def words(text: Column) -> Column:
    """The folded words of a text in order; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(fold(text), F.lit("")), r"[^\p{L}\p{N}]+"), lambda w: w != "")
