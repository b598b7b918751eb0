"""Numbers that stand as text: parsing, tolerance and display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DECIMAL = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def number(text: Column) -> Column:
    """A finite number, or null: blanks, words, NaN and infinities are no numbers."""
    value = F.when(text.rlike(_DECIMAL), F.trim(text).try_cast("double"))
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def exact(text: Column) -> Column:
    """The number as an exact decimal, or null."""
    return F.when(number(text).isNotNull(), F.trim(text).try_cast("decimal(28,9)"))


def relative_gap(a: Column, b: Column) -> Column:
    """|a - b| / max(|a|, |b|) of exact decimals; 0 where both are 0."""
    top = F.greatest(F.abs(a), F.abs(b))
    return F.when(top == 0, F.lit(0).cast("decimal(38,12)")).otherwise((F.abs(a - b) / top).cast("decimal(38,12)"))


def beyond(a: Column, b: Column, share: str) -> Column:
    """Whether the gap is strictly greater than ``share``, decided without division."""
    return F.abs(a - b) > F.greatest(F.abs(a), F.abs(b)) * F.lit(share).cast("decimal(4,3)")


def parse_duration(text: Column) -> Column:
    """`s`, `m:ss` or `h:mm:ss` as seconds with three decimals; anything else, and zero or less, is empty."""
    t = F.trim(F.coalesce(text, F.lit("")))
    part = lambda n: F.regexp_extract(t, r"^(?:(?:(\d+):)?(\d+):)?(\d+(?:\.\d+)?)$", n)
    of = lambda n: F.coalesce(F.nullif(part(n), F.lit("")).try_cast("double"), F.lit(0.0))
    seconds = of(1) * 3600 + of(2) * 60 + of(3)
    return F.when((part(3) != "") & (seconds > 0), F.format_string("%.3f", seconds)).otherwise("")


def show_size(kilobytes: Column) -> Column:
    n = number(kilobytes)
    return F.when(n.isNotNull() & (n > 0), F.format_string("%.1f MB", F.bround(n / 1024, 1)))


def show_bitrate(bits: Column) -> Column:
    n = number(bits)
    return F.when(n.isNotNull() & (n > 0), F.concat(F.bround(n / 1000, 0).cast("long").cast("string"), F.lit(" kbps")))


def show_time(seconds: Column) -> Column:
    n = number(seconds)
    whole = F.floor(n).cast("long")
    return F.when(n.isNotNull() & (n > 0), F.format_string("%d:%02d", F.floor(whole / 60).cast("long"), whole % 60))
