"""Small scalar expressions (C3, C4, C5, C7) shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pairs(n: Column | str) -> Column:
    """Unordered pairs C(n, 2), exact on bigint (0 for n < 2): the even factor is
    halved by a shift, so nothing passes through a double."""
    n = col_of(n).cast("bigint")
    half = F.when(n % 2 == 0, F.shiftright(n, 1) * (n - 1)).otherwise(n * F.shiftright(n - 1, 1))
    return F.when(n < 2, F.lit(0).cast("bigint")).otherwise(half)


def first_of_first(arr: Column | str, field: str) -> Column:
    """C4: ``arr[0].field[0]``, null-safe (the source throws on an empty list)."""
    return F.get(F.get(col_of(arr), 0).getField(field), 0)


def ratio(num: Column, den: Column) -> Column:
    """Double ratio that is NULL (not an error, not NaN) for a zero denominator."""
    return num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))


def square(c: Column | str) -> Column:
    """The square of an integer as an exact decimal."""
    d = col_of(c).cast("decimal(19,0)")
    return d * d


# XML escapes of the five predefined entities, in the order applied.
XML_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"))


def xml_escape(c: Column | str) -> Column:
    """C5 helper: escape text for an XML attribute value."""
    out = col_of(c).cast("string")
    for raw, ent in XML_ESCAPES:
        out = F.replace(out, F.lit(raw), F.lit(ent))
    return out
