"""Well-known binary and text of points and rectangles as native Column expressions.

Doubles become their eight IEEE bytes through ``hex`` of the bit pattern, which Spark's
functions give by arithmetic alone for the finite values of coordinates; big-endian WKB
needs no byte swap.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c) if isinstance(c, str) else F.lit(c)


def let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def double_bits(value: Column) -> Column:
    """The IEEE 754 bits of a finite double as a long, without Python.

    The exponent is found by log2 and corrected by one where that rounds; the fraction is
    exact, since scaling by powers of two and subtracting the leading 1 are.
    """
    v = value.cast("double")
    size = F.abs(v)
    guess = F.floor(F.log2(size)).cast("int")
    power = lambda e: F.pow(F.lit(2.0), e.cast("double"))
    exponent = guess + F.when(size >= power(guess + 1), 1).when(size < power(guess), -1).otherwise(0)
    fraction = ((size / power(exponent) - 1.0) * F.lit(4503599627370496.0)).cast("long")
    bits = F.shiftleft((exponent + 1023).cast("long"), 52) + fraction
    sign = F.when(v < 0, F.lit(-9223372036854775808)).otherwise(F.lit(0))
    return F.when(size == 0, F.lit(0).cast("long")).otherwise(bits.bitwiseOR(sign))


def _hexes(*values: Column) -> Column:
    """Array of the values' bytes as hexadecimal text."""
    return F.transform(F.array(*(v.cast("double") for v in values)), lambda v: F.lpad(F.hex(double_bits(v)), 16, "0"))


def point_wkb(x: Column, y: Column, srid: int | None = None) -> Column:
    """POINT as big-endian WKB, or EWKB with an SRID."""
    head = "0000000001" if srid is None else f"0020000001{srid:08X}"
    known = x.isNotNull() & y.isNotNull()
    return F.when(known, F.unhex(F.concat(F.lit(head), F.array_join(_hexes(x, y), ""))))


def box_wkb(xmin: Column, ymin: Column, xmax: Column, ymax: Column, srid: int | None = None) -> Column:
    """The rectangle as a closed POLYGON ring, counter-clockwise from the lower right."""
    head = "0000000003" if srid is None else f"0020000003{srid:08X}"
    order = (2, 1, 2, 3, 0, 3, 0, 1, 2, 1)
    return F.unhex(let(_hexes(xmin, ymin, xmax, ymax), lambda h: F.concat(F.lit(head + "0000000100000005"), *(h[i] for i in order))))


def box_wkt(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """The rectangle as WKT, with the ring of ``box_wkb``."""
    s = lambda v: v.cast("string")
    pair = lambda x, y: F.concat(s(x), F.lit(" "), s(y))
    ring = [pair(xmax, ymin), pair(xmax, ymax), pair(xmin, ymax), pair(xmin, ymin), pair(xmax, ymin)]
    return F.concat(F.lit("POLYGON (("), F.concat_ws(", ", *ring), F.lit("))"))
