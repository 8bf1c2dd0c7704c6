"""Rounding of binary numbers by their exact value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hundredths(c: Column) -> Column:
    """c rounded to two decimals by its exact binary value, true ties to even; numbers of 2^46 or more, which stand wider apart, as they are.

    12.345 is stored a little above and 2.675 a little below that, so they become 12.35 and 2.67; a rounding of the shortest
    text that stands for a number would see ties there. The number is scaled to a whole one by a power of two, which is exact."""
    size = F.abs(c.cast("double"))
    bits = F.least(F.greatest(F.lit(53) - F.floor(F.log2(size)).cast("int"), F.lit(1)), F.lit(62))
    whole = (size * F.pow(F.lit(2.0), bits.cast("double"))).try_cast("bigint") * 100
    down = F.call_function("shiftright", whole, bits)
    rest, half = whole - F.call_function("shiftleft", down, bits), F.call_function("shiftleft", F.lit(1).cast("bigint"), bits - 1)
    up = ((rest > half) | ((rest == half) & (down % 2 == 1))).cast("bigint")
    rounded = F.signum(c) * ((down + up) / 100.0)
    return F.when(size >= 2.0**46, c).when(size < 2.0**-9, F.signum(c) * 0.0).otherwise(rounded)
