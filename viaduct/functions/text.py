"""Text expressions: dialect numbers, prefixes, slices, code lookups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = " \t\n\x0b\f\r"
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def strip(c: Column) -> Column:
    return F.btrim(c.cast("string"), F.lit(BLANK))


def number(c: Column) -> Column:
    """A decimal number with a point; null for all else, NaN included."""
    s = strip(c)
    return F.when(s.rlike(_NUMBER), s.try_cast("double"))


def spanish_float(c: Column) -> Column:
    """Dots and a comma: dots group, the comma is the decimal sign. A comma alone is decimal; a dot alone stays decimal."""
    s = strip(c)
    plain = F.replace(s, F.lit(","), F.lit("."))
    return number(F.when(s.contains(".") & s.contains(","), F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(plain))


def grouped_float(c: Column) -> Column:
    """Dots always group, the comma is the decimal sign."""
    return number(F.replace(F.replace(strip(c), F.lit("."), F.lit("")), F.lit(","), F.lit(".")))


def road_prefix(c: Column) -> Column:
    """AP, A, N or else the leading capitals; the first alternative that fits wins. Null if there is none."""
    return F.nullif(F.regexp_extract(c, "^(AP|A|N|[A-Z]+)", 1), F.lit(""))


def is_interurban(c: Column) -> Column:
    return F.coalesce(c.rlike("^(AP-|A-|N-)"), F.lit(False))


def from_right(c: Column, start: int, length: int) -> Column:
    """length characters that begin `start` from the end; null where the text is shorter."""
    return F.when(F.char_length(c) >= start, F.substring(c, F.char_length(c) - (start - 1), F.lit(length)))


def zero_padded(c: Column, width: int) -> Column:
    """Longer text stays as it is."""
    return F.when(F.char_length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def literal_map(table: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))


def province_name(c: Column, table: dict) -> Column:
    """Name of a numeric code, however it is written (2, 02, 2.0); other text as it is."""
    return F.coalesce(F.try_element_at(literal_map(table), number(c).try_cast("int")), c.cast("string"))


def labelled(lines: Column, order: str, label: str) -> Column:
    """Text after the label in the last line that has this order and label."""
    fit = F.filter(lines, lambda x: (x["order"] == order) & x["value"].contains(label))
    return strip(F.replace(F.try_element_at(fit, F.lit(-1))["value"], F.lit(label), F.lit("")))


def fixed_fields(c: Column, layout: list[tuple[str, int]]) -> list[Column]:
    """Columns of a fixed-width line, stripped."""
    out, at = [], 1
    for name, width in layout:
        out.append(strip(F.substring(c, at, width)).alias(name))
        at += width
    return out


def layout_of(text: str, fields: int) -> list[tuple[str, int]]:
    """(name, width) of each field in the text of a layout table, whose rows read `<n> <NAME> ... CHAR(<width>)`."""
    import re

    rows = re.split(r"(?m)^(?=\d+ )", text)
    out = []
    for row in rows:
        m = re.match(r"(\d+) (\S+)", row)
        w = re.search(r"CHAR\((\d+)\)", row)
        if m and w and int(m[1]) == len(out) + 1 and len(out) < fields:
            out.append((m[2], int(w[1])))
    if len(out) != fields:
        raise ValueError(f"{len(out)} of {fields} fields found")
    return out
