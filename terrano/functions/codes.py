"""Administrative code expressions; codes are strings, leading zeros matter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def padded(c: Column, width: int) -> Column:
    """Left-padded with zeros to width, never cut (lpad alone would cut)."""
    return F.lpad(c, F.greatest(F.length(c), F.lit(width)), F.lit("0"))


def code7(c: Column) -> Column:
    return padded(F.regexp_replace(c.cast("string"), "[^0-9]", ""), 7)


def code6(c: Column) -> Column:
    """The first six digits after padding to seven: the order matters."""
    return F.substring(code7(c), 1, 6)


def whole6(c: Column) -> Column:
    return padded(F.regexp_replace(c.cast("string"), "[^0-9]", ""), 6)


def class_of(c: Column, mixed: bool = False) -> Column:
    """Kind of unit by the seventh digit; mixed: 4 and 5 are the urban and rural parts of mixed units."""
    d = F.substring(code7(c), 7, 1)
    urban, rural = (["1", "4"], ["2", "5"]) if mixed else (["1"], ["2"])
    return F.when(d.isin(urban), "urban").when(d.isin(rural), "rural").when(d == "3", "urban_rural").otherwise("rural")


def is_county(c: Column) -> Column:
    return (F.length(c) == 7) & (F.substring(c, 5, 3) == "000") & (F.substring(c, 3, 2) != "00")


def is_whole_commune(c: Column) -> Column:
    return (F.length(c) == 7) & (F.substring(c, 5, 3) != "000") & (F.substring(c, 3, 2) != "00") & F.substring(c, 7, 1).isin("1", "2", "3")
