"""Integers out of text and out of packed words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hex_to_int(text: Column) -> Column:
    """A hexadecimal number below 2^63, with or without its prefix; null where it is none."""
    bare = F.regexp_replace(F.lower(text), "^0x", "")
    return F.when(bare.rlike("^0*[0-7]?[0-9a-f]{1,15}$"), F.conv(bare, 16, 10).cast("bigint"))


def int_to_hex(value: Column, width: int = 0) -> Column:
    """With zeros in front up to `width` digits; a longer number keeps all of its digits."""
    text = F.lower(F.hex(value))
    return F.concat(F.lit("0x"), F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0")) if width else text)


def field(word: Column, low: int, bits: int) -> Column:
    """The unsigned number in `bits` bits from bit `low` on."""
    return F.shiftright(word, low).bitwiseAND((1 << bits) - 1)


def floor_div(value: Column, by: int) -> Column:
    """Division that rounds down, also below zero."""
    return F.floor(value / by).cast("bigint")


def micros(ts: Column) -> Column:
    """A timestamp without zone as whole microseconds since 1970, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def position_label(groups: dict[str, list[Column]]) -> Column:
    """name=(a,b,c) for each group that has a value, parted by blanks."""
    shown = [F.when(F.coalesce(*[c.isNotNull() for c in cols]) & (F.concat_ws(",", *[c.cast("string") for c in cols]) != ""), F.concat(F.lit(f"{name}=("), F.concat_ws(",", *[c.cast("string") for c in cols]), F.lit(")"))) for name, cols in groups.items()]
    return F.concat_ws(" ", *shown)
