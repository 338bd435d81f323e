"""Column functions on colours, dashes and codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The codes looked for, with their class, and other spellings.
TARGET_CODES = {
    "B": "BYDLENI", "BI": "BYDLENI", "BV": "BYDLENI", "BH": "BYDLENI", "BU": "BYDLENI", "BX.c": "BYDLENI", "BX.p": "BYDLENI", "BX.r": "BYDLENI",
    "R": "REKREACE", "RI": "REKREACE", "RX": "REKREACE",
    "S": "SMISENE_OBYTNE", "SO": "SMISENE_OBYTNE", "SV": "SMISENE_OBYTNE", "SC": "SMISENE_OBYTNE", "SX": "SMISENE_OBYTNE",
}
CODE_ALIASES = {"BXC": "BX.c", "BX.C": "BX.c", "BXP": "BX.p", "BX.P": "BX.p", "BXR": "BX.r", "BX.R": "BX.r"}
# End of fixed values.


def channels(hex_color: Column) -> tuple[Column, Column, Column]:
    return tuple(F.conv(F.substring(hex_color, at, 2), 16, 10).cast("int") for at in (2, 4, 6))


def near_white(hex_color: Column, least: int = 242, spread: int = 10) -> Column:
    c = channels(hex_color)
    return F.coalesce((F.least(*c) >= least) & (F.greatest(*c) - F.least(*c) <= spread), F.lit(False))


def near_black(hex_color: Column, most: int = 35, spread: int = 20) -> Column:
    c = channels(hex_color)
    return F.coalesce((F.greatest(*c) <= most) & (F.greatest(*c) - F.least(*c) <= spread), F.lit(False))


def red_fill(hex_color: Column) -> Column:
    r, g, b = channels(hex_color)
    return F.coalesce((r >= 180) & (g <= 110) & (b <= 110), F.lit(False))


def dash(raw: Column) -> Column:
    """(norm, phase) of a dash text: ``[a b] phase`` or bare numbers, the last one the phase; solid if all are 0 or none."""
    numbers = lambda text: F.transform(F.regexp_extract_all(text, F.lit(r"-?[0-9.]+"), F.lit(0)), lambda x: x.cast("double"))
    raw = F.coalesce(raw, F.lit(""))
    bracket = raw.contains("[")
    bare = numbers(raw)
    inside = F.when(bracket, numbers(F.regexp_extract(raw, r"\[([^\]]*)\]", 1))).otherwise(F.slice(bare, F.lit(1), F.greatest(F.size(bare) - 1, F.lit(0))))
    phase = F.coalesce(F.when(bracket, F.get(numbers(F.regexp_extract(raw, r"\](.*)$", 1)), F.lit(0))).otherwise(F.get(bare, F.size(bare) - 1)), F.lit(0.0))
    solid = ~F.exists(inside, lambda x: F.abs(x) > 1e-9)
    short = lambda x: F.regexp_replace(x.cast("string"), r"\.0$", "")
    norm = F.when(solid, F.lit("solid")).otherwise(F.concat(F.array_join(F.transform(inside, short), ","), F.lit(";phase="), short(phase)))
    return F.struct(norm.alias("norm"), F.when(solid, F.lit(0.0)).otherwise(phase).alias("phase"))


def target_code(text: Column) -> Column:
    """The code that a text is, by its ASCII letters, digits and dots in capitals; null if none."""
    bare = F.regexp_replace(F.upper(F.regexp_replace(text, r"[^\x00-\x7F]", "")), r"[^A-Z0-9.]", "")
    known = {c.upper(): c for c in TARGET_CODES} | CODE_ALIASES
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.try_element_at(table, bare)
