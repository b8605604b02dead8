"""Musical keys on the wheel of twelve, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PATTERN = r"^\s*(0?[1-9]|1[0-2])\s*([ABab])\s*$"
#: Classic names in wheel order, minor (A) then major (B); fixed values.
MINOR = ("Abm", "Ebm", "Bbm", "Fm", "Cm", "Gm", "Dm", "Am", "Em", "Bm", "F#m", "Dbm")
MAJOR = ("B", "F#", "Db", "Ab", "Eb", "Bb", "F", "C", "G", "D", "A", "E")
#: Other spellings of the same keys; fixed values.
SPELLINGS = {"G#m": "Abm", "D#m": "Ebm", "A#m": "Bbm", "C#m": "Dbm", "Gbm": "F#m", "Cb": "B", "Gb": "F#", "C#": "Db", "G#": "Ab", "D#": "Eb"}
#: Compatibility by relation; fixed values.
COMPAT = {"same": 1.0, "neighbour": 0.8, "relative": 0.8, "two": 0.5, "far": 0.2, "unknown": 0.5}
EXPONENT = 0.6


def number(key: Column) -> Column:
    n = F.regexp_extract(key, PATTERN, 1)
    return F.try_to_number(F.nullif(n, F.lit("")), F.lit("99")).cast("int")


def side(key: Column) -> Column:
    return F.nullif(F.upper(F.regexp_extract(key, PATTERN, 2)), F.lit(""))


def relation(a: Column, b: Column) -> Column:
    """same, neighbour, relative, two, far, or unknown if either isn't a key. Each key is read once: the rest is a look into a table."""
    return coded_relation(code(a), code(b))


def compat(a: Column, b: Column) -> Column:
    return coded_compat(code(a), code(b))


def code(key: Column) -> Column:
    """A key as a small number, 24 for unknown: parse each item once, then look pairs up."""
    return F.coalesce((number(key) - 1) * 2 + F.when(side(key) == "B", 1).otherwise(0), F.lit(24)).cast("int")


def _name(a: int, b: int) -> str:
    if 24 in (a, b):
        return "unknown"
    turn, level = (a // 2 - b // 2) % 12, a % 2 == b % 2
    return {(True, 0): "same", (True, 1): "neighbour", (False, 0): "relative", (True, 2): "two"}.get((level, min(turn, 12 - turn)), "far")


RELATIONS = tuple(_name(a, b) for a in range(25) for b in range(25))
STEPS = {"same": 0, "neighbour": 1, "relative": 1}


def coded_relation(a: Column, b: Column) -> Column:
    return F.get(F.array(*map(F.lit, RELATIONS)), a * 25 + b)


def coded_compat(a: Column, b: Column) -> Column:
    return F.get(F.array(*(F.lit(COMPAT[r]) for r in RELATIONS)), a * 25 + b)


def coded_steps(a: Column, b: Column) -> Column:
    return F.get(F.array(*(F.lit(STEPS.get(r, 2)) for r in RELATIONS)), a * 25 + b)


def factor(a: Column, b: Column) -> Column:
    return F.pow(compat(a, b), F.lit(EXPONENT))


def steps(a: Column, b: Column) -> Column:
    """0 the same key, 1 a neighbour or the relative, 2 all else and unknown."""
    return coded_steps(code(a), code(b))


def classic(key: Column) -> Column:
    """The classic name of a wheel key; "" if it isn't one."""
    names = F.when(side(key) == "A", F.get(F.array(*map(F.lit, MINOR)), number(key) - 1)).when(side(key) == "B", F.get(F.array(*map(F.lit, MAJOR)), number(key) - 1))
    return F.coalesce(names, F.lit(""))


def wheel(name: Column) -> Column:
    """The wheel key of a classic name; null if it isn't one."""
    table = {n: f"{i + 1}A" for i, n in enumerate(MINOR)} | {n: f"{i + 1}B" for i, n in enumerate(MAJOR)}
    table |= {other: table[n] for other, n in SPELLINGS.items()}
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), F.trim(name))


def format_class(text: Column) -> Column:
    """How a key is written: classic, wheel, unknown or empty."""
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", "empty").when(wheel(text).isNotNull(), "classic").when(number(text).isNotNull(), "wheel").otherwise("unknown")


def unanimous(agreement: Column) -> Column:
    """"won/total" -> whether all segments agree; null if it wasn't measured; an error if malformed."""
    text = F.trim(F.coalesce(agreement, F.lit("")))
    won, total = F.regexp_extract(text, r"^(\d+)/(\d+)$", 1), F.regexp_extract(text, r"^(\d+)/(\d+)$", 2)
    return F.when(text == "", None).when(won == "", F.raise_error(F.concat(F.lit("malformed agreement: "), text)).cast("boolean")).otherwise((total.try_cast("int") > 0) & (won.try_cast("int") == total.try_cast("int")))


def doubtful(agreement: Column) -> Column:
    """Whether a key isn't known to be unanimous; malformed counts as doubtful."""
    parts = F.split(F.trim(F.coalesce(agreement, F.lit(""))), "/")
    won, total = (F.get(parts, i).try_cast("int") for i in (F.lit(0), F.lit(1)))
    return ~F.coalesce((total > 0) & (won == total), F.lit(False))
