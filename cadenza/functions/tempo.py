"""Tempo as column expressions. A tempo counts if it is finite and above 0."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Relative distance from which two tempi don't mix.
GATE = 0.08
#: The readings of the second tempo: as it is, doubled, halved. In ties the earlier one holds.
READINGS = ((1.0, "same"), (2.0, "double"), (0.5, "half"))
#: Nominal ratios of a tempo estimate to its truth, and their class; fixed values, the first wins ties.
RATIOS = (
    (1.0, "exact"), (2.0, "octave"), (1 / 2, "octave"), (4.0, "octave"), (1 / 4, "octave"), (3 / 2, "triplet"), (2 / 3, "triplet"),
    (3.0, "other"), (1 / 3, "other"), (4 / 3, "other"), (3 / 4, "other"), (5 / 4, "other"), (4 / 5, "other"), (5 / 3, "other"), (3 / 5, "other"), (6.0, "other"), (1 / 6, "other"),
)
CLASSES = ("exact", "octave", "triplet", "other", "genuine", "no-reference")


def valid(bpm: Column) -> Column:
    """Whether a tempo is measured. NaN, infinite, null and 0 aren't."""
    return F.coalesce((bpm > 0) & (bpm < float("inf")), F.lit(False))


def _apart(a: Column, b: Column, factor: float) -> Column:
    return F.abs(a - b * factor) / F.greatest(a, b * factor)


def distance(a: Column, b: Column) -> Column:
    """Relative distance over the three readings; 1 if either isn't measured."""
    return F.when(valid(a) & valid(b), F.least(*(_apart(a, b, f) for f, _ in READINGS))).otherwise(1.0)


def score(a: Column, b: Column) -> Column:
    """1 for equal tempi, down to exactly 0 at the gate and beyond."""
    d = distance(a, b)
    return F.when(d < GATE, 1 - d / GATE).otherwise(0.0)


def passes(a: Column, b: Column) -> Column:
    return distance(a, b) < GATE


def reading(a: Column, b: Column) -> Column:
    """The index in ``READINGS`` of the nearest reading; null if either isn't measured."""
    gaps = [_apart(a, b, f) for f, _ in READINGS]
    least = F.least(*gaps)
    return F.when(valid(a) & valid(b), reduce(lambda rest, i: F.when(gaps[i] == least, i).otherwise(rest), (1, 0), F.lit(2)))


def reading_name(a: Column, b: Column) -> Column:
    return F.get(F.array(*(F.lit(n) for _, n in READINGS)), reading(a, b))


def delta_percent(a: Column, b: Column) -> Column:
    """The step from a to b in percent, with its sign; its size is the gate's distance. Null if not measured."""
    factor = F.get(F.array(*(F.lit(f) for f, _ in READINGS)), reading(a, b))
    return F.when(valid(a) & valid(b), 100 * distance(a, b) * F.when(b * factor < a, -1.0).otherwise(1.0))


def pitch(a: Column, b: Column) -> Column:
    """How far the slower must be pitched, by the best reading: an independent check of the gate."""
    return F.least(*(1 - F.least(a, b * f) / F.greatest(a, b * f) for f, _ in READINGS))


def absolute_error(estimate: Column, truth: Column) -> Column:
    """BPM by which an estimate misses its truth, its double or its half."""
    return F.least(*(F.abs(estimate - truth * f) for f, _ in READINGS))


def octave_gap(a: Column, b: Column) -> Column:
    """Octave-tolerant absolute distance for similar-track lists; 999 if either is missing."""
    return F.when(valid(a) & valid(b), absolute_error(a, b)).otherwise(999.0)


def error_class(estimate: Column, truth: Column, limit: float = 1.0, tolerance: float = 0.02) -> Column:
    """struct(class, ratio, off): the nominal ratio that explains an estimate."""
    each = F.array(*(F.struct(F.abs(estimate - truth * r).alias("off"), F.lit(i).alias("i"), F.lit(r).alias("ratio"), F.lit(n).alias("name"), F.greatest(F.lit(limit), truth * (r * tolerance)).alias("within")) for i, (r, n) in enumerate(RATIOS)))
    near = F.array_min(F.filter(each, lambda x: x.off <= x.within))
    close = F.abs(estimate - truth) <= limit
    name = F.when(~valid(truth), "no-reference").when(close, "exact").when(near.isNull() | (near.i == 0), "genuine").otherwise(near["name"])
    ratio = F.when(~valid(truth), None).when(close | (near.i == 0), 1.0).otherwise(near.ratio)
    off = F.when(~valid(truth), None).when(close, F.abs(estimate - truth)).otherwise(near.off)
    return F.struct(name.alias("class"), ratio.cast("double").alias("ratio"), off.cast("double").alias("off"))


def shown(bpm: Column) -> Column:
    """One decimal, half to even; null if not measured."""
    return F.when(valid(bpm), F.bround(bpm, 1))
