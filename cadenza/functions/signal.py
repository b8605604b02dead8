"""Signals held as arrays: envelopes, keys from chroma, cutoffs and fingerprints.

What fits is a column expression; kernels that need a transform are Arrow UDFs over whole batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tone profiles of major and minor keys, from C; fixed values (Krumhansl and Kessler 1982).
MAJOR_PROFILE = (6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88)
MINOR_PROFILE = (6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17)
#: The wheel's numbers for tonics from C; each semitone is seven steps on.
MAJOR_WHEEL = tuple((8 + 7 * i - 1) % 12 + 1 for i in range(12))
MINOR_WHEEL = tuple((5 + 7 * i - 1) % 12 + 1 for i in range(12))


def rms(y: Column) -> Column:
    """Root of the mean square; 0 of nothing."""
    total = F.aggregate(y, F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double"))
    return F.when(F.size(y) > 0, F.sqrt(total / F.size(y))).otherwise(0.0)


def largest_by_bin(y: Column, bins: int) -> Column:
    """Each bin's largest value; sample i is in bin i * bins div size; 0 for bins without any."""
    n = F.size(y)
    places = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.struct(F.ceil(b * n / bins).cast("int").alias("a"), F.ceil((b + 1) * n / bins).cast("int").alias("z")))
    return F.transform(places, lambda p: F.coalesce(F.array_max(F.slice(y, p.a + 1, F.greatest(p.z - p.a, F.lit(0)))).cast("double"), F.lit(0.0)))


def central(y: Column, length: int) -> Column:
    """The middle ``length`` samples; all if there are fewer."""
    return F.when(F.size(y) > length, F.slice(y, F.floor((F.size(y) - length) / 2).cast("int") + 1, length)).otherwise(y)


def segments(y: Column, n: int, length: int) -> Column:
    """The middle ``length`` of each of n equal parts; none if a part is shorter."""
    part = F.floor(F.size(y) / n).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.slice(y, i * part + F.floor((part - length) / 2).cast("int") + 1, length))
    return F.when(part >= length, cut).otherwise(F.array().cast("array<array<double>>"))


def rises(y: Column) -> Column:
    """The positive part of each step from the sample before."""
    return F.transform(y, lambda x, i: F.when(i == 0, 0.0).otherwise(F.greatest(x - F.get(y, i - 1), F.lit(0.0))))


def _pearson(a: Column, b: list[float]) -> Column:
    n, centred = len(b), [x - sum(b) / len(b) for x in b]
    mean = F.aggregate(a, F.lit(0.0), lambda t, x: t + x) / n
    top = F.aggregate(F.zip_with(a, F.array(*map(F.lit, centred)), lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    below = F.aggregate(a, F.lit(0.0), lambda t, x: t + (x - mean) * (x - mean)) * sum(x * x for x in centred)
    return F.when(below > 0, top / F.sqrt(below)).otherwise(0.0)


def key_ranking(chroma: Column) -> Column:
    """struct(score, key) for the 24 keys, best first, of twelve chroma values from C."""
    each = []
    for tonic in range(12):
        turned = F.concat(F.slice(chroma, tonic + 1, 12 - tonic), F.slice(chroma, 1, tonic)) if tonic else chroma
        each.append(F.struct(_pearson(turned, list(MAJOR_PROFILE)).alias("score"), F.lit(f"{MAJOR_WHEEL[tonic]}B").alias("key")))
        each.append(F.struct(_pearson(turned, list(MINOR_PROFILE)).alias("score"), F.lit(f"{MINOR_WHEEL[tonic]}A").alias("key")))
    return F.sort_array(F.array(*each), asc=False)


def detected_key(chroma: Column) -> Column:
    """struct(key, confidence)."""
    best = F.get(key_ranking(chroma), F.lit(0))
    return F.struct(best["key"].alias("key"), F.bround(F.greatest(best.score, F.lit(0.0)), 3).alias("confidence"))


def consensus(votes: Column) -> Column:
    """struct(key, agreement) of array<struct<key,score>>: most votes, then the largest sum of positive scores."""
    kinds = F.array_distinct(F.transform(votes, lambda v: v["key"]))
    tally = F.transform(kinds, lambda k: F.struct(F.size(F.filter(votes, lambda v: v["key"] == k)).alias("n"), F.aggregate(votes, F.lit(0.0), lambda t, v: t + F.when(v["key"] == k, F.greatest(v.score, F.lit(0.0))).otherwise(0.0)).alias("sum"), k.alias("key")))
    best = F.array_max(tally)
    return F.struct(best["key"].alias("key"), F.concat(best.n, F.lit("/"), F.size(votes)).alias("agreement"))


@cache
def hann(size: int) -> np.ndarray:
    return np.hanning(size)


def spectrum(y: np.ndarray, size: int = 8192) -> np.ndarray:
    """Mean power in dB of half-overlapping Hann frames."""
    if len(y) < size:
        y = np.pad(y, (0, size - len(y)))
    frames = np.lib.stride_tricks.sliding_window_view(y, size)[:: size // 2] * hann(size)
    return 10 * np.log10((np.abs(np.fft.rfft(frames, axis=1)) ** 2).mean(0) + 1e-12)


def cutoff(level: np.ndarray, rate: float, floor: float = -68.0, reach: float = 500.0) -> tuple[float, float]:
    """(Hz, dB): the last frequency above the floor under the peak, and the drop across it."""
    hz = np.linspace(0, rate / 2, len(level))
    over = np.flatnonzero(level - level.max() > floor)
    if not len(over):
        return 0.0, 0.0
    at = hz[over[-1]]
    mean = lambda low, high: level[(hz >= low) & (hz <= high)].mean() if ((hz >= low) & (hz <= high)).any() else -120.0
    return float(at), float(mean(at - reach, at) - mean(at + 1e-9, at + reach))


def cutoffs(rate: float):
    """An Arrow UDF: PCM -> struct(hz, wall_db)."""

    @F.pandas_udf("hz double, wall_db double")
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([cutoff(spectrum(np.asarray(y, float)), rate) for y in s], columns=["hz", "wall_db"])

    return measure


def fingerprint(y: np.ndarray, rate: float, bands: int = 24, steps: int = 24, size: int = 4096) -> np.ndarray:
    """bands x steps levels in dB, each band's mean removed, of unit deviation: one flat vector."""
    starts = np.linspace(0, max(0, len(y) - size), steps).astype(int)
    frames = np.stack([np.pad(y[s : s + size], (0, max(0, size - len(y[s : s + size])))) for s in starts]) * np.hanning(size)
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
    edges = np.unique(np.geomspace(2, size // 2, bands + 1).astype(int))
    level = 10 * np.log10(np.stack([power[:, a:b].mean(1) for a, b in zip(edges, edges[1:], strict=False)]) + 1e-12)
    level -= level.mean(1, keepdims=True)
    return (level / (level.std() or 1.0)).ravel()


def fingerprints(rate: float):
    """An Arrow UDF: PCM -> fingerprint."""

    @F.pandas_udf("array<double>")
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([fingerprint(np.asarray(y, float), rate) for y in s])

    return measure


def beat_phase(times: np.ndarray, weights: np.ndarray, bpm: float, bins: int = 64) -> tuple[float, float]:
    """(offset in seconds, concentration 0 to 1): where a grid of this tempo gathers the most weight."""
    period = 60.0 / bpm
    angle = 2 * np.pi * (times % period) / period
    total = weights.sum()
    if total <= 0:
        return 0.0, 0.0
    curve = np.bincount((angle / (2 * np.pi) * bins).astype(int) % bins, weights, bins)
    smooth = (np.roll(curve, 1) + 2 * curve + np.roll(curve, -1)) / 4
    mean = (weights * np.exp(1j * angle)).sum() / total
    return float((smooth.argmax() + 0.5) / bins * period), float(abs(mean))


def downbeat(rise: np.ndarray) -> tuple[int, float]:
    """(beat of the bar, share of the votes) from a novelty at each beat: what rises against the same beat of the bar before."""
    if len(rise) < 8:
        return 0, 0.0
    novelty = np.maximum(rise[4:] - rise[:-4], 0)
    votes = np.bincount(np.arange(4, len(rise)) % 4, novelty, 4)
    return int(votes.argmax()), float(votes.max() / votes.sum()) if votes.sum() > 0 else 0.0


# Fixed values of where a print looks: seconds, windows, and the frequencies of its bands.
PRINT_START, PRINT_SECONDS, PRINT_STEP, PRINT_SKIPS = 30.0, 60.0, 0.5, 100.0
PRINT_WINDOWS, PRINT_BANDS, PRINT_LOW, PRINT_HIGH = 24, 24, 60.0, 6000.0
PRINT_MISSING = 0.25


def print_grid(seconds: Column) -> Column:
    """struct(start, step, length, n): where a print looks at a recording. Null without a length.

    Long recordings skip their intro. The step is a share of the rest, rounded down to a quantum, so copies whose
    lengths differ by little have the same grid; a short one is a single window, all there is.
    """
    start = F.when(seconds > PRINT_SKIPS, PRINT_START).otherwise(0.0)
    rest, length = seconds - start, PRINT_SECONDS / PRINT_WINDOWS
    step = F.greatest(F.lit(length), F.floor(rest / PRINT_WINDOWS / PRINT_STEP) * PRINT_STEP)
    many = F.struct(start.alias("start"), step.alias("step"), F.lit(length).alias("length"), F.lit(PRINT_WINDOWS).alias("n"))
    one = F.struct(start.alias("start"), F.lit(0.0).alias("step"), rest.alias("length"), F.lit(1).alias("n"))
    return F.when((rest > 0) & (seconds < float("inf")), F.when(rest < PRINT_SECONDS, one).otherwise(many))


def print_windows(grid: Column) -> Column:
    """array of struct(offset, length) in seconds."""
    return F.transform(F.sequence(F.lit(0), grid.n - 1), lambda k: F.struct((grid.start + k * grid.step).alias("offset"), grid["length"].alias("length")))


def windowed(y: np.ndarray, rate: float, start: float, step: float, length: float, n: int) -> np.ndarray | None:
    """The samples of a grid's windows, one after another, each of its exact length; None if one misses more than a moment."""
    size, parts = round(length * rate), []
    for k in range(n):
        first = round((start + k * step) * rate)
        part = y[first : first + size]
        if len(part) < size - int(rate * PRINT_MISSING):
            return None
        parts.append(np.pad(part, (0, size - len(part))))
    return np.concatenate(parts) if parts else None


def window_print(y: np.ndarray | None, rate: float, low: float = PRINT_LOW, high: float = PRINT_HIGH, size: int = 8192) -> np.ndarray | None:
    """Levels in dB of PRINT_WINDOWS equal parts by PRINT_BANDS bands, each band's mean removed, of unit deviation: how each band changes over time."""
    part = 0 if y is None else len(y) // PRINT_WINDOWS
    if part < 512 or len(y) < rate * 2:
        return None
    edges = np.geomspace(low, high, PRINT_BANDS + 1)
    # All parts are of one length, so their levels stand at the same frequencies.
    hz = np.linspace(0, rate / 2, size // 2 + 1)
    bands = list(zip(*(np.searchsorted(hz, e) for e in (edges[:-1], edges[1:])), strict=True))
    rows = []
    for k in range(PRINT_WINDOWS):
        level = spectrum(y[k * part : (k + 1) * part], size)
        rows.append([level[a:b].mean() if b > a else -120.0 for a, b in bands])
    table = np.array(rows) - np.mean(rows, axis=0)
    spread = table.std()
    return (table / spread).ravel() if spread > 1e-9 else None


def window_prints(rate: float, low: float = PRINT_LOW, high: float = PRINT_HIGH, size: int = 8192):
    """An Arrow UDF: (PCM, grid) -> print, or null."""

    @F.pandas_udf("array<double>")
    def measure(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.Series]:
        for pcm, grid in batches:
            found = []
            for y, start, step, length, n in zip(pcm, grid["start"], grid["step"], grid["length"], grid["n"], strict=True):
                known = y is not None and n == n and n is not None
                got = window_print(windowed(np.asarray(y, float), rate, start, step, length, int(n)), rate, low, high, size) if known else None
                found.append(got)
            yield pd.Series(found)

    return measure


def grid_prints(rate: float, low: float = PRINT_LOW, high: float = PRINT_HIGH, size: int = 8192):
    """An Arrow UDF: (PCM, array of grids) -> array of prints, null where a grid has none. So samples are sent once."""

    @F.pandas_udf("array<array<double>>")
    def measure(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for pcm, grids in batches:
            found = []
            for y, asked in zip(pcm, grids, strict=True):
                y = None if y is None else np.asarray(y, float)
                prints = [None if y is None or g is None else window_print(windowed(y, rate, g["start"], g["step"], g["length"], int(g["n"])), rate, low, high, size) for g in asked]
                found.append([None if p is None else p.tolist() for p in prints])
            yield pd.Series(found, dtype=object)

    return measure
