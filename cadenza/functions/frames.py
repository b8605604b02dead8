"""MPEG-1 layer III: where the first frame of a stream begins, and which bytes hold the middle of a file."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bit rates in kbit/s and sample rates by their codes in a header; fixed values.
BIT_RATES = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
SAMPLE_RATES = (44100, 48000, 32000)
#: Bytes that are searched for a first frame; frames that must follow each other, as two header bytes also come by chance.
SEARCHED, CHAIN = 64 * 1024, 3
#: Bytes of streams that are looked at together.
AT_ONCE = 1 << 20
#: Seconds of the middle, and what a file must be longer by.
MIDDLE, SPARE = 140.0, 10.0


def lengths_at(data: np.ndarray, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The lengths of frames whose headers begin at places of ``data``, in streams that end at ``ends``; 0 for none."""
    out = np.zeros(len(at), np.int64)
    whole = np.flatnonzero(at + 4 <= ends)
    place = at[whole]
    third = data[place + 2].astype(np.int64)
    rate, sample, pad = third >> 4, third >> 2 & 3, third >> 1 & 1
    good = (data[place] == 0xFF) & (data[place + 1] & 0xFE == 0xFA) & (rate > 0) & (rate < 15) & (sample < 3)
    out[whole[good]] = 144_000 * np.array(BIT_RATES)[rate[good]] // np.array(SAMPLE_RATES)[sample[good]] + pad[good]
    return out


def first_in_each(contents: list[bytes | None]) -> np.ndarray:
    """``first_frame`` of several streams, laid end to end: only bytes that can begin a header are looked at further."""
    data = np.frombuffer(b"".join(c or b"" for c in contents), np.uint8)
    sizes = np.array([len(c or b"") for c in contents], np.int64)
    ends = np.cumsum(sizes)
    start = np.flatnonzero(data == 0xFF)
    of = np.searchsorted(ends, start, "right")
    near = start - (ends - sizes)[of] < SEARCHED
    start, of = start[near], of[near]
    at = start
    for _ in range(CHAIN):
        length = lengths_at(data, at, ends[of])
        alive = length > 0
        start, of, at = start[alive], of[alive], (at + length)[alive]
    out = np.full(len(contents), -1, np.int64)
    found, first = np.unique(of, return_index=True)
    out[found] = start[first] - (ends - sizes)[found]
    return out


def first_frame(data: bytes | None) -> int:
    """The byte at which the first of ``CHAIN`` frames begins, each ending where the next begins; -1 if none does."""
    return int(first_in_each([data])[0])


def first_frames(content: Column) -> Column:
    """``first_frame`` of a column of bytes, in Arrow batches, of which ``AT_ONCE`` bytes or one stream are looked at together."""

    @F.pandas_udf("long")
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for contents in batches:
            upto = np.cumsum([0 if c is None else len(c) for c in contents])
            parts = np.split(np.arange(len(contents)), np.flatnonzero(np.diff(upto // AT_ONCE)) + 1)
            found = [first_in_each([contents.iloc[i] for i in part]) for part in parts if len(part)]
            yield pd.Series(np.concatenate(found) if found else [], dtype="int64")

    return measure(content)


def middle_range(seconds: Column, size: Column, middle: float = MIDDLE) -> Column:
    """struct(first, last, start, length): the bytes of the middle seconds, by the mean rate of bytes; null for the whole file.

    Files of unknown or no length or size, and short ones, are taken whole.
    """
    rate = size / seconds
    start = F.greatest(F.lit(0.0), seconds / 2 - middle / 2)
    first = F.floor(start * rate).cast("long")
    last = F.least(size.cast("long") - 1, F.floor(first + middle * rate).cast("long"))
    known = (size > 0) & (seconds > middle + SPARE) & (seconds < float("inf"))
    return F.when(known, F.struct(first.alias("first"), last.alias("last"), start.alias("start"), F.lit(middle).alias("length")))
