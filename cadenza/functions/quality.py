"""Audio quality rules as column expressions: expected cutoff, flags, grades."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bit rate (kbit/s) from which a cutoff (kHz) is expected; fixed values.
CUTOFFS = ((320, 20.0), (256, 19.5), (192, 18.5), (160, 16.5), (128, 16.0), (96, 15.0), (0, 13.0))
TOLERANCE, LOSSLESS_KHZ, WALL_DB, SLACK_KHZ = 1.0, 19.0, 25.0, 0.25
#: Codecs without loss, and what names of codecs hold that count one and a half times; fixed values.
LOSSLESS, EFFICIENT = ("flac", "alac", "wav", "pcm"), ("opus", "aac", "mp4a")
#: Grades by effective bit rate and by cutoff (Hz), best first; fixed values.
BY_RATE = ((300, "A"), (256, "A-"), (200, "B"), (150, "C"), (96, "D"))
BY_CUTOFF = ((19500, "B"), (18000, "C"), (15500, "D"))


def expected_cutoff(rate: Column) -> Column:
    out = F.lit(None).cast("double")
    for limit, khz in reversed(CUTOFFS):
        out = F.when(rate >= limit, khz).otherwise(out)
    return out


def supported_rate(cutoff: Column) -> Column:
    """The highest bit rate whose expected cutoff is reached, or missed by ``SLACK_KHZ`` at most."""
    out = F.lit(0)
    for limit, khz in reversed(CUTOFFS):
        out = F.when(cutoff >= khz - SLACK_KHZ, limit).otherwise(out)
    return out


def flag(cutoff: Column, wall_db: Column, rate: Column, lossless: Column) -> Column:
    """ok, low (a soft roll-off) or suspicious (a codec's wall below what the format promises)."""
    wall = F.coalesce(wall_db >= WALL_DB, F.lit(False))
    lossy = F.when(cutoff - expected_cutoff(rate) >= -TOLERANCE, "ok").when(wall, "suspicious").otherwise("low")
    whole = F.when(wall & (cutoff < LOSSLESS_KHZ), "suspicious").otherwise("ok")
    return F.when(cutoff.isNull(), "unmeasured").when(lossless, whole).otherwise(lossy)


def effective_rate(rate: Column, codec: Column) -> Column:
    """Bit rate as an older codec would need it: the newer ones count one and a half times."""
    return F.when(F.lower(codec).rlike("|".join(EFFICIENT)), rate * 1.5).otherwise(rate.cast("double"))


def grade(rate: Column, cutoff_hz: Column, wall: Column, codec: Column | None = None) -> Column:
    """A to F by bit rate or else by cutoff; A for a codec without loss; null if nothing is known."""
    by_rate, by_cutoff = F.lit("F"), F.lit("F")
    for limit, name in reversed(BY_RATE):
        by_rate = F.when(rate >= limit, name).otherwise(by_rate)
    for limit, name in reversed(BY_CUTOFF):
        by_cutoff = F.when(cutoff_hz >= limit, name).otherwise(by_cutoff)
    by_cutoff = F.when(cutoff_hz >= 20000, F.when(wall, "A-").otherwise("A")).otherwise(by_cutoff)
    whole = F.coalesce(F.lower(codec).isin(*LOSSLESS), F.lit(False)) if codec is not None else F.lit(False)
    return F.when(whole, "A").when(rate.isNotNull(), by_rate).when(cutoff_hz.isNotNull(), by_cutoff)
