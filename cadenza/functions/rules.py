"""Rules on single rows as column expressions: each gives the name of what is wrong, or null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadenza.functions.text import CONTROLS, basename, squeezed

RATINGS = ("ok", "fair", "bad")
NAME_MAX, REASON_MAX = 200, 1_000


def agreement_fault(agreement: Column, votes: Column) -> Column:
    """An agreement "g/t" goes with exactly t votes ("8A|3B"), g of them at most; both may be absent."""
    form = r"^\s*(\d+)/(\d+)\s*$"
    won, total = (F.regexp_extract(agreement, form, i).try_cast("int") for i in (1, 2))
    n = F.when(votes == "", 0).otherwise(F.size(F.split(votes, r"\|")))
    return (
        F.when(agreement.isNull() & votes.isNull(), None).when(agreement.isNull() | votes.isNull(), "half-absent").when(~agreement.rlike(form), "form")
        .when(won > total, "more-than-all").when(n != total, "votes-differ")
    )


def one_line(text: Column) -> Column:
    return F.regexp_replace(text, CONTROLS, " ")


def clean_name(name: Column) -> Column:
    """Control characters as spaces; blank is no name."""
    return F.when(F.trim(one_line(name)) != "", one_line(name))


def rating_fault(rating: Column, reason: Column) -> Column:
    """A rating is one of three, exactly; a bad one needs its reason; reasons have a length."""
    why = F.nullif(F.trim(one_line(reason)), F.lit(""))
    return F.when(~F.coalesce(rating.isin(*RATINGS), F.lit(False)), "rating").when((rating == "bad") & why.isNull(), "no-reason").when(F.length(why) > REASON_MAX, "long-reason")


def confined(path: Column, roots: tuple[str, ...]) -> Column:
    """Whether a path without ".." lies below a root, or is one."""
    plain = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/+", "/")
    inside = F.lit(False)
    for root in roots:
        inside |= (plain == root.rstrip("/")) | F.startswith(plain, F.lit(root.rstrip("/") + "/"))
    return F.coalesce(inside & ~plain.rlike(r"(^|/)\.\.(/|$)"), F.lit(False))


def posix_restored(path: Column) -> Column:
    """One form for paths of either system: slashes, no trailing one, lower-case drive letters."""
    plain = F.regexp_replace(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/+", "/"), "(.)/$", "$1")
    return F.when(plain.rlike("^[A-Za-z]:"), F.concat(F.lower(F.substring(plain, 1, 1)), F.substring(plain, 2, 2**31 - 1))).otherwise(plain)


def file_state(path: Column, matches: Column) -> Column:
    """no-path, ok, ambiguous or not-found, by how many files a path leads to."""
    return F.when(F.coalesce(F.trim(path), F.lit("")) == "", "no-path").when(matches == 1, "ok").when(matches > 1, "ambiguous").otherwise("not-found")


def spectral_verdict(cutoff_hz: Column, wall: Column) -> Column:
    """What a measured cutoff says: full, lossy-320, lossy-256, lossy-192, lossy-128, lossy-96, soft or poor."""
    hard = F.when(cutoff_hz >= 20_000, "lossy-320").when(cutoff_hz >= 19_500, "lossy-256").when(cutoff_hz >= 18_000, "lossy-192").when(cutoff_hz >= 15_500, "lossy-128").otherwise("lossy-96")
    soft = F.when(cutoff_hz >= 20_000, "full").when(cutoff_hz >= 16_000, "soft").otherwise("poor")
    return F.when(cutoff_hz.isNotNull(), F.when(F.coalesce(wall, F.lit(False)), hard).otherwise(soft))


def agreement_text(won: Column, votes: Column) -> Column:
    """The struct (agreement "g/t", votes "a|b") of a vote; nulls if nothing was measured."""
    n = F.size(votes)
    return F.struct(F.when(votes.isNotNull(), F.concat(won.cast("string"), F.lit("/"), n.cast("string"))).alias("agreement"), F.array_join(votes, "|").alias("votes"))


def now_text() -> Column:
    return F.date_format(F.convert_timezone(None, F.lit("UTC"), F.current_timestamp().cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def recent_from(days: int = 400) -> Column:
    """The first date that counts as recent, as text."""
    return F.date_sub(F.current_date(), days).cast("string")


def curve_text(metrics: Column, n: Column, least: int = 12) -> Column:
    """A curve's figure with the sign that it is orientative below so many points."""
    return F.concat(F.format_string("%.2f", F.bround(metrics, 2)), F.when(n < least, F.lit(" (orientative)")).otherwise(""))


def shown_name(title: Column, path: Column) -> Column:
    return F.coalesce(F.nullif(squeezed(title), F.lit("")), basename(path))
