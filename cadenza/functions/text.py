"""Text rules as column expressions: cleaning, names, versions, tokens, paths."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that name a version of a track; fixed values.
VERSION = r"(?i)\b(original\s+mix|extended\s+mix|edit|preview|remix|bootleg|master(v\d+)?|vip|dub|radio\s+edit)\b"
#: Words that say nothing about which track it is; fixed values. Words of versions (mix, remix, edit) aren't among them, as a remix is another track.
STOP_WORDS = (
    "official", "video", "oficial", "audio", "lyric", "lyrics", "letra", "hd", "hq",
    "4k", "mv", "m", "v", "remaster", "remastered", "explicit", "clip", "visualizer",
    "feat", "ft", "featuring", "con", "the", "a", "el", "la", "los", "las", "de", "del",
    "y", "and", "x", "vs", "full", "free", "download", "out", "now", "premiere",
)
CONTROLS = r"[\x00-\x1f\x7f​-‏ -‮⁠﻿]"
#: Genre families by what their names hold; the first that fits; fixed values in a fixed order.
FAMILIES = (
    ("electronic", ("dance", "electro", "techno", "house", "trance", "dubstep", "drum", "dnb", "edm", "electronic", "hardstyle", "hardcore", "rave", "progressive", "big room", "garage", "breakbeat")),
    ("rap", ("rap", "hip hop", "hip-hop", "hiphop", "trap", "drill")),
    ("pop", ("pop",)),
    ("rock", ("rock", "metal", "punk", "indie", "alternative", "grunge")),
    ("latin", ("latin", "reggaeton", "salsa", "cumbia", "bachata", "merengue", "tango")),
    ("rnb", ("r&b", "rnb", "soul", "funk")),
    ("jazz", ("jazz", "blues")),
    ("reggae", ("reggae", "dancehall", "ska")),
    ("classical", ("classical", "clásica")),
    ("folk", ("folk", "country", "acoustic")),
)


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def cleaned(text: Column) -> Column:
    """Without invisible and control characters, white space squeezed."""
    return squeezed(F.regexp_replace(F.coalesce(text, F.lit("")), CONTROLS, " "))


def fold(x: str | None) -> str:
    plain = "".join(c for c in unicodedata.normalize("NFKD", x or "") if not unicodedata.combining(c)).casefold()
    kept = "".join(c if c.isalnum() else "" if c in "'’`" else "s" if c == "$" else " " for c in plain)
    return " ".join(kept.split())


@F.pandas_udf(T.StringType())
def folded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """NFKD without marks, case folded, apostrophes dropped, other signs as spaces. Spark has no such form."""
    for s in batches:
        yield s.map(fold, na_action=None)


@F.pandas_udf(T.ArrayType(T.StringType()))
def folded_names(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The distinct folded names of an array, ascending, without empty ones."""
    for s in batches:
        yield s.map(lambda names: sorted({fold(n) for n in (names if names is not None else ())} - {""}))


def artist_identity(artist: Column) -> Column:
    """Trimmed, lower case; null if blank, which blocks nobody."""
    return F.nullif(F.lower(F.trim(artist)), F.lit(""))


def declared(text: Column, absent: str = "not declared") -> Column:
    return F.coalesce(F.nullif(F.trim(text), F.lit("")), F.lit(absent))


def label(artist: Column, title: Column, path: Column) -> Column:
    title = F.nullif(F.trim(title), F.lit(""))
    return F.when(F.nullif(F.trim(artist), F.lit("")).isNotNull() & title.isNotNull(), F.concat(F.trim(artist), F.lit(" — "), title)).otherwise(F.coalesce(title, stem(path)))


def basename(path: Column) -> Column:
    """The last part of a path of either system."""
    return F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(.)\.[^.]*$", "$1")


def natural(text: Column) -> Column:
    """An order key in which numbers count by value: each run of digits is padded to 12."""
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(F.regexp_replace(p, r"^0+(?=\d)", ""), 12, "0")).otherwise(p)), "")


def genre_key(genre: Column) -> Column:
    key = F.lower(cleaned(genre))
    return F.when(~key.isin("", "no genre", "sin género"), key)


def genre_family(genre: Column) -> Column:
    """The broad family of a genre; null if there is no genre, "other" if none fits."""
    key = F.lower(genre)
    out = F.when(key != "", "other")
    for family, parts in reversed(FAMILIES):
        out = F.when(reduce(or_, [F.contains(key, F.lit(p)) for p in parts]), family).otherwise(out)
    return out


def tokens(text: Column) -> Column:
    """Distinct words of two letters or more outside brackets, without stop words."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\(\[\{].*?[\)\]\}]", " ")
    words = F.split(F.trim(F.regexp_replace(plain, r"[^0-9a-záéíóúüñ\s]", " ")), r"\s+")
    # Stop words are a set that is made once, not an array that is hashed for each text.
    return F.sort_array(F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS))))


def shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def relevance(candidate: Column, query: Column) -> Column:
    """Shared tokens over the smaller set; a query of two words or more needs two in common."""
    least = F.least(F.size(candidate), F.size(query))
    return F.when(F.size(query) == 0, 1.0).when((F.size(candidate) == 0) | ((F.size(query) >= 2) & (shared(candidate, query) < 2)), 0.0).otherwise(shared(candidate, query) / least)


def same_track(a: Column, b: Column) -> Column:
    return (shared(a, b) >= 2) & (shared(a, b) / F.greatest(F.least(F.size(a), F.size(b)), F.lit(1)) >= 0.72)


def versions(side: Column) -> Column:
    """The version words of a name, in lower case, joined by spaces."""
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(side), F.lit(VERSION), 0), lambda x: F.regexp_replace(x, r"\s+", " ")), " ")


def without_version(side: Column) -> Column:
    bare = F.regexp_replace(side, r"\(([^)]*)\)", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, VERSION, " "), r"\s+", " "))


def counting_key(side: Column) -> Column:
    return F.lower(squeezed(F.regexp_replace(without_version(side), r"[^\p{L}\p{N}_\s]", " ")))


def cell_guard(text: Column) -> Column:
    """A leading sign that a spreadsheet would take for a formula gets an apostrophe."""
    return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def hidden_paths(text: Column) -> Column:
    """Absolute paths in a message become their last part."""
    return F.regexp_replace(text, r"(?:[A-Za-z]:)?[\\/](?:[^\\/\s'\"]+[\\/])+([^\\/\s'\"]+)", "$1")


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\R+", " "))


def xml_safe(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x09\x0A\x0D\x20-퟿-�\x{10000}-\x{10FFFF}]", "")


def clock(seconds: Column) -> Column:
    """m:ss of a number of seconds; empty if it isn't known."""
    return F.when(seconds >= 0, F.format_string("%d:%02d", F.floor(seconds / 60), F.floor(seconds).cast("long") % 60)).otherwise("")


def clock_seconds(text: Column) -> Column:
    """Seconds of h:mm:ss, m:ss or s; null if it isn't one."""
    parts = F.split(F.trim(text), ":")
    value = F.aggregate(parts, F.lit(0).cast("long"), lambda total, p: total * 60 + p.try_cast("long"))
    return F.when(text.rlike(r"^\s*\d+(:\d{1,2}){0,2}\s*$"), value)


def number_or(text: Column, default: float = 0.0) -> Column:
    return F.coalesce(text.try_cast("double"), F.lit(default))


def opaque_id(path: Column) -> Column:
    return F.substring(F.sha1(F.lower(path).cast("binary")), 1, 16)
