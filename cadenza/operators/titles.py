"""Titles of uploads as readings: a table of rewrites cleans them, and each way in which a title can be read is a row.

An upload says who and what in one line, in several layouts. ``readings`` gives every layout that fits as an
element of an array, the likeliest first, so that a join by any reading finds what one reading misses. All is
column expressions; only Unicode forms, which Spark doesn't have, are Arrow UDFs.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.text import folded, folded_names, squeezed

# Patterns whose words decide what a title is taken to say.
ARTIST_SEPARATOR = r"\s*(?:,|&|\+|/|\bx\b|\bvs\.?\s|\band\b|\bfeat\.?\s|\bft\.?\s|\bfeaturing\b|\bwith\b|·)\s*"
CHANNEL = r"\s*-\s*topic\s*$|\s*vevo\s*$|\s*official\s*$"
VERSION = (
    r"remix|\bmix\b|\bedit\b|\bvip\b|bootleg|\bflip\b|rework|version|instrumental|a\s?capp?ella|acoustic|sped\s*up|slowed|nightcore|\b8d\b|"
    r"bass\s*boosted|\blive\b|en\s+vivo|\bconcert\b|remaster|\bdub\b|\bdemo\b|\boriginal\b"
)
STRONG_VERSION = r"\blive\b|remix|\bmix\b|\bedit\b|acoustic|instrumental|a\s?capp?ella|sped\s*up|slowed|nightcore|bootleg|\bvip\b|\bcover\b"
NOISE = (
    r"official|oficial|\bvideo\b|\bv[ií]deo\b|\baudio\b|\blyrics?\b|\bletra\b|visuali[sz]er|\bvisual\b|\bhd\b|\bhq\b|\b4k\b|\bmv\b|\bm/v\b|out\s+now|"
    r"free\s*d(?:ownload|l)|premiere|\bexplicit\b|\bclip\b|full\s*album|music\s*video|subtitulad|con\s+letra|\bprod\b|produced\s+by|^\s*from\b|"
    r"^\s*\d{4}\s*$|^\s*(?:19|20)\d{2}\b|\bdir\.?\s+by\b|directed\s+by|performance\s+ver|dance\s+(?:practice|performance)"
)
EVENT = (
    r"\b(?:19|20)\d{2}\b|festival|glastonbury|coachella|tomorrowland|lollapalooza|\btour\b|\bgira\b|concierto|\bsessions?\b|boiler\s*room|"
    r"tiny\s*desk|\bkexp\b|\bawards?\b|\bstage\b|\ben\s+vivo\b"
)
LABEL = (
    r"records?|recordings|\bmusic\b|release|label|exclusive|\bep\b|\blp\b|album|single|\bfree\b|\bdl\b|download|premiere|out\s+now|"
    r"^\s*[A-Za-z]{2,}\s?-?\d{2,}\s*$|^\s*(?:hard\s+)?(?:techno|house|trance|dnb|drum\s*(?:&|and|n)\s*bass|dubstep|hardstyle|psytrance|edm|"
    r"electronic|minimal|progressive|bounce|hardcore|garage|breakbeat|trap|phonk)\s*$"
)
SEPARATOR = r"\s+[-–—]\s*|\s*[-–—]\s+|\s+:\s+"
TRAILING = (
    r"\s*[-|]?\s*\b(?:official\s+(?:music\s+)?(?:video|audio|visuali[sz]er|lyric\s+video|mv)|(?:official\s+)?lyric\s+video|music\s+video|official\s+mv|"
    r"official|premiere|m/v|mv)\s*$"
)
#: What goes before any group is looked at, in this order.
FIRST = (
    (r"#(?=[^\W\d])\w+", " "), (r"(?<=[\)\]])\s*#\d+\s*$", ""), (r"\.(?:mp3|wav|flac|m4a|aiff?|ogg)\s*$", ""), (r"^\s*premiere\s*[:\-|–]\s*", ""),
    (r"\bfree\s*d(?:ownload|l)\b|<3", " "), (r"^\s*[A-Da-d]?\d{1,2}\s*[.)]\s*(?=[^\d\s.])", ""),
)
#: Groups inside groups that are looked at.
DEPTH = 3
#: Names that are asked for, of several artists.
ASKED = 3

_I = "(?iU)"
#: Signs that a title doesn't begin or end with.
_EDGES = " -–—|"
#: Brackets of groups that stay, out of the way of the groups around them.
_OPEN, _SHUT = "\x02", "\x03"


_version, _noise, _label, _trailing = (re.compile(p, re.I) for p in (VERSION, NOISE, LABEL, TRAILING))
_first = [(re.compile(p, re.I), r) for p, r in FIRST]


def _group(m: re.Match) -> str:
    """What stays of a group that has none inside: versions as they are, noise and marks nothing, others make room for the group around them."""
    inside, before = m[1], m.string[: m.start()].rstrip()
    if _version.search(inside):
        return m[0]
    lone = len(inside.split()) == 1 and not re.search(r"\d", inside)
    mark = m[0][0] == "[" and (_label.search(inside) or before.endswith((")", "]", _SHUT)) or lone)
    return " " if mark or _noise.search(inside) else f"{_OPEN}{inside}{_SHUT}"


def clean(title: str | None) -> str:
    """A title in compatibility form (full-width brackets as plain ones) without what an upload adds to it; all else stays."""
    t = unicodedata.normalize("NFKC", title or "")
    for pattern, by in _first:
        t = pattern.sub(by, t)
    for _ in range(DEPTH):
        t = re.sub(r"[(\[]([^()\[\]]*)[)\]]", _group, t)
    t = t.replace(_OPEN, "(").replace(_SHUT, ")")
    t = " ".join(re.sub(r"\s*[(\[]\s*[)\]]", " ", t).split()).strip(_EDGES)
    for _ in range(2):
        t = _trailing.sub("", t).strip(_EDGES)
    return t


def _arrow(f):
    """A function of one text as an Arrow UDF."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(f, na_action=None)

    return lambda text: F.pandas_udf(run, "string")(text)


def compatible(text: Column) -> Column:
    """The compatibility form of a text; empty for null."""
    return _arrow(lambda x: unicodedata.normalize("NFKC", x or ""))(text)


def cleaned_title(title: Column) -> Column:
    """``clean`` of a column."""
    return _arrow(clean)(title)


def artist_text(artist: Column) -> Column:
    """An artist field without groups (other names of the same) and the channel's suffix."""
    plain = F.regexp_replace(artist, r"\s*[(\[][^)\]]*[)\]]", " ")
    return F.trim(F.regexp_replace(F.trim(plain), _I + CHANNEL, ""))


def artist_names(artist: Column) -> Column:
    """The names of an artist field, as they are written."""
    return F.filter(F.transform(F.split(artist_text(artist), _I + ARTIST_SEPARATOR), lambda n: F.trim(n)), lambda n: n != "")


def other_titles(title: Column) -> Column:
    """Both names of a title in another script with its Latin name in brackets; none otherwise."""
    outside, inside = (F.regexp_extract(title, r"^\s*([^()]+?)\s*\(([^()]+)\)\s*$", i) for i in (1, 2))
    two = ~outside.rlike("[A-Za-z]") & outside.rlike(r"\p{L}") & inside.rlike("[A-Za-z]")
    return F.when(two, F.array(outside, inside)).otherwise(F.array().cast("array<string>"))


def _same(a: Column, b: Column) -> Column:
    """Whether two sets of folded names share one, or are alike without spaces."""
    tight = lambda x: F.array_sort(F.transform(x, lambda n: F.replace(n, F.lit(" "), F.lit(""))))
    return (F.size(a) > 0) & (F.size(b) > 0) & (F.arrays_overlap(a, b) | (tight(a) == tight(b)))


def readings(rows: DataFrame, title: str = "title", uploader: str = "uploader") -> DataFrame:
    """Adds readings: array of struct(how, artist, title, other, event), the likeliest first; ``other`` is a second name of the title, ``event`` an occasion
    that makes it another recording.

    how: quoted (Artist 'Title'), bars (Artist | Title), sides (Artist - Title), turned (Title - Artist, by that artist),
    uploader (the title alone); and swapped, the other way round of two sides, if nothing says which is which. Null
    and empty titles have the uploader's reading of an empty title.
    """
    c, text = F.col, lambda x: F.coalesce(F.col(x).cast("string"), F.lit(""))
    at = lambda x, i: F.coalesce(F.get(x, F.lit(i)), F.lit(""))
    has = lambda x, pattern: x.rlike(_I + pattern)
    corner, quote = r"^([^「『]+?)\s*[「『]([^」』]+)[」』]\s*(.*)$", r"^([^'\"“‘]+?)\s+[\"“'‘]([^\"”'’]+)[\"”'’](\s.*)?$"
    step = rows.withColumns({"_t": cleaned_title(text(title)), "_up": compatible(text(uploader))})
    step = step.withColumn("_main", at(F.split("_t", r"\s+//\s+"), 0)).withColumn("_bars", F.split("_main", r"\s+\|{1,2}\s+"))
    first, second, rest = at(c("_bars"), 0), at(c("_bars"), 1), F.array_join(F.slice("_bars", 2, 99), " ")
    barred = F.size("_bars") >= 2
    step = step.withColumns({"_who": folded_names(name_parts(first)), "_mine": folded_names(name_parts(c("_up"))), "_second": folded(second)})
    mine = _same(c("_who"), c("_mine"))
    # A left side of nothing but noise: what is right of it is read.
    lead = barred & (F.size("_bars") == 2) & has(first, NOISE) & ~has(first, SEPARATOR) & ~mine & has(second, SEPARATOR) & ~has(second, EVENT)
    event = barred & ~lead & (has(rest, EVENT) | has(rest, STRONG_VERSION) | (has(rest, VERSION) & ~has(rest, NOISE)))
    by_bars = barred & ~lead & (c("_second") != "") & ((mine & ~has(rest, EVENT)) | (~event & ~has(first, SEPARATOR) & ~has(rest, NOISE) & (F.size("_bars") == 2)))
    step = step.withColumns({"_by_bars": by_bars, "_event": F.when(event & ~by_bars, rest), "_plain": F.when(lead, second).when(barred, first).otherwise(c("_main")), "_barred": barred & ~lead})
    sides = F.split("_plain", _I + SEPARATOR, 2)
    step = step.withColumns({"_left": at(sides, 0), "_right": at(sides, 1)})
    step = step.withColumns(
        {
            "_l": folded_names(name_parts(c("_left"))), "_r": folded_names(name_parts(c("_right"))), "_fl": folded(c("_left")), "_fr": folded(c("_right")),
            "_ft": folded(c("_plain")), "_fu": folded(artist_text(c("_up"))), "_q": folded(F.regexp_extract("_t", quote, 3)), "_k": folded(F.regexp_extract("_t", corner, 3)),
        }
    )
    two = (c("_fl") != "") & (c("_fr") != "")
    turned = two & _same(c("_r"), c("_mine")) & ~_same(c("_l"), c("_mine"))
    groups = F.array_join(F.regexp_extract_all("_right", F.lit(r"[(\[][^)\]]*[)\]]"), 0), " ")
    bare = F.trim(F.regexp_replace("_right", r"\s*[(\[][^)\]]*[)\]]", " "))
    nothing = F.lit(None).cast("string")

    def reading(how: str, artist: Column, name: Column, other: Column = nothing, occasion: Column = nothing) -> Column:
        return F.struct(F.lit(how).alias("how"), F.trim(artist).alias("artist"), F.trim(name).alias("title"), other.alias("other"), occasion.alias("event"))

    in_corners, in_quotes = c("_t").rlike(corner) & ~has(F.regexp_extract("_t", corner, 1), SEPARATOR), c("_t").rlike(quote) & ~has(F.regexp_extract("_t", quote, 1), SEPARATOR)
    latin = F.trim(F.regexp_extract("_t", corner, 3)).rlike(r"^[A-Za-z0-9 ,.'!?&-]+$")
    quoted = lambda p, other=nothing: reading("quoted", F.regexp_extract("_t", p, 1), F.regexp_extract("_t", p, 2), other)
    other_way = reading("swapped", bare, F.concat_ws(" ", "_left", F.nullif(groups, F.lit(""))), nothing, c("_event"))
    # Without sides the uploader is the artist; a title that begins with that name loses it.
    own = artist_text(c("_up"))
    begins = (c("_fu") != "") & F.startswith("_ft", F.concat("_fu", F.lit(" "))) & F.startswith(F.lower("_plain"), F.lower(own))
    alone = F.when(begins, F.trim(F.substring(c("_plain"), F.length(own) + 1, F.length("_plain")))).otherwise(c("_plain"))
    main = (
        F.when(in_corners & (c("_k") == ""), quoted(corner))
        .when(in_corners & latin, quoted(corner, F.trim(F.regexp_extract("_t", corner, 3))))
        .when(in_quotes & (c("_q") == ""), quoted(quote))
        .when(c("_by_bars"), reading("bars", first, second))
        .when(turned, other_way.withField("how", F.lit("turned")))
        .when(two, reading("sides", c("_left"), c("_right"), nothing, c("_event")))
        .otherwise(reading("uploader", c("_up"), alone, nothing, c("_event")))
    )
    unclear = two & ~turned & ~c("_barred") & ~c("_t").rlike("[「『\"“]")
    out = F.when(unclear, F.array(main, other_way)).otherwise(F.array(main))
    return step.withColumn("readings", out).select(*(F.col(f"`{x}`") for x in rows.columns), "readings")


def name_parts(artist: Column) -> Column:
    """``artist_names`` as the argument of an Arrow UDF, which may hold no lambda of its own: empty names fold to nothing."""
    return F.split(artist_text(artist), _I + ARTIST_SEPARATOR)


def search_texts(artist: Column, title: Column, version: Column, others: Column) -> Column:
    """What to ask a catalogue for, the strictest first, each once: each artist with the title in fields, the whole field with the title, and with the
    version, other titles, each artist and the title. Nothing without an artist or a title, as a title alone finds anything."""
    names = F.slice(artist_names(artist), 1, ASKED)
    field = lambda a, t: F.concat(F.lit('artist:"'), a, F.lit('" track:"'), t, F.lit('"'))
    whole = F.concat(artist_text(artist), F.lit(" "), title)
    every = F.concat(
        F.transform(names, lambda a: field(a, title)),
        F.array(whole),
        F.when(F.coalesce(version, F.lit("")) != "", F.array(F.concat(whole, F.lit(" "), version))).otherwise(F.array().cast("array<string>")),
        F.transform(F.array_sort(others), lambda t: field(F.get(names, F.lit(0)), t)),
        F.transform(names, lambda a: F.concat(a, F.lit(" "), title)),
    )
    known = (F.size(names) > 0) & (F.coalesce(title, F.lit("")) != "")
    return F.when(known, F.array_distinct(F.transform(every, squeezed))).otherwise(F.array().cast("array<string>"))
