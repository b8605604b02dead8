"""Small rules on single values: units, percentages, colours, file addresses, lines of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Colours of hot cues by pad, A to H, and of loops; fixed values. A memory mark is written without one.
PAD_COLOURS = ("#ff4d5a", "#34d17c", "#4fa3ff", "#ffd23f", "#b48cff", "#2fd4cf", "#ff7ab8", "#f2f3f8")
LOOP_COLOUR = "#ff9a2e"
#: Types of marks in a collection, from 0; fixed values.
MARK_TYPES = ("cue", "fade-in", "fade-out", "load", "loop")
DAY = 86_400


def known(x: Column) -> Column:
    """The number itself; null for NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def milliseconds(seconds: Column) -> Column:
    """Whole milliseconds of 0 to a day, half to even; null outside of it."""
    return F.when(known(seconds).between(0, DAY), F.bround(seconds * 1000).cast("long"))


def seconds_shown(ms: Column) -> Column:
    """Seconds with one decimal of positive milliseconds; null else."""
    return F.when(known(ms.cast("double")) > 0, F.round(ms / 1000, 1))


def percent_shown(share: Column) -> Column:
    """A share of 1 as whole percent, half to even."""
    return F.bround(share * 100).cast("int")


def mark_colour(kind: Column, num: Column) -> Column:
    """The colour of a loop, or of a cue by its pad (0 to 7); null for memory marks and for what isn't a mark."""
    pad = F.when(num.between(0, len(PAD_COLOURS) - 1), F.get(F.array(*map(F.lit, PAD_COLOURS)), num))
    return F.when(kind == "loop", LOOP_COLOUR).when(kind == "cue", pad)


def mark_class(kind: Column, num: Column) -> Column:
    """What a collection's mark is, from its type and number as text: "memory cue", "hot loop G", ..."""
    name = F.coalesce(F.get(F.array(*map(F.lit, MARK_TYPES)), kind.try_cast("int")), F.concat(F.lit("Type "), kind))
    pad = F.when(num.rlike(r"^\d+$"), num.try_cast("int"))
    letter = F.when(pad < len(PAD_COLOURS), F.char(F.lit(65) + pad))
    return F.when(num == "-1", F.concat(F.lit("memory "), name)).when(letter.isNotNull(), F.concat(F.lit("hot "), name, F.lit(" "), letter)).otherwise(F.concat(name, F.lit(" (Num "), num, F.lit(")")))


def title_alone(title: Column, artist: Column) -> Column:
    """A title without exactly "artist - " before it, if anything is left."""
    head = F.concat(artist, F.lit(" - "))
    rest = F.trim(F.substr(title, F.length(head) + 1))
    return F.when((artist != "") & F.startswith(title, head) & (rest != ""), rest).otherwise(title)


def local_path(address: Column) -> Column:
    """The path of a ``file://`` address: escapes decoded, plus signs kept, no slash before a drive letter."""
    path = F.url_decode(F.replace(F.regexp_replace(address, r"^file://(localhost)?", ""), F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(path, r"^/(?=[A-Za-z]:)", "")


def relative_path(text: Column) -> Column:
    """A path below a root as parts joined by slashes; null if it is absolute, climbs, or holds a drive or NUL."""
    plain = F.replace(text, F.lit("\\"), F.lit("/"))
    bad = plain.rlike(r"^/|^[A-Za-z]:|\x00|(^|/)\.\.(/|$)")
    return F.when(~bad, F.array_join(F.filter(F.split(plain, "/"), lambda p: ~p.isin("", ".")), "/"))


def curve_of(config: Column) -> Column:
    """The curve that a set's stored settings (JSON) name; null if they can't be read."""
    return F.try_variant_get(F.try_parse_json(config), "$.curve", "string")


def tempo_attributes(bpm: Column, first_beat: Column, downbeat: Column) -> Column:
    """A TEMPO element's attributes: only if there is a grid (``first_beat``) and its first bar's begin (``downbeat``, seconds) is known."""
    sure = (known(bpm) > 0) & (known(downbeat) >= 0) & first_beat.isNotNull()
    return F.when(sure, F.format_string('Inizio="%.3f" Bpm="%.2f" Metro="4/4" Battito="1"', downbeat, bpm))


def step_line(position: Column, bpm: Column, key: Column, energy: Column, label: Column) -> Column:
    """A saved step as one line of fixed columns."""
    return F.concat(F.lpad(position.cast("string"), 3, " "), F.lit("  "), F.lpad(F.format_string("%.1f", bpm), 6, " "), F.lit("  "), F.rpad(key, 3, " "), F.lit("  "), F.lpad(percent_shown(energy).cast("string"), 3, " "), F.lit("%  "), label)


def safe_file_name(text: Column, longest: int = 120) -> Column:
    """A name without signs that a system forbids, without dots or spaces at its end; "unnamed" if nothing is left."""
    plain = F.regexp_replace(F.regexp_replace(text, r'[<>:"/\\|?*\x00-\x1f]', "_"), r"\s+", " ")
    return F.coalesce(F.nullif(F.regexp_replace(F.substring(F.trim(plain), 1, longest), r"[. ]+$", ""), F.lit("")), F.lit("unnamed"))
