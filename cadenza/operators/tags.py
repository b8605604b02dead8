"""Tags of files: fields out of raw keys, what is junk in them, who wrote them, and a report on all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.text import stem

#: The raw keys of each field; fixed values.
ALIASES = {
    "artist": ("TPE1", "ARTIST", "©ART"),
    "title": ("TIT2", "TITLE", "©nam"),
    "genre": ("TCON", "GENRE", "©gen"),
    "bpm": ("TBPM", "BPM", "TMPO", "TEMPO"),
    "key": ("TKEY", "INITIALKEY", "KEY", "INITIAL KEY"),
    "comment": ("COMM", "COMMENT", "©cmt", "DESCRIPTION"),
}
#: Leftovers of where a file came from; fixed patterns.
JUNK = (
    ("download site (named in the text)", r"(?i)myfreemp3"),
    ("download site", r"(?i)\bmp3teca|mp3xd|descargar\b"),
    ("official video", r"(?i)\b(official|oficial)\s+(music\s+)?(video|audio)\b"),
    ("free download", r"(?i)\bfree\s*download\b"),
    ("no copyright", r"(?i)\bno\s*copyright\b"),
    ("lyrics", r"(?i)\b(lyrics?|letra)\b"),
    ("address", r"(?i)https?://|www\.|\.(com|net|vip|org)\b"),
    ("quality label", r"(?i)\[\s*(hd|hq|4k|320\s*kbps?)\s*\]"),
    ("said twice", r"(?i)\bextended\s+mix\b.*\bextended\s+mix\b"),
)
#: And what only names of files have; fixed patterns.
NAME_JUNK = (("cut", r"(?i)\(\s*cut\s*\)"), ("copy number", r"\s\(\d+\)\s*$"), ("technical data", r"(?i)\b\d{2,3}k?\d{0,2}b?\b.*\b(master|mix)\b"))
#: Signatures of tools, in raw keys and comments; fixed patterns.
SERATO, MIXED = r"(?i)^(GEOB:Serato|TXXX:SERATO_)", r"(?i)^(TXXX:EnergyLevel|GEOB:(Key|Energy|BeatGrid)$)"
MIXED_COMMENT = r"(?i)^\s*\d{1,2}[AB]\s*-\s*Energy\s*\d+\s*$"
WHEEL_KEY, CLASSIC_KEY = r"(?i)^\s*\d{1,2}\s*[AB]\s*$", r"(?i)^\s*[A-G][#b]?\s*(m|min|maj|major|minor)?\s*$"
ARTIST_TITLE = r"^\s*(.{2,60}?)\s+[-–—]\s+(.{2,})$"
FIELDS = tuple(ALIASES)


def field(raw: Column, name: str) -> Column:
    """The first value that isn't blank among a file's raw tags (a map, in order) whose key, or whose key's first or last part, is the field's."""

    def known(k: Column) -> Column:
        upper = F.upper(k)
        return k.isin(*ALIASES[name]) | F.element_at(F.split(upper, ":"), 1).isin(*ALIASES[name]) | F.element_at(F.split(upper, ":"), -1).isin(*ALIASES[name])

    found = F.filter(F.map_entries(raw), lambda e: known(e["key"]) & (F.coalesce(F.trim(e["value"]), F.lit("")) != ""))
    return F.coalesce(F.trim(F.get(found, 0)["value"]), F.lit(""))


def reasons(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The names of the rules that a text matches, in their order."""
    return F.filter(F.array(*(F.when(text.rlike(p), F.lit(n)) for n, p in rules)), lambda x: x.isNotNull())


def split_artist(title: Column, artist: Column) -> Column:
    """artist, title out of "artist - title": only if there is no artist, or it is the same; else null."""
    left, right = F.trim(F.regexp_extract(title, ARTIST_TITLE, 1)), F.trim(F.regexp_extract(title, ARTIST_TITLE, 2))
    fits = title.rlike(ARTIST_TITLE) & ((F.trim(artist) == "") | (F.lower(F.trim(artist)) == F.lower(left)))
    return F.when(fits, F.struct(left.alias("artist"), right.alias("title")))


def tools(raw: Column, comment: Column, own: str) -> Column:
    """Which tools left a signature: own, serato, mixed."""
    keys = F.map_keys(raw)
    signs = {"own": F.startswith(F.lower(comment), F.lit(own)), "serato": F.exists(keys, lambda k: k.rlike(SERATO)), "mixed": F.exists(keys, lambda k: k.rlike(MIXED)) | comment.rlike(MIXED_COMMENT)}
    return F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in signs.items())), lambda x: x.isNotNull())


def key_origin(key: Column, found: Column) -> Column:
    """Who wrote a key: own, mixed, serato, external, unknown or none. A wheel key alone proves nothing."""
    wheel = F.when(F.array_contains(found, "mixed"), "mixed").when(F.array_contains(found, "serato"), "serato").otherwise("unknown")
    return F.when(key == "", "none").when(F.array_contains(found, "own"), "own").when(key.rlike(WHEEL_KEY), wheel).when(key.rlike(CLASSIC_KEY), "external").otherwise("unknown")


def plain_origin(value: Column, found: Column) -> Column:
    """Who wrote a field whose form tells nothing."""
    return F.when(value == "", "none").when(F.array_contains(found, "own"), "own").otherwise("unknown")


def diagnosed(files: DataFrame, own: str = "cadenza") -> DataFrame:
    """Files (path, raw: map of strings) with their fields, suggested names, junk and origins. Null maps have no tags."""
    raw = F.coalesce("raw", F.create_map().cast("map<string,string>"))
    rows = files.select("path", raw.alias("raw"), *(field(raw, f).alias(f) for f in FIELDS), F.size(raw).alias("n_tags"))
    rows = rows.withColumn("tools", tools(F.col("raw"), F.col("comment"), own))
    named = F.coalesce(F.nullif("title", F.lit("")), stem(F.col("path")))
    said = {f: reasons(F.col(f), JUNK) for f in ("artist", "title", "genre", "comment")}
    touched = F.filter(F.array(*(F.when(F.size(r) > 0, F.lit(f)) for f, r in said.items())), lambda x: x.isNotNull())
    comment_origin = F.when((F.col("comment") != "") & ~F.array_contains("tools", "own") & F.array_contains("tools", "mixed"), "mixed").otherwise(plain_origin(F.col("comment"), F.col("tools")))
    return rows.select(
        "path", *FIELDS, "n_tags", "tools", split_artist(named, F.col("artist")).alias("suggested"),
        F.array_distinct(F.flatten(F.array(*said.values()))).alias("junk"), touched.alias("junk_fields"), reasons(stem(F.col("path")), JUNK + NAME_JUNK).alias("name_junk"),
        key_origin(F.col("key"), F.col("tools")).alias("key_origin"), plain_origin(F.col("bpm"), F.col("tools")).alias("bpm_origin"), comment_origin.alias("comment_origin"),
    )


def audit(rows: DataFrame) -> DataFrame:
    """name, n, percent of all: files that lack a field, that hold junk, and whose key comes from whom. One pass."""
    missing = {f"no {f}": F.col(f) == "" for f in ("artist", "title", "genre", "bpm", "key")}
    junk = {"junk in tags": F.size("junk") > 0, "junk in name": F.size("name_junk") > 0, "artist in title": F.col("suggested").isNotNull()}
    origin = {f"key {o}": F.col("key_origin") == o for o in ("own", "mixed", "serato", "external", "unknown", "none")}
    every = missing | junk | origin
    counts = rows.agg(F.count(F.lit(1)).alias("all"), *(F.count_if(c).alias(n) for n, c in every.items()))
    each = counts.select("all", F.inline(F.array(*(F.struct(F.lit(n).alias("name"), F.col(f"`{n}`").alias("n")) for n in every))))
    return each.select("name", "n", F.try_divide(100.0 * F.col("n"), F.col("all")).alias("percent"))


def write_plan(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, field, action, value: what writing ``after``'s fields onto ``before``'s does. Nothing is written.

    omit: nothing known on either side; empty: a container's value goes as it is junk (after has an
    empty text); preserve: unknown (null) or equal; write: else.
    """
    fields = lambda df, n: df.select("path", F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias(n)) for f in FIELDS))))
    met = fields(before, "old").join(fields(after, "new"), ["path", "field"])
    old = F.coalesce("old", F.lit(""))
    action = F.when((old == "") & (F.coalesce("new", F.lit("")) == ""), "omit").when(F.col("new").isNull() | (F.col("new") == old), "preserve").when(F.col("new") == "", "empty").otherwise("write")
    return met.select("path", "field", action.alias("action"), F.when(action == "write", F.col("new")).when(action == "preserve", old).alias("value"))
