"""Chat formatting by schema fingerprints. DataFrame functions only.

Chat data comes in many layouts. A layout is known by its fingerprint, a hash of its nested field
paths; each known fingerprint selects a declarative mapping to canonical turns (conv_id, turn,
role, text). A table with a row for each turn is one layout among these. ``turns`` converts a table by the fingerprint of its schema, ``json_turns`` a column
of JSON records, each by its own fingerprint. ``formatted`` renders turns by a template that marks
each turn and escapes control strings reversibly, with the character spans of the loss mask;
``read_back`` parses the text again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The template: <turn role>text</turn> and a line feed.
OPEN, OPENED, CLOSE = "<turn ", ">", "</turn>\n"
#: Strings that may not stand in a text, and what stands for them; & first, so that it reverses.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"))
#: Other names of roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
TURN = "array<struct<turn:bigint,role:string,text:string>>"


def paths(kind: T.DataType, at: str = "") -> list[str]:
    """The nested field paths of a type, arrays as []."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return paths(kind.elementType, f"{at}[]")
    return [at]


def fingerprint(found: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(set(found))).encode()).hexdigest()[:16]


def _pair(*columns: tuple[str, str]) -> Callable[[Callable[[str], Column]], Column]:
    """Turns from fields of one record, in this order; those that are null are left out."""

    def made(get: Callable[[str], Column]) -> Column:
        each = [F.struct(F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), get(c).cast("string").alias("text")) for i, (c, role) in enumerate(columns)]
        return F.filter(F.array(*each), lambda x: x.text.isNotNull())

    return made


def _instruction(get: Callable[[str], Column]) -> Column:
    asked = F.when(F.coalesce(get("input"), F.lit("")) == "", get("instruction")).otherwise(F.concat_ws("\n\n", get("instruction"), get("input")))
    return F.array(
        F.struct(F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), asked.alias("text")),
        F.struct(F.lit(1).cast("long").alias("turn"), F.lit("assistant").alias("role"), get("output").alias("text")),
    )


def _messages(array: str, role: str, text: str) -> Callable[[Callable[[str], Column]], Column]:
    return lambda get: F.transform(get(array), lambda x, i: F.struct(i.cast("long").alias("turn"), canonical(x[role]).alias("role"), x[text].alias("text")))


def canonical(role: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, F.lower(role)), role)


def _row(get: Callable[[str], Column]) -> Column:
    """A record that is one turn. Its role stays as it is."""
    return F.array(F.struct(get("turn").cast("long").alias("turn"), get("role").alias("role"), get("text").alias("text")))


#: Field paths of a record -> its turns. ``get`` gives a field's column.
LAYOUTS: dict[tuple[str, ...], Callable[[Callable[[str], Column]], Column]] = {
    ("role", "text", "turn"): _row,
    ("prompt", "response"): _pair(("prompt", "user"), ("response", "assistant")),
    ("prompt", "completion"): _pair(("prompt", "user"), ("completion", "assistant")),
    ("question", "answer"): _pair(("question", "user"), ("answer", "assistant")),
    ("system", "prompt", "response"): _pair(("system", "system"), ("prompt", "user"), ("response", "assistant")),
    ("instruction", "output"): _pair(("instruction", "user"), ("output", "assistant")),
    ("input", "instruction", "output"): _instruction,
    ("messages[].content", "messages[].role"): _messages("messages", "role", "content"),
    ("conversations[].from", "conversations[].value"): _messages("conversations", "from", "value"),
    ("turns[].role", "turns[].text"): _messages("turns", "role", "text"),
}
#: Fingerprint -> paths and mapping.
MAPPINGS = {fingerprint(list(k)): (k, f) for k, f in LAYOUTS.items()}
#: The paths that any layout has; others don't count.
KNOWN = sorted({p for k in LAYOUTS for p in k})
#: Layouts from most paths to fewest: for records whose known paths are no layout's, but contain one.
LARGEST = sorted(LAYOUTS, key=lambda k: (-len(k), k))
#: The types in which JSON records of a layout are read.
JSON_TYPES = {
    "messages": "array<struct<role:string,content:string>>",
    "conversations": "array<struct<`from`:string,value:string>>",
    "turns": "array<struct<role:string,text:string>>",
}


def turns(df: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """conv_id, turn, role, text from a table, by the mapping that its schema's fingerprint selects.

    The fingerprint is that of the paths, without ``conv_id``, that any layout knows; other columns and
    fields are ignored, whatever their names. If no layout has exactly these, the largest one that they
    contain is taken. Raises ValueError if there is none.
    """
    found = [p for p in paths(df.schema) if p != conv_id and p in KNOWN]
    chosen = MAPPINGS.get(fingerprint(found)) or next(((k, LAYOUTS[k]) for k in LARGEST if set(k) <= set(found)), None)
    if chosen is None:
        raise ValueError(f"no mapping for the field paths {sorted(paths(df.schema))}")
    made = df.select(F.col(conv_id).alias("conv_id"), chosen[1](lambda c: F.col(c)).cast(TURN).alias("t"))
    return made.select("conv_id", F.inline("t"))


def _json_paths(raw: Column) -> Column:
    """The field paths of a JSON record: its keys and, for arrays of objects, the keys of all their objects."""
    none = F.array().cast("array<string>")
    keys = F.coalesce(F.json_object_keys(raw), none)
    each = [
        F.when(F.array_contains(keys, k), F.flatten(F.transform(F.coalesce(F.from_json(F.get_json_object(raw, f"$.{k}"), "array<string>"), none), lambda x: F.coalesce(F.json_object_keys(x), none)))).otherwise(none)
        for k in sorted(JSON_TYPES)
    ]

    def prefixed(k: str, names: Column) -> Column:
        return F.transform(names, lambda x: F.concat(F.lit(f"{k}[]."), x))

    nested = [prefixed(k, x) for k, x in zip(sorted(JSON_TYPES), each, strict=True)]
    return F.array_sort(F.array_distinct(F.concat(F.filter(keys, lambda x: ~x.isin(*JSON_TYPES)), *nested)))


def _digest(found: Column) -> Column:
    return F.substring(F.sha2(F.array_join(found, "\n"), 256), 1, 16)


def json_layouts(df: DataFrame, record: str = "record", conv_id: str = "conv_id") -> DataFrame:
    """conv_id, record, fingerprint (of all its paths), layout: one row for each JSON record.

    ``layout`` is the fingerprint of the mapping that it selects, as ``turns`` does for tables; null if
    there is none or the record isn't a JSON object, so that such records can be counted.
    """
    read = df.select(F.col(conv_id).alias("conv_id"), F.col(record).alias("record"), _json_paths(F.col(record)).alias("found"))
    read = read.withColumn("known", F.array_intersect("found", F.array(*map(F.lit, KNOWN))))
    layout = F.when(_digest(F.col("known")).isin(*MAPPINGS), _digest(F.col("known")))
    for k in LARGEST:
        layout = F.coalesce(layout, F.when(F.size(F.array_except(F.array(*map(F.lit, k)), "known")) == 0, F.lit(fingerprint(list(k)))))
    return read.select("conv_id", "record", _digest(F.col("found")).alias("fingerprint"), layout.alias("layout"))


def json_turns(df: DataFrame, record: str = "record", conv_id: str = "conv_id") -> DataFrame:
    """conv_id, fingerprint, turn, role, text from JSON records, each by its own fingerprint.

    Records without a mapping give no rows; ``json_layouts`` counts them.
    """
    names = sorted({p for k in LAYOUTS for p in k if "[]" not in p})
    schema = ", ".join([*(f"`{n}` string" for n in names), *(f"`{k}` {v}" for k, v in JSON_TYPES.items())])
    read = json_layouts(df, record, conv_id).where("layout IS NOT NULL").select("conv_id", "fingerprint", "layout", F.from_json("record", schema).alias("r"))
    made = F.lit(None).cast(TURN)
    for k, (_, f) in MAPPINGS.items():
        made = F.when(F.col("layout") == k, f(lambda c: F.col(f"r.{c}")).cast(TURN)).otherwise(made)
    return read.select("conv_id", "fingerprint", F.inline(made))


def escaped(text: Column) -> Column:
    for raw, safe in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescaped(text: Column) -> Column:
    for raw, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def formatted(turn_rows: DataFrame) -> DataFrame:
    """conv_id, formatted, loss (array of start and end, in code points, of assistant texts).

    Turns stand in order of turn, role and rendered text, nulls first, so ties have one result;
    rows that are all alike stay, one turn each. Null roles and texts are empty. A null conv_id is one
    conversation. Each turn is rendered before the rows of a conversation meet; the text of one
    conversation is one value, so it must fit in a task.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    shown = F.concat(F.lit(OPEN), escaped(role), F.lit(OPENED), escaped(text), F.lit(CLOSE))
    each = turn_rows.select("conv_id", F.struct("turn", role.alias("role"), shown.alias("shown")).alias("t"))
    met = each.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    made = met.select("conv_id", F.array_join(F.col("t.shown"), "").alias("formatted"), F.transform("t", lambda x: F.struct(x.role.alias("role"), F.length(x.shown).cast("long").alias("n"), F.length(escaped(x.role)).alias("r"))).alias("t"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        first, end = acc.at + len(OPEN) + x.r + len(OPENED), acc.at + x.n - len(CLOSE)
        span = F.array(F.struct(first.cast("long").alias("start"), end.cast("long").alias("end")))
        return F.struct((acc.at + x.n).alias("at"), F.when(x.role == "assistant", F.concat(acc.spans, span)).otherwise(acc.spans).alias("spans"))

    return made.select("conv_id", "formatted", F.aggregate("t", start, step, lambda acc: acc.spans).alias("loss"))


def read_back(rows: DataFrame) -> DataFrame:
    """``formatted``'s rows with turns (array of role and text) and loss_text, both parsed from the text."""
    parts = F.filter(F.split(F.col("formatted"), CLOSE), lambda x: x != "")
    cut = F.transform(parts, lambda x: F.split(F.substring(x, len(OPEN) + 1, 2**31 - 1), OPENED, 2))
    parsed = F.transform(cut, lambda x: F.struct(unescaped(x[0]).alias("role"), unescaped(x[1]).alias("text")))
    under = F.transform("loss", lambda x: unescaped(F.substring(F.col("formatted"), (x.start + 1).cast("int"), (x.end - x.start).cast("int"))))
    return rows.withColumns({"turns": parsed, "loss_text": F.array_join(under, "")})
