"""Lists from elsewhere: records read, joined and put in an order for mixing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.functions.scoring import SetConfig
from cadenza.operators.library import SHORTEST
from cadenza.operators.setbuilder import Shelf, one_set, tempo_scores

#: Tasks that lists are dealt over: they are few bytes, but much work.
TASKS = 96
RECORD = "kind string, id string, title string, `user` struct<username:string>, policy string, streamable boolean, full_duration double, duration double, permalink_url string, media struct<transcodings:array<struct<snipped:boolean,format:struct<protocol:string>>>>"


def tracks(records: DataFrame, record: str = "record") -> DataFrame:
    """Other columns, track_id, title, artist, duration, url, playable, preview from JSON records; unusable ones go.

    A record is usable if its kind is track, or none, its id a whole number and its title not blank.
    It is playable if its policy doesn't block it, it can be streamed, and one of its streams is a plain
    download; only a preview if policy or a stream says that it is cut. A length of 0 isn't known.
    """
    r = F.col("r")
    rest = [c for c in records.columns if c != record]
    read = records.select(*rest, F.from_json(F.col(record), RECORD).alias("r"))
    streams = F.coalesce(r.media.transcodings, F.array().cast("array<struct<snipped:boolean,format:struct<protocol:string>>>"))
    known = lambda ms: F.when(ms > 0, F.round(ms / 1000, 1))
    kept = read.where((F.coalesce(r.kind, F.lit("track")) == "track") & r.id.rlike(r"^[0-9]{1,20}$") & (F.trim(r.title) != ""))
    return kept.select(
        *rest, r.id.alias("track_id"), F.trim(r.title).alias("title"), F.trim(F.coalesce(r["user"].username, F.lit(""))).alias("artist"), F.coalesce(known(r.full_duration), known(r.duration)).alias("duration"),
        r.permalink_url.alias("url"),
        (F.coalesce(r.policy != "BLOCK", F.lit(True)) & F.coalesce(r.streamable, F.lit(True)) & F.exists(streams, lambda s: F.coalesce(s.format.protocol == "progressive", F.lit(False)))).alias("playable"),
        (F.coalesce(r.policy == "SNIP", F.lit(False)) | F.exists(streams, lambda s: F.coalesce(s.snipped, F.lit(False)))).alias("preview"),
    )


def others(rows: DataFrame, station: str, track: str, place: str, seed: str) -> DataFrame:
    """A station's rows without its seed and without repeats, the first one stays, numbered again in order; of one place the smaller track is first."""
    first = rows.where(F.col(track) != F.col(seed)).withColumn("nth", F.row_number().over(W.partitionBy(station, track).orderBy(place))).where("nth = 1").drop("nth")
    return first.withColumn(place, F.row_number().over(W.partitionBy(station).orderBy(place, track)))


def pooled(*pools: DataFrame, key: str = "track_id") -> DataFrame:
    """The union of candidate pools, each candidate once, from the first pool that has it."""
    numbered = [p.withColumn("pool", F.lit(i)) for i, p in enumerate(pools)]
    every = numbered[0]
    for p in numbered[1:]:
        every = every.unionByName(p)
    return every.withColumn("nth", F.row_number().over(W.partitionBy(key).orderBy("pool"))).where("nth = 1").drop("nth", "pool")


def labelled(a: DataFrame, b: DataFrame, names: tuple[str, str]) -> DataFrame:
    """path, sources: in which of two collections a path, whatever its case, stands."""
    sides = [d.select(F.lower("path").alias("path")).distinct().withColumn(n, F.lit(name)) for d, n, name in ((a, "one", names[0]), (b, "two", names[1]))]
    return sides[0].join(sides[1], "path", "full").select("path", F.concat_ws(" and ", "one", "two").alias("sources"))


def mixing_order(items: DataFrame, station: str = "station") -> DataFrame:
    """station, place, track_id, part, reason: each station's items in an order for mixing.

    ``items`` has station, position, track_id, bpm, key, energy, artist, duration, timbre; bpm and
    timbre are null where an item wasn't analysed. The set that is built from the first analysed item (flat
    curve, no artist gap, all weight on timbre) comes first; then analysed items that it left, with
    what kept them out; then the others. A list is a page of a service, so one fits in a task.
    """

    def order(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["position", "track_id"], kind="stable").drop_duplicates("track_id")
        known = rows[rows["bpm"].notna() & rows["timbre"].notna()].copy()
        out: list[tuple] = []
        if len(known):
            known["path"], known["track"] = known["track_id"], known["duration"].fillna(0) >= SHORTEST
            x = np.stack(known["timbre"].to_numpy()).astype(float)
            x = x - x.mean(0)
            known["timbre"] = list(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12))
            shelf = Shelf(known)
            steps = [r[2] for r in one_set(shelf, shelf.place[known["track_id"].iloc[0]], SetConfig(length=len(known), curve="flat", artist_gap=0, w_energy=0.0))]
            out += [(t, "set", "") for t in steps]
            own = known.set_index("track_id")
            tempos = own.loc[steps, "bpm"].to_numpy(float)
            for t, r in own[~own.index.isin(steps)].iterrows():
                near = (tempo_scores(float(r["bpm"]), tempos) > 0).any()
                out.append((t, "left", "fragment" if not r["track"] else "cut-off" if near else "out-of-range"))
        out += [(t, "unanalysed", "not-analysed") for t in rows.loc[~rows["track_id"].isin(known["track_id"]), "track_id"]]
        return pd.DataFrame([(rows[station].iloc[0], i, *x) for i, x in enumerate(out)], columns=[station, "place", "track_id", "part", "reason"])

    kind, of = (dict(items.dtypes)[c] for c in (station, "track_id"))
    return items.repartition(TASKS, station).groupBy(station).applyInPandas(order, f"{station} {kind}, place int, track_id {of}, part string, reason string")


def left_out(row_bpm: Column, tempos: Column, duration: Column, passes) -> Column:
    """Why an analysed item isn't in a set: fragment, out-of-range of all of its tempos, or cut-off."""
    return F.when(F.coalesce(duration, F.lit(0.0)) < SHORTEST, "fragment").when(F.exists(tempos, lambda t: passes(t, row_bpm)), "cut-off").otherwise("out-of-range")
