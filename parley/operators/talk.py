"""Who spoke: tallies, speaker identities and search within transcripts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from parley.functions import strings

MIN_QUERY = 2


def talk_time(rows: DataFrame, keys: list[str], secs: Column) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum(secs).alias("secs"))


def with_share(tallied: DataFrame, key: str = "meeting_id") -> DataFrame:
    """Share of the meeting's total, 0 where the total is 0."""
    total = tallied.groupBy(key).agg(F.sum("secs").alias("_total"))
    return tallied.join(total, key).withColumn("share", F.coalesce(F.try_divide("secs", "_total"), F.lit(0.0))).drop("_total")


def tally_speakers(segments: DataFrame, secs: Column, key: str = "meeting_id", speaker: str = "speaker_key", order: str = "seg_idx") -> DataFrame:
    """key, speaker, secs, share, place: most talk first, the first to speak on ties."""
    found = segments.groupBy(key, speaker).agg(F.sum(secs).alias("secs"), F.min(order).alias("_first"))
    place = W.partitionBy(key).orderBy(F.col("secs").desc(), "_first")
    return with_share(found.withColumn("place", (F.row_number().over(place) - 1).cast("int")).drop("_first"), key)


def first_appearance(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Distinct values of each key numbered by where they first occur."""
    seen = rows.groupBy(key, value).agg(F.min(order).alias("first"))
    return seen.withColumn("place", (F.row_number().over(W.partitionBy(key).orderBy("first")) - 1).cast("int"))


def assign_identities(segments: DataFrame, people: DataFrame, key: str = "meeting_id") -> DataFrame:
    """One row for each speaker of a meeting in order of appearance: speaker_key, label, anonymous, color_slot.

    Named speakers use no placeholder name; the unattributed use neither a name nor a colour.
    """
    keyed = segments.withColumn("speaker_key", strings.speaker_key(F.col("person_id"), F.col("speaker_number")))
    seen = first_appearance(keyed, key, "speaker_key", "seg_idx")
    of = keyed.groupBy(key, "speaker_key").agg(F.max("person_id").alias("person_id"))
    named = seen.join(of, [key, "speaker_key"]).join(people.select(F.col("id").alias("person_id"), F.nullif("name", F.lit("")).alias("name")), "person_id", "left")
    upto = W.partitionBy(key).orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    real = F.col("speaker_key") != "unattributed"
    nameless = real & F.col("name").isNull()
    before = lambda c: F.coalesce(F.sum(c.cast("int")).over(upto), F.lit(0))
    out = named.withColumn("_anon", before(nameless)).withColumn("_color", before(real))
    label = F.when(~real, "Unattributed").otherwise(F.coalesce("name", strings.anonymous_name(F.col("_anon"))))
    return out.select(key, "place", "speaker_key", "person_id", label.alias("label"), nameless.alias("anonymous"), F.when(real, strings.color_slot(F.col("_color"))).alias("color_slot"))


def find_matches(segments: DataFrame, query: str, keys: list[str]) -> DataFrame:
    """keys, at, from, to of every case-insensitive hit in a segment's words (hits may overlap; word places inclusive).

    A segment's text is searched once from hit to hit, and the hits' offsets
    are looked up in the running sum of its words' lengths, so the work is linear in both.
    """
    q = query.strip().lower()
    text = F.concat_ws("", F.transform("words", lambda w: F.concat(F.lower(w["text"]), F.lit(" "))))
    sizes = F.transform("words", lambda w: F.coalesce(F.length(w["text"]), F.lit(0)) + 1)
    given = segments.select(*keys, text.alias("_text"), sizes.alias("_sizes"))
    kinds = ", ".join(f"`{k}` {dict(given.dtypes)[k]}" for k in keys)
    if len(q) < MIN_QUERY:
        return given.select(*keys, *[F.lit(0).alias(c) for c in ("at", "from", "to")]).limit(0)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], [[], [], []]
            for row, one in enumerate(batch.column(len(keys)).to_pylist()):
                at, hits = one.find(q), []
                while at >= 0:
                    hits.append(at)
                    at = one.find(q, at + 1)
                starts = np.cumsum(batch.column(len(keys) + 1)[row].values.to_numpy())  # where the next word begins
                places = np.array(hits, dtype=np.int32)
                rows += [row] * len(hits)
                for out, offsets in zip(found, (None, places, places + len(q) - 1), strict=True):
                    out.append(places if offsets is None else np.searchsorted(starts, offsets, side="right"))
            if rows:
                kept = [c.take(pa.array(rows)) for c in batch.columns[: len(keys)]]
                yield pa.RecordBatch.from_arrays([*kept, *[pa.array(np.concatenate(out).astype(np.int32)) for out in found]], [*keys, "at", "from", "to"])

    return given.filter(F.col("_text").contains(q)).mapInArrow(search, f"{kinds}, at int, `from` int, `to` int")


def hits_per_segment(matches: DataFrame, keys: list[str]) -> DataFrame:
    """The hits of each segment as one ordered list."""
    return matches.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "from", "to"))).alias("hits"))
