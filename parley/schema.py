"""Table schemas, derived columns and constraint checks.

Rows of a Spark table have no order, so every ordered table carries an ordinal.
Derived columns are made in one place and recomputed on every write.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = "struct<text:string,start:double,end:double>"
WORDS = f"array<{WORD}>"
TABLES = {
    "jurisdictions": "id int, name string, name_short string, state string, postcode string, created_at timestamp_ntz",
    "bodies": "id int, jurisdiction_id int, name string, name_short string, homepage_url string, timezone string, created_at timestamp_ntz",
    "video_sources": "id int, body_id int, kind string, youtube_id string, url string, created_at timestamp_ntz",
    "meetings": "id int, body_id int, youtube_id string, youtube_url string, title string, description string, start_time timestamp, duration_secs decimal(18,3), created_at timestamp_ntz",
    "people": "id int, name string, bio string, created_at timestamp_ntz, voice_embedding array<float>",
    "segments": f"id int, meeting_id int, person_id int, speaker_number int, words {WORDS}, text string, start_secs decimal(18,3), end_secs decimal(18,3), duration_secs decimal(18,3), created_at timestamp_ntz",
}
# fixed values: foreign keys as (table, column, parent)
FOREIGN_KEYS = (
    ("bodies", "jurisdiction_id", "jurisdictions"),
    ("video_sources", "body_id", "bodies"),
    ("meetings", "body_id", "bodies"),
    ("segments", "meeting_id", "meetings"),
    ("segments", "person_id", "people"),
)
VOICE_DIMS = 192


def words_text(words: Column) -> Column:
    """Texts of the words joined by a space; null texts are skipped."""
    return F.array_join(F.transform(words, lambda w: w["text"]), " ")


def words_start(words: Column) -> Column:
    return F.try_element_at(words, F.lit(1))["start"]


def words_end(words: Column) -> Column:
    return F.try_element_at(words, F.lit(-1))["end"]


def seconds(x: Column) -> Column:
    """Interval seconds with three digits, as the tables store them."""
    return F.round(x, 3).cast("decimal(18,3)")


def source_url(kind: Column, youtube_id: Column) -> Column:
    return F.when(kind == "channel", F.concat(F.lit("https://www.youtube.com/channel/"), youtube_id)).when(kind == "playlist", F.concat(F.lit("https://www.youtube.com/playlist?list="), youtube_id))


def watch_url(youtube_id: Column) -> Column:
    return F.when(youtube_id == "", "").otherwise(F.concat(F.lit("https://www.youtube.com/watch?v="), youtube_id))


def derive_segments(segments: DataFrame) -> DataFrame:
    """Recompute text and times from ``words``; the duration is rounded from the unrounded difference."""
    w = F.col("words")
    return segments.withColumns({"text": words_text(w), "start_secs": seconds(words_start(w)), "end_secs": seconds(words_end(w)), "duration_secs": seconds(words_end(w) - words_start(w))})


def derive_meetings(meetings: DataFrame) -> DataFrame:
    return meetings.withColumn("youtube_url", watch_url(F.col("youtube_id")))


def derive_sources(sources: DataFrame) -> DataFrame:
    return sources.withColumn("url", source_url(F.col("kind"), F.col("youtube_id")))


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str = "id") -> DataFrame:
    """Rows whose non-null key has no parent."""
    return child.filter(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def duplicates(table: DataFrame, key: str) -> DataFrame:
    """Key values that occur more than once, with their count."""
    return table.filter(F.col(key).isNotNull()).groupBy(key).count().filter("count > 1")


def wordless(segments: DataFrame) -> DataFrame:
    """Segments that break the rule that words are present and not empty."""
    return segments.filter(F.coalesce(F.size("words"), F.lit(0)) <= 0)


def split_valid(table: DataFrame, rule: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that satisfy a check or leave it unknown, rows that break it)."""
    holds = F.coalesce(rule, F.lit(True))
    return table.filter(holds), table.filter(~holds)


def violations(tables: dict[str, DataFrame]) -> DataFrame:
    """One row for each broken constraint: constraint and rows."""
    checks = [(f"{t}.{c} -> {p}", orphans(tables[t], c, tables[p])) for t, c, p in FOREIGN_KEYS if t in tables and p in tables]
    if "meetings" in tables:
        checks.append(("meetings.youtube_id unique", duplicates(tables["meetings"], "youtube_id")))
    if "segments" in tables:
        checks.append(("segments.words not empty", wordless(tables["segments"])))
    if "people" in tables:
        checks.append((f"people.voice_embedding has {VOICE_DIMS} numbers", tables["people"].filter(F.size("voice_embedding") != VOICE_DIMS)))
    out = None
    for name, rows in checks:
        part = rows.agg(F.lit(name).alias("constraint"), F.count(F.lit(1)).alias("rows"))
        out = part if out is None else out.unionByName(part)
    return out.filter("rows > 0")
