"""Batch ingest: videos with transcripts and turns become meetings, people and segments.

Speech models stay outside: their results come in as tables. The whole batch
is one set of frames; a video that cannot be ingested is reported and does not stop the others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators import timeline, voices
from parley.operators.numbering import dense_number, greatest, written
from parley.schema import derive_meetings, derive_segments, seconds
from parley.sources.versions import TableSet


@dataclass
class Batch:
    """Stage results of a batch, keyed by video id (``meeting_id`` holds it here)."""

    videos: DataFrame  # id, channel_id, title, description, duration
    words: DataFrame  # meeting_id, word_idx, text, start, end
    turns: DataFrame  # meeting_id, turn_idx, start, end, speaker_num
    centroids: DataFrame  # meeting_id, speaker_num, centroid


def plan(videos: DataFrame, meetings: DataFrame, sources: DataFrame) -> DataFrame:
    """id, body_id, status: skipped if ingested, rejected if no body has the channel (the least body wins), else ingested."""
    body = sources.filter("youtube_id != ''").groupBy(F.col("youtube_id").alias("channel_id")).agg(F.min("body_id").alias("body_id"))
    done = meetings.select(F.col("youtube_id").alias("id"), F.lit(True).alias("_done"))
    found = videos.select("id", "channel_id").dropDuplicates(["id"]).join(done, "id", "left").join(body, "channel_id", "left")
    status = F.when(F.col("_done"), "skipped").when(F.col("body_id").isNull(), "rejected").otherwise("ingested")
    return found.select("id", "body_id", status.alias("status"))


def ingest(batch: Batch, tables: dict[str, DataFrame], *, bucket_secs: float = timeline.BUCKET_SECS) -> tuple[dict[str, DataFrame], DataFrame]:
    """(new meetings, people and segments tables, status of every video). Tables: meetings, people, segments, video_sources.

    Start times stay null; segments without words are dropped; ids go on after the greatest.
    """
    status = plan(batch.videos, tables["meetings"], tables["video_sources"])
    taken = status.filter("status = 'ingested'").select("id", "body_id")
    number = lambda rows, order, t: dense_number(rows, order, after=greatest(tables[t]), kind="int")
    new = number(batch.videos.dropDuplicates(["id"]).join(taken, "id").withColumnRenamed("id", "youtube_id"), ["youtube_id"], "meetings")
    meetings = derive_meetings(new.select("id", "body_id", "youtube_id", "title", "description", F.lit(None).cast("timestamp").alias("start_time"), seconds(F.col("duration")).alias("duration_secs")))
    only = taken.select(F.col("id").alias("meeting_id"))
    of = lambda rows: rows.join(only, "meeting_id", "left_semi")
    spoken = timeline.align_speakers(of(batch.words), of(batch.turns), bucket_secs=bucket_secs).filter(F.size("words") > 0)
    resolved, people = voices.resolve_people(of(batch.centroids), tables["people"])
    named = voices.identify_segments(spoken, resolved).join(meetings.select(F.col("youtube_id").alias("meeting_id"), F.col("id").alias("_meeting")), "meeting_id")
    rows = number(named.drop("meeting_id").withColumnRenamed("_meeting", "meeting_id"), ["meeting_id", "seg_idx"], "segments")
    segments = derive_segments(rows.select("id", "meeting_id", F.col("person_id").cast("int").alias("person_id"), F.col("speaker_num").alias("speaker_number"), "words"))
    out = {t: tables[t].unionByName(added, allowMissingColumns=True) for t, added in (("meetings", meetings), ("people", people), ("segments", segments))}
    return out, status


def ingest_into(store: TableSet, batch: Batch, *, bucket_secs: float = timeline.BUCKET_SECS) -> tuple[int, DataFrame]:
    """Ingest a batch into versioned tables: its meetings, people and segments appear together, in one commit. Returns the version and the status of every video.

    Another commit to these tables meanwhile is a ``Conflict``; ingested videos are skipped when the batch is repeated.
    """
    base = store.version()
    tables = store.read(version=base)
    status = written(plan(batch.videos, tables["meetings"], tables["video_sources"]))
    new, _ = ingest(batch, tables, bucket_secs=bucket_secs)
    return store.commit(new, base=base), status
