from datetime import datetime

import pytest
from pyspark.sql import functions as F

from parley.functions import strings, times, vectors


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def at(text):
    return F.lit(text).cast("timestamp")


@pytest.mark.parametrize(
    ("instant", "zone", "shown"),
    [("2026-06-15T03:00:00Z", "America/Anchorage", "June 14, 2026 7:00 PM"), ("2026-06-15T03:00:00Z", "America/New_York", "June 14, 2026 11:00 PM"), ("2026-06-15T03:00:00Z", "UTC", "June 15, 2026 3:00 AM")],
)
def test_meeting_time(spark, instant, zone, shown):
    assert one(spark, times.meeting_time(at(instant), F.lit(zone))) == shown


@pytest.mark.parametrize(
    ("wall", "zone", "instant"),
    [
        ("2026-06-14T19:00", "America/Anchorage", "2026-06-15 03:00"),
        ("2026-01-14T19:00", "America/Anchorage", "2026-01-15 04:00"),
        ("2026-03-08T02:30", "America/Anchorage", "2026-03-08 10:30"),
        ("2026-03-29T02:30", "Europe/Berlin", "2026-03-29 01:30"),
        ("2026-10-25T02:30", "Europe/Berlin", "2026-10-25 01:30"),
        ("", "UTC", None),
        ("not a date", "UTC", None),
    ],
)
def test_from_input_value(spark, wall, zone, instant):
    got = one(spark, times.from_input_value(F.lit(wall), F.lit(zone)).cast("timestamp_ntz"))
    assert got == (instant and datetime.strptime(instant, "%Y-%m-%d %H:%M"))


def test_repeated_hour_renders_back(spark):
    zone = F.lit("America/Anchorage")
    assert one(spark, times.input_value(times.from_input_value(F.lit("2026-11-01T01:00"), zone), zone)) == "2026-11-01T01:00"
    assert one(spark, times.input_value(at("2026-06-15T08:00:00Z"), zone)) == "2026-06-15T00:00"


def test_zone_abbreviation(spark):
    assert one(spark, times.zone_abbreviation(at("2026-06-15T03:00:00Z"), F.lit("America/Anchorage"))) == "AKDT"


@pytest.mark.parametrize(
    ("text", "precision", "want"),
    [
        ("01:23:05.023", "seconds", "1h 23m 5s"), ("01:23:05.023", "minutes", "1h 23m"), ("00:23:05", "seconds", "23m 5s"), ("00:23:05", "minutes", "23m"), ("00:00:05", "seconds", "5s"),
        ("01:00:00", "minutes", "1h 0m"), ("00:23:45", "minutes", "24m"), ("01:59:45", "minutes", "2h 0m"), ("00:00:20", "minutes", "<1m"), ("fix me", "minutes", "fix me"),
    ],
)
def test_duration(spark, text, precision, want):
    assert one(spark, times.duration(F.lit(text), precision)) == want


@pytest.mark.parametrize(("secs", "want"), [(0.08, "0:00:00.08"), (2.0, "0:00:02.00"), (2.56, "0:00:02.56"), (9921.28, "2:45:21.28"), (1.005, "0:00:01.00")])
def test_psv_time(spark, secs, want):
    assert one(spark, times.psv_time(F.lit(secs))) == want


def test_psv_time_round_trip_and_errors(spark):
    assert one(spark, times.parse_psv_time(F.lit("0:01:14.96"))) == 74.96
    for wrong in ("1:00", "a:b:c"):
        with pytest.raises(Exception, match="invalid timestamp"):
            one(spark, times.parse_psv_time(F.lit(wrong)))


def test_timeline_text(spark):
    assert one(spark, times.timeline_secs(F.lit("1:02:03.5"))) == 3723.5
    assert one(spark, times.timeline_text(F.lit(3723.5))) == "1:02:03.500"
    assert one(spark, times.timeline_text(F.lit(62.25))) == "1:02.250"
    assert one(spark, times.clock(F.lit(-3.0))) == "0:00"
    assert one(spark, times.interval_text(F.lit(5025.023))) == "01:23:45.023"


def test_segment_secs(spark):
    w = F.array(F.struct(F.lit("a").alias("text"), F.lit(2.0).alias("start"), F.lit(4.5).alias("end")))
    assert one(spark, times.segment_secs(F.lit("00:00:03"), w)) == 3.0
    assert one(spark, times.segment_secs(F.lit(None).cast("string"), w)) == 2.5
    assert one(spark, times.segment_secs(F.lit(None).cast("string"), F.slice(w, 1, 0))) == 0.0


def test_strings(spark):
    assert one(spark, strings.blank_to_null(F.lit("  \t"))) is None
    assert one(spark, strings.blank_to_null(F.lit("  x "))) == "x"
    assert one(spark, strings.anonymous_name(F.lit(0))) == "Anonymous Aardvark"
    assert one(spark, strings.anonymous_name(F.lit(51))) == "Anonymous Zebu"
    assert one(spark, strings.anonymous_name(F.lit(52))) == "Anonymous Speaker 53"
    assert one(spark, strings.color_slot(F.lit(9))) == 2
    assert one(spark, strings.redact_url(F.lit("postgres://u:pw@h/db"))) == "postgres://u:***@h/db"
    assert one(spark, strings.redact_url(F.lit("not a url"))) == "not a url"
    assert one(spark, strings.parse_speaker_label(F.lit("segmented:spk-4"))) == 4
    assert one(spark, strings.parse_speaker_label(F.lit("unlabeled"))) is None
    with pytest.raises(Exception, match="unknown speaker label"):
        one(spark, strings.parse_speaker_label(F.lit("identified:3")))
    assert one(spark, strings.pad_end(F.lit("abc"), F.lit(2))) == "abc"


@pytest.mark.parametrize(("text", "query", "escape", "want"), [("50% off", "0%o", False, True), ("50% off", "0%o", True, False), ("a_b", "a_b", True, True), ("axb", "a_b", True, False), ("a\\b", "a\\b", True, True), ("ab", "a\\b", False, True), ("HELLO", "ell", False, True)])
def test_contains_text(spark, text, query, escape, want):
    assert one(spark, strings.contains_text(F.lit(text), query, escape=escape)) is want


def test_attendance_label(spark):
    label = lambda n, a, b: one(spark, strings.attendance_label(F.lit(n), F.lit("GBOS"), F.lit(a).cast("string"), F.lit(b).cast("string")))
    assert label(5, "Apr 2023", "Feb 2026") == "5 GBOS meetings, Apr 2023–Feb 2026"
    assert label(1, "Apr 2023", "Apr 2023") == "1 GBOS meeting, Apr 2023"
    assert label(2, None, None) == "2 GBOS meetings"


def test_vectors(spark):
    v = lambda *x: F.array(*[F.lit(float(i)).cast("float") for i in x])
    assert one(spark, vectors.cosine_similarity(v(0, 0), v(1, 2))) == 0.0
    assert one(spark, vectors.cosine_distance(v(0, 0), v(0, 0))) == 1.0
    assert abs(one(spark, vectors.cosine_similarity(v(1, 1), v(2, 2))) - 1) < 1e-12
    assert one(spark, vectors.weighted_mean(v(1, 0), F.lit(3.0), v(0, 1), F.lit(1.0))) == [0.75, 0.25]
    assert one(spark, vectors.one_hot(3, F.lit(1))) == [0.0, 1.0, 0.0]
    assert one(spark, vectors.slice_wave(v(0, 1, 2, 3), F.lit(2), F.lit(-1.0), F.lit(1.0))) == [0.0, 1.0]
    with pytest.raises(Exception, match="empty window"):
        one(spark, vectors.slice_wave(v(0, 1), F.lit(1), F.lit(1.0), F.lit(1.0)))
    with pytest.raises(Exception, match="sample rate"):
        one(spark, vectors.checked_rate(F.lit(8000)))


def test_intervals_and_clips(spark):
    from datetime import timedelta

    assert one(spark, times.interval_of(F.lit(1.2345678))) == timedelta(seconds=1.235)
    assert one(spark, times.interval_of(F.lit(None).cast("double"))) is None
    assert one(spark, times.naive_to_instant(F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")).cast("string")) == "2026-01-01 00:00:00"
    r = one(spark, vectors.tail_clip(F.lit(0.0), F.lit(20.0)))
    assert (r["from"], r["to"]) == (192_000, 320_000)
    assert one(spark, vectors.sample_secs(F.lit(8000))) == 0.5
    assert one(spark, times.seek_target(F.lit(5.0), F.lit(-15.0), F.lit(None).cast("double"))) == 0.0
    assert one(spark, times.seek_target(F.lit(95.0), F.lit(15.0), F.lit(100.0))) == 100.0


def test_playback(spark):
    from parley.operators import timeline

    row = spark.range(1).select(*[timeline.playback_status(F.lit(p), F.lit(1)).alias(f"s{p}") for p in range(3)], timeline.cyclic_step(F.lit(0), F.lit(-1), F.lit(5)).alias("c")).first()
    assert tuple(row) == ("past", "active", "future", 4)
    spans = spark.createDataFrame([(1, 0.0, 2.0), (1, 1.0, 3.0), (2, 0.0, 1.0), (2, 1.0, 2.0)], "k int, start double, end double")
    assert {r.k: r.overlaps for r in timeline.any_overlap(spans, "k").collect()} == {1: True, 2: False}


def test_hits_per_segment(spark):
    from parley.operators import talk
    from parley.schema import WORDS

    rows = spark.createDataFrame([(1, 0, [("lala", 0.0, 0.1)])], f"meeting_id int, seg_idx int, words {WORDS}")
    got = talk.hits_per_segment(talk.find_matches(rows, "la", ["meeting_id", "seg_idx"]), ["meeting_id", "seg_idx"]).first()
    assert [h["at"] for h in got.hits] == [0, 2]
