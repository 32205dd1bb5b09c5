from datetime import datetime

import pytest
from pyspark.sql import functions as F

from parley.operators import relational, talk
from parley.schema import WORDS, derive_meetings, derive_segments, split_valid, violations


@pytest.fixture(scope="module")
def tables(spark):
    t = datetime(2023, 4, 10, 18), datetime(2026, 2, 3, 18)
    return {
        "bodies": spark.createDataFrame([(1, "GBOS", "UTC"), (2, "Assembly", "UTC")], "id int, name_short string, timezone string"),
        "meetings": spark.createDataFrame([(1, 1, "a", "", t[0]), (2, 1, "b", "", t[1]), (3, 2, "c", "", None)], "id int, body_id int, youtube_id string, title string, start_time timestamp"),
        "people": spark.createDataFrame([(1, "Ann"), (2, None), (3, "Cy")], "id int, name string"),
        "segments": spark.createDataFrame([*[(i, 1, 1) for i in range(1, 6)], *[(i, 2, 1) for i in range(6, 9)], (9, 3, 1), (10, 1, None), (11, 3, 2)], "id int, meeting_id int, person_id int").withColumn("text", F.concat(F.lit("word "), F.col("id"))),
    }


def test_attendance(tables):
    people = relational.with_attendance(tables["people"], relational.attendance(tables["segments"], tables["meetings"], tables["bodies"]))
    got = {r.id: [(a.body, a.meetings, a.first and a.first.year, a.last and a.last.year) for a in r.attendance] for r in people.collect()}
    assert got == {1: [("GBOS", 2, 2023, 2026), ("Assembly", 1, None, None)], 2: [("Assembly", 1, None, None)], 3: []}


def test_attendance_text(tables):
    people = relational.with_attendance(tables["people"], relational.attendance(tables["segments"], tables["meetings"], tables["bodies"]))
    assert people.filter("id = 1").select(relational.attendance_text(F.col("attendance")).alias("x")).first().x == "2 GBOS meetings, Apr 2023–Feb 2026 · 1 Assembly meeting"


def test_list_ingested_puts_unknown_dates_first(tables):
    got = relational.list_ingested(tables["meetings"], tables["bodies"], tables["segments"]).collect()
    assert [(r.id, r.body, r.segments) for r in got] == [(3, "assembly", 2), (2, "gbos", 3), (1, "gbos", 6)]
    assert relational.list_ingested(tables["meetings"], tables["bodies"], tables["segments"], []).count() == 3


def test_available(spark, tables):
    sources = spark.createDataFrame([(1, 1), (2, 2)], "id int, body_id int")
    listing = spark.createDataFrame([(1, 0, "newest"), (1, 1, "a"), (1, 2, "oldest"), (2, 0, "p")], "source_id int, i int, video_id string")
    got = relational.available(tables["bodies"], sources, listing, tables["meetings"], "Gbos").collect()
    assert [r.video_id for r in got] == ["newest", "oldest"]
    with pytest.raises(ValueError, match="assembly, gbos"):
        relational.available(tables["bodies"], sources, listing, tables["meetings"], "nope")


def test_find_one_and_lookup(tables):
    assert relational.find_one(tables["people"], 3).first().name == "Cy"
    with pytest.raises(LookupError):
        relational.find_one(tables["people"], 9)
    with pytest.raises(Exception, match="no name for"):
        relational.lookup(tables["segments"].withColumn("id", F.col("id") + 0), tables["people"], "id", "name", required=True).collect()


def test_search(tables):
    got = relational.search_segments(tables["segments"], tables["meetings"], tables["people"], "WORD", limit=3).collect()
    assert [r.id for r in got] == [11, 10, 9]
    assert got[1].person is None and got[0].person.name is None
    assert relational.search_segments(tables["segments"], tables["meetings"], tables["people"], "").count() == 0


def test_updates(spark, tables):
    changed = relational.set_name(tables["people"], spark.createDataFrame([(1, "  "), (2, " Bo ")], "id int, name string"))
    assert {r.id: r.name for r in changed.collect()} == {1: None, 2: "Bo", 3: "Cy"}


def test_group_by_meeting(tables):
    rows = tables["segments"].withColumn("start_secs", F.when(F.col("id") != 1, -F.col("id")))
    got = relational.group_by_meeting(rows, tables["meetings"]).collect()
    assert [r.id for r in got] == [2, 1, 3]
    assert [s.id for s in got[0].segments] == [8, 7, 6]


def test_percentile_nearest_rank(spark):
    assert spark.range(1, 22).select(F.col("id").cast("double").alias("x")).agg(relational.percentile_nearest_rank(0.95, "x").alias("p")).first().p == 20.0
    assert spark.range(0).select(F.col("id").cast("double").alias("x")).agg(relational.percentile_nearest_rank(0.95, "x").alias("p")).first().p == 0.0


def test_derived_columns_and_checks(spark):
    rows = spark.createDataFrame([(1, 1, 5, [("hello", 2.0, 2.4), ("there", 3.0, 3.5), ("world", 4.0, 4.5)]), (2, 9, None, [])], f"id int, meeting_id int, person_id int, words {WORDS}")
    got = {r.id: r for r in derive_segments(rows).collect()}
    assert (got[1].text, float(got[1].start_secs), float(got[1].end_secs), float(got[1].duration_secs)) == ("hello there world", 2.0, 4.5, 2.5)
    assert got[2].start_secs is None
    good, bad = split_valid(rows, F.size("words") > 0)
    assert (good.count(), bad.count()) == (1, 1)
    meetings = derive_meetings(spark.createDataFrame([(1, "x"), (2, "x"), (3, "")], "id int, youtube_id string"))
    assert meetings.filter("id = 3").first().youtube_url == ""
    people = spark.createDataFrame([(5, [0.0])], "id int, voice_embedding array<float>")
    assert {r.constraint for r in violations({"meetings": meetings, "segments": rows, "people": people}).collect()} == {"segments.meeting_id -> meetings", "meetings.youtube_id unique", "segments.words not empty", "people.voice_embedding has 192 numbers"}


def test_find_matches_overlap(spark):
    rows = spark.createDataFrame([(1, 0, [("aaa", 0.0, 0.1), ("A", 0.2, 0.3)])], f"meeting_id int, seg_idx int, words {WORDS}")
    got = [(r["at"], r["from"], r["to"]) for r in talk.find_matches(rows, " AA ", ["meeting_id", "seg_idx"]).orderBy("at").collect()]
    assert got == [(0, 0, 0), (1, 0, 0)]
    assert [(r["from"], r["to"]) for r in talk.find_matches(rows, "a a", ["meeting_id", "seg_idx"]).collect()] == [(0, 1)]
    assert talk.find_matches(rows, "a", ["meeting_id", "seg_idx"]).count() == 0


def test_identities(spark, tables):
    rows = spark.createDataFrame([(1, 0, None, None), (1, 1, 1, 0), (1, 2, None, 1), (1, 3, 2, 2), (1, 4, None, 1)], "meeting_id int, seg_idx int, person_id int, speaker_number int")
    got = [(r.speaker_key, r.label, r.anonymous, r.color_slot) for r in talk.assign_identities(rows, tables["people"]).orderBy("place").collect()]
    assert got == [("unattributed", "Unattributed", False, None), ("person:1", "Ann", False, 1), ("number:1", "Anonymous Aardvark", True, 2), ("person:2", "Anonymous Beaver", True, 3)]


def test_tally(spark):
    rows = spark.createDataFrame([(1, 0, "a", 1.0), (1, 1, "b", 3.0), (1, 2, "c", 1.0), (2, 0, "a", 0.0)], "meeting_id int, seg_idx int, speaker_key string, secs double")
    got = [(r.meeting_id, r.speaker_key, r.share) for r in talk.tally_speakers(rows, F.col("secs")).orderBy("meeting_id", "place").collect()]
    assert got == [(1, "b", 0.6), (1, "a", 0.2), (1, "c", 0.2), (2, "a", 0.0)]


def test_group_order_without_ties(spark, tmp_path):
    # lines (3, 1), (2, 1000001), (1, 2000001) and so on share a segment id: their meetings go by id
    import __spark_entry__

    keys = [k for d in range(1, 60) for k in (d + 2000000, d, d + 1000000) if (d % 7) and k % 7]
    day = lambda k: f"2024-01-{1 + k % 1000000 % 28:02d}"
    spark.createDataFrame([(k, 1, day(k), "") for k in keys], "o_orderkey long, o_custkey long, o_orderdate string, o_orderpriority string").withColumn("o_orderdate", F.to_timestamp("o_orderdate")).write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(k, 3 - k // 1000000, 1.0) for k in keys], "l_orderkey long, l_linenumber int, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(1, 1)], "c_custkey long, c_nationkey int").write.parquet(str(tmp_path / "customer.parquet"))
    got = __spark_entry__.queries()["o10_group_order"](spark, str(tmp_path)).orderBy("place").collect()
    want = sorted(keys, key=lambda k: (-int(day(k)[-2:]), (3 - k // 1000000) * 1000000 + k, k))
    assert [(r.place, r.id) for r in got] == list(enumerate(want, 1))
    segments = spark.createDataFrame([(k, 5, 1.0, "") for k in range(40, 0, -1)], "meeting_id long, id long, start_secs double, text string")
    meetings = spark.createDataFrame([(k, None) for k in range(40, 0, -1)], "id long, start_time timestamp").withColumn("start_time", F.lit("2024-01-01").cast("timestamp"))
    assert [r.id for r in relational.group_by_meeting(segments, meetings).collect()] == list(range(1, 41))
