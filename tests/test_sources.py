import json
import wave

import pytest
from pyspark.sql import functions as F

from parley.operators.timeline import collect_words
from parley.plans.ingest import Batch, ingest, ingest_into
from parley.schema import WORDS
from parley.sources import psv, sinks, snapshot
from parley.sources.versions import TableSet
from parley.streaming.arrivals import arrived, ingest_arrivals

PSV = """# a comment
start_sec|end_sec|event_type|event_data

0:00:00.08||meta|{"begin_speaker":"segmented:spk-2"}
0:00:00.08|0:00:01.00|text|hello
0:00:01.00|0:00:02.00|text|a|b
0:00:02.00|0:00:02.50|vad|{"index":0,"dur":0.92}
0:00:03.00||meta|{"begin_speaker":"segmented:spk-4"}
0:00:03.00|0:00:03.50|text|x
0:00:04.00||meta|{"begin_speaker":"unlabeled"}
0:00:04.00|0:00:04.50|text|y
"""


def test_psv_reader(spark, tmp_path):
    (tmp_path / "a.psv").write_text(PSV)
    got = psv.read(spark, str(tmp_path)).orderBy("seg_idx").collect()
    assert [(r.speaker_num, [w.text for w in r.words]) for r in got] == [(2, ["hello", "a|b"]), (4, ["x"]), (None, ["y"])]


@pytest.mark.parametrize(("text", "error"), [("0:00:01.00|0:00:02.00|text|a", "begin_speaker"), ("0:00:01.00|0:00:02.00|odd|a", "unknown event type"), ('0:00:01.00||meta|{"begin_speaker":"identified:1"}', "unknown speaker label"), ("0:00:01.00||meta|{broken", "(?i)malformed|parse")])
def test_psv_errors(spark, tmp_path, text, error):
    (tmp_path / "a.psv").write_text(text)
    with pytest.raises(Exception, match=error):
        psv.read(spark, str(tmp_path)).collect()


def test_psv_round_trip_through_files(spark, tmp_path):
    rows = [("m", 0, None, [("a", 0.0, 0.5)]), ("m", 1, 2, [("b", 1.0, 1.25), ("c", 2.0, 9921.28)]), ("m", 2, 3, [])]
    df = spark.createDataFrame(rows, f"file string, seg_idx int, speaker_num int, words {WORDS}")
    psv.write(psv.segment_lines(df), str(tmp_path / "out"))
    got = psv.read(spark, str(tmp_path / "out" / "file=m")).orderBy("seg_idx").collect()
    assert [(r.speaker_num, [tuple(w) for w in r.words]) for r in got] == [(s, w) for _, _, s, w in rows]


def test_vad_lines(spark):
    runs = spark.createDataFrame([("m", 0, 0.4, 1.32, [("a", 0.5, 0.9)]), ("m", 1, 2.0, 302.0, [])], f"file string, run_idx int, start double, end double, words {WORDS}")
    lines = [r.line for r in psv.run_lines(runs).orderBy("line_no").collect()]
    assert lines[1] == '0:00:00.40||meta|{"begin_speaker":"unlabeled"}'
    assert lines[2] == '0:00:00.40|0:00:01.32|vad|{"index":0,"dur":0.92}' and lines[4].endswith('{"index":1,"dur":300}')


def test_snapshot(spark, tmp_path):
    (tmp_path / "jurisdictions.jsonl").write_text('{"id":"j","name":"J","name_short":"j","state":"AK"}\n\n')
    (tmp_path / "bodies.jsonl").write_text('{"id":"b","jurisdiction_id":"j","name":"B","name_short":"B","timezone":"UTC","video_sources":[{"kind":"channel","youtube_id":"c"},{"kind":"playlist","youtube_id":"p"}]}\n')
    (tmp_path / "people.jsonl").write_text('{"slug":"a","name":"A"}\n')
    (tmp_path / "meetings" / "b_1").mkdir(parents=True)
    (tmp_path / "meetings" / "b_1" / "meeting.json").write_text('{\n"body_id":"b","youtube_id":"1","title":"t","duration_secs":"fix me"}')
    found = snapshot.load(spark, str(tmp_path))
    assert found["meetings"].first().slug == "b_1"
    rows = snapshot.to_rows(found)
    assert [tuple(r) for r in rows["video_sources"].orderBy("id").collect()] == [(1, 1, "channel", "c", "https://www.youtube.com/channel/c"), (2, 1, "playlist", "p", "https://www.youtube.com/playlist?list=p")]
    with pytest.raises(Exception, match="(?i)path"):
        snapshot.load(spark, str(tmp_path / "none"))["people"].count()


def test_listing_and_metadata(spark):
    tree = {"entries": [{"_type": "playlist", "id": "tab", "entries": [{"id": "a"}, {"_type": "url", "id": "b"}, {"_type": "channel", "id": "z"}]}, {"_type": "url", "id": "c"}, {"_type": "playlist", "entries": [{"id": "a"}, {"id": "d"}]}]}
    df = spark.createDataFrame([(1, json.dumps(tree))], "k int, doc string")
    assert [r.video_id for r in snapshot.flatten_listing(df, "k", "doc").orderBy("i").collect()] == ["a", "b", "c", "d"]
    r = snapshot.video_metadata(spark.createDataFrame([('{"id":"v"}',)], "doc string"), "doc").first()
    assert (r.id, r.title, r.duration) == ("v", "", None)


def test_targets():
    known = {"DATABASE_URL_LOCAL": "pg://l", "DATABASE_URL_STAGE_ONE": "pg://s"}
    assert snapshot.resolve_target(None, known) == "pg://l"
    assert snapshot.resolve_target("stage-one", known) == "pg://s"
    assert snapshot.resolve_target("pg://x", known) == "pg://x"
    with pytest.raises(ValueError, match="local, stage-one"):
        snapshot.resolve_target("nope", known)
    assert snapshot.redact("pg://u:p@h") == "pg://u:***@h"


def test_id_list_and_audio(spark, tmp_path):
    with pytest.raises(ValueError):
        snapshot.id_list(spark, " \n ")
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(16000)
        w.writeframes(b"\x00\x40" * 4)
    files = snapshot.audio_files(spark, str(tmp_path / "*.wav"))
    wavs = snapshot.decode_wav(files).first()
    assert (wavs.sample_rate, wavs.samples) == (16000, [0.5] * 4)
    wrong = files.select("path", F.lit("00").alias("sha256"))
    with pytest.raises(Exception, match="digest differs"):
        snapshot.verified_audio(files, wrong).select(F.length("content")).collect()


def test_sinks(spark, tmp_path):
    out = str(tmp_path / "db")
    for n in (2, 3):
        sinks.replace_tables({"t": spark.range(n), "u": spark.range(n)}, out)
        assert {t: rows.count() for t, rows in TableSet(spark, out).read().items()} == {"t": n, "u": n}
    calls = []
    for _ in range(2):
        sinks.memo(spark, str(tmp_path / "memo"), lambda: calls.append(1) or spark.range(1))
    assert len(calls) == 1
    rows = spark.createDataFrame([("a", None), ("bbb", "x")], "p string, q string")
    assert [r.value for r in sinks.json_lines(rows).collect()] == ['{"p":"a","q":null}', '{"p":"bbb","q":"x"}']
    assert [r.value for r in sinks.padded_table(rows, ["p", "q"]).collect()] == ["a", "bbb  x"]


def one_hot(i):
    return [float(k == i) for k in range(192)]


def test_ingest(spark, tmp_path):
    words = [("v1", 0, "Hello", 0.5, 0.9), ("v1", 1, "everyone", 1.0, 1.4), ("v1", 2, "Thanks", 5.0, 5.4)]
    batch = Batch(
        spark.createDataFrame([("v1", "chan", "T", "", 3600.0), ("bad", "other", "", "", None)], "id string, channel_id string, title string, description string, duration double"),
        spark.createDataFrame(words, "meeting_id string, word_idx int, text string, start double, end double"),
        spark.createDataFrame([("v1", 0, 0.4, 1.5, 0), ("v1", 1, 4.9, 5.5, 1)], "meeting_id string, turn_idx int, start double, end double, speaker_num int"),
        spark.createDataFrame([("v1", 0, one_hot(0)), ("v1", 1, one_hot(1))], "meeting_id string, speaker_num int, centroid array<float>"),
    )
    tables = {
        "meetings": spark.createDataFrame([], "id int, body_id int, youtube_id string, youtube_url string, title string, description string, start_time timestamp, duration_secs decimal(18,3)"),
        "people": spark.createDataFrame([], "id int, name string, voice_embedding array<float>"),
        "segments": spark.createDataFrame([], f"id int, meeting_id int, person_id int, speaker_number int, words {WORDS}, text string, start_secs decimal(18,3), end_secs decimal(18,3), duration_secs decimal(18,3)"),
        "video_sources": spark.createDataFrame([(1, 1, "chan")], "id int, body_id int, youtube_id string"),
    }
    new, status = ingest(batch, tables)
    assert {r.id: r.status for r in status.collect()} == {"v1": "ingested", "bad": "rejected"}
    got = new["segments"].orderBy("id").collect()
    assert [r.text for r in got] == ["Hello everyone", "Thanks"] and got[0].person_id != got[1].person_id
    m = new["meetings"].first()
    assert m.start_time is None and float(m.duration_secs) == 3600.0
    again, status = ingest(batch, {**tables, **new})
    assert {r.id: r.status for r in status.collect()} == {"v1": "skipped", "bad": "rejected"}
    assert again["segments"].count() == 2
    store = TableSet(spark, str(tmp_path / "db"))
    store.commit(tables)
    for version in (2, 3):  # one commit for the three tables; repeated, the batch adds nothing
        assert ingest_into(store, batch)[0] == version
        assert {n: rows.count() for n, rows in store.read().items()} == {"meetings": 1, "people": 2, "segments": 2, "video_sources": 1}


def test_stream_is_idempotent(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    run = lambda: ingest_arrivals(spark, str(source), "id string, n int", "id", str(tmp_path / "out"), str(tmp_path / "cp"), lambda df: df).awaitTermination()
    (source / "1.json").write_text('{"id":"a","n":1}\n{"id":"a","n":1}\n')
    run()
    (source / "2.json").write_text('{"id":"a","n":1}\n{"id":"b","n":2}\n')
    run()
    assert sorted(r.id for r in arrived(spark, str(tmp_path / "out")).collect()) == ["a", "b"]


def test_broken_batches_leave_nothing_and_are_taken_again(spark, tmp_path):
    """Keys make two rows or none; batches break off before, within and after their writes, and stand as if nothing had happened."""
    source, out, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    source.mkdir()
    calls = []

    def handle(rows):
        calls.append(sorted(r.id for r in rows.collect()))
        return rows.filter("n > 0").select("id", F.explode(F.array(F.lit(1), F.lit(2))).alias("k"))

    def run(how):
        ingest_arrivals(spark, str(source), "id string, n int", "id", out, cp, how, most_files=1).awaitTermination()

    def shown():
        rows = arrived(spark, out)
        return None if rows is None else sorted((r.id, r.k) for r in rows.collect())

    def broken(rows):
        handle(rows).limit(1).write.mode("overwrite").parquet(f"{out}/results/batch=1")  # a part of the rows is there
        raise RuntimeError("broken")

    assert shown() is None
    (source / "1.json").write_text('{"id":"a","n":1}\n{"id":"z","n":0}\n')
    run(handle)
    first = [("a", 1), ("a", 2)]
    assert shown() == first
    (source / "2.json").write_text('{"id":"a","n":1}\n{"id":"b","n":2}\n{"id":"z","n":5}\n')
    for how in (broken, broken):
        with pytest.raises(Exception, match="broken"):
            run(how)
        assert shown() == first
    run(handle)
    assert shown() == [*first, ("b", 1), ("b", 2)] and calls == [["a", "z"], ["b"], ["b"], ["b"]]  # z made no rows and stays handled
    (source / "3.json").write_text('{"id":"c","n":1}\n')
    run(handle)
    assert shown()[-2:] == [("c", 1), ("c", 2)] and calls[-1] == ["c"]


def test_files_with_a_manifest(spark, tmp_path):
    rows = spark.createDataFrame([(f"d{i % 3}/f{i}.bin", bytes([i]) * (i * 1000 + 1)) for i in range(20)], "path string, content binary").repartition(3)
    folder = f"{tmp_path}/files"
    manifest = sinks.write_files(rows, folder)
    assert manifest.count() == 20 and manifest.count() == 20  # written again, the same
    (tmp_path / "files/d1/f4.bin").write_bytes(b"damaged")
    (tmp_path / "files/d2/f5.bin").unlink()
    (tmp_path / "files/d0/other.bin").write_bytes(b"x")
    status = {r.path: r.status for r in snapshot.check_files(snapshot.audio_files(spark, folder), manifest_table(spark, rows), folder).collect()}
    assert {p: s for p, s in status.items() if s != "ok"} == {"d1/f4.bin": "differs", "d2/f5.bin": "missing", "d0/other.bin": "unknown"} and len(status) == 21


def manifest_table(spark, rows):
    return rows.select("path", F.sha2("content", 256).alias("sha256"))


def test_collect_words_keeps_order(spark):
    rows = spark.createDataFrame([(1, 1, "b", 1.0, 2.0), (1, 0, "a", 0.0, 1.0)], "meeting_id int, word_idx int, text string, start double, end double")
    assert [w.text for w in collect_words(rows, ["meeting_id"], "word_idx").first().words] == ["a", "b"]


def test_write_text_keeps_what_is_there(spark, tmp_path):
    sinks.write_text(spark, str(tmp_path / "a" / "t.txt"), "häß\n")
    assert (tmp_path / "a" / "t.txt").read_text(encoding="utf-8") == "häß\n"
    with pytest.raises(Exception, match="exist"):
        sinks.write_text(spark, str(tmp_path / "a" / "t.txt"), "other")
    assert (tmp_path / "a" / "t.txt").read_text(encoding="utf-8") == "häß\n"


def test_psv_times_are_split_once(spark):
    lines = spark.createDataFrame([("f", 2, "0:00:01.00|0:00:01.50|text|a|b"), ("f", 1, '0:00:00.00||meta|{"begin_speaker":"unlabeled"}')], "file string, line_no int, line string")
    events = psv.parse_lines(lines)
    assert [(r.start, r.end, r.event_data) for r in events.orderBy("line_no").collect()] == [(0.0, None, '{"begin_speaker":"unlabeled"}'), (1.0, 1.5, "a|b")]
    assert events._jdf.queryExecution().optimizedPlan().toString().count(", :, ") == 2
