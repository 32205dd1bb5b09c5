import random
import time

import pytest
from pyspark.sql import functions as F

from parley.operators import talk, timeline
from parley.schema import WORDS


def words(spark, rows):
    """rows: (meeting, word_idx, text, start, end[, speaker])."""
    kinds = "meeting_id int, word_idx int, text string, start double, end double"
    return spark.createDataFrame(rows, kinds + (", speaker_num int" if rows and len(rows[0]) == 6 else ""))


def turns(spark, spans):
    return spark.createDataFrame([(1, i, float(a), float(b), s) for i, (a, b, s) in enumerate(spans)], "meeting_id int, turn_idx int, start double, end double, speaker_num int")


def spoken(spark, text, start=9.0, step=0.4, length=0.3, pauses=()):
    out, at = [], start
    for i, w in enumerate(text.split()):
        at += dict(pauses).get(i, 0.0)
        out.append((1, i, w, at, at + length))
        at += step
    return words(spark, out)


def texts(segments):
    rows = segments.orderBy("seg_idx").collect()
    return [(r.speaker_num, " ".join(w.text for w in r.words)) for r in rows]


def test_islands_by_speaker(spark):
    got = timeline.align_speakers(words(spark, [(1, 0, "a", 0.0, 0.4), (1, 1, "b", 0.5, 0.9), (1, 2, "c", 2.0, 2.5)]), turns(spark, [(0, 1, 0), (1.8, 3, 1)]))
    assert texts(got) == [(0, "a b"), (1, "c")]


def test_no_turns_is_one_null_segment(spark):
    got = timeline.align_speakers(words(spark, [(1, 0, "a", 0.0, 0.4), (1, 1, "b", 0.5, 0.9)]), turns(spark, []))
    assert texts(got) == [(None, "a b")]


def test_no_words_is_no_segment(spark):
    assert timeline.align_speakers(words(spark, []), turns(spark, [(0, 1, 0)])).count() == 0


def test_sliver_is_absorbed(spark):
    got = timeline.align_speakers(spoken(spark, "we have always been supported by the whole board here"), turns(spark, [(9, 11.0, 0), (11.0, 11.8, 1), (11.8, 14, 0)]))
    assert [s for s, _ in texts(got)] == [0]


@pytest.mark.parametrize(
    ("text", "pauses", "spans"),
    [
        ("we have been supported. Point of order. Thank you all", (), [(9, 10.55, 0), (10.55, 11.75, 1), (11.75, 14, 0)]),  # a sentence ends
        ("we have been heard yes maybe so thank you all", {4: 1.0}.items(), [(9, 10.9, 0), (10.9, 12.7, 1), (12.7, 16, 0)]),  # a pause
        ("we have been heard one two three four five six seven thank you", (), [(9, 10.55, 0), (10.55, 13.35, 1), (13.35, 16, 0)]),  # too long
    ],
)
def test_real_interjections_stay(spark, text, pauses, spans):
    got = timeline.align_speakers(spoken(spark, text, pauses=pauses), turns(spark, spans))
    assert [s for s, _ in texts(got)] == [0, 1, 0]


def _fold(segments):
    """Sliver absorption written as a plain loop."""
    import re

    def wobble(p, s, n):
        near = p[-2:] + s + n[:2]
        return 0 < len(s) <= 5 and s[-1][2] - s[0][1] <= 2.0 and not any(re.search(r"[.?!][\"')\]]?$", w[0]) for w in near) and all(b[1] - a[2] <= 0.5 for a, b in zip(near, near[1:], strict=False))

    out, i = [], 0
    while i < len(segments):
        if out and i + 1 < len(segments):
            p, s, n = out[-1], segments[i], segments[i + 1]
            if p[0] is not None and p[0] == n[0] and s[0] != p[0] and wobble(p[1], s[1], n[1]):
                out[-1] = (p[0], p[1] + s[1] + n[1])
                i += 2
                continue
        out.append(segments[i])
        i += 1
    return out


def test_absorption_equals_the_plain_fold(spark):
    draw = random.Random(5)
    rows, want = [], {}
    for meeting in range(12):
        at, own, last = 0.0, [], object()
        for k in range(draw.randint(1, 14)):
            speaker = draw.choice([s for s in (None, 0, 1, 2) if s != last])
            last, said = speaker, []
            for _ in range(draw.randint(1, 7)):
                at += draw.choice([0.1, 0.1, 0.2, 0.7])
                said.append((draw.choice(["a", "b", "c.", "d"]), round(at, 3), round(at + 0.2, 3)))
                at += 0.2
            own.append((speaker, said))
            rows.append((meeting, k, speaker, said))
        want[meeting] = [(s, [w[0] for w in said]) for s, said in _fold(own)]
    df = spark.createDataFrame(rows, f"meeting_id int, seg_idx int, speaker_num int, words {WORDS}")
    got = {}
    for r in timeline.absorb_slivers(df).orderBy("meeting_id", "seg_idx").collect():
        got.setdefault(r.meeting_id, []).append((r.speaker_num, [w.text for w in r.words]))
    assert got == want


@pytest.mark.parametrize(
    ("tokens", "want"),
    [
        ([(" A", 0), ("sk", 0.24), (" not", 0.4), (" what", 0.64), (",", 0.8)], [("Ask", 0, 0.4), ("not", 0.4, 0.64), ("what,", 0.64, 0.96)]),
        ([(" report", 10), (" Thanks", 11.7)], [("report", 10, 10.32), ("Thanks", 11.7, 12.02)]),
        ([(" a", 1), (" b", 1.16)], [("a", 1, 1.16), ("b", 1.16, 1.48)]),
        ([(" June", 5), (".", 8.4), (" Next", 9)], [("June.", 5, 5.32), ("Next", 9, 9.32)]),
        ([(" A", 0), ("sk", 0.24)], [("Ask", 0, 0.56)]),
        ([(" a", 1), (" ", 1.1), (" b", 3)], [("a", 1, 1.1), ("b", 3, 3.32)]),
        ([], []),
    ],
)
def test_tokens_to_words(spark, tokens, want):
    df = spark.createDataFrame([(1, i, t, float(ts)) for i, (t, ts) in enumerate(tokens)], "meeting_id int, i int, token string, ts double")
    got = [(r.text, round(r.start, 6), round(r.end, 6)) for r in timeline.tokens_to_words(df).orderBy("word_idx").collect()]
    assert got == [(t, float(a), float(b)) for t, a, b in want]


def test_overlap_and_nearest_match_brute_force(spark):
    draw = random.Random(2)
    w = [(m, i, "x", a := draw.uniform(0, 60), a + draw.choice([0, 0.3, 2])) for m in range(3) for i in range(40)]
    t = [(m, i, a := float(draw.randint(0, 60)), a + draw.randint(0, 8), draw.randint(0, 3)) for m in range(3) for i in range(12)]
    got = timeline.assign_speakers(words(spark, w), spark.createDataFrame(t, "meeting_id int, turn_idx int, start double, end double, speaker_num int"))
    found = {(r.meeting_id, r.word_idx): r.speaker_num for r in got.collect()}
    for m, i, _, a, b in w:
        own = [x for x in t if x[0] == m]
        over = [(min(b, x[3]) - max(a, x[2]), -x[1], x[4]) for x in own]
        best = max(over)
        if best[0] > 0:
            assert found[m, i] == best[2]
        else:
            assert found[m, i] == min((abs((a + b) / 2 - (x[2] + x[3]) / 2), x[1], x[4]) for x in own)[2]


def test_words_to_runs_keeps_empty_runs(spark):
    w = words(spark, [(1, 0, "early", 0.1, 0.2), (1, 1, "a", 1.0, 1.1), (1, 2, "b", 3.0, 3.1)])
    runs = spark.createDataFrame([(1, 0, 0.5, 0.9), (1, 1, 1.0, 1.5), (1, 2, 2.0, 2.2), (1, 3, 3.0, 4.0)], "meeting_id int, run_idx int, start double, end double")
    got = {r.run_idx: [x.text for x in r.words] for r in timeline.words_to_runs(w, runs).collect()}
    assert got == {0: ["early"], 1: ["a"], 2: [], 3: ["b"]}


def test_pack_runs(spark):
    spans = [(0, 50), (60, 110), (115, 130), (140, 300), (301, 302)]
    runs = spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(spans)], "meeting_id int, run_idx int, start double, end double")
    assert [r.window_idx for r in timeline.pack_runs(runs).orderBy("run_idx").collect()] == [0, 0, 1, 2, 3]


def test_round_trip_segments_to_turns(spark):
    got = timeline.align_speakers(words(spark, [(1, 0, "a", 0.0, 0.4), (1, 1, "c", 2.0, 2.5)]), turns(spark, [(0, 1, 0), (1.8, 3, 1)]))
    assert [(r.start, r.end, r.speaker_num) for r in timeline.segments_to_turns(got).orderBy("turn_idx").collect()] == [(0.0, 0.4, 0), (2.0, 2.5, 1)]


def test_active_index(spark):
    row = spark.range(1).select(timeline.active_index(F.array(F.lit(1.0), F.lit(2.0)), F.lit(0.5)).alias("a"), timeline.active_index(F.array(F.lit(1.0), F.lit(2.0)), F.lit(2.0)).alias("b")).first()
    assert (row.a, row.b) == (-1, 1)


def test_transcribe_seam(spark):
    windows = spark.createDataFrame([(1, 0, 0.0, 10.0), (1, 1, 10.0, 20.0)], "meeting_id int, window_idx int, start double, end double")

    def decode(batches):
        for b in batches:
            for r in b.itertuples():
                import pandas as pd

                yield pd.DataFrame({"meeting_id": r.meeting_id, "window_idx": r.window_idx, "i": [0, 1], "token": [" he", "llo"], "ts": [1.0, 1.2]})

    got = [(r.word_idx, r.text, r.start) for r in timeline.transcribe(windows, decode).orderBy("word_idx").collect()]
    assert got == [(0, "hello", 1.0), (1, "hello", 11.0)]


def test_words_kept_shows_lost_and_added_words(spark):
    words = spark.createDataFrame([(m, i) for m, n in ((1, 3), (2, 2), (3, 1)) for i in range(n)], "meeting_id int, word_idx int")
    word = ("w", 0.0, 1.0)
    segments = spark.createDataFrame([(1, [word, word]), (1, [word]), (2, [word]), (4, [word])], "meeting_id int, words array<struct<text:string,start:double,end:double>>")
    found = {tuple(r) for r in timeline.words_kept(words, segments).collect()}
    assert found == {(1, 3, 3), (2, 2, 1), (3, 1, 0), (4, 0, 1)}


def plain_fold(segments):
    """Sliver absorption segment by segment, with all words at hand."""
    stop = lambda w: w[0][-1:] in ".?!"
    out, i = [], 0
    while i < len(segments):
        speaker, words = segments[i]
        if out and i + 1 < len(segments) and out[-1][0] is not None and out[-1][0] == segments[i + 1][0] != speaker and 0 < len(words) <= 5 and words[-1][2] - words[0][1] <= 2.0:
            near = out[-1][1][-2:] + words + segments[i + 1][1][:2]
            if not any(map(stop, near)) and all(y[1] - x[2] <= 0.5 for x, y in zip(near, near[1:], strict=False)):
                out[-1] = (out[-1][0], out[-1][1] + words + segments[i + 1][1])
                i += 2
                continue
        out.append((speaker, list(words)))
        i += 1
    return out


def test_sliver_fold_equals_the_plain_one_and_is_linear(spark):
    """Random short segments of one meeting, most of them slivers of each other; 10,000 in one meeting take seconds."""
    draw = random.Random(6)

    def meeting(n):
        at, segments = 0.0, []
        for _ in range(n):
            words = []
            for _ in range(draw.choice([0, 1, 1, 2, 3, 7])):
                at += draw.choice([0.0, 0.1, 0.1, 0.7])
                words.append((draw.choice(["a", "b", "c", "end.", "d"]), at, at + 0.2))
                at += 0.2
            segments.append((draw.choice([0, 0, 1, None]), words))
        return segments

    meetings = [meeting(40) for _ in range(30)] + [meeting(10_000)]
    rows = spark.createDataFrame([(m, i, p, w) for m, segments in enumerate(meetings) for i, (p, w) in enumerate(segments)], f"meeting_id int, seg_idx int, speaker_num int, words {WORDS}").repartition(3)
    began = time.perf_counter()
    got = timeline.absorb_slivers(rows).collect()
    assert time.perf_counter() - began < 60
    for m, segments in enumerate(meetings):
        own = sorted((r for r in got if r.meeting_id == m), key=lambda r: r.seg_idx)
        assert [(r.speaker_num, [tuple(w) for w in r.words]) for r in own] == plain_fold(segments) and [r.seg_idx for r in own] == list(range(len(own)))


def test_hits_of_a_long_segment(spark):
    """A segment of 1 MB with overlapping hits over word ends, against a search from every offset."""
    draw = random.Random(2)
    words = [draw.choice(["a", "aa", "aaa", "b", "Aé", "漢a"]) for _ in range(300_000)]
    rows = spark.createDataFrame([(1, 0, [(w, 0.0, 0.0) for w in words]), (1, 1, []), (2, 0, None)], f"meeting_id int, seg_idx int, words {WORDS}")
    began = time.perf_counter()
    got = talk.find_matches(rows, " a a ", ["meeting_id", "seg_idx"]).collect()
    assert time.perf_counter() - began < 60
    text = "".join(w.lower() + " " for w in words)
    places = [k for k, w in enumerate(words) for _ in range(len(w) + 1)]
    assert [(r.at, r["from"], r["to"]) for r in got] == [(i, places[i], places[i + 2]) for i in range(len(text)) if text.startswith("a a", i)]


def test_active_place(spark):
    points = spark.createDataFrame([(1, 0.5), (1, 1.0), (1, 9.0), (2, 3.0)], "meeting_id int, at double")
    items = spark.createDataFrame([(1, 0, 1.0), (1, 1, 1.0), (1, 2, 4.0)], "meeting_id int, place int, start double")
    got = timeline.active_place(points, items, "meeting_id", "at", "start", "place").collect()
    assert {(r.meeting_id, r.at): r.active for r in got} == {(1, 0.5): -1, (1, 1.0): 1, (1, 9.0): 2, (2, 3.0): -1}


def test_nearest_reads_no_frame_again(spark):
    # a frame up to the partition's end is read again for every row: quadratic in a meeting's rows
    points = spark.createDataFrame([(m, i, i * 0.7) for m in (1, 2) for i in range(40)], "meeting_id int, p int, mid double")
    anchors = spark.createDataFrame([(1, k, float(k // 2 * 5 % 31), k * 10) for k in range(12)], "meeting_id int, turn_idx int, mid double, grp int")
    got = timeline.nearest(points, anchors, "meeting_id", "mid", "turn_idx", "grp")
    held = anchors.collect()
    want = {(m, i): min(held, key=lambda a: (abs(a.mid - i * 0.7), a.turn_idx)).grp if m == 1 else None for m in (1, 2) for i in range(40)}
    assert {(r.meeting_id, r.p): r.grp for r in got.collect()} == want
    assert "unboundedfollowing" not in got._jdf.queryExecution().optimizedPlan().toString().lower()
