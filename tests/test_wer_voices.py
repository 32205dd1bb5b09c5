import random
import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.operators import voices, wer
from parley.schema import WORDS


def full_matrix(a, b):
    d = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j - 1] + (a[i - 1] != b[j - 1]), d[i - 1][j] + 1, d[i][j - 1] + 1)
    out, i, j = [], len(a), len(b)
    while i or j:
        if i and j and d[i][j] == d[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
            out.append(("match" if a[i] == b[j] else "sub", i, j))
        elif i and d[i][j] == d[i - 1][j] + 1:
            i -= 1
            out.append(("del", i, -1))
        else:
            j -= 1
            out.append(("ins", -1, j))
    return out[::-1]


def test_alignment_equals_full_matrix():
    draw = random.Random(11)
    for _ in range(200):
        a, b = ([f"w{draw.randint(0, 23)}" for _ in range(draw.randint(0, 59))] for _ in range(2))
        assert wer.align(a, b) == full_matrix(a, b)
    a, b = [str(i % 7) for i in range(300)], ["1", "2", "3", "9", "1"]
    assert wer.align(a, b) == full_matrix(a, b)


def test_alignment_of_long_texts():
    """25,000 words against 25,000: a transcript with every 100th word another, every 250th missing and every 333rd doubled."""
    draw = np.random.default_rng(1)
    a = draw.integers(0, 997, 25_000).astype(np.int32)
    b = [x for i, w in enumerate(a) for x in (() if i % 250 == 7 else (1000 if i % 100 == 0 else w, w) if i % 333 == 5 else (1000 if i % 100 == 0 else w,))]
    b = np.resize(np.array(b, dtype=np.int32), 25_000)
    tracemalloc.start()
    began = time.perf_counter()
    steps = wer.align_codes(a, b)
    assert time.perf_counter() - began < 60 and tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()
    assert (steps != 2).sum() == (steps != 1).sum() == 25_000
    at_a, at_b = np.cumsum(steps != 2) - 1, np.cumsum(steps != 1) - 1
    same = (steps == 0) & (a[np.maximum(at_a, 0)] == b[np.maximum(at_b, 0)])
    assert 24_600 < same.sum() < 24_800


@pytest.mark.parametrize(
    ("ref", "hyp", "s", "d", "i", "rate"),
    [
        ("the quick brown fox", "the quick brown fox", 0, 0, 0, 0.0), ("Hello, world!", "hello world", 0, 0, 0, 0.0), ("the quick brown fox", "the quick red fox", 1, 0, 0, 0.25),
        ("the quick brown fox", "the brown fox", 0, 1, 0, 0.25), ("the quick fox", "the very quick fox", 0, 0, 1, 1 / 3), ("the quick brown fox jumps", "a quick red fox", 2, 1, 0, 0.6),
        ("", "extra words here", 0, 0, 3, 1.0), ("", "", 0, 0, 0, 0.0),
    ],
)
def test_word_error_rate(spark, ref, hyp, s, d, i, rate):
    r = wer.word_error_rate(spark.createDataFrame([(1, ref, hyp)], "k int, ref string, hyp string"), "k", F.col("ref"), F.col("hyp")).first()
    assert (r.n_sub, r.n_del, r.n_ins) == (s, d, i) and abs(r.wer - rate) < 1e-12


def test_compare_and_limits(spark):
    row = (1, [("Hi,", 0.0, 0.5), ("you", 1.0, 1.5)], [("hi", 0.1, 0.5), ("two", 1.0, 1.5)])
    m = wer.compare_transcripts(spark.createDataFrame([row], f"k int, a {WORDS}, b {WORDS}"), "k", "a", "b")
    r = m.first()
    assert (r.n_match, r.n_sub, r.wer) == (1, 1, 0.5) and abs(r.p95_start_error - 0.1) < 1e-12
    assert wer.over_limits(m, wer=0.5, p95=0.5).count() == 0
    assert wer.over_limits(m, wer=0.0, p95=0.0).count() == 1


def vec(*xs, n=8):
    v = np.zeros(n, dtype=np.float32)
    v[: len(xs)] = xs
    return v.tolist()


def test_agglomerate_like_the_plain_loop():
    def plain(vs, ws, threshold):
        c, m = [np.array(v, dtype=np.float32) for v in vs], [[i] for i in range(len(vs))]
        w = list(ws)
        while True:
            best, pair = threshold, None
            for i in range(len(c)):
                for j in range(i + 1, len(c)):
                    a, b = c[i].astype(float), c[j].astype(float)
                    sim = a @ b / (np.linalg.norm(a) * np.linalg.norm(b) or 1)
                    if sim >= best:
                        best, pair = sim, (i, j)
            if pair is None:
                break
            i, j = pair
            c[i] = ((c[i].astype(float) * w[i] + c[j].astype(float) * w[j]) / (w[i] + w[j])).astype(np.float32)
            w[i] += w[j]
            m[i] += m[j]
            del c[j], w[j], m[j]
        return [next(g for g, x in enumerate(m) if k in x) for k in range(len(vs))]

    draw = np.random.default_rng(0)
    for _ in range(20):
        vs = draw.normal(size=(9, 4)).tolist()
        ws = draw.uniform(1, 5, 9).tolist()
        assert voices.agglomerate(vs, ws, 0.5) == plain(vs, ws, 0.5)


def test_nearest_person_in_blocks(spark):
    draw = np.random.default_rng(1)
    people = [(i, draw.normal(size=6).astype("float32").tolist()) for i in range(60)] + [(60, [0.0] * 6)]
    asked = [(i, draw.normal(size=6).astype("float32").tolist()) for i in range(40)] + [(40, [0.0] * 6)]
    got = voices.nearest_person(spark.createDataFrame(asked, "query_id long, embedding array<float>"), spark.createDataFrame(people, "id int, voice_embedding array<float>").repartition(3), block=7)
    found = {r.query_id: r.person_id for r in got.collect()}
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1)
    for q, v in asked:
        d = [1 - unit(v) @ unit(p) for _, p in people]
        assert found.get(q) == (int(np.argmin(d)) if min(d) < 0.45 and q != 40 else None)


def test_identity_sees_people_added_before(spark):
    speakers = [(1, 0, vec(1)), (1, 1, vec(0, 1)), (2, 0, vec(0.1, 1)), (2, 1, vec(0, 0, 1))]
    people = spark.createDataFrame([(7, "Ann", vec(1, 0.1))], "id int, name string, voice_embedding array<float>")
    resolved, new = voices.resolve_people(spark.createDataFrame(speakers, "meeting_id int, speaker_num int, centroid array<float>"), people)
    assert {(r.meeting_id, r.speaker_num): r.person_id for r in resolved.collect()} == {(1, 0): 7, (1, 1): 8, (2, 0): 8, (2, 1): 9}
    assert sorted(r.id for r in new.collect()) == [8, 9]


def sequential(speakers, people, limit=0.45):
    """The rule itself: one speaker after the other, each sees whom those before it added."""
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1)
    ids, units = [i for i, _ in people], [unit(v) for _, v in people]
    out = {}
    for key, v in sorted(speakers, key=lambda s: s[0]):
        d = np.round(1 - np.array(units) @ unit(v), 12) if units else np.array([9.0])
        at = min(np.flatnonzero(d == d.min()), key=lambda i: ids[i]) if units else 0
        if d[at] >= limit:
            ids.append(max(ids, default=0) + 1)
            units.append(unit(v))
            at = len(ids) - 1
        out[key] = ids[at]
    return out


@pytest.mark.parametrize(("n", "voices_", "at_once"), [(2000, 60, 300), (2000, 700, 2048), (150, 150, 7)])
def test_identity_equals_the_sequential_rule(spark, n, voices_, at_once):
    """Speakers of a few stored and many new voices, one voice a third of all, some close to two people."""
    draw = np.random.default_rng(n + voices_)
    centres = draw.normal(size=(voices_, 12))
    people = [(i + 3, (centres[i] + draw.normal(size=12) * 0.2).astype(np.float32).tolist()) for i in range(voices_ // 5)]
    voice = np.where(draw.random(n) < 1 / 3, voices_ - 1, draw.integers(0, voices_, n))
    speakers = [((int(k) // 7, int(k) % 7), (centres[v] + draw.normal(size=12) * 0.5).astype(np.float32).tolist()) for k, v in zip(draw.permutation(n), voice, strict=True)]
    given = spark.createDataFrame([(*k, v) for k, v in speakers], "meeting_id int, speaker_num int, centroid array<float>").repartition(5)
    known = spark.createDataFrame([(i, "p", v) for i, v in people], "id int, name string, voice_embedding array<float>")
    resolved, new = voices.resolve_people(given, known, at_once=at_once)
    want = sequential(speakers, people)
    assert {(r.meeting_id, r.speaker_num): r.person_id for r in resolved.collect()} == want
    assert sorted(r.id for r in new.collect()) == sorted(set(want.values()) - {i for i, _ in people})


def test_nearest_person_skips_blocks_and_loses_nothing(spark):
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(30, 48))
    people = [(i, (centres[i % 30] + draw.normal(size=48) * 0.1).astype(np.float32).tolist()) for i in range(3000)] + [(3000, [0.0] * 48), (3001, [0.0] * 48)]
    people += [(3002 + i, people[i][1]) for i in range(40)]  # equal voices: the least id wins
    rows = spark.createDataFrame(people, "id long, voice_embedding array<float>").repartition(4)
    asked = rows.filter("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("voice_embedding").alias("embedding"))
    units = np.array([np.array(v) / (np.linalg.norm(v) or 1) for _, v in people])
    for others in (False, True):
        got = {r.query_id: (r.person_id, r.distance) for r in voices.nearest_person(asked, rows, max_distance=3.0, block=64, others_only=others).collect()}
        assert len(got) == 61
        for i, (p, d) in got.items():
            every = np.round(1 - units @ units[i], 12)
            if others:
                every[i] = np.inf
            assert d == pytest.approx(every.min(), abs=1e-9) and p == int(np.flatnonzero(every <= every.min() + 1e-12)[0])
    share = voices.share_skipped(asked, rows, max_distance=3.0, block=64).first()
    assert share.every == 61 * 3042 and share.skipped > 0.7, share
    assert voices.nearest_person(asked.limit(0), rows).count() == 0 and voices.nearest_person(asked, rows.limit(0)).count() == 0


def test_agglomerate_is_quadratic_and_handles_ties():
    draw = np.random.default_rng(2)
    n = 1200
    near = (draw.normal(size=(40, 16))[draw.integers(0, 40, n)] + draw.normal(size=(n, 16)) * 0.15).tolist()
    began = time.perf_counter()
    groups = voices.agglomerate(near, [1.0] * n, 0.5)
    assert time.perf_counter() - began < 20 and 20 <= max(groups) + 1 <= 60
    assert voices.agglomerate([[1.0, 0.0]] * 4, [1.0] * 4) == [0] * 4 and voices.agglomerate([], []) == []
    assert voices.agglomerate([[1, 0], [0, 1], [1, 0], [0, 1]], [1] * 4, 1.0) == [0, 1, 0, 1]


def test_merge_speakers(spark):
    rows = [(1, 0, 0.0, 2.0, 5, vec(1)), (1, 1, 3.0, 6.0, 6, vec(0, 1)), (1, 2, 7.0, 9.0, 7, vec(1, 0.1)), (1, 3, 9.0, 9.5, 8, vec(0, 0, 1)), (2, 0, 0.0, 1.0, 3, vec(1))]
    got = voices.merge_speakers(spark.createDataFrame(rows, "meeting_id int, turn_idx int, start double, end double, speaker_num int, embedding array<float>"))
    # 5 and 7 merge (4.5 s with the orphan 8 next to it), 6 has 3 s; meeting 2 has no voiceprint
    assert {(r.meeting_id, r.turn_idx): r.speaker_num for r in got.collect()} == {(1, 0): 0, (1, 1): 1, (1, 2): 0, (1, 3): 0, (2, 0): 0}


def test_centroid_of_longest_turns(spark):
    rows = [(1, i, 0.0, s, 0, vec(float(i))) for i, s in enumerate([1.0, 2.0, 5.0, 2.0, 2.0])]
    got = voices.speaker_centroids(spark.createDataFrame(rows, "meeting_id int, turn_idx int, start double, end double, speaker_num int, embedding array<float>")).first()
    assert got.centroid[0] == 2.0  # turns 2, 1 and 3
