import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from parley.llm import queries
from parley.llm import suffix_dedup as op


def brute(texts, threshold):
    """(n_bytes, n_removed, n_spans, kept) of each text by the definition: every string of the length, counted."""
    data = [(t or "").encode() for t in texts]
    counts = collections.Counter(d[i : i + threshold] for d in data for i in range(len(d) - threshold + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - threshold + 1):
            if counts[d[i : i + threshold]] > 1:
                gone[i : i + threshold] = b"\1" * threshold
        runs = [x for x in bytes(gone).split(b"\0") if x]
        out.append((len(d), sum(gone), len(runs), bytes(b for b, g in zip(d, gone, strict=True) if not g)))
    return out


def corpus(seed, n, threshold):
    """Texts with copies, near copies, shared passages of about the threshold's length, runs of one letter and periods."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcé漢") for _ in range(draw.randint(1, 6)))
    prose = lambda k: " ".join(word() for _ in range(k))
    shared = [prose(3 * threshold)[: threshold + d] for d in (-1, 0, 1, 5, threshold)]
    texts = [None, "", "a", "x" * (3 * threshold), "ab" * threshold, "abc" * (2 * threshold)]
    for _ in range(n):
        kind = draw.randrange(6)
        if kind == 0 and len(texts) > 9:
            texts.append(draw.choice(texts[6:]))
        elif kind == 1 and len(texts) > 9:
            t = draw.choice(texts[6:]) or "q"
            at = draw.randrange(len(t))
            texts.append(t[:at] + draw.choice(["", "Q", prose(2)]) + t[at + draw.randint(0, 3) :])
        elif kind == 2:
            texts.append(prose(4) + draw.choice(shared) + prose(draw.randint(0, 9)) + draw.choice(shared))
        elif kind == 3:
            own = prose(threshold // 2)
            texts.append(own + prose(3) + own)  # repeats within itself
        else:
            texts.append(prose(draw.randint(1, threshold)))
    return texts


def run(spark, texts, **kind):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return {r.doc_id: r for r in op.remove_repeats(rows, **kind).collect()}


@pytest.mark.parametrize(("threshold", "start"), [(40, None), (40, 10), (40, 13), (200, 50), (200, None), (7, 1)])
def test_equals_brute_force(spark, threshold, start):
    texts = corpus(threshold + (start or 0), 150, threshold)
    got = run(spark, texts, threshold=threshold, start=start)
    want = brute(texts, threshold)
    assert len(got) == len(texts) and any(0 < w[1] < w[0] for w in want)
    for i, w in enumerate(want):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, bytes(got[i].kept)) == w
        assert sum(s.end - s.start for s in got[i].spans) == w[1] and len(got[i].spans) == w[2]


def test_segments_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(op, "SEGMENT", 300)
    texts = corpus(3, 60, 40) + ["word " * 1500, "".join(random.Random(1).choices("ab ", k=6000))]
    rows = list(enumerate((t or "").encode() for t in texts))
    whole = []
    for raw, part, row, offset, begin in op._batches(iter(rows), 40):
        name, whole_name, lo, n = op.blocks_of(raw, part, 20, 40)
        assert len(name) == len(whole_name)
        whole += [(int(row[part[a]]), int(a - begin[part[a]] + offset[part[a]]) + d) for a, k in zip(lo, n, strict=True) for d in range(k)]
    assert sorted(whole) == [(i, p) for i, d in rows for p in range(len(d) - 39)]  # every position in one block


def test_repeated_rows_over_many_tasks(spark):
    rows = spark.createDataFrame([(7 if i % 3 else i, 1, i) for i in range(3000)], "a long, b long, tid long")
    spark.conf.set("spark.sql.shuffle.partitions", "61")
    try:
        got = {r.tid for r in op.repeated(rows.repartition(4), ["a", "b"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == {i for i in range(3000) if i % 3}


def test_query_over_the_table(spark, tmp_path):
    texts = corpus(8, 120, 200)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op13_suffix_dedup"](spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(len(texts))] == [(n, gone, runs, hashlib.sha256(kept).hexdigest()) for n, gone, runs, kept in brute(texts, 200)]


def test_awkward_and_empty(spark, awkward, nothing):
    got = op.remove_repeats(awkward, show=lambda c: F.sha2(c, 256)).collect()
    assert len(got) == awkward.count()
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert all(r.n_removed == 0 for r in by[1] + by[2] + by[3]) and by[3][0].n_bytes == 0
    assert by[7][0].n_bytes > by[7][0].n_removed - 1 > 0  # it repeats itself
    assert op.remove_repeats(nothing).collect() == []
    long = "".join(random.Random(2).choices("abcdefgh ", k=2_500_000))
    got = run(spark, [long, long[1_000_000:1_000_500], "#" + long[-199:]])
    assert [(got[i].n_removed, got[i].n_spans) for i in range(3)] == [(500, 1), (500, 1), (0, 0)]
