import random

from parley.llm import decontamination as op
from parley.llm.common import shingles
from parley.llm.near_dedup import weighted_jaccard


def brute(docs, items, similarity=0.8):
    """All windows of every item's length, compared exactly."""
    out = {}
    for d, text in docs:
        words = (text or "").split()
        for i, item in items:
            n = len((item or "").split())
            if not n or not words:
                continue
            own = shingles([item])[0]
            size = min(n, len(words))
            best = max(weighted_jaccard(shingles([" ".join(words[k : k + size])])[0], own) for k in range(len(words) - size + 1))
            if best >= similarity:
                out[d, i] = round(best, 6)
    return out


def data():
    draw = random.Random(1)
    vocabulary = [f"v{i}" for i in range(80)]
    say = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    items = [(i, say(draw.randint(15, 40))) for i in range(20)] + [(20, "tiny item"), (21, "again again again again again again again"), (22, None), (23, " ")]
    docs = []
    for d in range(60):
        words = say(draw.randint(0, 120)).split()
        if d % 3 == 0:
            own = draw.choice(items[:22])[1].split()
            if d % 6 == 0 and len(own) > 10:
                own[draw.randint(0, 1) * -1] = "changed"
            at = draw.randint(0, len(words))
            words[at:at] = own
        if d % 7 == 0:
            words = draw.choice(items[:20])[1].split()[:-1]  # shorter than the item
        docs.append((d, " ".join(words)))
    return docs, items


def test_equals_brute_force(spark):
    docs, items = data()
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    for passes in (20_000, 7):
        got = {(r.doc_id, r.item_id): round(r.similarity, 6) for r in op.find_leaks(d, b, items_per_pass=passes).collect()}
        assert got == want
    assert len(want) > 15
    kept = {r.doc_id for r in op.drop_leaks(d, b).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in want}


def test_blocks_find_every_fingerprint_within_the_radius():
    draw = random.Random(2)
    index = op.ItemIndex(list(range(50)), [" ".join(str(draw.random()) for _ in range(12)) for _ in range(50)])
    (words,) = [n for n in index.prints if len(index.prints[n]) > 5][:1] or [max(index.prints, key=lambda n: len(index.prints[n]))]
    own = [int(x) for x in index.prints[words]]
    import numpy as np

    for _ in range(200):
        near = own[draw.randrange(len(own))]
        for bit in draw.sample(range(64), draw.randint(0, 30)):
            near ^= 1 << bit
        want = {index.items[words][k] for k, x in enumerate(own) if bin(x ^ near).count("1") <= index.radius}
        assert {i for _, i, _ in index.candidates(words, np.array([near], dtype=np.uint64))} == want


def test_case_and_punctuation_do_not_hide_a_leak(spark):
    item = "The quick brown fox jumps over the lazy dog, and then it sleeps for hours"
    docs = spark.createDataFrame([(1, "Intro text! " + item.upper().replace(",", " --") + " The end.")], "doc_id long, text string")
    assert op.find_leaks(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).first().item_id == 7


def test_awkward_and_empty(spark, awkward, nothing):
    b = spark.createDataFrame([(1, "Plain words of a short document. It has two lines.", "x"), (None, None, None)], "item_id long, text string, similarity string")
    got = op.find_leaks(awkward, b).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 1)] * 3 + [(8, 1)]
    assert op.drop_leaks(awkward, b).count() == awkward.count() - 4
    assert op.find_leaks(nothing, b).count() == 0 and op.find_leaks(awkward, b.limit(0)).count() == 0
    assert op.drop_leaks(awkward, b.limit(0)).exceptAll(awkward).count() == 0
