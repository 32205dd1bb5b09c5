import random
from collections import defaultdict

import numpy as np
import pytest

from parley.llm import near_dedup as op
from parley.llm.common import shingles


def brute(rows):
    """Class of each id from all pairs."""
    bags, parent = shingles([t for _, t in rows]), list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(bags[i]) and len(bags[j]) and op.weighted_jaccard(bags[i], bags[j]) >= 0.8:
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[root(i)].append(d)
    return {d: min(own) for own in least.values() for d in own}


def corpus():
    draw = random.Random(6)
    say = lambda n: [f"w{draw.randint(0, 5000)}" for _ in range(n)]
    rows, base = [], say(150)
    for k in range(60):  # a family with many degrees of change
        words = list(base)
        for _ in range(draw.choice([0, 1, 2, 3, 5, 9, 15])):
            words[draw.randrange(len(words))] = f"x{draw.randint(0, 99)}"
        rows.append((1000 + k, " ".join(words)))
    for k in range(120):
        words = say(draw.randint(1, 200))
        rows.append((k, " ".join(words)))
        if k % 3 == 0:
            words.insert(draw.randint(0, len(words)), "extra")
            rows.append((300 + k, " ".join(words) + " !!"))
    rows += [(5000 + k, "Short text") for k in range(4)] + [(6000, "same same same same same same"), (6001, "same same same same same same same")]
    return rows


@pytest.mark.parametrize("block_rows", [512, 8])
def test_classes_equal_brute_force(spark, block_rows):
    rows = corpus()
    got = {r.doc_id: r.class_id for r in op.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), block_rows=block_rows).collect()}
    want = brute(rows)
    assert got == want
    assert max(np.unique(list(want.values()), return_counts=True)[1]) > 8  # the family is larger than a block


def test_signatures_are_unbiased():
    draw = np.random.default_rng(3)
    a = np.repeat(draw.integers(1, 2**63, 200).astype(np.uint64), draw.integers(1, 9, 200))
    b = np.concatenate([a[:500], draw.integers(1, 2**63, 300).astype(np.uint64)])
    true = op.weighted_jaccard(a, b)
    x, y = op.signatures([op.multiset(a), op.multiset(b)], 4000)
    assert abs((x == y).mean() - true) < 4 * (true * (1 - true) / 4000) ** 0.5


def test_signatures_do_not_depend_on_company():
    draw = np.random.default_rng(5)
    bags = [op.multiset(draw.integers(1, 2**63, n).astype(np.uint64)) for n in (1, 3, 700, 40)]
    whole = op.signatures(bags)
    assert all((op.signatures([b])[0] == row).all() for b, row in zip(bags, whole, strict=True))


def test_weights_count(spark):
    a, b = "again " * 30, "again " * 60
    got = {r.doc_id: r.class_id for r in op.near_duplicates(spark.createDataFrame([(1, a), (2, b), (3, a.upper())], "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_components_of_a_chain(spark):
    key = lambda i: f"{i:04d}".encode()
    links = [(key(i), key(i + 1)) for i in range(60) if i != 30] + [(key(7), key(7))]
    got = {r.key: r["class"] for r in op.components(spark.createDataFrame(links, "a binary, b binary")).collect()}
    assert len(got) == 61 and len({bytes(got[key(i)]) for i in range(31)}) == 1 and len(set(map(bytes, got.values()))) == 2


def test_awkward_and_empty(awkward, nothing):
    got = op.near_duplicates(awkward).collect()
    assert len(got) == awkward.count()
    classes = {r.doc_id: r.class_id for r in got}
    assert classes[1] == 1 and classes[8] == 1 and classes[2] == 2 and classes[3] == 3 and classes[6] == 6 and classes[None] is None
    kept = op.keep_one(awkward)
    assert kept.schema == awkward.schema and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 7]
    assert op.near_duplicates(nothing).count() == 0 and op.keep_one(nothing).count() == 0


def test_one_id_for_two_texts(spark):
    rows = [(1, "a b c d e f g h"), (1, "q r s t u v w x"), (2, "q r s t u v w x")]
    got = sorted((r.doc_id, r.class_id) for r in op.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 1), (1, 1), (2, 1)]


def test_keep_one_of_each_text_of_an_id(spark):
    """A text without copies stays though its id also stands for another one."""
    rows = [(1, "a b c d e f g h", "x"), (1, "q r s t u v w x", "y"), (2, "q r s t u v w x", "z"), (1, "a b c d e f g h", "w"), (3, "", "v"), (3, None, "u")]
    kept = set()
    for parts in (1, 5):
        got = op.keep_one(spark.createDataFrame(rows, "doc_id long, text string, key string").repartition(parts)).collect()
        assert sorted((r.doc_id, r.text or "") for r in got) == [(1, "a b c d e f g h"), (1, "q r s t u v w x"), (3, "")]
        kept.add(frozenset((r.doc_id, r.text, r.key) for r in got))
    assert len(kept) == 1
