import math
import pickle
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from parley.llm import suffix_tree_lm as op


def corpus(n, seed=4):
    draw = random.Random(seed)
    syllables = ["ka", "to", "ri", "Me", "so", "ß", "nu"]
    return [(i, " ".join("".join(draw.choice(syllables) for _ in range(draw.randint(1, 5))) for _ in range(draw.randint(0, 60)))) for i in range(n)]


def base(rows):
    tokens = {i: (t or "").encode().lower().split() for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    c, ends = Counter(), 0
    for i, t in tokens.items():
        if not held[i]:
            c.update(t)
            ends += 1
    n, v = sum(c.values()) + ends, len(c) + (ends > 0)
    log = lambda k: math.log10((k + 1) / (n + v + 1))
    return {i: (held[i], len(t) + 1, sum(c[w] > 0 for w in t) + (ends > 0), n, sum(log(c[w]) for w in t) + log(ends)) for i, t in tokens.items()}


def test_base_scores_equal_brute_force(spark):
    rows = corpus(200)
    for alphabet, head in ((5, 5), (5, 40), (10_000, 5)):  # with and without words outside the alphabet, and outside the head
        got = op.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), alphabet=alphabet, head_words=head, least_gain=2.0).collect()
        want = base(rows)
        assert len(got) == 200
        for r in got:
            w = want[r.doc_id]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4] and abs(r.base_score - w[4]) < 1e-6


def phrases(n, seed=3):
    """Texts of fixed phrases and loose words, so that contexts of one and two words tell something."""
    draw = random.Random(seed)
    loose = [f"w{i}" for i in range(40)]
    fixed = [" ".join(draw.choice(loose) for _ in range(4)) for _ in range(12)]
    return [(i, " ".join(draw.choice(fixed) if draw.random() < 0.6 else draw.choice(loose) for _ in range(draw.randint(0, 12)))) for i in range(n)]


def plain_tree(texts, alphabet, discount, entry_cost, least):
    """Contexts, test and smoothing redone with dictionaries; p(context, symbol) of the longest kept suffix, and the open mass of the root."""
    words = Counter(w for t in texts for w in t)
    own = {w for w, _ in sorted(words.items(), key=lambda x: -x[1])[:alphabet]}
    streams = [["$", *[w if w in own else "?" for w in t], "$"] for t in texts]
    counts = [{}, {}, {}]
    for s in streams:
        for i in range(1, len(s)):
            for d in (0, 1) if i == 1 else (0, 1, 2):
                counts[d].setdefault(tuple(s[i - d : i]), Counter())[s[i]] += 1
    n, v = sum(counts[0][()].values()), len(words) + (len(texts) > 0)
    root = lambda x: (counts[0][()][x] + (v if x == "?" else 0)) / (n + v)
    kept, stored = {(): None}, {}  # open mass and shares of the stored symbols

    def p(ctx, x):
        if not ctx:
            return root(x)
        mass, shares = kept[ctx]
        return shares.get(x, 0) + mass * p(ctx[1:], x)

    for d in (1, 2):
        for ctx, c in counts[d].items():
            if ctx[1:] in kept and (d == 1 or (ctx[0],) in stored and ctx[1] in stored[ctx[0],]):
                total = sum(c.values())
                shares = {x: (k - discount) / total for x, k in c.items() if k > 1 and k * math.log((k - discount) / total / p(ctx[1:], x)) >= entry_cost}
                stored[ctx] = shares
                mass, gain = 1 - sum(shares.values()), sum(c[x] * math.log(y / p(ctx[1:], x)) - entry_cost for x, y in shares.items())
                if shares and gain + (total - sum(c[x] for x in shares)) * math.log(mass) >= least:
                    kept[ctx] = mass, shares
    return own, kept, p


def test_scores_equal_a_plain_tree(spark):
    rows, options = phrases(200), {"discount": 0.7, "entry_cost": 1.0, "least_gain": 3.0}
    train = [t.split() for i, t in [*rows, rows[3]] if zlib.crc32(str(i).encode()) % 7 != 2]
    own, kept, p = plain_tree(train, 100, *options.values())
    assert {len(c) for c in kept} == {0, 1, 2} and 20 < len(kept) < 400
    docs = spark.createDataFrame([*rows, rows[3]], "doc_id long, text string").repartition(3)
    for head in (0, 40, 1 << 20):  # whatever the head holds, every kept context scores; equal rows keep equal scores
        got = op.score(docs, head_keys=head, **options).collect()
        assert len(got) == 201
        for r in got:
            s, total = ["$", *dict(rows)[r.doc_id].split(), "$"], 0.0
            if set(s) - own - {"$"}:
                continue  # spelled words have their own test
            for i in range(1, len(s)):
                ctx = next(c for c in ((s[i - 2], s[i - 1]) if i > 1 else None, (s[i - 1],), ()) if c in kept)
                total += math.log10(p(ctx, s[i]))
            assert abs(r.score - total) < 1e-3 * max(1, abs(total))


def test_spelling(spark):
    """Runs of symbols are read from the bytes before, and every distribution sums to one."""
    (chunk,) = op.chunks(pa.array(["ab ab", "", "ba"]))
    table = np.zeros(256, dtype=np.uint8)
    table[[97, 98]] = 1, 2
    letters = op.Alphabet(op.Lookup(np.empty(0, dtype=np.int64)), np.empty(0, dtype=np.int64), 1, 0, 0, 0, table, np.zeros(256))
    codes, raw, word = letters.spelled(chunk, np.array([1, 2]))
    runs = [tuple(int(c) >> 6 * k & 63 for k in (3, 2, 1, 0)) for c in codes]
    assert runs == [(1, 2, 0, 1), (2, 0, 1, 2), (0, 1, 2, 0), (0, 0, 0, 2), (0, 0, 2, 1), (0, 2, 1, 0)]
    assert raw.tolist() == [97, 98, 0, 98, 97, 0] and word.tolist() == [1, 1, 1, 2, 2, 2]
    draw = np.random.default_rng(2)
    tree = op.make_spelling(*np.unique(draw.integers(0, 8, 40_000) << 6 | draw.integers(0, 3, 40_000) << 12 | draw.integers(0, 2, 40_000), return_counts=True))
    assert np.allclose((10.0 ** tree.log).sum(axis=1), 1, atol=1e-4)


def test_lookup_and_bitmap(spark):
    draw = np.random.default_rng(5)
    keys = np.unique(draw.integers(-(1 << 62), 1 << 62, 5000))
    for spread in (False, True):
        own = keys[op.Lookup.order(keys, spread)]
        found = pickle.loads(pickle.dumps(op.Lookup(own, spread)))
        asked = np.r_[keys, draw.integers(-(1 << 62), 1 << 62, 5000)]
        at = found.find(asked)
        assert (at[:5000] >= 0).all() and (own[at[:5000]] == keys).all() and ((at >= 0) == np.isin(asked, keys)).all()
    bits = op.bitmap(spark.createDataFrame([(int(k),) for k in keys[:300]], "key long"))
    assert op.may_hold(bits, keys[:300]).all() and op.may_hold(bits, keys[300:]).sum() < 10


def test_held_out_scores_beat_the_base(spark):
    """On texts of phrases, and on the documents of sf0.1, a token is likelier than the base says; on each side by a margin."""
    docs = spark.createDataFrame(phrases(600), "doc_id long, text string")
    total = op.score(docs).filter("held_out").groupBy().sum("score", "base_score", "n_tokens").first()
    assert total[0] > total[1] + 0.2 * total[2]
    held = op.score(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).filter("held_out").groupBy().sum("score", "base_score", "n_tokens").first()
    assert held[0] > held[1] + 0.1 * held[2]


def test_awkward_and_empty(spark, awkward, nothing):
    got = op.score(awkward).collect()
    assert len(got) == awkward.count() and all(r.score <= 0 for r in got)
    one = [r for r in got if r.doc_id == 1]
    assert len(one) == 3 and len({(r.score, r.base_score) for r in one}) == 1
    assert {r.n_tokens for r in got if r.doc_id in (2, 3, 6)} == {1}
    assert op.score(nothing).count() == 0
    words = " ".join(f"{i % 5003:x}" for i in range(900_000))  # one very long text
    assert op.score(spark.createDataFrame([(1, words)], "doc_id long, text string")).first().n_tokens == 900_001
