import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from parley.llm import quality_rules as op


def brute(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def data():
    draw = random.Random(7)
    texts = []
    for _ in range(300):
        words = [draw.choice(["a", "b", "c", "#x", "é😀", "Word", "<p>"]) for _ in range(draw.randint(0, 60))]
        texts.append("".join(w + draw.choice([" ", " ", "\n", "\t\x0b", "\r\n", "\x1c"]) for w in words))
    return texts + [None, "", "\n\n", "x " * 30_000]


def test_base_counts_equal_brute_force(spark):
    texts = data()
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for r in op.apply_rules(docs, labels).collect():
        n_words, *rest = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n_words, *rest)
        assert r.base_failed == (n_words < 10 or 100 * rest[3] > 20 * n_words)
        assert r.kept == (not r.base_failed)  # without labels nothing else is rejected


def test_binomial_tail_is_exact(spark):
    rows = [(k, n) for n in (1, 5, 100, 5000) for k in (0, 1, 2, 7, 90) if k <= n]
    got = spark.createDataFrame(rows, "k long, n long").select("k", "n", op.binomial_tail(F.col("k"), F.col("n"), 0.02).alias("p")).collect()
    for r in got:
        want = sum(math.exp(math.lgamma(r.n + 1) - math.lgamma(i + 1) - math.lgamma(r.n - i + 1) + i * math.log(0.02) + (r.n - i) * math.log(0.98)) for i in range(r.k + 1))
        assert r.p == 1.0 if r.k > 0.02 * r.n else abs(r.p - want) < 1e-9


def test_thresholds_limit_false_rejection(spark):
    draw = random.Random(1)
    rows = []
    for i in range(4000):
        bad, stratum = i % 10 == 0, "ab"[i % 2]
        words = [f"w{draw.randint(0, 10**6)}" for _ in range(40)]
        if bad or stratum == "b" and i % 7 == 1:  # in stratum b symbols are common in good rows
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words), stratum, 0 if bad else 1))
    docs = spark.createDataFrame([(i, t, s) for i, t, s, _ in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, _, q in rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in op.apply_rules(docs, labels).collect()}
    for s in "ab":
        good = [got[i].kept for i, _, x, q in rows if x == s and q]
        assert 1 - sum(good) / len(good) <= 0.02
    bad = [got[i].kept for i, _, x, q in rows if x == "a" and not q]
    assert not any(bad)
    assert all(got[i].kept for i, _, x, q in rows if x == "b" and not q)  # no safe cutoff there


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a b c", "en")], "doc_id long, text string, lang string")
    plan = op.features(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_awkward_and_empty(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, None, None)], "doc_id long, quality int, toxic int")
    got = op.apply_rules(awkward, labels).collect()
    assert len(got) == awkward.count() and next(r for r in got if r.doc_id == 3).n_words == 0
    assert op.apply_rules(nothing, labels.limit(0)).count() == 0
