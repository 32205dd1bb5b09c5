import random

import numpy as np

from parley.llm import quality_classifier as op


def corpus(n, seed):
    """Grade 2 plain, 1 with an insult or shouting, 0 with both."""
    draw = random.Random(seed)
    words = [f"{draw.choice('bcdfgklmnprst')}{draw.choice('aeiou')}{draw.choice('bcdfgklmnprst')}" for _ in range(400)]
    rows = []
    for i in range(n):
        text, grade = [draw.choice(words) for _ in range(draw.randint(20, 200))], 2
        if i % 4 == 1:
            text[draw.randrange(len(text))] = draw.choice(["zzmoron", "zzscum", "zzidiot"])
            grade -= 1
        text = " ".join(text)
        if i % 5 == 2:
            text, grade = text.upper() + "!!", grade - 1
        rows.append((i, text, grade))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(3000, 1)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(4)
    known = spark.createDataFrame([(i, g) for i, _, g in rows if i % 3], "doc_id long, grade int")
    model = op.train(docs, known)
    assert (np.diff(model.thresholds) > 0).all()
    got = {r.doc_id: r for r in op.score(docs, model).collect()}
    assert len(got) == 3000
    held = [(g, got[i]) for i, _, g in rows if i % 3 == 0]
    good, bad = [r.p_top >= op.LEAST for g, r in held if g == 2], [r.p_top >= op.LEAST for g, r in held if g < 2]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.1
    means = [np.mean([r.expected_grade for g, r in held if g == k]) for k in range(3)]
    assert means == sorted(means)


def test_descent_lowers_an_independent_loss():
    """The likelihood, computed here on its own, rises with the epochs."""
    draw = np.random.default_rng(2)
    rows = [np.unique(draw.integers(0, 50, 12)) for _ in range(300)]
    grades = np.array([min(2, int((r < 10).sum())) for r in rows])

    def loss(m):
        f = np.array([m.weights[r].sum() for r in rows])
        edge = np.concatenate([np.full((300, 1), -50.0), m.thresholds[None, :] - f[:, None], np.full((300, 1), 50.0)], axis=1)
        cdf = 1 / (1 + np.exp(-edge))
        return -np.log(np.maximum(cdf[np.arange(300), grades + 1] - cdf[np.arange(300), grades], 1e-12)).mean()

    size = (1 << op.BITS) + op.SHAPES * op.BINS
    flat, at = np.concatenate(rows), np.r_[0, np.cumsum([len(r) for r in rows])]
    losses = [loss(op._descend(flat, at, grades, size, epochs=n, step=0.1, penalty=0.0, batch=64)) for n in (1, 5, 40)]
    assert losses[0] > losses[1] > losses[2] and losses[2] < 0.5 * losses[0]


def test_select_keeps_columns(awkward):
    model = op.Ordinal(np.zeros((1 << op.BITS) + op.SHAPES * op.BINS), np.array([-50.0]))
    assert op.select_rows(awkward, model).exceptAll(awkward).count() == 0 and op.select_rows(awkward, model).count() == awkward.count()


def test_awkward_labels_and_empty(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (4, 1, 1), (None, 1, 0), (5, None, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    model = op.train(awkward, op.grades(labels))
    assert op.score(awkward, model).count() == awkward.count()
    none = op.train(nothing, op.grades(labels))
    assert op.score(nothing, none).count() == 0
    assert op.score(awkward, op.train(awkward, op.grades(labels.limit(0)))).filter(f"p_top < {op.LEAST}").count() == 0
