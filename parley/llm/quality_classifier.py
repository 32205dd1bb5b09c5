"""Operator 6: ordinal cumulative-link regression on graded ratings.

A row's grade 0..K-1 follows P(grade <= k) = sigmoid(theta_k - f(text)): one
score f, linear in hashed words and a few binned shape features, is shared by
all grades, and the thresholds theta are ordered (each is the one before plus
an exponential). The fit is proximal Adagrad: the absolute-value penalty
leaves words without a consistent effect at zero, so a long text does not
collect noise. Scoring gives the expected grade and the probability of the top
grade, by which rows are kept.

The fit takes at most ``fit_rows`` labelled rows (a documented bound: those of
least hashed id) as feature ids, never as texts; every row is scored.

Defined cases: null or empty text has the shape features alone; null ids and
repeated rows are scored like any other; labels with a null grade are left
out, and of several labels for an id the lowest grade counts; without labels
of at least two grades every row gets the top grade; other columns are
ignored by ``score`` and kept by ``select_rows``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import columns, groups, word_hashes

BITS = 18
#: Least probability of the top grade for a row to be kept.
LEAST = 0.65
STEMS = (4, 5, 6)
SHAPES, BINS = 6, 12
_KINDS = np.zeros((4, 256), dtype=np.int64)
_KINDS[0, 65:91] = 1
_KINDS[1, 48:58] = 1
_KINDS[2, [ord(c) for c in "#*$%&|<>!{}[]=_~^\\/@"]] = 1
_KINDS[3, [9, 10, 11, 12, 13, 32]] = 1


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def features(texts: list[str | None], bits: int = BITS) -> list[np.ndarray]:
    """Distinct feature ids per text: hashed words and stems below 2**bits, then one bin for each shape."""
    h, first, *led = word_hashes(texts, STEMS)
    kinds = [(x >> np.uint64(64 - bits)).astype(np.int64) for x in (h, *led)]
    out = []
    for k, text in enumerate(texts):
        raw = np.frombuffer((text or "").encode("utf-8", "replace"), dtype=np.uint8)
        a, b = first[k], first[k + 1]
        unique, *stems = (_distinct(x[a:b]) for x in kinds)
        counts = np.bincount(raw, minlength=256)
        size, words = max(1, len(raw)), max(1, b - a)
        lines = (text or "").split("\n")
        shares = [*((_KINDS[:3] @ counts) / size), 1 - len(unique) / words, 1 - len(set(lines)) / len(lines)]
        bins = [min(BINS - 1, int(s * 40)) if s < 0.2 else min(BINS - 1, 8 + int((s - 0.2) * 5)) for s in shares] + [min(BINS - 1, int(np.log2(b - a + 1)))]
        out.append(np.concatenate([_distinct(np.concatenate([unique, *stems])), (1 << bits) + np.arange(SHAPES) * BINS + np.array(bins)]))
    return out


@dataclass
class Ordinal:
    """Shared weights and ordered thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray

    def scores(self, texts: list[str | None], bits: int = BITS) -> np.ndarray:
        return np.array([self.weights[f].sum() for f in features(texts, bits)])

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -50, 50)))


def _descend(flat: np.ndarray, at: np.ndarray, grades: np.ndarray, size: int, *, epochs: int, step: float, penalty: float, batch: int) -> Ordinal:
    """Proximal Adagrad; the result is the mean over the last half of the epochs, with weights that end at zero left there."""
    top = int(grades.max())
    w, seen_w, mean_w = np.zeros(size), np.full(size, 1e-3), np.zeros(size)
    share = np.clip([(grades <= k).mean() for k in range(top)], 1e-3, 1 - 1e-3)
    theta = np.log(share / (1 - share))
    raw = np.r_[theta[0], np.log(np.maximum(np.diff(theta), 1e-2))]
    seen_t, mean_raw, n, draw = np.full(top, 1e-3), np.zeros(top), 0, np.random.default_rng(7)
    for epoch in range(epochs):
        order = draw.permutation(len(grades))
        for lo in range(0, len(order), batch):
            pick = order[lo : lo + batch]
            ids = np.concatenate([flat[at[i] : at[i + 1]] for i in pick])
            row = np.repeat(np.arange(len(pick)), at[pick + 1] - at[pick])
            f = np.bincount(row, w[ids], minlength=len(pick))
            theta = raw[0] + np.r_[0.0, np.cumsum(np.exp(raw[1:]))]
            edge = np.concatenate([np.full((len(pick), 1), -np.inf), theta[None, :] - f[:, None], np.full((len(pick), 1), np.inf)], axis=1)
            cdf = 1 / (1 + np.exp(-np.clip(edge, -40, 40)))
            cdf[:, 0], cdf[:, -1] = 0, 1
            slope = cdf * (1 - cdf)
            y, own = grades[pick], np.arange(len(pick))
            mass = np.maximum(cdf[own, y + 1] - cdf[own, y], 1e-9)
            g_f = (slope[own, y + 1] - slope[own, y]) / mass / len(pick)  # of the loss by f
            above, below = slope[own, y + 1] / mass / len(pick), slope[own, y] / mass / len(pick)
            g_theta = np.bincount(y[y > 0] - 1, below[y > 0], minlength=top) - np.bincount(y[y < top], above[y < top], minlength=top)
            g_raw = np.r_[g_theta.sum(), [g_theta[k:].sum() * np.exp(raw[k]) for k in range(1, top)]]
            seen_t += g_raw**2
            raw = raw - step * g_raw / np.sqrt(seen_t)
            g = np.bincount(ids, g_f[row], minlength=size)
            hit = np.flatnonzero(g)
            seen_w[hit] += g[hit] ** 2
            rate = step / np.sqrt(seen_w[hit])
            moved = w[hit] - rate * g[hit]
            w[hit] = np.sign(moved) * np.maximum(np.abs(moved) - rate * penalty, 0)
        if epoch >= epochs // 2:
            mean_w, mean_raw, n = mean_w + w, mean_raw + raw, n + 1
    raw = mean_raw / n
    return Ordinal(np.where(w != 0, mean_w / n, 0.0), raw[0] + np.r_[0.0, np.cumsum(np.exp(raw[1:]))])


def fit(rows: list[np.ndarray], grades: np.ndarray, *, bits: int = BITS, epochs: int = 60, step: float = 0.2, select: float = 4e-3, penalty: float = 1e-3, batch: int = 512, least_rows: int = 8) -> Ordinal:
    """Two fits of the cumulative-link likelihood: the first (penalty ``select``) chooses features, the second weighs them.

    Features of fewer than ``least_rows`` rows keep weight 0.
    """
    size = (1 << bits) + SHAPES * BINS
    if len(np.unique(grades)) < 2:
        return Ordinal(np.zeros(size), np.full(max(1, int(grades.max()) if len(grades) else 1), -50.0))
    # the rows' ids in one array of 32-bit numbers, and where each row begins
    flat, at = np.concatenate(rows).astype(np.int32, copy=False), np.r_[0, np.cumsum([len(r) for r in rows])]
    usable = sum(np.bincount(flat[k : k + (1 << 20)], minlength=size) for k in range(0, len(flat), 1 << 20)) >= least_rows
    for strength, rate in ((select, step), (penalty, 3 * step)):
        kept = usable[flat]
        left, full = np.zeros(len(rows), dtype=np.int64), at[1:] > at[:-1]
        left[full] = np.add.reduceat(kept, at[:-1][full], dtype=np.int32)
        at, flat = np.r_[0, np.cumsum(left)], flat[kept]
        model = _descend(flat, at, grades, size, epochs=epochs, step=rate, penalty=strength, batch=batch)
        usable = model.weights != 0
    return model


def train(docs: DataFrame, graded: DataFrame, *, fit_rows: int = 12_000, bits: int = BITS, **options) -> Ordinal:
    """Model from ``graded`` (doc_id, grade), fitted on at most ``fit_rows`` labelled rows, chosen by hashed id."""
    chosen = graded.filter("doc_id is not null and grade is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("grade").cast("int").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in groups(texts):
                ids = [f.astype("<i4").tobytes() for f in features(texts[a:b], bits)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(ids, pa.binary()), batch.column(2).slice(a, b - a)], ["doc_id", "ids", "grade"])

    # an id repeated in docs must not multiply the bounded sample
    labelled = columns(docs, doc_id="long", text="string").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "grade")
    got = labelled.mapInArrow(extract, "doc_id long, ids binary, grade int").groupBy("doc_id").agg(F.min("ids").alias("ids"), F.min("grade").alias("grade")).orderBy("doc_id").toArrow()
    rows = [np.frombuffer(x.as_buffer(), dtype="<i4") for x in got.column("ids")]  # views, not copies
    model = fit(rows, np.array(got.column("grade").to_pylist(), dtype=np.int64), bits=bits, **options)
    del rows, got
    pa.default_memory_pool().release_unused()
    return model


def score(docs: DataFrame, model: Ordinal, *, bits: int = BITS) -> DataFrame:
    """doc_id, expected_grade, p_top (probability of the highest grade) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))  # 2**bits weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Ordinal(*sent.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in groups(texts):
                tails = own.tails(own.scores(texts[a:b], bits))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(tails.sum(axis=1)), pa.array(tails[:, -1].copy())], ["doc_id", "expected_grade", "p_top"])

    return columns(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, expected_grade double, p_top double")


def select_rows(docs: DataFrame, model: Ordinal, *, least: float = LEAST, bits: int = BITS) -> DataFrame:
    """The rows of ``docs``, columns unchanged, whose top grade has probability ``least`` or more."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Ordinal(*sent.value)
        for batch in batches:
            texts = batch.column(place).to_pylist()
            for a, b in groups(texts):
                yield batch.slice(a, b - a).filter(pa.array(own.tails(own.scores(texts[a:b], bits))[:, -1] >= least))

    return docs.mapInArrow(run, docs.schema)


def grades(labels: DataFrame) -> DataFrame:
    """Ratings from the label table: 2 good and clean, 1 poor or toxic, 0 both; a null flag counts as unknown."""
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") + 1 - F.col("toxic")).cast("int").alias("grade"))
