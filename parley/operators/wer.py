"""Word alignment by edit distance with traceback, and the error rates that follow from it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions import strings
from parley.operators.relational import percentile_nearest_rank

OPS = ("match", "sub", "del", "ins")


def _rows(a: np.ndarray, b: np.ndarray, cost: np.ndarray, way: np.ndarray | None = None) -> np.ndarray:
    """The cost row after the words ``a``, from the row before them; ``way`` takes the directions (0 pair, 1 del, 2 ins) of every row.

    Rows are kept without their place, so that insertions are a running minimum.
    """
    steps = np.arange(len(b) + 1, dtype=np.int32)
    for i, word in enumerate(a):
        pair = cost[:-1] + (b != word)
        best = cost + 1
        np.minimum(best[1:], pair, out=best[1:])
        new = np.minimum.accumulate(best - steps) + steps
        if way is not None:
            way[i, 0] = 1
            way[i, 1:] = np.where(new[1:] == pair, 0, np.where(new[1:] == cost[1:] + 1, 1, 2))
        cost = new
    return cost


def align_codes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Directions (0 pair, 1 del, 2 ins) of a least-cost alignment of two code arrays, in order.

    On equal cost a pairing comes before a deletion, and that before an
    insertion, seen from the end. Going forward, one cost row is kept for every
    square root of the reference's length; going back, the directions of the
    rows between two kept ones are made again, up to the column that the path has reached. So memory
    grows with the length times its square root, and the result is that of the whole matrix.
    """
    m, n = len(a), len(b)
    every = max(1, int(m**0.5))
    cost, kept = np.arange(n + 1, dtype=np.int32), []
    for lo in range(0, m, every):
        kept.append(cost)
        if lo + every < m:
            cost = _rows(a[lo : lo + every], b, cost)
    out, i, j = [], m, n
    for block in range(len(kept) - 1, -1, -1):
        lo = block * every
        way = np.empty((i - lo, j + 1), dtype=np.uint8)
        _rows(a[lo:i], b[:j], kept[block][: j + 1], way)
        while i > lo:
            step = way[i - lo - 1, j]
            out.append(step)
            i -= step != 2
            j -= step != 1
    out += [2] * j
    return np.array(out[::-1], dtype=np.uint8)


def align(ref: list[str], hyp: list[str]) -> list[tuple[str, int, int]]:
    """(op, ref place, hyp place) of the alignment of two word lists, -1 for none."""
    codes: dict[str, int] = {}
    a, b = (np.array([codes.setdefault(w, len(codes)) for w in side], dtype=np.int32) for side in (ref, hyp))
    out, i, j = [], 0, 0
    for step in align_codes(a, b).tolist():
        if step == 0:
            out.append(("match" if a[i] == b[j] else "sub", i, j))
        else:
            out.append(("del", i, -1) if step == 1 else ("ins", -1, j))
        i += step != 2
        j += step != 1
    return out


def align_pairs(pairs: DataFrame, key: str, ref: Column, hyp: Column) -> DataFrame:
    """key, step, op, ref_idx, hyp_idx: the alignment of each row's two word arrays."""
    kind = dict(pairs.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, a, b in zip(batch[key], batch["_ref"], batch["_hyp"], strict=True):
                steps = align(list(a), list(b))
                if not steps:
                    continue  # two empty texts have no steps
                yield pd.DataFrame({key: [k] * len(steps), "step": range(len(steps)), "op": [s[0] for s in steps], "ref_idx": [s[1] for s in steps], "hyp_idx": [s[2] for s in steps]})

    given = pairs.select(key, F.coalesce(ref, F.array().cast("array<string>")).alias("_ref"), F.coalesce(hyp, F.array().cast("array<string>")).alias("_hyp"))
    return given.mapInPandas(run, f"{key} {kind}, step int, op string, ref_idx int, hyp_idx int")


def tally(aligned: DataFrame, key: str) -> DataFrame:
    """Counts of each op per key."""
    return aligned.groupBy(key).agg(*[F.count_if(F.col("op") == op).alias(f"n_{op}") for op in OPS])


def error_rate(errors: Column, n_ref: Column, n_hyp: Column) -> Column:
    """Errors per reference word; without reference words 0 if the hypothesis is empty too, else 1."""
    return F.when(n_ref > 0, errors / n_ref).when(n_hyp == 0, 0.0).otherwise(1.0)


def word_error_rate(pairs: DataFrame, key: str, ref: Column, hyp: Column) -> DataFrame:
    """key, n_ref, n_match, n_sub, n_del, n_ins, wer of two texts, compared as normalised words."""
    given = pairs.select(key, strings.normalised_words(ref).alias("_r"), strings.normalised_words(hyp).alias("_h"))
    counts = tally(align_pairs(given, key, F.col("_r"), F.col("_h")), key)
    sized = given.select(key, F.size("_r").alias("n_ref"), F.size("_h").alias("n_hyp")).join(counts, key, "left").na.fill(0)
    return sized.withColumn("wer", error_rate(F.col("n_sub") + F.col("n_del") + F.col("n_ins"), F.col("n_ref"), F.col("n_hyp"))).drop("n_hyp")


def compare_transcripts(pairs: DataFrame, key: str, ref_words: str, hyp_words: str) -> DataFrame:
    """Error rate and the time errors of matching words (mean, max, 95th percentile) of two word arrays."""
    token = lambda c: F.transform(c, lambda w: strings.normalised_token(w["text"]))
    steps = align_pairs(pairs, key, token(ref_words), token(hyp_words))
    counts = tally(steps, key)
    timed = steps.filter("op = 'match'").join(pairs.select(key, ref_words, hyp_words), key)
    gap = lambda c: F.abs(F.get(F.col(ref_words), F.col("ref_idx"))[c] - F.get(F.col(hyp_words), F.col("hyp_idx"))[c])
    errors = timed.select(key, gap("start").alias("start_error"), gap("end").alias("end_error"))
    stats = errors.groupBy(key).agg(*[e for c in ("start_error", "end_error") for e in (F.avg(c).alias(f"mean_{c}"), F.max(c).alias(f"max_{c}"), percentile_nearest_rank(0.95, c).alias(f"p95_{c}"))])
    sized = pairs.select(key, F.size(ref_words).alias("n_ref"), F.size(hyp_words).alias("n_hyp"))
    out = sized.join(counts, key, "left").join(stats, key, "left").na.fill(0)
    return out.withColumn("wer", error_rate(F.col("n_sub") + F.col("n_del") + F.col("n_ins"), F.col("n_ref"), F.col("n_hyp")))


def over_limits(metrics: DataFrame, *, wer: float, p95: float) -> DataFrame:
    """Rows whose error rate or 95th percentile time error is above its limit."""
    return metrics.filter((F.col("wer") > wer) | (F.col("p95_start_error") > p95) | (F.col("p95_end_error") > p95))
