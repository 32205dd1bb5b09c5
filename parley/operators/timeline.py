"""Timeline operators: islands, interval and nearest joins, as-of joins, packing and sliver absorption.

Inputs are long tables keyed by a meeting and an ordinal. Joins on intervals go
through time buckets, so one meeting's words are spread over tasks; nearest and as-of
joins are windows over a union of both sides. Folds whose state depends on earlier
decisions run once per meeting on Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from parley.functions import strings
from parley.functions.vectors import overlap
from parley.schema import WORDS

# fixed values: limits of the alignment rules
SLIVER_WORDS, SLIVER_SECS, MAX_GAP_SECS, PUNCTUATION_WORDS = 5, 2.0, 0.5, 2
MAX_TOKEN_SECS = 0.32
WINDOW_SECS = 120.0
#: Width of the time buckets of interval joins: about the length of a typical turn, so that a span touches few.
BUCKET_SECS = 10.0


def islands(rows: DataFrame, key: str, order: str | list[str], value: str, *, island: str = "island") -> DataFrame:
    """``rows`` with the 0-based number of the run of equal consecutive values (nulls are equal) they are in."""
    by = W.partitionBy(key).orderBy(*([order] if isinstance(order, str) else order))
    same = F.col(value).eqNullSafe(F.lag(value).over(by)) & (F.row_number().over(by) > 1)
    return rows.withColumn("_new", F.when(same, 0).otherwise(1)).withColumn(island, (F.sum("_new").over(by.rowsBetween(W.unboundedPreceding, 0)) - 1).cast("int")).drop("_new")


def word_struct() -> Column:
    return F.struct(F.col("text"), F.col("start"), F.col("end"))


def collect_words(rows: DataFrame, keys: list[str], order: str, *, into: str = "words") -> DataFrame:
    """One row per key with its words in order."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), word_struct().alias("w"))))
    return rows.groupBy(*keys).agg(F.transform(ordered, lambda x: x["w"]).cast(WORDS).alias(into))


def speaker_segments(words: DataFrame, key: str = "meeting_id") -> DataFrame:
    """Words (key, word_idx, text, start, end, speaker_num) folded into runs: key, seg_idx, speaker_num, words."""
    return collect_words(islands(words, key, "word_idx", "speaker_num", island="seg_idx"), [key, "seg_idx", "speaker_num"], "word_idx")


def tokens_to_words(tokens: DataFrame, key: str = "meeting_id") -> DataFrame:
    """Tokens (key, i, token, ts) folded into words: key, word_idx, text, start, end.

    A word starts at a marked token or the first one. It ends a token's length
    after its last voiced token (or its first), but not after the next word's onset;
    words that come out empty are dropped after they have cut the one before.
    """
    by = W.partitionBy(key).orderBy("i")
    begins = strings.starts_word(F.col("token")) | (F.row_number().over(by) == 1)
    marked = tokens.withColumn("_begins", begins).withColumn("_word", F.sum(F.col("_begins").cast("int")).over(by.rowsBetween(W.unboundedPreceding, 0)))
    piece = F.when(F.col("_begins"), strings.strip_marker(F.col("token"))).otherwise(F.col("token"))
    voiced = F.when(F.col("_begins") | strings.is_voiced(F.col("token")), F.struct("i", "ts"))
    pieces = F.array_sort(F.collect_list(F.struct("i", piece.alias("piece"))))
    whole = marked.groupBy(key, "_word").agg(F.array_join(F.transform(pieces, lambda x: x["piece"]), "").alias("text"), F.min_by("ts", "i").alias("start"), F.max(voiced)["ts"].alias("_voiced"))
    after = W.partitionBy(key).orderBy("_word")
    timed = whole.withColumn("end", F.least(F.col("_voiced") + MAX_TOKEN_SECS, F.lead("start").over(after)))
    return timed.filter("text != ''").withColumn("word_idx", (F.row_number().over(after) - 1).cast("int")).select(key, "word_idx", "text", "start", "end")


def _buckets(start: Column, end: Column, width: float) -> Column:
    return F.explode(F.sequence(F.floor(start / width), F.floor(F.greatest(start, end) / width)))


def overlap_argmax(words: DataFrame, turns: DataFrame, key: str = "meeting_id", *, bucket_secs: float = BUCKET_SECS) -> DataFrame:
    """key, word_idx and the speaker of the turn that overlaps the word most (more than 0; the earliest turn wins ties)."""
    w = words.select(key, "word_idx", F.col("start").alias("w_start"), F.col("end").alias("w_end")).withColumn("bucket", _buckets(F.col("w_start"), F.col("w_end"), bucket_secs))
    t = turns.select(key, "turn_idx", F.col("speaker_num"), F.col("start").alias("t_start"), F.col("end").alias("t_end")).withColumn("bucket", _buckets(F.col("t_start"), F.col("t_end"), bucket_secs))
    length = overlap(F.col("w_start"), F.col("w_end"), F.col("t_start"), F.col("t_end"))
    met = w.join(t, [key, "bucket"]).withColumn("overlap", length).filter("overlap > 0")
    return met.groupBy(key, "word_idx").agg(F.max_by("speaker_num", F.struct("overlap", -F.col("turn_idx"))).alias("speaker_num"))


def nearest(points: DataFrame, anchors: DataFrame, key: str, at: str, order: str, value: str) -> DataFrame:
    """``points`` with the value of the anchor nearest in ``at`` (the least ``order`` wins ties); null if the key has none.

    Only the closest anchor on either side can be nearest, so both are found by
    one window over the union instead of comparing all pairs.
    """
    sole = anchors.groupBy(key, F.col(at).alias("_at")).agg(F.min_by(F.struct(F.col(at).alias("at"), F.col(order).alias("order"), F.col(value).alias("value")), order).alias("_a"))
    both = points.withColumn("_at", F.col(at)).withColumn("_a", F.lit(None).cast(sole.schema["_a"].dataType)).withColumn("_point", F.lit(True)).unionByName(sole.withColumn("_point", F.lit(False)), allowMissingColumns=True)
    before = W.partitionBy(key).orderBy("_at").rangeBetween(W.unboundedPreceding, 0)
    # from the latest on, as a frame that ends with the partition is read again for every row
    after = W.partitionBy(key).orderBy(F.col("_at").desc()).rangeBetween(W.unboundedPreceding, 0)
    found = both.withColumn("_b", F.last("_a", ignorenulls=True).over(before)).withColumn("_f", F.last("_a", ignorenulls=True).over(after)).filter("_point")
    gap = lambda c: F.abs(F.col(f"{c}.at") - F.col("_at"))
    pick = F.when(F.col("_f").isNull(), F.col("_b.value")).when(F.col("_b").isNull(), F.col("_f.value")).when((gap("_f") < gap("_b")) | (gap("_f") == gap("_b")) & (F.col("_f.order") < F.col("_b.order")), F.col("_f.value")).otherwise(F.col("_b.value"))
    return found.withColumn(value, pick).drop("_at", "_a", "_point", "_b", "_f")


def assign_speakers(words: DataFrame, turns: DataFrame, key: str = "meeting_id", *, bucket_secs: float = BUCKET_SECS) -> DataFrame:
    """Words with the speaker of the turn that overlaps most, else of the turn with the nearest midpoint; null without turns."""
    hit = overlap_argmax(words, turns, key, bucket_secs=bucket_secs)
    plain = words.drop("speaker_num")
    missed = plain.join(hit, [key, "word_idx"], "left_anti").withColumn("mid", (F.col("start") + F.col("end")) / 2)
    anchors = turns.withColumn("mid", (F.col("start") + F.col("end")) / 2)
    return plain.join(hit, [key, "word_idx"]).unionByName(nearest(missed, anchors, key, "mid", "turn_idx", "speaker_num").drop("mid"))


def as_of(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, value: str) -> DataFrame:
    """``left`` with the value of the last ``right`` row of the key whose time is not after its own (greatest value on ties), else null."""
    typed = right.schema[value].dataType
    both = left.withColumn("_at", F.col(left_at)).withColumn("_v", F.lit(None).cast(typed)).withColumn("_left", F.lit(1)).unionByName(right.select(key, F.col(right_at).alias("_at"), F.col(value).alias("_v"), F.lit(0).alias("_left")), allowMissingColumns=True)
    upto = W.partitionBy(key).orderBy("_at", "_left", "_v").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(upto)).filter("_left = 1").drop("_at", "_v", "_left")


def words_to_runs(words: DataFrame, runs: DataFrame, key: str = "meeting_id") -> DataFrame:
    """Every run with the words that start in it or before the next; earlier words go to the first run, runs may be empty."""
    given = as_of(words, runs, key, "start", "start", "run_idx")
    first = runs.groupBy(key).agg(F.min_by("run_idx", F.struct("start", "run_idx")).alias("_first"))
    placed = given.join(first, key).withColumn("run_idx", F.coalesce("run_idx", "_first"))
    filled = collect_words(placed, [key, "run_idx"], "word_idx")
    return runs.select(key, "run_idx", "start", "end").join(filled, [key, "run_idx"], "left").withColumn("words", F.coalesce("words", F.array().cast(WORDS)))


def active_index(times: Column, at: Column) -> Column:
    """Place of the last value of a sorted array that is not above ``at``, else -1."""
    return F.size(F.filter(times, lambda x: x <= at)) - 1


def active_place(points: DataFrame, items: DataFrame, key: str, at: str, start: str, place: str) -> DataFrame:
    """``points`` with ``active``: the place of the last item of the key that has started by then, -1 for none."""
    found = as_of(points, items, key, at, start, place)
    return found.withColumn("active", F.coalesce(place, F.lit(-1))).drop(place)


def playback_status(place: Column, active: Column) -> Column:
    return F.when(place < active, "past").when(place == active, "active").otherwise("future")


def cyclic_step(place: Column, step: Column, n: Column) -> Column:
    return F.pmod(place + step, n)


def pack_runs(runs: DataFrame, key: str = "meeting_id", *, most_secs: float = WINDOW_SECS) -> DataFrame:
    """``runs`` with the window they are decoded in: greedy, a run joins while the window stays within ``most_secs``."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("run_idx", kind="stable")
        window, begin, out = -1, 0.0, []
        for start, end in zip(rows["start"], rows["end"], strict=True):
            if window < 0 or end - begin > most_secs:
                window, begin = window + 1, start
            out.append(window)
        return rows.assign(window_idx=out)

    plain = runs.select(key, "run_idx", "start", "end")
    kinds = ", ".join(f"{n} {t}" for n, t in plain.dtypes)
    return plain.groupBy(key).applyInPandas(fold, f"{kinds}, window_idx int")


def any_overlap(spans: DataFrame, key: str, order: tuple[str, str] = ("start", "end")) -> DataFrame:
    """key and whether any two of its spans overlap in time."""
    a, b = order
    before = W.partitionBy(key).orderBy(a, b).rowsBetween(W.unboundedPreceding, -1)
    return spans.withColumn("_m", F.max(b).over(before)).groupBy(key).agg(F.coalesce(F.max(F.col("_m") > F.col(a)), F.lit(False)).alias("overlaps"))


def gaps_within(words: Column, most: float = MAX_GAP_SECS) -> Column:
    """Whether every pause between consecutive words is at most ``most`` seconds."""
    places = F.when(F.size(words) > 1, F.sequence(F.lit(1), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))
    return F.forall(places, lambda i: F.get(words, i)["start"] - F.get(words, i - 1)["end"] <= most)


def is_wobble(before: Column, sliver: Column, after: Column) -> Column:
    """Whether a short stretch between two of another speaker is a labelling error, not a turn."""
    n = PUNCTUATION_WORDS
    near = F.concat(F.slice(before, F.greatest(F.size(before) - (n - 1), F.lit(1)), n), sliver, F.slice(after, 1, n))
    span = F.try_element_at(sliver, F.lit(-1))["end"] - F.try_element_at(sliver, F.lit(1))["start"]
    calm = ~F.exists(near, lambda w: strings.ends_sentence(w["text"]))
    return (F.size(sliver) > 0) & (F.size(sliver) <= SLIVER_WORDS) & (span <= SLIVER_SECS) & calm & gaps_within(near)


def _fold_slivers(speakers: list[int | None], sizes: list[int], heads: list[list[tuple]], tails: list[list[tuple]]) -> list[int]:
    """Output place of each of a meeting's ordered segments; words are (start, end, ends a sentence). The state is the open segment's speaker and its last words."""
    out, last, speaker, tail, skip = [], -1, None, [], False
    for i, (own, n, head) in enumerate(zip(speakers, sizes, heads, strict=True)):
        if skip:
            skip = False
            out.append(last)
            continue
        if i and i + 1 < len(sizes) and speaker is not None and speakers[i + 1] == speaker and own != speaker and 0 < n <= SLIVER_WORDS and head[-1][1] - head[0][0] <= SLIVER_SECS:
            near = tail + head + heads[i + 1][:PUNCTUATION_WORDS]
            if not any(stop for *_, stop in near) and all(y[0] - x[1] <= MAX_GAP_SECS for x, y in zip(near, near[1:], strict=False)):
                tail = (tail + head + tails[i + 1])[-PUNCTUATION_WORDS:]
                skip = True
                out.append(last)
                continue
        last, speaker, tail = last + 1, own, tails[i]
        out.append(last)
    return out


def absorb_slivers(segments: DataFrame, key: str = "meeting_id") -> DataFrame:
    """Segments (key, seg_idx, speaker_num, words) with wobbles merged into the speaker around them.

    A left fold: a merged segment's new tail is what the next step sees. The
    fold looks at a few words of each segment, no more than the longest
    sliver's and the last of the one before, and marks where segments go; a merged
    segment's words are those of its parts as they lie one after the other. One meeting is one group.
    """
    w = F.col("words").cast(WORDS)
    stops = F.transform(w, lambda x: F.coalesce(strings.ends_sentence(x["text"]), F.lit(False)))
    given = segments.select(key, "seg_idx", F.col("speaker_num").cast("int").alias("speaker_num"), F.coalesce(w, F.array().cast(WORDS)).alias("words"), F.coalesce(stops, F.array().cast("array<boolean>")).alias("_stops"))

    def fold(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("seg_idx").combine_chunks()
        words, stops = (rows.column(c).combine_chunks() for c in ("words", "_stops"))
        flat = words.flatten()
        at = np.concatenate([[0], np.cumsum(words.value_lengths().to_numpy())]).astype(np.int32)
        each = list(zip(*(flat.field(c).to_numpy(zero_copy_only=False).tolist() for c in ("start", "end")), stops.flatten().to_pylist(), strict=True))
        spans = list(zip(at.tolist(), at[1:].tolist(), strict=False))
        heads, tails = [each[lo : min(hi, lo + SLIVER_WORDS)] for lo, hi in spans], [each[max(lo, hi - PUNCTUATION_WORDS) : hi] for lo, hi in spans]
        out = np.array(_fold_slivers(rows.column("speaker_num").to_pylist(), [hi - lo for lo, hi in spans], heads, tails), dtype=np.int32)
        first = np.flatnonzero(np.diff(out, prepend=-1))
        kept = rows.select([key, "speaker_num"]).take(pa.array(first))
        merged = pa.ListArray.from_arrays(pa.array(np.append(at[first], at[-1]).astype(np.int32)), flat)
        return pa.table({key: kept.column(key), "seg_idx": pa.array(np.arange(len(first), dtype=np.int32)), "speaker_num": kept.column("speaker_num"), "words": merged})

    return given.groupBy(key).applyInArrow(fold, f"{key} {dict(given.dtypes)[key]}, seg_idx int, speaker_num int, words {WORDS}")


def align_speakers(words: DataFrame, turns: DataFrame, key: str = "meeting_id", *, bucket_secs: float = BUCKET_SECS) -> DataFrame:
    """Words and turns to speaker segments: assignment, runs, sliver absorption."""
    given = assign_speakers(words, turns.withColumn("speaker_num", F.col("speaker_num").cast("int")), key, bucket_secs=bucket_secs)
    return absorb_slivers(speaker_segments(given, key), key)


def words_kept(words: DataFrame, segments: DataFrame, key: str = "meeting_id") -> DataFrame:
    """key, before, after: words of each key and words in its segments; alignment neither drops nor adds any."""
    after = segments.groupBy(key).agg(F.sum(F.size("words")).alias("after"))
    return words.groupBy(key).agg(F.count(F.lit(1)).alias("before")).join(after, key, "full").na.fill(0, ["before", "after"])


def segments_to_turns(segments: DataFrame, key: str = "meeting_id") -> DataFrame:
    """Turns of the attributed, non-empty segments: key, turn_idx, start, end, speaker_num."""
    kept = segments.filter(F.col("speaker_num").isNotNull() & (F.size("words") > 0))
    w = F.col("words")
    return kept.select(key, (F.row_number().over(W.partitionBy(key).orderBy("seg_idx")) - 1).alias("turn_idx"), F.element_at(w, 1)["start"].alias("start"), F.element_at(w, -1)["end"].alias("end"), "speaker_num")


def transcribe(windows: DataFrame, decode, key: str = "meeting_id") -> DataFrame:
    """Words of decoded windows, shifted by their window's start.

    ``decode`` is the recogniser: a function for ``mapInPandas`` from
    (key, window_idx, start, end) to (key, window_idx, i, token, ts).
    """
    kind = dict(windows.dtypes)[key]
    tokens = windows.select(key, "window_idx", "start", "end").mapInPandas(decode, f"{key} {kind}, window_idx int, i int, token string, ts double")
    inside = tokens.withColumn("_w", F.struct(key, "window_idx"))
    words = tokens_to_words(inside.drop(key, "window_idx"), "_w").select(F.col(f"_w.{key}").alias(key), F.col("_w.window_idx").alias("window_idx"), "word_idx", "text", "start", "end")
    shifted = words.join(windows.select(key, "window_idx", F.col("start").alias("_offset")), [key, "window_idx"]).withColumns({"start": F.col("start") + F.col("_offset"), "end": F.col("end") + F.col("_offset")})
    order = W.partitionBy(key).orderBy("window_idx", "word_idx")
    return shifted.withColumn("word_idx", (F.row_number().over(order) - 1).cast("int")).select(key, "word_idx", "text", "start", "end")


def transcribe_runs(runs: DataFrame, decode, key: str = "meeting_id", *, most_secs: float = WINDOW_SECS) -> DataFrame:
    """Speech runs (key, run_idx, start, end) with their words: runs are packed into windows, each window is decoded once, and its words go back to the runs they start in."""
    windows = pack_runs(runs, key, most_secs=most_secs).groupBy(key, "window_idx").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return words_to_runs(transcribe(windows, decode, key), runs, key)
