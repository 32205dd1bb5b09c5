"""Operator 13: exact removal of repeated strings by distributed prefix doubling.

Every string of ``threshold`` bytes stands at a position; a position's rank at a
length is a name of the string that starts there, equal for equal strings. Spark
sorts positions by their ranks, and those whose rank is alone are finished:
no longer string there can repeat. For the rest, the ranks at a position and at
a growing offset behind it form pairs that rank strings of up to twice the
length, until the threshold is reached.

Three observations keep the sorted rows few, without leaving out any string:

* Equal texts are ranked once, and count as repeated.
* At the first length (``start``) a string of the threshold's length is
  represented by the least name inside it. Equal strings have equal
  representatives, so a representative that is alone finishes all the
  neighbouring positions, the block, that it stands for.
* A block whose whole string occurs again, up to the last byte that any of its
  positions reaches, repeats at all its positions. Of equal blocks, one goes on,
  as a partner, where a different block has the same representative.

The positions of the other blocks are doubled one by one. Sorted rows are dealt
by ranges that end with the position, so a rank that a third of all positions
share spreads over many tasks; the outermost rows of the tasks are compared afterwards.

Names have 64 bits; a pair decides with 128, and so does a block's name with its
representative's. Texts longer than a segment are worked on in segments.

Defined cases: a null or empty text has no bytes; it and every text shorter
than the threshold keep all. Rows with a null or repeated id are rows like any other:
two rows with the same long text lose it both. Bytes are those of UTF-8, and what
remains need not be valid UTF-8. Other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import bucketed, columns, discard, durable, mix, powers, release

THRESHOLD = 200
#: Bytes of text that are worked on at once.
SEGMENT = 1 << 18
_LETTERS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_PLACE = np.uint64((1 << 24) - 1)
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


class Names:
    """Names of the strings in some bytes."""

    def __init__(self, raw: np.ndarray) -> None:
        up, down = powers(len(raw) + 1)
        self.total = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(_LETTERS[raw] * up[:-1], out=self.total[1:])
        self.down = down

    def __call__(self, at: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        return mix((self.total[at + length] - self.total[at]) * self.down[at] + np.asarray(length, dtype=np.uint64))


def _segments(size: int, threshold: int) -> Iterator[tuple[int, int]]:
    """Ranges of bytes that together hold every string of the threshold's length, each starting in one range."""
    for lo in range(0, max(size - threshold + 1, 0), SEGMENT):
        yield lo, min(lo + SEGMENT + threshold - 1, size)


def blocks_of(raw: np.ndarray, text: np.ndarray, start: int, threshold: int) -> tuple[np.ndarray, ...]:
    """Representative's name, name of the whole, first position and number of positions of each block; ``text`` numbers the text of each byte."""
    names, n, width = Names(raw), len(raw), threshold - start + 1
    at = np.flatnonzero(text[: n - threshold + 1] == text[threshold - 1 :])
    short = np.full(n, np.iinfo(np.uint64).max)
    every = np.arange(n - start + 1)
    own = names(every, start)
    short[: len(own)] = (own & ~_PLACE) | every.astype(np.uint64)
    step = 1
    while step < width:  # least of ``width`` places from each on, by doubling
        by = min(step, width - step)
        short[: n - by] = np.minimum(short[: n - by], short[by:])
        step += by
    least = (short[at] & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.append(True, least[1:] != least[:-1])) if len(at) else at
    count = np.diff(np.append(first, len(at)))
    lo = at[first]
    return own[least[first]], names(lo, count - 1 + threshold), lo, count


def _batches(rows: Iterator[tuple[int, bytes]], threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes of texts and segments joined to about a segment, the number of each byte's part, and the parts' rows, offsets in their text and starts."""
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def emit() -> tuple[np.ndarray, ...]:
        sizes = np.array([len(d) for *_, d in held])
        out = np.frombuffer(b"".join(d for *_, d in held), dtype=np.uint8), np.repeat(np.arange(len(held)), sizes), np.array([r for r, *_ in held]), np.array([o for _, o, _ in held]), np.cumsum(sizes) - sizes
        held.clear()
        return out

    for row, data in rows:
        for lo, hi in _segments(len(data), threshold):
            if held and size + hi - lo > SEGMENT:
                yield emit()
                size = 0
            held.append((row, lo, data[lo:hi]))
            size += hi - lo
    if held:
        yield emit()


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def distinct_texts(docs: DataFrame) -> DataFrame:
    """tid, key, data, copies: each text of a table once, as bytes, in buckets by ``tid``."""
    given = columns(docs, text="string").select(F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    once = given.groupBy(F.unhex(F.sha2("data", 256)).alias("key")).agg(F.first("data").alias("data"), F.count(F.lit(1)).alias("copies"))
    # in the order of their keys, so that a repeated task gives the same numbers
    texts = bucketed(once.sortWithinPartitions("key").select(F.monotonically_increasing_id().alias("tid"), "key", "data", "copies"), "tid")
    release(texts)
    return texts


def blocks(texts: DataFrame, start: int, threshold: int) -> DataFrame:
    """name, whole, tid, lo, n, weight: all blocks of all texts; the weight is 2 for a text with copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tid, data = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            weight = np.minimum(batch.column(2).to_numpy(), 2)
            for raw, part, row, offset, begin in _batches(enumerate(data), threshold):
                name, whole, lo, n = blocks_of(raw, part, start, threshold)
                own = part[lo]
                r = row[own]
                yield pa.RecordBatch.from_arrays([_signed(name), _signed(whole), pa.array(tid[r]), pa.array((lo - begin[own] + offset[own]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(weight[r])], ["name", "whole", "tid", "lo", "n", "weight"])

    return texts.select("tid", "data", "copies").mapInArrow(run, "name long, whole long, tid long, lo int, n int, weight long")


def marked(rows: DataFrame, ranks: list[str], keep: list[str]) -> DataFrame:
    """Rows that stand next to one of equal ranks (``equal``), and the first and last rows of each task (``edge``), written.

    Rows are dealt by ranges of ranks and position, and sorted by them. Of rows inside a task only the columns ``keep`` are needed later.
    """
    kind = rows.schema
    names = rows.columns
    edges = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kind.fields) + ", edge boolean, equal boolean"

    def shown(table: pa.Table, edge: np.ndarray, equal: np.ndarray) -> pa.Table:
        inside = [pc.if_else(pa.array(edge), table.column(c), pa.scalar(None, table.column(c).type)) if c not in keep else table.column(c) for c in names]
        return pa.Table.from_arrays([*inside, pa.array(edge), pa.array(equal)], [*names, "edge", "equal"])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_equal, held_edge = None, False, True
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            keys = [table.column(c).to_numpy() for c in ranks]
            same = np.logical_and.reduce([k[1:] == k[:-1] for k in keys])
            equal, edge = np.append(False, same) | np.append(same, False), np.zeros(table.num_rows, dtype=bool)
            edge[0] = held_edge
            equal[0] |= held_equal
            out = np.flatnonzero((equal | edge)[:-1])
            part = shown(table.take(pa.array(out)), edge[out], equal[out])
            held = table.slice(table.num_rows - 1).to_batches()[0]
            held_equal, held_edge = bool(equal[-1]), bool(edge[-1])
            yield from part.to_batches()
        if held is not None:
            yield from shown(pa.Table.from_batches([held]), np.array([True]), np.array([held_equal])).to_batches()

    return durable(rows.repartitionByRange(*names).sortWithinPartitions(*names).mapInArrow(mark, edges))


def repeated(rows: DataFrame, ranks: list[str]) -> DataFrame:
    """Rows, without their ranks, that occur in another row too: neighbours in a task, and outermost rows of tasks that meet each other."""
    found = marked(rows, ranks, [c for c in rows.columns if c not in ranks])
    met = found.filter("edge").groupBy(*ranks).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")  # two rows a task at most
    return found.filter("equal").unionByName(found.filter("edge and not equal").join(met, ranks, "left_semi")).drop("edge", "equal", *ranks)


def rank_pairs(texts: DataFrame, positions: DataFrame, length: int, offset: int, threshold: int) -> DataFrame:
    """rank, next_rank, tid, at, asks: names of ``length`` bytes at each position and ``offset`` bytes behind it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tid = batch.column(0).to_numpy()
            for k, data in enumerate(batch.column(1).to_pylist()):
                spans = batch.column(2)[k].values
                lo, n, asks = (spans.field(c).to_numpy(zero_copy_only=False) for c in ("lo", "n", "asks"))
                at = np.repeat(lo - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
                asks = np.repeat(asks, n)
                for low, high in _segments(len(data), threshold):
                    here = (at >= low) & (at < low + SEGMENT)
                    own = at[here] - low
                    if len(own):
                        names = Names(np.frombuffer(data, dtype=np.uint8)[low:high])
                        yield pa.RecordBatch.from_arrays([_signed(names(own, length)), _signed(names(own + offset, length)), pa.array(np.full(len(own), tid[k])), pa.array((own + low).astype(np.int32)), pa.array(asks[here])], ["rank", "next_rank", "tid", "at", "asks"])

    spans = positions.groupBy("tid").agg(F.collect_list(F.struct("lo", "n", "asks")).alias("spans"))
    joined = texts.select("tid", "data").join(spans, "tid")
    return joined.mapInArrow(run, "rank long, next_rank long, tid long, at int, asks boolean")


def find_repeats(texts: DataFrame, *, threshold: int = THRESHOLD, start: int | None = None) -> DataFrame:
    """tid, start, end: spans whose union is what repeated strings cover, of texts without copies.

    ``start`` is the first length that is ranked: less than the threshold, which doubling reaches from there.
    """
    length = start or threshold // 2
    every = durable(blocks(texts, length, threshold))
    shared = marked(every, ["name"], every.columns)  # a few outermost rows may be alone; they make no difference below
    discard(every)
    classes = durable(shared.groupBy("name", "whole").agg(F.sum("weight").alias("times"), F.first("tid").alias("tid"), F.first("lo").alias("lo"), F.first("n").alias("n")))
    again = classes.filter("times > 1").select("name", "whole")
    spans = durable(shared.filter("weight = 1").join(again, ["name", "whole"]).select("tid", F.col("lo").alias("start"), (F.col("lo") + F.col("n") + (threshold - 1)).alias("end")))
    discard(shared)
    mixed = classes.groupBy("name").agg(F.count(F.lit(1)).alias("_classes"), F.min("times").alias("_least")).filter("_classes > 1 and _least = 1").select("name")
    positions = classes.join(mixed, "name", "left_semi").select("tid", "lo", "n", (F.col("times") == 1).alias("asks"))
    while length < threshold:
        offset = min(length, threshold - length)
        kept = repeated(rank_pairs(texts, positions, length, offset, threshold), ["rank", "next_rank"])
        positions = kept.select("tid", F.col("at").alias("lo"), F.lit(1).alias("n"), "asks")
        length += offset
        release(positions)
    return spans.unionByName(positions.filter("asks").select("tid", F.col("lo").alias("start"), (F.col("lo") + threshold).alias("end")))


def cut(texts: DataFrame, found: DataFrame, *, threshold: int = THRESHOLD) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, spans, kept of each distinct text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, spans, kept = [], [], [], []
            for k, (data, copies) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                n = len(data)
                gone = np.zeros(n, dtype=bool)
                if copies > 1 and n >= threshold:
                    gone[:] = True
                elif batch.column(3)[k].is_valid:
                    own = batch.column(3)[k].values
                    turn = np.zeros(n + 1, dtype=np.int64)
                    np.add.at(turn, own.field("start").to_numpy(), 1)
                    np.add.at(turn, own.field("end").to_numpy(), -1)
                    gone = np.cumsum(turn[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))).tolist()
                sizes.append(n)
                removed.append(int(gone.sum()))
                spans.append([{"start": s, "end": e} for s, e in zip(edge[::2], edge[1::2], strict=True)])
                kept.append(np.frombuffer(data, dtype=np.uint8)[~gone].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(map(len, spans), pa.int64()), pa.array(spans, _SPANS), pa.array(kept, pa.binary())], ["key", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    lists = found.groupBy("tid").agg(F.collect_list(F.struct("start", "end")).alias("found"))
    given = texts.join(lists, "tid", "left").select("key", "data", "copies", "found")
    return given.mapInArrow(run, "key binary, n_bytes long, n_removed long, n_spans long, spans array<struct<start:int,end:int>>, kept binary")


def remove_repeats(docs: DataFrame, *, threshold: int = THRESHOLD, start: int | None = None, show: Callable[[str], Column] = F.col) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans, kept of every row of ``docs``.

    ``kept`` is ``show`` of the remaining bytes' column, taken before results meet the rows.
    """
    texts = distinct_texts(docs)
    done = durable(cut(texts, find_repeats(texts, threshold=threshold, start=start), threshold=threshold).withColumn("kept", show("kept")))
    rows = columns(docs, doc_id="long", text="string").select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("key"))
    return rows.join(done, "key").drop("key")
