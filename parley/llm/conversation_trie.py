"""Operator 12: the prefix trie of conversations that are rebuilt upon shared openings.

A turn is known by a digest of its role and text, so texts never leave the
scan. A rebuilt conversation is one row of digests and text lengths; equal ones
become one row first, with the hash of their ids, which streams through sorted
chunks. Rows are then dealt by the digest of their first turn. A first turn
with more than ``limit`` turns below it is too large for a task: its rows are
dealt again by their second turn as well, and so on, one job for each shared
turn. Each bucket of whole subtries builds pointer dictionaries and sums them
up from the leaves; the few nodes above them are summed up from their
subtries by aggregation, level by level.

Defined cases: rows without a conversation id are left out; a null role or
text is empty; turns are taken in order, null first, and rows of one turn by
the digest of role and text; repeated rows are turns like any other; other
columns are ignored. Without conversations there are no nodes, not even the
root. A conversation is the unit that has to fit in a task, at 20 bytes a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import columns, durable

#: Bytes of a digest.
WIDE = 16
#: Turns that one task holds as a trie, at about 500 bytes each.
LIMIT = 50_000
#: Conversations share the openings of every ``FAMILY``-th one, of up to ``OPENING`` - 1 turns.
FAMILY, OPENING = 100, 6
#: Ids in a chunk of the streamed hash.
_CHUNK = 100_000
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _digest(hexed: Column) -> Column:
    """The first bytes of SHA-256, from its hexadecimal form."""
    return F.substring(F.unhex(hexed), 1, WIDE)


def original(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: digest and code points of each turn, in order."""
    rows = columns(conversations, conv_id="long", turn="long", role="string", text="string").filter("conv_id is not null").na.fill("", ["role", "text"])
    seen = _digest(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", seen.alias("digest"), F.length("text").alias("size")))).alias("turns"))


def rebuild(conversations: DataFrame) -> DataFrame:
    """conv_id, digests (one binary), sizes: each conversation upon the opening of its family's first."""
    own = original(conversations)
    opening = own.select(F.col("conv_id").alias("_lead"), F.slice("turns", 1, OPENING - 1).alias("_opening"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(OPENING)).cast("int")
    joined = own.withColumn("_lead", F.col("conv_id") - F.col("conv_id") % FAMILY).join(opening, "_lead", "left").withColumn("_h", h)
    first = F.coalesce(F.slice("_opening", F.lit(1), F.col("_h")), F.array().cast("array<struct<turn:bigint,digest:binary,size:int>>"))
    rest = F.slice("turns", F.col("_h") + 1, F.greatest(F.size("turns") - F.col("_h"), F.lit(0)))
    whole = joined.select("conv_id", F.concat(first, rest).alias("turns"))
    return whole.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), "")).alias("digests"), F.transform("turns", lambda t: t["size"]).alias("sizes"))


def hashed_ids(members: DataFrame, key: str) -> DataFrame:
    """key, n, first, ends: number, least and hash of all ids (``conv_id``) of each key.

    Ids are sorted over all tasks, so that a key of many ids is spread; each
    task writes its share as decimal chunks, and a key's chunks stream through its hash.
    """

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            cut = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1] or i % _CHUNK == 0), len(keys)] if keys else []
            parts = [(keys[lo], ids[lo], hi - lo, ",".join(map(str, ids[lo:hi]))) for lo, hi in zip(cut, cut[1:], strict=False)]
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*parts, strict=True), (pa.binary(), pa.int64(), pa.int64(), pa.string()), strict=True)], [key, "first", "n", "ids"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []

        def emit() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.binary(), pa.int64(), pa.int64(), pa.string()), strict=True)], [key, "n", "first", "ends"])
            done.clear()
            return out

        for batch in batches:
            for k, first, n, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now[0] != k:
                    if now:
                        done.append((now[0], now[1], now[2], now[3].hexdigest()))
                    now = [k, 0, first, hashlib.sha256()]
                else:
                    now[3].update(b",")
                now[1] += n
                now[3].update(ids.encode())
            if done:
                yield emit()
        if now:
            done.append((now[0], now[1], now[2], now[3].hexdigest()))
            yield emit()

    order = members.select(key, "conv_id").repartitionByRange(key, "conv_id").sortWithinPartitions(key, "conv_id")
    parts = order.mapInArrow(chunks, f"{key} binary, first long, n long, ids string")
    return parts.repartition(key).sortWithinPartitions(key, "first").mapInArrow(stream, f"{key} binary, n long, first long, ends string")


def sequences(rebuilt: DataFrame) -> DataFrame:
    """digests, sizes, n, first, ends: a row for each distinct sequence of turns, with its members' number, least id and hashed ids."""
    ends = hashed_ids(rebuilt.select("conv_id", F.unhex(F.sha2("digests", 256)).alias("sequence")), "sequence")
    return rebuilt.join(ends.drop("sequence"), F.col("conv_id") == F.col("first")).drop("conv_id")


def postorder(kids: list[dict[bytes, int]], tops: list[int]) -> Iterator[int]:
    """Nodes below and with ``tops``, children before their parents."""
    stack = [(top, False) for top in tops]
    while stack:
        node, done = stack.pop()
        if done or not kids[node]:
            yield node
        else:
            stack.append((node, True))
            stack.extend((kid, False) for kid in kids[node].values())


def build_subtries(rows: pd.DataFrame) -> pd.DataFrame:
    """Nodes of all subtries of a bucket; a subtrie's top has the key of its parent."""
    kids: list[dict[bytes, int]] = []
    depth, parent, size, n, leaves, saved, first, ends = ([] for _ in range(8))
    tops: dict[bytes, int] = {}
    above: dict[int, tuple[bytes, int]] = {}

    def grow(at: int, deep: int, points: int) -> int:
        kids.append({})
        for column, value in ((depth, deep), (parent, at), (size, points), (n, 0), (leaves, 0), (saved, 0), (first, 1 << 63), (ends, NO_ENDS)):
            column.append(value)
        return len(kids) - 1

    for key, level, parent_key, parent_first, digests, sizes, count, least, hashed in rows[["key", "level", "parent_key", "parent_first", "digests", "sizes", "n", "first", "ends"]].itertuples(index=False):
        at = tops.get(key)
        if at is None:
            at = tops[key] = grow(-1, level, int(sizes[level - 1]))
            above[at] = parent_key, parent_first
        for d in range(level, len(sizes)):
            turn = digests[WIDE * d : WIDE * (d + 1)]
            kid = kids[at].get(turn)
            if kid is None:
                kid = kids[at][turn] = grow(at, d + 1, int(sizes[d]))
            at = kid
        n[at], first[at], ends[at] = count, least, hashed
    for node in postorder(kids, list(tops.values())):
        saved[node] += (n[node] - 1) * size[node]
        leaves[node] = leaves[node] or 1
        if (up := parent[node]) >= 0:
            n[up] += n[node]
            leaves[up] += leaves[node]
            saved[up] += saved[node]
            first[up] = min(first[up], first[node])
    parents = [above[k][1] if up < 0 else first[up] for k, up in enumerate(parent)]
    keys = [above[k][0] if up < 0 else None for k, up in enumerate(parent)]
    return pd.DataFrame({"conv_id": np.array(first, dtype=np.int64), "depth": depth, "parent_conv_id": np.array(parents, dtype=np.int64), "n_convs": n, "n_children": [len(k) for k in kids], "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": ends, "parent_key": keys})


def trie(conversations: DataFrame, *, limit: int = LIMIT) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows = durable(sequences(durable(rebuild(conversations))))
    total = rows.agg(F.min("first").alias("first"), F.sum(F.size("sizes")).alias("turns"), F.count(F.lit(1)).alias("rows")).first()
    spark = rows.sparkSession
    if not total.rows:
        return spark.createDataFrame([], NODE)
    upper = [spark.createDataFrame([(b"", None, None, total.first, 0)], "key binary, parent_key binary, parent_first long, first long, size int")]
    pending, level, settled, ended = rows.select("*", F.lit(b"").alias("key"), F.lit(total.first).cast("long").alias("top")), 0, [], []
    while True:
        ended.append(pending.filter(F.size("sizes") == level).select("key", F.col("n").alias("own_n"), F.col("ends").alias("own_ends")))
        level += 1
        key = _digest(F.sha2(F.concat("key", F.substring("digests", WIDE * (level - 1) + 1, WIDE)), 256))
        deeper = pending.filter(F.size("sizes") >= level).select("digests", "sizes", "n", "first", "ends", F.lit(level).alias("level"), F.col("key").alias("parent_key"), F.col("top").alias("parent_first"), key.alias("key"))
        below = deeper.groupBy("key").agg(F.min("parent_key").alias("parent_key"), F.min("parent_first").alias("parent_first"), F.min("first").alias("first"), F.min(F.get("sizes", F.lit(level - 1))).alias("size"), F.sum(F.size("sizes") - level + 1).alias("_turns"), F.count(F.lit(1)).alias("_rows"))
        large = durable(below.filter((F.col("_turns") > limit) & (F.col("_rows") > 1)).drop("_turns", "_rows"))
        if large.isEmpty():
            settled.append(deeper)
            break
        settled.append(deeper.join(large.select("key"), "key", "left_anti").select(deeper.columns))
        upper.append(large)
        pending = durable(deeper.drop("parent_key", "parent_first", "level").join(large.select("key", F.col("first").alias("top")), "key"))
    whole = settled[0]
    for more in settled[1:]:
        whole = whole.unionByName(more)
    buckets = max(1, -(-(total.turns or 0) // limit))
    dealt = whole.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    nodes = durable(dealt.groupBy("bucket").applyInPandas(build_subtries, f"{NODE}, parent_key binary"))
    out, kept = nodes.drop("parent_key"), ["parent_key", "depth", "n_convs", "n_leaves", "saved_tokens"]
    last = nodes.filter("parent_key is not null").select(kept)
    tops = last
    for depth in range(len(upper) - 1, -1, -1):
        sums = tops.filter(F.col("depth") == depth + 1).groupBy("parent_key").agg(F.sum("n_convs").alias("n"), F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved"))
        found = upper[depth].join(sums.withColumnRenamed("parent_key", "key"), "key", "left").join(ended[depth], "key", "left").na.fill(0, ["n", "n_children", "n_leaves", "saved", "own_n"])
        n = F.col("n") + F.col("own_n")
        own = durable(found.select(F.col("first").alias("conv_id"), F.lit(depth).cast("long").alias("depth"), F.col("parent_first").alias("parent_conv_id"), n.alias("n_convs"), "n_children", F.greatest("n_leaves", F.lit(1)).cast("long").alias("n_leaves"), (F.col("saved") + (n - 1) * F.col("size")).alias("saved_tokens"), F.coalesce("own_ends", F.lit(NO_ENDS)).alias("ends_sha256"), "parent_key"))
        out = out.unionByName(own.drop("parent_key"))
        tops = last.unionByName(own.select(kept))
    return out
