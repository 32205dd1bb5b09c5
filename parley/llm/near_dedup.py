"""Operator 5: near-duplicate classes from BagMinHash signatures.

A text is the multiset of its 5-word shingles, with counts as weights. Weights
are discretised to unit steps and grouped into dyadic intervals [0,1), [1,2),
[2,4), [4,8)...; each (shingle, interval) carries its own Poisson process whose
points have a time, a signature slot and a position in the interval. Points
beyond the shingle's weight are thinned out, which is the process's
hierarchical split. A slot keeps its earliest point, so two texts agree in a
slot with probability equal to their weighted Jaccard similarity. Points are
drawn in order of time up to a horizon that fills all slots; only a few per
text are needed, whatever its length.

Texts with equal word sequences are collapsed first. Signatures are banded;
texts that share a bucket, directly or through others, form a candidate
cluster (found by linking every member of a bucket to its first). Inside a
cluster every pair is compared by sketch, and pairs that may reach the
similarity are verified by exact multiset overlap unless links already join
them. That work stays in the task: only the links come out, no pairs. A large
cluster is first compared with its most central text; those linked to it are
its core and need not meet each other. It is then cut into blocks of bounded size, and each
pair of blocks, but for two of the core, is one task's group. Classes are the
connected components of the links.

Recall: with 30 bands of 6 slots a pair of similarity 0.8 shares a bucket with
probability 0.9999. The sketch filter drops pairs whose estimate from 180
slots is below 0.65, five standard errors under 0.8.

Defined cases: texts without words are in no class but their own; texts of 1 to
4 words are one shingle; equal and repeated rows share a class; rows with a null id are
returned with a null class; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import SHINGLE, columns, durable, groups, mix, rolling, word_hashes

BANDS, ROWS = 30, 6
SIMILARITY = 0.8
ESTIMATE = 0.65
_STEP = np.uint64(0x9E3779B97F4A7C15)


def multiset(shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, sorted, and their counts."""
    s = np.sort(shingle)
    at = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.empty(0, dtype=np.int64)
    return s[at], np.diff(np.r_[at, len(s)])


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two shingle multisets, 0 if one is empty."""
    (x, m), (y, n) = multiset(a), multiset(b)
    if not len(x) or not len(y):
        return 0.0
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    shared = np.minimum(m, n[at])[y[at] == x].sum()
    return float(shared / (len(a) + len(b) - shared))


def _unit(x: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1]."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], slots: int = BANDS * ROWS) -> np.ndarray:
    """A row of ``slots`` 64-bit names of earliest points for each non-empty multiset."""
    out = np.zeros((len(bags), slots), dtype=np.uint64)
    earliest = np.full(len(bags) * slots, np.inf)
    horizon = np.array([slots * (np.log(slots) + 4) / max(1, int(n.sum())) for _, n in bags])
    todo = np.arange(len(bags))
    name = out.reshape(-1)
    while len(todo):
        text = np.concatenate([np.full(len(bags[i][0]), i) for i in todo])
        shingle, weight = (np.concatenate([bags[i][k] for i in todo]) for k in (0, 1))
        parts = [(text, shingle, np.zeros(len(text)), np.ones(len(text)), weight)]
        low = 1
        while (over := weight > low).any():
            text, shingle, weight = text[over], shingle[over], weight[over]
            parts.append((text, shingle, np.full(len(text), float(low)), np.full(len(text), float(low)), weight))
            low *= 2
        text, shingle, start, length, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
        state = mix(shingle ^ mix((start * 2 + length).astype(np.uint64) + _STEP))
        limit, time, drawn = horizon[text], np.zeros(len(text)), 0
        while len(text):
            block = int(min(64, max(1, 60_000 // len(text))))
            point = mix(state[:, None] + _STEP * np.arange(drawn + 1, drawn + block + 1, dtype=np.uint64))
            times = time[:, None] - np.cumsum(np.log(_unit(point)), axis=1) / length[:, None]
            drawn += block
            row, col = np.nonzero(times <= limit[:, None])
            t, p = times[row, col], point[row, col]
            more = mix(p + np.uint64(1))
            kept = start[row] + length[row] * ((more & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32) < weight[row]
            at = text[row[kept]] * slots + ((more[kept] >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32)).astype(np.int64)
            t, p = t[kept], p[kept]
            np.minimum.at(earliest, at, t)
            first = earliest[at] == t
            name[at[first]] = p[first]
            alive = times[:, -1] <= limit
            text, state, start, length, weight, limit, time = text[alive], state[alive], start[alive], length[alive], weight[alive], limit[alive], times[alive, -1]
        open_ = np.isinf(earliest.reshape(len(bags), slots)[todo]).any(axis=1)
        todo = todo[open_]
        horizon[todo] *= 2
    return out


def _key(words: np.ndarray) -> bytes:
    return hashlib.blake2b(words.tobytes(), digest_size=16).digest()


def _shingles(words: np.ndarray) -> np.ndarray:
    return rolling(words, min(SHINGLE, max(1, len(words))))


def sketches(docs: DataFrame, *, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, key (digest of the word sequence; null without words), bands (bucket names) and sketch (a byte for each slot)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix(np.arange(1, bands + 1, dtype=np.uint64) * _STEP)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in groups(texts, 1 << 19):
                h, first = word_hashes(texts[a:b])
                words = [h[i:j] for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                full = [w for w in words if len(w)]
                sig = signatures([multiset(_shingles(w)) for w in full], bands * rows)
                bucket = np.repeat(salt[None, :], len(full), axis=0)
                for j in range(rows):
                    bucket = mix(bucket * _STEP + sig.reshape(len(full), bands, rows)[:, :, j])
                low = (sig & np.uint64(0xFF)).astype(np.uint8)
                it = iter(range(len(full)))
                at = [next(it) if len(w) else None for w in words]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array([_key(w) if len(w) else None for w in words], pa.binary()),
                        pa.array([None if i is None else bucket[i].view(np.int64) for i in at], pa.list_(pa.int64())),
                        pa.array([None if i is None else low[i].tobytes() for i in at], pa.binary()),
                    ],
                    ["doc_id", "key", "bands", "sketch"],
                )

    return columns(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, key binary, bands array<long>, sketch binary")


def _cluster_texts(reps: DataFrame, coarse: DataFrame, docs: DataFrame) -> DataFrame:
    """cluster, key, sketch and text of every text in a candidate cluster."""
    wanted = reps.select("key", "sketch", F.col("rep").alias("doc_id")).join(coarse.select("key", F.col("class").alias("cluster")), "key")
    texts = columns(docs, doc_id="long", text="string").join(wanted, "doc_id").select("cluster", "key", "sketch", "text")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # an id may stand for several texts; only the text with that key counts
        for batch in batches:
            keys, texts = batch.column(1).to_pylist(), batch.column(3).to_pylist()
            for lo, hi in groups(texts):
                h, first = word_hashes(texts[lo:hi])
                right = [k == _key(h[i:j]) for k, i, j in zip(keys[lo:hi], first[:-1].tolist(), first[1:].tolist(), strict=True)]
                yield batch.slice(lo, hi - lo).filter(pa.array(right, pa.bool_()))

    return texts.mapInArrow(own, "cluster binary, key binary, sketch binary, text string").dropDuplicates(["key"])


def _may_link(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Estimated similarities of sketch rows; chance agreement of a byte is taken off."""
    return ((x == y).mean(axis=-1) - 1 / 256) / (1 - 1 / 256)


def _group_links(keys: list[bytes], sketches_: list[bytes], texts: list[str], sides: list[int], estimate: float, similarity: float) -> list[tuple[bytes, bytes]]:
    """A spanning set of the links among the texts of one group; sides 0 and 1 are compared with each other, or all if there is one side."""
    n = len(keys)
    sketch = np.frombuffer(b"".join(sketches_), dtype=np.uint8).reshape(n, -1)
    side, parent, out, bags = np.array(sides), list(range(n)), [], {}

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def bag(i: int) -> np.ndarray:
        if i not in bags:
            bags[i] = _shingles(word_hashes([texts[i]])[0])
        return bags[i]

    two, found = len(set(sides)) > 1, []
    for i in range(n - 1):
        close = _may_link(sketch[i], sketch[i + 1 :])
        at = np.flatnonzero((close >= estimate) & (side[i + 1 :] != side[i] if two else True))
        found += zip((-close[at]).tolist(), [i] * len(at), (at + i + 1).tolist(), strict=True)
    for _, i, j in sorted(found):
        a, b = root(i), root(j)
        if a != b:
            x, y = bag(i), bag(j)
            if min(len(x), len(y)) >= similarity * max(len(x), len(y)) and weighted_jaccard(x, y) >= similarity:
                parent[a] = b
                out.append((keys[i], keys[j]))
    return out


def _links(rows: DataFrame, estimate: float, similarity: float) -> DataFrame:
    """Links of all groups; ``rows``: group, side, key, sketch, text. Groups are streamed one by one from sorted partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, out = None, ([], [], [], []), []  # keys, sketches, texts, sides

        def close() -> None:
            if len(held[0]) > 1:
                out.extend(_group_links(*held, estimate, similarity))
            for part in held:
                part.clear()

        def emit() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.binary()) for k in (0, 1)], ["a", "b"])
            out.clear()
            return done

        for batch in batches:
            cols = {c: batch.column(c).to_pylist() for c in ("group", "key", "sketch", "text", "side")}
            for group, *row in zip(*cols.values(), strict=True):
                if group != at:
                    close()
                    at = group
                for part, x in zip(held, row, strict=True):
                    part.append(x)
            if out:
                yield emit()
        close()
        yield emit()

    dealt = rows.select("group", "side", "key", "sketch", "text").repartition("group").sortWithinPartitions("group", "key")
    return dealt.mapInArrow(run, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """key, class (one key of its component) of every key in a link.

    Every round each key takes the least name next to it, and that one's; the links
    are then rewritten between names, and those within a name or repeated vanish.
    """
    ends = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    edges = durable(links.filter("a != b").select(*ends).distinct())
    names = edges.select(F.col("a").alias("key")).union(edges.select("b")).distinct().withColumn("class", F.col("key"))
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        up = durable(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("p")).select("v", F.least("v", "p").alias("p")))
        up = durable(up.join(up.select(F.col("v").alias("p"), F.col("p").alias("q")), "p").select("v", F.col("q").alias("p")))
        names = durable(names.join(up.withColumnRenamed("v", "class"), "class", "left").select("key", F.coalesce("p", "class").alias("class")))
        moved = edges.join(up.select(F.col("v").alias("a"), F.col("p").alias("x")), "a").join(up.select(F.col("v").alias("b"), F.col("p").alias("y")), "b")
        edges = durable(moved.select(F.col("x").alias("a"), F.col("y").alias("b")).filter("a != b").select(*ends).distinct())
    return names


def _block_groups(texts: DataFrame, sizes: DataFrame, block_rows: int, block_bytes: int, estimate: float, similarity: float) -> tuple[DataFrame, list[DataFrame]]:
    """Rows of every group to compare, and links found on the way."""
    sized = texts.join(sizes, "cluster")
    one = F.greatest(F.ceil(F.col("n") / block_rows), F.ceil(F.col("bytes") / block_bytes))
    small = sized.filter(one == 1).select(F.col("cluster").alias("group"), F.lit(0).alias("side"), "key", "sketch", "text")
    large = sized.filter(one > 1)
    if large.isEmpty():
        return small, []
    # compare with the central text: one row for each member, the two of them as a group
    central = large.filter("key = central").select("cluster", F.struct("key", "sketch", "text").alias("c"))
    met = large.filter("key != central").join(central, "cluster")
    pairs = met.select(F.sha2(F.concat("cluster", "key"), 256).cast("binary").alias("group"), F.explode(F.array(F.struct(F.lit(0).alias("side"), "key", "sketch", "text"), F.struct(F.lit(1).alias("side"), F.col("c.key"), F.col("c.sketch"), F.col("c.text")))).alias("x")).select("group", "x.*")
    star = durable(_links(pairs, estimate, similarity))
    core = star.select(F.col("a").alias("key")).union(star.select("b")).distinct().withColumn("core", F.lit(True))
    marked = durable(large.join(core, "key", "left").select("cluster", "key", "sketch", "text", F.coalesce("core", F.lit(False)).alias("core")))
    share = marked.groupBy("cluster", "core").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block_rows), F.ceil(F.sum(F.length("text")) / block_bytes)).cast("int").alias("blocks"))
    both = share.groupBy("cluster").agg(F.coalesce(F.max(F.when(~F.col("core"), F.col("blocks"))), F.lit(0)).alias("loose"), F.coalesce(F.max(F.when(F.col("core"), F.col("blocks"))), F.lit(0)).alias("firm"))
    own = marked.join(both, "cluster").withColumn("block", F.pmod(F.xxhash64("key"), F.when(F.col("core"), F.col("firm")).otherwise(F.col("loose"))).cast("int"))
    # a block of the core meets every loose block; a loose block meets every loose block, itself included, and the core's
    loose, firm = F.sequence(F.lit(0), F.col("loose") - 1), F.sequence(F.lit(0), F.col("firm") - 1)
    name = lambda kind, x, y: F.concat_ws(":", F.hex("cluster"), F.lit(kind), x, y).cast("binary")
    with_loose = F.transform(loose, lambda j: F.struct(name("l", F.least(F.col("block"), j).cast("string"), F.greatest(F.col("block"), j).cast("string")).alias("group"), F.when(F.col("block") > j, 1).otherwise(0).alias("side")))
    with_core = F.transform(firm, lambda j: F.struct(name("c", F.col("block").cast("string"), j.cast("string")).alias("group"), F.lit(0).alias("side")))
    from_core = F.transform(loose, lambda j: F.struct(name("c", j.cast("string"), F.col("block").cast("string")).alias("group"), F.lit(1).alias("side")))
    none = F.array().cast("array<struct<group:binary,side:int>>")
    meets = F.when(F.col("core"), F.when(F.col("loose") > 0, from_core).otherwise(none)).otherwise(F.concat(with_loose, F.when(F.col("firm") > 0, with_core).otherwise(none)))
    cut = own.withColumn("g", F.explode(meets)).select("g.group", "g.side", "key", "sketch", "text")
    return small.unionByName(cut), [star]


def _classes(docs: DataFrame, *, similarity: float = SIMILARITY, estimate: float = ESTIMATE, bands: int = BANDS, rows: int = ROWS, block_rows: int = 512, block_bytes: int = 32 << 20) -> tuple[DataFrame, DataFrame]:
    """Sketches of all rows; key, rep (least doc_id) and class of every text with words."""
    sketch = durable(sketches(docs, bands=bands, rows=rows))
    named = sketch.filter("key is not null and doc_id is not null")
    reps = durable(named.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")))
    member = reps.select("key", F.explode("bands").alias("bucket"))
    crowded = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("a")).filter("n > 1")
    shared = durable(member.join(crowded, "bucket").groupBy("a", F.col("key").alias("b")).agg(F.sum("n").alias("n")))
    classes = None
    if not shared.isEmpty():
        coarse = components(shared.filter("a != b"))
        texts = durable(_cluster_texts(reps, coarse, docs))
        weight = shared.groupBy(F.col("b").alias("key")).agg(F.sum("n").alias("w"))
        sizes = durable(texts.select("cluster", "key", F.length("text").alias("bytes")).join(weight, "key").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.max_by("key", F.struct("w", "key")).alias("central")))
        compared, links = _block_groups(texts, sizes, block_rows, block_bytes, estimate, similarity)
        found = durable(reduce(DataFrame.union, [_links(compared, estimate, similarity), *links]))
        if not found.isEmpty():
            classes = components(found)
    if classes is None:
        return sketch, reps.select("key", "rep", F.col("key").alias("class"))
    return sketch, reps.select("key", "rep").join(classes, "key", "left").withColumn("class", F.coalesce("class", "key"))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id of every row; class_id is the least doc_id of the class."""
    sketch, whole = _classes(docs, **options)
    found = sketch.select("doc_id", "key")
    by_class = whole.join(whole.groupBy("class").agg(F.min("rep").alias("class_id")), "class").select("key", "class_id")
    named = found.filter("key is not null and doc_id is not null").join(by_class, "key").select("doc_id", "class_id")
    alone = found.filter("key is null or doc_id is null").select("doc_id", F.when(F.col("key").isNull(), F.col("doc_id")).alias("class_id"))
    return named.unionByName(alone)


def _with_key(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` and the key of each text, empty without words."""
    schema = docs.select("*", F.lit(b"").alias(name)).schema
    given = docs.withColumn(name, F.col("text").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keys = batch.column(batch.num_columns - 1).to_pylist(), []
            for a, b in groups(texts):
                h, first = word_hashes(texts[a:b])
                keys += [_key(h[i:j]) if j > i else b"" for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(keys, pa.binary())], batch.schema.names)

    return given.mapInArrow(run, schema)


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One row of every class, of its text of least id (then least key), and of equal texts of that id the one of least hash; rows with a null id all stay."""
    sketch, whole = _classes(docs, **options)
    key, doc = (next(n for n in (f"{base}{'_' * i}" for i in range(len(docs.columns) + 1)) if n not in docs.columns) for base in ("_text_key", "_text_id"))
    first = whole.groupBy("class").agg(F.min(F.struct("rep", "key")).alias("at")).select(F.col("at.rep").alias(doc), F.col("at.key").alias(key))
    wordless = sketch.filter("key is null and doc_id is not null").select(F.col("doc_id").alias(doc), F.lit(b"").alias(key)).distinct()
    named = _with_key(docs.filter("doc_id is not null"), key).withColumn(doc, F.col("doc_id").cast("long"))
    rows = named.join(first.unionByName(wordless), [doc, key], "left_semi")
    own = [F.col(f"`{c}`") for c in docs.columns]
    one = rows.groupBy(doc, key).agg(F.min_by(F.struct(*own), F.xxhash64(*own)).alias("row")).select("row.*")
    return one.select(docs.columns).unionByName(docs.filter("doc_id is null"))
