"""Operator 4: benchmark decontamination with SimHash windows and multi-index Hamming blocks.

Every benchmark item of L words is compared with the L-word windows of every
text. A window's 64-bit SimHash over its 5-word shingles is looked up among the
fingerprints of the items of that length: the 64 bits are cut into radius + 1
blocks, so that any fingerprint within the radius agrees in one block at least
(pigeonhole), and the union of the block lists is complete. Candidates within
the radius are then verified by exact weighted-shingle (multiset) Jaccard
similarity.

Windows that cannot reach the similarity are not fingerprinted: with m
shingles on both sides, overlap o and similarity s = o / (2m - o), at least
2sm / (1 + s) of a window's shingles must occur in some item. This bound loses
nothing. A text shorter than an item is one window itself.

The index of one pass is broadcast and holds about ``items_per_pass`` items;
larger benchmarks take more passes over the texts. The texts are never shuffled.

Defined cases: null or empty texts match nothing; items without words are
left out; items shorter than five words are one shingle, their whole; repeated rows are
reported each; null doc ids are reported as null; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import SHINGLE, columns, groups, rolling, word_hashes

SIMILARITY = 0.8
RADIUS = 20
_SEED_BITS = 22


def _bits(shingle: np.ndarray) -> np.ndarray:
    """A row of 64 signs for each shingle hash."""
    return np.unpackbits(shingle.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1


def _fingerprints(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1).view(">u8").ravel().astype(np.uint64)


def _blocks(radius: int) -> list[tuple[np.uint64, np.uint64]]:
    edges = np.linspace(0, 64, radius + 2).round().astype(int)
    return [(np.uint64(a), np.uint64((1 << int(b - a)) - 1)) for a, b in zip(edges[:-1], edges[1:], strict=True)]


class ItemIndex:
    """Fingerprints, block tables and shingle multisets of one pass's items."""

    def __init__(self, ids: list[int], texts: list[str], radius: int = RADIUS, similarity: float = SIMILARITY) -> None:
        self.radius, self.similarity, self.blocks = radius, similarity, _blocks(radius)
        h, first = word_hashes(texts)
        self.items: dict[int, list[int]] = defaultdict(list)  # words -> places in the lists below
        self.ids, self.shingle, self.count, prints = [], [], [], []
        owners: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        for item, a, b in zip(ids, first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b > a:
                k = min(SHINGLE, b - a)
                every = rolling(h[a:b], k)
                own, count = np.unique(np.sort(every), return_counts=True)
                self.items[b - a].append(len(self.ids))
                self.ids.append(item)
                self.shingle.append(own)
                self.count.append(count)
                prints.append(_fingerprints(_bits(every).sum(axis=0, keepdims=True))[0])
                for x in own.tolist():
                    owners[k][x].add(b - a)
        self.prints = {n: np.array([prints[i] for i in at], dtype=np.uint64) for n, at in self.items.items()}
        self.tables = {n: [self._table(p, shift, mask) for shift, mask in self.blocks] for n, p in self.prints.items()}
        self.seeds = {}
        for k, lengths in owners.items():
            known = np.array(sorted(lengths), dtype=np.uint64)
            marks = np.zeros(1 << _SEED_BITS, dtype=bool)
            marks[known >> np.uint64(64 - _SEED_BITS)] = True
            self.seeds[k] = (known, marks, [sorted(lengths[x]) for x in known.tolist()])

    @staticmethod
    def _table(prints: np.ndarray, shift: np.uint64, mask: np.uint64) -> dict[int, np.ndarray]:
        value = (prints >> shift) & mask
        return {int(v): np.flatnonzero(value == v) for v in np.unique(value)}

    def candidates(self, words: int, prints: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(window, item place, distance) of all item fingerprints of that length within the radius."""
        own = self.prints[words]
        for w, fp in enumerate(prints.tolist()):
            lists = [t[v] for t, (shift, mask) in zip(self.tables[words], self.blocks, strict=True) if (v := (fp >> int(shift)) & int(mask)) in t]
            if lists:
                found = np.unique(np.concatenate(lists))
                distance = np.bitwise_count(own[found] ^ np.uint64(fp))
                for i, d in zip(found[distance <= self.radius].tolist(), distance[distance <= self.radius].tolist(), strict=True):
                    yield w, self.items[words][i], d

    def exact(self, item: int, window: np.ndarray) -> float:
        """Weighted Jaccard similarity of the shingle multisets."""
        own, count = self.shingle[item], self.count[item]
        at = np.minimum(np.searchsorted(own, window), len(own) - 1)
        there = np.bincount(at[own[at] == window], minlength=len(own))
        shared = np.minimum(there, count).sum()
        return float(shared / (count.sum() + len(window) - shared))

    def matches(self, texts: list[str | None]) -> dict[int, list[tuple[int, float, int, int, int]]]:
        """Per text with a match: (item id, similarity, distance, first word, words) of each matching item's best window."""
        h, first = word_hashes(texts)
        best: dict[tuple[int, int], tuple[float, int, int, int]] = {}
        for k, (known, marks, lengths) in self.seeds.items():
            every = rolling(h, k)
            at = np.flatnonzero(marks[every >> np.uint64(64 - _SEED_BITS)])
            place = np.minimum(np.searchsorted(known, every[at]), len(known) - 1)
            at, place = (x[known[place] == every[at]] for x in (at, place))
            text = np.searchsorted(first, at, side="right") - 1
            inside = at + k <= first[text + 1]
            near: dict[tuple[int, int], list[int]] = defaultdict(list)
            for p, u, t in zip(at[inside].tolist(), place[inside].tolist(), text[inside].tolist(), strict=True):
                for n in lengths[u]:
                    near[t, n].append(p)
            for (t, n), seeds in near.items():
                self._search(every, k, t, n, np.array(seeds), int(first[t]), int(first[t + 1]), best)
        out: dict[int, list[tuple[int, float, int, int, int]]] = defaultdict(list)
        for (t, item), (similarity, distance, start, n) in sorted(best.items()):
            out[t].append((self.ids[item], similarity, -distance, start, n))
        return out

    def _search(self, every: np.ndarray, k: int, t: int, n: int, seeds: np.ndarray, lo: int, hi: int, best: dict) -> None:
        size = min(n, hi - lo)  # words of a window
        m = size - k + 1
        share = self.similarity / (1 + self.similarity)
        need = max(1, int(np.ceil(share * (m + n - k + 1) - 1e-9)))
        if len(seeds) < need:
            return
        # windows that start at w hold the seeds in [w, w + m); the last start is hi - size
        a, b = max(lo, int(seeds[0]) - m + 1), min(hi - size, int(seeds[-1]))
        starts = np.arange(a, b + 1)
        starts = starts[np.searchsorted(seeds, starts + m) - np.searchsorted(seeds, starts) >= need]
        for part in np.split(starts, range(4096, len(starts), 4096)):
            if not len(part):
                continue
            base = int(part[0])
            sums = np.zeros((int(part[-1]) + m - base + 1, 64), dtype=np.int32)
            np.cumsum(_bits(every[base : int(part[-1]) + m]), axis=0, out=sums[1:])
            prints = _fingerprints(sums[part + m - base] - sums[part - base])
            for w, item, distance in self.candidates(n, prints):
                start = int(part[w])
                similarity = self.exact(item, every[start : start + m])
                found = (similarity, -distance, start - lo, size)
                if similarity >= self.similarity and ((t, item) not in best or found[:2] > best[t, item][:2]):
                    best[t, item] = found


def indexes(benchmark: DataFrame, *, items_per_pass: int = 20_000, radius: int = RADIUS, similarity: float = SIMILARITY) -> Iterator[ItemIndex]:
    """One index for each pass; each holds about ``items_per_pass`` items, dealt by hashed id and text."""
    items = columns(benchmark, item_id="long", text="string").filter("text is not null").distinct()
    passes = max(1, -(-items.count() // items_per_pass))
    for i in range(passes):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == i).orderBy("item_id", "text").toArrow()
        yield ItemIndex(own.column(0).to_pylist(), own.column(1).to_pylist(), radius, similarity)


def find_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per text and matching item: doc_id, item_id, similarity, distance, start_word, n_words."""
    given, sc, parts = columns(docs, doc_id="long", text="string"), docs.sparkSession.sparkContext, []
    schema = "doc_id long, item_id long, similarity double, distance int, start_word long, n_words long"
    for index in indexes(benchmark, **options):
        sent = sc.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                rows = [(ids[a + t], *m) for a, b in groups(texts) for t, found in sent.value.matches(texts[a:b]).items() for m in found]
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "similarity", "distance", "start_word", "n_words"])

        parts.append(given.mapInArrow(run, schema))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, columns unchanged, in whose text no benchmark item is found."""
    out, place = docs, docs.columns.index("text")
    for index in indexes(benchmark, **options):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(place).to_pylist()
                for a, b in groups(texts):
                    hit = sent.value.matches(texts[a:b])
                    yield batch.slice(a, b - a).filter(pa.array([t not in hit for t in range(b - a)], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out
