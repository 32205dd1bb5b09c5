"""Operator 3: language-model scores from a probabilistic suffix tree.

Texts are lower-cased (A-Z) and cut at white space. The tree's symbols are
the words of the training texts (the ``alphabet`` most frequent ones), the end
of a text, and one symbol for every other word, which is then spelled byte by
byte by a small tree over bytes, learned from the rare words. A context is the
one or two symbols before a symbol.

* A next symbol seen c >= 2 times in a context of n symbols gets the share
  (c - discount) / n. It is stored if it diverges from its probability in the
  suffix (the context one symbol shorter): c times the log-ratio of the two must reach
  ``entry_cost`` nats. What the stored ones leave is the context's open mass,
  which all symbols share as in the suffix. The root is Witten-Bell smoothed:
  its open mass goes to words outside the alphabet.
* A context is kept if the log-likelihood of its own next symbols gains
  ``least_gain`` nats, with ``entry_cost`` paid for each stored one. A context
  of two symbols is looked at if its suffix is kept and its second symbol is
  stored for its first.
* A symbol is scored in the longest kept context before it.

In that form the score is a sum: the root's logarithms, and what each kept
context on the way to the longest one, and each stored symbol of it, adds. So
the tree is a table (key, value). The ``head_keys`` most used keys are sent to
the tasks; the others are joined, for the places where a bitmap of bounded
size says that such a key may exist. Every kept context and every stored symbol counts,
whichever way it is looked up. For the base score the counts of the ``head_words``
most frequent words are sent, and the others joined in the same pass. Words are
told apart by a 64-bit hash.

Defined cases: a null text counts as empty, which is one token, the end; a null
id is no held-out one; equal rows get equal scores, one row each; with no training text the
base score is 0 and words are spelled by uniform bytes; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from parley.llm.common import columns, durable, mix, powers, release

BITS = 20
ALPHABET, HEAD_WORDS, HEAD_KEYS = (1 << BITS) - 2, 1 << BITS, 1 << 22
DISCOUNT = 0.75
#: What a stored symbol and a kept context must earn, in nats: the cost of naming one symbol of 2**BITS for the context, and one more for the symbol stored in it.
LEAST_GAIN = BITS * math.log(2)
ENTRY_COST = 2 * LEAST_GAIN
END, OTHER, FIRST = 0, 1, 2  # ids of the end (and begin) of a text, of words outside the alphabet, of the first word
ONE_NEXT, TWO, TWO_NEXT = (np.int64(k) << np.int64(60) for k in (1, 2, 3))  # kinds of keys: a context of 1 or 2 symbols, with a next symbol or without
BITMAP_BITS = 26
_CHUNK = 1 << 19
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Words found so often at most teach the spelling of words outside the alphabet.
RARE = 8
#: Symbols of the spelling: END closes a word, ESCAPE stands before a rare byte.
SYMBOLS, SYMBOL_BITS, SPELL_DEPTH, SPELL_GAIN = 64, 6, 3, 10.0
ESCAPE = SYMBOLS - 1


def held_out() -> Column:
    """Whether a row is kept from training, by its id."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2


@dataclass
class Chunk:
    """Words of some texts: their hashes, the bytes they stand in, and for each text (plus one) its first word."""

    raw: np.ndarray  # lower-cased bytes
    start: np.ndarray
    stop: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    begin: np.ndarray  # first byte of each text

    @property
    def text(self) -> np.ndarray:
        """Text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def symbols(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all words and ends in order: the symbol, the one before, the one before that (0 beyond the begin), and the place of each word."""
        place = np.arange(len(ids)) + self.text
        symbol = np.zeros(len(ids) + len(self.first) - 1, dtype=np.int64)
        symbol[place] = ids
        one, two = np.zeros_like(symbol), np.zeros_like(symbol)
        one[1:], two[2:] = symbol[:-1], symbol[:-2]
        two[one == END] = END
        return symbol, one, two, place


def chunks(texts: pa.Array) -> Iterator[Chunk]:
    """Words of a column without nulls, for about half a million bytes at a time; a longer text stands alone."""
    texts = texts.cast(pa.large_binary())
    offset = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offset, offset[lo] + _CHUNK, side="right")) - 1)
        at = offset[lo : hi + 1] - offset[lo]
        raw = _LOWER[whole[offset[lo] : offset[hi]]]
        inside = np.zeros(len(raw) + 2, dtype=bool)
        inside[1:-1] = ~_SPACE[raw]
        edge = np.zeros(len(raw) + 1, dtype=bool)
        edge[at] = True
        start = np.flatnonzero(inside[1:] & (edge | ~inside[:-1]))
        stop = np.flatnonzero(inside[:-1] & (edge | ~inside[1:]))
        up, down = powers(len(raw) + 1)
        total = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
        hashed = mix((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64))
        yield Chunk(raw, start, stop, hashed, np.searchsorted(start, at), at)
        lo = hi


def packed(x: np.ndarray) -> tuple[str, int, bytes]:
    """An array in few bytes for sending: its bytes by significance, compressed."""
    raw = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes()
    return x.dtype.str, len(x), pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(kind: str, n: int, data: bytes) -> np.ndarray:
    wide = np.dtype(kind).itemsize
    raw = np.frombuffer(pa.decompress(data, n * wide, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(wide, n).T).view(kind).ravel()


class Packed:
    """Arrays that are pickled in few bytes."""

    def __init__(self, *arrays: np.ndarray) -> None:
        self.arrays = arrays

    def __getstate__(self) -> list:
        return [packed(x) for x in self.arrays]

    def __setstate__(self, state: list) -> None:
        self.arrays = tuple(unpacked(*x) for x in state)


class Lookup:
    """Places of distinct 64-bit keys in a sorted array, by their leading bits and a few steps."""

    def __init__(self, keys: np.ndarray, spread: bool = False) -> None:
        """``keys`` in order; ``spread``: they are no hashes, so they are in the order of a mixed form."""
        self.spread = spread
        self._index(mix(keys.view(np.uint64)) if spread else keys.view(np.uint64))

    @staticmethod
    def order(keys: np.ndarray, spread: bool = False) -> np.ndarray:
        """The order that ``keys`` must have."""
        return np.argsort(mix(keys.view(np.uint64)) if spread else keys.view(np.uint64))

    def _index(self, ordered: np.ndarray) -> None:
        self.keys = np.r_[ordered, np.uint64((1 << 64) - 1)]
        bits = max(1, int(len(ordered)).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.begin = np.searchsorted(ordered >> self.shift, np.arange(1 << bits, dtype=np.uint64)).astype(np.int32)

    def __getstate__(self) -> tuple:
        return self.spread, packed(np.diff(self.keys[:-1], prepend=np.uint64(0)))

    def __setstate__(self, state: tuple) -> None:
        self.spread = state[0]
        self._index(np.cumsum(unpacked(*state[1]), dtype=np.uint64))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key in the sorted array, -1 if it is not there."""
        keys = mix(keys.view(np.uint64)) if self.spread else keys.view(np.uint64)
        at = self.begin[keys >> self.shift]
        todo = np.flatnonzero(self.keys[at] < keys)
        while len(todo):
            at[todo] += 1
            todo = todo[self.keys[at[todo]] < keys[todo]]
        return np.where((self.keys[at] == keys) & (at < len(self.keys) - 1), at, -1)


def _bit(keys: np.ndarray) -> np.ndarray:
    return mix(keys.view(np.uint64) + np.uint64(7)) >> np.uint64(64 - BITMAP_BITS)


def bitmap(keys: DataFrame) -> np.ndarray:
    """Bits of all values of the one long column; false positives are possible, nothing is missed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = np.unique(_bit(batch.column(0).to_numpy()))
            word = (bit >> np.uint64(6)).astype(np.int64)
            at = np.flatnonzero(np.r_[True, word[1:] != word[:-1]][: len(word)])
            if len(at):
                mask = np.bitwise_or.reduceat(np.uint64(1) << (bit & np.uint64(63)), at)
                yield pa.RecordBatch.from_arrays([pa.array(word[at]), pa.array(mask.view(np.int64))], ["word", "mask"])

    words = keys.mapInArrow(run, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()  # 2**20 rows at most
    out = np.zeros(1 << (BITMAP_BITS - 6), dtype=np.uint64)
    out[words.column("word").to_numpy()] = words.column("mask").to_numpy().view(np.uint64)
    return out


def may_hold(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bit = _bit(keys)
    return bits[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1) > 0


def _merged(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with summed counts."""
    if counts is None:
        keys = np.sort(keys)
        at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
        return keys[at], np.diff(np.r_[at, len(keys)]).astype(np.int32)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def _counted(texts: DataFrame, keys: Callable[[Chunk], dict[int, np.ndarray]]) -> DataFrame:
    """kind, key and n: how often each key that ``keys`` finds occurs. Tasks add up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for kind, parts in held.items():
                own, n = _merged(*map(np.concatenate, zip(*parts, strict=True)))
                for lo in range(0, len(own), 100_000):
                    part = slice(lo, lo + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own[part]), kind, dtype=np.int32)), pa.array(own[part]), pa.array(n[part].astype(np.int64))], ["kind", "key", "n"])
            held.clear()

        size = 0
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                for kind, own in keys(chunk).items():
                    if len(own):
                        held.setdefault(kind, []).append(_merged(own))
                        size += len(held[kind][-1][0])
                if size > 1_500_000:
                    held = {kind: [_merged(*map(np.concatenate, zip(*parts, strict=True)))] for kind, parts in held.items()}
                    size = sum(len(parts[0][0]) for parts in held.values())
                    if size > 1_000_000:
                        yield from out()
                        size = 0
        yield from out()

    return texts.mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def count_words(texts: DataFrame) -> DataFrame:
    """kind 0: words by hash; kind 1: bytes; kind 2: texts."""
    return _counted(texts, lambda c: {0: c.hash.view(np.int64), 1: c.raw[~_SPACE[c.raw]].astype(np.int64), 2: np.zeros(len(c.first) - 1, dtype=np.int64)})


def cutoff(values: DataFrame, column: str, most: int) -> float:
    """Least value such that at most ``most`` rows reach it, found on a grid of eighth powers of two."""
    steps = values.select(F.floor(F.log2(column) * 8).cast("int").alias("step")).groupBy("step").count().orderBy(F.col("step").desc()).collect()
    left, cut = most, math.inf
    for row in steps:
        left -= row["count"]
        if left < 0:
            break
        cut = 2.0 ** (row["step"] / 8)
    return cut


class Alphabet:
    """The most frequent words (the ``head``), the symbols of those found ``cut`` times or more, and the root's distribution."""

    def __init__(self, words: Lookup, found: np.ndarray, cut: float, tokens: int, kinds: int, texts: int, table: np.ndarray, escaped: np.ndarray) -> None:
        """``found``: count of each word; ``tokens``, ``kinds``, ``texts``: of the training texts; ``table``, ``escaped``: spelling symbol of each byte, and log10 probability of a byte after an escape."""
        self.words, self.cut, self.totals, self.table, self.escaped = words, cut, (tokens, kinds, texts), table, escaped
        self._derive(found)

    def _derive(self, found: np.ndarray) -> None:
        tokens, kinds, texts = self.totals
        self.found, own = found, found >= self.cut
        self.id = np.where(own, np.cumsum(own) + FIRST - 1, OTHER).astype(np.int32)
        self.counts = np.r_[texts, max(0, tokens - texts - found[own].sum()), found[own]].astype(np.float64)
        mass = self.counts.copy()
        mass[OTHER] += max(1, kinds)
        mass[END] = max(mass[END], 1)
        self.log = np.log10(mass / mass.sum())

    def __getstate__(self) -> tuple:
        return self.words, self.cut, self.totals, self.table, self.escaped, packed(self.found)

    def __setstate__(self, state: tuple) -> None:
        self.words, self.cut, self.totals, self.table, self.escaped = state[:5]
        self._derive(unpacked(*state[5]))

    def ids(self, chunk: Chunk) -> np.ndarray:
        return self.at(self.words.find(chunk.hash))

    def at(self, places: np.ndarray) -> np.ndarray:
        return np.where(places >= 0, self.id[places], OTHER) if len(self.id) else np.full(len(places), OTHER)

    def spelled(self, chunk: Chunk, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each byte of the words ``own`` and the END after each: the code of up to ``SPELL_DEPTH`` symbols before it and its own symbol, the byte (0 for END), and the word.

        The symbols before may belong to the word before; white space and the begin of a text read as END.
        """
        size = chunk.stop[own] - chunk.start[own] + 1
        word = np.repeat(own, size)
        at = np.arange(len(word)) - np.repeat(np.cumsum(size) - size - chunk.start[own], size)
        last = at == chunk.stop[word]
        symbols = np.zeros(SPELL_DEPTH + len(chunk.raw) + 1, dtype=np.int64)
        symbols[SPELL_DEPTH:-1] = np.where(_SPACE[chunk.raw], END, self.table[chunk.raw])
        raw = np.where(last, 0, np.r_[chunk.raw, np.uint8(0)][at])
        code = np.where(last, END, symbols[SPELL_DEPTH + at])
        first = chunk.begin[chunk.text[word]]
        for back in range(1, SPELL_DEPTH + 1):
            code |= np.where(at - back >= first, symbols[SPELL_DEPTH + at - back], END) << (SYMBOL_BITS * back)
        return code, raw, word


def make_alphabet(counted: DataFrame, most: int, head_words: int) -> Alphabet:
    """From the counts of words, bytes and texts; at most ``most`` words get symbols, the most frequent ones."""
    words = counted.filter("kind = 0")
    got = words.filter(F.col("n") >= cutoff(words, "n", max(most, head_words))).select("key", "n").toArrow()
    total = counted.filter("kind != 1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"), F.coalesce(F.sum(F.when(F.col("kind") == 2, F.col("n"))), F.lit(0)).alias("ends")).first()
    key = got.column("key").to_numpy()
    order = Lookup.order(key)
    histogram = {r.key: r.n for r in counted.filter("kind = 1").collect()}  # at most 256 rows
    by_count = sorted(histogram, key=lambda b: (-histogram[b], b))
    table = np.full(256, ESCAPE, dtype=np.uint8)
    for symbol, byte in enumerate(by_count[: SYMBOLS - 2], start=1):
        table[byte] = symbol
    rare = np.array([0 if table[b] != ESCAPE else histogram.get(b, 0) for b in range(256)])
    escaped = np.where(table == ESCAPE, np.log10((rare + 1) / (rare.sum() + 256)), 0.0)
    return Alphabet(Lookup(key[order]), got.column("n").to_numpy()[order], cutoff(words, "n", most), int(total.n), int(total.v), int(total.ends), table, escaped)


@dataclass
class Spelling:
    """State of each run of ``SPELL_DEPTH`` symbols (the longest kept suffix), and log10 probabilities by state."""

    state: np.ndarray
    log: np.ndarray

    def scores(self, codes: np.ndarray) -> np.ndarray:
        return self.log[self.state[codes >> SYMBOL_BITS], codes & (SYMBOLS - 1)]


def make_spelling(codes: np.ndarray, counts: np.ndarray) -> Spelling:
    """Tree over bytes: a context is kept if count times divergence from its suffix, less a half log of the count for each symbol seen, reaches ``SPELL_GAIN``."""
    nothing = np.zeros(1 << (SYMBOL_BITS * SPELL_DEPTH), dtype=np.int32)
    n = np.bincount(codes & (SYMBOLS - 1), counts, minlength=SYMBOLS)
    logs, plain, state = [(n + 1) / (n.sum() + SYMBOLS)], [n / max(1, n.sum())], nothing
    every = np.arange(len(nothing))
    for d in range(1, SPELL_DEPTH + 1):
        mask = (1 << (SYMBOL_BITS * d)) - 1
        context, row = np.unique(codes >> SYMBOL_BITS & mask, return_inverse=True)
        own = np.bincount(row * SYMBOLS + (codes & (SYMBOLS - 1)), counts, minlength=len(context) * SYMBOLS).reshape(-1, SYMBOLS)
        up = state[context]  # so far, states are of contexts shorter than d
        total, kinds = own.sum(axis=1, keepdims=True), (own > 0).sum(axis=1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(own > 0, own * np.log(own / total / np.array(plain)[up]), 0.0).sum(axis=1) - 0.5 * (np.log(total) * kinds)[:, 0]
        kept = np.flatnonzero(gain >= SPELL_GAIN)
        names = np.full(mask + 1, -1, dtype=np.int32)
        names[context[kept]] = len(logs) + np.arange(len(kept))
        logs += list((own[kept] + kinds[kept] * np.array(logs)[up[kept]]) / (total[kept] + kinds[kept]))
        plain += list(own[kept] / total[kept])
        state = np.where(names[every & mask] >= 0, names[every & mask], state)
    return Spelling(state, np.log10(np.array(logs)).astype(np.float32))


def _judge(c: np.ndarray, n: np.ndarray, up: np.ndarray, discount: float, entry_cost: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Share of each symbol in its context, the nats it gains, and whether it is worth storing."""
    share = (c - discount) / n
    gain = c * np.log(share / up) - entry_cost
    return share, gain, gain >= 0



def train(texts: DataFrame, sent: Broadcast, *, discount: float = DISCOUNT, entry_cost: float = ENTRY_COST, least_gain: float = LEAST_GAIN) -> tuple[Spelling, np.ndarray, DataFrame]:
    """Spelling tree, log10 open mass of each kept context of one symbol (0: not kept), and key, value and uses of the rest of the tree; ``sent``: the alphabet."""
    sc = texts.sparkSession.sparkContext
    low = (1 << BITS) - 1

    def pairs(chunk: Chunk) -> dict[int, np.ndarray]:
        ids = sent.value.ids(chunk)
        symbol, one, _, _ = chunk.symbols(ids)
        often = sent.value.counts > 1  # a pair cannot be found oftener than its symbols
        return {0: (one << BITS | symbol)[often[one] & often[symbol]], 1: sent.value.spelled(chunk, np.flatnonzero((ids == OTHER) | (sent.value.counts[ids] <= RARE)))[0]}

    def judge_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            kind, key, c = (batch.column(k).to_numpy() for k in range(3))
            pair = np.where(kind == 0, key, 0)
            stored = _judge(c, own.counts[pair >> BITS], 10.0 ** own.log[pair & low], discount, entry_cost)[2]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(stored & (kind == 0))], ["kind", "key", "c", "stored"])

    def shares(key: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, ...]:
        own = sent.value
        up, n = 10.0 ** own.log[key & low], own.counts[key >> BITS]
        return (up, n, *_judge(c, n, up, discount, entry_cost)[:2])

    def sums_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, c = (batch.column(k).to_numpy() for k in range(2))
            _, n, share, gain = shares(key, c)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key >> BITS, c, n, share, gain)], ["context", "c", "n", "share", "gain"])

    found = durable(_counted(texts, pairs).filter("kind = 1 or n > 1").mapInArrow(judge_one, "kind int, key long, c long, stored boolean"))
    release(texts)
    spelled = found.filter("kind = 1").select("key", "c").toArrow()  # runs of four symbols of 64
    spelling = make_spelling(spelled.column(0).to_numpy(), spelled.column(1).to_numpy())
    stored = found.filter("stored").select("key", "c")
    sums = stored.mapInArrow(sums_one, "context long, c long, n double, share double, gain double").groupBy("context").agg(F.sum("share").alias("share"), F.sum("c").alias("c"), F.first("n").alias("n"), F.sum("gain").alias("gain"))
    one = sums.filter(F.col("gain") + (F.col("n") - F.col("c")) * F.log(1 - F.col("share")) >= least_gain).select("context", "share").toArrow()  # at most one row for each symbol
    masses = np.zeros(len(sent.value.log))
    masses[one.column("context").to_numpy()] = np.log10(1 - one.column("share").to_numpy())
    # pairs that make a context, and pairs found twice, as the last two of three symbols must be
    grown = sc.broadcast(Packed(masses.astype(np.float32), bitmap(stored.select("key")), bitmap(found.filter("kind = 0").select("key"))))

    def values_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, c = (batch.column(k).to_numpy() for k in range(2))
            open_, (up, _, share, _) = grown.value.arrays[0][key >> BITS].astype(np.float64), shares(key, c)
            p = share + 10.0**open_ * up
            kept = pa.array(open_ < 0)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(c), pa.array(p), pa.array(np.log10(p / up) - open_)], ["key", "uses", "p", "value"]).filter(kept)

    one_next = durable(stored.mapInArrow(values_one, "key long, uses long, p double, value double"))

    def triples(chunk: Chunk) -> dict[int, np.ndarray]:
        symbol, one, two, _ = chunk.symbols(sent.value.ids(chunk))
        mass, contexts, twice = grown.value.arrays
        at = np.flatnonzero((mass[one] < 0) & (one != END))
        at = at[may_hold(twice, one[at] << BITS | symbol[at])]
        context = two[at] << BITS | one[at]
        seen = may_hold(contexts, context)
        return {0: context[seen] << BITS | symbol[at][seen]}

    def judge_two(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, c, context, n = (batch.column(k).to_numpy() for k in range(4))
            up = batch.column(4).to_numpy(zero_copy_only=False)  # nan: the suffix has not stored it
            up = np.where(np.isnan(up), 10.0 ** (grown.value.arrays[0][context & low] + sent.value.log[key & low]), up)
            share, gain, stored = _judge(c, n, up, discount, entry_cost)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(up), pa.array(share), pa.array(gain)], ["key", "c", "context", "n", "up", "share", "gain"]).filter(pa.array(stored))

    three = _counted(texts, triples).filter("n > 1").select("key", F.col("n").alias("c"), F.shiftright("key", BITS).alias("context"), F.col("key").bitwiseAND(F.lit((1 << 2 * BITS) - 1)).alias("pair"))
    three = three.join(one_next.select(F.col("key").alias("pair"), F.col("p").alias("up")), "pair", "left")
    three = three.join(stored.select(F.col("key").alias("context"), F.col("c").alias("n")), "context").select("key", "c", "context", F.col("n").cast("double").alias("n"), F.coalesce("up", F.lit(math.nan)).alias("up"))
    three = three.mapInArrow(judge_two, "key long, c long, context long, n double, up double, share double, gain double")
    own = W.partitionBy("context")
    summed = three.withColumns({"all": F.sum("share").over(own), "gain": F.sum("gain").over(own) + (F.col("n") - F.sum("c").over(own)) * F.log(1 - F.sum("share").over(own)), "rank": F.row_number().over(own.orderBy("key"))})
    two = durable(summed.filter(F.col("gain") >= least_gain).select("key", "c", "context", "n", "up", "share", F.log10(1 - F.col("all")).alias("mass"), "rank"))
    release(texts)
    table = one_next.select((F.col("key") + F.lit(int(ONE_NEXT))).alias("key"), "value", "uses")
    table = table.unionByName(two.filter("rank = 1").select((F.col("context") + F.lit(int(TWO))).alias("key"), F.col("mass").alias("value"), F.col("n").cast("long").alias("uses")))
    added = F.log10(F.col("share") / F.col("up") + F.pow(F.lit(10.0), F.col("mass"))) - F.col("mass")
    return spelling, masses, table.unionByName(two.select((F.col("key") + F.lit(int(TWO_NEXT))).alias("key"), added.alias("value"), F.col("c").alias("uses")))


@dataclass
class Tree:
    """What a task needs besides the alphabet: the spelling, the head of the tree, and where the rest may matter."""

    spelling: Spelling
    head: Lookup
    arrays: Packed  # open masses of contexts of one symbol, values of the head, bitmap of the keys outside the head (or nothing)

    def read(self, alphabet: Alphabet, chunk: Chunk, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 probability of each text by what is here, and the lookups outside: text and key."""
        masses, values, rest = self.arrays.arrays
        symbol, one, two, place = chunk.symbols(ids)
        text = np.repeat(np.arange(len(chunk.first) - 1), np.diff(chunk.first) + 1)
        score = alphabet.log[symbol] + masses[one]
        codes, raw, word = alphabet.spelled(chunk, np.flatnonzero(ids == OTHER))
        each = self.spelling.scores(codes) + alphabet.escaped[raw] * (codes & (SYMBOLS - 1) == ESCAPE)
        np.add.at(score, place[word], each)
        at = np.flatnonzero(masses[one] < 0)
        outside = []

        def look(where: np.ndarray, keys: np.ndarray) -> np.ndarray:
            """Add the values of the keys to the places; True where a key is, or may be."""
            found = self.head.find(keys)
            hit = found >= 0
            score[where[hit]] += values[found[hit]]
            if len(rest):
                open_ = np.flatnonzero(~hit)
                open_ = open_[may_hold(rest, keys[open_])]
                outside.append((text[where[open_]], keys[open_]))
                hit[open_] = True
            return hit

        look(at, one[at] << BITS | symbol[at] | ONE_NEXT)
        context = two[at] << BITS | one[at]
        hit = look(at[one[at] != END], context[one[at] != END] | TWO)
        at, context = at[one[at] != END][hit], context[one[at] != END][hit]
        look(at, context << BITS | symbol[at] | TWO_NEXT)
        owner, key = (np.concatenate(x) for x in zip(*outside, strict=True)) if outside else (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))
        return np.bincount(text, score, minlength=len(chunk.first) - 1), owner, key


def score(docs: DataFrame, *, alphabet: int = ALPHABET, head_words: int = HEAD_WORDS, head_keys: int = HEAD_KEYS, **options) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    docs = columns(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    training = docs.filter(~held_out()).select("text")
    counted = durable(count_words(training))
    total = counted.filter("kind != 1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("words"), F.coalesce(F.max(F.col("kind") == 2), F.lit(False)).alias("any")).first()
    own = make_alphabet(counted, alphabet, head_words)
    sc = docs.sparkSession.sparkContext
    sent = sc.broadcast(own)
    spelling, masses, table = train(training, sent, **options)
    cut = cutoff(table, "uses", head_keys)
    head, rest = table.filter(F.col("uses") >= cut).select("key", "value").toArrow(), table.filter(F.col("uses") < cut)
    key, value = head.column("key").to_numpy(), head.column("value").to_numpy()
    order = Lookup.order(key, spread=True)
    outside = bitmap(rest.select("key")) if head.num_rows < table.count() else np.empty(0, dtype=np.uint64)
    tree = Tree(spelling, Lookup(key[order], spread=True), Packed(masses.astype(np.float32), value[order].astype(np.float32), outside))
    del head, key, value, order
    below = math.log10(total.n + total.words + 1)  # the end is one of the distinct tokens
    trees = sc.broadcast(tree)
    end, ends_known = math.log10(own.counts[END] + 1) - below, int(total.any)
    schema = "doc_id long, t long, word boolean, key long, n long, held_out boolean, n_tokens long, n_known long, base double, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, tree, logs = sent.value, trees.value, np.log10(sent.value.found + 1) - below
        names = schema.replace(",", "").split()[::2]
        for batch in batches:
            lo = 0
            for chunk in chunks(batch.column(1)):
                m = len(chunk.first) - 1
                places, text = model.words.find(chunk.hash), chunk.text
                ids = model.at(places)
                value, owner, key = tree.read(model, chunk, ids)
                known = places >= 0
                base = np.bincount(text[known], logs[places[known]], minlength=m) + end
                size = np.diff(chunk.first)
                mixed = mix(chunk.hash + np.arange(len(ids), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) - (chunk.first[text].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
                running = np.r_[np.uint64(0), np.cumsum(mixed, dtype=np.uint64)]
                t = (running[chunk.first[1:]] - running[chunk.first[:-1]]).view(np.int64)
                doc, held = batch.column(0).slice(lo, m), batch.column(2).slice(lo, m)
                lo += m
                none = lambda n, kind: pa.nulls(n, kind)
                yield pa.RecordBatch.from_arrays(
                    [doc, pa.array(t), none(m, pa.bool_()), pa.array(t), none(m, pa.int64()), held, pa.array(size + 1), pa.array(np.bincount(text[known], minlength=m) + ends_known), pa.array(base), pa.array(value)],
                    names,
                )
                # the lookups outside, equal ones of a text together
                for word, who, what in ((True, text[~known], chunk.hash[~known].view(np.int64)), (False, owner, key)):
                    if not len(who):
                        continue
                    order = np.lexsort((what, who))
                    who, what = who[order], what[order]
                    at = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (what[1:] != what[:-1])])
                    n = np.diff(np.r_[at, len(who)])
                    who, k = who[at], len(at)
                    yield pa.RecordBatch.from_arrays(
                        [doc.take(pa.array(who)), pa.array(t[who]), pa.array(np.full(k, word)), pa.array(what[at]), pa.array(n), *(none(k, kind) for kind in (pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()))],
                        names,
                    )

    parts = docs.select("doc_id", "text", held_out().alias("held")).mapInArrow(run, schema)
    # a row for each text, one for each of its words outside the head, and one for each key that may
    # be outside the head; equal rows have one doc_id and t
    words = counted.filter("kind = 0").select(F.lit(True).alias("word"), "key", F.col("n").alias("c"), F.lit(None).cast("double").alias("value"))
    looked_up = parts.join(words.unionByName(rest.select(F.lit(False).alias("word"), "key", F.lit(None).cast("long").alias("c"), "value")), ["word", "key"], "left")
    found = looked_up.groupBy("doc_id", "t").agg(
        F.count("n_tokens").alias("m"),
        *[F.max(c).alias(c) for c in ("held_out", "n_tokens", "n_known", "base", "score")],
        F.coalesce(F.sum(F.when(F.col("word"), F.col("n") * (F.log10(F.coalesce("c", F.lit(0)) + 1) - below))), F.lit(0.0)).alias("rest"),
        F.coalesce(F.sum(F.col("n") * F.col("value")), F.lit(0.0)).alias("more"),
        F.coalesce(F.sum(F.when(F.col("c").isNotNull(), F.col("n"))), F.lit(0)).alias("rest_known"),
    )
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "m")))
    return each.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.col("rest_known") / F.col("m")).cast("long").alias("n_known"), F.lit(int(total.n)).cast("long").alias("train_tokens"), (F.col("base") + F.col("rest") / F.col("m")).alias("base_score"), (F.col("score") + F.col("more") / F.col("m")).alias("score"))
