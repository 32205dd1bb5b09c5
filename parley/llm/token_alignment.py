"""Operator 11: alignment of two tokenizers over the same texts.

A byte-level tokenizer (A) encodes a space and the text, a piece tokenizer with
byte fallback (B) the text, to which it adds that space. Every byte gets a
label: no token ends there, one of A's, one of B's, or one of both. A regular
expression cuts the label string into spans up to each both-label; the labels
in a span are the tokens of a group. A byte with any label closes one pair of
overlapping tokens, so the labels also name all links of A's and B's tokens.

Links are counted for the whole corpus. Each document keeps its distinct pairs
of ids with their numbers; tasks sum them up before the shuffle. Documents look
up the counts of the most frequent pairs in a broadcast table of at most
``HEAD`` rows, whatever the input; all other pairs meet their counts in a join.

Defined cases: a null or empty text, and one whose tokens do not spell the
space and the text byte by byte, has no tokens: zeros, and empty groups. Rows
with a null or repeated id are rows of their own, and repeated rows count as
often as they stand there. Strings of special tokens are plain text. Other
columns are ignored. An empty table gives none. One text is encoded as a whole.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import columns, durable, groups
from parley.llm.packing import Encoder

#: Most pairs whose counts are broadcast: 13 bytes each, 27 MB.
HEAD = 1 << 21
#: Labels of a byte: no end, A's end, B's end, both.
LABELS = b"-ABX"
_SPAN = re.compile(rb"[^X]*X")
#: Pairs that a task gathers before it sums them up.
_GATHERED = 1 << 22
#: Counts of a document's pair fit in a byte; a pair that stands there more often is listed again.
_MOST = 255
_pairs: dict[tuple[str, str], TokenizerPair] = {}
_ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs binary, times binary"


def byte_alphabet() -> dict[str, int]:
    """The byte of each character in a byte-level vocabulary: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class TokenizerPair:
    """Ids and token bytes of both tokenizers, and the texts of their ids with the marks that follow them."""

    def __init__(self, a: str, b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece

        self.a, self.b = Encoder(a), sentencepiece.SentencePieceProcessor(model_file=b)
        self.a.tokenizer.encode_special_tokens, self.a.special = True, []
        letters = byte_alphabet()
        names = [self.a.tokenizer.id_to_token(i) or "" for i in range(self.a.tokenizer.get_vocab_size())]
        self.bytes_a = [bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in names]
        pieces = [(self.b.id_to_piece(i), self.b.is_byte(i)) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:-1], 16)]) if single else p.replace("▁", " ").encode() for p, single in pieces]
        self.size_a, self.size_b = (np.array([len(t) for t in side], dtype=np.int64) for side in (self.bytes_a, self.bytes_b))
        self.n_a, self.n_b = len(self.bytes_a), len(self.bytes_b)
        # without a normalizer, and with a token for each byte, a byte-level tokenizer spells every text
        self.spells_all = self.a.by_piece and set(letters) <= set(names)
        marks = ((self.n_a, ","), (self.n_a, "|"), (self.n_b, ","), (self.n_b, ";"))
        self.texts = np.array([f"{i}{mark}" for n, mark in marks for i in range(n)], dtype=object)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Both tokenizers' ids of each text; none where a side does not spell the space and the text."""
        none, out = np.empty(0, dtype=np.int64), []
        for text, one, two in zip(texts, self.a.encode([f" {t}" for t in texts]), self.b.encode(texts, num_threads=1), strict=True):
            ids_a, raw = np.frombuffer(one, dtype="<u4").astype(np.int64), f" {text}".encode()
            right = text and (self.spells_all or b"".join(map(self.bytes_a.__getitem__, ids_a.tolist())) == raw) and b"".join(map(self.bytes_b.__getitem__, two)) == raw
            out.append((ids_a, np.array(two, dtype=np.int64)) if right else (none, none))
        return out


def _pair(a: str, b: str) -> TokenizerPair:
    if (a, b) not in _pairs:
        _pairs[a, b] = TokenizerPair(a, b)
    return _pairs[a, b]


def label_string(end_a: np.ndarray, end_b: np.ndarray, size: int) -> bytes:
    """A label for each byte, from the places (exclusive) where tokens end."""
    labels = np.zeros(size, dtype=np.uint8)
    labels[end_a - 1] = 1
    labels[end_b - 1] += 2
    return np.frombuffer(LABELS, dtype=np.uint8)[labels].tobytes()


def token_spans(labels: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of A's and B's tokens in each group of a label string."""
    ends = np.cumsum(np.fromiter(map(len, _SPAN.findall(labels)), dtype=np.int64))
    raw = np.frombuffer(labels, dtype=np.uint8)
    counts = []
    for mark in b"AB":
        upto = np.cumsum((raw == mark) | (raw == LABELS[3]))[ends - 1] if len(ends) else ends
        counts.append(np.diff(upto, prepend=0))
    return counts[0], counts[1]


def links(labels: bytes, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pair of ids, A's in the upper 32 bits, that each labelled byte closes, and the places of those bytes."""
    raw = np.frombuffer(labels, dtype=np.uint8)
    at = np.flatnonzero(raw != LABELS[0])
    own = raw[at]
    is_a, is_b = own != LABELS[2], own != LABELS[1]
    return (ids_a[np.cumsum(is_a) - is_a] << 32) | ids_b[np.cumsum(is_b) - is_b], at


def _align(pair: TokenizerPair, texts: list[str], show: Callable[[str], str]) -> Iterator[tuple]:
    """n_a, n_b, n_groups, n_links, groups, pairs, times of each text."""
    ids = pair.encode(texts)
    ids_a, ids_b = (np.concatenate([x[side] for x in ids]) for side in (0, 1))
    n_a, n_b = (np.array([len(x[side]) for x in ids]) for side in (0, 1))
    end_a, end_b = np.cumsum(pair.size_a[ids_a]), np.cumsum(pair.size_b[ids_b])
    last = np.zeros(len(ids) + 1, dtype=np.int64)
    last[1:] = np.append(0, end_a)[np.cumsum(n_a)]  # a text's tokens of either kind end at the same place
    labels = label_string(end_a, end_b, int(last[-1]))
    in_a, in_b = token_spans(labels)
    raw = np.frombuffer(labels, dtype=np.uint8)
    shared = np.append(0, np.cumsum(raw == LABELS[3]))[last]
    # a group's tokens of A, then those of B; a mark follows each
    code_a, code_b = ids_a + pair.n_a * (raw[end_a - 1] == LABELS[3]), ids_b + 2 * pair.n_a + pair.n_b * (raw[end_b - 1] == LABELS[3])
    codes = np.empty(len(ids_a) + len(ids_b), dtype=np.int64)
    codes[np.arange(len(ids_a)) + np.repeat(np.cumsum(in_b) - in_b, in_a)] = code_a
    codes[np.arange(len(ids_b)) + np.repeat(np.cumsum(in_a), in_b)] = code_b
    words, first = pair.texts[codes].tolist(), np.append(0, np.cumsum(n_a + n_b))
    linked, at = links(labels, ids_a, ids_b)
    link = np.searchsorted(at, last)
    for k in range(len(ids)):
        if not n_a[k]:
            yield 0, 0, 0, 0, "", b"", b""
            continue
        own, times = np.unique(linked[link[k] : link[k + 1]], return_counts=True)
        if times.max() > _MOST:
            full, part = np.divmod(times, _MOST)
            own = np.concatenate([np.repeat(own, full), own[part > 0]])
            times = np.concatenate([np.full(full.sum(), _MOST), part[part > 0]])
        packed = ((own >> 32) * pair.n_b + (own & 0xFFFFFFFF)).astype("<u4")
        yield int(n_a[k]), int(n_b[k]), int(shared[k + 1] - shared[k]), int(link[k + 1] - link[k]), show("".join(words[first[k] : first[k + 1]])[:-1]), packed.tobytes(), times.astype(np.uint8).tobytes()


def digest(text: str) -> str:
    """Lower-case hexadecimal SHA-256."""
    return hashlib.sha256(text.encode()).hexdigest()


def token_groups(docs: DataFrame, a: str, b: str, *, show: Callable[[str], str] = str) -> DataFrame:
    """row, doc_id, n_a, n_b, n_groups, n_links, groups, pairs, times of each document.

    ``groups`` is ``show`` of the groups' ids as text (``a1,a2|b1;a3|b2,b3``). ``pairs`` holds the distinct linked ids as
    unsigned 32-bit numbers (A's id times the size of B's vocabulary, plus B's id), ``times`` how often each is linked, a byte each.
    ``row`` tells rows apart; read again, it need not be the same, so write the result before joining by it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(a, b)
        if pair.n_a * pair.n_b >= 1 << 32:
            raise ValueError("pairs of these vocabularies do not fit in 32 bits")
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            for lo, hi in groups(texts):
                found = list(zip(*_align(pair, texts[lo:hi], show), strict=True))
                counts = [pa.array(c, pa.int64()) for c in found[:4]]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], batch.column(1)[lo:hi], *counts, pa.array(found[4], pa.string()), pa.array(found[5], pa.binary()), pa.array(found[6], pa.binary())], names)

    names = [c.split()[0] for c in _ALIGNED.split(", ")]
    given = columns(docs, doc_id="long", text="string").select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return given.mapInArrow(run, _ALIGNED)


def _unpacked(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs, their numbers and the places of their rows, of all rows of a batch; the pairs' column is ``at``."""
    pairs = [np.frombuffer(x, dtype="<u4") for x in batch.column(at).to_pylist()]
    times = [np.frombuffer(x, dtype=np.uint8) for x in batch.column(at + 1).to_pylist()]
    sizes = [len(p) for p in pairs]
    return np.concatenate(pairs).astype(np.int64), np.concatenate(times).astype(np.int64), np.repeat(np.arange(len(pairs)), sizes)


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, dtype=np.int64)
    return keys[first], np.add.reduceat(values, first) if len(first) else values


def pair_counts(aligned: DataFrame, n_b: int) -> DataFrame:
    """pair, n, best: links of each pair of ids over all documents, and whether no other pair of B's id has more."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            keys, values = _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(values)], ["pair", "n"])

        for batch in batches:
            if batch.num_rows:
                held.append(_summed(*_unpacked(batch, 0)[:2]))
                if sum(len(k) for k, _ in held) > _GATHERED:
                    merged = _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    held[:] = [merged]
                    if len(merged[0]) > _GATHERED // 2:
                        yield flush()
        if held:
            yield flush()

    counts = durable(aligned.select("pairs", "times").mapInArrow(gather, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    own = F.col("pair") % n_b
    most = counts.groupBy(own.alias("_b")).agg(F.max("n").alias("_most"))
    return counts.join(most, own == F.col("_b")).select("pair", "n", (F.col("n") == F.col("_most")).alias("best"))


def _head(counts: DataFrame, most: int) -> tuple[int, tuple[np.ndarray, ...]]:
    """The least count of the pairs that are broadcast, and those pairs with their counts and marks, ascending: ``most`` at most."""
    band = F.floor(F.log2("n") * 8).cast("int")
    left, least = most, 1 << 62
    for row in counts.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("rows"), F.min("n").alias("least")).orderBy(F.desc("band")).collect():  # 512 bands at most
        if row.rows > left:
            break
        left, least = left - row.rows, row.least
    found = counts.filter(F.col("n") >= least).orderBy("pair").toArrow()
    return least, tuple(found.column(c).to_numpy() for c in ("pair", "n", "best"))


def link_statistics(aligned: DataFrame, counts: DataFrame, *, head: int = HEAD) -> DataFrame:
    """row, n_best, count_sum of each document: its links whose count is the highest of their B id, and the sum of its links' counts."""
    least, table = _head(counts, head)
    sent = aligned.sparkSession.sparkContext.broadcast(table)

    def known(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = sent.value[0]
        at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
        return at, keys[at] == pairs if len(keys) else np.zeros(len(pairs), dtype=bool)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                pairs, times, row = _unpacked(batch, 1)
                at, hit = known(pairs)
                at, times, row = at[hit], times[hit], row[hit]
                best, total = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows, dtype=np.int64)
                np.add.at(best, row, times * sent.value[2][at])
                np.add.at(total, row, times * sent.value[1][at])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best), pa.array(total)], ["row", "n_best", "count_sum"])

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                pairs, times, row = _unpacked(batch, 1)
                miss = ~known(pairs)[1]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[miss])), pa.array(pairs[miss]), pa.array(times[miss])], ["row", "pair", "times"])

    given = aligned.select("row", "pairs", "times")
    found = given.mapInArrow(look, "row long, n_best long, count_sum long")
    rare = given.mapInArrow(rest, "row long, pair long, times long").join(counts.filter(F.col("n") < least), "pair")
    rare = rare.select("row", F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum"))
    return found.unionByName(rare).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align(docs: DataFrame, a: str, b: str, *, show: Callable[[str], str] = str, head: int = HEAD) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups of each document."""
    import sentencepiece

    aligned = durable(token_groups(docs, a, b, show=show))
    counts = durable(pair_counts(aligned, sentencepiece.SentencePieceProcessor(model_file=b).get_piece_size()))
    found = link_statistics(aligned, counts, head=head)
    return aligned.join(found, "row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
