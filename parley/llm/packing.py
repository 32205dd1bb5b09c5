"""Operator 7: packing token sequences by minimum bin slack.

Texts are encoded once, cut into full windows and one remainder each. Only
small descriptors (id, start, length, checksum) leave that stage; they are
dealt at random into bounded groups, and within a group windows are filled by
minimum bin slack: starting from the longest remainder, a bitset subset-sum
over the multiset of remaining lengths finds the fill closest to capacity, the
counts are backtracked, and the pattern is used as often as the counts allow.

Defined cases: null text counts as empty and yields the one closing id;
repeated rows and null ids are packed like any other row; other columns are
ignored. A group holds about ``group_rows`` descriptors whatever the input.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import columns, durable, held

CAPACITY = 1024


#: How a byte-level tokenizer with its standard pattern cuts a text; ids never cross a cut.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: The same cuts by the standard library's faster patterns, for texts without a character that they class otherwise.
_QUICK = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_OTHERWISE = re.compile("[\x1c-\x1f\u00b2\u00b3\u00b9\u00bc-\u00be\u0250-\U0010ffff]")
_KNOWN, _LONG = 1_000_000, 64


class Encoder:
    """Ids of whole texts by the tokenizer file at ``path``.

    A byte-level tokenizer cuts texts with ``SPLIT`` and encodes each piece for
    itself. So the tokenizer encodes each distinct piece once, and texts are
    put together from the pieces' ids; at most ``_KNOWN`` short pieces are
    remembered. Texts with a special token's string, and texts for any other
    kind of tokenizer, are encoded whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        cut = parts.get("pre_tokenizer") or {}
        self.by_piece = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not parts.get("normalizer")
        self.known: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        whole = [not self.by_piece or any(s in t for s in self.special) for t in texts]
        slow = iter(self._ids([t for t, w in zip(texts, whole, strict=True) if w]))
        cut = [[] if w else (SPLIT if _OTHERWISE.search(t) else _QUICK).findall(t) for t, w in zip(texts, whole, strict=True)]
        known = self.known
        new = list({p for pieces in cut for p in pieces if p not in known})
        known.update(zip(new, self._ids(new), strict=True))
        out = [next(slow) if w else b"".join(map(known.__getitem__, pieces)) for pieces, w in zip(cut, whole, strict=True)]
        if len(known) > _KNOWN:
            known.clear()
        for p in new:
            if len(p) > _LONG:
                known.pop(p, None)
        return out


def _encoder(path: str) -> Encoder:
    encoders = held("encoders")
    if path not in encoders:
        encoders[path] = Encoder(path)
    return encoders[path]


def token_pieces(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Pieces of at most ``capacity`` ids: doc_id, start, length, ids_crc32, doc_tokens."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, closing = _encoder(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for lo in range(0, len(texts), 256):
                out = []
                for doc, data in zip(ids[lo : lo + 256], encoder.encode(texts[lo : lo + 256]), strict=True):
                    data += closing
                    total = len(data) // 4
                    out += [(doc, s, min(capacity, total - s), zlib.crc32(data[4 * s : 4 * (s + capacity)]), total) for s in range(0, total, capacity)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return columns(docs, doc_id="long", text="string").mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def _best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """Multiset of available lengths whose sum is the largest not above ``room``; longer ones are preferred.

    One bitset per step (bit s: sum s is reachable), kept for backtracking.
    """
    full, wanted = (1 << (room + 1)) - 1, 1 << room
    reach, steps = 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, part = min(counts[length], room // length), 1
        while left and not reach & wanted:
            take = min(part, left)
            steps.append((length, take, reach))
            reach |= (reach << (take * length)) & full
            left -= take
            part *= 2
        if reach & wanted:
            break
    total, used = reach.bit_length() - 1, defaultdict(int)
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            used[length] += take
            total -= take * length
    return used


def fill_windows(lengths: list[int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(repeats, lengths with counts) of windows that use each length exactly once."""
    counts: dict[int, int] = defaultdict(int)
    for x in lengths:
        counts[x] += 1
    out = []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        used = _best_fill({k: v for k, v in counts.items() if v}, capacity - longest)
        counts[longest] += 1
        used[longest] += 1
        times = min(counts[k] // n for k, n in used.items())
        for k, n in used.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
        out.append((times, dict(used)))
    return out


def pack(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, end_id: int = 0, group_rows: int = 50_000) -> DataFrame:
    """Every piece of every text with the sequence and the offset where it lies."""
    pieces = durable(token_pieces(docs, tokenizer, capacity=capacity, end_id=end_id))
    n_groups = max(1, -(-pieces.count() // group_rows))
    # a row's own place takes part: equal rows hash alike, and any even spread gives a right result
    dealt = pieces.withColumn("bin", F.pmod(F.xxhash64("doc_id", "start", F.monotonically_increasing_id()), F.lit(n_groups)))

    def fill(key: tuple[pa.Scalar], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in ("length", "doc_id", "start", "ids_crc32")]).drop_columns("bin")
        lengths = rows.column("length").to_pylist()
        shelf: dict[int, list[int]] = defaultdict(list)
        for at, length in enumerate(lengths):
            shelf[length].append(at)
        sequence, offset = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
        n = 0
        for times, used in fill_windows(lengths, capacity):
            for _ in range(times):
                at = 0
                for length, count in used.items():
                    for _ in range(count):
                        row = shelf[length].pop()
                        sequence[row], offset[row] = (key[0].as_py() << 32) + n, at
                        at += length
                n += 1
        return rows.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return dealt.groupBy("bin").applyInArrow(fill, kinds)
