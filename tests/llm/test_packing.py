import itertools
import random
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
from tokenizers import Tokenizer

from parley.llm import packing as op
from parley.llm.queries import tokenizer_files


def check(rows, texts, tokenizer, capacity=1024):
    """Every id lies in one piece, sequences are gapless and fit."""
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for i, t in texts.items()}
    seen, at = {}, {}
    for r in rows:
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and 0 < r.length <= capacity
        assert r.ids_crc32 == zlib.crc32(np.array(own[r.start : r.start + r.length], dtype="<u4").tobytes())
        seen.setdefault(r.doc_id, []).append((r.start, r.length))
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, pieces in seen.items():
        pieces.sort()
        assert [p[0] for p in pieces] == list(itertools.accumulate([0] + [p[1] for p in pieces[:-1]])) and sum(p[1] for p in pieces) == len(ids[i])
    fills = []
    for pieces in at.values():
        pieces.sort()
        assert [p[0] for p in pieces] == list(itertools.accumulate([0] + [p[1] for p in pieces[:-1]]))
        fills.append(sum(p[1] for p in pieces))
        assert fills[-1] <= capacity
    return fills


@pytest.mark.parametrize("files", [{"tokenizer": public_tokenizers.path("word_bpe_49k.json")}, tokenizer_files()])
def test_round_trip(spark, files):
    draw = random.Random(3)
    texts = {i: " ".join(draw.choice(["the", "Überraschung", "x9", "-", "\n", "don't", "漢字", "  ", "<|endoftext|>"]) for _ in range(draw.randint(0, 900))) for i in range(150)}
    texts |= {200: "", 201: None, 202: "word " * 9000, 203: "a" * 5000}
    got = op.pack(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3), group_rows=60, **files).collect()
    fills = check(got, texts, Tokenizer.from_file(files["tokenizer"]))
    assert {r.doc_id for r in got} == set(texts) and sum(fills) / len(fills) > 0.95 * 1024


def test_pieces_are_cut_where_the_tokenizer_cuts():
    """Every code point that both know of, between letters, digits, spaces and marks; and texts encoded whole."""
    encoder = op.Encoder(tokenizer_files()["tokenizer"])
    points = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and regex.match(r"\P{Cn}", chr(c))]
    for a, b in (("a", "b"), ("1", "2"), (" ", "."), ("'", "s"), (" ", " ")):
        texts = ["".join(f"{a}{c}{b}\n" for c in points[k : k + 500]) for k in range(0, len(points), 500)]
        assert encoder.encode(texts) == encoder._ids(texts)
    for a, b in itertools.product([c for c in points if ord(c) < 0x250], "a1 .'\n"):
        assert op._OTHERWISE.search(a) or op._QUICK.findall(b + a + b) == op.SPLIT.findall(b + a + b)
    draw = random.Random(8)
    odd = ["it's", "IT'S", "'ll", "\u00a0", "  ", "\n\n", "\t ", "é", "e\u0301", "٣", "½", "😀", "\u200b", "x" * 99, "--", "_", "\x00", "\r\n"]
    texts = ["".join(draw.choice(odd) for _ in range(draw.randint(0, 40))) for _ in range(2000)]
    assert encoder.encode(texts) == encoder._ids(texts) and encoder.known


def test_large_ids_next_to_null_stay_exact(spark):
    rows = [(9007199254740993, "one text"), (None, "another text"), (9007199254740992, "a third")]
    got = op.pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), **tokenizer_files()).collect()
    assert {r.doc_id for r in got} == {r[0] for r in rows}


def test_best_fill_equals_brute_force():
    draw = random.Random(1)
    for _ in range(200):
        counts = {draw.randint(1, 30): draw.randint(1, 3) for _ in range(4)}
        room = draw.randint(0, 60)
        used = op._best_fill(counts, room)
        assert all(n <= counts[k] for k, n in used.items())
        every = max(s for s in (sum(k * n for k, n in zip(counts, ns, strict=True)) for ns in itertools.product(*[range(c + 1) for c in counts.values()])) if s <= room)
        assert sum(k * n for k, n in used.items()) == every


def test_windows_use_each_length_once():
    draw = random.Random(2)
    lengths = [draw.randint(1, 64) for _ in range(3000)]
    windows = op.fill_windows(lengths, 64)
    used = sorted(x for times, own in windows for k, n in own.items() for x in [k] * (n * times))
    assert used == sorted(lengths)
    assert sum(t for t, _ in windows) <= 1.01 * -(-sum(lengths) // 64) + 1


def test_awkward_and_empty(awkward, nothing):
    got = op.pack(awkward.select("doc_id", "text", "kept"), **tokenizer_files()).collect()
    counts = {}
    for r in got:
        counts[r.doc_id] = counts.get(r.doc_id, 0) + r.length
    one = next(r for r in got if r.doc_id == 1)
    assert counts[1] == 3 * one.doc_tokens and counts[2] == 2 and counts[3] == 1 and None in counts
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)
    assert op.pack(nothing, **tokenizer_files()).count() == 0
