import collections
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from parley.llm import queries
from parley.llm import token_alignment as op

FILES = queries.aligned_files()


def brute(texts):
    """Rows by the definition, from the tokenizers' own results, pair by pair."""
    a, b = Tokenizer.from_file(FILES["a"]), sentencepiece.SentencePieceProcessor(model_file=FILES["b"])
    a.encode_special_tokens = True
    letters, docs, counts = op.byte_alphabet(), [], collections.Counter()
    for text in texts:
        raw = f" {text}".encode() if text else b""
        one = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(f" {text}", add_special_tokens=False).ids] if text else []
        two = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in (b.encode(text) if text else [])]
        if b"".join(x for _, x in one) != raw or b"".join(x for _, x in two) != raw:
            one = two = []
        sides = []
        for side in (one, two):
            at, spans = 0, []
            for i, x in side:
                spans.append((at, at + len(x), i))
                at += len(x)
            sides.append(spans)
        met = [(x[2], y[2]) for x in sides[0] for y in sides[1] if x[0] < y[1] and y[0] < x[1]]
        cuts = sorted({x[1] for x in sides[0]} & {y[1] for y in sides[1]})
        within = lambda spans, lo, hi: ",".join(str(i) for s, e, i in spans if lo <= s and e <= hi)
        shown = ";".join(f"{within(sides[0], lo, hi)}|{within(sides[1], lo, hi)}" for lo, hi in zip([0, *cuts], cuts, strict=False))
        counts.update(met)
        docs.append((len(one), len(two), len(cuts), met, shown))
    top = collections.defaultdict(int)
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    return [(n, m, g, len(met), sum(counts[p] == top[p[1]] for p in met), sum(counts[p] for p in met), shown) for n, m, g, met, shown in docs]


WORDS = ["the", "Überraschung", "x9", "-", "\n", "don't", "漢字", "  ", "<|endoftext|>", "<s>", "</s>", "<unk>", "\x00", "▁", "é", "é", "😀", "\t", "tokenizers", "ﬁ", " "]


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(5)
    return ["".join(draw.choice(WORDS) + draw.choice(["", " "]) for _ in range(draw.randint(1, 60))) for _ in range(80)] + ["", None, "a", " ", "a " * 700]


@pytest.mark.parametrize("head", [op.HEAD, 40, 0])
def test_equals_brute_force(spark, texts, head):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in op.align(rows, **FILES, head=head).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_the_query_hashes_the_groups(spark, tmp_path, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.QUERIES["op11_token_alignment"](spark, str(tmp_path)).collect()}
    for i, row in enumerate(brute(texts)):
        assert tuple(got[i])[1:7] == row[:6] and got[i].groups_sha256 == (op.digest(row[6]) if row[6] else "")


@given(st.lists(st.tuples(st.integers(1, 4), st.integers(1, 4)), min_size=1, max_size=40))
def test_labels_spans_and_links(sizes):
    end_a, end_b = np.cumsum([x for x, _ in sizes]), np.cumsum([y for _, y in sizes])
    n = int(max(end_a[-1], end_b[-1])) + 1
    end_a, end_b = np.append(end_a, n), np.append(end_b, n)
    labels = op.label_string(end_a, end_b, n)
    cuts = [0, *sorted(set(end_a.tolist()) & set(end_b.tolist()))]
    groups = [tuple(sum(lo < e <= hi for e in ends) for ends in (end_a, end_b)) for lo, hi in zip(cuts, cuts[1:], strict=False)]
    assert list(zip(*(x.tolist() for x in op.token_spans(labels)), strict=True)) == groups
    spans = [[(int(s), int(e)) for s, e in zip(np.append(0, ends[:-1]), ends, strict=True)] for ends in (end_a, end_b)]
    want = sorted((i << 32) | j for i, x in enumerate(spans[0]) for j, y in enumerate(spans[1]) if x[0] < y[1] and y[0] < x[1])
    assert sorted(op.links(labels, np.arange(len(end_a)), np.arange(len(end_b)))[0].tolist()) == want


def test_awkward_and_empty(spark, awkward, nothing):
    got = op.align(awkward, **FILES).collect()
    assert len(got) == awkward.count() and got[0].__fields__[-1] == "groups"
    zero = [r for r in got if r.doc_id in (2, 3)]
    assert len(zero) == 3 and all(tuple(r)[1:] == (0,) * 6 + ("",) for r in zero)
    ones = [tuple(r) for r in got if r.doc_id == 1]
    assert len(ones) == 3 and len(set(ones)) == 1 and ones[0][5] > 0
    assert op.align(nothing, **FILES).collect() == []
    short = spark.createDataFrame([(1, "")], "doc_id long, text string")
    assert [tuple(r) for r in op.align(short, **FILES).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_a_byte_level_tokenizer_spells_every_text():
    pair = op.TokenizerPair(**FILES)
    assert pair.spells_all
    draw = random.Random(1)
    texts = ["".join(chr(draw.choice([draw.randrange(1, 0xD800), draw.randrange(0xE000, 0x110000), draw.randrange(32, 127)])) for _ in range(50)) for _ in range(500)] + [" ".join(WORDS)]
    for text, ids in zip(texts, pair.a.encode([f" {t}" for t in texts]), strict=True):
        assert b"".join(pair.bytes_a[i] for i in np.frombuffer(ids, dtype="<u4")) == f" {text}".encode()


def test_files_are_those_of_the_contract():
    assert FILES == {"a": public_tokenizers.path("byte_bpe_50k.json"), "b": public_tokenizers.path("piece_bpe_32k.model")}
