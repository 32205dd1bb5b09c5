import collections
import hashlib
import random
import zlib

import pytest

from parley.llm import conversation_trie as op
from parley.llm import queries

KIND = "conv_id long, turn long, role string, text string"


def brute(rows):
    """Nodes by the definition: every prefix of every rebuilt conversation."""
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()), (role, text)))
    own = {c: [t for _, t in sorted(x)] for c, x in own.items()}
    whole = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        lead = c - (c % 100 if c >= 0 else -(-c % 100))
        whole[c] = tuple(own.get(lead, [])[:h] + x[h:])
    members = collections.defaultdict(list)
    for c, x in whole.items():
        for d in range(len(x) + 1):
            members[x[:d]].append(c)
    kids = collections.defaultdict(list)
    for path in members:
        if path:
            kids[path[:-1]].append(path)
    leaves, saved = collections.Counter(), collections.Counter()
    for path, own_members in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in kids
            saved[path[:d]] += (len(own_members) - 1) * (len(path[-1][1]) if path else 0)
    out = []
    for path, own_members in members.items():
        ends = ",".join(map(str, sorted(c for c in own_members if len(whole[c]) == len(path))))
        out.append((min(own_members), len(path), min(members[path[:-1]]) if path else None, len(own_members), len(kids[path]), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed, families=3):
    draw, rows = random.Random(seed), []
    for c in [*range(100 * families), -250, -200, -7, 10**15 + 100, 10**15 + 150]:
        if draw.random() < 0.8:
            for turn in range(draw.randint(1, 8)):
                same = draw.random() < 0.7  # hot first turns, equal conversations
                rows.append((c, turn, draw.choice(["user", "system"]) if not same else "user", f"text {turn}" if same else draw.choice(["é 😀", "", "other " * draw.randint(1, 9)])))
    return rows


@pytest.mark.parametrize("limit", [op.LIMIT, 40, 3])
def test_equals_brute_force(spark, limit):
    rows = conversations(4)
    got = op.trie(spark.createDataFrame(rows, KIND).repartition(3), limit=limit)
    assert got.columns == [c.split()[0] for c in op.NODE.split(", ")]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_query_reads_the_table(spark, tmp_path):
    rows = conversations(9, families=1)
    spark.createDataFrame(rows, KIND).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.QUERIES["op12_conversation_trie"](spark, str(tmp_path)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_copies_long_and_nested_conversations(spark):
    rows = [(100 * c, t, "user", f"turn {t}") for c in range(300) for t in range(3)]  # one conversation, 300 times
    rows += [(100_000, t, "user", f"turn {t}") for t in range(900)]  # a deep chain upon it
    rows += [(200_000 + 100 * k, t, "user", f"turn {t}") for k in range(4) for t in range(5 + k)]  # each a prefix of the next
    for limit in (op.LIMIT, 20):
        assert sorted((tuple(r) for r in op.trie(spark.createDataFrame(rows, KIND), limit=max(limit, 890)).collect()), key=str) == brute(rows)


def test_chunks_of_ids_join_to_one_hash(spark, monkeypatch):
    members = spark.createDataFrame([(bytes([k % 3]), i) for k, i in enumerate(range(997, -3, -1))], "key binary, conv_id long").repartition(5)
    got = {bytes(r.key): r for r in op.hashed_ids(members, "key").collect()}
    for k in range(3):
        ids = sorted(i for n, i in enumerate(range(997, -3, -1)) if n % 3 == k)
        r = got[bytes([k])]
        assert (r.n, r.first, r.ends) == (len(ids), ids[0], hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def test_postorder_is_iterative():
    kids = [{b"x": k + 1} for k in range(5000)] + [{}]
    assert list(op.postorder(kids, [0])) == list(range(5000, -1, -1))


def test_nulls_ties_extra_columns_and_empty(spark):
    rows = [(1, None, None, None), (1, 0, "user", None), (1, 0, "user", "b"), (1, 0, "user", "b"), (1, 1, None, "c"), (None, 0, "user", "x"), (0, 5, "user", "lead"), (0, None, "system", "before"), (2, 0, "", "")]
    given = spark.createDataFrame([(*r, "k", 7, b"d") for r in rows], f"{KIND}, key string, depth int, digests binary")
    assert sorted((tuple(r) for r in op.trie(given).collect()), key=str) == brute(rows)
    long = [(7, 0, "user", "word " * 200_000), (8, 0, "user", "word " * 200_000)]
    assert sorted((tuple(r) for r in op.trie(spark.createDataFrame(long, KIND)).collect()), key=str) == brute(long)
    assert op.trie(spark.createDataFrame([], KIND)).collect() == [] and op.trie(spark.createDataFrame([(None, 1, "a", "b")], KIND)).collect() == []
