import random

import pytest
from pyspark.sql import functions as F

from parley.operators.numbering import dense_number
from parley.operators.relational import insert_missing
from parley.sources import seed, sinks
from parley.sources.versions import Conflict, TableSet


def shown(store, version=None):
    return {n: sorted(r.id for r in rows.collect()) for n, rows in store.read(version=version).items()}


class Stopped(Exception):
    pass


def test_a_commit_that_stops_after_any_step_leaves_a_whole_version(spark, tmp_path):
    """Each step of a commit of two tables ends the writer in turn; readers always see both old or both new tables."""
    store = TableSet(spark, str(tmp_path / "db"))
    store.commit({"t": spark.range(2), "u": spark.range(2), "kept": spark.range(9)})
    before, after = {"t": [0, 1], "u": [0, 1], "kept": list(range(9))}, {"t": [0, 1, 2], "u": [0, 1, 2], "kept": list(range(9))}

    def breaking(step):
        class Broken(TableSet):
            done = 0

            def _count(self):
                self.done += 1
                assert shown(store) in (before, after)
                if self.done == step:
                    raise Stopped

            def _write(self, name, rows):
                out = super()._write(name, rows)
                self._count()
                return out

            def _publish(self, version, pointer):
                if step == 3:
                    draft = self._path(f"{self.folder}/drafts/half")  # only a part of the pointer is written
                    out = self._files.create(draft, True)
                    out.write(bytearray(b'{"t": '))
                    out.close()
                    raise Stopped
                assert super()._publish(version, pointer)
                self._count()
                return True

        return Broken(spark, store.folder)

    for step in (1, 2, 3):
        with pytest.raises(Stopped):
            breaking(step).commit({"t": spark.range(3), "u": spark.range(3)})
        assert shown(store) == before and store.version() == 1
    with pytest.raises(Stopped):  # stopped after the pointer is there: the commit holds
        b = breaking(99)
        b._count = lambda: (_ for _ in ()).throw(Stopped) if store.version() == 2 else None
        b.commit({"t": spark.range(3), "u": spark.range(3)})
    assert shown(store) == after and shown(store, 1) == before
    held = store.read()["t"]
    assert len(store.vacuum(keep=1)) > 0 and store.versions() == [2]
    assert shown(store) == after and held.count() == 3
    assert store.vacuum(keep=1) == []


def test_conflicts_and_commits_side_by_side(spark, tmp_path):
    store = TableSet(spark, str(tmp_path / "db"))
    assert store.version() == 0 and store.read() == {}
    with pytest.raises(LookupError):
        store.read(["t"])
    base = store.commit({"t": spark.range(1), "u": spark.range(1)})
    assert store.commit({"t": spark.range(2)}, base=base) == 2
    assert store.commit({"u": spark.range(3)}, base=base) == 3  # another table: both hold
    assert shown(store) == {"t": [0, 1], "u": [0, 1, 2]}
    with pytest.raises(Conflict):
        store.commit({"t": spark.range(5)}, base=base)
    with pytest.raises(Conflict):
        store.commit({"v": spark.range(5)}, base=base, alone=True)
    assert not store._publish(3, {}) and shown(store) == {"t": [0, 1], "u": [0, 1, 2]}
    assert sinks.replace_tables({"v": spark.range(1)}, store.folder) == 4 and shown(store) == {"v": [0]}


def test_numbers_are_dense_over_many_ranges(spark):
    draw = random.Random(4)
    values = [(draw.choice([None, draw.randint(0, 50)]), i) for i in range(3000)]
    rows = spark.createDataFrame(values, "a int, b int").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = dense_number(rows, [F.col("a").desc_nulls_last(), "b"], into="n", after=10).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    order = sorted(values, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert {(r.a, r.b): r.n for r in got} == {r: 11 + k for k, r in enumerate(order)}
    assert dense_number(rows.limit(0), ["a"], kind="int").dtypes[-1] == ("id", "int") and dense_number(rows.limit(0), ["a"]).collect() == []
    plan = dense_number(rows, ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_insert_missing_goes_on_after_the_greatest_id(spark):
    table = spark.createDataFrame([(4, "b"), (9, "d")], "id int, name string")
    new = spark.createDataFrame([("d",), ("c",), ("a",), ("c",)], "name string")
    assert sorted(tuple(r) for r in insert_missing(table, new, "name").collect()) == [(4, "b"), (9, "d"), (10, "a"), (11, "c")]


KEYS = (("b", "a_id", "a"), ("c", "b_id", "b"), ("c", "p_id", "p"))


def test_reseed_clears_dependants_and_restarts_ids(spark, tmp_path):
    assert seed.dependants({"b"}, KEYS) == {"b", "c"} and seed.parents_first({"c", "b", "a", "p"}, KEYS) == ["a", "p", "b", "c"]
    with pytest.raises(ValueError, match="refer to each other"):
        seed.parents_first({"x", "y"}, (("x", "y_id", "y"), ("y", "x_id", "x")))
    store = TableSet(spark, str(tmp_path / "db"))
    store.commit({
        "a": spark.createDataFrame([(7, "old")], "id int, name string"),
        "b": spark.createDataFrame([(5, 7)], "id int, a_id int"),
        "c": spark.createDataFrame([(3, 5, 1)], "id int, b_id int, p_id int"),
        "p": spark.createDataFrame([(1,)], "id int"),
    })
    seeds = {"a": spark.createDataFrame([("k2", "two"), ("k1", "one")], "key string, name string"), "b": spark.createDataFrame([("x", "k2"), ("w", "k2"), ("y", "k1")], "key string, a_id string")}
    for _ in range(2):
        seed.reseed(store, seeds, {"b": ["a_id", "key"]}, KEYS)
        now = {n: sorted(tuple(r) for r in rows.collect()) for n, rows in store.read().items()}
        assert now == {"a": [(1, "one"), (2, "two")], "b": [(1, 1), (2, 2), (3, 2)], "c": [], "p": [(1,)]}
    version = store.version()
    with pytest.raises(Exception, match="no _id for a_id"):
        seed.reseed(store, seeds | {"b": spark.createDataFrame([("x", "none")], "key string, a_id string")}, keys=KEYS)
    assert store.version() == version and store.read()["b"].count() == 3  # a failure leaves all as it was
