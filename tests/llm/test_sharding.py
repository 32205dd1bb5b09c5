import uuid

import pytest
from pyspark.sql import functions as F

from parley.llm import sharding as op


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}/{uuid.uuid4().hex}"


def test_every_version_holds_all_rows(spark, folder):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 512).alias("text")).repartition(3)
    table = op.ShardedTable(spark, folder, rows.schema, target_bytes=200_000, fanout=4)
    table.append(rows.filter("doc_id < 3000"), shard_rows=100)
    table.append(rows.filter("doc_id >= 3000"), shard_rows=100)
    before = table.manifest().count()
    last = table.compact()
    assert table.versions() == list(range(1, last + 1)) and last > 2
    assert table.read(1).count() == 3000
    for version in range(2, last + 1):
        got = table.read(version)
        assert got.count() == 5000 and got.exceptAll(rows).count() == 0
    assert table.manifest().count() < before / 4
    assert table.manifest().agg(F.sum("rows")).first()[0] == 5000
    assert table.compact() == last  # nothing left to do


def test_commit_is_exclusive(spark, folder):
    rows = spark.range(10)
    table = op.ShardedTable(spark, folder, rows.schema)
    table.append(rows)
    with pytest.raises(Exception, match="AlreadyExists"):
        table._commit(table.manifest(), 1)
    assert table.versions() == [1] and table.read().count() == 10


def test_unreferenced_files_are_not_read(spark, folder):
    rows = spark.range(10)
    table = op.ShardedTable(spark, folder, rows.schema)
    table.append(rows)
    rows.write.parquet(f"{folder}/data/failed-attempt")
    assert table.read().count() == 10


def test_awkward_and_empty(awkward, nothing, folder):
    table = op.shard_and_compact(awkward, folder, shard_rows=2)
    assert table.read().exceptAll(awkward).count() == 0 and table.read().count() == awkward.count()
    none = op.shard_and_compact(nothing, folder + "-none")
    assert none.versions() == [1] and none.read().count() == 0 and none.read().schema == nothing.schema


def test_all_types_are_kept(spark, tmp_path):
    kinds = "i tinyint, s smallint, n int, l bigint, f float, d double, b boolean, t string, x binary, day date, at timestamp, wall timestamp_ntz, m decimal(20,3), list array<timestamp>, map map<string,int>, st struct<a:timestamp,b:string>"
    row = "1Y, 2S, 3, 4L, cast(1.5 as float), 2.5D, true, 'é', x'00ff', date'1900-01-01', timestamp'1000-01-01 01:02:03.123456', timestamp_ntz'9999-12-31 23:59:59.999999', 1.234BD, array(timestamp'2024-02-29 00:00:00', null), map('a', 1), named_struct('a', timestamp'2000-01-01 00:00:00', 'b', null)"
    one = spark.sql(f"select {row}").toDF(*[k.split(" ")[0] for k in kinds.split(", ")])
    rows = spark.createDataFrame([], kinds).unionByName(one).unionByName(spark.sql("select " + ", ".join(f"cast(null as {k.split(' ', 1)[1]}) as {k.split(' ', 1)[0]}" for k in kinds.split(", "))))
    given = rows.union(rows).union(rows).repartition(6)
    table = op.shard_and_compact(given, f"file://{tmp_path}/t", shard_rows=1)
    assert len(table.versions()) > 1
    text = lambda df: sorted(str(r) for r in df.collect())
    assert text(table.read()) == text(given) and table.read().schema.simpleString() == given.schema.simpleString()
