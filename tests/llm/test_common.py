import os
from types import SimpleNamespace

from parley.llm import common


def test_shared_folder_is_the_sessions_or_in_the_warehouse(spark, tmp_path):
    """The setting cannot change within a session, so the session is replaced but for its Hadoop configuration."""
    for given, want in ((f"{tmp_path}/cp", f"file://{tmp_path}/cp"), (f"file:{tmp_path}/cp", f"file://{tmp_path}/cp"), (None, f"file://{tmp_path}/house/_shared")):
        conf = {"spark.checkpoint.dir": given, "spark.sql.warehouse.dir": f"{tmp_path}/house/"}
        assert common.shared_folder(SimpleNamespace(conf=conf, _jvm=spark._jvm, _jsparkSession=spark._jsparkSession)) == want


def test_tables_are_written_and_deleted(spark):
    rows = common.durable(spark.range(10))
    place = os.path.dirname(rows.inputFiles()[0].removeprefix("file://"))
    assert rows.count() == 10 and os.path.isdir(place)
    common.discard(rows)
    assert not os.path.exists(place)
    common.discard(common.durable(spark.range(0)))


def test_bucketed_rows_stay_where_they_are(spark):
    """A join on the key moves only the other side; every row is there once."""
    held = common.bucketed(spark.range(1000).selectExpr("id as k", "id * 2 as v"), "k")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = held.join(spark.range(0, 1000, 3).withColumnRenamed("id", "k").groupBy("k").count(), "k")
        assert sorted((r.k, r.v) for r in joined.collect()) == [(i, 2 * i) for i in range(0, 1000, 3)]
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SelectedBucketsCount: 4 out of 4" in plan and held.inputFiles()[0].startswith(common.shared_folder(spark))
    assert plan.split("== Initial Plan ==")[0].count("Exchange hashpartitioning") == 1


def test_workers_keep_only_the_last_operators_things():
    from parley.llm import packing
    from parley.llm.queries import tokenizer_files

    own = packing._encoder(tokenizer_files()["tokenizer"])
    assert packing._encoder(tokenizer_files()["tokenizer"]) is own and list(common._held) == ["encoders"]
    up, _ = common.powers(10)
    assert list(common._held) == ["word hashes"] and common.powers(10)[0].base is up.base
    assert list(common.groups(["x" * (1 << 18)] * 2)) == [(0, 1), (1, 2)]


def test_pipeline_stages_send_small_batches(spark):
    import corpus_pipeline

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        corpus_pipeline.STAGES[3][1](spark, spark.createDataFrame([(1, "a")], "doc_id long, text string"), "")
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == corpus_pipeline.BATCH_ROWS == 1000
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
