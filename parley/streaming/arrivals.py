"""Extension: incremental ingest from a folder of arriving files.

The batch operators have no streaming form of their own. This runs a batch
function on each micro-batch of a file source. All that a micro-batch writes is
kept under its number and overwritten if it runs again, and readers look only at
batches that are marked as done: a batch that broke off at any step leaves nothing that is seen, and a replayed one changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parley.sources.sinks import exists, write_text


def _done(spark: SparkSession, target: str) -> int:
    """Number of the last batch that is done, -1 for none; batches are run in order."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/done")
    files = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return max((int(s.getPath().getName()) for s in files.listStatus(place)), default=-1) if files.exists(place) else -1


def _batches(spark: SparkSession, folder: str, last: int) -> DataFrame | None:
    """Rows of the batches up to ``last``, without their number."""
    if last < 0 or not exists(spark, folder):
        return None
    return spark.read.option("basePath", folder).parquet(folder).filter(F.col("batch") <= last).drop("batch")


def arrived(spark: SparkSession, target: str) -> DataFrame | None:
    """What ``handle`` returned for all batches that are done; None before the first."""
    return _batches(spark, f"{target}/results", _done(spark, target))


def ingest_arrivals(spark: SparkSession, source: str, schema: str, key: str, target: str, checkpoint: str, handle: Callable[[DataFrame], DataFrame], *, most_files: int | None = None) -> StreamingQuery:
    """Process all files that have arrived under ``source``, then stop; ``arrived`` reads the results from ``target``.

    ``handle`` sees each key once, with the first row of it that arrives (of one batch any), whatever
    number of rows it makes of it, none included. If it fails, the query fails, and the next one takes the same batch again.
    """

    def step(rows: DataFrame, batch: int) -> None:
        last = _done(spark, target)
        if batch <= last:
            return  # done before, but the query stopped before it was told so
        fresh = rows.dropDuplicates([key])
        seen = _batches(spark, f"{target}/keys", last)
        if seen is not None:
            fresh = fresh.join(seen, key, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{target}/taken/batch={batch}")
        taken = spark.read.schema(fresh.schema).parquet(f"{target}/taken/batch={batch}")  # keys and results come from the same rows
        handle(taken).write.mode("overwrite").parquet(f"{target}/results/batch={batch}")
        taken.select(key).write.mode("overwrite").parquet(f"{target}/keys/batch={batch}")
        write_text(spark, f"{target}/done/{batch}", "")

    stream = spark.readStream.schema(schema)
    if most_files:
        stream = stream.option("maxFilesPerTrigger", most_files)
    return stream.json(source).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def talk_by_window(events: DataFrame, *, at: str = "ts", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events and total value for each kind and time window of a stream or table; rows later than ``late`` are dropped from a stream."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
