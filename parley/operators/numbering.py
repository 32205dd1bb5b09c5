"""Dense numbers over a total order without passing all rows through one task."""

from __future__ import annotations

import itertools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ROW = (1 << 33) - 1  # the lower bits of Spark's row marks count within a partition


def new_folder(spark: SparkSession) -> str:
    """A new folder that the driver and the executors share: in ``spark.checkpoint.dir``, else (tests) in the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/parley-{uuid.uuid4().hex}"


def written(rows: DataFrame) -> DataFrame:
    """``rows`` as a table of the shared folder, so that what follows sees one fixed result."""
    path = new_folder(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def dense_number(rows: DataFrame, order: list[Column | str], into: str = "id", *, after: int = 0, kind: str = "long") -> DataFrame:
    """``rows`` with ``into`` set to ``after`` + 1, + 2, ... in ``order``; rows of one place are numbered in any order.

    Rows are sorted by ranges, written with their place in their range, and
    moved on by the rows of the ranges before, of which there is one number for each task.
    """
    placed = rows.drop(into).repartitionByRange(*order).sortWithinPartitions(*order)
    fixed = written(placed.select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().bitwiseAND(_ROW).alias("_at")))
    sizes = sorted((r["_range"], r["n"]) for r in fixed.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect())  # a row for each task
    starts = itertools.accumulate((n for _, n in sizes), initial=after)
    offsets = rows.sparkSession.createDataFrame([(k, start) for (k, _), start in zip(sizes, starts, strict=False)], "_range int, _start long")
    return fixed.join(F.broadcast(offsets), "_range").withColumn(into, (F.col("_start") + F.col("_at") + 1).cast(kind)).drop("_range", "_at", "_start")


def greatest(table: DataFrame, column: str = "id") -> int:
    """The greatest value of an id column, 0 for none."""
    return table.agg(F.coalesce(F.max(column), F.lit(0)).cast("long").alias("top")).first().top
