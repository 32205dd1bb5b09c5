"""Writers: all-or-nothing table sets, files with a manifest, memoised stages and status output."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.sources.versions import TableSet


def _hadoop(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _hadoop(spark, path)
    return files.exists(place)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file on the path's own file system; the file must not exist."""
    files, place = _hadoop(spark, path)
    out = files.create(place, False)
    out.write(bytearray(text.encode()))
    out.close()


def replace_tables(tables: dict[str, DataFrame], folder: str) -> int:
    """Make the given tables the only ones of a versioned folder, in one commit; ``TableSet`` reads them."""
    return TableSet(next(iter(tables.values())).sparkSession, folder).commit(tables, alone=True)


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """Write ``content`` of each row as the file ``path`` below ``folder`` and return the manifest: path, sha256, n_bytes.

    Tasks write to a name of their own first, so a file is whole wherever it
    exists; a repeated task writes the same bytes again. ``folder`` is a URI that Arrow's file systems know, or a local path.
    """

    place = re.sub(r"^file:/(?!/)", "file:///", folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(place)
        for batch in batches:
            paths, contents = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for path, content in zip(paths, contents, strict=True):
                final = f"{root.rstrip('/')}/{path}"
                files.create_dir(final.rpartition("/")[0], recursive=True)
                draft = f"{final}.{uuid.uuid4().hex}"
                with files.open_output_stream(draft) as out:
                    out.write(content)
                files.move(draft, final)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hashlib.sha256(c).hexdigest() for c in contents]), pa.array([len(c) for c in contents], pa.int64())], ["path", "sha256", "n_bytes"])

    return rows.select("path", "content").mapInArrow(run, "path string, sha256 string, n_bytes long")


def memo(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``, made and written first if it is not complete yet."""
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def json_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def padded_table(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One text line for each row with columns padded to their widest value."""
    texts = rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])
    widths = texts.agg(*[F.coalesce(F.max(F.length(c)), F.lit(0)).alias(f"_w{i}") for i, c in enumerate(columns)])
    padded = [F.rpad(F.col(c), F.col(f"_w{i}"), F.lit(" ")) for i, c in enumerate(columns)]
    return texts.join(F.broadcast(widths)).select(F.rtrim(F.concat_ws("  ", *padded)).alias("value"))
