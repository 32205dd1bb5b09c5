"""Operator 9: size-tiered compaction of a sharded table with versioned manifests.

Arrivals are appended as small immutable parquet shards. Compaction sorts the
shards of the current version into tiers by size; in each tier with enough
shards, runs of similar size are merged into files of about ``target_bytes``.
Every merge is one task that streams its inputs into one output, so nothing is
shuffled and memory is a few batches. A version becomes visible when its commit file is
renamed into place, which fails if another writer took the number. Shards are
never changed, and a failed or repeated task leaves an unreferenced file only.

Layout of a table folder: ``data/`` shards, ``manifests/`` one parquet table
for each version (path, rows, bytes, tier), ``commits/`` one file for each version.

Defined cases: all columns, types, nulls, empty and repeated rows are kept as
they are; an empty table has one version without rows; extra columns pass through.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

SHARD_ROWS = 1_000
TARGET_BYTES = 128 << 20
FANOUT = 4
BASE_BYTES = 1 << 20
_GROUP_BYTES = 32 << 20
_MANIFEST = "path string, rows long, bytes long, tier int"


def _uri(path: str) -> str:
    return "file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path


@dataclass
class ShardedTable:
    """A folder of shards, manifests and commits."""

    spark: SparkSession
    folder: str
    schema: StructType
    target_bytes: int = TARGET_BYTES
    fanout: int = FANOUT

    def _files(self):
        jvm = self.spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(self.folder)
        return jvm, place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        jvm, files = self._files()
        place = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/commits")
        if not files.exists(place):
            return []
        return sorted(int(s.getPath().getName()) for s in files.listStatus(place) if s.getPath().getName().isdigit())

    def _commit(self, manifest: DataFrame, version: int) -> int:
        """Write the manifest, then take the version number by a rename that never overwrites."""
        name = f"{version:012d}-{uuid.uuid4().hex}"
        manifest.select("path", "rows", "bytes", "tier").write.parquet(f"{self.folder}/manifests/{name}")
        jvm, files = self._files()
        path, gateway = jvm.org.apache.hadoop.fs.Path, self.spark.sparkContext._gateway
        draft, final = path(f"{self.folder}/drafts/{name}"), path(f"{self.folder}/commits/{version:012d}")
        out = files.create(draft, False)
        out.write(bytearray(name.encode()))
        out.close()
        files.mkdirs(final.getParent())
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(draft, final, gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        return version

    def manifest(self, version: int | None = None) -> DataFrame:
        known = self.versions()
        if not known:
            return self.spark.createDataFrame([], _MANIFEST)
        jvm, files = self._files()
        commit = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/commits/{known[-1] if version is None else version:012d}")
        stream = files.open(commit)
        name = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        stream.close()
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.folder}/manifests/{name}")

    def _tier(self, size):
        return F.greatest(F.lit(0), F.floor(F.log(float(self.fanout), size / F.lit(BASE_BYTES)))).cast("int")

    def append(self, rows: DataFrame, *, shard_rows: int = SHARD_ROWS) -> int:
        """New shards of at most ``shard_rows`` rows, committed as the next version."""
        known = self.versions()
        place = f"{self.folder}/data/{uuid.uuid4().hex}"
        rows.write.option("maxRecordsPerFile", shard_rows).parquet(place)
        there = self.spark.read.schema(self.schema).parquet(place).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"))
        new = there.groupBy("path").agg(F.count(F.lit(1)).alias("rows"), F.max("bytes").alias("bytes")).withColumn("tier", self._tier(F.col("bytes")))
        return self._commit(self.manifest().unionByName(new), (known[-1] if known else 0) + 1)

    def _runs(self, manifest: DataFrame) -> DataFrame:
        """Shards below target size with the run they are merged in; runs have at least ``fanout`` shards or fill the target."""
        small = manifest.filter(F.col("bytes") < self.target_bytes // 2)
        parts = max(1, small.count() // 10_000)
        dealt = small.withColumn("part", F.pmod(F.xxhash64("path"), F.lit(parts)))
        before = W.partitionBy("tier", "part").orderBy("bytes", "path")
        run = dealt.withColumn("run", F.floor((F.sum("bytes").over(before) - F.col("bytes")) / F.lit(self.target_bytes)))
        size = run.groupBy("tier", "part", "run").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("all"), F.sort_array(F.collect_list("path")).alias("paths"))
        return size.filter((F.col("n") >= self.fanout) | (F.col("n") > 1) & (F.col("all") >= self.target_bytes)).select("paths")

    def compact(self) -> int:
        """Merge until no tier has a run to merge; every pass is a version. Returns the last version."""
        while True:
            version, manifest = (self.versions() or [0])[-1], self.manifest()
            runs = self._runs(manifest)
            place = f"{self.folder}/data/{uuid.uuid4().hex}"
            # the runs are a row for each merge; one task each
            table = f"{self.folder}/drafts/{uuid.uuid4().hex}"
            n = runs.count()
            if not n:
                return version
            runs.repartition(n).mapInArrow(_merge(place, self.schema), "paths array<string>, path string, rows long, bytes long").write.parquet(table)
            done = self.spark.read.schema("paths array<string>, path string, rows long, bytes long").parquet(table)
            gone = done.select(F.explode("paths").alias("path"))
            new = done.select("path", "rows", "bytes").withColumn("tier", self._tier(F.col("bytes")))
            self._commit(manifest.join(gone, "path", "left_anti").unionByName(new), version + 1)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the latest by default; ``_metadata`` tells the shard."""
        paths = [r.path for r in self.manifest(version).select("path").toLocalIterator()]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)


def _merge(place: str, schema: StructType):
    """Task function: stream the shards of each run into one new file, with the types of ``schema`` (timestamps in microseconds, as Spark reads them)."""
    timed = any(word in schema.simpleString() for word in ("timestamp", "time("))
    kinds = to_arrow_schema(schema) if timed else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for paths in batch.column(0).to_pylist():
                system, root = fs.FileSystem.from_uri(_uri(place))
                system.create_dir(root, recursive=True)
                name, writer, rows, waiting, held = f"merged-{uuid.uuid4().hex}.parquet", None, 0, [], 0
                for path in paths:
                    own, local = fs.FileSystem.from_uri(_uri(path))
                    with own.open_input_file(local) as stream:
                        for part in pq.ParquetFile(stream, coerce_int96_timestamp_unit="us").iter_batches(batch_size=2048):
                            if kinds is not None:
                                part = part.cast(kinds)
                            writer = writer or pq.ParquetWriter(f"{root}/{name}", part.schema, filesystem=system, compression="zstd")
                            waiting.append(part)
                            held += part.nbytes
                            if held >= _GROUP_BYTES:
                                writer.write_table(pa.Table.from_batches(waiting))
                                waiting, held = [], 0
                            rows += part.num_rows
                if writer is not None:
                    if waiting:
                        writer.write_table(pa.Table.from_batches(waiting))
                    writer.close()
                    size = system.get_file_info(f"{root}/{name}").size
                    yield pa.RecordBatch.from_arrays([pa.array([paths], pa.list_(pa.string())), pa.array([f"{place}/{name}"]), pa.array([rows], pa.int64()), pa.array([size], pa.int64())], ["paths", "path", "rows", "bytes"])

    return run


def shard_and_compact(rows: DataFrame, folder: str, *, shard_rows: int = SHARD_ROWS, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT) -> ShardedTable:
    """A new table in ``folder``: one append, then compaction."""
    table = ShardedTable(rows.sparkSession, folder, rows.schema, target_bytes, fanout)
    table.append(rows, shard_rows=shard_rows)
    table.compact()
    return table
