"""Sets of tables that change all at once: a version is one small pointer file that names the files of every table.

A commit first writes its tables to new folders, which no reader looks at, and
then the pointer of the next version, by a rename that never overwrites.
Readers resolve the greatest pointer. So at every moment, and after a crash at
any step, they see one whole version; what a crashed commit left behind is
dropped by ``vacuum``.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another commit changed the same tables meanwhile."""


class TableSet:
    """The versioned tables of ``folder``, on any file system of the session's Hadoop configuration whose rename is atomic."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _names(self, folder: str) -> list[str]:
        place = self._path(f"{self.folder}/{folder}")
        return sorted(s.getPath().getName() for s in self._files.listStatus(place)) if self._files.exists(place) else []

    def versions(self) -> list[int]:
        return [int(n) for n in self._names("versions") if n.isdigit()]

    def version(self) -> int:
        """The newest version; 0 before the first commit."""
        return max(self.versions(), default=0)

    def pointer(self, version: int | None = None) -> dict[str, str]:
        """Table names with their folders, as of a version (the newest by default)."""
        version = self.version() if version is None else version
        if not version:
            return {}
        stream = self._files.open(self._path(f"{self.folder}/versions/{version:012d}"))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def read(self, names: list[str] | None = None, *, version: int | None = None) -> dict[str, DataFrame]:
        """The tables of one version; a name that it does not have is an error."""
        found = self.pointer(version)
        missing = sorted(set(names or ()) - set(found))
        if missing:
            raise LookupError(f"no tables {', '.join(missing)} in {self.folder}")
        return {n: self.spark.read.parquet(f"{self.folder}/{found[n]}") for n in (found if names is None else names)}

    def _write(self, name: str, rows: DataFrame) -> str:
        """A table in a folder of its own; the folder's path within the set."""
        place = f"data/{uuid.uuid4().hex}/{name}.parquet"
        rows.write.parquet(f"{self.folder}/{place}")
        return place

    def _publish(self, version: int, pointer: dict[str, str]) -> bool:
        """Make a pointer the given version; false if that version exists."""
        draft, final = (self._path(f"{self.folder}/{x}") for x in (f"drafts/{uuid.uuid4().hex}", f"versions/{version:012d}"))
        out = self._files.create(draft, False)
        out.write(bytearray(json.dumps(pointer, sort_keys=True).encode()))
        out.close()
        self._files.mkdirs(final.getParent())
        fs = self.spark._jvm.org.apache.hadoop.fs
        none = self.spark.sparkContext._gateway.new_array(fs.Options.Rename, 0)
        try:
            fs.FileContext.getFileContext(self._files.makeQualified(draft).toUri(), self.spark._jsparkSession.sessionState().newHadoopConf()).rename(self._files.makeQualified(draft), self._files.makeQualified(final), none)
        except Exception as failed:
            if "FileAlreadyExists" not in str(failed):
                raise
            return False
        return True

    def commit(self, tables: dict[str, DataFrame], *, base: int | None = None, alone: bool = False) -> int:
        """Replace the given tables, all or none, and return the new version.

        Other tables stay as they are, or go if ``alone``. ``base`` is the
        version that the new rows were made from (the newest by default): if a
        later one changed a table that this commit writes, or ``alone`` any, that is a ``Conflict``.
        """
        base = self.version() if base is None else base
        seen, new = self.pointer(base), {n: self._write(n, rows) for n, rows in tables.items()}
        while True:
            newest = self.version()
            now = self.pointer(newest)
            changed = {n for n in {*now, *seen} if now.get(n) != seen.get(n)}
            if changed & (set(now) | set(seen) if alone else set(new)):
                raise Conflict(f"version {newest} of {self.folder} changed {', '.join(sorted(changed))}")
            if self._publish(newest + 1, new if alone else now | new):
                return newest + 1

    def vacuum(self, *, keep: int = 2) -> list[str]:
        """Delete all but the ``keep`` newest versions, and every data folder that no kept version names. Not while a commit is being written."""
        known = self.versions()
        for version in known[:-keep]:
            self._files.delete(self._path(f"{self.folder}/versions/{version:012d}"), False)
        used = {place.split("/")[1] for v in known[-keep:] for place in self.pointer(v).values()}
        gone = [n for n in self._names("data") if n not in used]
        for name in gone:
            self._files.delete(self._path(f"{self.folder}/data/{name}"), True)
        for name in self._names("drafts"):
            self._files.delete(self._path(f"{self.folder}/drafts/{name}"), False)
        return gone
