"""Shared helpers: durable intermediate tables and vectorised word hashing.

Words for hashing purposes are maximal runs of ASCII letters, digits and any
non-ASCII character of the lower-cased text, so case and punctuation never
separate near copies. All hashes are 64 bit and depend on the word alone.
"""

from __future__ import annotations

import gc
import re
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
_BASE = 0x9E6C63D0876A9A99 | 1
_MASK = (1 << 64) - 1
_held: dict[str, dict] = {}

_WORD = np.zeros(256, dtype=bool)
_WORD[128:] = True
for _lo, _hi in ((48, 58), (65, 91), (97, 123)):
    _WORD[_lo:_hi] = True


def shared_folder(df_or_spark) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``, else the warehouse (tests).

    A path without a scheme belongs to the default file system of the session's
    Hadoop configuration, as for Spark's own readers and writers.
    """
    spark = df_or_spark.sparkSession if isinstance(df_or_spark, DataFrame) else df_or_spark
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    place = spark._jvm.org.apache.hadoop.fs.Path(found)
    full = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(place).toString()
    return re.sub(r"^file:/(?!/)", "file:///", full)


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` as a table of the shared folder and read it from there.

    Other than a checkpoint, a table carries no constraints of the plan that
    made it; in loops those grow until planning takes longer than the work.
    """
    path = f"{shared_folder(df)}/parley-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """Like ``durable``, but dealt by ``key`` into as many buckets as the session has shuffle partitions: later joins on the key leave these rows where they are."""
    spark, name = df.sparkSession, f"parley_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, key).write.format("parquet").bucketBy(n, key).option("path", f"{shared_folder(df)}/{name}").saveAsTable(name)
    return spark.table(name)


def release(df: DataFrame) -> None:
    """Let Spark's cleaner drop the shuffle files of steps whose results are written; else it waits for the driver's next full garbage collection."""
    gc.collect()
    df.sparkSession._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Delete a table that ``durable`` wrote, once all that is made from it is written; then let go of shuffle files too."""
    files = df.inputFiles()
    if files:
        place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        place.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(place, True)
    release(df)


def columns(df: DataFrame, **kinds: str) -> DataFrame:
    """Only the named columns, cast to the given types; extra columns are left behind."""
    return df.select(*(F.col(f"`{name}`").cast(kind).alias(name) for name, kind in kinds.items()))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (in a new array)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def held(owner: str) -> dict:
    """What ``owner`` keeps in this Python worker between tasks. What others kept goes: workers are reused by the tasks of other operators."""
    for other in [k for k in _held if k != owner]:
        del _held[other]
    return _held.setdefault(owner, {})


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    tables = held("word hashes")
    if len(tables.get("up", ())) < n:
        size = 1 << max(19, int(n).bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            tables[name] = np.cumprod(table, dtype=np.uint64)
    return tables["up"][:n], tables["down"]


def groups(texts: list[str | None], most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` characters together; a longer text stands alone."""
    first = size = 0
    for i, t in enumerate(texts):
        n = len(t or "") + 1
        if size and size + n > most:
            yield first, i
            first, size = i, 0
        size += n
    if first < len(texts):
        yield first, len(texts)


def word_hashes(texts: list[str | None], stems: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """Hashes of all words in order, and for each text (plus one past the last) the index of its first word.

    For each length in ``stems`` an array follows with the hashes of the words'
    first so many bytes, and of the whole word where it is shorter.
    """
    parts = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    at = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=at[1:])
    raw = np.frombuffer(b"\n".join(parts) + b"\n", dtype=np.uint8)
    inside = np.zeros(len(raw) + 1, dtype=np.int8)
    inside[1:] = _WORD[raw]
    turn = np.diff(inside)
    start, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    up, down = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    inverse, size = down[start], end - start
    h = mix((total[end] - total[start]) * inverse + size.astype(np.uint64))
    led = [mix((total[start + np.minimum(size, k)] - total[start]) * inverse + np.uint64(k << 32)) for k in stems]
    return h, np.searchsorted(start, at), *led


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive word hashes (empty if there are fewer)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.full(n, k, dtype=np.uint64)
    for j in range(k):
        out *= np.uint64(0xD1342543DE82EF95)
        out += h[j : j + n]
    return mix(out)


def shingles(texts: list[str | None], k: int = SHINGLE) -> list[np.ndarray]:
    """Per text its k-word shingle hashes in order; a text of 1 to k-1 words has one shingle, all its words."""
    h, first = word_hashes(texts)
    every = rolling(h, k)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        out.append(every[a : b - k + 1] if b - a >= k else rolling(h[a:b], b - a) if b > a else every[:0])
    return out
