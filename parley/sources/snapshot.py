"""File snapshots, listings and named targets."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from parley.operators.numbering import dense_number
from parley.operators.relational import keep_first, lookup
from parley.schema import derive_sources

JURISDICTION = "id string, name string, name_short string, state string"
BODY = "id string, jurisdiction_id string, name string, name_short string, timezone string, video_sources array<struct<kind:string,youtube_id:string>>"
PERSON = "slug string, name string"
MEETING = "body_id string, youtube_id string, title string, duration_secs string, _audio_sha256 string"
VIDEO = "id string, channel_id string, title string, description string, duration double"
_LEAF = "_type:string,id:string,title:string"
#: Listings nest a channel's tabs over its videos: two levels below the root.
LISTING = f"struct<{_LEAF},entries:array<struct<{_LEAF},entries:array<struct<{_LEAF}>>>>>"


def tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """The parquet tables of a folder by name."""
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}


def jdbc_table(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A live database table; partition options are passed on."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def resolve_target(target: str | None, known: dict[str, str]) -> str:
    """URL of a named target (``DATABASE_URL_<NAME>``), or the URL itself; ``local`` by default. An unknown name is an error that lists the known."""
    name = target or "local"
    if "://" in name:
        return name
    found = known.get("DATABASE_URL_" + name.upper().replace("-", "_"))
    if not found:
        names = sorted(k.removeprefix("DATABASE_URL_").lower().replace("_", "-") for k in known if k.startswith("DATABASE_URL_"))
        raise ValueError(f"unknown target {name!r}; known: {', '.join(names) or 'none'}")
    return found


def redact(url: str) -> str:
    """The URL with its password masked."""
    return re.sub(r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^:/?#@]*):[^@/?#]*@", r"\1:***@", url)


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line; blank lines are skipped, broken ones are an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document for each file."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def load(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Jurisdictions, bodies, people and one row for each meeting folder (its name is the slug). A missing path is an error."""
    meetings = json_document(spark, f"{folder}/meetings/*/meeting.json", MEETING).withColumn("slug", F.regexp_extract(F.col("_metadata.file_path"), "/([^/]+)/meeting\\.json$", 1))
    return {"jurisdictions": jsonl(spark, f"{folder}/jurisdictions.jsonl", JURISDICTION), "bodies": jsonl(spark, f"{folder}/bodies.jsonl", BODY), "people": jsonl(spark, f"{folder}/people.jsonl", PERSON), "meetings": meetings}


def to_rows(snapshot: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables with 1-based ids in order of their string keys; an unknown key is an error."""
    number = lambda df, key: dense_number(df.withColumn("_key", F.col(key)), ["_key"], into="_id", kind="int")
    places = number(snapshot["jurisdictions"], "id")
    keys = places.select(F.col("_key").alias("jurisdiction_id"), F.col("_id").alias("_jurisdiction"))
    bodies = number(lookup(snapshot["bodies"], keys, "jurisdiction_id", "_jurisdiction", required=True), "id")
    sources = bodies.select(F.col("_id").alias("body_id"), F.posexplode("video_sources").alias("_pos", "s"))
    numbered = dense_number(sources, ["body_id", "_pos"], kind="int")
    return {
        "jurisdictions": places.select(F.col("_id").alias("id"), "name", "name_short", "state"),
        "bodies": bodies.select(F.col("_id").alias("id"), F.col("_jurisdiction").alias("jurisdiction_id"), "name", "name_short", "timezone"),
        "video_sources": derive_sources(numbered.select("id", "body_id", "s.kind", "s.youtube_id")),
    }


def flatten_listing(listings: DataFrame, key: str, document: str) -> DataFrame:
    """key, i, video_id, title: the video leaves of nested listing documents (JSON text) in order, each id once."""
    tree = F.from_json(document, LISTING)
    leaf = lambda e: e["_type"].isNull() | (e["_type"] == "url")
    top = listings.select(key, F.posexplode(tree["entries"]).alias("a", "e"))
    plain = lambda e, b: F.struct(F.lit(0).alias("b") if b is None else b.alias("b"), e["_type"].alias("_type"), e["id"].alias("id"), e["title"].alias("title"))
    inner = F.transform(F.col("e.entries"), lambda x, b: plain(x, b))
    each = top.select(key, "a", F.explode(F.when(F.col("e.entries").isNotNull(), inner).otherwise(F.array(plain(F.col("e"), None)))).alias("x"))
    kept = each.filter(leaf(F.col("x")) & F.col("x.id").isNotNull()).select(key, "a", F.col("x.b").alias("b"), F.col("x.id").alias("video_id"), F.col("x.title").alias("title"))
    first = keep_first(kept, [key, "video_id"], ["a", "b"])
    return first.select(key, (F.row_number().over(W.partitionBy(key).orderBy("a", "b")) - 1).alias("i"), "video_id", "title")


def video_metadata(documents: DataFrame, document: str) -> DataFrame:
    """id, channel_id, title, description, duration of metadata JSON; missing texts are '', a missing duration null."""
    m = F.from_json(document, VIDEO)
    return documents.select(*[F.coalesce(m[c], F.lit("")).alias(c) for c in ("id", "channel_id", "title", "description")], m["duration"].alias("duration"))


def id_list(spark: SparkSession, text: str) -> DataFrame:
    """Ids of a white-space separated text; none is an error."""
    found = spark.createDataFrame([(text,)], "value string").select(F.explode(F.split("value", "\\s+")).alias("id")).filter("id != ''")
    if found.isEmpty():
        raise ValueError("no ids given")
    return found


def audio_files(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256 and content of the files of a folder, at any depth (Spark passes over files without a byte); decoding is left to a seam."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.sha2("content", 256).alias("sha256"), "content")


def verified_audio(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose digest is the manifest's (path, sha256); any other is an error."""
    wrong = F.raise_error(F.concat(F.lit("digest differs: "), F.col("path"))).cast("binary")
    return files.join(manifest.select("path", F.col("sha256").alias("_want")), "path").withColumn("content", F.when(F.col("sha256") == F.col("_want"), F.col("content")).otherwise(wrong)).drop("_want")


def check_files(files: DataFrame, manifest: DataFrame, folder: str) -> DataFrame:
    """path (below ``folder``) and status of all files and manifest rows: ok, differs, missing or unknown."""
    tail = F.regexp_extract("path", "(?:^|/)" + re.escape(folder.rstrip("/").rpartition("/")[2]) + "/(.*)$", 1)
    found = files.select(tail.alias("path"), F.col("sha256").alias("_found"))
    status = F.when(F.col("_found").isNull(), "missing").when(F.col("_want").isNull(), "unknown").when(F.col("_found") == F.col("_want"), "ok").otherwise("differs")
    return found.join(manifest.select("path", F.col("sha256").alias("_want")), "path", "full").select("path", status.alias("status"))


def encode_wav(waves: DataFrame, *, rate: int = 16_000) -> DataFrame:
    """path, content: 16-bit PCM files of one channel from path and samples (floats in -1..1, clipped)."""
    import pandas as pd

    def run(batches):
        import io
        import wave

        import numpy as np

        for batch in batches:
            out = []
            for path, samples in zip(batch["path"], batch["samples"], strict=True):
                held = io.BytesIO()
                with wave.open(held, "wb") as w:
                    w.setnchannels(1), w.setsampwidth(2), w.setframerate(rate)
                    w.writeframes(np.clip(np.round(np.asarray(samples, dtype=np.float64) * 32768), -32768, 32767).astype("<i2").tobytes())
                out.append((path, held.getvalue()))
            yield pd.DataFrame(out, columns=["path", "content"])

    return waves.select("path", "samples").mapInPandas(run, "path string, content binary")


def decode_wav(files: DataFrame) -> DataFrame:
    """path, sample_rate, samples (floats in -1..1, first channel) of 16-bit PCM files."""
    import pandas as pd

    def run(batches):
        import io
        import wave

        import numpy as np

        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                with wave.open(io.BytesIO(content)) as w:
                    raw = np.frombuffer(w.readframes(w.getnframes()), dtype="<i2").reshape(-1, w.getnchannels())[:, 0]
                    out.append((path, w.getframerate(), (raw / 32768).astype("float32")))
            yield pd.DataFrame(out, columns=["path", "sample_rate", "samples"])

    return files.select("path", "content").mapInPandas(run, "path string, sample_rate int, samples array<float>")


