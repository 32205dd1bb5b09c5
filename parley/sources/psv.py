"""Pipe-separated transcripts: reader and writers.

A file is read as lines with their place in the file. Files are independent,
so grouping is a window per file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from parley.functions import strings, times
from parley.schema import WORDS

HEADER = "start_sec|end_sec|event_type|event_data"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 1), line of every file under ``path``; a file is one row until its lines are numbered."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", "\r?\n")).alias("n", "line")).select("file", (F.col("n") + 1).alias("line_no"), "line")


def parse_lines(lines: DataFrame) -> DataFrame:
    """Events of lines (file, line_no, line): start, end, event_type, event_data. Data may hold pipes; an unknown type is an error."""
    kept = lines.withColumn("line", strings.trim_all(F.col("line"))).filter((F.col("line") != "") & ~F.col("line").startswith("#") & (F.col("line") != HEADER))
    fail = lambda why: F.raise_error(F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(f": {why}: "), F.col("line"))).cast("string")
    # step by step: a step's columns are worked out once, however often the next one reads them
    cut = kept.select("file", "line_no", "line", F.split("line", "\\|", 4).alias("_p"))
    p = F.col("_p")
    kind = F.when(F.size(p) < 4, fail("expected four fields")).when(p[2].isin("text", "meta", "vad"), p[2]).otherwise(fail("unknown event type"))
    shaped = cut.select("file", "line_no", kind.alias("event_type"), F.get(p, 0).alias("_s"), F.get(p, 1).alias("_e"), F.get(p, 3).alias("event_data"))
    parts = shaped.select("*", F.split("_s", ":").alias("_sp"), F.split("_e", ":").alias("_ep"))
    start, end = times.parts_secs(F.col("_s"), F.col("_sp")), F.when(F.col("event_type") != "meta", times.parts_secs(F.col("_e"), F.col("_ep")))
    return parts.select("file", "line_no", start.alias("start"), end.alias("end"), "event_type", "event_data")


def segments(events: DataFrame) -> DataFrame:
    """file, seg_idx, speaker_num, words: a meta row opens a segment, vad rows are skipped; a word before any meta is an error."""
    order = W.partitionBy("file").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    kept = events.filter("event_type != 'vad'").withColumn("seg_idx", (F.sum((F.col("event_type") == "meta").cast("int")).over(order) - 1).cast("int"))
    early = F.raise_error(F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(": text before begin_speaker"))).cast("int")
    kept = kept.withColumn("seg_idx", F.when(F.col("seg_idx") < 0, early).otherwise(F.col("seg_idx")))
    label = F.from_json("event_data", "begin_speaker string", {"mode": "FAILFAST"})["begin_speaker"]
    speaker = F.max(F.when(F.col("event_type") == "meta", strings.parse_speaker_label(label)))
    word = F.when(F.col("event_type") == "text", F.struct("line_no", F.struct(F.col("event_data").alias("text"), "start", "end").alias("w")))
    return kept.groupBy("file", "seg_idx").agg(speaker.alias("speaker_num"), F.transform(F.array_sort(F.collect_list(word)), lambda x: x["w"]).cast(WORDS).alias("words"))


def read(spark: SparkSession, path: str) -> DataFrame:
    return segments(parse_lines(read_lines(spark, path)))


def _text_line(w: Column) -> Column:
    return F.concat(times.psv_time(w["start"]), F.lit("|"), times.psv_time(w["end"]), F.lit("|text|"), w["text"])


def _numbered(rows: DataFrame, key: str, order: str, lines: Column) -> DataFrame:
    """key, line_no, line with the header first."""
    body = rows.select(key, F.col(order).alias("_o"), F.posexplode(lines).alias("_i", "line"))
    place = F.row_number().over(W.partitionBy(key).orderBy("_o", "_i")) + 1
    head = rows.select(key).distinct().select(key, F.lit(1).alias("line_no"), F.lit(HEADER).alias("line"))
    return head.unionByName(body.select(key, place.alias("line_no"), "line"))


def segment_lines(rows: DataFrame, key: str = "file") -> DataFrame:
    """Segments (key, seg_idx, speaker_num, words) as numbered lines of one file for each key."""
    begin = F.coalesce(F.try_element_at("words", F.lit(1))["start"], F.lit(0.0))
    meta = F.concat(times.psv_time(begin), F.lit("||meta|"), F.to_json(F.struct(strings.speaker_label(F.col("speaker_num")).alias("begin_speaker"))))
    return _numbered(rows, key, "seg_idx", F.concat(F.array(meta), F.transform("words", _text_line)))


def run_lines(runs: DataFrame, key: str = "file") -> DataFrame:
    """Speech runs (key, run_idx, start, end, words) as one unlabeled segment with a vad row before each run's words."""
    first = F.row_number().over(W.partitionBy(key).orderBy("run_idx")) == 1
    meta = F.concat(times.psv_time(F.col("start")), F.lit('||meta|{"begin_speaker":"unlabeled"}'))
    length = F.regexp_replace(F.regexp_replace(F.format_string("%.2f", times.half_up((F.col("end") - F.col("start")) * 100) / 100), "0+$", ""), "\\.$", "")
    vad = F.concat(times.psv_time(F.col("start")), F.lit("|"), times.psv_time(F.col("end")), F.lit('|vad|{"index":'), F.col("run_idx").cast("string"), F.lit(',"dur":'), length, F.lit("}"))
    rows = runs.withColumn("_meta", F.when(first, F.array(meta)).otherwise(F.array().cast("array<string>")))
    return _numbered(rows, key, "run_idx", F.concat("_meta", F.array(vad), F.transform("words", _text_line)))


def write(lines: DataFrame, path: str, key: str = "file") -> None:
    """One folder for each key with its lines in order; lines of a key share a task, as one file has to be in order."""
    whole = lines.repartition(F.col(key)).sortWithinPartitions(key, "line_no")
    whole.select(key, F.col("line").alias("value")).write.partitionBy(key).text(path)
