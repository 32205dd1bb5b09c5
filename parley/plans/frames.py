"""The meeting tables as analogues over the benchmark tables, and their SQL forms.

Nations are bodies, orders meetings, suppliers people, line items segments;
events are words or turns on a user's timeline. Nulls, which the tables lack,
are made by rule on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

BASE = 1704067200  # 2024-01-01 in Unix seconds


class Frames:
    """Analogue frames of one scale folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def bodies(self) -> DataFrame:
        k = F.col("n_nationkey")
        zone = F.when(k % 3 == 0, "America/Anchorage").when(k % 3 == 1, "Europe/Berlin").otherwise("UTC")
        return self.table("nation").select(k.alias("id"), F.col("n_regionkey").alias("jurisdiction_id"), F.col("n_name").alias("name"), F.col("n_name").alias("name_short"), zone.alias("timezone"))

    @property
    def meetings(self) -> DataFrame:
        body = self.table("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("body_id"))
        start = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate").cast("timestamp"))
        return self.table("orders").join(body, "o_custkey").select(F.col("o_orderkey").alias("id"), "body_id", F.concat(F.lit("v"), F.col("o_orderkey")).alias("youtube_id"), F.col("o_orderpriority").alias("title"), start.alias("start_time"))

    @property
    def people(self) -> DataFrame:
        return self.table("supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 5 != 0, F.col("s_name")).alias("name"))

    @property
    def segments(self) -> DataFrame:
        person = F.when(F.col("l_suppkey") % 11 != 0, F.col("l_suppkey"))
        return self.table("lineitem").select(F.col("l_orderkey").alias("meeting_id"), person.alias("person_id"), F.col("l_linenumber").alias("id"), F.col("l_quantity").alias("secs"))

    @property
    def words(self) -> DataFrame:
        """Events as words of a user's timeline."""
        order = W.partitionBy("user_id").orderBy("ts", "event_id")
        start = F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0 - BASE
        speaker = (F.length("event_type") % 3).cast("int")
        return self.table("events").select(F.col("user_id").alias("meeting_id"), (F.row_number().over(order) - 1).cast("int").alias("word_idx"), F.col("event_type").alias("text"), start.alias("start"), (start + 600 * (F.col("event_id") % 7)).alias("end"), speaker.alias("speaker_num"))

    @property
    def turns(self) -> DataFrame:
        """Every third event of a user opens a turn of one to four hours."""
        third = self.words.filter("word_idx % 3 = 0")
        return third.select("meeting_id", (F.col("word_idx") / 3).cast("int").alias("turn_idx"), "start", (F.col("start") + 3600 * (1 + F.col("word_idx") % 4)).alias("end"), (F.col("word_idx") % 4).cast("int").alias("speaker_num"))

    @property
    def talk(self) -> DataFrame:
        """Conversation turns as segments with words of half a second each."""
        texts = F.filter(F.split("text", "\\s+"), lambda w: w != "")
        words = F.transform(texts, lambda w, i: F.struct(w.alias("text"), (i * 0.5).cast("double").alias("start"), (i * 0.5 + 0.4).cast("double").alias("end")))
        return self.table("conversations").select(F.col("conv_id").alias("meeting_id"), F.col("turn").cast("int").alias("seg_idx"), F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1).alias("speaker_num"), "role", words.alias("words"))


SQL = {
    "bodies": "select n_nationkey as id, n_regionkey as jurisdiction_id, n_name as name, n_name as name_short, case n_nationkey % 3 when 0 then 'America/Anchorage' when 1 then 'Europe/Berlin' else 'UTC' end as timezone from nation",
    "meetings": "select o_orderkey as id, c_nationkey as body_id, 'v' || o_orderkey as youtube_id, o_orderpriority as title, case when o_orderkey % 7 <> 0 then o_orderdate end as start_time from orders join customer on o_custkey = c_custkey",
    "people": "select s_suppkey as id, case when s_suppkey % 5 <> 0 then s_name end as name from supplier",
    "segments": "select l_orderkey as meeting_id, case when l_suppkey % 11 <> 0 then l_suppkey end as person_id, l_linenumber as id, l_quantity as secs from lineitem",
    "words": f"select user_id as meeting_id, (row_number() over (partition by user_id order by ts, event_id) - 1)::int as word_idx, event_type as text, epoch_us(ts) / 1000000.0 - {BASE} as start, epoch_us(ts) / 1000000.0 - {BASE} + 600 * (event_id % 7) as \"end\", (length(event_type) % 3)::int as speaker_num from events",
    "turns": "select meeting_id, (word_idx // 3)::int as turn_idx, start, start + 3600 * (1 + word_idx % 4) as \"end\", (word_idx % 4)::int as speaker_num from words where word_idx % 3 = 0",
    "talk": "select conv_id as meeting_id, turn::int as seg_idx, case role when 'user' then 0 when 'assistant' then 1 end as speaker_num, role, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') as texts from conversations",
}


def with_frames(names: str, query: str) -> str:
    """``query`` with the named frames as common tables (``turns`` brings ``words``)."""
    wanted = ["words"] * ("turns" in names.split() and "words" not in names.split()) + names.split()
    return "with recursive " + ", ".join(f"{n} as ({SQL[n]})" for n in wanted) + (", " if query.lstrip().startswith("+") else " ") + query.lstrip().removeprefix("+").strip()
