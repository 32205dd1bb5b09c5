"""Registered queries: each applies an operator to the benchmark tables, with its DuckDB form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from parley.functions import strings, times, vectors
from parley.operators import relational, talk, timeline, voices, wer
from parley.plans.frames import Frames, with_frames
from parley.schema import source_url, violations, watch_url, words_end, words_start, words_text
from parley.sources import psv, sinks, snapshot

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


#: The analogue's turns last hours.
BUCKET = 7200.0


def query(name: str, frames: str | None = None, sql: str | None = None):
    """Register a function of ``Frames``; ``sql`` may use the named analogue frames."""

    def register(f: Callable[[Frames], DataFrame]) -> Callable[[Frames], DataFrame]:
        QUERIES[name] = lambda spark, folder: f(Frames(spark, folder))
        if sql is not None:
            ORACLES[name] = with_frames(frames, sql) if frames else sql.strip()
        return f

    return register


# --- relational reads ---------------------------------------------------------


@query("a5_attendance", "bodies meetings segments", """
select person_id, body_id, b.name_short as body, timezone, count(distinct meeting_id) as meetings, min(start_time) as first, max(start_time) as last
from segments s join meetings m on m.id = s.meeting_id join bodies b on b.id = m.body_id where person_id is not null group by all""")  # fmt: skip
def _(x: Frames) -> DataFrame:
    found = relational.attendance(x.segments, x.meetings, x.bodies)
    return found.select("person_id", "body_id", "body", "timezone", "meetings", F.col("first").cast("timestamp_ntz").alias("first"), F.col("last").cast("timestamp_ntz").alias("last"))


@query("j13_people_with_attendance", "bodies meetings segments people", """
+ att as (select person_id, b.name_short as body, timezone, count(distinct meeting_id) as n, min(start_time) as f, max(start_time) as l
  from segments s join meetings m on m.id = s.meeting_id join bodies b on b.id = m.body_id where person_id is not null group by all),
lab as (select *, strftime(timezone(timezone, timezone('UTC', f)), '%b %Y') as fm, strftime(timezone(timezone, timezone('UTC', l)), '%b %Y') as lm from att),
txt as (select person_id, string_agg(n || ' ' || body || case n when 1 then ' meeting' else ' meetings' end || case when f is null then '' when fm = lm then ', ' || fm else ', ' || fm || '–' || lm end, ' · ' order by n desc, body) as t from lab group by 1)
select id, name, coalesce(t, '') as attendance from people left join txt on person_id = id""")  # fmt: skip
def _(x: Frames) -> DataFrame:
    people = relational.with_attendance(x.people, relational.attendance(x.segments, x.meetings, x.bodies))
    return people.select("id", "name", relational.attendance_text(F.col("attendance")).alias("attendance"))


@query("t16_list_ingested", "bodies meetings segments", """
select m.id, youtube_id, title, start_time, lower(name_short) as body, count(s.id) as segments
from meetings m join bodies b on b.id = m.body_id left join segments s on s.meeting_id = m.id group by all""")  # fmt: skip
def _(x: Frames) -> DataFrame:
    return relational.list_ingested(x.meetings, x.bodies, x.segments).withColumn("start_time", F.col("start_time").cast("timestamp_ntz"))


@query("f2_optional_ids", "bodies meetings segments", """
select m.id, count(s.id) as segments from meetings m join bodies b on b.id = m.body_id left join segments s on s.meeting_id = m.id where m.id in (1, 2, 3, 5, 8) group by 1""")  # fmt: skip
def _(x: Frames) -> DataFrame:
    return relational.list_ingested(x.meetings, x.bodies, x.segments, [1, 2, 3, 5, 8]).select("id", "segments")


@query("t18_search", None, """
select conv_id * 1000 + turn as id, conv_id as meeting_id, role from conversations where text ilike '%tion%' order by id desc limit 50""")  # fmt: skip
def _(x: Frames) -> DataFrame:
    c = x.table("conversations")
    segments = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("meeting_id"), F.col("role").alias("person_id"), "text")
    meetings = c.select(F.col("conv_id").alias("id")).distinct()
    people = c.select(F.col("role").alias("id"), F.col("role").alias("name")).distinct()
    return relational.search_segments(segments, meetings, people, "TION").select("id", "meeting_id", F.col("person.id").alias("role"))


@query("f4_like_metacharacters", None, """
select doc_id from documents where text ilike '%a_e%th%'""")  # fmt: skip
def _(x: Frames) -> DataFrame:
    return x.table("documents").filter(strings.contains_text(F.col("text"), "a_e%th")).select("doc_id")


@query("f4_like_escaped", None, """
select doc_id from documents where contains(lower(text), '%%%')""")  # fmt: skip
def _(x: Frames) -> DataFrame:
    return x.table("documents").filter(strings.contains_text(F.col("text"), "%%%", escape=True)).select("doc_id")


@query("j3_required_parent", "bodies meetings", """
select m.id, b.name as body, r_name as jurisdiction from meetings m join bodies b on b.id = body_id join region on r_regionkey = jurisdiction_id""")  # fmt: skip
def _(x: Frames) -> DataFrame:
    regions = x.table("region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    bodies = relational.to_one(x.bodies, regions, "jurisdiction_id", "jurisdiction", required=True)
    return relational.to_one(x.meetings, bodies, "body_id", "body", required=True).select("id", F.col("body.name").alias("body"), F.col("body.jurisdiction.name").alias("jurisdiction"))


@query("j4_optional_parent", "segments people", """
select meeting_id, count(*) as n, count(p.id) as identified, count(p.name) as named from segments s left join people p on p.id = person_id group by 1""")  # fmt: skip
def _(x: Frames) -> DataFrame:
    joined = relational.to_one(x.segments, x.people, "person_id", "person")
    return joined.groupBy("meeting_id").agg(F.count(F.lit(1)).alias("n"), F.count("person").alias("identified"), F.count("person.name").alias("named"))


@query("j5_nested_children", None, """
select n_nationkey as id, n_name as name, coalesce(string_agg(c_name, ',' order by c_custkey), '') as customers from nation left join customer on c_nationkey = n_nationkey group by all""")  # fmt: skip
def _(x: Frames) -> DataFrame:
    nested = relational.to_many(x.bodies, x.table("customer"), "c_nationkey", "customers", [F.col("c_custkey")])
    return nested.select("id", "name", F.array_join(F.transform("customers", lambda c: c["c_name"]), ",").alias("customers"))


@query("j6_top100_per_parent", None, """
select user_id as id, string_agg(event_id::varchar, ',' order by event_id desc) as events from (select *, row_number() over (partition by user_id order by event_id desc) as n from events) where n <= 100 group by 1""")  # fmt: skip
def _(x: Frames) -> DataFrame:
    users = x.table("events").select(F.col("user_id").alias("id")).distinct()
    nested = relational.to_many(users, x.table("events"), "user_id", "events", [F.col("event_id").desc()], limit=relational.PERSON_SEGMENTS)
    return nested.select("id", F.array_join(F.transform("events", lambda e: e["event_id"].cast("string")), ",").alias("events"))


@query("j7_available", "bodies meetings", """
select lower(name_short) as body, o_custkey as source_id, o_orderkey as i, 'v' || o_orderkey as video_id
from orders join customer on c_custkey = o_custkey join bodies b on b.id = c_nationkey where not exists (select 1 from lineitem where l_orderkey = o_orderkey)""")  # fmt: skip
def _(x: Frames) -> DataFrame:
    sources = x.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("body_id"))
    listing = x.table("orders").select(F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("i"), F.concat(F.lit("v"), F.col("o_orderkey")).alias("video_id"))
    seen = x.table("lineitem").select(F.concat(F.lit("v"), F.col("l_orderkey")).alias("youtube_id")).distinct()
    return relational.available(x.bodies, sources, listing, seen)


@query("t15_available_slug", "bodies", """
select lower(name_short) as body, count(*) as videos from orders join customer on c_custkey = o_custkey join bodies b on b.id = c_nationkey
where lower(name_short) = 'nation_7' and o_orderkey % 2 = 1 group by 1""")  # fmt: skip
def _(x: Frames) -> DataFrame:
    sources = x.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("body_id"))
    listing = x.table("orders").select(F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("i"), F.col("o_orderkey").cast("string").alias("video_id"))
    seen = x.table("orders").filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").cast("string").alias("youtube_id"))
    return relational.available(x.bodies, sources, listing, seen, "Nation_7").groupBy("body").agg(F.count(F.lit(1)).alias("videos"))


@query("j8_lookup_or_null", "segments", """
select person_id, count(*) as n, sum(case when s_name is null then 1 else 0 end)::bigint as missed from segments left join supplier on s_suppkey = person_id group by 1""")  # fmt: skip
def _(x: Frames) -> DataFrame:
    names = x.table("supplier").select(F.col("s_suppkey").alias("person_id"), "s_name")
    found = relational.lookup(x.segments, names, "person_id", "s_name")
    return found.groupBy("person_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("s_name").isNull()).alias("missed"))


@query("j9_lookup_required", None, "select o_orderkey, c_nationkey from orders join customer on c_custkey = o_custkey")
def _(x: Frames) -> DataFrame:
    nations = x.table("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return relational.lookup(x.table("orders"), nations, "o_custkey", "c_nationkey", required=True).select("o_orderkey", "c_nationkey")


@query("j10_update_from", None, """
select c_custkey as id, case when n_nationkey % 4 = 1 then null when n_nationkey < 20 then n_name else c_mktsegment end as segment from customer left join nation on n_nationkey = c_nationkey""")  # fmt: skip
def _(x: Frames) -> DataFrame:
    customers = x.table("customer").select(F.col("c_custkey").alias("id"), "c_nationkey", F.col("c_mktsegment").alias("segment"))
    names = x.table("nation").select(F.col("n_nationkey").alias("c_nationkey"), F.when(F.col("n_nationkey") % 4 != 1, F.col("n_name")).alias("name")).filter("c_nationkey < 20 or c_nationkey % 4 = 1")
    return relational.update_from(customers, names, "c_nationkey", "name", "segment").select("id", "segment")


@query("j11_delete_childless", None, "select o_orderkey as id from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey)")
def _(x: Frames) -> DataFrame:
    return relational.delete_childless(x.table("orders").select(F.col("o_orderkey").alias("id")), x.table("lineitem"), "l_orderkey")


@query("j11_conditional_insert", None, "select n_nationkey as id, n_name as name from nation union all select 99, 'NATION_99' where exists (select 1 from region where r_regionkey = 3)")
def _(x: Frames) -> DataFrame:
    row = x.spark.createDataFrame([(99, "NATION_99")], "id int, name string")
    return relational.insert_if_exists(x.bodies.select("id", "name"), row, x.table("region").filter("r_regionkey = 3"))


@query("j12_scalar_subquery", None, "select o_orderkey, (select n_regionkey from nation where n_name = 'NATION_7') as region from orders")
def _(x: Frames) -> DataFrame:
    nations = x.table("nation").withColumnRenamed("n_nationkey", "id")
    return relational.with_scalar(x.table("orders").select("o_orderkey"), nations, F.col("n_name") == "NATION_7", "n_regionkey", "region")


@query("snk3_keyed_update", "people", "select id, case when id % 3 = 0 then null when id % 3 = 1 then 'n' || id else name end as name from people")
def _(x: Frames) -> DataFrame:
    changes = x.people.filter("id % 3 < 2").select("id", F.when(F.col("id") % 3 == 0, " \t ").otherwise(F.concat(F.lit(" n"), F.col("id"), F.lit(" "))).alias("name"))
    return relational.set_name(x.people, changes)


@query("snk6_get_or_create", None, "select n_name as name, n_nationkey as id from nation union all select 'NEW_' || r_regionkey, 25 + r_regionkey from region")
def _(x: Frames) -> DataFrame:
    new = x.table("region").select(F.concat(F.lit("NEW_"), F.col("r_regionkey")).alias("name")).unionByName(x.table("nation").select(F.col("n_name").alias("name")))
    return relational.insert_missing(x.bodies.select("name", "id"), new, "name")


@query("f9_null_collapse", None, "select o_orderkey, case when o_orderpriority not in ('5-LOW', '4-NOT SPECIFIED') then o_orderpriority end as priority from orders")
def _(x: Frames) -> DataFrame:
    return x.table("orders").select("o_orderkey", relational.null_collapse(F.col("o_orderpriority"), ["5-LOW", "4-NOT SPECIFIED"]).alias("priority"))


@query("o1_nulls_first_desc", "meetings", "select id, start_time from meetings order by start_time desc nulls first, id desc")
def _(x: Frames) -> DataFrame:
    return x.meetings.orderBy(relational.desc("start_time"), relational.desc("id")).select("id", F.col("start_time").cast("timestamp_ntz").alias("start_time"))


@query("o2_nulls_last_asc", "people", "select id, name from people order by name asc nulls last, id")
def _(x: Frames) -> DataFrame:
    return x.people.orderBy(relational.asc("name"), relational.asc("id"))


@query("o10_group_order", "meetings segments", """
select row_number() over (order by start_time desc nulls last, case when start_time is null then id end desc, seen)::int as place, id, n from
(select m.id, start_time, min(l_linenumber * 1000000 + l_orderkey) as seen, count(*) as n from meetings m join lineitem on l_orderkey = m.id group by all)""")  # fmt: skip
def _(x: Frames) -> DataFrame:
    rows = x.table("lineitem").select(F.col("l_orderkey").alias("meeting_id"), (F.col("l_linenumber") * 1000000 + F.col("l_orderkey")).alias("id"), F.col("l_quantity").alias("start_secs"), F.lit("").alias("text"))
    grouped = relational.group_by_meeting(rows, x.meetings)
    first = F.array_min(F.transform("segments", lambda s: s["id"]))
    keys = grouped.select("id", "start_time", F.size("segments").cast("long").alias("n"), first.alias("seen"), F.when(F.col("start_time").isNull(), F.floor(F.col("id") / 65536)).alias("block"))
    # only days and blocks of undated ids are ranked in one task; meetings are ranked within them
    by = W.orderBy(F.col("t").desc_nulls_last(), F.col("b").desc()).rowsBetween(W.unboundedPreceding, -1)
    sizes = keys.groupBy(F.col("start_time").alias("t"), F.col("block").alias("b")).agg(F.count(F.lit(1)).alias("c"))
    offsets = sizes.withColumn("before", F.coalesce(F.sum("c").over(by), F.lit(0)))
    within = W.partitionBy("start_time", "block").orderBy(F.when(F.col("start_time").isNull(), F.col("id")).desc_nulls_last(), "seen", "id")  # ids of several meetings' segments can be equal here
    placed = keys.join(offsets, F.col("start_time").eqNullSafe(F.col("t")) & F.col("block").eqNullSafe(F.col("b")))
    return placed.select((F.col("before") + F.row_number().over(within)).cast("int").alias("place"), "id", "n")


@query("u1_keep_first", None, "select event_id, user_id, event_type, value from (select *, row_number() over (partition by user_id, event_type order by ts, event_id) as n from events) where n = 1")
def _(x: Frames) -> DataFrame:
    return relational.keep_first(x.table("events"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "user_id", "event_type", "value")


@query("u3_bag_union", None, "select n_nationkey as id, 'nation' as kind from nation union all select r_regionkey, 'region' from region union all select r_regionkey, 'region' from region")
def _(x: Frames) -> DataFrame:
    r = x.table("region").select(F.col("r_regionkey").alias("id"), F.lit("region").alias("kind"))
    return x.table("nation").select(F.col("n_nationkey").alias("id"), F.lit("nation").alias("kind")).unionByName(r).unionByName(r)


@query("a14_status_totals", "bodies meetings segments", """
select count(*) as meetings, sum(n)::bigint as segments, count(distinct body) as bodies from (select m.id, lower(name_short) as body, count(s.id) as n from meetings m join bodies b on b.id = body_id left join segments s on s.meeting_id = m.id group by all)""")  # fmt: skip
def _(x: Frames) -> DataFrame:
    return relational.status_totals(relational.list_ingested(x.meetings, x.bodies, x.segments))


@query("a18_p95", None, "select l_returnflag, quantile_disc(l_extendedprice, 0.95) as p95, round(avg(l_extendedprice), 4) as mean, max(l_extendedprice) as top, count(*) filter (where l_discount > 0.05) as discounted from lineitem group by 1")
def _(x: Frames) -> DataFrame:
    return x.table("lineitem").groupBy("l_returnflag").agg(relational.percentile_nearest_rank(0.95, "l_extendedprice").alias("p95"), F.round(F.coalesce(F.avg("l_extendedprice"), F.lit(0.0)), 4).alias("mean"), F.max("l_extendedprice").alias("top"), F.count_if(F.col("l_discount") > 0.05).alias("discounted"))


# --- derived columns and checks -------------------------------------------------


@query("prj5_urls", None, """
select page_id, case when page_id % 2 = 0 then 'https://www.youtube.com/channel/' || page_id else 'https://www.youtube.com/playlist?list=' || page_id end as source,
  case when page_id % 5 = 0 then '' else 'https://www.youtube.com/watch?v=' || page_id end as watch from pages""")  # fmt: skip
def _(x: Frames) -> DataFrame:
    k = F.col("page_id").cast("string")
    return x.table("pages").select("page_id", source_url(F.when(F.col("page_id") % 2 == 0, "channel").otherwise("playlist"), k).alias("source"), watch_url(F.when(F.col("page_id") % 5 == 0, "").otherwise(k)).alias("watch"))


@query("s2_url_normalise", None, """
select page_id, case when contains(u, 'youtube.com') then u else 'https://www.youtube.com/channel/' || u end as channel, case when contains(u, 'youtube.com') then u else 'https://www.youtube.com/watch?v=' || u end as video
from (select page_id, case when page_id % 3 = 0 then 'https://youtube.com/' || page_id else url end as u from pages)""")  # fmt: skip
def _(x: Frames) -> DataFrame:
    u = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://youtube.com/"), F.col("page_id"))).otherwise(F.col("url"))
    return x.table("pages").select("page_id", strings.channel_url(u).alias("channel"), strings.video_url(u).alias("video"))


@query("udf1_words_to_text", "talk", "select meeting_id, seg_idx, coalesce(array_to_string(texts, ' '), '') as text, len(texts)::int as n from talk")
def _(x: Frames) -> DataFrame:
    return x.talk.select("meeting_id", "seg_idx", words_text(F.col("words")).alias("text"), F.size("words").alias("n"))


@query("udf2_word_bounds", "words", """
select meeting_id, round(min_by(start, word_idx), 3) as start, round(max_by("end", word_idx), 3) as "end", round(max_by("end", word_idx) - min_by(start, word_idx), 3) as duration, count(*) as n from words group by 1""")  # fmt: skip
def _(x: Frames) -> DataFrame:
    folded = timeline.collect_words(x.words, ["meeting_id"], "word_idx")
    w = F.col("words")
    return folded.select("meeting_id", F.round(words_start(w), 3).alias("start"), F.round(words_end(w), 3).alias("end"), F.round(words_end(w) - words_start(w), 3).alias("duration"), F.size(w).cast("long").alias("n"))


@query("c1_violations", None, """
select 'meetings.youtube_id unique' as "constraint", count(*) as rows from (select o_custkey from orders group by 1 having count(*) > 1)
union all select 'meetings.body_id -> bodies', count(*) from orders where o_custkey % 30 > 24""")  # fmt: skip
def _(x: Frames) -> DataFrame:
    meetings = x.table("orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 30).alias("body_id"), F.col("o_custkey").alias("youtube_id"))
    return violations({"meetings": meetings, "bodies": x.bodies.select("id")})


@query("c3_nonempty_words", "talk", "select meeting_id, seg_idx from talk where len(texts) > 0")
def _(x: Frames) -> DataFrame:
    return x.talk.filter(F.size("words") > 0).select("meeting_id", "seg_idx")


# --- timeline -----------------------------------------------------------------------


@query("w1_speaker_islands", "words", """
+ flag as (select *, case when speaker_num is not distinct from lag(speaker_num) over w and word_idx > 0 then 0 else 1 end as new from words window w as (partition by meeting_id order by word_idx)),
run as (select *, sum(new) over (partition by meeting_id order by word_idx) - 1 as seg from flag)
select meeting_id, seg::int as seg_idx, speaker_num, count(*) as n, string_agg(text, ' ' order by word_idx) as text from run group by all""")  # fmt: skip
def _(x: Frames) -> DataFrame:
    return timeline.speaker_segments(x.words).select("meeting_id", "seg_idx", "speaker_num", F.size("words").cast("long").alias("n"), words_text(F.col("words")).alias("text"))


@query("w2_word_ends", None, """
with t as (select conv_id * 1000 + turn as meeting_id, i - 1 as i, case when i % 3 = 1 then ' ' else '' end || substr(text, 4 * i - 3, 4) as token, i * 0.2 + (i % 5) * 0.02 as ts from (select *, unnest(range(1, (length(text) + 3) // 4 + 1)) as i from conversations)),
m as (select *, starts_with(token, ' ') or starts_with(token, '▁') or i = 0 as b from t),
g as (select *, sum(b::int) over (partition by meeting_id order by i) as w from m),
a as (select meeting_id, w, string_agg(case when b then regexp_replace(token, '^[ ▁]+', '') else token end, '' order by i) as text, min_by(ts, i) as start, max_by(ts, i) filter (where b or regexp_matches(token, '[\\p{L}\\p{N}]')) as v from g group by all),
e as (select *, least(v + 0.32, lead(start) over (partition by meeting_id order by w)) as "end" from a)
select meeting_id, (row_number() over (partition by meeting_id order by w) - 1)::int as word_idx, text, round(start, 4) as start, round("end", 4) as "end" from e where text <> ''""")  # fmt: skip
def _(x: Frames) -> DataFrame:
    rows = x.table("conversations").filter("length(text) > 0").select((F.col("conv_id") * 1000 + F.col("turn")).alias("meeting_id"), "text", F.explode(F.sequence(F.lit(1), F.ceil(F.length("text") / 4).cast("int"))).alias("k"))
    token = F.concat(F.when(F.col("k") % 3 == 1, " ").otherwise(""), F.substring(F.col("text"), F.col("k") * 4 - 3, F.lit(4)))
    tokens = rows.select("meeting_id", (F.col("k") - 1).alias("i"), token.alias("token"), (F.col("k") * 0.2 + (F.col("k") % 5) * 0.02).cast("double").alias("ts"))
    return timeline.tokens_to_words(tokens).withColumns({"start": F.round("start", 4), "end": F.round("end", 4)})


@query("j14_overlap_assign", "words turns", """
+ met as (select w.meeting_id, word_idx, t.speaker_num, row_number() over (partition by w.meeting_id, word_idx order by least(w."end", t."end") - greatest(w.start, t.start) desc, turn_idx) as n
  from words w join turns t on t.meeting_id = w.meeting_id and w.start < t."end" and w."end" > t.start where least(w."end", t."end") - greatest(w.start, t.start) > 0),
hit as (select meeting_id, word_idx, speaker_num from met where n = 1),
far as (select w.meeting_id, w.word_idx, t.speaker_num, row_number() over (partition by w.meeting_id, w.word_idx order by abs((w.start + w."end") / 2 - (t.start + t."end") / 2), turn_idx) as n
  from words w join turns t on t.meeting_id = w.meeting_id where not exists (select 1 from hit h where h.meeting_id = w.meeting_id and h.word_idx = w.word_idx))
select * from hit union all select meeting_id, word_idx, speaker_num from far where n = 1""")  # fmt: skip
def _(x: Frames) -> DataFrame:
    return timeline.assign_speakers(x.words, x.turns, bucket_secs=BUCKET).select("meeting_id", "word_idx", "speaker_num")


@query("j16_nearest_anchor", "words turns", """
select meeting_id, word_idx, anchor from (select w.meeting_id, w.word_idx, t.turn_idx as anchor, row_number() over (partition by w.meeting_id, w.word_idx order by abs(w.start - t.start), t.turn_idx) as n
from words w join turns t on t.meeting_id = w.meeting_id) where n = 1""")  # fmt: skip
def _(x: Frames) -> DataFrame:
    anchors = x.turns.select("meeting_id", "start", "turn_idx", F.col("turn_idx").alias("anchor"))
    return timeline.nearest(x.words.select("meeting_id", "word_idx", "start"), anchors, "meeting_id", "start", "turn_idx", "anchor").select("meeting_id", "word_idx", "anchor")


@query("j17_asof_runs", "words", """
+ runs as (select meeting_id, word_idx as run_idx, start from words where text = 'click'),
f as (select meeting_id, min_by(run_idx, start) as first from runs group by 1),
a as (select w.meeting_id, coalesce(r.run_idx, first) as run_idx, word_idx, w.text from words w asof left join runs r on r.meeting_id = w.meeting_id and r.start <= w.start join f on f.meeting_id = w.meeting_id)
select r.meeting_id, r.run_idx, count(a.word_idx) as n, coalesce(string_agg(a.text, ' ' order by a.word_idx), '') as text from runs r left join a using (meeting_id, run_idx) group by all""")  # fmt: skip
def _(x: Frames) -> DataFrame:
    runs = x.words.filter("text = 'click'").select("meeting_id", F.col("word_idx").alias("run_idx"), "start", "end")
    filled = timeline.words_to_runs(x.words, runs)
    return filled.select("meeting_id", "run_idx", F.size("words").cast("long").alias("n"), words_text(F.col("words")).alias("text"))


@query("j18_active_index", "words", """
select meeting_id, p as at, ((select count(*) from words w where w.meeting_id = u.meeting_id and w.start <= p) - 1)::int as active from (select distinct meeting_id from words) u, (select unnest([0, 86400, 864000, 8640000]) as p)""")  # fmt: skip
def _(x: Frames) -> DataFrame:
    points = x.words.select("meeting_id").distinct().withColumn("at", F.explode(F.array(*[F.lit(p) for p in (0, 86400, 864000, 8640000)])))
    return timeline.active_place(points, x.words, "meeting_id", "at", "start", "word_idx").select("meeting_id", "at", "active")


@query("j21_any_overlap", "turns", """
select meeting_id, coalesce(max(m > start), false) as overlaps from (select *, max("end") over (partition by meeting_id order by start, "end" rows between unbounded preceding and 1 preceding) as m from turns) group by 1""")  # fmt: skip
def _(x: Frames) -> DataFrame:
    return timeline.any_overlap(x.turns, "meeting_id")


@query("w7_pack_windows", "turns", """
+ n as (select meeting_id, turn_idx, start, "end" from turns),
fold as (select meeting_id, turn_idx, 0 as window_idx, start as begin from n where turn_idx = 0
  union all select n.meeting_id, n.turn_idx, case when n."end" - f.begin > 40000 then f.window_idx + 1 else f.window_idx end, case when n."end" - f.begin > 40000 then n.start else f.begin end
  from fold f join n on n.meeting_id = f.meeting_id and n.turn_idx = f.turn_idx + 1)
select meeting_id, turn_idx as run_idx, window_idx from fold""")  # fmt: skip
def _(x: Frames) -> DataFrame:
    runs = x.turns.select("meeting_id", F.col("turn_idx").alias("run_idx"), "start", "end")
    return timeline.pack_runs(runs, most_secs=40000.0).select("meeting_id", "run_idx", "window_idx")


@query("t4_segments_to_turns", "words", """
+ flag as (select *, case when speaker_num is not distinct from lag(speaker_num) over w and word_idx > 0 then 0 else 1 end as new from words window w as (partition by meeting_id order by word_idx)),
run as (select *, sum(new) over (partition by meeting_id order by word_idx) - 1 as seg from flag)
select meeting_id, (row_number() over (partition by meeting_id order by seg) - 1)::int as turn_idx, speaker_num, round(start, 3) as start, round("end", 3) as "end"
from (select meeting_id, seg, speaker_num, min_by(start, word_idx) as start, max_by("end", word_idx) as "end" from run group by all)""")  # fmt: skip
def _(x: Frames) -> DataFrame:
    return timeline.segments_to_turns(timeline.speaker_segments(x.words)).select("meeting_id", "turn_idx", "speaker_num", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


# --- talk and identity ----------------------------------------------------------------


@query("w3_first_appearance", None, """
select conv_id as meeting_id, role, (row_number() over (partition by conv_id order by min(turn)) - 1)::int as place, min(turn) as first from conversations group by conv_id, role""")  # fmt: skip
def _(x: Frames) -> DataFrame:
    return talk.first_appearance(x.table("conversations").withColumnRenamed("conv_id", "meeting_id"), "meeting_id", "role", "turn")


@query("w4_renumber_by_talk", "turns", """
+ t as (select meeting_id, speaker_num, sum("end" - start) as secs, min(turn_idx) as first from turns group by all)
select meeting_id, speaker_num as old, (row_number() over (partition by meeting_id order by round(secs, 3) desc, first) - 1)::int as new from t""")  # fmt: skip
def _(x: Frames) -> DataFrame:
    whole = x.turns.withColumn("end", F.col("start") + F.round(F.col("end") - F.col("start"))).withColumn("group", F.col("speaker_num")).withColumns({"start": F.lit(0.0), "end": F.round(F.col("end") - F.col("start"), 3)})
    return voices.renumber_by_talk(whole).select("meeting_id", F.col("group").alias("old"), F.col("speaker_num").alias("new")).distinct()


@query("a9_speaker_tally", None, """
with t as (select l_orderkey as meeting_id, l_suppkey as speaker_key, sum(l_quantity) as secs, min(l_linenumber) as first from lineitem group by all)
select meeting_id, speaker_key, secs, round(secs / sum(secs) over (partition by meeting_id), 6) as share from t""")  # fmt: skip
def _(x: Frames) -> DataFrame:
    rows = x.table("lineitem").select(F.col("l_orderkey").alias("meeting_id"), F.col("l_suppkey").alias("speaker_key"), F.col("l_linenumber").alias("seg_idx"), F.col("l_quantity").alias("secs"))
    return talk.tally_speakers(rows, F.col("secs")).select("meeting_id", "speaker_key", "secs", F.round("share", 6).alias("share"))


@query("t20_assign_speakers", None, """
with s as (select user_id as meeting_id, event_id as seg_idx, case when event_type = 'click' then user_id % 9 end as person_id, case event_type when 'click' then 0 when 'view' then 1 when 'error' then 2 when 'signup' then 3 end as num from events),
k as (select *, case when person_id is not null then 'person:' || person_id when num is not null then 'number:' || num else 'unattributed' end as key from s),
f as (select meeting_id, key, max(person_id) as person_id, min(seg_idx) as first from k group by all),
p as (select f.*, nullif(case when s_suppkey % 5 <> 0 then s_name end, '') as name, row_number() over (partition by meeting_id order by first) - 1 as place from f left join supplier on s_suppkey = person_id),
c as (select *, coalesce(sum((key <> 'unattributed' and name is null)::int) over w, 0) as anon, coalesce(sum((key <> 'unattributed')::int) over w, 0) as color from p window w as (partition by meeting_id order by place rows between unbounded preceding and 1 preceding))
select meeting_id, place::int as place, key as speaker_key, key <> 'unattributed' and name is null as anonymous, case when key = 'unattributed' then 'Unattributed' when name is not null then name else 'Anonymous ' || ['Aardvark', 'Beaver', 'Crocodile', 'Dolphin', 'Elephant'][anon::int + 1] end as label,
  case when key <> 'unattributed' then (color % 8 + 1)::int end as color_slot from c""")  # fmt: skip
def _(x: Frames) -> DataFrame:
    kind = F.col("event_type")
    person = F.when(kind == "click", F.col("user_id") % 9)
    number = F.when(kind == "click", 0).when(kind == "view", 1).when(kind == "error", 2).when(kind == "signup", 3)
    segments = x.table("events").select(F.col("user_id").alias("meeting_id"), F.col("event_id").alias("seg_idx"), person.alias("person_id"), number.alias("speaker_number"))
    return talk.assign_identities(segments, x.people).select("meeting_id", "place", "speaker_key", "anonymous", "label", "color_slot")


@query("s10_find_matches", "talk", """
+ t as (select meeting_id, seg_idx, array_to_string(list_transform(texts, lambda w: lower(w) || ' '), '') as s, texts from talk),
h as (select meeting_id, seg_idx, s, unnest(list_filter(range(1, length(s) - 3 + 1), lambda i: substr(s, i, 3) = 'he ')) as i from t where contains(s, 'he '))
select meeting_id, seg_idx, (i - 1)::int as at, (length(substr(s, 1, i - 1)) - length(replace(substr(s, 1, i - 1), ' ', '')))::int as "from", (length(substr(s, 1, i + 1)) - length(replace(substr(s, 1, i + 1), ' ', '')))::int as "to" from h""")  # fmt: skip
def _(x: Frames) -> DataFrame:
    # queries are trimmed, so hits at a word's end are picked afterwards
    found = talk.find_matches(x.talk, "he", ["meeting_id", "seg_idx"])
    texts = x.talk.select("meeting_id", "seg_idx", F.concat_ws("", F.transform("words", lambda w: F.concat(F.lower(w["text"]), F.lit(" ")))).alias("s"))
    ends = found.join(texts, ["meeting_id", "seg_idx"]).filter(F.substring(F.col("s"), F.col("at") + 3, F.lit(1)) == " ")
    return ends.select("meeting_id", "seg_idx", "at", "from", "to")


# --- voices ---------------------------------------------------------------------------


@query("a10_centroid", None, """
select label, i as pos, round(avg(v), 5) as x from (select label, unnest(embedding) as v, generate_subscripts(embedding, 1) - 1 as i from embeddings) group by all""")  # fmt: skip
def _(x: Frames) -> DataFrame:
    return voices.mean_vector(x.table("embeddings"), "label").select("label", F.posexplode("centroid").alias("pos", "v")).select("label", F.col("pos").cast("long").alias("pos"), F.round(F.col("v").cast("double"), 5).alias("x"))


@query("a12_topk_centroid", None, """
with r as (select label, embedding, row_number() over (partition by label order by vec_id % 7 desc, vec_id) as n from embeddings where vec_id % 7 >= 2)
select label, i as pos, round(avg(v), 4) as x from (select label, unnest(embedding) as v, generate_subscripts(embedding, 1) - 1 as i from r where n <= 3) group by all""")  # fmt: skip
def _(x: Frames) -> DataFrame:
    turns = x.table("embeddings").select(F.lit(0).alias("meeting_id"), F.col("label").alias("speaker_num"), F.col("vec_id").alias("turn_idx"), F.lit(0.0).alias("start"), (F.col("vec_id") % 7).cast("double").alias("end"), "embedding")
    return voices.speaker_centroids(turns).select(F.col("speaker_num").alias("label"), F.posexplode("centroid").alias("pos", "v")).select("label", F.col("pos").cast("long").alias("pos"), F.round(F.col("v").cast("double"), 4).alias("x"))


@query("j19_nearest_person", None, """
with e as (select vec_id, embedding::double[] as v from embeddings)
select vec_id as query_id, person_id, round(d, 5) as distance from (select q.vec_id, p.vec_id as person_id, 1 - list_cosine_similarity(q.v, p.v) as d, row_number() over (partition by q.vec_id order by 1 - list_cosine_similarity(q.v, p.v), p.vec_id) as n from e q join e p on q.vec_id <> p.vec_id where q.vec_id % 50 = 0) where n = 1""")  # fmt: skip
def _(x: Frames) -> DataFrame:
    e = x.table("embeddings")
    people = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("voice_embedding"))
    found = voices.nearest_person(e.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), people, max_distance=3.0, others_only=True)
    return found.withColumn("distance", F.round("distance", 5))


@query("j20_pairs", None, """
with c as (select label, list(x order by i) as v from (select label, i, avg(v) as x from (select label, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as i from embeddings) group by all) group by 1)
select a.label as a, b.label as b, round(list_cosine_similarity(a.v, b.v), 4) as similarity from c a join c b on a.label < b.label""")  # fmt: skip
def _(x: Frames) -> DataFrame:
    centroids = voices.mean_vector(x.table("embeddings"), "label").withColumn("meeting_id", F.lit(0))
    return voices.similar_pairs(centroids, "meeting_id", "label", F.col("centroid")).select("a", "b", F.round("similarity", 4).alias("similarity"))


@query("m1_cosine", None, "select vec_id, round(list_cosine_similarity(embedding::double[], list_reverse(embedding)::double[]), 5) as similarity from embeddings")
def _(x: Frames) -> DataFrame:
    return x.table("embeddings").select("vec_id", F.round(vectors.cosine_similarity(F.col("embedding"), F.reverse("embedding")), 5).alias("similarity"))


def voice_turns(x: Frames) -> DataFrame:
    k = F.col("vec_id")
    return x.table("embeddings").select((k % 5).alias("meeting_id"), k.alias("turn_idx"), (k * 3.0).alias("start"), (k * 3.0 + 1 + k % 3).alias("end"), (k % 20).cast("int").alias("speaker_num"), "embedding")


def _merged(weight: str) -> str:
    """Clusters of a meeting's speakers, merged pair by pair from the closest on (the last of equals), and each speaker's group."""
    return f"""
turns as (select vec_id % 5 as meeting_id, vec_id as turn_idx, vec_id * 3.0 as start, vec_id * 3.0 + 1 + vec_id % 3 as "end", (vec_id % 20)::int as speaker_num, embedding as v from embeddings),
long as (select *, row_number() over (partition by meeting_id, speaker_num order by "end" - start desc, turn_idx) as n from turns where "end" - start >= 1.5),
dims as (select meeting_id, speaker_num, unnest(v)::double as c, generate_subscripts(v, 1) as i from long where n <= 3),
mean as (select meeting_id, speaker_num, i, avg(c)::float::double as c from dims group by all),
voice as (select meeting_id, speaker_num, list(c order by i) as v from mean group by all),
mass as (select meeting_id, speaker_num, {weight} as w from turns group by all),
merging as (select 0 as step, meeting_id, row_number() over (partition by meeting_id order by speaker_num) as id, v, w::double as w, [speaker_num] as members from voice join mass using (meeting_id, speaker_num)
  union all select m.step + 1, m.meeting_id, m.id, case when m.id = p.a then list_transform(range(1, len(p.va) + 1), lambda k: ((p.va[k] * p.wa + p.vb[k] * p.wb) / (p.wa + p.wb))::float::double) else m.v end,
    case when m.id = p.a then p.wa + p.wb else m.w end, case when m.id = p.a then p.both else m.members end
  from merging m join (select x.meeting_id, x.id as a, y.id as b, x.v as va, y.v as vb, x.w as wa, y.w as wb, list_concat(x.members, y.members) as both,
      row_number() over (partition by x.meeting_id order by round(list_cosine_similarity(x.v, y.v), 12) desc, x.id desc, y.id desc) as n
    from merging x join merging y on x.meeting_id = y.meeting_id and x.id < y.id where round(list_cosine_similarity(x.v, y.v), 12) >= 0.2) p on p.meeting_id = m.meeting_id and p.n = 1 and p.b <> m.id),
ended as (select *, max(step) over (partition by meeting_id) as last from merging),
placed as (select meeting_id, members, (row_number() over (partition by meeting_id order by id) - 1)::int as grp from ended where step = last),
groups as (select meeting_id, unnest(members) as speaker_num, grp from placed)"""


@query("t10_merge_speakers", None, "with recursive" + _merged('sum("end" - start)') + """,
known as (select t.*, (t.start + t."end") / 2 as mid, grp from turns t left join groups using (meeting_id, speaker_num)),
near as (select o.meeting_id, o.turn_idx, k.grp, row_number() over (partition by o.meeting_id, o.turn_idx order by abs(o.mid - k.mid), k.turn_idx) as n from known o join known k on o.meeting_id = k.meeting_id and o.grp is null and k.grp is not null),
labelled as (select k.meeting_id, k.turn_idx, k.start, k."end", coalesce(k.grp, n.grp, -1 - k.speaker_num) as grp from known k left join near n on n.meeting_id = k.meeting_id and n.turn_idx = k.turn_idx and n.n = 1),
total as (select meeting_id, grp, (row_number() over (partition by meeting_id order by sum("end" - start) desc, min(turn_idx)) - 1)::int as speaker_num from labelled group by meeting_id, grp)
select meeting_id, turn_idx, start::double as start, "end"::double as "end", speaker_num from labelled join total using (meeting_id, grp)""")  # fmt: skip
def _(x: Frames) -> DataFrame:
    return voices.merge_speakers(voice_turns(x), threshold=0.2)


@query("t9_agglomerate", None, "with recursive" + _merged("1") + """
select meeting_id, speaker_num, grp as "group" from groups""")  # fmt: skip
def _(x: Frames) -> DataFrame:
    centroids = voices.speaker_centroids(voice_turns(x)).withColumn("weight", F.lit(1.0))
    return voices.cluster_speakers(centroids, threshold=0.2)


# --- strings, times, JSON ---------------------------------------------------------------


@query("s5_normalise", None, """
select doc_id, len(w)::int as n, coalesce(array_to_string(w, ' '), '') as words from (select doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\\p{L}\\p{N}\\s'']', ' ', 'g'), '\\s+'), lambda w: w <> '') as w from documents)""")  # fmt: skip
def _(x: Frames) -> DataFrame:
    w = strings.normalised_words(F.col("text"))
    return x.table("documents").select("doc_id", F.size(w).alias("n"), F.array_join(w, " ").alias("words"))


@query("s7_sentence_end", None, """
select conv_id, turn, regexp_matches(text, '[.?!]["'')\\]]?$') as ends, regexp_matches(text, '[\\p{L}\\p{N}]') as voiced, regexp_replace(lower(text), '[^\\p{L}\\p{N}\\s'']', '', 'g') as token from conversations""")  # fmt: skip
def _(x: Frames) -> DataFrame:
    t = F.col("text")
    return x.table("conversations").select("conv_id", "turn", strings.ends_sentence(t).alias("ends"), strings.is_voiced(t).alias("voiced"), strings.normalised_token(t).alias("token"))


@query("s3_labels", "people bodies", """
select id, coalesce(nullif(name, ''), '(unnamed)') as label, case when id % 4 = 0 then name else name || ', ' || id end as place, rpad(coalesce(name, ''), 24, ' ') as padded, 'person:' || id as key from people""")  # fmt: skip
def _(x: Frames) -> DataFrame:
    state = F.when(F.col("id") % 4 == 0, "").otherwise(F.col("id").cast("string"))
    place = F.when(F.col("name").isNotNull(), strings.place_label(F.col("name"), state))
    return x.people.select("id", strings.label_or(F.col("name"), "(unnamed)").alias("label"), place.alias("place"), strings.pad_end(F.coalesce("name", F.lit("")), F.lit(24)).alias("padded"), strings.speaker_key(F.col("id"), F.lit(None)).alias("key"))


@query("d5_meeting_time", None, """
with z as (select event_id, ts, case event_id % 3 when 0 then 'America/Anchorage' when 1 then 'Europe/Berlin' else 'Australia/Adelaide' end as tz from events)
select event_id, strftime(timezone(tz, timezone('UTC', ts)), '%B %-d, %Y %-I:%M %p') as shown, strftime(timezone(tz, timezone('UTC', ts)), '%b %Y') as month, strftime(timezone(tz, timezone('UTC', ts)), '%Y-%m-%dT%H:%M') as input, strftime(ts, '%Y-%m-%d') as day from z""")  # fmt: skip
def _(x: Frames) -> DataFrame:
    k, at = F.col("event_id"), F.col("ts").cast("timestamp")
    zone = F.when(k % 3 == 0, "America/Anchorage").when(k % 3 == 1, "Europe/Berlin").otherwise("Australia/Adelaide")
    return x.table("events").select("event_id", times.meeting_time(at, zone).alias("shown"), times.month_year(at, zone).alias("month"), times.input_value(at, zone).alias("input"), times.iso_date(at).alias("day"))


@query("d8_wall_to_instant", None, """
with v as (select event_id, case event_id % 2 when 0 then 'America/Anchorage' else 'Europe/Berlin' end as tz, date_trunc('minute', ts) as u from events),
o as (select *, epoch_us(timezone(tz, timezone('UTC', u))) - epoch_us(u) as o1 from v),
p as (select *, epoch_us(timezone(tz, timezone('UTC', make_timestamp(epoch_us(u) - o1)))) - (epoch_us(u) - o1) as o2 from o)
select event_id, make_timestamp(epoch_us(u) - o2) as instant from p""")  # fmt: skip
def _(x: Frames) -> DataFrame:
    zone = F.when(F.col("event_id") % 2 == 0, "America/Anchorage").otherwise("Europe/Berlin")
    value = F.date_format("ts", "yyyy-MM-dd'T'HH:mm")
    return x.table("events").select("event_id", times.from_input_value(value, zone).cast("timestamp_ntz").alias("instant"))


@query("d9_zone_abbreviation", None, """
with l as (select event_id, date_diff('hour', ts, timezone(case event_id % 2 when 0 then 'America/Anchorage' else 'Europe/Berlin' end, timezone('UTC', ts))) as hours from events)
select event_id, case hours when -9 then 'AKST' when -8 then 'AKDT' when 1 then 'CET' when 2 then 'CEST' end as zone from l""")  # fmt: skip
def _(x: Frames) -> DataFrame:
    zone = F.when(F.col("event_id") % 2 == 0, "America/Anchorage").otherwise("Europe/Berlin")
    return x.table("events").select("event_id", times.zone_abbreviation(F.col("ts").cast("timestamp"), zone).alias("zone"))


@query("d10_clock", None, """
with s as (select o_orderkey, floor(o_totalprice)::bigint as s, o_totalprice / 100 as d from orders)
select o_orderkey, case when s >= 3600 then (s // 3600) || ':' || lpad(((s % 3600) // 60)::varchar, 2, '0') || ':' || lpad((s % 60)::varchar, 2, '0') else (s // 60) || ':' || lpad((s % 60)::varchar, 2, '0') end as clock,
  case when floor(d / 60 + 0.5) = 0 then '<1m' when floor(d / 60 + 0.5) >= 60 then floor(floor(d / 60 + 0.5) / 60)::bigint || 'h ' || (floor(d / 60 + 0.5)::bigint % 60) || 'm' else floor(d / 60 + 0.5)::bigint || 'm' end as minutes,
  case when floor(d + 0.5) >= 3600 then (floor(d + 0.5)::bigint // 3600) || 'h ' || ((floor(d + 0.5)::bigint % 3600) // 60) || 'm ' || (floor(d + 0.5)::bigint % 60) || 's' when floor(d + 0.5) >= 60 then (floor(d + 0.5)::bigint // 60) || 'm ' || (floor(d + 0.5)::bigint % 60) || 's' else floor(d + 0.5)::bigint || 's' end as seconds from s""")  # fmt: skip
def _(x: Frames) -> DataFrame:
    secs = F.col("o_totalprice")
    return x.table("orders").select("o_orderkey", times.clock(secs).alias("clock"), times.secs_duration(secs / 100, "minutes").alias("minutes"), times.secs_duration(secs / 100).alias("seconds"))


@query("d11_interval_secs", None, """
with s as (select o_orderkey, o_orderkey % 5 as k, lpad((o_orderkey % 60)::varchar, 2, '0') as ss from orders)
select o_orderkey, case when k = 0 then null else k * 3600 + 754 - 34 + (o_orderkey % 60) + 0.5 end as secs from s""")  # fmt: skip
def _(x: Frames) -> DataFrame:
    k = F.col("o_orderkey")
    text = F.when(k % 5 == 0, "not an interval").otherwise(F.format_string("%02d:12:%02d.5", k % 5, k % 60))
    return x.table("orders").select("o_orderkey", times.interval_secs(text).alias("secs"))


@query("d14_psv_time", None, """
with c as (select o_orderkey, floor(o_totalprice / 7 * 100 + 0.5)::bigint as cs from orders)
select o_orderkey, (cs // 360000) || ':' || lpad(((cs // 6000) % 60)::varchar, 2, '0') || ':' || lpad(((cs // 100) % 60)::varchar, 2, '0') || '.' || lpad((cs % 100)::varchar, 2, '0') as shown, round(cs / 100.0, 2)::double as parsed from c""")  # fmt: skip
def _(x: Frames) -> DataFrame:
    shown = times.psv_time(F.col("o_totalprice") / 7)
    return x.table("orders").select("o_orderkey", shown.alias("shown"), F.round(times.parse_psv_time(shown), 2).alias("parsed"))


@query("d17_scalar_times", "turns", """
select meeting_id, turn_idx, round((start + "end") / 2, 4) as mid, round(least(1000000, greatest(0, start - 15)), 4) as target, round(least("end", start + 5000) - greatest(start, start + 1000), 4) as shared, (turn_idx - 1 + 7) % 7 as step from turns""")  # fmt: skip
def _(x: Frames) -> DataFrame:
    a, b = F.col("start"), F.col("end")
    return x.turns.select("meeting_id", "turn_idx", F.round(times.midpoint(a, b), 4).alias("mid"), F.round(times.seek_target(a, F.lit(-15.0), F.lit(1000000.0)), 4).alias("target"), F.round(vectors.overlap(a, b, a + 1000, a + 5000), 4).alias("shared"), timeline.cyclic_step(F.col("turn_idx"), F.lit(-1), F.lit(7)).alias("step"))


@query("r7_json_props", None, "select event_id, (props->>'k')::int as k, '{\"k\":' || (props->>'k') || '}' as again from events")
def _(x: Frames) -> DataFrame:
    p = F.from_json("props", "k int", {"mode": "FAILFAST"})
    return x.table("events").select("event_id", p["k"].alias("k"), F.to_json(p).alias("again"))


@query("f13_quantified", "talk", "select meeting_id, seg_idx, len(list_filter(texts, lambda w: regexp_matches(w, '[.?!][\"'')\\]]?$'))) > 0 as ends from talk")
def _(x: Frames) -> DataFrame:
    return x.talk.select("meeting_id", "seg_idx", F.exists("words", lambda w: strings.ends_sentence(w["text"])).alias("ends"))


# --- formats and evaluation -----------------------------------------------------------------


@query("p1_psv_roundtrip", "talk", "select meeting_id::varchar as file, seg_idx, speaker_num, len(texts)::int as n, coalesce(array_to_string(texts, ' '), '') as text, case when len(texts) > 0 then round((len(texts) - 1) * 0.5 + 0.4, 2)::double end as \"end\" from talk")
def _(x: Frames) -> DataFrame:
    rows = x.talk.withColumn("file", F.col("meeting_id").cast("string"))
    again = psv.segments(psv.parse_lines(psv.segment_lines(rows)))
    return again.select("file", "seg_idx", "speaker_num", F.size("words").alias("n"), words_text(F.col("words")).alias("text"), words_end(F.col("words")).alias("end"))


@query("p3_vad_lines", "talk", "select meeting_id::varchar as file, count(*) + sum(len(texts))::bigint + 2 as lines from talk group by 1")
def _(x: Frames) -> DataFrame:
    end = F.coalesce(words_end(F.col("words")), F.lit(0.0))
    runs = x.talk.select(F.col("meeting_id").cast("string").alias("file"), F.col("seg_idx").alias("run_idx"), F.lit(0.0).alias("start"), end.alias("end"), "words")
    return psv.run_lines(runs).groupBy("file").agg(F.count(F.lit(1)).alias("lines"))


#: Cells of the cost matrix of ``pairs`` (a, r, h) along its diagonals: least cost, the kinds of steps that lead there, the step itself, and the same of the cell to the left.
_GRID = """
grid as (select a, 0 as d, 0 as i, 0 as j, 0 as c, 0 as s, 0 as x, 0 as n, '' as op, null::int as lc, null::int as ls, null::int as lx, null::int as ln from pairs
  union all select a, d, i, j, case op when 'ins' then bc + 1 when 'del' then ac + 1 else pc end, case op when 'ins' then bs when 'del' then "as" else ps + (op = 'sub')::int end,
    case op when 'ins' then bx when 'del' then ax + 1 else px end, case op when 'ins' then bn + 1 when 'del' then an else pn end, op, bc, bs, bx, bn
  from (select *, case when pc <= least(coalesce(ac, 1000000), coalesce(bc, 1000000)) + 1 then case when same then 'match' else 'sub' end when ac <= coalesce(bc, 1000000) then 'del' else 'ins' end as op
    from (select g.*, p.r[g.i] = p.h[g.j] as same, lc + (case when p.r[g.i] = p.h[g.j] then 0 else 1 end) as pc from (
      select a, d + 1 as d, i + di as i, j + 1 - di as j, max(c) filter (where di = 1) as ac, max(s) filter (where di = 1) as "as", max(x) filter (where di = 1) as ax, max(n) filter (where di = 1) as an,
        max(lc) filter (where di = 1) as lc, max(ls) filter (where di = 1) as ps, max(lx) filter (where di = 1) as px, max(ln) filter (where di = 1) as pn,
        max(c) filter (where di = 0) as bc, max(s) filter (where di = 0) as bs, max(x) filter (where di = 0) as bx, max(n) filter (where di = 0) as bn
      from grid, (select unnest([0, 1]) as di) group by all) g join pairs p on p.a = g.a and g.i <= len(p.r) and g.j <= len(p.h))))"""


@query("e3_wer", None, """with recursive words as (select item_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\\p{L}\\p{N}\\s'']', ' ', 'g'), '\\s+'), lambda w: w <> '') as w from benchmark),
pairs as (select x.item_id as a, x.w as r, y.w as h from words x join words y on y.item_id = x.item_id + 1),""" + _GRID + """
select a, len(r)::int as n_ref, (len(r) - s - x)::bigint as n_match, s::bigint as n_sub, x::bigint as n_del, n::bigint as n_ins, round(case when len(r) > 0 then c / len(r) when len(h) = 0 then 0 else 1 end, 6) as wer from pairs join grid using (a) where i = len(r) and j = len(h)""")  # fmt: skip
def _(x: Frames) -> DataFrame:
    b = x.table("benchmark")
    pairs = b.select(F.col("item_id").alias("a"), F.col("text").alias("ref")).join(b.select((F.col("item_id") - 1).alias("a"), F.col("text").alias("hyp")), "a")
    return wer.word_error_rate(pairs, "a", F.col("ref"), F.col("hyp")).withColumn("wer", F.round("wer", 6))


@query("e4_compare_transcripts", None, """with recursive texts as (select item_id as a, string_split(text, ' ') as rt, string_split(regexp_replace(text, 'the ', '', 'g'), ' ') as ht from benchmark),
pairs as (select a, list_transform(rt, lambda w: regexp_replace(lower(w), '[^\\p{L}\\p{N}\\s'']', '', 'g')) as r, list_transform(ht, lambda w: regexp_replace(lower(w), '[^\\p{L}\\p{N}\\s'']', '', 'g')) as h from texts),""" + _GRID + """,
path as (select a, i, j, op from pairs join grid using (a) where i = len(r) and j = len(h)
  union all select g.a, g.i, g.j, g.op from path p join grid g on g.a = p.a and g.i = p.i - (p.op <> 'ins')::int and g.j = p.j - (p.op <> 'del')::int where p.op <> ''),
near as (select a, abs((i - 1) * 0.5 - ((j - 1) * 0.5 + 0.1)) as s, abs((i - 1) * 0.5 - (j - 1) * 0.5) as e from path where op = 'match'),
stats as (select a, avg(s) as mean_start_error, max(s) as max_start_error, quantile_disc(s, 0.95) as p95_start_error, avg(e) as mean_end_error, max(e) as max_end_error, quantile_disc(e, 0.95) as p95_end_error from near group by 1),
kinds as (select a, count(*) filter (where op = 'match') as n_match, count(*) filter (where op = 'sub') as n_sub, count(*) filter (where op = 'del') as n_del, count(*) filter (where op = 'ins') as n_ins from path group by 1)
select a as item_id, len(r)::int as n_ref, len(h)::int as n_hyp, n_match, n_sub, n_del, n_ins, """ + ", ".join(f"round({c}::double, 6) as {c}" for c in ("mean_start_error", "max_start_error", "p95_start_error", "mean_end_error", "max_end_error", "p95_end_error")) + """,
  round((n_sub + n_del + n_ins) / len(r), 6) as wer from pairs join kinds using (a) join stats using (a)""")  # fmt: skip
def _(x: Frames) -> DataFrame:
    near = {c: F.round(c, 6) for c in ("mean_start_error", "max_start_error", "p95_start_error", "mean_end_error", "max_end_error", "p95_end_error", "wer")}
    timed = lambda c, shift: F.transform(F.split(c, " "), lambda w, i: F.struct(w.alias("text"), (i * 0.5 + shift).cast("double").alias("start"), (i * 0.5 + 0.4).cast("double").alias("end")))
    pairs = x.table("benchmark").select("item_id", timed("text", 0.0).alias("ref"), timed(F.regexp_replace("text", "the ", ""), 0.1).alias("hyp"))
    return wer.compare_transcripts(pairs, "item_id", "ref", "hyp").withColumns(near)


@query("x1_flatten_tree", None, """
select n_nationkey as source, (row_number() over (partition by n_nationkey order by c_custkey) - 1)::int as i, 'v' || c_custkey as video_id from customer join nation on n_nationkey = c_nationkey where c_custkey % 3 <> 2""")  # fmt: skip
def _(x: Frames) -> DataFrame:
    k = F.col("c_custkey")
    leaf = F.struct(F.when(k % 3 == 0, "url").when(k % 3 == 2, "playlist").alias("_type"), F.concat(F.lit("v"), k).alias("id"), F.lit("t").alias("title"))
    per = x.table("customer").groupBy("c_nationkey").agg(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), leaf.alias("l")))), lambda s: s["l"]).alias("leaves"))
    tab = F.struct(F.lit("playlist").alias("_type"), F.lit("tab").alias("id"), F.col("leaves").alias("entries"))
    documents = per.select(F.col("c_nationkey").alias("source"), F.to_json(F.struct(F.lit("root").alias("id"), F.array(tab, tab).alias("entries"))).alias("doc"))
    return snapshot.flatten_listing(documents, "source", "doc").select("source", "i", "video_id")


@query("src15_id_list", None, "select unnest(['a', 'b', 'c']) as id")
def _(x: Frames) -> DataFrame:
    return snapshot.id_list(x.spark, " a\tb\n  c ")


@query("st_talk_by_window", None, "select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def _(x: Frames) -> DataFrame:
    from parley.streaming.arrivals import talk_by_window

    return talk_by_window(x.table("events").withColumn("ts", F.col("ts").cast("timestamp"))).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


# --- further rows of the inventory ------------------------------------------------------------


@query("prj2_exclude_columns", None, "select doc_id, lang, source from documents")
def _(x: Frames) -> DataFrame:
    return x.table("documents").drop("text", "n_chars")


@query("o5_top_k", None, "select event_id, user_id from events order by event_id desc limit 50")
def _(x: Frames) -> DataFrame:
    return x.table("events").orderBy(F.col("event_id").desc()).limit(relational.SEARCH_LIMIT).select("event_id", "user_id")


@query("o9_longest_turns", "turns", """
select meeting_id, turn_idx, n from (select *, row_number() over (partition by meeting_id order by round("end" - start, 3) desc, turn_idx)::int as n from turns where "end" - start >= 5400) where n <= 3""")  # fmt: skip
def _(x: Frames) -> DataFrame:
    whole = x.turns.withColumns({"end": F.round(F.col("end") - F.col("start"), 3), "start": F.lit(0.0)})
    found = voices.longest_turns(whole, ["meeting_id"], least_secs=5400.0)
    order = W.partitionBy("meeting_id").orderBy(F.col("end").desc(), "turn_idx")
    return found.select("meeting_id", "turn_idx", F.row_number().over(order).alias("n"))


@query("w10_playback_status", "words", """
+ a as (select meeting_id, count(*) filter (where start <= 864000) - 1 as active from words group by 1)
select meeting_id, word_idx, case when word_idx < active then 'past' when word_idx = active then 'active' else 'future' end as status from words join a using (meeting_id)""")  # fmt: skip
def _(x: Frames) -> DataFrame:
    points = x.words.select("meeting_id").distinct().withColumn("at", F.lit(864000.0))
    at = timeline.active_place(points, x.words, "meeting_id", "at", "start", "word_idx")
    return x.words.join(at, "meeting_id").select("meeting_id", "word_idx", timeline.playback_status(F.col("word_idx"), F.col("active")).alias("status"))


@query("d13_timeline_text", None, """
with t as (select o_orderkey, round(o_totalprice / 10, 3) as s from orders)
select o_orderkey, case when s >= 3600 then floor(s / 3600)::int || ':' || lpad(floor((s % 3600) / 60)::int::varchar, 2, '0') || ':' || printf('%06.3f', s % 60) else floor((s % 3600) / 60)::int || ':' || printf('%06.3f', s % 60) end as shown from t""")  # fmt: skip
def _(x: Frames) -> DataFrame:
    return x.table("orders").select("o_orderkey", times.timeline_text(F.round(F.col("o_totalprice") / 10, 3)).alias("shown"))


@query("j22_hits_per_segment", "talk", """
select meeting_id, seg_idx, ((length(s) - length(replace(s, 'th', ''))) // 2)::int as hits from (select *, array_to_string(list_transform(texts, lambda w: lower(w) || ' '), '') as s from talk) where contains(s, 'th')""")  # fmt: skip
def _(x: Frames) -> DataFrame:
    keys = ["meeting_id", "seg_idx"]
    found = talk.hits_per_segment(talk.find_matches(x.talk, " TH ", keys), keys)
    return found.select(*keys, F.size("hits").alias("hits"))


@query("snk10_json_lines", None, """select '{"id":' || n_nationkey || ',"name":"' || n_name || '"}' as value from nation""")
def _(x: Frames) -> DataFrame:
    return sinks.json_lines(x.bodies.select("id", "name"))


@query("snk10_padded_table", None, "select rtrim(rpad(n_nationkey::varchar, 2, ' ') || '  ' || rpad(n_name, (select max(length(n_name)) from nation)::int, ' ')) as value from nation")
def _(x: Frames) -> DataFrame:
    return sinks.padded_table(x.bodies, ["id", "name"])
