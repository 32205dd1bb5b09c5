"""More registered queries: rows of the inventory that the main catalogue leaves out, and folds with a recursive SQL form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions import strings, times, vectors
from parley.operators import relational, talk, timeline, voices, wer
from parley.operators.numbering import new_folder, written
from parley.plans import ingest
from parley.plans.catalogue import BUCKET, query, voice_turns
from parley.plans.frames import Frames
from parley.schema import derive_segments, words_end, words_start, words_text
from parley.sources import psv, seed, sinks, snapshot
from parley.sources.versions import TableSet
from parley.streaming import arrivals


# --- alignment folds --------------------------------------------------------------

#: Speakers of words by overlap, else by the nearest midpoint.
_ASSIGNED = """
met as (select w.meeting_id, word_idx, t.speaker_num, row_number() over (partition by w.meeting_id, word_idx order by least(w."end", t."end") - greatest(w.start, t.start) desc, turn_idx) as n
  from words w join turns t on t.meeting_id = w.meeting_id and w.start < t."end" and w."end" > t.start where least(w."end", t."end") - greatest(w.start, t.start) > 0),
far as (select w.meeting_id, w.word_idx, t.speaker_num, row_number() over (partition by w.meeting_id, w.word_idx order by abs((w.start + w."end") / 2 - (t.start + t."end") / 2), turn_idx) as n
  from words w join turns t on t.meeting_id = w.meeting_id where not exists (select 1 from met h where h.meeting_id = w.meeting_id and h.word_idx = w.word_idx)),
spoken as (select w.meeting_id, w.word_idx, w.text, w.start, w."end", s.speaker_num as spk from words w join (select * from met where n = 1 union all select * from far where n = 1) s on s.meeting_id = w.meeting_id and s.word_idx = w.word_idx),"""
#: The left fold over segments of ``spoken``: f says which output segment (o, speaker p, first word at) each one goes to.
_ABSORBED = """
flag as (select *, case when word_idx > 0 and spk is not distinct from lag(spk) over w then 0 else 1 end as new, (word_idx > 0 and start - lag("end") over w > 0.5)::int as gap from spoken window w as (partition by meeting_id order by word_idx)),
run as (select *, sum(new) over w - 1 as seg, sum(gap) over w as gaps from flag window w as (partition by meeting_id order by word_idx)),
seg as (select meeting_id, seg, min_by(spk, word_idx) as spk, min(word_idx) as a, max(word_idx) as b, max_by("end", word_idx) - min_by(start, word_idx) as span from run group by all),
segs as (select *, lead(spk) over w as after, coalesce(lead(b) over w, b) as last from seg window w as (partition by meeting_id order by seg)),
f as (select meeting_id, seg, spk as p, 0 as o, a as begin, false as skip from segs where seg = 0
  union all select meeting_id, seg, case when held then p else spk end, case when held then o else o + 1 end, case when held then begin else a end, held and not skip from (
    select s.*, f.p, f.o, f.begin, f.skip, f.skip or (s.spk <> f.p and s.after = f.p and s.b - s.a < 5 and s.span <= 2.0 and y.gaps = z.gaps) as held
    from f join segs s on s.meeting_id = f.meeting_id and s.seg = f.seg + 1
    join run y on y.meeting_id = s.meeting_id and y.word_idx = greatest(s.a - 2, f.begin) join run z on z.meeting_id = s.meeting_id and z.word_idx = least(s.b + 2, s.last)) g),
folded as (select r.meeting_id, o as seg_idx, min_by(p, word_idx) as speaker_num, count(*)::int as n, string_agg(text, ' ' order by word_idx) as text from run r join f on f.meeting_id = r.meeting_id and f.seg = r.seg group by r.meeting_id, o)"""


def _shown(segments: DataFrame) -> DataFrame:
    return segments.select("meeting_id", "seg_idx", "speaker_num", F.size("words").alias("n"), words_text(F.col("words")).alias("text"))


@query("t2_absorb_slivers", "words", '+ spoken as (select meeting_id, word_idx, text, word_idx * 0.3::double as start, word_idx * 0.3::double + 0.25 as "end", speaker_num as spk from words),' + _ABSORBED + "\nselect * from folded")
def _(x: Frames) -> DataFrame:
    close = x.words.withColumns({"start": F.col("word_idx") * 0.3, "end": F.col("word_idx") * 0.3 + 0.25})
    return _shown(timeline.absorb_slivers(timeline.speaker_segments(close)))


@query("t1_align_speakers", "words turns", "+" + _ASSIGNED + _ABSORBED + "\nselect * from folded")
def _(x: Frames) -> DataFrame:
    return _shown(timeline.align_speakers(x.words, x.turns, bucket_secs=BUCKET))


@query("a19_words_kept", None, "select user_id as meeting_id, count(*) as before, count(*) as after from events group by 1")
def _(x: Frames) -> DataFrame:
    return timeline.words_kept(x.words, timeline.align_speakers(x.words, x.turns, bucket_secs=BUCKET))


# --- identity ---------------------------------------------------------------------------

#: Centroids of ``turns`` (meeting_id, speaker_num, secs, turn_idx, v), then people for them in order of arrival: the nearest one there is, stored or added before, else a new one.
_RESOLVED = """
long as (select *, row_number() over (partition by meeting_id, speaker_num order by secs desc, turn_idx) as n from turns where secs >= 1.5),
dims as (select meeting_id, speaker_num, unnest(v)::double as c, generate_subscripts(v, 1) as i from long where n <= 3),
mean as (select meeting_id, speaker_num, i, avg(c)::float::double as c from dims group by all),
asked as (select *, row_number() over (order by meeting_id, speaker_num) as q from (select meeting_id, speaker_num, list(c order by i) as v from mean group by all)),
hit as (select q, person_id, d from (select q, vec_id as person_id, 1 - list_cosine_similarity(a.v, e.embedding::double[]) as d, row_number() over (partition by q order by 1 - list_cosine_similarity(a.v, e.embedding::double[]), vec_id) as n from asked a join embeddings e on true) where n = 1 and d < 0.45),
missed as (select *, row_number() over (order by q) as k from asked where q not in (select q from hit)),
grown as (select 0::bigint as k, 0::bigint as q, (select max(vec_id) from embeddings) as person_id, [[0.0::double]] as known, false as new, [0.0::double] as v
  union all select k, q, case when near then person_id else person_id + 1 end, case when near then known else list_append(known, v) end, not near, v from (
    select m.k, m.q, m.v, g.person_id, g.known, coalesce(list_min(list_transform(g.known[2:], lambda u: 1 - list_cosine_similarity(u, m.v))) < 0.45, false) as near from grown g join missed m on m.k = g.k + 1)),
fresh as (select q, person_id, v from grown where new),
close as (select q, person_id, d from hit union all select q, person_id, -1 from fresh
  union all select a.q, f.person_id, 1 - list_cosine_similarity(a.v, f.v) from asked a join fresh f on f.q < a.q where 1 - list_cosine_similarity(a.v, f.v) < 0.45),
resolved as (select meeting_id, speaker_num, min_by(person_id, {'d': d, 'p': person_id}) as person_id from asked a join close using (q) group by all)"""


@query("t13_identity", None, """
with recursive turns as (select vec_id % 5 as meeting_id, (vec_id % 20)::int as speaker_num, 1 + vec_id % 3 as secs, vec_id as turn_idx, embedding as v from embeddings),""" + _RESOLVED + """
select person_id, meeting_id, speaker_num, person_id > (select max(vec_id) from embeddings) as added from resolved""")  # fmt: skip
def _(x: Frames) -> DataFrame:
    people = x.table("embeddings").select(F.col("vec_id").cast("int").alias("id"), F.col("embedding").alias("voice_embedding"))
    resolved, new = voices.resolve_people(voices.speaker_centroids(voice_turns(x)), people)
    return resolved.join(new.select(F.col("id").cast("long").alias("person_id"), F.lit(True).alias("added")), "person_id", "left").withColumn("added", F.coalesce("added", F.lit(False)))


_PLANNED = "select distinct 'v' || user_id as id, case when user_id = 3 then 'skipped' when user_id % 4 = 3 then 'rejected' else 'ingested' end as status, user_id as video from events"


def _videos(x: Frames) -> DataFrame:
    of = F.col("user_id")
    return x.table("events").select(F.concat(F.lit("v"), of).alias("id"), F.concat(F.lit("c"), of % 4).alias("channel_id"), F.lit("t").alias("title"), F.lit("").alias("description"), F.lit(60.0).alias("duration")).distinct()


def _ingested(x: Frames) -> dict[str, DataFrame]:
    return {
        "meetings": x.spark.createDataFrame([(1, 1, "v3")], "id int, body_id int, youtube_id string"),
        "people": x.table("embeddings").select(F.col("vec_id").cast("int").alias("id"), F.lit("p").alias("name"), F.col("embedding").alias("voice_embedding")),
        "segments": x.spark.createDataFrame([(1, 1)], "id int, meeting_id int"),
        "video_sources": x.spark.createDataFrame([(i, i + 1, f"c{i}") for i in range(3)], "id int, body_id int, youtube_id string"),
    }


@query("f7_ingest_plan", None, f"select id, (video % 4 + 1)::int as body_id, status from ({_PLANNED}) where video % 4 < 3 union all select id, null, status from ({_PLANNED}) where video % 4 = 3")
def _(x: Frames) -> DataFrame:
    known = _ingested(x)
    return ingest.plan(_videos(x), known["meetings"], known["video_sources"])


@query("t17_ingest", "words", "+ wturns as (select meeting_id, (word_idx // 3)::int as turn_idx, start, start + 3600 * (1 + word_idx % 4) as \"end\", (word_idx % 4)::int as speaker_num from words where word_idx % 3 = 0)," + _ASSIGNED.replace("join turns", "join wturns") + _ABSORBED + f""",
plan as ({_PLANNED}),
turns as (select 'v' || (vec_id % 5) as meeting_id, (vec_id % 4)::int as speaker_num, 2.0 as secs, vec_id as turn_idx, embedding as v from embeddings where 'v' || (vec_id % 5) in (select id from plan where status = 'ingested')),{_RESOLVED},
counts as (select 'v' || s.meeting_id as id, count(*) as segments, count(distinct person_id) as people from folded s left join resolved r on r.meeting_id = 'v' || s.meeting_id and r.speaker_num = s.speaker_num group by 1)
select plan.id, status, case when status = 'ingested' then segments end as segments, case when status = 'ingested' then people end as people from plan left join counts on counts.id = plan.id""")  # fmt: skip
def _(x: Frames) -> DataFrame:
    of = lambda rows: rows.withColumn("meeting_id", F.concat(F.lit("v"), F.col("meeting_id")))
    k = F.col("vec_id")
    centroids = voices.speaker_centroids(x.table("embeddings").select((k % 5).alias("meeting_id"), (k % 4).cast("int").alias("speaker_num"), k.alias("turn_idx"), F.lit(0.0).alias("start"), F.lit(2.0).alias("end"), "embedding"))
    new, status = ingest.ingest(ingest.Batch(_videos(x), of(x.words.drop("speaker_num")), of(x.turns), of(centroids)), _ingested(x), bucket_secs=BUCKET)
    counts = new["segments"].groupBy("meeting_id").agg(F.count("words").alias("segments"), F.countDistinct("person_id").alias("people")).filter("segments > 0")
    named = new["meetings"].select(F.col("youtube_id").alias("id"), F.col("id").alias("meeting_id"))
    return status.join(named, "id", "left").join(counts, "meeting_id", "left").select("id", "status", "segments", "people")


# --- evaluation ------------------------------------------------------------------------

#: Edit distance in words: each distinct word of a pair is one character (pairs have less than 127 of them).
_DISTANCE = """
codes as (select a, r, h, list_distinct(list_concat(r, h)) as d from pairs),
strs as (select a, len(r)::int as n_ref, len(h)::int as n_hyp, array_to_string(list_transform(r, lambda w: chr(list_position(d, w)::int)), '') as rs, array_to_string(list_transform(h, lambda w: chr(list_position(d, w)::int)), '') as hs from codes)"""


@query("e3_error_rate", None, "with words as (select item_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\\p{L}\\p{N}\\s'']', ' ', 'g'), '\\s+'), lambda w: w <> '') as w from benchmark),\npairs as (select x.item_id as a, x.w as r, y.w as h from words x join words y on y.item_id = x.item_id + 1)," + _DISTANCE + "\nselect a, n_ref, levenshtein(rs, hs) as errors, round(levenshtein(rs, hs) / n_ref, 6) as wer from strs")
def _(x: Frames) -> DataFrame:
    b = x.table("benchmark")
    pairs = b.select(F.col("item_id").alias("a"), F.col("text").alias("ref")).join(b.select((F.col("item_id") - 1).alias("a"), F.col("text").alias("hyp")), "a")
    rate = wer.word_error_rate(pairs, "a", F.col("ref"), F.col("hyp"))
    return rate.select("a", "n_ref", (F.col("n_sub") + F.col("n_del") + F.col("n_ins")).alias("errors"), F.round("wer", 6).alias("wer"))


@query("e4_dropped_words", None, """
with w as (select item_id, string_split(text, ' ') as r from benchmark)
select item_id, len(r)::int as n_ref, (len(r) + 1) // 2 as n_match, len(r) // 2 as n_del, 0::bigint as n_sub, 0::bigint as n_ins, 0.1 as mean_start_error, 0.1 as p95_start_error, 0.0 as max_end_error from w""")  # fmt: skip
def _(x: Frames) -> DataFrame:
    """Each word is told from the others by its place, so that only one alignment is best; every second one is missing."""
    words = F.transform(F.split("text", " "), lambda w, i: F.struct(F.concat(w, i.cast("string")).alias("text"), (i * 0.5).cast("double").alias("start"), (i * 0.5 + 0.4).cast("double").alias("end")))
    kept = F.transform(F.filter("ref", lambda w, i: i % 2 == 0), lambda w: F.struct(w["text"].alias("text"), (w["start"] + 0.1).alias("start"), w["end"].alias("end")))
    pairs = x.table("benchmark").select("item_id", words.alias("ref")).withColumn("hyp", kept)
    found = wer.compare_transcripts(pairs, "item_id", "ref", "hyp")
    near = lambda c: F.round(c, 6).alias(c)
    return found.select("item_id", "n_ref", "n_match", "n_del", "n_sub", "n_ins", near("mean_start_error"), near("p95_start_error"), near("max_end_error"))


@query("e5_over_limits", None, "select o_orderkey from orders where o_orderkey % 100 > 20 or o_orderkey % 7 > 5 or o_orderkey % 11 > 5")
def _(x: Frames) -> DataFrame:
    k = F.col("o_orderkey")
    metrics = x.table("orders").select("o_orderkey", (k % 100 / 100).alias("wer"), (k % 7 / 10).alias("p95_start_error"), (k % 11 / 10).alias("p95_end_error"))
    return wer.over_limits(metrics, wer=0.2, p95=0.5).select("o_orderkey")


# --- relational ------------------------------------------------------------------------


@query("f8_find_one", "bodies", "select * from bodies where id = 7")
def _(x: Frames) -> DataFrame:
    return relational.find_one(x.bodies, 7)


@query("f12_short_query", "talk", """
+ t as (select meeting_id, seg_idx, array_to_string(list_transform(texts, lambda w: lower(w) || ' '), '') as s from talk),
q as (select unnest([' h ', ' HE ', ' e']) as query)
select query, count(*) filter (where length(trim(query)) >= 2 and contains(s, lower(trim(query)))) as segments from q, t group by 1""")  # fmt: skip
def _(x: Frames) -> DataFrame:
    """One letter finds nothing; two letters find all segments that have them."""
    out = None
    for q in (" h ", " HE ", " e"):
        keys = ["meeting_id", "seg_idx"]
        part = talk.find_matches(x.talk, q, keys).select(*keys).distinct().agg(F.lit(q).alias("query"), F.count(F.lit(1)).alias("segments"))
        out = part if out is None else out.unionByName(part)
    return out


@query("o11_segments_in_order", "meetings", """
select id, string_agg(l_linenumber::varchar, ',' order by case when l_linenumber % 3 = 0 then 0 else l_quantity end, l_linenumber) as segments from meetings join lineitem on l_orderkey = id group by 1""")  # fmt: skip
def _(x: Frames) -> DataFrame:
    start = F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity"))
    rows = x.table("lineitem").select(F.col("l_orderkey").alias("meeting_id"), F.col("l_linenumber").alias("id"), start.alias("start_secs"), F.lit("").alias("text"))
    grouped = relational.group_by_meeting(rows, x.meetings)
    return grouped.select("id", F.array_join(F.transform("segments", lambda s: s["id"].cast("string")), ",").alias("segments"))


@query("o12_known_slugs", "bodies", "select 'unknown body ''atlantis''; known: ' || string_agg(lower(name_short), ', ' order by lower(name_short)) as message from bodies")
def _(x: Frames) -> DataFrame:
    try:
        relational.resolve_slug(x.bodies, "atlantis")
    except ValueError as unknown:
        return x.spark.createDataFrame([(str(unknown),)], "message string")
    raise AssertionError("the slug is unknown")


@query("w11_cyclic_step", None, "select event_id, ((user_id % 7 + event_id % 5 - 2) % 7 + 7) % 7 as place from events")
def _(x: Frames) -> DataFrame:
    return x.table("events").select("event_id", timeline.cyclic_step(F.col("user_id") % 7, F.col("event_id") % 5 - 2, F.lit(7)).alias("place"))


@query("w6_gaps_within", "talk", "select meeting_id, seg_idx, len(texts) <= 26 as close from talk")
def _(x: Frames) -> DataFrame:
    """The i-th word starts at i * i hundredths and takes no time, so pauses grow."""
    at = lambda i: (i * i / 100).cast("double")
    words = F.transform("words", lambda w, i: F.struct(w["text"].alias("text"), at(i).alias("start"), at(i).alias("end")))
    return x.talk.select("meeting_id", "seg_idx", timeline.gaps_within(words, 0.5).alias("close"))


# --- strings, times, vectors -------------------------------------------------------------


@query("s17_work_folder", "bodies meetings", "select m.id, lower(name_short) || '_' || youtube_id as folder from meetings m join bodies b on b.id = body_id")
def _(x: Frames) -> DataFrame:
    slugs = x.bodies.select(F.col("id").alias("body_id"), strings.slug(F.col("name_short")).alias("slug"))
    return x.meetings.join(slugs, "body_id").select("id", strings.work_folder(F.col("slug"), F.col("youtube_id")).alias("folder"))


@query("s19_plural", None, "select l_orderkey, count(*) || case count(*) when 1 then ' segment' else ' segments' end as shown from lineitem group by 1")
def _(x: Frames) -> DataFrame:
    n = F.col("n")
    return x.table("lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n")).select("l_orderkey", F.concat_ws(" ", n.cast("string"), strings.plural(n, "segment")).alias("shown"))


@query("d1_interval", None, "select o_orderkey, case when o_orderkey % 5 <> 0 then timestamp '2024-01-01' + to_microseconds((o_orderkey * 1000 + o_orderkey % 1000) * 1000) end as at from orders")
def _(x: Frames) -> DataFrame:
    k = F.col("o_orderkey")
    secs = F.when(k % 5 != 0, k + k % 1000 / 1000 + 0.0001)
    return x.table("orders").select("o_orderkey", (F.lit("2024-01-01").cast("timestamp_ntz") + times.interval_of(secs)).alias("at"))


@query("c4_derived_columns", "talk", """
select meeting_id, seg_idx, array_to_string(texts[2:], ' ') as text, case when len(texts) > 1 then 0.5 end::double as start_secs, case when len(texts) > 1 then (len(texts) - 1) * 0.5 + 0.4 end::double as end_secs, case when len(texts) > 1 then (len(texts) - 2) * 0.5 + 0.4 end::double as duration_secs from talk""")  # fmt: skip
def _(x: Frames) -> DataFrame:
    """Derived once, then again after the first word is edited away: the columns follow."""
    first = derive_segments(x.talk)
    edited = derive_segments(first.withColumn("words", F.slice("words", 2, F.greatest(F.size("words"), F.lit(1)))))
    return edited.select("meeting_id", "seg_idx", "text", *[F.col(c).cast("double").alias(c) for c in ("start_secs", "end_secs", "duration_secs")])


@query("d4_naive_to_instant", None, "select event_id, ts as instant from events")
def _(x: Frames) -> DataFrame:
    return x.table("events").select("event_id", times.naive_to_instant(F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("instant"))


@query("d15_iso_date", None, "select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day from orders")
def _(x: Frames) -> DataFrame:
    return x.table("orders").select("o_orderkey", times.iso_date(F.col("o_orderdate").cast("timestamp")).alias("day"))


@query("d16_segment_secs", "talk", "select meeting_id, seg_idx, case when seg_idx % 2 = 0 then 3725.5 when len(texts) = 0 then 0 else (len(texts) - 1) * 0.5 + 0.4 end::double as secs from talk")
def _(x: Frames) -> DataFrame:
    text = F.when(F.col("seg_idx") % 2 == 0, "01:02:05.5")
    return x.talk.select("meeting_id", "seg_idx", F.round(times.segment_secs(text, F.col("words")), 6).alias("secs"))


@query("a11_weighted_mean", None, """
select vec_id, i as pos, round(((a * 2 + b * 3) / 5)::float::double, 5) as x from (select vec_id, unnest(embedding)::double as a, unnest(list_reverse(embedding))::double as b, generate_subscripts(embedding, 1) - 1 as i from embeddings)""")  # fmt: skip
def _(x: Frames) -> DataFrame:
    mean = vectors.weighted_mean(F.col("embedding"), F.lit(2.0), F.reverse("embedding"), F.lit(3.0))
    return x.table("embeddings").select("vec_id", F.posexplode(mean).alias("pos", "v")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.round(F.col("v").cast("double"), 5).alias("x"))


@query("m4_tail_clip", "turns", 'select meeting_id, turn_idx, floor(greatest(start, "end" - 8) * 16000)::bigint as "from", floor("end" * 16000)::bigint as "to" from turns')
def _(x: Frames) -> DataFrame:
    return x.turns.select("meeting_id", "turn_idx", vectors.tail_clip(F.col("start"), F.col("end")).alias("c")).select("meeting_id", "turn_idx", F.col("c.from").alias("from"), F.col("c.to").alias("to"))


@query("m5_slice_wave", None, """
with w as (select vec_id, embedding, (vec_id % 30)::int + 1 as a, least(vec_id % 30 + 41, len(embedding))::int as b from embeddings)
select vec_id, b - a + 1 as n, embedding[a]::double as first, embedding[b]::double as last from w""")  # fmt: skip
def _(x: Frames) -> DataFrame:
    start = (F.col("vec_id") % 30) / 8
    wave = vectors.slice_wave(F.col("embedding"), F.lit(8.0), start, start + 41 / 8)
    return x.table("embeddings").select("vec_id", wave.alias("w")).select("vec_id", F.size("w").cast("long").alias("n"), F.element_at("w", 1).cast("double").alias("first"), F.element_at("w", -1).cast("double").alias("last"))


@query("m7_sample_secs", None, "select event_id, event_id / 16000 as secs, 16000 as rate from events")
def _(x: Frames) -> DataFrame:
    return x.table("events").select("event_id", vectors.sample_secs(F.col("event_id")).alias("secs"), vectors.checked_rate(F.lit(16000)).alias("rate"))


@query("r9_one_hot", None, "select vec_id, unnest(range(8)) as pos, (unnest(range(8)) = vec_id % 8)::int::double as x from embeddings")
def _(x: Frames) -> DataFrame:
    hot = vectors.one_hot(8, F.col("vec_id") % 8)
    return x.table("embeddings").select("vec_id", F.posexplode(hot).alias("pos", "x")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.col("x").cast("double").alias("x"))


# --- sources and sinks --------------------------------------------------------------------


@query("src3_targets", None, """
select lower(replace(r_name, ' ', '-')) as target, 'file:/' || r_regionkey as url from region
union all select 'jdbc:x://h/' || n_nationkey, 'jdbc:x://h/' || n_nationkey from nation union all select '', 'file:/0' from region where r_regionkey = 0""")  # fmt: skip
def _(x: Frames) -> DataFrame:
    """Targets named by the regions, one of them the local one; URLs by the nations."""
    places = [tuple(r) for r in x.table("region").select("r_name", "r_regionkey").collect()]  # a dimension of names
    known = {f"DATABASE_URL_{n.replace(' ', '_')}": f"file:/{k}" for n, k in places} | {"DATABASE_URL_LOCAL": "file:/0"}
    asked = [n.lower().replace(" ", "-") for n, _ in places] + [f"jdbc:x://h/{r.n_nationkey}" for r in x.table("nation").select("n_nationkey").collect()] + [""]
    return x.spark.createDataFrame([(n, snapshot.resolve_target(n or None, known)) for n in asked], "target string, url string")


@query("src4_redact_url", None, "select c_custkey, case when c_custkey % 3 = 0 then c_name else 'db://u' || c_custkey || ':***@h/d' end as url from customer")
def _(x: Frames) -> DataFrame:
    k = F.col("c_custkey")
    url = F.when(k % 3 == 0, F.col("c_name")).otherwise(F.concat(F.lit("db://u"), k, F.lit(":pass"), k, F.lit("@h/d")))
    return x.table("customer").select("c_custkey", strings.redact_url(url).alias("url"))


@query("src5_json_lines", None, "select o_orderkey as id, o_orderpriority as name from orders")
def _(x: Frames) -> DataFrame:
    folder = new_folder(x.spark)
    rows = x.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"))
    sinks.json_lines(rows).unionByName(x.table("region").select(F.lit("").alias("value"))).write.text(folder)  # with blank lines
    return snapshot.jsonl(x.spark, folder, "id long, name string")


def _text_files(rows: DataFrame, folder: str, of: Callable[[str], str]) -> None:
    """One small text file for each (name, text) of a dimension table."""
    for row in rows.collect():
        sinks.write_text(rows.sparkSession, f"{folder}/{of(row[0])}", row[1])


@query("src7_snapshot_load", None, """
select 'meetings' as kind, 'm' || r_regionkey as slug, r_name as name from region union all select 'people', 'p' || n_nationkey, n_name from nation
union all select 'bodies', 'b' || n_nationkey, n_name from nation union all select 'jurisdictions', 'j' || r_regionkey, r_name from region""")  # fmt: skip
def _(x: Frames) -> DataFrame:
    """Written as a snapshot folder (JSON lines and one document a meeting folder), then loaded."""
    folder = new_folder(x.spark)
    places = x.table("region").select(F.concat(F.lit("j"), F.col("r_regionkey")).alias("id"), F.col("r_name").alias("name"))
    bodies = x.table("nation").select(F.concat(F.lit("b"), F.col("n_nationkey")).alias("id"), F.col("n_name").alias("name"))
    people = x.table("nation").select(F.concat(F.lit("p"), F.col("n_nationkey")).alias("slug"), F.col("n_name").alias("name"))
    for name, rows in (("jurisdictions", places), ("bodies", bodies), ("people", people)):
        sinks.json_lines(rows).write.text(f"{folder}/{name}.jsonl")
    documents = x.table("region").select(F.concat(F.lit("m"), F.col("r_regionkey")), F.concat(F.lit('{\n "title": "'), "r_name", F.lit('"\n}')))
    _text_files(documents, folder, lambda slug: f"meetings/{slug}/meeting.json")
    found = snapshot.load(x.spark, folder)
    parts = [found[k].select(F.lit(k).alias("kind"), F.col(key).alias("slug"), F.col(name).alias("name")) for k, key, name in (("meetings", "slug", "title"), ("people", "slug", "name"), ("bodies", "id", "name"), ("jurisdictions", "id", "name"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("src11_video_metadata", None, """
select 'v' || o_orderkey as id, case when o_orderkey % 2 = 0 then o_orderpriority else '' end as title, '' as channel_id, '' as description, case when o_orderkey % 2 = 0 then o_orderkey * 0.5 end::double as duration from orders""")  # fmt: skip
def _(x: Frames) -> DataFrame:
    k = F.col("o_orderkey")
    even = lambda c: F.when(k % 2 == 0, c)
    doc = F.to_json(F.struct(F.concat(F.lit("v"), k).alias("id"), even(F.col("o_orderpriority")).alias("title"), even(k * 0.5).alias("duration")))
    return snapshot.video_metadata(x.table("orders").select(doc.alias("doc")), "doc")


@query("prj6_snapshot_rows", None, """
with b as (select n_name, n_nationkey, row_number() over (order by n_name) as body_id from nation),
s as (select body_id, k, n_nationkey from b, unnest(['channel', 'playlist']) as t(k))
select row_number() over (order by body_id, k)::int as id, body_id::int as body_id, k as kind, 'y' || n_nationkey as youtube_id, 'https://www.youtube.com/' || case k when 'channel' then 'channel/' else 'playlist?list=' end || 'y' || n_nationkey as url from s""")  # fmt: skip
def _(x: Frames) -> DataFrame:
    source = lambda kind: F.struct(F.lit(kind).alias("kind"), F.concat(F.lit("y"), F.col("n_nationkey")).alias("youtube_id"))
    places = x.table("region").select(F.col("r_name").alias("id"), F.col("r_name").alias("name"), F.col("r_name").alias("name_short"), F.lit("").alias("state"), "r_regionkey")
    bodies = x.table("nation").join(places.select(F.col("r_regionkey").alias("n_regionkey"), F.col("id").alias("jurisdiction_id")), "n_regionkey")
    bodies = bodies.select(F.col("n_name").alias("id"), "jurisdiction_id", F.col("n_name").alias("name"), F.col("n_name").alias("name_short"), F.lit("UTC").alias("timezone"), F.array(source("channel"), source("playlist")).alias("video_sources"))
    return snapshot.to_rows({"jurisdictions": places.drop("r_regionkey"), "bodies": bodies})["video_sources"].select("id", "body_id", "kind", "youtube_id", "url")


@query("snk5_replace_tables", None, "select 'orders' as name, o_orderkey as key, o_totalprice::double as value, o_orderstatus as text from orders union all select 'nation', n_nationkey, n_regionkey::double, n_name from nation")
def _(x: Frames) -> DataFrame:
    """Seeded with other rows and one more table first: nothing of them stays."""
    folder, tables = new_folder(x.spark), {"orders": x.table("orders"), "nation": x.table("nation")}
    sinks.replace_tables({n: rows.unionByName(rows) for n, rows in tables.items()} | {"region": x.table("region")}, folder)
    sinks.replace_tables(tables, folder)
    again = TableSet(x.spark, folder).read()
    assert set(again) == set(tables)
    orders = again["orders"].select(F.lit("orders").alias("name"), F.col("o_orderkey").alias("key"), F.col("o_totalprice").cast("double").alias("value"), F.col("o_orderstatus").alias("text"))
    return orders.unionByName(again["nation"].select(F.lit("nation").alias("name"), F.col("n_nationkey").alias("key"), F.col("n_regionkey").cast("double").alias("value"), F.col("n_name").alias("text")))


@query("snk5_versions", None, """
select 1 as version, 'orders' as name, count(*) as n, sum(o_orderkey)::bigint as total from orders
union all select 1, 'nation', count(*), sum(n_nationkey)::bigint from nation
union all select 2, 'orders', count(*), sum(o_orderkey)::bigint from orders where o_orderkey % 3 = 0
union all select 2, 'nation', count(*), sum(n_nationkey)::bigint from nation""")  # fmt: skip
def _(x: Frames) -> DataFrame:
    """A commit of one table leaves the others; the version before can still be read."""
    store = TableSet(x.spark, new_folder(x.spark))
    store.commit({"orders": x.table("orders"), "nation": x.table("nation")})
    store.commit({"orders": store.read()["orders"].filter("o_orderkey % 3 = 0")})
    out = None
    for version in (1, 2):
        for name, key in (("orders", "o_orderkey"), ("nation", "n_nationkey")):
            part = store.read([name], version=version)[name].agg(F.lit(version).alias("version"), F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), F.sum(key).alias("total"))
            out = part if out is None else out.unionByName(part)
    return out


@query("snk4_reseed", None, """
with b as (select row_number() over (order by n_name) as id, n_name, r_name from nation join region on r_regionkey = n_regionkey),
p as (select row_number() over (order by r_name) as id, r_name from region)
select 'jurisdictions' as name, id::int as id, r_name as text, null::int as parent from p
union all select 'bodies', b.id::int, n_name, p.id::int from b join p using (r_name)
union all select 'people', s_suppkey::int, s_name, null from supplier""")  # fmt: skip
def _(x: Frames) -> DataFrame:
    """Seeded twice: meetings and segments, which depend on the bodies, are cleared, people are not, and ids start at 1 each time."""
    r = x.table("region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    n = x.table("nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("jurisdiction_id"), F.col("n_name").alias("name"))
    p = x.table("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    tables = {"jurisdictions": r, "bodies": n, "people": p, "meetings": x.meetings.select("id", "body_id"), "segments": x.segments.select("id", "meeting_id", "person_id")}
    store = TableSet(x.spark, new_folder(x.spark))
    store.commit(tables)
    seeds = {"bodies": n.join(r.select(F.col("id").alias("jurisdiction_id"), F.col("name").alias("_r")), "jurisdiction_id").select(F.col("name").alias("key"), F.col("_r").alias("jurisdiction_id"), "name"), "jurisdictions": r.select(F.col("name").alias("key"), "name")}
    for _ in range(2):
        seed.reseed(store, seeds)
    now = store.read()
    shown = lambda t, parent=None: now[t].select(F.lit(t).alias("name"), F.col("id").cast("int").alias("id"), F.col("name" if t in ("jurisdictions", "bodies", "people") else "id").cast("string").alias("text"), (F.col(parent) if parent else F.lit(None)).cast("int").alias("parent"))
    return shown("jurisdictions").unionByName(shown("bodies", "jurisdiction_id")).unionByName(shown("people")).unionByName(shown("meetings", "body_id")).unionByName(shown("segments", "meeting_id"))


@query("snk9_memo", None, "select n_nationkey, n_name from nation")
def _(x: Frames) -> DataFrame:
    folder = new_folder(x.spark)
    sinks.memo(x.spark, folder, lambda: x.table("nation").select("n_nationkey", "n_name"))
    return sinks.memo(x.spark, folder, lambda: x.table("nation").limit(0))  # not made again


def _hundredths(cs: str) -> str:
    return f"({cs} // 360000) || ':' || lpad((({cs} // 6000) % 60)::varchar, 2, '0') || ':' || lpad((({cs} // 100) % 60)::varchar, 2, '0') || '.' || lpad(({cs} % 100)::varchar, 2, '0')"


@query("p3_vad_text", "talk", f"""
+ t as (select meeting_id::varchar as file, seg_idx, texts, case when len(texts) > 0 then len(texts) * 50 - 10 else 0 end as cs, row_number() over (partition by meeting_id order by seg_idx) as k from talk),
l as (select file, seg_idx, texts, list_concat(case when k = 1 then ['0:00:00.00||meta|{{"begin_speaker":"unlabeled"}}'] else [] end,
  ['0:00:00.00|' || {_hundredths("cs")} || '|vad|{{"index":' || seg_idx || ',"dur":' || (cs // 100) || case when cs = 0 then '' else '.' || (cs % 100 // 10) end || '}}'],
  list_transform(texts, lambda w, i: {_hundredths("(i * 50 - 50)")} || '|' || {_hundredths("(i * 50 - 10)")} || '|text|' || w)) as lines from t),
e as (select file, seg_idx, unnest(lines) as line, generate_subscripts(lines, 1) as i from l)
select file, (1 + row_number() over (partition by file order by seg_idx, i))::int as line_no, line from e union all select distinct file, 1, '{psv.HEADER}' from t""")  # fmt: skip
def _(x: Frames) -> DataFrame:
    end = F.coalesce(F.try_element_at("words", F.lit(-1))["end"], F.lit(0.0))
    runs = x.talk.select(F.col("meeting_id").cast("string").alias("file"), F.col("seg_idx").alias("run_idx"), F.lit(0.0).alias("start"), end.alias("end"), "words")
    return psv.run_lines(runs)


# --- files ---------------------------------------------------------------------------------


@query("src13_wav", None, """
with x as (select vec_id, unnest(embedding)::double as v from embeddings)
select vec_id, 16000 as sample_rate, count(*) as n, sum(greatest(-32768, least(32767, round_even(v * 32768, 0))))::bigint as total from x group by 1""")  # fmt: skip
def _(x: Frames) -> DataFrame:
    """Vectors are written as one WAV file each, and read back."""
    folder = new_folder(x.spark)
    waves = x.table("embeddings").select(F.concat(F.lit("v"), F.col("vec_id") % 10, F.lit("/"), F.col("vec_id"), F.lit(".wav")).alias("path"), F.col("embedding").alias("samples"))
    written(sinks.write_files(snapshot.encode_wav(waves), folder))
    read = snapshot.decode_wav(snapshot.audio_files(x.spark, folder))
    total = F.aggregate("samples", F.lit(0).cast("long"), lambda a, v: a + F.round(v * 32768).cast("long"))
    return read.select(F.regexp_extract("path", "/(\\d+)\\.wav$", 1).cast("long").alias("vec_id"), "sample_rate", F.size("samples").cast("long").alias("n"), total.alias("total"))


@query("src14_checked_files", None, """
select 'p/' || page_id || '.html' as path, case when page_id = (select min(page_id) from pages) then 'differs' when page_id = (select max(page_id) from pages) then 'unknown' else 'ok' end as status from pages
union all select 'p/none.html', 'missing'""")  # fmt: skip
def _(x: Frames) -> DataFrame:
    """Pages are written as files; the first is damaged afterwards, the last is not in the manifest, which names one more."""
    folder, name = new_folder(x.spark), F.concat(F.lit("p/"), F.col("page_id"), F.lit(".html")).alias("path")
    pages = x.table("pages")
    ends = pages.agg(F.min("page_id").alias("a"), F.max("page_id").alias("b")).first()
    manifest = written(sinks.write_files(pages.select(name, F.concat(F.coalesce("html", F.lit("")), F.lit("\n")).cast("binary").alias("content")), folder))
    written(sinks.write_files(pages.filter(F.col("page_id") == ends.a).select(name, F.lit(b"damaged").alias("content")), folder))
    held = manifest.filter(F.col("path") != f"p/{ends.b}.html").select("path", "sha256").unionByName(x.spark.createDataFrame([("p/none.html", "0")], "path string, sha256 string"))
    return snapshot.check_files(snapshot.audio_files(x.spark, folder), held, folder)


@query("t8_transcribe", "talk", """
+ runs as (select meeting_id, seg_idx as run_idx, row_number() over (partition by meeting_id order by seg_idx) as k, seg_idx * 40.0::double as start, seg_idx * 40.0::double + 1 + len(texts) % 30 as "end" from talk),
fold as (select meeting_id, run_idx, k, start, "end", 0 as window_idx, start as begin from runs where k = 1
  union all select n.meeting_id, n.run_idx, n.k, n.start, n."end", case when n."end" - f.begin > 120 then f.window_idx + 1 else f.window_idx end, case when n."end" - f.begin > 120 then n.start else f.begin end
  from fold f join runs n on n.meeting_id = f.meeting_id and n.k = f.k + 1),
windows as (select meeting_id, window_idx, min(start) as start, max("end") as "end" from fold group by all),
words as (select meeting_id, window_idx, start + i as t0, 'w' || i as text from (select *, unnest(range(0, floor("end" - start)::bigint + 1)) as i from windows)),
placed as (select w.meeting_id, r.run_idx, w.t0, w.text from words w asof join runs r on r.meeting_id = w.meeting_id and r.start <= w.t0)
select r.meeting_id, r.run_idx, count(t0) as n, coalesce(string_agg(text, ' ' order by t0), '') as text, round(min(t0), 3) as first, round(max(t0) + 0.32, 3) as last from runs r left join placed p using (meeting_id, run_idx) group by all""")  # fmt: skip
def _(x: Frames) -> DataFrame:
    """The recogniser says one word each second of a window."""

    def decode(batches):
        for batch in batches:
            batch = batch.assign(i=[range(int(b - a) + 1) for a, b in zip(batch["start"], batch["end"], strict=True)]).explode("i")
            yield batch.assign(token=" w" + batch["i"].astype(str), ts=batch["i"].astype(float), i=batch["i"].astype("int32"))[["meeting_id", "window_idx", "i", "token", "ts"]]

    begin = F.col("seg_idx") * F.lit(40.0)
    runs = x.talk.select("meeting_id", F.col("seg_idx").alias("run_idx"), begin.alias("start"), (begin + 1 + F.size("words") % 30).alias("end"))
    found = timeline.transcribe_runs(runs, decode)
    w = F.col("words")
    return found.select("meeting_id", "run_idx", F.size(w).cast("long").alias("n"), words_text(w).alias("text"), F.round(words_start(w), 3).alias("first"), F.round(words_end(w), 3).alias("last"))


@query("st3_arrivals", None, "select event_id, event_type, value * 2 as doubled, k::int as k from events, (select unnest([1, 2]) as k) where value >= 20")
def _(x: Frames) -> DataFrame:
    """Events arrive as files in two lots, with repeated rows; the second lot's batch breaks off once, with a part of its rows written."""
    folder, schema = new_folder(x.spark), "event_id long, event_type string, value double"
    events = x.table("events").select("event_id", "event_type", "value")

    def handle(rows: DataFrame) -> DataFrame:
        return rows.filter("value >= 20").select("event_id", "event_type", (F.col("value") * 2).alias("doubled"), F.explode(F.array(F.lit(1), F.lit(2))).alias("k"))

    def broken(rows: DataFrame) -> DataFrame:
        handle(rows).filter("k = 1").write.mode("overwrite").parquet(f"{folder}/out/results/batch=1")
        raise RuntimeError("broken off")

    def run(how) -> None:
        arrivals.ingest_arrivals(x.spark, f"{folder}/in", schema, "event_id", f"{folder}/out", f"{folder}/checkpoint", how).awaitTermination()

    lots = F.pmod(F.xxhash64("event_id"), F.lit(2))
    events.filter(lots == 0).write.mode("append").json(f"{folder}/in")
    run(handle)
    events.filter((lots == 1) | (F.col("event_type") == "click")).write.mode("append").json(f"{folder}/in")
    try:
        run(broken)
    except StreamingQueryException:
        run(handle)
    return arrivals.arrived(x.spark, f"{folder}/out")
