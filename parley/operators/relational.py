"""Relational reads and functional updates over the meeting tables.

Sort orders follow the reference database: nulls last ascending, first
descending. Updates return new tables. Small dimensions are left to the optimiser to
broadcast by their measured size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from parley.functions import strings, times
from parley.operators.numbering import dense_number, greatest

SEARCH_LIMIT, PERSON_SEGMENTS = 50, 100


def asc(name: str) -> Column:
    return F.col(name).asc_nulls_last()


def desc(name: str) -> Column:
    return F.col(name).desc_nulls_first()


def attendance(segments: DataFrame, meetings: DataFrame, bodies: DataFrame) -> DataFrame:
    """person_id, body, timezone, meetings (distinct), first, last; unidentified segments do not count."""
    seen = segments.filter(F.col("person_id").isNotNull()).select("person_id", "meeting_id").distinct()
    # distinct before the joins: the rest works on a row for each person and meeting
    met = seen.join(meetings.select(F.col("id").alias("meeting_id"), "body_id", "start_time"), "meeting_id")
    named = met.groupBy("person_id", "body_id").agg(F.count(F.lit(1)).alias("meetings"), F.min("start_time").alias("first"), F.max("start_time").alias("last"))
    return named.join(bodies.select(F.col("id").alias("body_id"), F.col("name_short").alias("body"), "timezone"), "body_id")


def with_attendance(people: DataFrame, attended: DataFrame) -> DataFrame:
    """People with their attendance, most attended body first (then by name); an empty list if there is none."""
    entry = F.struct((-F.col("meetings")).alias("o"), F.col("body"), F.col("timezone"), F.col("meetings"), F.col("first"), F.col("last"))
    lists = attended.groupBy(F.col("person_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: F.struct(x["body"].alias("body"), x["timezone"].alias("timezone"), x["meetings"].alias("meetings"), x["first"].alias("first"), x["last"].alias("last"))).alias("attendance"))
    kind = lists.schema["attendance"].dataType
    return people.drop("voice_embedding").join(lists, "id", "left").withColumn("attendance", F.coalesce("attendance", F.array().cast(kind)))


def attendance_text(attended: Column) -> Column:
    """All bodies of an attendance list in one line."""
    month = lambda x, c: times.month_year(x[c], x["timezone"])
    return F.array_join(F.transform(attended, lambda x: strings.attendance_label(x["meetings"], x["body"], month(x, "first"), month(x, "last"))), " · ")


def list_ingested(meetings: DataFrame, bodies: DataFrame, segments: DataFrame, ids: list[int] | None = None) -> DataFrame:
    """Meetings with body slug and segment count (0 if none), newest first, unknown dates before all."""
    counts = segments.groupBy(F.col("meeting_id").alias("id")).agg(F.count("id").alias("segments"))
    given = meetings.filter(F.col("id").isin(ids)) if ids else meetings
    joined = given.join(bodies.select(F.col("id").alias("body_id"), "name_short"), "body_id").join(counts, "id", "left")
    return joined.select("id", "youtube_id", "title", "start_time", strings.slug(F.col("name_short")).alias("body"), F.coalesce("segments", F.lit(0)).alias("segments")).orderBy(desc("start_time"), desc("id"))


def search_segments(segments: DataFrame, meetings: DataFrame, people: DataFrame, query: str, *, limit: int = SEARCH_LIMIT, escape: bool = False) -> DataFrame:
    """The newest segments whose text contains the query, with meeting and person (null if unidentified)."""
    if not query:
        return search_segments(segments, meetings, people, " ", limit=limit).limit(0)
    hits = segments.filter(strings.contains_text(F.col("text"), query, escape=escape)).orderBy(F.col("id").desc()).limit(limit)
    return to_one(to_one(hits, meetings, "meeting_id", "meeting", required=True), people.select("id", "name"), "person_id", "person").orderBy(F.col("id").desc())


def to_one(child: DataFrame, parent: DataFrame, key: str, name: str, *, required: bool = False) -> DataFrame:
    """The parent row as a struct; a miss drops the row if required, else the struct is null."""
    held = parent.select(F.col("id").alias(key), F.struct(*parent.columns).alias(name))
    return child.join(held, key, "inner" if required else "left")


def to_many(parent: DataFrame, child: DataFrame, key: str, name: str, order: list[Column], *, limit: int | None = None) -> DataFrame:
    """Child rows as an ordered array of structs, at most ``limit`` for each parent; empty if there are none."""
    place = F.row_number().over(W.partitionBy(key).orderBy(*order))
    ranked = child.withColumn("_n", place)
    if limit is not None:
        ranked = ranked.filter(F.col("_n") <= limit)
    lists = ranked.groupBy(F.col(key).alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.struct(*child.columns).alias("c")))), lambda x: x["c"]).alias(name))
    return parent.join(lists, "id", "left").withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))


def not_in(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in the other table; duplicates and order columns stay."""
    return rows.join(other.select(key), key, "left_anti")


def available(bodies: DataFrame, sources: DataFrame, listing: DataFrame, meetings: DataFrame, slug: str | None = None) -> DataFrame:
    """Listed videos (source_id, i, video_id) that are not ingested: body, source_id, i, video_id in listing order."""
    chosen = bodies if slug is None else resolve_slug(bodies, slug)
    of = sources.select(F.col("id").alias("source_id"), "body_id").join(chosen.select(F.col("id").alias("body_id"), strings.slug(F.col("name_short")).alias("body")), "body_id")
    return not_in(listing.join(of, "source_id"), meetings.select(F.col("youtube_id").alias("video_id")), "video_id").select("body", "source_id", "i", "video_id").orderBy("body", "source_id", "i")


def resolve_slug(bodies: DataFrame, slug: str) -> DataFrame:
    """Bodies with this slug, ignoring case; an unknown slug is an error that lists the known ones."""
    found = bodies.filter(strings.slug(F.col("name_short")) == slug.lower())
    if found.isEmpty():
        known = bodies.agg(F.array_join(F.sort_array(F.collect_set(strings.slug(F.col("name_short")))), ", ").alias("s")).first().s
        raise ValueError(f"unknown body {slug!r}; known: {known}")
    return found


def find_one(table: DataFrame, id_: int) -> DataFrame:
    """The row with this id; a missing one is an error."""
    found = table.filter(F.col("id") == id_).limit(1)
    if found.isEmpty():
        raise LookupError(f"no row with id {id_}")
    return found


def lookup(rows: DataFrame, table: DataFrame, key: str, value: str, *, required: bool = False) -> DataFrame:
    """``value`` looked up by ``key``: null for a miss, or an error if required."""
    found = rows.join(table.select(key, value, F.lit(True).alias("_hit")), key, "left")
    if required:
        miss = F.raise_error(F.concat(F.lit(f"no {value} for {key} "), F.col(key).cast("string")))
        found = found.withColumn(value, F.when(F.col("_hit"), F.col(value)).otherwise(miss.cast(dict(table.dtypes)[value])))
    return found.drop("_hit")


def update_by_key(table: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """``table`` with the other columns of ``changes`` set where the key occurs there, to null as well."""
    values = [c for c in changes.columns if c != key]
    named = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in values], F.lit(True).alias("_hit"))
    joined = table.join(named, key, "left")
    return joined.select(*[F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in table.columns])


def set_name(people: DataFrame, changes: DataFrame, column: str = "name") -> DataFrame:
    """Edit a text column of people; blank values become null."""
    return update_by_key(people, changes.withColumn(column, strings.blank_to_null(F.col(column))))


def update_from(table: DataFrame, other: DataFrame, key: str, source: str, target: str) -> DataFrame:
    """``target`` overwritten with the other table's ``source`` where the key matches."""
    return update_by_key(table, other.select(key, F.col(source).alias(target)), key)


def null_collapse(column: Column, placeholders: list[str]) -> Column:
    """Placeholder values as null."""
    return F.when(~column.isin(placeholders), column)


def delete_childless(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    return parents.join(children.select(F.col(key).alias("id")), "id", "left_semi")


def insert_missing(table: DataFrame, new: DataFrame, key: str | list[str]) -> DataFrame:
    """Append the rows whose key is not there yet; ids go on after the greatest one, in order of the keys."""
    keys = [key] if isinstance(key, str) else key
    fresh = new.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti").drop("id")
    numbered = dense_number(fresh, keys, after=greatest(table), kind=dict(table.dtypes)["id"])
    return table.unionByName(numbered, allowMissingColumns=True)


def insert_if_exists(table: DataFrame, row: DataFrame, condition: DataFrame) -> DataFrame:
    """Append ``row`` if the condition table has any row."""
    return table.unionByName(row.join(condition.limit(1).select(F.lit(1).alias("_one")), F.lit(True), "left_semi"), allowMissingColumns=True)


def with_scalar(rows: DataFrame, table: DataFrame, where: Column, value: str, name: str) -> DataFrame:
    """``rows`` with one value of the row of ``table`` that satisfies ``where`` (the least id), null if none does."""
    one = table.filter(where).agg(F.min_by(value, "id").alias(name))  # always a single row
    return rows.join(F.broadcast(one))


def keep_first(rows: DataFrame, key: str | list[str], order: str | list[str]) -> DataFrame:
    """The first row of every key in a stated order."""
    keys, orders = ([x] if isinstance(x, str) else x for x in (key, order))
    first = F.min_by(F.struct(*rows.columns), F.struct(*orders))
    return rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(first.alias("_r")).select("_r.*")


def group_by_meeting(segments: DataFrame, meetings: DataFrame) -> DataFrame:
    """Meetings with their segments in time order (an unknown start counts as 0), recent ones first.

    Unknown dates come last, by descending id; equal dates keep the order in
    which their first segment appears, and the lesser meeting id goes first where those are equal.
    """
    entry = F.struct(F.coalesce("start_secs", F.lit(0)).alias("o"), F.col("id"), F.col("text"))
    lists = segments.groupBy(F.col("meeting_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: F.struct(x["id"].alias("id"), x["text"].alias("text"))).alias("segments"), F.min("id").alias("_seen"))
    unknown = F.when(F.col("start_time").isNull(), F.col("id"))
    return meetings.join(lists, "id").orderBy(F.col("start_time").desc_nulls_last(), unknown.desc_nulls_last(), F.col("_seen"), F.col("id")).drop("_seen")


def status_totals(listed: DataFrame) -> DataFrame:
    """One row: meetings, segments, bodies."""
    return listed.agg(F.count(F.lit(1)).alias("meetings"), F.coalesce(F.sum("segments"), F.lit(0)).alias("segments"), F.countDistinct("body").alias("bodies"))


def percentile_nearest_rank(p: float, x: str) -> Column:
    """Exact nearest-rank percentile, 0 for no rows."""
    return F.coalesce(F.expr(f"percentile_disc({p}) within group (order by {x})"), F.lit(0.0))
