"""Date, time zone, timestamp and duration column functions. The session's time zone is UTC."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_INTERVAL = "^(\\d+):(\\d{2}):(\\d{2}(?:\\.\\d+)?)$"


def half_up(x: Column) -> Column:
    """Nearest integer, halves upwards (also below zero)."""
    return F.floor(x + 0.5)


def interval_of(secs: Column) -> Column:
    """Day-time interval of seconds, rounded to three digits; null stays null."""
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.round(secs, 3).cast("decimal(18,6)"))


def wall_clock(instant: Column, zone: Column) -> Column:
    return F.from_utc_timestamp(instant, zone)


def naive_to_instant(wall: Column) -> Column:
    """A wall-clock time taken as UTC."""
    return F.to_utc_timestamp(wall, "UTC")


def meeting_time(instant: Column, zone: Column) -> Column:
    """"June 14, 2026 7:00 PM"."""
    return F.date_format(wall_clock(instant, zone), "MMMM d, yyyy h:mm a")


def month_year(instant: Column, zone: Column) -> Column:
    """"Apr 2023"."""
    return F.date_format(wall_clock(instant, zone), "MMM yyyy")


def input_value(instant: Column, zone: Column) -> Column:
    """"2026-06-14T19:00" in the zone."""
    return F.date_format(wall_clock(instant, zone), "yyyy-MM-dd'T'HH:mm")


def iso_date(instant: Column) -> Column:
    return F.date_format(instant, "yyyy-MM-dd")


def from_input_value(value: Column, zone: Column) -> Column:
    """Instant of a wall-clock input; null if it is not one.

    The offset is looked up twice: at the wall time taken as UTC, then at the
    first result. In a gap or a repeated hour this differs from Spark's own
    conversion.
    """
    good = value.rlike("^\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}$")
    naive = F.try_to_timestamp(F.when(good, value), F.lit("yyyy-MM-dd'T'HH:mm"))
    micros = F.unix_micros(naive)

    def offset(at: Column) -> Column:
        moment = F.timestamp_micros(at)
        return F.unix_micros(F.from_utc_timestamp(moment, zone)) - at

    return F.timestamp_micros(micros - offset(micros - offset(micros)))


def zone_abbreviation(instant: Column, zone: Column) -> Column:
    """"AKDT": the zone differs by row, which no built-in format can do."""

    @F.pandas_udf("string")
    def name(at: pd.Series, zones: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(at), dtype=object)
        for z, rows in zones.groupby(zones):
            own = at[rows.index]
            out[rows.index] = own.dt.tz_localize("UTC").dt.tz_convert(z).map(lambda t: t.tzname() if t is not pd.NaT else None)
        return out

    return name(instant, zone)


def clock(secs: Column) -> Column:
    """Whole seconds as ``h:mm:ss``, or ``m:ss`` under an hour; never below zero."""
    s = F.greatest(F.lit(0), F.floor(secs)).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))


def interval_secs(text: Column) -> Column:
    """Seconds of ``H:MM:SS[.f]``, null for any other text."""
    part = lambda k: F.try_to_number(F.regexp_extract(text, _INTERVAL, k), F.lit("999999999999.999999")).cast("double")
    return F.when(text.rlike(_INTERVAL), part(1) * 3600 + part(2) * 60 + part(3))


def secs_duration(secs: Column, precision: str = "seconds") -> Column:
    """"1h 23m 5s", or "1h 23m" with minute precision, where less than half a minute is "<1m"."""
    if precision == "minutes":
        mins = half_up(F.greatest(F.lit(0.0), secs) / 60).cast("long")
        h, m = F.floor(mins / 60), F.pmod(mins, F.lit(60))
        return F.when(mins == 0, "<1m").when(h > 0, F.format_string("%dh %dm", h, m)).otherwise(F.format_string("%dm", mins))
    s = F.greatest(F.lit(0), half_up(secs)).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))
    return F.when(h > 0, F.format_string("%dh %dm %ds", h, m, r)).when(m > 0, F.format_string("%dm %ds", m, r)).otherwise(F.format_string("%ds", r))


def duration(text: Column, precision: str = "seconds") -> Column:
    """``secs_duration`` of an interval's text; other texts pass unchanged."""
    secs = interval_secs(text)
    return F.when(secs.isNull(), text).otherwise(secs_duration(secs, precision))


def interval_text(secs: Column) -> Column:
    """``HH:MM:SS[.f]`` of seconds, with up to three digits and no trailing zeros."""
    ms = F.round(secs * 1000).cast("long")
    h, m, s, f = F.floor(ms / 3600000), F.pmod(F.floor(ms / 60000), F.lit(60)), F.pmod(F.floor(ms / 1000), F.lit(60)), F.pmod(ms, F.lit(1000))
    whole = F.format_string("%02d:%02d:%02d", h, m, s)
    return F.when(f == 0, whole).otherwise(F.concat(whole, F.lit("."), F.regexp_replace(F.format_string("%03d", f), "0+$", "")))


def timeline_secs(text: Column) -> Column:
    """Seconds of ``mm:ss`` or ``h:mm:ss``; other shapes are an error."""
    p = F.split(text, ":")
    num = lambda k: F.get(p, F.lit(k)).cast("double")
    return F.when(F.size(p) == 2, num(0) * 60 + num(1)).when(F.size(p) == 3, num(0) * 3600 + num(1) * 60 + num(2)).otherwise(F.raise_error(F.concat(F.lit("not a timestamp: "), text)).cast("double"))


def timeline_text(secs: Column) -> Column:
    """``m:ss.mmm``, or ``h:mm:ss.mmm`` from one hour."""
    h, m = F.floor(secs / 3600), F.floor(F.pmod(secs, F.lit(3600.0)) / 60)
    s = F.format_string("%06.3f", F.pmod(secs, F.lit(60.0)))
    return F.when(h > 0, F.concat(F.format_string("%d:%02d:", h, m), s)).otherwise(F.concat(F.format_string("%d:", m), s))


def psv_time(secs: Column) -> Column:
    """``H:MM:SS.ss`` of seconds, halves of a hundredth upwards."""
    cs = half_up(secs * 100).cast("long")
    total = F.floor(cs / 100)
    return F.format_string("%d:%02d:%02d.%02d", F.floor(total / 3600), F.pmod(F.floor(total / 60), F.lit(60)), F.pmod(total, F.lit(60)), F.pmod(cs, F.lit(100)))


def parse_psv_time(text: Column) -> Column:
    """Seconds of ``H:MM:SS.ss``; a wrong number of parts or a part that is no number is an error."""
    return parts_secs(text, F.split(text, ":"))


def parts_secs(text: Column, p: Column) -> Column:
    """``parse_psv_time`` of a text whose parts ``p`` are there: a column that is read here, where an expression would be worked out at each use."""
    num = lambda k: F.get(p, F.lit(k)).try_cast("double")
    good = half_up((num(0) * 3600 + num(1) * 60 + num(2)) * 100) / 100  # null where a part is no number
    why = F.when(F.size(p) != 3, "expected H:MM:SS.ss").otherwise("not a number")
    wrong = F.raise_error(F.concat(F.lit("invalid timestamp ("), why, F.lit("): "), text)).cast("double")
    return F.when(text.isNull(), None).when(F.size(p) != 3, wrong).otherwise(F.coalesce(good, wrong))


def segment_secs(duration_text: Column, words: Column) -> Column:
    """Length of a segment: its interval's, else from its words and at least 0, else 0."""
    span = F.try_element_at(words, F.lit(-1))["end"] - F.try_element_at(words, F.lit(1))["start"]
    return F.coalesce(interval_secs(duration_text), F.greatest(F.lit(0.0), span), F.lit(0.0))


def midpoint(start: Column, end: Column) -> Column:
    return (start + end) / 2


def seek_target(at: Column, step: Column, length: Column) -> Column:
    """Where a jump lands: not before 0 and not after a known length."""
    target = F.greatest(F.lit(0.0), at + step)
    return F.coalesce(F.least(length, target), target)
