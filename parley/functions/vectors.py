"""Vector and sample-array column functions. Vectors are arrays; sums run in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MATCH_THRESHOLD = 0.55
MAX_DISTANCE = 1 - MATCH_THRESHOLD
SAMPLE_RATE = 16_000
MAX_EMBED_SECS = 8.0


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 if either vector is zero."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 for a zero vector, so that it never matches."""
    return 1 - cosine_similarity(a, b)


def weighted_mean(a: Column, weight_a: Column, b: Column, weight_b: Column) -> Column:
    """Mean of two centroids by weight, stored as floats."""
    return F.zip_with(a, b, lambda x, y: ((x * weight_a + y * weight_b) / (weight_a + weight_b)).cast("float"))


def one_hot(size: int, place: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (i == place).cast("float"))


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.least(a_end, b_end) - F.greatest(a_start, b_start)


def tail_clip(start: Column, end: Column, rate: int = SAMPLE_RATE, most: float = MAX_EMBED_SECS) -> Column:
    """Sample range (from, to) of the last seconds of a turn."""
    return F.struct(F.floor(F.greatest(start, end - most) * rate).alias("from"), F.floor(end * rate).alias("to"))


def slice_wave(samples: Column, rate: Column, start: Column, end: Column) -> Column:
    """Samples of a time window, clamped to the wave; an empty window is an error."""
    clamp = lambda s: F.floor(F.greatest(F.lit(0.0), F.least(s * rate, F.size(samples).cast("double"))) + 0.5).cast("int")
    a, b = clamp(start), clamp(end)
    return F.when(a >= b, F.raise_error(F.lit("empty window")).cast("array<float>")).otherwise(F.slice(samples, a + 1, b - a))


def sample_secs(index: Column, rate: Column | int = SAMPLE_RATE) -> Column:
    return index / rate


def checked_rate(rate: Column, expected: int = SAMPLE_RATE) -> Column:
    """The rate itself; any other than the expected is an error."""
    return F.when(rate == expected, rate).otherwise(F.raise_error(F.concat(F.lit("unexpected sample rate "), rate.cast("string"))).cast("int"))
