"""Similarities and feature scores between 0 and 1, as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector has no length."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 where either is empty or null."""
    return F.coalesce(F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))), F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    """Common members over the larger set's size."""
    return F.coalesce(F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b))), F.lit(0.0))


def price_similarity(a_low: Column, a_high: Column, b_low: Column, b_high: Column) -> Column:
    """exp(-2 |a-b| / max) on the sums of the bounds; 0 unless both are positive."""
    a, b = F.coalesce(a_low, F.lit(0.0)) + F.coalesce(a_high, F.lit(0.0)), F.coalesce(b_low, F.lit(0.0)) + F.coalesce(b_high, F.lit(0.0))
    return F.when((a > 0) & (b > 0), F.exp(-2 * F.abs(a - b) / F.greatest(a, b))).otherwise(0.0)


def price_overlap(low: Column, high: Column, user_low: float, user_high: float) -> Column:
    """Shared part of two price ranges over the smaller one: 1 for free events, 0 for disjoint ranges."""
    free = F.coalesce(low, F.lit(0.0)) == 0
    top = F.when(F.coalesce(high, F.lit(0.0)) == 0, low).otherwise(high)
    shared = F.least(top, F.lit(user_high)) - F.greatest(low, F.lit(user_low))
    smaller = F.least(F.when(top - low == 0, 1.0).otherwise(top - low), F.lit((user_high - user_low) or 1.0))
    return F.when(free, 1.0).when(shared < 0, 0.0).otherwise(F.least(F.lit(1.0), shared / smaller))


def time_match(at: Column, hours: list[int], days: list[int]) -> Column:
    """Half for an hour near a preferred one, half for a preferred day (Monday 0); 1/2 where the time is null."""
    gap = F.array_min(F.transform(F.array(*map(F.lit, hours)), lambda h: F.abs(h - F.hour(at))))
    return F.when(at.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), 1 - gap / F.lit(12.0)) * 0.5 + F.when(F.weekday(at).isin(days), 0.5).otherwise(0.0))


def recency(days: Column) -> Column:
    """Bands of days until an event: past 0, a week 1, a month .8, a quarter .6, later .3; null .5."""
    return F.when(days.isNull(), 0.5).when(days < 0, 0.0).when(days <= 7, 1.0).when(days <= 30, 0.8).when(days <= 90, 0.6).otherwise(0.3)


def hour_similarity(a: Column, b: Column) -> Column:
    """Of two hours as shares of a day, round the clock."""
    return 1 - F.least(F.abs(a - b), 1 - F.abs(a - b))


def mlp(features: Column, layers: list[tuple[list[list[float]], list[float]]]) -> Column:
    """A ReLU network with a sigmoid at its single output; layers of (rows of weights, biases)."""
    x = features
    for k, (rows, bias) in enumerate(layers):
        out = [dot(x, F.array(*map(F.lit, row))) + b for row, b in zip(rows, bias)]
        x = F.array(*[o if k == len(layers) - 1 else F.greatest(F.lit(0.0), o) for o in out])
    return 1 / (1 + F.exp(-x[0]))
