"""Scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from siltstone.model.vocabulary import CONFIDENCE, HALF_LIFE_DAYS, MULTIPLIER, RRF_K


def confidence_rank(confidence: Column) -> Column:
    """AMBIGUOUS 0, INFERRED 1, EXTRACTED 2; null counts as EXTRACTED."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, CONFIDENCE)), confidence) - 1, F.lit(2)).cast("int")


def passes_confidence(confidence: Column, floor: str | None) -> Column:
    return F.lit(True) if floor is None else confidence_rank(confidence) >= CONFIDENCE.index(floor)


def surprise(confidence: Column, near_source: Column, far_source: Column, near_community: Column, far_community: Column, near_degree: Column, far_degree: Column) -> Column:
    """How unexpected an edge is, from 0 to 8: doubt, crossing a source or community, a leaf on a hub; two hubs count less.

    Nulls leave their factor out; crossings don't count for AMBIGUOUS edges.
    """
    sure = ~F.coalesce(confidence == "AMBIGUOUS", F.lit(False))
    weight = F.when(confidence == "AMBIGUOUS", 1.5).when(confidence == "INFERRED", 1.25).otherwise(1.0)
    crossing = F.when(sure & (near_source != far_source), 1.5).otherwise(1.0)
    bridge = F.when(sure & (near_community != far_community), 1.4).otherwise(1.0)
    low, high = F.least(near_degree, far_degree), F.greatest(near_degree, far_degree)
    leaf = F.when((low <= 2) & (high >= 5), 1.3).otherwise(1.0)
    hubs = F.when(low >= 3, F.greatest(1.0 - 0.15 * F.log2(low / 2.0), F.lit(0.5))).otherwise(1.0)
    return F.least(weight * crossing * bridge * leaf * hubs, F.lit(8.0))


def source_weight(source: Column, updated_at: Column, now: str, multiplier: Column | None = None, half_life: Column | None = None, ahead: bool = False) -> Column:
    """A source's multiplier, halved for each half-life of age. No source: 1. No time, or one to come: the multiplier; with `ahead` a time to come doubles it for each half-life."""
    times = F.coalesce(multiplier, F.lit(MULTIPLIER)) if multiplier is not None else F.lit(MULTIPLIER)
    half = F.coalesce(half_life, F.lit(HALF_LIFE_DAYS)) if half_life is not None else F.lit(HALF_LIFE_DAYS)
    age = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(updated_at)
    power = -F.log(F.lit(2.0)) * age / 86_400_000_000.0 / half
    decay = F.when((F.lit(ahead) | (age >= 0)) & age.isNotNull() & (half > 0), _exp()(F.coalesce(power, F.lit(0.0))) if ahead else F.exp(power)).otherwise(1.0)
    return F.when(source.isNull() | (source == ""), 1.0).otherwise(times * decay)


def _exp():
    """The C library's exponential: weights of times to come get so large that Java's, the last bit of which differs at times, shows in six digits."""
    import math

    def one(x: float) -> float:
        try:
            return math.exp(x)
        except OverflowError:
            return math.inf

    return F.udf(one, "double")


def rounded(value: Column, digits: int = 6) -> Column:
    """As binary numbers are rounded by scaling: on large values F.round, which takes the shortest decimal form, gives another last digit."""
    scaled = value * 10.0**digits
    return F.when(F.abs(scaled) < float("inf"), F.round(scaled) / 10.0**digits).otherwise(value)


def rank_term(rank: Column) -> Column:
    """A list's share in a fused score; rank from 0."""
    return 1.0 / (F.lit(RRF_K) + rank + 1)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is null, empty, zero or of another length."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norms > 0), dot(a, b) / norms), F.lit(0.0))
