"""Decay, reinforcement and score arithmetic as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DAY_MS, DECAY_LAMBDA, DYNAMICS, RELATION, SCORING, SECTORS


def clamped(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def days_between(since: Column, now: Column) -> Column:
    return (now - since) / DAY_MS


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def boosted(similarity: Column) -> Column:
    return 1 - F.exp(-SCORING.tau * similarity)


def sector_rate(sector: Column) -> Column:
    return reduce(lambda c, s: c.when(sector == s, DECAY_LAMBDA[s]), SECTORS[1:], F.when(sector == SECTORS[0], DECAY_LAMBDA[SECTORS[0]]))


def sector_decay(sector: Column, salience: Column, days: Column, segment_share: Column | None = None) -> Column:
    """Exponential fall to a floor at the sector's rate, slower in later segments; unknown sectors do not decay."""
    rate = sector_rate(sector)
    if segment_share is not None:
        rate = rate * (1 - F.sqrt(segment_share))
    kept = F.exp(-rate * days)
    return F.when(rate.isNull(), salience).otherwise(clamped(salience * kept + SCORING.floor * (1 - kept)))


def recency(days: Column) -> Column:
    """Not clamped: negative beyond t_max days."""
    return F.exp(-days / SCORING.t_days) * (1 - days / SCORING.t_max)


def tier(days_since: Column, coactivations: Column, salience: Column) -> Column:
    """hot: seen within six days and much activated or salient; warm: either alone, or of middle salience; else cold."""
    recent, much = days_since < 6, (coactivations > 5) | (salience > 0.7)
    return F.when(recent & much, "hot").when(recent | (salience > 0.4), "warm").otherwise("cold")


def activated(salience: Column, coactivations: Column) -> Column:
    return clamped(salience * (1 + F.log1p(coactivations.cast("double"))))


def tier_factor(tier_: Column, days: Column, salience: Column) -> Column:
    """What is left after so many days; salience is the activated one."""
    rate = F.when(tier_ == "hot", 0.005).when(tier_ == "warm", 0.02).otherwise(0.05)
    return F.exp(-rate * days / (salience + 0.1))


def tiered_decay(tier_: Column, days: Column, salience: Column, coactivations: Column) -> Column:
    s = activated(salience, coactivations)
    return clamped(s * tier_factor(tier_, days, s))


def dual_phase(days: Column) -> Column:
    """A fast and a slow exponential together, at most 1."""
    d = DYNAMICS
    return clamped(F.exp(-d.fast * days) + d.slow_share * F.exp(-d.slow * days))


def dynamic_salience(salience: Column, rate: Column, days: Column, recalls: Column, emotion: Column) -> Column:
    return clamped(salience * F.exp(-rate * days) + DYNAMICS.recall * recalls + DYNAMICS.emotion * emotion)


def trace(salience: Column) -> Column:
    return F.least(F.lit(1.0), salience + DYNAMICS.trace * (1 - salience))


def propagated(target: Column, weight: Column, source: Column) -> Column:
    return F.least(F.lit(1.0), target + DYNAMICS.trace * weight * source)


def context_boost(neighbour: Column, salience: Column, days: Column) -> Column:
    return clamped(neighbour + DYNAMICS.context * (salience - neighbour) * F.exp(-DYNAMICS.context_decay * days))


def link_weight(similarity: Column, days: Column) -> Column:
    return F.greatest(F.lit(0.0), similarity / (1 + days))


def coactivated(weight: Column, hours: Column) -> Column:
    return F.least(F.lit(1.0), weight + DYNAMICS.coactivation * (1 - weight) * F.exp(-hours / DYNAMICS.coactivation_hours))


def energy_threshold(energy: Column) -> Column:
    return clamped(DYNAMICS.threshold * (1 + F.log(energy + 1)), 0.1, 0.9)


def sector_penalty(query: Column, additional: Column, memory: Column) -> Column:
    """1 for the query's own sectors, else by the relation table, 0.3 where it has nothing."""
    table = F.create_map(*[x for q, row in RELATION.items() for m, v in row.items() for x in (F.lit(f"{q}>{m}"), F.lit(v))])
    other = F.coalesce(F.try_element_at(table, F.concat(query, F.lit(">"), memory)), F.lit(0.3))
    return F.when((query == memory) | F.coalesce(F.array_contains(additional, memory), F.lit(False)), 1.0).otherwise(other)


def hybrid_score(similarity: Column, overlap: Column, waypoint: Column, recency_: Column, tags: Column, keyword: Column, own_project: Column) -> Column:
    """Sigmoid of the weighted parts; a row of the asked project moves up on the logit scale."""
    s = SCORING
    boost = F.when(keyword > s.keyword_least, s.keyword_boost * keyword).otherwise(0.0)
    x = s.similarity * boosted(similarity) + s.overlap * overlap + s.waypoint * clamped(waypoint) + s.recency * recency_ + s.tags * tags + boost
    return sigmoid(x + F.when(own_project, s.project_boost).otherwise(0.0))


def confidence_decay(confidence: Column, rate: float, age_days: Column) -> Column:
    return F.greatest(F.lit(0.1), confidence * (1 - rate * age_days))


def link_strength(semantic: Column, emotional: Column) -> Column:
    return sigmoid(0.7 * semantic + 0.3 * emotional)


def compressed_size(size: Column, left: Column, least: int = 64, most: int = 1536) -> Column:
    """Components that decay leaves of a vector: buckets of equal width for the share that is left."""
    want = F.greatest(F.lit(least), F.least(size, F.greatest(F.lit(least), F.least(F.lit(most), F.floor(size * clamped(left)).cast("int")))))
    return F.when(want >= size, size).otherwise(F.ceil(size / F.ceil(size / want)).cast("int"))


def hit(salience: Column) -> Column:
    """Salience of a memory that a query has met."""
    return clamped(salience + 0.5)


def plain_score(relevance: Column, hours: Column, salience: Column, rate: float = 0.02) -> Column:
    return relevance * 0.6 + F.exp(-rate * F.greatest(F.lit(0.0), hours)) * 0.2 + F.least(salience, F.lit(1.0)) * 0.2


def temporal_relevance(scope: Column, days: Column) -> Column:
    """How well a memory's age fits what a query says of time; 1 where it says nothing or the age is not known."""
    falling = 1 - days / 30
    present = F.when(days < 7, 1.0).otherwise(F.greatest(F.lit(0.5), falling))
    return F.when(days.isNull(), 1.0).when(scope == "past", F.greatest(F.lit(0.3), falling)).when(scope == "present", present).when(scope == "future", 0.7).otherwise(1.0)
