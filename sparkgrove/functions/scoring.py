"""Relevance and upper-confidence-bound scores as column expressions.

A model's judgement of relevance has no offline form; the stand-in is the share of the query's words that a candidate holds.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXPLORATION = 1.414
#: Score of a candidate whose judgement failed or can't be read.
NEUTRAL = 0.3
#: Factor for a source that a second reading doesn't confirm.
UNCONFIRMED = 0.3


def words(*texts: Column) -> Column:
    """Distinct words of the texts, split at blanks, in lower case; an empty array for nulls."""
    joined = F.concat_ws(" ", *texts)
    return F.array_distinct(F.filter(F.split(F.lower(joined), " "), lambda w: w != ""))


def relevance(query: Column, candidate: Column) -> Column:
    """Share of the query's distinct words among the candidate's; 0 for a query without words."""
    return F.when(F.size(query) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(query, candidate)) / F.size(query))


def parsed_score(response: Column) -> Column:
    """The relevance_score of a JSON response, clamped to 0 .. 1: 0 where the field is missing, neutral where null or unreadable."""
    parsed = F.try_parse_json(response)
    value = F.try_variant_get(parsed, "$.relevance_score", "double")
    missing = parsed.isNotNull() & F.variant_get(parsed, "$.relevance_score", "variant").isNull()
    clamped = F.greatest(F.least(value, F.lit(1.0)), F.lit(0.0))
    return F.when(missing, 0.0).when(value.isNull() | F.isnan(value), NEUTRAL).otherwise(clamped)


def mean_reward(reward: Column, visits: Column) -> Column:
    return F.when(visits == 0, F.lit(0.0)).otherwise(reward / visits)


def ucb1(reward: Column, visits: Column, parent_visits: Column) -> Column:
    """Mean plus exploration bonus; infinite without visits, the mean alone where the parent is missing or unvisited."""
    mean = mean_reward(reward, visits)
    bonus = EXPLORATION * F.sqrt(F.log(parent_visits) / visits)
    return F.when(visits == 0, F.lit(float("inf"))).when(parent_visits.isNull() | (parent_visits == 0), mean).otherwise(mean + bonus)


def rank_score(reward: Column, visits: Column) -> Column:
    """Mean reward times the logarithm of the visits plus one."""
    return mean_reward(reward, visits) * F.log(visits + 1)


def rounded(value: Column, unit: float = 1e6) -> Column:
    """To the nearest part of ``unit``, halves up, by arithmetic that every engine does alike."""
    return F.floor(value * unit + 0.5) / unit
