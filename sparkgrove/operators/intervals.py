"""Covered periods and gaps of overlapping, nested or gapped intervals, by a sweep line.

Boundaries become events of plus and minus one, the running sum of the events is the number of open
intervals, and a period begins where that number rises from zero. Sums and neighbours are found in
two steps, within blocks of positions and over block totals, so that an entity holding a third of
all intervals is swept by many tasks: no window is larger than the distinct positions of one block or
the blocks of one entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Distinct positions that one window may hold.
BLOCK = 4096


def _before(df: DataFrame, entity: list[str], block: str, value: Column, name: str) -> DataFrame:
    """Adds the sum of ``value`` over all earlier blocks of the entity."""
    totals = df.groupBy(*entity, block).agg(F.sum(value).alias("_sum"))
    earlier = W.partitionBy(*entity).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*entity, block, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias(name))
    return df.join(offsets, [*entity, block])


def _next(df: DataFrame, entity: list[str], block: str, position: str, name: str) -> DataFrame:
    """Adds the following position of the same entity, in this block or a later one."""
    heads = df.groupBy(*entity, block).agg(F.min(position).alias("_head"))
    heads = heads.select(*entity, block, F.lead("_head").over(W.partitionBy(*entity).orderBy(block)).alias("_later"))
    inside = F.lead(position).over(W.partitionBy(*entity, block).orderBy(position))
    return df.join(heads, [*entity, block]).withColumn(name, F.coalesce(inside, "_later")).drop("_later")


def covered_and_gaps(intervals: DataFrame, spans: DataFrame, entity: list[str], start: str, end: str, low: str, high: str, block: int = BLOCK) -> DataFrame:
    """Longest covered ('period') and uncovered ('gap') runs of each span.

    ``intervals`` has inclusive integer bounds ``start`` and ``end`` per entity, ``spans`` one row per
    entity with inclusive ``low`` and ``high``. Result: the entity columns, ``kind``, ``first``, ``last``.

    - Intervals are cut to their span; what lies outside, and intervals of an entity without span, count
      for nothing. So do intervals with a null or reversed bound (put those in order before).
    - Repeated, nested and touching intervals form one period. Integer positions touch when one ends
      right before the other starts.
    - A span without intervals is one gap. A span with a null bound or ``low > high`` gives no rows, and
      so does a null entity. Repeated spans of one entity count as their union's hull.
    - Other columns of either table are ignored; empty tables give an empty result.
    """
    spans = spans.dropna(subset=[*entity, low, high]).filter(F.col(low) <= F.col(high))
    spans = spans.groupBy(*entity).agg(F.min(low).cast("long").alias("_low"), F.max(high).cast("long").alias("_high"))
    cut = (
        intervals.select(*entity, F.col(start).cast("long").alias("_s"), F.col(end).cast("long").alias("_e"))
        .filter("_s <= _e")
        .distinct()
        .join(spans, entity)
        .select(*entity, F.greatest("_s", "_low").alias("_s"), F.least("_e", "_high").alias("_e"))
        .filter("_s <= _e")
    )

    def event(position: str, delta: int) -> Column:
        return F.struct(F.expr(position).alias("_at"), F.lit(delta).cast("long").alias("_delta"))

    events = cut.select(*entity, F.inline(F.array(event("_s", 1), event("_e + 1", -1)))).unionByName(spans.select(*entity, F.inline(F.array(event("_low", 0), event("_high + 1", 0)))))
    events = events.groupBy(*entity, "_at").agg(F.sum("_delta").alias("_delta")).withColumn("_block", F.floor(F.col("_at") / block))

    running = F.sum("_delta").over(W.partitionBy(*entity, "_block").orderBy("_at").rowsBetween(W.unboundedPreceding, 0))
    swept = _before(events, entity, "_block", F.col("_delta"), "_open").withColumn("_open", F.col("_open") + running)
    swept = swept.join(spans, entity)
    turns = swept.filter("_at = _low or _at > _high or (_open > 0) != (_open - _delta > 0)")
    turns = _next(turns.select(*entity, "_at", "_block", "_open", "_high"), entity, "_block", "_at", "_until")
    kind = F.when(F.col("_open") > 0, "period").otherwise("gap")
    return turns.filter("_at <= _high").select(*entity, kind.alias("kind"), F.col("_at").alias("first"), (F.col("_until") - 1).alias("last"))
