"""Oversized items cut at natural boundaries into overlapping pieces under a limit.

Agglomerative merging: an item begins as atomic segments, the runs between its natural boundaries.
Adjacent pairs wait in a heap, the weakest boundary first; a pair is merged while its size plus the overlap
fits, otherwise its boundary becomes a cut. ``cut_pages`` counts the boundary nearest to the start of the item as the
weakest, which makes each cut come as late as possible; ``merge_segments`` takes any strengths.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_segments(bounds: Sequence[int], strengths: Sequence[float], limit: int, overlap: int = 0, least: int = 1) -> list[tuple[int, int]]:
    """Pieces (first, last) of the segments between ``bounds``, in order.

    ``bounds`` are ascending positions: the first unit of each segment, and one past the end; ``strengths``
    has a number for each inner bound. Each piece has at most ``limit`` units, repeats the last ``overlap`` units of the one
    before, and has at least ``least`` units where it ends at a natural boundary. A segment that is too long
    by itself is cut at the limit. Equal strengths: the earlier boundary is merged first.
    """
    n = len(bounds) - 1
    following, previous = list(range(1, n + 1)), list(range(-1, n - 1))
    start, end = list(bounds[:-1]), [b - 1 for b in bounds[1:]]
    lead = [0] * n  # units repeated from the piece before
    settled = [True] + [False] * (n - 1)  # whether what lies before is cut off
    pieces: list[tuple[int, int]] = []
    heap = [(strengths[i - 1], i) for i in range(1, n)]
    heapq.heapify(heap)

    def size(i: int) -> int:
        return end[i] - start[i] + 1 + lead[i]

    def chop(i: int) -> None:
        while settled[i] and size(i) > limit:
            first = start[i] - lead[i]
            pieces.append((first, first + limit - 1))
            start[i], lead[i] = first + limit, overlap

    while heap:
        _, b = heapq.heappop(heap)
        a = previous[b]
        chop(a)
        fits = size(a) + end[b] - start[b] + 1 + (0 if settled[a] else overlap) <= limit
        if fits or settled[a] and size(a) < least:
            end[a], following[a] = end[b], following[b]
            if following[b] < n:
                previous[following[b]] = a
            chop(a)
        else:
            settled[b], lead[b] = True, min(overlap, start[b] - bounds[0])
    i = 0
    while i < n:
        chop(i)
        pieces.append((start[i] - lead[i], end[i]))
        i = following[i]
    return sorted(pieces)


def cut_pages(items: DataFrame, starts: DataFrame, entity: str, limit: int = 15, overlap: int = 2, least: int = 3) -> DataFrame:
    """Pieces of the items that have more than ``limit`` pages.

    ``items`` has ``entity``, ``first``, ``last``; ``starts`` has ``entity`` and ``page``, the pages where a section starts.
    Result: entity, first, last, piece_no (from 1), first_page, last_page, for each distinct item. While more than
    ``limit`` pages remain, the cut is the last one that leaves ``least`` to ``limit`` pages and lies before a section's
    start; without one the piece has ``limit`` pages.

    - Items with a null or of at most ``limit`` pages give no rows; an entity without starts is cut at the limit.
    - Repeated items and starts count once. Extra columns are ignored, empty tables give an empty result.
    - Starts of an entity are gathered once as a sorted array, no longer than its pages; a document
      with very many items is divided among tasks by Spark's handling of skewed joins.
    """
    if not 0 <= overlap < least <= limit:
        raise ValueError("needs 0 <= overlap < least <= limit")
    items = items.select(entity, F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last")).filter(F.col("last") - F.col("first") + 1 > limit).distinct()
    pages = starts.dropna(subset=[entity, "page"]).groupBy(entity).agg(F.array_sort(F.collect_set(F.col("page").cast("long"))).alias("starts"))
    # an item's own starts only, so that what goes to Python grows with the pages of the items
    inside = F.filter("starts", lambda p: (p > F.col("first")) & (p <= F.col("last")))
    joined = items.join(pages, entity, "left").select(F.col(entity).cast("string").alias("entity"), "first", "last", inside.alias("starts"))
    out = pa.schema([("entity", pa.string()), *[(c, pa.int64()) for c in ("first", "last")], *[(c, pa.int32()) for c in ("piece_no", "first_page", "last_page")]])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, first, last, at in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                bounds = [first, *(at or ()), last + 1]
                pieces = merge_segments(bounds, range(len(bounds) - 2), limit, overlap, least)
                rows += [(name, first, last, i, *piece) for i, piece in enumerate(pieces, 1)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), out.types)], schema=out)

    done = joined.mapInArrow(cut, "entity string, first long, last long, piece_no int, first_page int, last_page int")
    return done.withColumnRenamed("entity", entity)
