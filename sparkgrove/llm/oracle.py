"""SQL with the same result, where SQL can express the operator."""

from __future__ import annotations

from sparkgrove.plans.data_queries import CURRENT

SQL = {
    "p3_found": f"""
    WITH RECURSIVE {CURRENT},
    ok AS (SELECT document_id, node_id, s, e FROM rng WHERE s <= e),
    starts AS (SELECT document_id, list(DISTINCT s) AS pts FROM ok GROUP BY document_id),
    cut AS (
        SELECT o.document_id, o.node_id, o.e, t.pts, 1 AS piece_no, o.s AS f,
               CASE WHEN o.e - o.s + 1 <= 15 THEN o.e ELSE coalesce(list_max(list_filter(t.pts, lambda x: x - 1 BETWEEN o.s + 2 AND o.s + 14)) - 1, o.s + 14) END AS l
        FROM ok o JOIN starts t USING (document_id) WHERE o.e - o.s + 1 > 15
        UNION ALL
        SELECT document_id, node_id, e, pts, piece_no + 1, l - 1,
               CASE WHEN e - (l - 1) + 1 <= 15 THEN e ELSE coalesce(list_max(list_filter(pts, lambda x: x - 1 BETWEEN l + 1 AND l + 13)) - 1, l + 13) END
        FROM cut WHERE l < e)
    SELECT document_id, node_id, CAST(piece_no AS INTEGER) AS piece_no, CAST(f AS INTEGER) AS first_page, CAST(l AS INTEGER) AS last_page FROM cut""",
}
