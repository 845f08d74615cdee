"""Boxes, layout, rasters as rows, coordinates, and text forms of molecules."""

from __future__ import annotations

from ..plans import views  # noqa: F401
from ..plans.dialect import catalogue
from . import pages  # noqa: F401

add = catalogue.add
PAIRS = "SELECT a.page, a.box_id AS a, b.box_id AS b, a.y1 AS ay1, a.x1 AS ax1, a.y2 AS ay2, a.x2 AS ax2, b.y1 AS by1, b.x1 AS bx1, b.y2 AS by2, b.x2 AS bx2 FROM @v_boxes a JOIN @v_boxes b ON a.page = b.page AND a.box_id < b.box_id"
INTER = "(greatest(0, least(ay2, by2) - greatest(ay1, by1)) * greatest(0, least(ax2, bx2) - greatest(ax1, bx1)))"
AREA_A, AREA_B = "((ay2 - ay1) * (ax2 - ax1))", "((by2 - by1) * (bx2 - bx1))"

add("sp01_box_algebra", lambda d: f"SELECT page, a, b, round({INTER} / ({AREA_A} + {AREA_B} - {INTER}), 6) AS iou, round({INTER} / least({AREA_A}, {AREA_B}), 6) AS coverage, least(ay1, by1) AS uy1, greatest(ax2, bx2) AS ux2 FROM ({PAIRS}) p WHERE {INTER} > 0")
add("jn09_containment", lambda d: f"SELECT page, a, b FROM ({PAIRS}) p WHERE ay1 - 2 <= by1 AND ax1 - 2 <= bx1 AND ay2 + 2 >= by2 AND ax2 + 2 >= bx2")
add("sp09_contact_sheet", lambda d: "SELECT page, i, CAST(floor(i / 4) AS BIGINT) AS grid_row, i % 4 AS grid_col, CAST(floor(i / 4) AS BIGINT) * 260 AS y, (i % 4) * 200 AS x FROM (SELECT page, row_number() OVER (ORDER BY page) - 1 AS i FROM (SELECT DISTINCT page FROM @v_boxes) p) t")
add("fl01_raw_detections", lambda d: "SELECT page, box_id FROM @v_boxes WHERE y2 - y1 >= 18 AND x2 - x1 >= 18 AND (y2 - y1) * (x2 - x1) >= 600 AND (y2 - y1) * (x2 - x1) <= 0.92 * 700 * 500")
add("so06_candidate_order", lambda d: "SELECT page, box_id, row_number() OVER (PARTITION BY page ORDER BY (y2 - y1) * (x2 - x1) DESC, score DESC, box_id) AS place FROM @v_boxes")
add("wn05_reading_rows", lambda d: "SELECT page, box_id, sum(CASE WHEN gap >= 50 THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY y1, box_id ROWS UNBOUNDED PRECEDING) AS line FROM (SELECT page, box_id, y1, y1 - lag(y1) OVER (PARTITION BY page ORDER BY y1, box_id) AS gap FROM @v_boxes) t")
add("tx34_coordinates", lambda d: "SELECT page, box_id, round((x1 - min(x1) OVER (PARTITION BY page)) / greatest(max(x1) OVER (PARTITION BY page) - min(x1) OVER (PARTITION BY page), 1e-6), 10) AS x, round((max(y1) OVER (PARTITION BY page) - y1) / greatest(max(y1) OVER (PARTITION BY page) - min(y1) OVER (PARTITION BY page), 1e-6), 10) AS y FROM @v_boxes")
add("tx33_flat_formula", lambda d: f"SELECT k, CAST(i AS BIGINT) AS i, {d.extract('t', '^[A-Z][a-z]?', 0)} AS element, coalesce(TRY_CAST({d.extract('t', '[0-9]+$', 0)} AS BIGINT), 1) AS n FROM (SELECT p_partkey AS k, concat('C', CAST(p_size AS STRING), 'H', CAST(p_partkey % 30 AS STRING), 'OCl2') AS f FROM @part) p {d.each_at(d.extract_all('f', '[A-Z][a-z]?[0-9]*', 0), 'i', 't')}")
add("tx07_head_tail", lambda d: "SELECT doc_id, CASE WHEN length(text) > 1000 THEN concat(substring(text, 1, 500), '[...]', right(text, 460)) ELSE text END AS text FROM @documents")
add("tx06_budgeted_context", lambda d: "SELECT doc_id, page, substring(text, 1, CAST(least(length(text), 600 - before) AS INT)) AS text, length(text) > 600 - before AS cut FROM (SELECT doc_id, page, text, coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM @v_lines) t WHERE before < 600")
add("tx23_page_candidates", lambda d: f"SELECT DISTINCT doc_id, page, w FROM (SELECT doc_id, page, lower(text) AS x FROM @v_lines) l {d.each(d.extract_all('x', '[0-9]+'), 'w')} WHERE length(w) <= 6")
