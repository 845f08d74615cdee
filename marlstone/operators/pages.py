"""Page ranges, runs of pages, headers carried forward, OCR payloads and tables on pages."""

from __future__ import annotations

from ..plans import views  # noqa: F401
from ..plans.dialect import catalogue

add = catalogue.add


@catalogue.view("v_ranges")
def _ranges(d):
    s = lambda x: f"CAST({x} AS STRING)"
    return f"""SELECT p_partkey AS k, CASE p_partkey % 6 WHEN 0 THEN concat({s('p_size')}, '-', {s('p_size + 3')}, ',', {s('p_size + 1')}) WHEN 1 THEN concat({s('p_size + 4')}, '-', {s('p_size')})
WHEN 2 THEN concat({s('p_size')}, ',,', {s('p_size + 9')}) WHEN 3 THEN concat('-', {s('p_size % 6')}) WHEN 4 THEN '0' ELSE 'x, 7' END AS pages FROM @part"""


def _parts(d, keep: str = "true") -> str:
    """Comma-parted pieces with both ends as whole numbers, null where they aren't any."""
    return f"SELECT k, trim(p) AS p, TRY_CAST({d.extract('trim(p)', '^(-?[0-9]+) *(?:- *[0-9]+)?$', 1)} AS BIGINT) AS lo, TRY_CAST({d.extract('trim(p)', '^-?[0-9]+ *- *([0-9]+)$', 1)} AS BIGINT) AS hi FROM @v_ranges {d.each(d.split('pages', ','), 'p')} WHERE {keep}"


add("tx02_pages_api", lambda d: f"SELECT DISTINCT k, page FROM (SELECT k, least(lo, coalesce(hi, lo)) AS lo, greatest(lo, coalesce(hi, lo)) AS hi FROM ({_parts(d)}) p WHERE lo >= 0 AND p <> '') q {d.each(d.series('lo', 'hi'), 'page')}")
add("tx03_pages_ui", lambda d: f"SELECT DISTINCT k, page FROM (SELECT k, least(abs(lo), coalesce(hi, CASE WHEN lo < 0 THEN 0 ELSE lo END)) AS lo, greatest(abs(lo), coalesce(hi, CASE WHEN lo < 0 THEN 0 ELSE lo END)) AS hi FROM ({_parts(d)}) p WHERE lo IS NOT NULL) q {d.each(d.series('lo', 'hi'), 'page')} WHERE page > 0")
add("tx04_exact_name_dedupe", lambda d: f"SELECT name, pos FROM (SELECT p_type AS name, p_partkey AS pos, row_number() OVER (PARTITION BY lower(trim({d.replace_all('p_type', r'\s+', ' ')})) ORDER BY p_partkey) AS n FROM @part) t WHERE n = 1")
add("ag04_batches", lambda d: "SELECT doc_id, page, CAST(floor((row_number() OVER (PARTITION BY doc_id ORDER BY page) - 1) / 3) AS BIGINT) AS batch FROM (SELECT DISTINCT doc_id, page FROM @v_assay_long) t")
add("ag05_page_runs", lambda d: "SELECT doc_id, min(page) AS first_page, max(page) AS last_page, count(*) AS n_pages FROM (SELECT doc_id, page, page - row_number() OVER (PARTITION BY doc_id ORDER BY page) AS island FROM (SELECT DISTINCT doc_id, page FROM @v_assay_long) t) u GROUP BY doc_id, island")

HEAD = "CASE WHEN page % 3 = 1 THEN substring(text, 1, 20) END"
add("wn01_sticky_header", lambda d: f"SELECT doc_id, page, last_value(h) IGNORE NULLS OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS header FROM (SELECT doc_id, page, nullif({HEAD}, '') AS h FROM @v_lines) t" if d.spark else f"SELECT doc_id, page, last_value(h IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS header FROM (SELECT doc_id, page, nullif({HEAD}, '') AS h FROM @v_lines) t")
add("jn07_context_source", lambda d: f"SELECT t.doc_id, t.page, coalesce(p.h, t.before) AS header FROM (SELECT doc_id, page, h, planned, {'last_value(h) IGNORE NULLS' if d.spark else 'last_value(h IGNORE NULLS)'} OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT doc_id, page, nullif({HEAD}, '') AS h, page - 3 AS planned FROM @v_lines) a) t LEFT JOIN (SELECT doc_id, page, nullif({HEAD}, '') AS h FROM @v_lines) p ON t.doc_id = p.doc_id AND p.page = t.planned AND p.page < t.page")
add("wn02_continuation", lambda d: "SELECT doc_id, page, substring(lag(text) OVER (PARTITION BY doc_id ORDER BY page), 1, 120) AS context FROM @v_lines")
add("st01_union_distinct", lambda d: "SELECT doc_id, page, min(ord) AS ord FROM (SELECT doc_id, page, page AS ord FROM @v_assay_long WHERE flag = 'R' UNION ALL SELECT doc_id, page, 1000 + page FROM @v_assay_long WHERE flag <> 'R') t GROUP BY doc_id, page")
add("st02_set_difference", lambda d: "SELECT doc_id, page FROM @v_assay_long WHERE flag = 'N' EXCEPT SELECT doc_id, page FROM @v_assay_long WHERE flag = 'R'")
add("st05_page_flags", lambda d: "SELECT a.doc_id, a.page, b.page IS NOT NULL AS detected FROM (SELECT DISTINCT doc_id, page FROM @v_assay_long) a LEFT JOIN (SELECT DISTINCT doc_id, page FROM @v_assay_long WHERE flag = 'R') b ON a.doc_id = b.doc_id AND a.page = b.page")
add("jn11_missing_decisions", lambda d: "SELECT w.doc_id, w.page, CASE WHEN g.n IS NULL THEN 'missing' WHEN g.n > 1 THEN 'duplicate' END AS fault FROM (SELECT DISTINCT doc_id, page FROM @v_assay_long) w LEFT JOIN (SELECT doc_id, page, count(*) AS n FROM @v_assay_long WHERE flag <> 'A' GROUP BY doc_id, page) g ON w.doc_id = g.doc_id AND w.page = g.page WHERE g.n IS NULL OR g.n > 1")
add("jn12_work_list", lambda d: "SELECT c.doc_id, c.page, a.assay FROM (SELECT DISTINCT doc_id, page FROM @v_assay_long) c CROSS JOIN (SELECT DISTINCT concat('IC', CAST(r_regionkey AS STRING)) AS assay FROM @region) a")
add("src01_page_text", lambda d: f"SELECT doc_id, page, trim({d.replace_all('text', r'\s+', ' ')}) AS text FROM @v_lines")
add("src02_page_count", lambda d: "SELECT doc_id, count(*) AS n_pages FROM @v_lines GROUP BY doc_id")
add("src11_layout_blocks", lambda d: "SELECT page, box_id, row_number() OVER (PARTITION BY page ORDER BY y1, x1, box_id) AS place FROM @v_boxes")
add("so05_block_order", lambda d: "SELECT page, box_id, y1, x1, rank() OVER (PARTITION BY page ORDER BY y1, x1) AS place FROM @v_boxes")
add("tx43_page_delta", lambda d: "SELECT doc_id, page, CASE WHEN sum(a) > 0 AND sum(b) = 0 THEN 'removed' WHEN sum(a) = 0 THEN 'added' ELSE 'same' END AS change FROM (SELECT doc_id, page, CASE WHEN flag = 'A' THEN 1 ELSE 0 END AS a, CASE WHEN flag = 'A' THEN 0 ELSE 1 END AS b FROM @v_assay_long) t GROUP BY doc_id, page")


@catalogue.view("v_payloads")
def _payloads(d):
    return """SELECT l_orderkey AS doc_id, l_linenumber AS n, CASE l_orderkey % 3 WHEN 0 THEN concat('{"page_markdowns": ["', l_shipmode, ' a", "b ', CAST(l_linenumber AS STRING), ' "]}') WHEN 1 THEN concat('{"pages": [{"page_number": ', CAST(l_linenumber AS STRING), ', "markdown": " m', CAST(l_partkey AS STRING), ' "}]}') ELSE '{}' END AS payload FROM (SELECT *, l_returnflag AS l_shipmode FROM @lineitem) l"""


add("src05_payload_shredder", lambda d: (f"SELECT doc_id, n, CAST(i AS BIGINT) AS i, trim(m) AS markdown FROM (SELECT doc_id, n, from_json(payload, 'page_markdowns array<string>, pages array<struct<page_number:int,markdown:string>>') AS p FROM @v_payloads) t {d.each_at('coalesce(p.page_markdowns, transform(p.pages, x -> x.markdown), array())', 'i', 'm')}" if d.spark else
    "SELECT doc_id, n, i - 1 AS i, trim(m) AS markdown FROM (SELECT doc_id, n, unnest(ms) AS m, generate_subscripts(ms, 1) AS i FROM (SELECT doc_id, n, coalesce(CAST(json_extract(payload, '$.page_markdowns') AS VARCHAR[]), json_extract_string(payload, '$.pages[*].markdown')) AS ms FROM @v_payloads) t) u"))

ROW = r"^ *[|].*[|] *$"
RULE = r"^[|: -]+$"


@catalogue.view("v_table_lines")
def _table_lines(d):
    lines = f"SELECT doc_id, CAST(i AS BIGINT) AS line, trim(x) AS x FROM @v_tables {d.each_at(d.split('markdown', chr(10)), 'i', 'x')}"
    flags = f"SELECT doc_id, line, x, {d.matches('x', ROW)} AS is_row, {d.matches('x', RULE)} AS is_rule FROM ({lines}) a"
    return f"SELECT doc_id, line, x, is_row, is_rule, sum(CASE WHEN is_row THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line) AS island FROM ({flags}) b"


@catalogue.view("v_cells")
def _cells(d):
    rows = "SELECT doc_id, island, line, x, row_number() OVER (PARTITION BY doc_id, island ORDER BY line) AS r, count(*) OVER (PARTITION BY doc_id, island) AS n FROM @v_table_lines WHERE is_row AND NOT is_rule"
    strip = "trim(BOTH '|' FROM x)" if d.spark else "trim(x, '|')"
    return f"SELECT doc_id, CAST(island AS BIGINT) AS table_no, CAST(r AS BIGINT) AS row_no, CAST(c + 1 AS BIGINT) AS col_no, trim(cell) AS text FROM ({rows}) t {d.each_at(d.split(strip, '|'), 'c', 'cell')} WHERE n >= 2"


add("src09_pipe_tables", lambda d: "SELECT doc_id, table_no, row_no, col_no, text FROM @v_cells")
add("tx08_strip_tables", lambda d: "SELECT doc_id, line, CASE WHEN is_row OR is_rule THEN '[table]' ELSE x END AS x FROM (SELECT *, lag(is_row OR is_rule) OVER (PARTITION BY doc_id ORDER BY line) AS before FROM @v_table_lines) t WHERE NOT ((is_row OR is_rule) AND coalesce(before, false))")
add("tx10_line_predicates", lambda d: f"SELECT doc_id, line, is_row, is_rule, (length(x) - length(replace(x, '|', '')) >= 2 AND NOT {d.matches('x', '^(#|[*] )')}) AS is_table_line, {d.matches('x', '[0-9] *(nM|uM|%)')} AS has_value FROM @v_table_lines")
add("tx15_table_chunks", lambda d: "SELECT doc_id, table_no, row_no, CAST(floor((row_no - 2) / 12) AS BIGINT) AS chunk FROM (SELECT DISTINCT doc_id, table_no, row_no FROM @v_cells) t WHERE row_no >= 2")
