"""Stand-ins for the inputs, made from the test tables by the same text on both engines."""

from __future__ import annotations

from .dialect import catalogue

view = catalogue.view

#: A row number of lineitem from the row itself, without a window over the table: order, line,
#: part and supplier tell its rows apart (up to 100,000 parts and 10,000 suppliers; beyond that
#: two rows of one line could share a number).
ORD = "(((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey)"


@view("v_structures")
def _structures(d):
    k = "CAST(p_partkey AS STRING)"
    form = f"CASE p_partkey % 6 WHEN 0 THEN concat('Example ', {k}) WHEN 1 THEN concat('Compound ', {k}) WHEN 2 THEN {k} WHEN 3 THEN concat('No. ', {k}) WHEN 4 THEN concat('(', {k}, ')') ELSE concat('Intermediate ', {k}) END"
    rest = "p_name AS smiles, CAST(p_size AS BIGINT) AS page_num, p_brand AS brand, p_type AS kind, p_partkey AS k"
    return f"SELECT CAST(p_partkey * 10 AS BIGINT) AS ord, {form} AS compound_id, {rest} FROM @part UNION ALL SELECT CAST(p_partkey * 10 + 1 AS BIGINT), concat('Formula ', {k}), {rest} FROM @part WHERE p_partkey % 10 = 0"


@view("v_assay_long")
def _assay_long(d):
    k = "CAST(l_partkey AS STRING)"
    return f"""SELECT {ORD} AS ord, CAST(l_linenumber AS BIGINT) AS page,
concat('IC', CAST(l_linenumber AS STRING)) AS assay,
CASE (l_partkey + l_linenumber) % 4 WHEN 0 THEN {k} WHEN 1 THEN concat('Example ', {k}) WHEN 2 THEN concat('(', {k}, ')') ELSE concat('Compound ', {k}) END AS raw_id,
concat(CAST(CAST(l_quantity AS BIGINT) AS STRING), ' nM') AS value, l_returnflag AS flag, l_orderkey AS doc_id, l_partkey AS k FROM @lineitem"""


@view("v_tasks")
def _tasks(d):
    return """SELECT CAST(o_orderkey AS STRING) AS task_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'pending' END AS status,
lower(o_orderpriority) AS type, least(1e0, o_totalprice / 400000) AS progress, CASE WHEN o_orderkey % 7 = 0 THEN 'Running step 3' WHEN o_orderkey % 5 = 0 THEN '' ELSE concat('Order of ', CAST(o_custkey AS STRING)) END AS message,
concat('{"pdf_id": "', CAST(o_custkey AS STRING), '", "lang": "en", "pages": [1, ', CAST(o_orderkey % 30 AS STRING), ']}') AS params,
CAST(o_custkey AS STRING) AS pdf_id, concat('f', CAST(o_custkey % 100 AS STRING), '.pdf') AS filename, CASE WHEN o_orderkey % 11 = 0 THEN 'failed' ELSE '' END AS error,
o_orderkey AS n, o_orderdate AS updated_at FROM @orders"""


@view("v_queue")
def _queue(d):
    return "SELECT c_custkey AS seq, concat('t', CAST(c_custkey AS STRING)) AS task_id, CAST(c_nationkey AS BIGINT) AS partition_ord, CASE WHEN c_mktsegment = 'BUILDING' THEN 'structure' ELSE 'assay' END AS task_name FROM @customer"


@view("v_lines")
def _lines(d):
    return f"SELECT doc_id, CAST(i + 1 AS BIGINT) AS page, line AS text FROM @documents {d.each_at(d.split('text', chr(10)), 'i', 'line')}"


@view("v_tables")
def _tables(d):
    row = "concat('| ', CAST(l_partkey AS STRING), ' | ', CAST(CAST(l_quantity AS BIGINT) AS STRING), ' nM | ', l_returnflag, ' |')"
    return f"""SELECT doc_id, 1 AS page, concat('Results of ', CAST(doc_id AS STRING), chr(10), '| id | IC50 | flag |', chr(10), '|---|:--:|---|', chr(10), body, chr(10), 'text after', chr(10), '| x | y |', chr(10), 'end') AS markdown
FROM (SELECT l_orderkey AS doc_id, {d.join_rows(row, chr(10), 'l_linenumber, l_partkey, l_suppkey, l_shipdate')} AS body FROM @lineitem GROUP BY l_orderkey) t"""


@view("v_boxes")
def _boxes(d):
    """Boxes of the lines of 1,500 orders to a document of 50 pages, so that pages don't grow with the data."""
    return f"""SELECT CAST(floor(l_orderkey / 1500) AS BIGINT) * 50 + l_orderkey % 50 AS page, {ORD} AS box_id,
(l_partkey * 37) % 700 AS y1, (l_suppkey * 53) % 500 AS x1, (l_partkey * 37) % 700 + 10 + l_linenumber * 13 AS y2, (l_suppkey * 53) % 500 + 8 + CAST(l_quantity AS BIGINT) AS x2, l_discount * 10 AS score FROM @lineitem"""


@view("v_decisions")
def _decisions(d):
    return """SELECT event_id, user_id AS page_group, event_id % 40 AS page, event_type,
CASE event_id % 7 WHEN 0 THEN concat('{"has_structure": "true", "confidence": "high", "reason": "r', CAST(event_id AS STRING), '"}')
WHEN 1 THEN concat('{"has_structure": true, "confidence": "HIGH", "reason": "ok"}')
WHEN 2 THEN concat('{"has_structure": false, "confidence": "medium"}')
WHEN 3 THEN concat('{"has_structure": true, "confidence": "sure", "reason": "x", "page": ', CAST(event_id % 40 AS STRING), '}')
WHEN 4 THEN '{}' ELSE concat('{"has_structure": true, "confidence": "low", "reason": "seen", "page": ', CAST(event_id % 41 AS STRING), '}') END AS payload FROM @events"""


@view("v_candidates")
def _candidates(d):
    return """SELECT CAST(p_size AS BIGINT) AS page, concat('p', CAST(p_size AS STRING), '/s', CAST(p_partkey AS STRING)) AS ref, CASE p_partkey % 4 WHEN 0 THEN 'markush' WHEN 1 THEN 'fragment' WHEN 2 THEN 'complete' ELSE 'text_substituent' END AS structure_type,
concat('R', CAST(p_partkey % 5 + 1 AS STRING)) AS variable_position, p_name AS smiles, p_partkey AS k FROM @part"""


@view("v_relations")
def _relations(d):
    return f"""SELECT l_orderkey AS record_id, concat('Example ', CAST(l_suppkey AS STRING)) AS compound_id, concat('p', CAST(p.p_size AS STRING), '/s', CAST(l_partkey AS STRING)) AS scaffold_ref,
concat('R', CAST(l_linenumber AS STRING)) AS variable_position, CASE WHEN l_returnflag = 'R' THEN 'ready' ELSE 'partial' END AS assembly_status, CASE WHEN l_tax < 0.03 THEN 'low' WHEN l_tax < 0.06 THEN 'medium' ELSE 'high' END AS confidence,
CAST(l_linenumber AS BIGINT) AS page, {ORD} AS ord FROM @lineitem JOIN @part p ON l_partkey = p.p_partkey"""
