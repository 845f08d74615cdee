"""Values and units, pivots with writer rules, merges of structures with assays, corrections."""

from __future__ import annotations

from ..plans.dialect import Dialect, catalogue
from ..plans.views import ORD
from . import ids  # noqa: F401

add = catalogue.add
VALUE = r"^([<>≤≥~≈]? *-?[0-9]+(?:[.][0-9]+)?(?: *[x×] *10\^?-?[0-9]+)?) *([A-Za-zμµ%/][A-Za-z0-9μµ%/.-]*)$"
ASSAYS = [f"IC{k}" for k in range(1, 8)]


def value_of(d: Dialect, x: str) -> str:
    return f"CASE WHEN {d.matches(f'trim({x})', VALUE)} THEN replace({d.extract(f'trim({x})', VALUE, 1)}, ' ', '') ELSE trim({x}) END"


def unit_of(d: Dialect, x: str) -> str:
    return d.extract(f"trim({x})", VALUE, 2)


def column_of(d: Dialect, name: str, unit: str) -> str:
    """Column name of an assay with its unit (TX20)."""
    base = f"coalesce(nullif(trim({name}), ''), 'Assay')"
    tail = f"concat('(', {unit}, ')')"
    return f"CASE WHEN {unit} = '' OR right({base}, length({tail})) = {tail} THEN {base} ELSE concat({base}, ' ', {tail}) END"


@catalogue.view("v_values")
def _values(d):
    q = "CAST(CAST(l_quantity AS BIGINT) AS STRING)"
    forms = [f"concat({q}, ' nM')", f"concat('< ', {q}, '.5 µM')", "'++'", "'ND'", q, f"concat('1.', {q}, ' x 10^-3 M')", f"concat({q}, '%')", "''"]
    return f"SELECT {ORD} AS ord, CASE l_partkey % 8 {' '.join(f'WHEN {i} THEN {f}' for i, f in enumerate(forms))} END AS value, CASE l_linenumber % 3 WHEN 0 THEN 'IC50 (nM)' WHEN 1 THEN 'Ki' ELSE '' END AS assay FROM @lineitem"


add("tx19_value_unit", lambda d: f"SELECT ord, {value_of(d, 'value')} AS value, {unit_of(d, 'value')} AS unit FROM @v_values")
add("tx20_column_name", lambda d: f"SELECT ord, {column_of(d, 'assay', unit_of(d, 'value'))} AS name FROM @v_values")


def _pivot(source: str, how: str) -> str:
    cells = ", ".join(f"{how.format(a=a)} AS {a}" for a in ASSAYS)
    return f"SELECT canonical, {cells} FROM {source} GROUP BY canonical"


WIDE = _pivot("@v_remapped", "max_by(CASE WHEN assay = '{a}' THEN value END, CASE WHEN assay = '{a}' THEN ord END)")
add("ag02_records_pivot", lambda d: f"SELECT canonical, name, max_by(value, ord) AS value, min_by(flag, ord) AS first_flag FROM (SELECT r.canonical, {column_of(d, 'l.assay', unit_of(d, 'l.value'))} AS name, {value_of(d, 'l.value')} AS value, l.ord, l.flag FROM @v_assay_long l JOIN @v_resolved r ON l.raw_id = r.raw WHERE r.canonical <> '') t GROUP BY canonical, name")
add("ag03_structure_dedupe", lambda d: "SELECT ord, compound_id, smiles FROM (SELECT *, row_number() OVER (PARTITION BY concat(compound_id, '_', smiles) ORDER BY ord) AS n FROM (SELECT ord, compound_id, smiles FROM @v_structures UNION ALL SELECT ord + 5, compound_id, smiles FROM @v_structures WHERE k % 3 = 0) s) t WHERE n = 1")
add("jn02_exact_merge", lambda d: "SELECT s.ord, s.compound_id, a.value FROM @v_structures s LEFT JOIN (SELECT raw_id, max_by(value, ord) AS value FROM @v_assay_long GROUP BY raw_id) a ON s.compound_id = a.raw_id")
add("jn03_full_outer", lambda d: "SELECT coalesce(s.compound_id, a.raw_id) AS id, s.ord, a.value, s.compound_id IS NULL AS assay_only FROM @v_structures s FULL OUTER JOIN (SELECT raw_id, max_by(value, ord) AS value FROM @v_assay_long WHERE raw_id <> '' GROUP BY raw_id) a ON s.compound_id = a.raw_id")
add("jn05_page_anchors", lambda d: "SELECT page, k, compound_id FROM (SELECT a.page, s.ord AS k, s.compound_id, row_number() OVER (PARTITION BY a.page ORDER BY s.ord) AS n FROM (SELECT DISTINCT page FROM @v_assay_long) a JOIN @v_structures s ON a.page = s.page_num) t WHERE n <= 12")
add("jn06_reference_keys", lambda d: "SELECT r.ord, r.scaffold_ref, c.structure_type, c.smiles FROM @v_relations r LEFT JOIN (SELECT ref, max_by(structure_type, k) AS structure_type, max_by(smiles, k) AS smiles FROM @v_candidates GROUP BY ref) c ON r.scaffold_ref = c.ref")
add("jn08_text_matches_id", lambda d: f"SELECT DISTINCT t.doc_id, t.page, o.r AS id FROM (SELECT doc_id, page, w FROM (SELECT doc_id, page, lower(text) AS x FROM @v_lines) l {d.each(d.extract_all('x', '[a-z0-9]+'), 'w')}) t JOIN (SELECT lower(n_name) AS r FROM @nation UNION SELECT 'license' UNION SELECT 'the') o ON t.w = o.r")
add("jn10_allow_list", lambda d: "SELECT ord, raw_id, value FROM @v_assay_long l WHERE EXISTS (SELECT 1 FROM @v_structures s WHERE s.compound_id = l.raw_id)")

FIXES = f"SELECT l_orderkey AS doc_id, l_linenumber AS n, {ORD} AS ord, CASE WHEN l_returnflag = 'R' THEN 'replace' ELSE 'uncertain' END AS action, CASE WHEN l_tax < 0.03 THEN 'low' WHEN l_tax < 0.06 THEN 'medium' ELSE 'high' END AS confidence, CASE WHEN l_linestatus = 'O' THEN '' ELSE concat(CAST(l_partkey AS STRING), ' nM') END AS visual_value FROM @lineitem"
GOOD = f"SELECT doc_id, n, max_by(visual_value, ord) AS fixed FROM ({FIXES}) f WHERE action = 'replace' AND confidence = 'high' AND visual_value <> '' GROUP BY doc_id, n"
add("jn13_corrections", lambda d: f"SELECT v.ord, coalesce(g.fixed, v.value) AS value, g.fixed IS NOT NULL AS changed FROM @v_assay_long v LEFT JOIN ({GOOD}) g ON v.doc_id = g.doc_id AND v.page = g.n")
add("jn14_verifier_merge", lambda d: f"SELECT v.ord, coalesce(nullif(f.visual_value, ''), v.value) AS value, v.value AS original FROM @v_assay_long v JOIN ({FIXES}) f ON v.ord = f.ord WHERE f.confidence <> 'low'")
add("ml09_visual_review", lambda d: f"SELECT ord, CASE WHEN action = 'replace' AND confidence <> 'high' THEN 'uncertain' ELSE action END AS action, confidence, visual_value FROM ({FIXES}) f")
add("st04_report_concat", lambda d: f"SELECT doc_id, n, action FROM ({FIXES}) a WHERE action = 'replace' UNION ALL SELECT doc_id, n, action FROM ({FIXES}) b WHERE confidence = 'low'")
add("wn09_writer_rules", lambda d: "SELECT assay, canonical, max_by(value, page) AS value FROM @v_remapped GROUP BY assay, canonical")
add("ag09_column_set", lambda d: "SELECT name, row_number() OVER (ORDER BY CASE name WHEN 'COMPOUND_ID' THEN 0 WHEN 'SMILES' THEN 1 ELSE 2 END, name) AS place FROM (SELECT DISTINCT assay AS name FROM @v_assay_long UNION SELECT 'SMILES' UNION SELECT 'COMPOUND_ID') t")
add("ag11_edge_argmax", lambda d: "SELECT a, b, max_by(k, p * 1000 - k) AS best, round(max(p), 6) AS p FROM (SELECT x.a, x.b, x.k, (x.p + coalesce(y.p, 0)) / 2 AS p FROM (SELECT p_size AS a, p_partkey % 10 AS b, p_partkey % 7 AS k, max(p_retailprice) AS p FROM @part GROUP BY p_size, p_partkey % 10, p_partkey % 7) x LEFT JOIN (SELECT p_size AS b, p_partkey % 10 AS a, CASE p_partkey % 7 WHEN 5 THEN 6 WHEN 6 THEN 5 ELSE p_partkey % 7 END AS k, max(p_retailprice) AS p FROM @part GROUP BY p_size, p_partkey % 10, CASE p_partkey % 7 WHEN 5 THEN 6 WHEN 6 THEN 5 ELSE p_partkey % 7 END, p_partkey % 7) y ON x.a = y.a AND x.b = y.b AND x.k = y.k) e GROUP BY a, b")
add("ag12_confidence", lambda d: "SELECT l_orderkey AS id, round(exp(avg(ln((l_quantity + 1) / 60))), 6) AS geo FROM @lineitem GROUP BY l_orderkey")
add("ag13_meters", lambda d: "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(sum(value * (event_id % 5 + 1)) / sum(event_id % 5 + 1), 6) AS weighted FROM @events GROUP BY event_type")
add("ag14_bond_lengths", lambda d: f"SELECT l_orderkey AS id, coalesce(round(avg(x), 6), 1.2) AS mean_length, coalesce(round({d.median('x')}, 6), 1.2) AS median_length FROM (SELECT l_orderkey, CASE WHEN l_discount > 0.01 THEN l_discount END AS x FROM @lineitem) t GROUP BY l_orderkey")
add("ag07_multiplicity", lambda d: "SELECT compound_id, variable_position, count(*) AS n FROM @v_relations WHERE assembly_status = 'ready' GROUP BY compound_id, variable_position HAVING count(*) > 1")
add("st03_intersection", lambda d: f"SELECT record_id, {d.join(d.common('a', 'b'), ',')} AS shared FROM (SELECT record_id, {d.split('max(va)', ' ')} AS a, {d.split('max(vb)', ' ')} AS b FROM (SELECT record_id, concat('R', CAST(min(page) AS STRING), ' R', CAST(max(page) AS STRING)) AS va, concat('R', CAST(max(page) AS STRING), ' R9') AS vb FROM @v_relations GROUP BY record_id) s GROUP BY record_id) t")
