"""Task lists, queues and their state, contracts over decisions, sinks' relational parts."""

from __future__ import annotations

from ..plans import views  # noqa: F401
from ..plans.dialect import catalogue

add = catalogue.add
NOW = "CAST('1998-01-01 00:00:00' AS TIMESTAMP)"
SEARCH = "lower(concat_ws(' ', task_id, type, status, message, pdf_id, filename, error))"

add("fl06_task_filter", lambda d: f"SELECT task_id, status, type FROM @v_tasks WHERE contains({SEARCH}, 'step') AND status = 'running' AND updated_at >= CAST('1994-01-01' AS TIMESTAMP) AND updated_at < CAST('1997-12-31' AS TIMESTAMP) + INTERVAL 1 DAY")
add("ag06_state_counts", lambda d: "SELECT type, count(CASE WHEN status = 'running' THEN 1 END) AS running, count(CASE WHEN status = 'pending' THEN 1 END) AS pending, count(*) AS total FROM @v_tasks GROUP BY type")
add("so01_task_sort", lambda d: "SELECT task_id, row_number() OVER (PARTITION BY type ORDER BY updated_at DESC, n) AS place FROM @v_tasks")
add("src14_registry", lambda d: "SELECT f.task_id, coalesce(s.status, f.status) AS status, coalesce(s.message, f.message) AS message FROM @v_tasks f LEFT JOIN (SELECT task_id, upper(status) AS status, message FROM @v_tasks WHERE n % 3 = 0) s ON f.task_id = s.task_id")
add("src15_projected_json", lambda d: f"SELECT task_id, {d.json('params', 'pdf_id')} AS pdf_id, {d.json('params', 'lang')} AS lang FROM @v_tasks")
add("tx26_revision_hash", lambda d: f"SELECT type, sha1({d.join_rows("concat(task_id, ':', status)", '|', 'n')}) AS revision FROM @v_tasks GROUP BY type")
add("tx27_date_bounds", lambda d: f"SELECT k, {d.timestamp('s')} AS day_start, {d.timestamp('s')} + INTERVAL 1 DAY AS day_end FROM (SELECT n AS k, CASE WHEN n % 4 = 0 THEN 'not a day' ELSE concat('1995-0', CAST(n % 9 + 1 AS STRING), '-1', CAST(n % 10 AS STRING)) END AS s FROM @v_tasks) t")
add("tx39_params_compaction", lambda d: (f"SELECT task_id, {d.json('params', 'lang')} AS lang, CAST(size(from_json(get_json_object(params, '$.pages'), 'array<int>')) AS BIGINT) AS pages_count FROM @v_tasks" if d.spark else f"SELECT task_id, {d.json('params', 'lang')} AS lang, CAST(json_array_length(params, '$.pages') AS BIGINT) AS pages_count FROM @v_tasks"))
add("tx40_terminal_state", lambda d: "SELECT task_id, CASE WHEN status = 'completed' THEN 1e0 ELSE round(progress, 3) END AS progress, CASE WHEN status = 'completed' AND message LIKE 'Running%' THEN 'Completed' ELSE message END AS message FROM @v_tasks")
add("tx41_partition_key", lambda d: "SELECT k, coalesce(nullif(trim(split_part(fwd, ',', 1)), ''), host, 'unknown') AS partition_id FROM (SELECT n AS k, CASE n % 3 WHEN 0 THEN concat(' 10.0.0.', pdf_id, ', proxy') WHEN 1 THEN '' END AS fwd, CASE WHEN n % 2 = 0 THEN 'host' END AS host FROM @v_tasks) t")
add("tx31_prompt_render", lambda d: "SELECT task_id, replace(replace('task {{ID}} is {{STATUS}}', '{{ID}}', coalesce(task_id, '')), '{{STATUS}}', coalesce(status, '')) AS prompt FROM @v_tasks")
add("tx42_list_parse", lambda d: f"SELECT k, x, min(i) AS place FROM (SELECT k, CAST(i AS BIGINT) AS i, lower(trim(p)) AS x FROM (SELECT n AS k, {d.replace_all("concat(type, '; ', status, ', ', upper(status))", '[;,]', ';')} AS s FROM @v_tasks) t {d.each_at(d.split('s', ';'), 'i', 'p')}) u WHERE x <> '' GROUP BY k, x")
add("sm01_enqueue", lambda d: "SELECT partition_ord, count(*) AS waiting, min(seq) AS head FROM @v_queue GROUP BY partition_ord")
add("sm03_requeue_front", lambda d: "SELECT task_id, row_number() OVER (PARTITION BY partition_ord ORDER BY CASE WHEN seq % 100 = 7 THEN -seq ELSE seq END) AS place FROM @v_queue")
add("sm05_staleness", lambda d: f"SELECT task_id FROM @v_tasks WHERE status = 'running' AND updated_at < {NOW} - INTERVAL 300 SECOND")
add("sm07_status_machine", lambda d: "SELECT user_id, max_by(event_type, event_id) AS status, CASE WHEN max_by(event_type, event_id) IN ('purchase', 'completed') THEN 1e0 ELSE max_by(value, event_id) / 1000 END AS progress FROM @events GROUP BY user_id")
add("sm10_redelivery", lambda d: "SELECT event_id, user_id, event_type FROM (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM @events) t WHERE n = 1")
add("jn15_reconcile", lambda d: f"SELECT q.n, CASE WHEN t.task_id IS NULL THEN 'clear' WHEN t.status = 'completed' THEN 'clear' WHEN a.task_id IS NOT NULL THEN 'leave' WHEN t.updated_at < {NOW} - INTERVAL 300 SECOND THEN 'requeue' ELSE 'fail' END AS decision FROM (SELECT n, CAST(n + n % 2 AS STRING) AS task_id FROM @v_tasks) q LEFT JOIN @v_tasks t ON q.task_id = t.task_id LEFT JOIN (SELECT task_id FROM @v_tasks WHERE n % 5 = 0) a ON q.task_id = a.task_id")
add("snk04_audit_rows", lambda d: "SELECT event_id, event_type AS task_name, value > 50 AS ok, substring(props, 1, 2000) AS preview FROM @events")
add("snk05_zip_first_wins", lambda d: "SELECT filename, task_id FROM (SELECT filename, task_id, row_number() OVER (PARTITION BY filename ORDER BY n) AS k FROM @v_tasks) t WHERE k = 1")
add("snk06_metadata_report", lambda d: f"SELECT type, {d.join_rows("concat('- ', task_id, chr(10), '  unit: ', coalesce(nullif(error, ''), 'not specified'))", chr(10), 'n')} AS report FROM @v_tasks GROUP BY type")
add("snk09_markdown", lambda d: f"SELECT doc_id, {d.join_rows(d.replace_all('x', '([*_#])', '~$1'), chr(10), 'line')} AS markdown FROM @v_table_lines GROUP BY doc_id")
add("so03_top_k", lambda d: "SELECT page, box_id FROM (SELECT page, box_id, row_number() OVER (PARTITION BY page ORDER BY score DESC, box_id) AS n FROM @v_boxes WHERE score > 0.05) t WHERE n <= 5")

CONF = "lower(coalesce({}, ''))"


def violations(d) -> str:
    """Contract violations of a page decision (ML03)."""
    h, c, r = d.json("payload", "has_structure"), d.json("payload", "confidence"), d.json("payload", "reason")
    typed = "contains(payload, '\"has_structure\": true') OR contains(payload, '\"has_structure\": false')"
    q = d.lit
    checks = [f"CASE WHEN {h} IS NULL THEN {q('missing has_structure')} WHEN NOT ({typed}) THEN {q('has_structure must be boolean')} ELSE '' END", f"CASE WHEN {c} IS NULL THEN {q('missing confidence')} WHEN lower({c}) NOT IN ('low', 'medium', 'high') THEN {q('bad confidence')} ELSE '' END", f"CASE WHEN {r} IS NULL THEN {q('missing reason')} ELSE '' END"]
    return d.join(d.filter(d.array(*checks), "x", "x <> ''"), "; ")


add("ml03_contract", lambda d: f"SELECT event_id, {violations(d)} AS violations FROM @v_decisions")
add("ml08_detection_batches", lambda d: "SELECT event_id, CAST(floor((row_number() OVER (PARTITION BY page_group ORDER BY event_id) - 1) / 6) AS BIGINT) AS batch FROM @v_decisions")
add("fl08_routing", lambda d: "SELECT c.doc_id, c.page, a.assay FROM (SELECT DISTINCT doc_id, page FROM @v_assay_long) c JOIN (SELECT DISTINCT doc_id, assay FROM @v_assay_long WHERE flag = 'R') a ON a.doc_id = c.doc_id")
add("fl09_value_validity", lambda d: f"SELECT event_id FROM @v_decisions WHERE lower({d.json('payload', 'confidence')}) IN ('low', 'medium', 'high') AND trim({d.json('payload', 'reason')}) <> '' AND {d.json('payload', 'has_structure')} = 'true'")
add("fl10_page_support", lambda d: "SELECT DISTINCT a.doc_id, a.assay FROM @v_assay_long a WHERE NOT EXISTS (SELECT 1 FROM @v_assay_long m WHERE m.doc_id = a.doc_id AND m.assay = a.assay AND m.flag = 'R')")
add("fl07_review_filter", lambda d: "SELECT ord FROM @v_structures WHERE trim(compound_id) <> '' AND (contains(lower(compound_id), 'exam') OR contains(lower(smiles), 'red'))")
