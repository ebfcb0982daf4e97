"""DuckDB SQL with the results of the catalogue's queries."""

DOCS = """docs AS (
    SELECT doc_id AS id,
           CASE WHEN doc_id % 17 = 0 THEN '' WHEN doc_id % 23 = 0 THEN 'Untitled' ELSE 'Doc ' || (doc_id % 400) END AS title,
           text AS content, NULLIF(CAST(substr(source, 4) AS INTEGER), 0) AS folder_id, doc_id % 11 <> 10 AS is_active,
           TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS created_at,
           CASE WHEN doc_id % 3 <> 0 THEN TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) + to_hours(doc_id % 7) END AS updated_at
    FROM documents)"""
FOLDERS = """folders AS (
    SELECT CAST(1 + r_regionkey AS INTEGER) AS id, r_name AS title, CAST(NULL AS INTEGER) AS parent_id, true AS is_active FROM region
    UNION ALL
    SELECT CAST(6 + n_nationkey AS INTEGER), n_name, CAST(1 + n_regionkey AS INTEGER), n_nationkey % 11 <> 10 FROM nation)"""
CHANGES = f"""{DOCS}, changes AS (
    SELECT id, 1 AS version, 'create' AS op, title, content, folder_id, true AS title_set, true AS content_set, true AS folder_id_set, true AS is_active, created_at AS ts FROM docs
    UNION ALL
    SELECT id, 2, 'patch', NULL, 'v2: ' || content, NULL, false, true, id % 8 = 0, NULL, created_at + INTERVAL 1 DAY FROM docs WHERE id % 4 = 0
    UNION ALL
    SELECT id, 3, 'delete', NULL, NULL, NULL, false, false, false, false, created_at + INTERVAL 2 DAY FROM docs WHERE id % 11 = 10)"""
LATEST = f"""{CHANGES}, latest AS (
    SELECT id, arg_max({{'v': title}}, version) FILTER (WHERE title_set) AS t, arg_max({{'v': content}}, version) FILTER (WHERE content_set) AS c,
           arg_max({{'v': folder_id}}, version) FILTER (WHERE folder_id_set) AS f, arg_max(is_active, version) FILTER (WHERE is_active IS NOT NULL) AS is_active,
           max(version) AS version, min(ts) AS created_at, max(ts) FILTER (WHERE version > 1) AS updated_at
    FROM changes GROUP BY id)"""
WS = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{0b}]"
ISO = "'%Y-%m-%dT%H:%M:%S'"
HITS = f"""{DOCS}, cv AS (
    SELECT vec_id, id AS doc_id, content AS page_content, title AS source, CAST(embedding AS DOUBLE[]) AS e, is_active
    FROM embeddings JOIN docs ON vec_id = id WHERE is_active), hits AS (
    SELECT * FROM (
        SELECT q.vec_id AS query_id, c.*, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_sum(list_transform(list_zip(q.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), c.vec_id) AS rank
        FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 50 = 0) q JOIN cv c ON c.vec_id <> q.vec_id)
    WHERE rank <= 3)"""
CONTEXT = f"""{HITS}, firsts AS (
    SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS n FROM hits), ctx AS (
    SELECT query_id, string_agg(page_content, chr(10) || chr(10) ORDER BY rank) AS context FROM hits GROUP BY query_id), src AS (
    SELECT query_id, string_agg(source || ': ' || substr(page_content, 1, 100) || '...', chr(10) ORDER BY rank) AS sources, count(*) AS n_sources
    FROM firsts WHERE n = 1 GROUP BY query_id)"""
ANSWER = "'Answer the question from the notes below. Say so if they do not hold the answer.' || chr(10) || chr(10) || 'Notes:' || chr(10) || context || chr(10) || chr(10) || 'Question: ' || question"
CHUNKS = """SELECT id AS doc_id, CAST(i AS INTEGER) AS chunk_no, substr(content, CAST(1 + 800 * i AS BIGINT), 1000) AS page_content, title AS source
    FROM {rows}, unnest(range(0, 1 + (greatest(length(content) - 200, 1) - 1) // 800)) AS u(i) WHERE content <> ''"""

ORACLES = {
    "doc_list": f"WITH {DOCS} SELECT id, title, substr(content, 1, 200) AS content, folder_id, created_at, updated_at FROM docs WHERE is_active ORDER BY updated_at DESC NULLS LAST, id",
    "doc_get": f"WITH {DOCS} SELECT id, title, content, folder_id FROM docs WHERE id = 7 AND is_active",
    "doc_missing": f"WITH {DOCS} SELECT id, title, content, folder_id FROM docs WHERE id = 10 AND is_active",
    "doc_home": f"WITH {DOCS} SELECT id, title, substr(content, 1, 200) AS content FROM docs WHERE is_active ORDER BY updated_at DESC NULLS LAST, id LIMIT 1",
    "doc_newest": f"WITH {DOCS} SELECT id, title FROM docs WHERE is_active",
    "doc_json": f"""WITH {DOCS} SELECT id, to_json({{'id': id, 'title': title, 'content': substr(content, 1, 200), 'folder_id': folder_id, 'created_at': strftime(created_at, {ISO}),
        'updated_at': strftime(updated_at, {ISO})}})::VARCHAR AS json FROM docs WHERE is_active""",
    "doc_json_read": f"WITH {DOCS} SELECT id, title, content, folder_id, strftime(created_at, {ISO}) AS created_at, strftime(updated_at, {ISO}) AS updated_at FROM docs",
    "doc_insert": f"""WITH {DOCS} SELECT id, 1 AS version, 'create' AS op, title, content, folder_id, true AS title_set, true AS content_set, true AS folder_id_set, true AS is_active,
        strftime(created_at, {ISO}) AS ts FROM docs""",
    "active_chunks": f"WITH {DOCS}, chunks AS ({CHUNKS.format(rows='docs')}) SELECT * FROM chunks WHERE doc_id IN (SELECT id FROM docs WHERE is_active)",
    "index_delete": f"WITH {DOCS}, chunks AS ({CHUNKS.format(rows='docs')}) SELECT * FROM chunks WHERE doc_id % 4 <> 0",
    "folder_insert": f"""WITH {FOLDERS} SELECT id, title, parent_id, is_active FROM folders UNION ALL SELECT CAST(id + 100 AS INTEGER), title || ' 2', parent_id, true FROM folders WHERE is_active""",
    "chat_prompt": """WITH m AS (SELECT conv_id, arg_max(text, turn) AS q FROM conversations GROUP BY conv_id)
        SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN 'Answer the question from the notes below. Say so if they do not hold the answer.' || chr(10) || chr(10) || 'Notes:' || chr(10) || 'none' || chr(10) || chr(10) || 'Question: ' || q
        ELSE 'Answer the question.' || chr(10) || chr(10) || 'Question: ' || q END AS prompt FROM m WHERE trim(q) <> ''""",
    "save_status": """WITH e AS (SELECT user_id AS doc_id, ts, event_id FROM events WHERE event_id % 13 <> 0), g AS (
        SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY doc_id ORDER BY ts, event_id) > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM e), s AS (
        SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY ts, event_id) AS no FROM g), b AS (
        SELECT doc_id, max(ts) + INTERVAL 30 MINUTE AS start_ts, count(*) AS n FROM s GROUP BY doc_id, no), v AS (
        SELECT doc_id, start_ts, start_ts + to_seconds(n * 10) AS end_ts, n % 4 <> 0 AS ok FROM b), w AS (SELECT max(ts) AS present FROM events), l AS (
        SELECT doc_id, max({'s': start_ts, 'e': end_ts, 'ok': ok}) AS last FROM v, w WHERE start_ts <= present GROUP BY doc_id), d AS (
        SELECT user_id AS doc_id, max(ts) AS edit_ts FROM events GROUP BY user_id)
        SELECT d.doc_id, CASE WHEN last IS NULL OR edit_ts > last.s THEN 'unsaved' WHEN present < last.e THEN 'saving' WHEN last.ok THEN 'saved' ELSE 'error' END AS status
        FROM d LEFT JOIN l USING (doc_id), w""",
    "folder_all": f"WITH {FOLDERS} SELECT id, title, parent_id FROM folders WHERE is_active",
    "folder_get": f"WITH {FOLDERS} SELECT id, title, parent_id FROM folders WHERE id = 16",
    "folder_contents_root": f"""WITH {DOCS}, {FOLDERS} SELECT 'folder' AS kind, CAST(id AS BIGINT) AS id, title FROM folders WHERE is_active AND parent_id IS NULL
        UNION ALL SELECT 'document', id, title FROM docs WHERE is_active AND folder_id IS NULL""",
    "folder_contents_child": f"""WITH {DOCS}, {FOLDERS} SELECT 'folder' AS kind, CAST(id AS BIGINT) AS id, title FROM folders WHERE is_active AND parent_id IS NOT DISTINCT FROM 2
        UNION ALL SELECT 'document', id, title FROM docs WHERE is_active AND folder_id IS NOT DISTINCT FROM 2""",
    "doc_with_folder": f"WITH {DOCS}, {FOLDERS} SELECT d.id, d.title, d.folder_id, f.title AS folder_title FROM docs d LEFT JOIN folders f ON d.folder_id = f.id",
    "folder_paths": f"""WITH RECURSIVE {FOLDERS}, tree AS (SELECT id, title AS path, 0 AS depth FROM folders WHERE parent_id IS NULL
        UNION ALL SELECT f.id, t.path || '/' || f.title, t.depth + 1 FROM folders f JOIN tree t ON f.parent_id = t.id) SELECT id, path, depth FROM tree""",
    "preview_ellipsis": f"WITH {DOCS} SELECT id, substr(content, 1, 100) || '...' AS preview FROM docs",
    "title_display": f"""WITH {DOCS} SELECT id, coalesce(nullif(title, ''), 'Untitled') AS shown, CASE WHEN lower(title) IN ('untitled', 'untitled document') THEN '' ELSE title END AS normal,
        coalesce(nullif(content, ''), 'No content') AS body FROM docs""",
    "context_truncate": f"""WITH {DOCS}, cut AS (SELECT id, left(content, length(content) // 2) AS prefix, substr(content, length(content) // 2 + 1) AS suffix, content FROM docs)
        SELECT id, right(prefix, 1000) AS prefix_kept, left(suffix, 200) AS suffix_kept, right(right(prefix, 1000), 500) AS prompt_prefix, left(suffix, 500) AS suffix_wide, right(prefix, 2000) AS prefix_wide,
        trim(substr(content, length(content) // 2 + 1, 50), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' AS at_end FROM cut""",
    "first_phrase": rf"WITH {DOCS} SELECT id, regexp_split_to_array(regexp_replace(content, '^{WS}+', ''), '[，,。！!？?;；\n]')[1] AS phrase FROM docs",
    "overlap_strip": """WITH c AS (SELECT conv_id, turn, left(text, 2 * (length(text) // 3)) AS prefix, substr(text, length(text) // 3 + 1) AS made FROM conversations)
        SELECT conv_id, turn, substr(made, 1 + coalesce(list_max(list_filter(range(1, least(length(made), length(prefix)) + 1), lambda n: left(made, n) = right(prefix, n))), 0)) AS kept FROM c""",
    "text_stats": rf"""WITH {DOCS}, cut AS (SELECT id, content, left(content, length(content) // 2) AS before FROM docs)
        SELECT id, CAST(length(content) AS INTEGER) AS n_chars, CAST(len(list_filter(regexp_split_to_array(content, '{WS}+'), lambda w: w <> '')) AS INTEGER) AS n_words,
        CAST(len(string_split(before, chr(10))) AS INTEGER) AS line, CAST(length(string_split(before, chr(10))[-1]) + 1 AS INTEGER) AS col FROM cut""",
    "markdown_like": rf"""WITH {DOCS}, m AS (SELECT id, content, regexp_matches(content, '^({WS}*#{{1,6}}{WS}|{WS}*>|{WS}*[-*]{WS}|{WS}*\d+\.{WS}|`{{3}})') AS is_markdown FROM docs)
        SELECT id, is_markdown, is_markdown AND (html IS NULL OR html = '' OR length(html) < length(content) * 1.5) AS as_markdown FROM m LEFT JOIN pages ON page_id = id""",
    "cache_key": "SELECT conv_id, 'rag:response:' || md5(arg_max(text, turn)) AS key FROM conversations GROUP BY conv_id",
    "date_display": f"""WITH {DOCS} SELECT id, strftime(updated_at, {ISO}) AS updated_iso, coalesce(strftime(updated_at + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S'), '') AS updated_local,
        strftime(coalesce(updated_at, TIMESTAMP '2024-06-01 00:00:00') + INTERVAL 8 HOUR, '%Y/%m/%d %H:%M:%S') AS listed, strftime(coalesce(updated_at, created_at), {ISO}) AS touched FROM docs""",
    "knn_top3": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), d AS (
        SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS dist FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
        SELECT query_id, vec_id, round(dist, 6) AS dist, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM d) WHERE rank <= 3""",
    "rag_context": f"""WITH {CONTEXT}, asked AS (SELECT query_id, context, sources, n_sources, 'What is known about vector ' || query_id || '?' AS question FROM ctx JOIN src USING (query_id))
        SELECT query_id, context, sources, CAST(n_sources AS INTEGER) AS n_sources, {ANSWER} AS prompt FROM asked""",
    "rag_answer": f"""WITH {CONTEXT}, asked AS (SELECT query_id, context, 'What is known about vector ' || query_id || '?' AS question FROM ctx)
        SELECT query_id, 'rag:response:' || md5(question) AS cache_key, CASE WHEN query_id % 400 = 200 THEN 'cached ' || query_id ELSE 'stub ' || md5({ANSWER}) END AS reply,
        CASE WHEN query_id % 400 = 200 THEN 'cached' ELSE 'ok' END AS status FROM asked""",
    "rag_cache_fill": f"""WITH {CONTEXT}, asked AS (SELECT query_id, context, 'What is known about vector ' || query_id || '?' AS question FROM ctx)
        SELECT 'rag:response:' || md5(question) AS key, 'put' AS op, '2024-06-01T00:00:00' AS ts, 'stub ' || md5({ANSWER}) AS value, 3600 AS ttl_s FROM asked WHERE query_id % 400 <> 200""",
    "chunks_fixed": f"WITH {DOCS} {CHUNKS.format(rows='docs')}",
    "chunk_counts": f"WITH {DOCS}, chunks AS ({CHUNKS.format(rows='docs')}) SELECT doc_id, count(*) AS n_chunks FROM chunks GROUP BY doc_id",
    "doc_patch": f"""WITH {CHANGES} SELECT d.id, d.title, CASE WHEN p.id IS NOT NULL THEN p.content ELSE d.content END AS content, CASE WHEN p.folder_id_set THEN NULL ELSE d.folder_id END AS folder_id,
        strftime(coalesce(p.ts, d.updated_at), {ISO}) AS updated_at FROM docs d LEFT JOIN (SELECT * FROM changes WHERE op = 'patch') p ON p.id = d.id""",
    "doc_soft_delete": f"""WITH {DOCS} SELECT id, is_active AND id % 5 <> 0 AS is_active, strftime(CASE WHEN is_active AND id % 5 = 0 THEN TIMESTAMP '2024-06-01 00:00:00' ELSE updated_at END, {ISO}) AS updated_at FROM docs""",
    "doc_latest": f"WITH {LATEST} SELECT id, t.v AS title, c.v AS content, f.v AS folder_id, is_active, version, strftime(created_at, {ISO}) AS created_at, strftime(updated_at, {ISO}) AS updated_at FROM latest",
    "index_sync": f"""WITH {LATEST}, w AS (SELECT id, max(version) AS version FROM changes WHERE content_set GROUP BY id), rows AS (
        SELECT l.id, l.t.v AS title, l.c.v AS content, w.version FROM latest l JOIN w ON w.id = l.id WHERE l.is_active), chunks AS ({CHUNKS.format(rows='rows')})
        SELECT c.*, r.version FROM chunks c JOIN rows r ON r.id = c.doc_id""",
    "index_pile": f"""WITH {LATEST}, rows AS (SELECT h.id, l.t.v AS title, h.content, h.version FROM changes h JOIN latest l ON l.id = h.id WHERE h.content_set AND l.is_active)
        SELECT id AS doc_id, CAST(i AS INTEGER) AS chunk_no, substr(content, CAST(1 + 800 * i AS BIGINT), 1000) AS page_content, title AS source, version
        FROM rows, unnest(range(0, 1 + (greatest(length(content) - 200, 1) - 1) // 800)) AS u(i) WHERE content <> ''""",
    "audit_rows": f"""WITH {CHANGES} SELECT 'system' AS user_id, strftime(ts, {ISO}) AS timestamp, CASE op WHEN 'create' THEN 'CREATE_DOC' WHEN 'patch' THEN 'UPDATE_DOC' ELSE 'DELETE_DOC' END AS action,
        'DOCUMENT' AS resource_type, CAST(id AS VARCHAR) AS resource_id, 'version ' || version AS details, 'SUCCESS' AS status FROM changes""",
    "system_logs": """SELECT event_id AS id, CAST(user_id AS VARCHAR) AS user_id, event_type AS action, 'DOCUMENT' AS resource_type, json_extract_string(props, '$.k') AS resource_id, props AS details,
        CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'SUCCESS' END AS status FROM events""",
    "request_durations": """SELECT event_id AS id, CASE WHEN event_id % 9 = 0 THEN '/static/x' WHEN event_id % 9 = 1 THEN '/health' ELSE '/documents/' || user_id END AS url,
        CAST(round(value * 1000) AS BIGINT) / 1000.0 AS duration_ms FROM events WHERE event_id % 9 NOT IN (0, 1)""",
    "debounced_saves": f"""WITH e AS (SELECT user_id AS doc_id, ts, event_id, event_type || event_id AS content FROM events WHERE event_id % 13 <> 0), g AS (
        SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY doc_id ORDER BY ts, event_id) > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM e), s AS (
        SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY ts, event_id) AS no FROM g)
        SELECT doc_id, strftime(min(ts), {ISO}) AS first_ts, strftime(max(ts), {ISO}) AS last_ts, arg_max(content, {{'ts': ts, 'id': event_id}}) AS content, count(*) AS n_edits FROM s GROUP BY doc_id, no""",
    "latest_requests": "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id",
    "ttl_reads": """WITH o AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN {'ts': ts, 'value': value, 'put': true} WHEN event_id % 7 = 3 THEN {'ts': ts, 'value': value, 'put': false} END AS op FROM events), s AS (
        SELECT *, last_value(op IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM o), r AS (
        SELECT *, coalesce(seen.put AND ts <= seen.ts + INTERVAL 1 HOUR, false) AS hit FROM s WHERE event_id % 3 <> 0 AND event_id % 7 <> 3)
        SELECT event_id AS op_id, event_type AS key, hit, CASE WHEN hit THEN seen.value END AS value FROM r""",
    "list_cache_reads": f"""WITH {CHANGES}, o AS (SELECT event_id AS op_id, ts, value, event_id % 4 = 0 AS put, event_id % 4 <> 0 AS get FROM events
        UNION ALL SELECT -(id * 10 + version), ts, NULL, false, false FROM changes), s AS (
        SELECT *, last_value(CASE WHEN NOT get THEN {{'ts': ts, 'value': value, 'put': put}} END IGNORE NULLS) OVER (ORDER BY ts, op_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM o), r AS (
        SELECT *, coalesce(seen.put AND ts <= seen.ts + INTERVAL 300 SECOND, false) AS hit FROM s WHERE get)
        SELECT op_id, 'documents_list' AS key, hit, CASE WHEN hit THEN seen.value END AS value FROM r""",
    "completion_triggers": """WITH e AS (SELECT user_id AS doc_id, ts + to_microseconds(125000 * (event_id % 4)) AS ts, event_id, event_type FROM events), g AS (
        SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY doc_id ORDER BY ts, event_id) > INTERVAL 250 MILLISECOND THEN 1 ELSE 0 END AS fresh FROM e), s AS (
        SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY ts, event_id) AS no FROM g)
        SELECT doc_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%g') AS last_ts, arg_max(event_type, {'ts': ts, 'id': event_id}) AS content, count(*) AS n_edits FROM s GROUP BY doc_id, no""",
    "body_defaults": "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text ELSE '' END AS content FROM conversations",
    "completion_urls": """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'http://local/v1/completions' ELSE rtrim(url, '/') || '/completions' END AS address FROM pages""",
    "date_parsed": """SELECT event_id, CASE event_id % 4 WHEN 3 THEN '' ELSE strftime(date_trunc('second', ts) + to_hours(CASE WHEN event_id % 4 = 2 THEN 6 ELSE 8 END), '%Y-%m-%d %H:%M:%S') END AS shown FROM events""",
    "completion_postprocess": rf"""WITH r AS (SELECT conv_id, turn, CASE turn % 3 WHEN 2 THEN '' ELSE text END AS reply FROM conversations)
        SELECT conv_id, turn, regexp_split_to_array(regexp_replace(reply, '^{WS}+', ''), '[，,。！!？?;；\n]')[1] AS completion FROM r""",
    "ask_plain": """SELECT conv_id, 'stub ' || md5('Answer the question.' || chr(10) || chr(10) || 'Question: ' || arg_max(text, turn)) AS reply, 'ok' AS status FROM conversations GROUP BY conv_id""",
    "polish_text": f"WITH {DOCS} SELECT id, 'stub ' || md5('Improve the wording of this text and keep its meaning and Markdown.' || chr(10) || chr(10) || content) AS reply, 'ok' AS status FROM docs",
    "extend_text": f"WITH {DOCS} SELECT id, 'stub ' || md5('Continue this text in its own style.' || chr(10) || chr(10) || content) AS reply, 'ok' AS status FROM docs",
    "complete_text": f"""WITH {DOCS} SELECT id, 'stub ' || md5('Fill the gap with a short phrase.' || chr(10) || 'Before: ' || right(left(content, length(content) // 2), 500) || chr(10) || 'After: ' || left(substr(content, length(content) // 2 + 1), 200)) AS completion FROM docs""",
    "completion_budget": """WITH p AS (SELECT conv_id, turn, string_split(text || CASE turn % 3 WHEN 0 THEN chr(10) || '```python' || chr(10) || 'x = 1' WHEN 1 THEN chr(10) || '```sql' || chr(10) || 'SELECT 1' ELSE '' END, '```') AS parts FROM conversations)
        SELECT conv_id, turn, CASE WHEN len(parts) > 1 AND contains(parts[-1], 'python') THEN 128 ELSE 64 END AS max_tokens FROM p""",
}
