"""DuckDB SQL for the correctness check.

Each oracle query is self-contained: it declares the derived inputs it needs as CTEs over the
pre-registered base tables, then states the operator's semantics in plain SQL.
"""

from __future__ import annotations

AS_OF_SQL = "TIMESTAMP '1998-06-01 00:00:00'"

VIEW_SQL = {
    "tasks": """
SELECT concat('t', cast(o_orderkey AS varchar)) AS task_id,
       concat('doc', cast(o_orderkey AS varchar),
              CASE o_orderkey % 8 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PNG' WHEN 2 THEN '.docx' WHEN 3 THEN '.html'
                                  WHEN 4 THEN '.tar.gz' WHEN 5 THEN '' WHEN 6 THEN '.jpeg' ELSE '.txt' END) AS file_name,
       CASE WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_orderstatus = 'O' THEN 'processing'
            WHEN o_custkey % 10 = 0 THEN 'failed' WHEN o_custkey % 10 = 1 THEN 'cancelled' ELSE 'completed' END AS status,
       5 - cast(substr(o_orderpriority, 1, 1) AS int) AS priority,
       CASE o_orderkey % 3 WHEN 0 THEN 'pipeline' WHEN 1 THEN 'vlm-transformers' ELSE 'vlm-vllm-engine' END AS backend,
       concat('{"lang":"', CASE o_orderkey % 2 WHEN 0 THEN 'ch' ELSE 'en' END, '"',
              CASE o_orderkey % 5 WHEN 0 THEN '' ELSE ',"method":"txt"' END, '}') AS options,
       CASE WHEN o_orderstatus = 'F' AND o_custkey % 10 > 1 AND o_orderkey % 5 <> 0
            THEN concat('/out/t', cast(o_orderkey AS varchar)) END AS result_path,
       CASE WHEN o_orderstatus = 'F' AND o_custkey % 10 = 0
            THEN concat('parse error ', cast(o_orderkey % 4 AS varchar)) END AS error_message,
       o_orderdate AS created_at,
       CASE WHEN o_orderstatus = 'O' OR (o_orderstatus = 'F' AND o_custkey % 10 <> 1)
            THEN o_orderdate + INTERVAL '1' MINUTE * cast(o_orderkey % 97 AS int) END AS started_at,
       CASE WHEN o_orderstatus = 'F' AND o_custkey % 10 <> 1
            THEN o_orderdate + INTERVAL '1' MINUTE * cast(o_orderkey % 97 + o_custkey % 240 AS int) END AS completed_at,
       CASE WHEN o_orderstatus = 'O' OR (o_orderstatus = 'F' AND o_custkey % 10 <> 1)
            THEN concat('wk-host-', cast(o_custkey % 3 AS varchar), '-cuda:', cast(o_custkey % 2 AS varchar),
                        '-', cast(1000 + o_custkey % 7 AS varchar)) END AS worker_id,
       cast(o_orderkey % 3 AS int) AS retry_count
FROM orders""",
    "task_events": """
SELECT event_id, concat('u', cast(user_id AS varchar)) AS task_id, ts,
       CASE WHEN event_type = 'signup' THEN 'submit' WHEN event_type = 'view' THEN 'claim'
            WHEN event_type = 'purchase' THEN 'complete' WHEN event_type = 'error' THEN 'fail'
            WHEN event_id % 10 = 0 THEN 'cancel' ELSE 'reset' END AS op,
       concat('w', cast(event_id % 4 AS varchar)) AS worker_id
FROM events""",
    "artifacts": """
SELECT t.task_id, k.kind,
       concat(t.result_path, '/doc/auto/', k.prefix, substr(t.task_id, 2), k.suffix) AS path,
       cast(100 + length(t.file_name) * k.n AS bigint) AS size
FROM tasks t CROSS JOIN (
  SELECT 'md' AS kind, 'doc' AS prefix, '.md' AS suffix, 1 AS n UNION ALL
  SELECT 'md', 'doc', '_layout.md', 2 UNION ALL
  SELECT 'content_list', 'doc', '_content_list.json', 3 UNION ALL
  SELECT 'middle_json', 'doc', '_middle.json', 4 UNION ALL
  SELECT 'model_output', 'doc', '_model.json', 5 UNION ALL
  SELECT 'image', 'images/', '_1.JPG', 6 UNION ALL
  SELECT 'image', 'images/', '_0.png', 7 UNION ALL
  SELECT 'other', 'images/', '_2.tmp', 8 UNION ALL
  SELECT 'image', 'images/', '_3.jpg', 9) k
WHERE t.result_path IS NOT NULL AND cast(substr(t.task_id, 2) AS bigint) % 11 <> 0""",
    "result_files": """
SELECT task_id, kind, path, octet_length(content)::bigint AS size, modified_at, content
FROM (
  SELECT a.task_id, a.kind, a.path,
         TIMESTAMP '1998-06-01 00:00:00' - INTERVAL '1' MINUTE * cast(a.num % 1440 AS int) AS modified_at,
         CASE a.kind WHEN 'md' THEN encode(coalesce(c.markdown, '')) WHEN 'content_list' THEN encode(coalesce(c.cl, ''))
              WHEN 'middle_json' THEN encode(coalesce(c.mj, ''))
              WHEN 'model_output' THEN encode(CASE WHEN a.num % 7 = 0 THEN substr(c.model, 1, 9) ELSE c.model END)
              WHEN 'image' THEN unhex(CASE WHEN ends_with(a.path, '.png') THEN '89504E47' ELSE 'FFD8FF' END) || encode(coalesce(c.text, ''))
              ELSE encode('') END AS content
  FROM (SELECT *, cast(substr(task_id, 2) AS bigint) AS num FROM artifacts) a
  LEFT JOIN doc_content c ON a.num % (SELECT count(*) FROM documents) = c.doc_id)""",
    "doc_content": """
SELECT d.doc_id, d.text, to_json({'lang': d.lang, 'n_chars': d.n_chars})::varchar AS model, b.markdown, b.cl, p.mj
FROM documents d
LEFT JOIN (SELECT doc_id,
             string_agg(CASE type WHEN 'heading' THEN repeat('#', level) || ' ' || text WHEN 'list_item' THEN '- ' || text
                        WHEN 'equation' THEN '$$' || text || '$$' ELSE text END, chr(10) || chr(10) ORDER BY block_idx) AS markdown,
             '[' || string_agg(to_json({'block_idx': block_idx, 'type': type, 'level': level, 'text': text})::varchar, ','
                               ORDER BY block_idx) || ']' AS cl
           FROM doc_blocks GROUP BY doc_id) b ON d.doc_id = b.doc_id
LEFT JOIN (SELECT doc_id, '{"doc_id":' || doc_id || ',"pages":[' ||
             string_agg('{"page_idx":' || page_idx || ',"blocks":[' || bl || ']}', ',' ORDER BY page_idx) || ']}' AS mj
           FROM (SELECT doc_id, block_idx // 20 AS page_idx,
                        string_agg(to_json({'block_idx': block_idx, 'type': type, 'text': text})::varchar, ',' ORDER BY block_idx) AS bl
                 FROM doc_blocks GROUP BY doc_id, block_idx // 20) GROUP BY doc_id) p ON d.doc_id = p.doc_id""",
    "doc_blocks": """
SELECT doc_id, cast(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS int) AS block_idx,
       CASE WHEN regexp_matches(line, '^#{1,6} +') THEN 'heading'
            WHEN starts_with(line, '- ') OR starts_with(line, '* ') THEN 'list_item'
            WHEN starts_with(line, '|') THEN 'table'
            WHEN starts_with(line, '$$') AND ends_with(line, '$$') AND length(line) > 4 THEN 'equation' ELSE 'paragraph' END AS type,
       CASE WHEN regexp_matches(line, '^#{1,6} +') THEN length(regexp_extract(line, '^#{1,6}')) ELSE 0 END AS level,
       CASE WHEN regexp_matches(line, '^#{1,6} +') THEN regexp_replace(line, '^#{1,6} +', '')
            WHEN starts_with(line, '- ') OR starts_with(line, '* ') THEN substr(line, 3)
            WHEN starts_with(line, '$$') AND ends_with(line, '$$') AND length(line) > 4 THEN substr(line, 3, length(line) - 4)
            ELSE line END AS text
FROM (SELECT doc_id, i, regexp_replace(l, '^[ \\t\\r]+|[ \\t\\r]+$', '', 'g') AS line
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i
            FROM documents)) WHERE line <> ''""",
    "md_docs": """
SELECT page_id AS doc_id,
       concat('# Page ', cast(page_id AS varchar), ' intro ![fig ', cast(page_id % 7 AS varchar), '](images/',
              cast(page_id AS varchar), '_0.png) then ![](http://x.example/', cast(page_id AS varchar),
              '_9.png) inline $a_', cast(page_id % 5 AS varchar), '$ and $$E=mc^', cast(page_id % 3 AS varchar), '$$ end') AS md,
       CASE WHEN page_id % 4 = 0 THEN NULL ELSE concat(cast(page_id AS varchar), '_0.png') END AS image_name
FROM pages""",
    "topic": """
SELECT concat('u', cast(user_id AS varchar)) AS key, props AS value, 'events' AS topic,
       cast(user_id % 3 AS int) AS partition,
       cast(row_number() OVER (PARTITION BY user_id % 3 ORDER BY ts, event_id) - 1 AS bigint) AS "offset",
       ts AS timestamp
FROM events""",
    "rq": "SELECT item_id AS query_id, text AS query FROM benchmark",
}

_DEPS = {"artifacts": ["tasks"], "doc_content": ["doc_blocks"], "result_files": ["artifacts", "doc_content"]}


def with_views(body: str, *names: str) -> str:
    """Prefix ``body`` with CTEs for the derived views it reads (dependencies first)."""
    order: list[str] = []

    def add(n: str) -> None:
        for d in _DEPS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    if not order:
        return body.strip()
    ctes = ",\n".join(f"{n} AS ({VIEW_SQL[n].strip()})" for n in order)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ctes + ",\n" + body[len("WITH RECURSIVE"):].lstrip()
    if body.upper().startswith("WITH"):
        return "WITH " + ctes + ",\n" + body[4:].lstrip()
    return "WITH " + ctes + "\n" + body
