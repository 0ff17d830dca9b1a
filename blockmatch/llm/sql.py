"""DuckDB SQL for the queries that SQL can express."""

SQL = {
    "op3_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               row_number() OVER (PARTITION BY t ORDER BY doc_id DESC) = 1 AS kept, sha256(t) AS text_sha256
        FROM d WINDOW g AS (PARTITION BY t)
    """,
    "op6_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
        h AS (SELECT page_id, t, sha1(t) AS x, max(page_id) OVER (PARTITION BY t) AS top FROM p),
        n AS (SELECT *, flatten([[(CAST('0x' || substr(x, 5 * i + 1, 5) AS BIGINT) >> s) & 31 FOR s IN [15, 10, 5, 0]]
                                 FOR i IN range(8)]) AS five_bits FROM h)
        SELECT page_id, octet_length(encode(t)) AS payload_bytes,
               array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', k + 1, 1) FOR k IN five_bits], '') AS payload_digest,
               CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> top THEN top END AS refers_to, CAST(NULL AS VARCHAR) AS problem
        FROM n
    """,
    "op1_near_dedup": """
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^ \\t\\n\\x0B\\f\\r]+') AS words FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
                ELSE list_distinct([array_to_string(words[i : i + 3], ' ') FOR i IN range(1, len(words) - 2)]) END AS shingles FROM w),
        n AS (SELECT doc_id, len(shingles) AS n FROM s),
        x AS (SELECT doc_id, unnest(shingles) AS shingle FROM s),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM x a JOIN x b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
        e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 80 * (na.n + nb.n - common)),
        r AS (SELECT doc_id, doc_id AS other FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other),
        c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
        SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c USING (doc_id)
    """,
    "op10_decontamination": """
        WITH t AS (SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
        w AS (SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                  '[^ \\t\\n\\x0B\\f\\r]+') AS words FROM t),
        s AS (SELECT kind, id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
                ELSE list_distinct([array_to_string(words[i : i + 4], ' ') FOR i IN range(1, len(words) - 3)]) END AS shingles FROM w),
        d AS (SELECT id AS doc_id, unnest(shingles) AS shingle FROM s WHERE kind = 0),
        b AS (SELECT id AS item_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s WHERE kind = 1),
        h AS (SELECT doc_id, item_id FROM d JOIN b USING (shingle) GROUP BY doc_id, item_id, n HAVING 100 * count(*) >= 80 * n),
        g AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS item_ids FROM h GROUP BY doc_id)
        SELECT doc_id, coalesce(n_items, 0) AS n_items, coalesce(item_ids, '') AS item_ids, n_items IS NOT NULL AS contaminated
        FROM documents LEFT JOIN g USING (doc_id)
    """,
}
