"""DuckDB SQL for the queries that SQL can express, by the name of the query."""

op2_substring_dedup = r"""
WITH w AS (
    SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS word,
           generate_subscripts(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), 1) AS i
    FROM documents
),
v AS (
    SELECT doc_id, i, string_agg(word, ' ') OVER part AS passage, count(*) OVER part AS n
    FROM w WINDOW part AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)
),
r AS (
    SELECT doc_id, i, row_number() OVER (PARTITION BY passage ORDER BY doc_id, i) > 1 AS again
    FROM v WHERE n = 20
),
c AS (
    SELECT w.doc_id, w.i, w.word, coalesce(max(r.again::INT) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) AS cut
    FROM w LEFT JOIN r ON r.doc_id = w.doc_id AND r.i = w.i
),
t AS (
    SELECT doc_id, count(*) AS n_words, sum(cut)::BIGINT AS n_removed,
           coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE cut = 0), '') AS kept
    FROM c GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id
"""

op8_embedding_near_dedup = r"""
WITH RECURSIVE v AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (
    SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.98
),
reach(u, w) AS (
    SELECT vec_id, vec_id FROM embeddings
    UNION
    SELECT reach.u, links.w FROM reach JOIN links ON reach.w = links.u
)
SELECT e.vec_id, coalesce((SELECT count(*) FROM links WHERE u = e.vec_id), 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN (SELECT u, min(w) AS component_id FROM reach GROUP BY u) c ON c.u = e.vec_id
"""

op9_chat_formatting = r"""
WITH m AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length(replace(replace(replace(role, '\', '\s'), '<', '\l'), '|', '\p')) + length(replace(replace(text, '\', '\s'), '<', '\l')) + 13)::BIGINT AS formatted_chars
FROM m GROUP BY conv_id
"""

op6_benchmark_decontamination = r"""
WITH t AS (
    SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark
),
w AS (
    SELECT kind, id, list_filter(string_split_regex(regexp_replace(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]', ' ', 'g'), ' +'), lambda x: x <> '') AS words FROM t
),
items AS (
    SELECT id AS item_id, least(5, len(words)) AS n, words FROM w WHERE kind = 'i' AND len(words) > 0
),
s AS (
    SELECT DISTINCT item_id, n, array_to_string(words[i:i + n - 1], ' ') AS shingle
    FROM (SELECT item_id, n, words, unnest(range(1, len(words) - n + 2)) AS i FROM items)
),
sizes AS (SELECT item_id, count(*) AS n_shingles FROM s GROUP BY item_id),
d AS (
    SELECT DISTINCT id AS doc_id, n, array_to_string(words[i:i + n - 1], ' ') AS shingle
    FROM (SELECT id, n, words, unnest(range(1, len(words) - n + 2)) AS i FROM w, (SELECT DISTINCT n FROM items) WHERE kind = 'd' AND len(words) >= n)
)
SELECT doc_id, item_id, n_shingles, count(*) AS n_shared, count(*) / n_shingles AS containment
FROM d JOIN s USING (n, shingle) JOIN sizes USING (item_id)
GROUP BY doc_id, item_id, n_shingles HAVING count(*) >= 0.8 * n_shingles
"""
