"""SQL for the numbered queries that it can express, over whole tables."""

from strandlake.llm import chat, codes, warc

NEAR_DUPLICATES = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM words WHERE len(w) > 0),
sets AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM places),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, b FROM ways UNION SELECT r.a, e.b FROM reach r JOIN ways e ON e.a = r.b),
low AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, d.doc_id <= coalesce(m, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN low USING (doc_id)
"""

NEAR_VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL),
u AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.93),
reach AS (SELECT a, b FROM links UNION SELECT r.a, e.b FROM reach r JOIN links e ON e.a = r.b),
low AS (SELECT a AS vec_id, min(b) AS m FROM reach GROUP BY 1), n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY 1)
SELECT t.vec_id, coalesce(n, 0)::BIGINT AS n_links, least(t.vec_id, coalesce(m, t.vec_id)) AS component_id, t.vec_id <= coalesce(m, t.vec_id) AS kept FROM embeddings t LEFT JOIN n USING (vec_id) LEFT JOIN low USING (vec_id)
"""

ORACLES = {"op2_chat_preferences": chat.ORACLE, "op7_multi_index": NEAR_VECTORS, "op10_minhash": NEAR_DUPLICATES, "op11_vector_codes": codes.ORACLE, "op13_warc": warc.ORACLE}
