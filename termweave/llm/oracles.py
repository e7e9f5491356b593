"""SQL that gives the rows of those queries that SQL can express, written independently of how the operators work."""

WORDS = r"list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

CONTAINED = f"""
WITH d AS (SELECT doc_id, {WORDS.format(text="lower(coalesce(text, ''))")} AS w FROM documents),
i AS (SELECT item_id, {WORDS.format(text="lower(coalesce(text, ''))")} AS w FROM benchmark),
dg AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) AS g FROM d)),
ig AS (SELECT DISTINCT item_id, g FROM (SELECT item_id, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) AS g FROM i)),
n AS (SELECT item_id, count(*) AS n FROM ig GROUP BY 1)
SELECT doc_id, ig.item_id, any_value(n)::BIGINT AS n_shingles, count(*)::BIGINT AS n_found
FROM ig JOIN dg ON ig.g = dg.g JOIN n ON n.item_id = ig.item_id GROUP BY doc_id, ig.item_id HAVING 5 * count(*) >= 4 * any_value(n)
"""

PASSAGES = f"""
WITH d AS (SELECT doc_id, {WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
k AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS s, unnest(list_transform(range(1, len(w) - 18), lambda s: array_to_string(w[s:s + 19], ' '))) AS g FROM d),
r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS place FROM k),
g AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM r WHERE place > 1),
e AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
j AS (SELECT e.doc_id, count(*) AS n, count(g.i) AS gone, string_agg(x, ' ' ORDER BY e.i) FILTER (WHERE g.i IS NULL) AS kept FROM e LEFT JOIN g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN j ON d.doc_id = j.doc_id
"""

VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
n AS (SELECT a, count(*) AS n FROM links GROUP BY 1),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM v LEFT JOIN n ON n.a = vec_id JOIN c ON c.a = vec_id
"""

LINES = f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS place FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, place, line, list_sort(list_distinct({WORDS.format(text="line")})) AS toks FROM l),
s AS (SELECT row_number() OVER (ORDER BY doc_id, place) AS sid, * FROM (SELECT toks, min(doc_id) AS doc_id, min_by(place, (doc_id, place)) AS place FROM t WHERE len(toks) > 0 GROUP BY toks)),
e AS (SELECT sid, len(toks) AS n, unnest(toks) AS tok FROM s),
f AS (SELECT tok, count(*) AS df FROM e GROUP BY 1),
p AS (SELECT sid, n, e.tok, row_number() OVER (PARTITION BY sid ORDER BY df, e.tok) AS i FROM e JOIN f ON e.tok = f.tok),
x AS (SELECT * FROM p WHERE i <= n - (4 * n + 4) // 5 + 1),
c AS (SELECT DISTINCT a.sid AS late, b.sid AS early FROM x a JOIN x b ON a.tok = b.tok AND b.sid < a.sid AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
g AS (SELECT DISTINCT late FROM c JOIN s a ON a.sid = late JOIN s b ON b.sid = early WHERE 9 * len(list_intersect(a.toks, b.toks)) >= 4 * (len(a.toks) + len(b.toks))),
k AS (SELECT t.doc_id, t.place, line, len(t.toks) = 0 OR (s.doc_id = t.doc_id AND s.place = t.place AND late IS NULL) AS stays FROM t LEFT JOIN s ON s.toks = t.toks LEFT JOIN g ON late = sid),
o AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT stays) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE stays), '') AS kept FROM k GROUP BY 1)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN o ON o.doc_id = d.doc_id
"""

SQL = {"op3_decontamination": CONTAINED, "op4_substring_dedup": PASSAGES, "op6_embedding_dedup": VECTORS, "op8_line_dedup": LINES}
