"""DuckDB SQL for the results of those queries that SQL can express in full."""

from __future__ import annotations

_REACH = """reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
lowest AS (SELECT a, min(b) AS b FROM reach GROUP BY a)"""

OP1 = r"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, count(*) OVER (PARTITION BY conv_id) AS n,
15 + length(replace(replace(regexp_replace(role, '<(/?)(\\*)turn', '<\1\2\\turn', 'g'), '%', '%25'), '>', '%3E')) + length(regexp_replace(text, '<(/?)(\\*)turn', '<\1\2\\turn', 'g')) AS size FROM t),
p AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
sum(upto) FILTER (role = 'assistant' OR k = n) AS formatted_chars FROM p GROUP BY conv_id"""

OP6 = f"""WITH RECURSIVE fit AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM fit a JOIN fit b ON a.vec_id < b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links), {_REACH}
SELECT e.vec_id, (SELECT count(*) FROM both_ways l WHERE l.a = e.vec_id) AS n_links, least(e.vec_id, coalesce(c.b, e.vec_id)) AS component_id, e.vec_id <= coalesce(c.b, e.vec_id) AS kept
FROM embeddings e LEFT JOIN lowest c ON c.a = e.vec_id"""

OP7 = f"""WITH RECURSIVE words AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingle AS MATERIALIZED (SELECT DISTINCT doc_id, md5(array_to_string(w[i : i + 4], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
links AS MATERIALIZED (SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM shingle x JOIN shingle y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2) p JOIN sizes m ON m.doc_id = p.a JOIN sizes n ON n.doc_id = p.b WHERE 100 * i >= 85 * (m.n + n.n - i)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links), {_REACH}
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.b, d.doc_id)) AS component_id, d.doc_id <= coalesce(c.b, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes z ON z.doc_id = d.doc_id LEFT JOIN lowest c ON c.a = d.doc_id"""

OP8 = r"""WITH w AS MATERIALIZED (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)),
g AS (SELECT doc_id, p, word, list(word) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS win FROM w),
k AS (SELECT doc_id, p, word, CASE WHEN len(win) = 20 THEN md5(array_to_string(win, ' ')) END AS win FROM g),
r AS (SELECT doc_id, p, word, win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id, p) > 1 AS again FROM k),
c AS (SELECT doc_id, p, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM r),
s AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS m, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_words, coalesce(m, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id"""

_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11 = rf"""WITH pieces AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_FOLDED}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
words AS (SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces WHERE len(w) > 0),
f AS MATERIALIZED (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS a FROM starts, range(1, 6) t(k) WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, phrase, a, k AS size, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT c.lang, c.phrase, c.a, x.a AS l, y.a AS r, n, c.k, (CAST(1000 AS HUGEINT) * c.a * n) // (CAST(x.a AS HUGEINT) * y.a) AS score
FROM (SELECT *, unnest(range(1, size)) AS k FROM c) c JOIN words ON words.lang = c.lang JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : c.k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1 :], ' ')),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT DISTINCT s.lang, s.phrase FROM (SELECT lang, a, size, i, array_to_string(w[i : j], ' ') AS phrase FROM c, range(1, 6) t(i), range(1, 6) u(j) WHERE j > i AND j <= size AND j - i + 1 < size) s JOIN c ON c.lang = s.lang AND c.phrase = s.phrase WHERE 100 * s.a >= 100 * c.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM lowest WHERE (lang, phrase) NOT IN (SELECT lang, phrase FROM inside) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000"""

OP12 = f"""SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, {_FOLDED} AS t FROM documents) WINDOW g AS (PARTITION BY t)"""

#: CRC-32 of a decimal number, byte by byte: SQL has no function of that name.
_CRC_STEP = "CASE WHEN x % 2 = 1 THEN xor(x >> 1, CAST(3988292384 AS BIGINT)) ELSE x >> 1 END"

OP13 = f"""WITH RECURSIVE digits AS (SELECT c AS conv_id, CAST(c AS VARCHAR) AS s, 1 AS i, CAST(4294967295 AS BIGINT) AS x, 8 AS bits FROM (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL)
UNION ALL SELECT conv_id, s, CASE WHEN bits = 8 THEN i + 1 ELSE i END, CASE WHEN bits = 8 THEN xor(x, CAST(ascii(s[i]) AS BIGINT)) ELSE {_CRC_STEP} END, CASE WHEN bits = 8 THEN 0 ELSE bits + 1 END FROM digits WHERE bits < 8 OR i <= len(s)),
heads AS (SELECT conv_id, conv_id - conv_id % 100 AS family, xor(x, CAST(4294967295 AS BIGINT)) % 6 AS h FROM digits WHERE bits = 8 AND i = len(s) + 1),
t AS (SELECT conv_id, length(coalesce(text, '')) AS chars, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS turn,
row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p FROM conversations WHERE conv_id IS NOT NULL),
rebuilt AS (SELECT h.conv_id, t.p, t.turn, t.chars FROM heads h JOIN t ON t.conv_id = h.family AND t.p <= h.h UNION ALL SELECT h.conv_id, t.p, t.turn, t.chars FROM heads h JOIN t ON t.conv_id = h.conv_id AND t.p > h.h),
listed AS (SELECT h.conv_id, coalesce(list(r.turn ORDER BY p) FILTER (r.turn IS NOT NULL), []) AS turns, coalesce(list(r.chars ORDER BY p) FILTER (r.turn IS NOT NULL), []) AS chars FROM heads h LEFT JOIN rebuilt r ON r.conv_id = h.conv_id GROUP BY h.conv_id),
paths AS MATERIALIZED (SELECT conv_id, d AS depth, md5(array_to_string(turns[1 : d], '')) AS key, CASE WHEN d > 0 THEN md5(array_to_string(turns[1 : d - 1], '')) END AS parent, CASE WHEN d > 0 THEN chars[d] ELSE 0 END AS chars, d = len(turns) AS ends FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM listed)),
nodes AS MATERIALIZED (SELECT key, depth, any_value(parent) AS parent, any_value(chars) AS chars, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '') AS ends FROM paths GROUP BY key, depth),
counted AS MATERIALIZED (SELECT n.*, (SELECT count(*) FROM nodes c WHERE c.parent = n.key) AS n_children FROM nodes n),
sums AS (SELECT p.key, sum((n.n_convs - 1) * n.chars) AS saved, count(*) FILTER (n.n_children = 0) AS leaves FROM counted n JOIN paths p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY p.key)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, q.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM counted n JOIN sums s ON s.key = n.key LEFT JOIN nodes q ON q.key = n.parent"""

SQL = {"op1_chat_formatting": OP1, "op6_embedding_near_dedup": OP6, "op7_minhash_near_dedup": OP7, "op8_substring_dedup": OP8, "op11_phrase_collocations": OP11, "op12_exact_dedup": OP12, "op13_conversation_trie": OP13}
