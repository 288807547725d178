"""DuckDB SQL for the queries of this subpackage that SQL can express."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _low(c: str) -> str:
    return f"translate(coalesce({c}, ''), '{UPPER}', '{LOWER}')"


OP1 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_low('text')}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') || ' ' || len(w) ELSE array_to_string(list_slice(w, i, i + 3), ' ') END AS g
  FROM w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) x(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 85 * (x.n + y.n - k)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.c, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS c FROM r GROUP BY 1) m USING (doc_id)
"""

_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

OP2 = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({_low('text')}, {_WORDS}) AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, list_slice(w, i, i + 7) AS t FROM b, unnest(range(1, greatest(len(w) - 7, 1) + 1)) x(i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT len(t) AS k FROM win),
d AS (SELECT doc_id, regexp_extract_all({_low('text')}, {_WORDS}) AS w FROM documents),
pos AS (SELECT doc_id, i, k, list_slice(w, i, i + k - 1) AS t FROM d, lens, unnest(range(1, len(w) - k + 2)) x(i)),
hit AS (SELECT doc_id, i, k, item_id FROM pos JOIN win USING (t)),
h AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)
"""


def _escaped(c: str) -> str:
    return rf"length(regexp_replace({c}, '(\\|<\||</?s>|\[/?INST\]|<</?SYS>>)', '\1x', 'g'))"


OP8 = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
s AS (SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS said FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(sum(length(said)) AS BIGINT) AS loss_chars, sha256(string_agg(said, '' ORDER BY turn)) AS loss_sha256,
  CAST(sum(23 + {_escaped('role')} + {_escaped('text')}) AS BIGINT) AS formatted_chars
FROM s GROUP BY 1
"""

OP6 = "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents"
