"""SQL of the training-data queries, as far as SQL can express them."""

from __future__ import annotations

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

#: Words of the documents that are left after the deletes, by source and language; revisions collapse white space, which changes no words.
WORDS_V1 = f"""
WITH l AS (SELECT doc_id FROM labels GROUP BY 1 HAVING max(toxic) = 1)
SELECT source, lang, 'words_v1' AS tokenizer_version, count(*) AS n_docs, CAST(sum(len({_WORDS.format("coalesce(text, '')")})) AS BIGINT) AS n_tokens
FROM documents WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM l WHERE doc_id IS NOT NULL) GROUP BY 1, 2
"""

#: All pairs that share a shingle are counted; components by walking the links. For small tables only: the driver runs it on a thousand documents.
JACCARD = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents
), sets AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w
), sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), lowest AS (SELECT a, min(b) AS b FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(b, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN lowest l ON l.a = d.doc_id
"""

_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"""(list_sum(list_transform(range(len({_DIGITS})), lambda i: CASE WHEN i % 2 = 0 THEN CAST(substr(reverse({_DIGITS}), i + 1, 1) AS INT)
  WHEN CAST(substr(reverse({_DIGITS}), i + 1, 1) AS INT) > 4 THEN 2 * CAST(substr(reverse({_DIGITS}), i + 1, 1) AS INT) - 9 ELSE 2 * CAST(substr(reverse({_DIGITS}), i + 1, 1) AS INT) END)) % 10 = 0)"""

#: The base spans of personal data, counted by kind.
PII_COUNTS = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS n_email,
  len(list_filter(regexp_extract_all(text, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), lambda m: len(list_filter(string_split(m, '.'), lambda p: len(ltrim(p, '0')) > 3 OR coalesce(TRY_CAST(p AS INT), 0) > 255)) = 0)) AS n_ip,
  len(list_filter(regexp_extract_all(text, '[0-9]([\x20-]?[0-9])+'), lambda m: len({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN})) AS n_card,
  len(list_filter(regexp_extract_all(text, '\+[0-9][\x20().0-9-]+[0-9]'), lambda m: len({_DIGITS}) BETWEEN 9 AND 15)) AS n_phone
FROM t
"""

#: CRC-32 of the id as text, bit by bit; texts without a letter have no language.
LANGUAGE_PARTS = r"""
WITH t AS (
  SELECT doc_id, text, list_reduce(list_concat([4294967295], flatten(list_transform(range(1, len(CAST(doc_id AS VARCHAR)) + 1),
    lambda i: [CAST(ord(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c // 2, 3988292384 * (c % 2)) END) AS c
  FROM documents
)
SELECT doc_id, xor(c, 4294967295) % 4 = 2 AS held_out, NOT coalesce(regexp_matches(text, '\pL'), false) AS undetermined FROM t
"""
