"""SQL for the registered queries that SQL can express whole."""

from __future__ import annotations


def _crc32(byte_list: str) -> str:
    """Unsigned crc32 (reflected polynomial 0xEDB88320) of a list of bytes."""
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    shifted = f"list_reduce(range(8), lambda c, i: {step}, xor(crc, b)::BIGINT)"  # eight steps
    return f"xor(list_reduce({byte_list}, lambda crc, b: {shifted}, 4294967295::BIGINT), 4294967295)"


def _ascii(text: str) -> str:
    return f"list_transform(string_split({text}, ''), lambda x: ord(x)::BIGINT)"


def _latin(text: str) -> str:
    """UTF-8 bytes of a text whose letters lie below U+0100."""
    points = f"list_transform(string_split({text}, ''), lambda x: ord(x)::BIGINT)"
    return f"flatten(list_transform({points}, lambda p: CASE WHEN p < 128 THEN [p] ELSE [192 + (p >> 6), 128 + (p & 63)] END))"


OP11_SQL = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY ALL
), hashed AS (
  SELECT run, n, {_crc32(_latin("coalesce(doc_id::VARCHAR, '') || ':' || run"))} AS h FROM runs
), typed AS (
  SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2)
            ELSE run END AS word FROM hashed
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM typed WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), cuts AS (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, max(other_n) AS most FROM near GROUP BY word
), forms AS (
  SELECT b.word, min(encode(near.other)) AS form FROM best b JOIN near ON near.word = b.word AND near.other_n = b.most GROUP BY b.word
), judged AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 10 * w.n THEN decode(form) END AS form,
         CASE WHEN most >= 10 * w.n THEN most END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word LEFT JOIN forms f ON f.word = w.word
), steps AS (
  SELECT word, word AS at FROM judged
  UNION SELECT s.word, j.form FROM steps s JOIN judged j ON j.word = s.at WHERE j.form IS NOT NULL
), roots AS (
  SELECT s.word, s.at AS root FROM steps s JOIN judged j ON j.word = s.at WHERE j.form IS NULL
)
SELECT j.word, j.form, r.root, j.n, j.n_near::BIGINT AS n_near, j.form_n FROM judged j JOIN roots r ON r.word = j.word
"""


def _leaf(text: str) -> str:
    values = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"


OP13_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, source, {_leaf("text")} AS leaf,
         CASE WHEN doc_id IS NOT NULL AND {_crc32(_ascii("doc_id::VARCHAR"))} % 2 = 0
              THEN {_leaf("replace(text, chr(10), '')")} END AS changed
  FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
         count(*) OVER (PARTITION BY source) AS n FROM leaves
), lower_nodes AS (
  SELECT source, 0 AS level, idx, n, leaf AS digest FROM placed
  UNION ALL
  SELECT source, any_value(level) + 1, idx // 3, (any_value(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx))
  FROM lower_nodes WHERE n > 1 GROUP BY source, idx // 3
), subroots AS (
  SELECT source, digest, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS idx, count(*) OVER () AS n
  FROM lower_nodes WHERE n = 1
), upper_nodes AS (
  SELECT 0 AS level, idx, n, digest FROM subroots
  UNION ALL
  SELECT any_value(level) + 1, idx // 3, (any_value(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx))
  FROM upper_nodes WHERE n > 1 GROUP BY idx // 3
), lower_sides AS (
  SELECT a.source, a.level, a.idx, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l,
         coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
  FROM lower_nodes a JOIN lower_nodes b
    ON a.source IS NOT DISTINCT FROM b.source AND a.level = b.level AND a.idx // 3 = b.idx // 3 WHERE a.n > 1 GROUP BY ALL
), upper_sides AS (
  SELECT a.level, a.idx, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l,
         coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
  FROM upper_nodes a JOIN upper_nodes b ON a.level = b.level AND a.idx // 3 = b.idx // 3 WHERE a.n > 1 GROUP BY ALL
), climbed AS (
  SELECT doc_id, source, idx AS own, leaf, 0 AS level, idx, coalesce(changed, leaf) AS folded, '' AS proof FROM placed
  UNION ALL
  SELECT c.doc_id, c.source, c.own, c.leaf, c.level + 1, c.idx // 3, sha256(s.l || c.folded || s.r), c.proof || s.l || s.r
  FROM climbed c JOIN lower_sides s ON s.source IS NOT DISTINCT FROM c.source AND s.level = c.level AND s.idx = c.idx
), at_subroot AS (
  SELECT c.*, s.digest AS subroot, s.idx AS place FROM climbed c JOIN lower_nodes t
    ON t.source IS NOT DISTINCT FROM c.source AND t.level = c.level AND t.n = 1
  JOIN subroots s ON s.source IS NOT DISTINCT FROM c.source
), on_top AS (
  SELECT doc_id, source, own, leaf, subroot, 0 AS level, place AS idx, folded, proof FROM at_subroot
  UNION ALL
  SELECT c.doc_id, c.source, c.own, c.leaf, c.subroot, c.level + 1, c.idx // 3, sha256(s.l || c.folded || s.r), c.proof || s.l || s.r
  FROM on_top c JOIN upper_sides s ON s.level = c.level AND s.idx = c.idx
)
SELECT c.doc_id, c.leaf, c.subroot, t.digest AS root, sha256(c.proof) AS proof_sha256, c.folded AS folded_root,
       c.folded = t.digest AS verified
FROM on_top c JOIN upper_nodes t ON t.level = c.level AND t.n = 1
"""
