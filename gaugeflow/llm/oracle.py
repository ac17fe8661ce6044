"""DuckDB SQL of the registered text queries that SQL can express."""

from __future__ import annotations

OP10 = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM wins),
places AS (
  SELECT r, size, i, array_to_string(w[i : i + size - 1], ' ') AS win
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, sizes WHERE len(w) >= size)),
found AS (SELECT r, item_id, p.size, i FROM places p JOIN wins ON wins.size = p.size AND wins.win = p.win),
hit AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS pos FROM found) GROUP BY r),
named AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM found) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""

OP7 = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS (
  SELECT r, i, array_to_string(w[i : i + 34], ' ') AS win
  FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM docs WHERE len(w) >= 35)),
twice AS (SELECT win FROM wins GROUP BY win HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM wins WHERE win IN (SELECT win FROM twice)),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM docs),
kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY p) AS rest, count(*) AS n
  FROM words ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)
"""

OP2 = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
good AS (
  SELECT * FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN e IF x <> 0]) > 0),
pairs AS (
  SELECT a.r AS r, b.r AS s FROM good a JOIN good b ON a.label = b.label AND len(a.e) = len(b.e) AND a.r <> b.r
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(r, s) AS (SELECT r, r FROM v UNION SELECT reach.r, pairs.s FROM reach JOIN pairs ON pairs.r = reach.s),
named AS (SELECT reach.r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.s GROUP BY reach.r),
linked AS (SELECT r, count(*) AS n FROM pairs GROUP BY r)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept
FROM v JOIN named USING (r) LEFT JOIN linked USING (r)
"""

OP12 = r"""
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM rows a, rows b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
pos AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER own)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM pos JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW own AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER own <= 5
"""


def _edit(state: str, cost: str, initial: str, line: str, when: str = "true") -> str:
    """A state's path with one more edit; null where it can't be made."""
    spoken = f"list_append({state}.t, {line})" if line else f"{state}.t"
    return f"CASE WHEN {state} IS NOT NULL AND {when} THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{initial}', 't': {spoken}}} END"


def _least(*paths: str) -> str:
    return f"list_min([{', '.join(paths)}])"


_SAID_USER = [x for s in ("s0", "s1", "s3") for x in (_edit(s, "more", "K", "line", "stays AND initial = 'u'"), _edit(s, "2 + more", "R", "'user:' || text", "stays"))]
OP13 = rf"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, dense_rank() OVER (ORDER BY conv_id) AS g, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT) AS codes
  FROM conversations),
kinds AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, codes),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))) % 20 AS kind
  FROM keyed),
damaged AS (
  SELECT g, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, md5(text), copy) AS pos
  FROM (SELECT *, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM kinds WHERE kind <> 0)),
said AS (
  SELECT *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said,
         row_number() OVER (PARTITION BY g, role, text ORDER BY pos) > 1 AS again, lag(role) OVER (PARTITION BY g ORDER BY pos) AS role_before
  FROM damaged),
faults AS (
  SELECT *, said = '' AS blank, said <> '' AND again AS duplicate, said <> '' AND NOT again AND right(said, 1) NOT IN ('.', '!', '?') AS truncated
  FROM said),
rows AS (
  SELECT *, NOT (blank OR duplicate) AS stays, truncated::BIGINT AS more, left(role, 1) AS initial, role || ':' || text AS line FROM faults),
paths AS (
  SELECT DISTINCT g, 0::BIGINT AS n, {{'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]}} AS s0, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR[]) AS s1,
         {{'c': 2::BIGINT, 'a': 'I', 't': ['user:']}} AS s2, {{'c': 4::BIGINT, 'a': 'II', 't': ['user:', 'assistant:']}} AS s3
  FROM keyed
  UNION ALL
  SELECT g, n, s0, s1, s2, {_least("s3", _edit("s2", "2", "I", "'assistant:'"))}
  FROM (
    SELECT g, n, s0, s1, {_least("s2", *[_edit(s, "2", "I", "'user:'") for s in ("s0", "s1", "s3")])} AS s2, s3
    FROM (
      SELECT g, n + 1 AS n, {_edit("s0", "3", "D", "")} AS s0,
             {_least(_edit("s1", "3", "D", ""), _edit("s0", "more", "K", "line", "stays AND initial = 's'"))} AS s1,
             {_least(_edit("s2", "3", "D", ""), *_SAID_USER)} AS s2,
             {_least(_edit("s3", "3", "D", ""), _edit("s2", "more", "K", "line", "stays AND initial = 'a'"), _edit("s2", "2 + more", "R", "'assistant:' || text", "stays"))} AS s3
      FROM paths JOIN rows USING (g) WHERE pos = n + 1))),
best AS (
  SELECT g, list_min([s0, s3]) AS best FROM paths QUALIFY row_number() OVER (PARTITION BY g ORDER BY n DESC) = 1),
counts AS (
  SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
         count(*) FILTER (truncated) AS truncated,
         count(*) FILTER (role_before IS NOT NULL AND left(role_before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows GROUP BY g)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, best.c::BIGINT AS cost, best.a AS audit,
       sha256(array_to_string(best.t, chr(10))) AS repaired_sha256
FROM (SELECT DISTINCT g, conv_id FROM keyed) JOIN best USING (g) LEFT JOIN counts USING (g)
"""

ORACLE = {"op12_hard_negatives": OP12, "op13_conversation_repair": OP13, "op2_near_vectors": OP2, "op7_repeated_passages": OP7, "op10_decontamination": OP10}
