"""DuckDB statements for the queries of this subpackage that SQL can express.

Without a statement, and tested against brute force in ``tests/llm``: op1 (suffix
arrays), op2 (similarity join with components), op4 (template tree), op5 (a trained
model), op6 and op8 (tokenizers), op7 (verdict by sketches), op9 (splitters), op11 (a trained
model), op13 (runs of every period).
"""

from __future__ import annotations

SQL: dict[str, str] = {}

SQL["op3_chat_formatting"] = """
WITH rows AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i
  FROM rows),
e AS (
  SELECT *,
    length(role) + 4 * (length(role) - length(replace(role, '&', '')))
      + 3 * (length(role) - length(replace(replace(replace(role, '<', ''), '[', ''), ']', ''))) AS role_len,
    length(text) + 4 * (length(text) - length(replace(text, '&', '')))
      + 3 * (length(text) - length(replace(replace(replace(text, '<', ''), '[', ''), ']', ''))) AS text_len
  FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(9 + role_len + text_len) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

SQL["op10_decontamination"] = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
  FROM bw, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM windows),
grams AS (
  SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS g
  FROM dw, sizes, unnest(range(1, len(w) - size + 2)) AS u(i) WHERE len(w) >= size),
found AS (SELECT doc_id, i, grams.size, item_id FROM grams JOIN windows ON grams.size = windows.size AND grams.g = windows.g),
hits AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS s
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hits.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
       sha256(coalesce(items.s, '')) AS items_sha256, hits.n IS NOT NULL AS contaminated
FROM dw LEFT JOIN hits ON hits.doc_id = dw.doc_id LEFT JOIN items ON items.doc_id = dw.doc_id
"""

_FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
_REPLACED = _FIELD.format("replace(text, chr(10), '')")
# crc32 bit by bit: every byte is followed by eight shifts, marked by -1
_CRC = """xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
        lambda c: list_prepend(CAST(ascii(c) AS BIGINT), list_transform(range(8), lambda j: CAST(-1 AS BIGINT)))))),
        lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295)"""
_UP = "list_transform(range((len(nodes) + 2) // 3), lambda i: sha256(array_to_string(nodes[3 * i + 1:3 * i + 3], '')))"
_STEP = """{'l': array_to_string(nodes[k // 3 * 3 + 1:k], ''), 'r': array_to_string(nodes[k + 2:k // 3 * 3 + 3], '')}"""
SQL["op12_merkle_manifest"] = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, sha256({_LEAF} || {_FIELD.format("text")}) AS leaf,
         CASE WHEN {_CRC} % 2 = 0 THEN sha256({_LEAF} || {_REPLACED}) END AS tampered FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
tree AS (
  SELECT source, 0 AS lvl, 1 AS width, list(leaf ORDER BY pos) AS nodes FROM p GROUP BY source
  UNION ALL SELECT source, lvl + 1, 3 * width, {_UP} FROM tree WHERE len(nodes) > 1),
sub AS (SELECT source, nodes[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos FROM tree WHERE len(nodes) = 1),
top AS (
  SELECT 0 AS lvl, 1 AS width, list(subroot ORDER BY pos) AS nodes FROM sub HAVING count(*) > 0
  UNION ALL SELECT lvl + 1, 3 * width, {_UP} FROM top WHERE len(nodes) > 1),
root AS (SELECT nodes[1] AS root FROM top WHERE len(nodes) = 1),
low AS (
  SELECT p.source, p.pos, list({_STEP} ORDER BY lvl) AS steps
  FROM (SELECT p.source, p.pos, lvl, nodes, p.pos // width AS k FROM p JOIN tree ON p.source IS NOT DISTINCT FROM tree.source WHERE len(nodes) > 1) p
  GROUP BY ALL),
high AS (
  SELECT source, list({_STEP} ORDER BY lvl) AS steps
  FROM (SELECT source, lvl, nodes, sub.pos // width AS k FROM sub, top WHERE len(nodes) > 1) GROUP BY source),
a AS (
  SELECT p.doc_id, p.leaf, coalesce(p.tampered, p.leaf) AS suspect, sub.subroot, root.root,
         list_concat(coalesce(low.steps, []), coalesce(high.steps, [])) AS steps
  FROM p JOIN sub ON p.source IS NOT DISTINCT FROM sub.source CROSS JOIN root
  LEFT JOIN low ON p.source IS NOT DISTINCT FROM low.source AND p.pos = low.pos
  LEFT JOIN high ON p.source IS NOT DISTINCT FROM high.source),
b AS (
  SELECT *, sha256(array_to_string(list_transform(steps, lambda s: s.l || s.r), '')) AS proof_sha256,
         list_reduce(list_prepend({{'l': suspect, 'r': ''}}, steps), lambda a, x: {{'l': sha256(x.l || a.l || x.r), 'r': ''}}).l AS folded_root
  FROM a)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM b
"""
