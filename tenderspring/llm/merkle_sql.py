"""The Merkle manifest of `documents` in DuckDB: the tree as lists a level, CRC-32 and folding as reductions of lists."""

SQL = """
WITH RECURSIVE d AS (SELECT doc_id, lang, n_chars, source, text, list_reduce([4294967295] || flatten([[ascii(c), -1, -1, -1, -1, -1, -1, -1, -1] for c in string_split(CAST(doc_id AS VARCHAR), '')]), lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END) AS c FROM documents),
both_ways AS (SELECT doc_id, lang, concat(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-')) AS head, coalesce(strlen(text) || ':' || text, '-') AS tail, n_chars, n_chars + CASE WHEN xor(c, 4294967295) % 7 = 0 THEN 1 ELSE 0 END AS claim FROM d),
leaves AS (SELECT doc_id, lang, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf, sha256(head || coalesce(strlen(CAST(claim AS VARCHAR)) || ':' || claim, '-') || tail) AS claimed FROM both_ways),
ordered AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM leaves),
tree AS (SELECT g, 0 AS level, list(leaf ORDER BY i) AS nodes FROM ordered GROUP BY g UNION ALL SELECT g, level + 1, [sha256(nodes[2 * k + 1] || coalesce(nodes[2 * k + 2], '')) for k in range(0, (len(nodes) + 1) // 2)] FROM tree WHERE len(nodes) > 1),
subroots AS (SELECT g, nodes[1] AS subroot FROM tree WHERE len(nodes) = 1),
top AS (SELECT 0 AS level, list(subroot ORDER BY g) AS nodes FROM subroots UNION ALL SELECT level + 1, [sha256(nodes[2 * k + 1] || coalesce(nodes[2 * k + 2], '')) for k in range(0, (len(nodes) + 1) // 2)] FROM top WHERE len(nodes) > 1),
steps AS (SELECT o.doc_id, o.i, o.g, 0 AS upper, level, xor(o.i >> level, 1) AS j, nodes FROM ordered o JOIN tree t ON t.g = o.g WHERE len(nodes) > 1 UNION ALL SELECT doc_id, i, g, 1, level, xor(g >> level, 1), nodes FROM ordered, top WHERE len(nodes) > 1),
paths AS (SELECT g, i, list(CASE WHEN j >= len(nodes) THEN '' WHEN j % 2 = 1 THEN 'R' || nodes[j + 1] ELSE 'L' || nodes[j + 1] END ORDER BY upper, level) AS path FROM steps GROUP BY g, i),
done AS (SELECT doc_id, leaf, subroot, (SELECT nodes[1] FROM top WHERE len(nodes) = 1) AS root, sha256(array_to_string([x[2:] for x in coalesce(path, [])], '')) AS proof_sha256, list_reduce([claimed] || coalesce(path, []), lambda a, b: CASE WHEN b = '' THEN sha256(a) WHEN b[1] = 'L' THEN sha256(b[2:] || a) ELSE sha256(a || b[2:]) END) AS folded_root FROM ordered JOIN subroots USING (g) LEFT JOIN paths USING (g, i))
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM done
"""
