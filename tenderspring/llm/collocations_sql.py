"""Collocations of `documents` in DuckDB, with all n-grams counted."""

SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, [x for x in regexp_split_to_array(p, '[\x20\x09]+') if x <> ''] AS w FROM pieces),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY 1),
f AS (SELECT lang, phrase, k, count(*) AS a FROM (SELECT lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') for i in range(1, len(w) - k + 2)]) AS phrase FROM w, (SELECT unnest(range(1, 5)) AS k) WHERE len(w) >= k) GROUP BY ALL HAVING count(*) >= 30),
longer AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer FROM (SELECT lang, w, a, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT lang, string_split(phrase, ' ') AS w, a, k, unnest(range(2, k)) AS m FROM f WHERE k >= 3)) GROUP BY ALL),
kept AS (SELECT lang, phrase, k, a, string_split(phrase, ' ') AS w FROM f LEFT JOIN longer USING (lang, phrase) WHERE k >= 2 AND (longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a)),
cuts AS (SELECT lang, phrase, a, cut, array_to_string(w[1:cut], ' ') AS first, array_to_string(w[cut + 1:k], ' ') AS rest FROM (SELECT *, unnest(range(1, k)) AS cut FROM kept)),
scored AS (SELECT c.lang, c.phrase, c.a, x.a AS l, y.a AS r, cut, CAST((2000000::HUGEINT * c.a) // (x.a::HUGEINT + y.a) AS BIGINT) AS score FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = first JOIN f y ON y.lang = c.lang AND y.phrase = rest),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM best JOIN total USING (lang) QUALIFY rank <= 2000
"""
