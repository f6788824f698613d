"""DuckDB SQL for the prefix trie: every prefix as a list, every pair of a node and one below it."""

from plantpulse.llm.prefix_trie import FAMILY, SHARED

#: CRC-32 of ASCII digits, eight shifts per character; DuckDB has no such function.
BITS = "list_reduce(list_concat([c], range(8)), lambda r, i: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END)"

SQL = rf"""
WITH RECURSIVE own AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
    {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS t FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT conv_id, conv_id::VARCHAR AS s FROM own),
sums AS (SELECT conv_id, s, 0 AS i, 4294967295::BIGINT AS c FROM ids
    UNION ALL SELECT conv_id, s, i + 1, {BITS.replace('[c]', '[xor(c, ascii(substr(s, i + 1, 1))::BIGINT)]')} FROM sums WHERE i < length(s)),
plans AS (SELECT conv_id, conv_id - conv_id % {FAMILY} AS base, xor(c, 4294967295) % {SHARED} AS h FROM sums WHERE i = length(s)),
pieces AS (SELECT p.conv_id, 0 AS part, o.pos, o.t FROM plans AS p JOIN own AS o ON o.conv_id = p.base AND o.pos <= p.h
    UNION ALL SELECT p.conv_id, 1, o.pos, o.t FROM plans AS p JOIN own AS o ON o.conv_id = p.conv_id AND o.pos > p.h),
turns AS (SELECT conv_id, list(t ORDER BY part, pos) AS ts FROM pieces GROUP BY conv_id),
full_turns AS (SELECT conv_id, coalesce(ts, []) AS ts FROM ids LEFT JOIN turns USING (conv_id)),
paths AS (SELECT conv_id, len(ts) AS n, d, ts[1:d] AS path FROM (SELECT *, unnest(range(len(ts) + 1)) AS d FROM full_turns)),
nodes AS (SELECT d, path, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends FROM paths GROUP BY d, path),
lengths AS (SELECT *, CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(path[d].text, '[^\x20\x09-\x0D]+')) END AS w FROM nodes),
children AS (SELECT d - 1 AS d, path[1:d - 1] AS path, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
counted AS (SELECT l.*, coalesce(c.n, 0) AS n_children FROM lengths AS l LEFT JOIN children AS c USING (d, path)),
below AS (SELECT k AS d, path[1:k] AS path, n_children = 0 AS leaf, (n_convs - 1) * w AS saved FROM (SELECT *, unnest(range(d + 1)) AS k FROM counted)),
summed AS (SELECT d, path, count(*) FILTER (WHERE leaf) AS n_leaves, sum(saved) AS saved FROM below GROUP BY d, path)
SELECT c.conv_id, c.d::BIGINT AS depth, p.conv_id AS parent_conv_id, c.n_convs::BIGINT AS n_convs, c.n_children::BIGINT AS n_children,
    s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, c.ends AS ends_sha256
FROM counted AS c JOIN summed AS s USING (d, path) LEFT JOIN nodes AS p ON p.d = c.d - 1 AND p.path = c.path[1:c.d - 1]
"""
