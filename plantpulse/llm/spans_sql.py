"""DuckDB SQL for the secret scan: positions from the pieces between the matches."""

from plantpulse.llm.secrets import BASE_KINDS, FAST, RULES


def _kind(order: int, kind: str, pattern: str, group: int, least: int) -> str:
    quoted = pattern.replace("'", "''")
    return f"""SELECT r, '{kind}' AS kind, {order} AS o, unnest(starts) AS s, unnest(ends) AS e, unnest(lengths) AS n, {least} AS least FROM (
        SELECT r, list_transform(range(1, len(m) + 1), lambda i: (list_sum(list_transform(p[1:i], lambda x: length(x)))
            + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT) AS starts,
            list_transform(range(1, len(m) + 1), lambda i: (list_sum(list_transform(p[1:i], lambda x: length(x)))
            + list_sum(list_transform(m[1:i], lambda x: length(x))))::BIGINT) AS ends,
            list_transform(g, lambda x: length(x)) AS lengths
        FROM (SELECT r, regexp_extract_all(text, '{quoted}') AS m, regexp_extract_all(text, '{quoted}', {group}) AS g,
            string_split_regex(text, '{quoted}') AS p FROM texts WHERE regexp_matches(text, '{quoted}')))"""


KINDS = "\n    UNION ALL ".join(_kind(i, k, FAST.get(k, p), g, n) for i, (k, _, p, g, n) in enumerate(RULES))
COUNTS = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in BASE_KINDS)
NAMES = ", ".join(f"'{k}'" for k in BASE_KINDS)

SECRETS = f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({KINDS}),
kept AS (SELECT * FROM found WHERE n >= least),
per AS (SELECT r, {COUNTS}, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) AS spans,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) FILTER (WHERE kind IN ({NAMES})) AS base FROM kept GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in BASE_KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN per USING (r)
"""
