"""DuckDB SQL for the mix: the taken words in closed form, and the targets by repeated resharing."""

from plantpulse.llm.mixing import BLOCK_WORDS, GOLDEN, MAX_EPOCHS, POINTS, TOTAL_PERCENT, WEIGHTS

TURNS = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(WEIGHTS))

SQL = rf"""
WITH RECURSIVE
texts AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS place, md5(coalesce(text, '')) AS text_md5 FROM documents),
streams AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY place, doc_id NULLS FIRST, size, text_md5 ROWS UNBOUNDED PRECEDING) - size AS start FROM texts),
sources AS (SELECT source, sum(size)::BIGINT AS size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} {TURNS} END AS w
    FROM texts GROUP BY source),
levels AS (
    SELECT 1 AS round, source, size, w, (sum(size) OVER ()) * {TOTAL_PERCENT / 100}::DOUBLE * w / sum(w) OVER () AS target FROM sources
    UNION ALL
    SELECT round + 1, source, size, w, CASE WHEN target >= {MAX_EPOCHS} * size THEN {MAX_EPOCHS} * size::DOUBLE ELSE
        ((sum(size) OVER ()) * {TOTAL_PERCENT / 100}::DOUBLE - coalesce(sum({MAX_EPOCHS} * size) FILTER (WHERE target >= {MAX_EPOCHS} * size) OVER (), 0))
        / sum(w) FILTER (WHERE target < {MAX_EPOCHS} * size) OVER () * w END
    FROM levels WHERE round <= (SELECT count(*) FROM sources)),
targets AS (SELECT source, size, target FROM levels WHERE round = (SELECT max(round) FROM levels)),
parts AS (SELECT source, round(sum(target) OVER (ORDER BY source NULLS LAST) / sum(target) OVER () * {POINTS})::BIGINT AS upto FROM targets),
cut AS (SELECT source, upto, coalesce(lag(upto) OVER (ORDER BY source NULLS LAST), 0) AS since FROM parts),
slots AS (SELECT i % {POINTS} * {GOLDEN} % {POINTS} AS point FROM
    (SELECT unnest(range(ceil(sum(target) / {BLOCK_WORDS})::BIGINT)) AS i FROM targets)),
drawn AS (SELECT source, count(*) AS n FROM slots JOIN cut ON point >= since AND point < upto GROUP BY source)
SELECT doc_id, s.source, s.size, t.size AS source_size, round(t.target, 3) AS target,
    sum(greatest(0, least(start + e * t.size + s.size, coalesce(n, 0) * {BLOCK_WORDS}) - (start + e * t.size)))::BIGINT AS taken,
    count(*) FILTER (WHERE s.size > 0 AND (start + e * t.size) // {BLOCK_WORDS} < coalesce(n, 0))::INTEGER AS copies
FROM streams AS s JOIN targets AS t ON s.source IS NOT DISTINCT FROM t.source
LEFT JOIN drawn AS d ON s.source IS NOT DISTINCT FROM d.source, range({MAX_EPOCHS}) AS p(e)
GROUP BY doc_id, s.source, s.size, t.size, t.target, start, text_md5, place, n
"""
