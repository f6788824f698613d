"""DuckDB SQL for the quality rules."""

from plantpulse.llm.quality import LINE_LIMIT, LINE_SHARE, MAX_REPEAT_PERCENT, MIN_LEFT_PERCENT, MIN_WORDS

FIGURES = rf"""
texts AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM
    (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM texts)),
grams AS (SELECT r, i, word, lead(word, 1) OVER p AS b, lead(word, 2) OVER p AS c FROM words WINDOW p AS (PARTITION BY r ORDER BY i)),
repeats AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, word, b, c) AS n FROM grams WHERE c IS NOT NULL) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM repeats, (VALUES (0), (1), (2)) AS o(k) GROUP BY r),
counted AS (SELECT r, count(*) AS n, sum(length(word)) AS chars FROM words GROUP BY r),
dups AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM
    (SELECT r, unnest(string_split(text, chr(10))) AS line FROM texts) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
figures AS (SELECT texts.r, doc_id, source, coalesce(counted.n, 0) AS n_words, coalesce(counted.chars, 0) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dups.n, 0) AS n_dup_lines,
    coalesce(covered.n, 0) AS n_repeat_words
    FROM texts LEFT JOIN counted USING (r) LEFT JOIN dups USING (r) LEFT JOIN covered USING (r)),
raw_lines AS (SELECT r, source, text, trim(regexp_replace(lower(unnest(string_split(text, chr(10)))), '[\x20\x09-\x0D]+', ' ', 'g')) AS line FROM texts),
lines AS (SELECT r, source, line, sum(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) AS words FROM raw_lines WHERE line <> '' GROUP BY ALL),
hosts AS (SELECT source, count(*) AS n FROM texts GROUP BY source),
above AS (SELECT f.source, line FROM (SELECT source, line, count(DISTINCT text) AS n FROM raw_lines WHERE line <> '' GROUP BY ALL) AS f
    JOIN hosts ON f.source IS NOT DISTINCT FROM hosts.source WHERE f.n > {LINE_LIMIT} AND f.n > hosts.n * {LINE_SHARE}::DOUBLE),
lost AS (SELECT r, sum(words) AS words FROM lines JOIN above ON lines.source IS NOT DISTINCT FROM above.source AND lines.line = above.line GROUP BY r),
judged AS (SELECT figures.*, coalesce(lost.words, 0) AS n_removed_words,
    n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed
    FROM figures LEFT JOIN lost USING (r))
"""

SQL = f"""
WITH {FIGURES}
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
    n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
    NOT base_failed AND 100 * (n_words - n_removed_words) >= {MIN_LEFT_PERCENT} * n_words AS kept,
    n_removed_words::BIGINT AS n_removed_words
FROM judged
"""
