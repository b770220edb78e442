"""SQL forms, for DuckDB, of the queries that have one."""

NGRAM_JOIN = r"""
WITH RECURSIVE worded AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS words FROM documents),
grams AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
        ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS gram FROM worded),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (
    SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS n FROM grams a JOIN grams b USING (gram)
    WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
    SELECT u, v FROM shared JOIN sizes a ON a.doc_id = u JOIN sizes b ON b.doc_id = v
    WHERE 100 * shared.n >= 75 * (a.n + b.n - shared.n)),
reach AS (
    SELECT u AS doc_id, u AS other FROM links UNION SELECT r.doc_id, l.v FROM reach r JOIN links l ON l.u = r.other),
groups AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, coalesce(g.component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN groups g ON g.doc_id = d.doc_id
"""

LINE_DEDUP = r"""
WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS place FROM parts),
solid AS (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS number,
        lead(line) OVER (PARTITION BY doc_id ORDER BY place) AS next,
        len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n_words
    FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
copies AS (
    SELECT *, n_words >= 8 AND row_number() OVER (PARTITION BY line ORDER BY doc_id, place) > 1 AS single,
        next IS NOT NULL AND row_number() OVER (PARTITION BY line, next ORDER BY doc_id, place) > 1 AS pair FROM solid),
marked AS (
    SELECT *, single OR pair OR coalesce(lag(pair) OVER (PARTITION BY doc_id ORDER BY place), false) AS gone FROM copies),
runs AS (
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
        count(*) FILTER (gone AND NOT earlier) AS n_runs
    FROM (SELECT *, coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY place), false) AS earlier FROM marked) GROUP BY doc_id),
kept AS (
    SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.place) FILTER (NOT coalesce(m.gone, false)) AS kept
    FROM lines l LEFT JOIN marked m ON m.doc_id = l.doc_id AND m.place = l.place GROUP BY l.doc_id)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
    coalesce(n_runs, 0)::BIGINT AS n_runs, sha256(coalesce(kept, '')) AS kept_sha256
FROM kept LEFT JOIN runs USING (doc_id)
"""

ORACLES = {"op4_ngram_join": NGRAM_JOIN, "op5_line_dedup": LINE_DEDUP}
