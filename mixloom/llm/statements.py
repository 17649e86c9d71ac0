"""DuckDB statements of the operators that SQL can express."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

DIVERGENCE = rf"""
WITH d AS (
    SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS id,
        regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
), occurrences AS (
    SELECT lang, source, id, unnest(terms) AS term FROM d
), kept AS (
    SELECT lang, term, count(*) AS times FROM occurrences GROUP BY lang, term HAVING count(DISTINCT id) >= 10
), languages AS (
    SELECT lang, count(*) AS v, sum(times) AS n FROM kept GROUP BY lang
), cells AS (
    SELECT lang, source, term, count(*) AS times FROM occurrences SEMI JOIN kept USING (lang, term) GROUP BY ALL
), groups AS (
    SELECT lang, source, coalesce(n, 0) AS n
    FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(times) AS n FROM cells GROUP BY ALL) USING (lang, source)
), shares AS (
    SELECT g.lang, g.source, k.term, coalesce(c.times, 0) AS times,
        (1 + (1000000000::HUGEINT * (coalesce(c.times, 0) + 2)) // (g.n + 2 * l.v))::HUGEINT AS p,
        (1 + (1000000000::HUGEINT * (k.times + 2)) // (l.n + 2 * l.v))::HUGEINT AS q
    FROM groups g JOIN languages l USING (lang) JOIN kept k USING (lang)
        LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), found AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
        coalesce((SELECT sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) FROM shares x JOIN shares y USING (lang, term)
            WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0)::BIGINT AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    UNION ALL
    SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM shares WHERE times > 0 AND p > q
)
SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM found
) WHERE part = 'pair' OR rank <= 10
"""

SEARCH = rf"""
WITH d AS (
    SELECT doc_id, row_number() OVER () AS id,
        regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
), sizes AS (
    SELECT count(*) AS big_n, sum(len(terms))::BIGINT AS total FROM d WHERE len(terms) > 0
), wanted AS (
    SELECT item, item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term
    FROM (SELECT *, row_number() OVER () AS item FROM benchmark)
), postings AS (
    SELECT id, doc_id, n, term, count(*) AS tf
    FROM (SELECT id, doc_id, len(terms) AS n, unnest(terms) AS term FROM d)
    SEMI JOIN wanted USING (term) GROUP BY ALL
), weights AS (
    SELECT term, floor(1000 * ln((2 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
    FROM postings, sizes GROUP BY term
), impacts AS (
    SELECT id, doc_id, term,
        w * ((1000000000::BIGINT * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * big_n) // total))) AS impact
    FROM postings JOIN weights USING (term), sizes
), scores AS (
    SELECT item, item_id, id, doc_id, sum(impact)::BIGINT AS score FROM wanted JOIN impacts USING (term) GROUP BY ALL
), ranked AS (
    SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
    FROM scores WHERE score > 0 AND doc_id IS NOT NULL
)
SELECT * FROM ranked WHERE rank <= 10
"""
