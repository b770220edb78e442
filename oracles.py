"""SQL for each registered query, run by DuckDB on the same tables."""

from __future__ import annotations

SITE = "https://"
MODES = (
    ("raw", None, None),
    ("log", None, None),
    ("max", None, None),
    ("raw", "euc", None),
    ("raw", None, "cos"),
)

TOKEN = "[a-z0-9](?:[a-z0-9/-]*[a-z0-9])?"
TAG = r"""<[\/!]?([\w-]+)\s*(?:\s*[\w-](?:=(?:"[^"]*")|[^\s"]+)?\s*)*\/?>"""


def token_list(text: str) -> str:
    return f"""flatten(list_transform(regexp_extract_all(lower({text}), '{TOKEN}'),
        lambda w: CASE WHEN regexp_matches(w, '[-/]') THEN list_prepend(w, regexp_split_to_array(w, '[-/]')) ELSE [w] END))"""


def postings(source: str, key: str = "doc_id", text: str = "text") -> str:
    """CTE body (term, doc_id, tf)."""
    return f"""SELECT term, doc_id, count(*)::BIGINT AS tf
        FROM (SELECT {key} AS doc_id, unnest({token_list(text)}) AS term FROM {source}) GROUP BY ALL"""


PAGE_TEXT = f"""
    tagged AS (SELECT page_id, regexp_split_to_array(html, '{TAG}') AS texts,
        regexp_extract_all(html, '{TAG}', 0) AS tags, regexp_extract_all(html, '{TAG}', 1) AS names FROM pages),
    pieces AS (SELECT page_id, unnest(texts) AS piece, generate_subscripts(texts, 1) AS i, len(texts) AS n, tags, names
        FROM tagged),
    marked AS (SELECT page_id, piece, i, n,
        CASE WHEN i > 1 THEN names[i - 1] END AS name,
        CASE WHEN i > 1 THEN tags[i - 1] LIKE '</%' END AS closing FROM pieces),
    states AS (SELECT *, coalesce(last_value(CASE WHEN name = 'script' THEN NOT closing END IGNORE NULLS)
        OVER (PARTITION BY page_id ORDER BY i ROWS UNBOUNDED PRECEDING), false) AS in_script FROM marked),
    page_text AS (SELECT page_id, replace(replace(replace(replace(string_agg(
        CASE WHEN name = 'a' AND closing THEN ']]' WHEN name = 'a' THEN '[[' ELSE '' END
        || CASE WHEN in_script AND i < n THEN '' ELSE piece END, '' ORDER BY i),
        '&gt;', '>'), '&lt;', '<'), '&quot;', '"'), '&amp;', '&') AS text FROM states GROUP BY page_id)"""

PAGE_NAME = f"CASE WHEN starts_with(url, '{SITE}') THEN substr(url, {len(SITE) + 1}) ELSE url END"


def search(queries: str, source: str = "documents", key: str = "doc_id", text: str = "text", ctes: str = "") -> str:
    """CTEs up to ``matched``: every hit with each of its query terms."""
    return f"""WITH {ctes + ', ' if ctes else ''}
    post AS ({postings(source, key, text)}),
    stats AS (SELECT doc_id, max(tf) AS tf_max, sum(tf * tf)::DOUBLE AS sum_sq FROM post GROUP BY doc_id),
    dfs AS (SELECT term, ln((SELECT count(*) FROM stats)::DOUBLE / count(*)) AS idf FROM post GROUP BY term),
    q AS ({queries}),
    qt AS (SELECT DISTINCT query_id, unnest({token_list('query_text')}) AS term FROM q),
    qn AS (SELECT query_id, count(*) AS n_terms FROM qt GROUP BY query_id),
    joined AS (SELECT qt.query_id, post.doc_id, tf::DOUBLE AS tf, tf_max, sum_sq, idf, n_terms,
        count(*) OVER (PARTITION BY qt.query_id, post.doc_id) AS found
        FROM qt JOIN qn USING (query_id) JOIN post USING (term) JOIN dfs USING (term) JOIN stats USING (doc_id)),
    matched AS (SELECT * FROM joined WHERE found = n_terms)"""


SCORES = {
    "raw": "sum(tf * idf)",
    "log": "sum((1 + ln(tf)) * idf)",
    "max": "sum((0.5 + 0.5 * tf / tf_max) * idf)",
    "euc": "sum(tf * idf) / sqrt(max(sum_sq))",
    "cos": "sum(tf) / (sqrt(max(sum_sq)) * sqrt(max(n_terms)))",
    "log euc": "sum((1 + ln(tf)) * idf) / sqrt(max(sum_sq))",
}
BENCHMARK = "SELECT item_id AS query_id, text AS query_text FROM benchmark"
FREQUENT = """SELECT * FROM (VALUES (0, 'the and'), (1, 'of the in'), (2, 'der die und'), (3, 'de la'), (4, 'the')) q(query_id, query_text)"""
TWO_TERMS = "SELECT 0 AS query_id, 'the and' AS query_text"


def scored(mode: str) -> str:
    return f"SELECT query_id::BIGINT AS query_id, doc_id, {SCORES[mode]} AS raw FROM matched GROUP BY query_id, doc_id"


def batch(mode: str) -> str:
    return f"{search(BENCHMARK)} SELECT query_id, doc_id, round(raw, 6) AS score FROM ({scored(mode)})"


def ranked(mode: str, queries: str, limit: int | None = None) -> str:
    keep = f"WHERE \"rank\" <= {limit}" if limit else ""
    return f"""{search(queries)} SELECT * FROM (SELECT query_id, doc_id, round(raw, 6) AS score,
        row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 9) DESC, doc_id) AS "rank"
        FROM ({scored(mode)})) {keep}"""


def _mixed() -> str:
    parts = [
        f"SELECT query_id * {len(MODES)} + {i} AS query_id, doc_id, round(raw, 6) AS score FROM ({scored(mode)})"
        for i, mode in enumerate(("raw", "log", "max", "euc", "cos"))
    ]
    return search(BENCHMARK) + " UNION ALL ".join(parts)


LINKS = """
    hrefs AS (SELECT url, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS href,
        generate_subscripts(regexp_extract_all(html, 'href="([^"]+)"', 1), 1) - 1 AS position FROM pages),
    resolved AS (SELECT url, regexp_extract(url, '^[a-z]+://[^/?#]*') || regexp_replace(href, '#.*$', '') AS to_url,
        position::BIGINT AS position FROM hrefs)"""


# Beginnings of page names: plain ones, and one of each kind that a filter leaves out.
NAME_KINDS = (
    "Plain_", "Category:", "Category_talk:", "Special:", "User:", "Help:", "Template:", "Talk:", "File:", "MediaWiki:",
    "User_talk:", "Special:Version/", "Special:WhatLinksHere/", "Special:Contributions/", "Special:RecentChangesLinked/",
)


def _content(url: str, name: str) -> str:
    special = ("Contributions", "WhatLinksHere", "RecentChangesLinked", "Version")
    spaces = ("User:", "Help:", "Template:", "Talk:", "File:", "MediaWiki:", "User_talk:")
    return " AND ".join(
        [f"starts_with({url}, '{SITE}')", f"NOT contains({url}, '#')"]
        + [f"NOT contains({url}, 'Special:{s}')" for s in special]
        + [f"NOT starts_with({name}, '{s}')" for s in spaces]
    )


SITE_LINKS = f"""{LINKS},
    named AS (SELECT {PAGE_NAME} AS from_page, substr(to_url, {len(SITE) + 1}) AS to_page, position, to_url FROM resolved),
    site_links AS (SELECT from_page, to_page, position FROM named WHERE {_content('to_url', 'to_page')})"""

# The part wiki, computed from the columns instead of from markup.
WIKI = """
    dump AS (SELECT *, p_name || ' ' || p_partkey || ' (' || lower(p_type) || ')' AS title,
        p_name || ' ' || p_partkey AS key,
        CASE p_type WHEN 'STANDARD' THEN 'Vacuum tube computers' WHEN 'LARGE' THEN 'Electro-mechanical computers'
            WHEN 'ECONOMY' THEN 'Comic book computers' WHEN 'MEDIUM' THEN 'Intel processors'
            WHEN 'SMALL' THEN 'Word processors' ELSE 'Promotions' END AS category,
        CASE WHEN p_size > 25 THEN 'Serial computers' ELSE 'Machines' END AS second FROM part),
    markup AS (SELECT *, '{{Infobox computer
| name = ' || p_name || '
| manufacturer = [[' || p_brand || ' works|' || p_brand || ']]
| release date = {{start date|' || (1940 + p_size) || '}}
| bits = ' || p_size || '-bit
| cpu = Core @ ' || p_size || '.5 [[Hertz|MHz]]
}}
The ' || p_name || ' was developed by [[' || p_brand || ' labs]] in ' || (1940 + p_size)
        || '. It was released in ' || (1950 + p_size) || ' on 3 May ' || (1951 + p_size) || '.
[[Category:' || category || '|x]] [[Category:' || second || ']]' AS value,
        list_concat([
            {'name': 'company', 'value': p_brand || ' works'},
            {'name': 'release', 'value': (1940 + p_size)::VARCHAR},
            {'name': 'wordSize', 'value': p_size::VARCHAR},
            {'name': 'clockSpeed', 'value': p_size || '.5 MHz'}],
            CASE p_type WHEN 'STANDARD' THEN [{'name': 'tech', 'value': 'vacuum-tubes'}]
                WHEN 'LARGE' THEN [{'name': 'tech', 'value': 'electro-mechanical'}] ELSE [] END,
            CASE WHEN p_size > 25 THEN [{'name': 'tech', 'value': 'serial'}] ELSE [] END,
            [{'name': 'clockSpeed?', 'value': p_size || '.5 MHz'},
            {'name': 'company?', 'value': p_brand || ' labs'},
            {'name': 'release', 'value': (1940 + p_size)::VARCHAR},
            {'name': 'release?', 'value': (1950 + p_size)::VARCHAR},
            {'name': 'release?', 'value': (1951 + p_size)::VARCHAR}]) AS attributes FROM dump),
    articles AS (SELECT * FROM markup WHERE p_type NOT IN ('PROMO', 'ECONOMY') AND NOT (p_type = 'SMALL' AND p_size <= 25)),
    site AS (
        SELECT p_name || ' ' || p_partkey AS key, p_name || ' ' || p_partkey AS title, p_brand, p_size,
            p_brand || ' Computers|' || p_type AS categories,
            'The [[' || p_name || ']] & sold by [[' || p_brand || ' shop]] on ' || (1930 + p_size) || '. [[Categories]]: [['
            || p_brand || ' Computers]][[' || p_type || ']]' AS value,
            [{'name': 'company?', 'value': p_brand || ' shop'}, {'name': 'release', 'value': (1930 + p_size)::VARCHAR}] AS attributes
        FROM part WHERE p_size > 25
        UNION ALL
        SELECT 'supplier ' || s_suppkey, 'Supplier ' || s_suppkey, NULL, NULL, 'Mainframes',
            'Made by ' || s_name || ' [[Category]]: [[Mainframes]]', []
        FROM supplier WHERE s_acctbal >= 0),
    titles AS (SELECT coalesce(a.title, s.title) AS title, a.title AS extern_title, s.title AS site_title,
        list_concat(coalesce(s.attributes, []), coalesce(a.attributes, [])) AS attributes,
        concat_ws(' ', s.value, a.value) AS value,
        CASE WHEN a.title IS NOT NULL THEN a.p_brand || ' works' WHEN s.p_brand IS NOT NULL THEN s.p_brand || ' shop' END AS company,
        CASE WHEN a.title IS NOT NULL THEN 1940 + a.p_size ELSE 1930 + s.p_size END AS release,
        a.p_size AS word_size, (a.p_size + 0.5) * 1e6 AS clock_speed,
        CASE WHEN a.p_size > 25 THEN 'serial' ELSE 'parallel' END AS architecture,
        CASE a.p_type WHEN 'STANDARD' THEN 'vacuum-tubes' WHEN 'LARGE' THEN 'electro-mechanical' ELSE 'transistor' END AS logic
        FROM articles a FULL OUTER JOIN site s USING (key)),
    search_docs AS (SELECT row_number() OVER (ORDER BY title, site_title NULLS FIRST) - 1 AS doc_id, title, site_title,
        extern_title, value AS text, coalesce(company, '') AS company, release::INTEGER AS release,
        word_size::INTEGER AS word_size, clock_speed::DOUBLE AS clock_speed, architecture, logic FROM titles)"""

FIELDED = f"""{WIKI},
    contents AS (UNPIVOT (SELECT doc_id, title, text, company, architecture, logic FROM search_docs)
        ON title, text, company, architecture, logic INTO NAME field VALUE content),
    toks AS (SELECT field, doc_id, unnest({token_list('content')}) AS term FROM contents),
    fpost AS (SELECT field, term, doc_id, count(*) AS tf FROM toks GROUP BY ALL),
    flen AS (SELECT field, doc_id, sum(tf) AS len FROM fpost GROUP BY ALL),
    fstat AS (SELECT field, count(*) AS n_docs, avg(len) AS avg_len FROM flen GROUP BY field),
    fdf AS (SELECT field, term, count(*) AS df FROM fpost GROUP BY ALL),
    boosts AS (SELECT * FROM (VALUES ('title', 4.0::DOUBLE), ('text', 1.0), ('company', 5.0), ('architecture', 5.0), ('logic', 5.0))
        AS t(field, boost)),
    q AS (SELECT DISTINCT regexp_extract(p_brand, '([0-9]+)', 1)::BIGINT AS query_id, p_brand || ' works serial' AS query_text FROM part),
    qt AS (SELECT DISTINCT query_id, unnest({token_list('query_text')}) AS term FROM q),
    contributions AS (SELECT query_id, doc_id, term, field,
        boost * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * len / avg_len)) AS score
        FROM qt JOIN fpost USING (term) JOIN fdf USING (field, term) JOIN fstat USING (field)
        JOIN flen USING (field, doc_id) JOIN boosts USING (field)),
    fhits AS (SELECT query_id, doc_id, sum(score) AS raw, count(DISTINCT term) AS found FROM contributions GROUP BY ALL)"""


def encoded(title: str) -> str:
    for char, code in (("%", "25"), (" ", "20"), ('"', "22"), ("#", "23"), ("<", "3C"), (">", "3E"), ("?", "3F")):
        title = f"replace({title}, '{char}', '%{code}')"
    return title


SEGMENT = '<a href="[^"]*">[^<]*</a>'


def all_sql() -> dict[str, str]:
    sql = {
        "tokens": f"""SELECT doc_id, len(t)::BIGINT AS n_tokens, array_to_string(t, ' ') AS tokens
            FROM (SELECT doc_id, {token_list('text')} AS t FROM documents)""",
        "page_text": f"WITH {PAGE_TEXT} SELECT page_id, text FROM page_text",
        "page_checks": f"""SELECT page_id, page_name, replace(page_name, '_', ' ') AS title,
            {_content('url', 'page_name')} AS is_content,
            NOT (starts_with(page_name, 'Category:') OR starts_with(page_name, 'Category_talk:')
                OR starts_with(page_name, 'Special:')) AND NOT contains(html, 'wgInternalRedirectTargetUrl') AS is_article
            FROM (SELECT *, {PAGE_NAME} AS page_name FROM pages)""",
        "normalized_titles": f"WITH {WIKI} SELECT p_partkey AS id, title, key AS n_title FROM dump",
        "result_urls": f"""WITH {WIKI} SELECT p_partkey AS id, 'https://en.wikipedia.org/wiki/' || {encoded('title')} AS url
            FROM dump""",
        "page_name_decoding": """SELECT p_partkey, replace(replace(p_name, ' ', '(20)') || '(3a)' || p_brand, '#', '(23)') || '.html'
            AS file_name, p_name || ':' || p_brand AS page_name FROM part""",
        "postings_tf": postings("documents"),
        "term_statistics": f"""WITH post AS ({postings('documents')}) SELECT term, count(*)::BIGINT AS df,
            round(ln((SELECT count(DISTINCT doc_id) FROM post)::DOUBLE / count(*)), 6) AS idf FROM post GROUP BY term""",
        "doc_statistics": f"""WITH post AS ({postings('documents')}) SELECT doc_id, max(tf) AS tf_max,
            round(1 / sqrt(sum(tf * tf)::DOUBLE), 9) AS euc, sum(tf)::BIGINT AS len FROM post GROUP BY doc_id""",
        "index_counts": f"""WITH post AS ({postings('documents')}) SELECT (SELECT count(*) FROM documents) AS n_documents,
            count(DISTINCT doc_id) AS n_with_terms, count(DISTINCT term) AS n_terms, sum(tf)::BIGINT AS n_tokens FROM post""",
        "page_postings": f"""WITH {PAGE_TEXT}, post AS ({postings('page_text', 'page_id')})
            SELECT term, doc_id AS page_id, tf FROM post""",
        "term_lookup": f"""WITH post AS ({postings('documents')}) SELECT doc_id, tf, lang, source
            FROM post JOIN documents USING (doc_id) WHERE term = 'the'""",
        "terms_of_toxic_documents": f"""WITH post AS ({postings('documents')}) SELECT doc_id, term, tf FROM post
            WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
        "document_ids": f"""SELECT row_number() OVER (ORDER BY page_name) - 1 AS doc_id, page_name
            FROM (SELECT DISTINCT {PAGE_NAME} AS page_name FROM pages)""",
        "unseen_documents": """SELECT doc_id, lang, n_chars FROM documents
            WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
        "incremental_ids": f"""WITH {PAGE_TEXT}, post AS ({postings('page_text', 'page_id')}),
            names AS (SELECT url AS page_name, min(page_id) AS page_id, NOT starts_with(url, 'http://') AS late
                FROM pages GROUP BY url),
            terms AS (SELECT doc_id AS page_id, count(*) AS n_terms FROM post GROUP BY doc_id)
            SELECT row_number() OVER (ORDER BY late, page_name) - 1 AS doc_id, page_name, late::BIGINT AS batch_id,
                coalesce(n_terms, 0)::BIGINT AS n_terms FROM names LEFT JOIN terms USING (page_id)""",
        "streamed_ids": """SELECT row_number() OVER (ORDER BY page_name) - 1 AS doc_id, page_name, 0::BIGINT AS batch_id
            FROM (SELECT DISTINCT url AS page_name FROM pages)""",
        "incremental_search": f"""{search(TWO_TERMS, 'own_text', 'page_id', ctes=PAGE_TEXT + """,
                own_text AS (SELECT * FROM page_text JOIN (SELECT min(page_id) AS page_id FROM pages GROUP BY url) USING (page_id))""")}
            SELECT query_id, round(raw, 6) AS score, url AS page_name FROM ({scored('euc')}) JOIN pages ON page_id = doc_id""",
        "streamed_batches": """WITH names AS (SELECT DISTINCT url AS page_name,
                CASE WHEN starts_with(url, 'http://') THEN 0 WHEN length(url) % 2 = 0 THEN 1 ELSE 2 END AS batch FROM pages)
            SELECT row_number() OVER (ORDER BY batch, page_name) - 1 AS doc_id, page_name, batch::BIGINT AS batch_id FROM names""",
        "excluded_pages": f"""WITH named AS (SELECT page_id, html, {list(NAME_KINDS)}[page_id % {len(NAME_KINDS)} + 1] || page_id
                || CASE WHEN page_id % 11 = 0 THEN '#top' ELSE '' END AS name FROM pages)
            SELECT page_id, NOT (starts_with(name, 'Category:') OR starts_with(name, 'Category_talk:') OR starts_with(name, 'Special:'))
                AND page_id % 7 <> 0 AND NOT contains(html, 'wgInternalRedirectTargetUrl') AS is_article,
                {_content(f"('{SITE}' || name)", 'name')} AS is_content, regexp_full_match(substr(html, 1, page_id % 3), '\\s*') AS is_blank FROM named""",
        "search_two_terms": ranked("raw", TWO_TERMS),
        "search_top_hits": f"""{search(TWO_TERMS)} SELECT query_id, doc_id, round(raw, 6) AS score
            FROM ({scored('raw')}) ORDER BY round(raw, 9) DESC, doc_id LIMIT 100""",
        "search_batch_top10": ranked("log euc", BENCHMARK, 10),
        "search_bitmaps": f"{search(FREQUENT)} SELECT query_id, doc_id, round(raw, 6) AS score FROM ({scored('raw')})",
        "search_block_top10": ranked("log euc", FREQUENT, 10),
        "search_mixed_modes": _mixed(),
        "page_search": f"""{search(TWO_TERMS, 'page_text', 'page_id', ctes=PAGE_TEXT)}
            SELECT query_id, doc_id, round(raw, 6) AS score, url FROM ({scored('euc')}) JOIN pages ON page_id = doc_id""",
        "hit_counts": f"""{search(BENCHMARK)} SELECT query_id, count(DISTINCT doc_id) AS n_hits FROM matched GROUP BY query_id""",
        "page_links": f"WITH {LINKS} SELECT url, to_url, position FROM resolved",
        "site_links": f"WITH {SITE_LINKS} SELECT * FROM site_links",
        "crawl_frontier": f"""WITH {SITE_LINKS}, firsts AS (SELECT to_page AS page_name, from_page, position,
                row_number() OVER (PARTITION BY to_page ORDER BY from_page, position) AS n FROM site_links)
            SELECT page_name, from_page, position FROM firsts
            WHERE n = 1 AND page_name NOT IN (SELECT {PAGE_NAME} FROM pages)""",
        "crawl_order": f"""WITH RECURSIVE {LINKS},
            firsts AS (SELECT page_id, url, href, min(position) AS position FROM hrefs JOIN pages USING (url) GROUP BY ALL),
            graph AS (SELECT url AS from_page, lead(url) OVER (PARTITION BY href ORDER BY page_id) AS to_page, position FROM firsts),
            edges AS (SELECT * FROM graph WHERE to_page IS NOT NULL),
            crawl(page_name, depth, from_page, position, place) USING KEY (page_name) AS (
                SELECT url, 0, NULL::VARCHAR, NULL::BIGINT, row_number() OVER (ORDER BY page_id) FROM pages
                WHERE url NOT IN (SELECT to_page FROM edges)
                UNION
                SELECT to_page, depth, from_page, position, row_number() OVER (ORDER BY place, position) FROM (
                    SELECT e.to_page, c.depth + 1 AS depth, e.from_page, e.position, c.place,
                        row_number() OVER (PARTITION BY e.to_page ORDER BY c.place, e.position) AS nth
                    FROM crawl c JOIN edges e ON e.from_page = c.page_name
                    WHERE e.to_page NOT IN (SELECT page_name FROM recurring.crawl)) WHERE nth = 1)
            SELECT page_name, depth::INTEGER AS depth, from_page, position::BIGINT AS position,
                row_number() OVER (ORDER BY depth, place) - 1 AS visit_order FROM crawl""",
        "attributes_anywhere": r"""WITH found AS (SELECT event_id, list_concat(
                CASE WHEN regexp_matches(props, '"k"') AND regexp_matches(props, '\d')
                    THEN [{'name': 'k', 'value': regexp_extract(props, '\d+')}] ELSE [] END,
                CASE WHEN regexp_matches(props, '\d\d')
                    THEN [{'name': 'tens', 'value': regexp_extract(props, '(\d)\d', 1)}] ELSE [] END) AS a FROM events)
            SELECT event_id, (i - 1)::BIGINT AS n, a[i].name AS name, a[i].value AS value
            FROM (SELECT event_id, a, unnest(range(1, len(a) + 1)) AS i FROM found)""",
        "attributes_first_success": rf"""WITH segments AS (SELECT page_id, unnest(regexp_extract_all(html, '{SEGMENT}')) AS s,
                generate_subscripts(regexp_extract_all(html, '{SEGMENT}'), 1) AS i FROM pages),
            tried AS (SELECT page_id, i, s, regexp_extract(s, '>([^<]*)<', 1) AS label, regexp_extract(s, '\d+') AS number
                FROM segments),
            named AS (SELECT page_id, i, CASE WHEN regexp_matches(s, '(?i)href="/the') AND label <> '' THEN 'article'
                WHEN number <> '' THEN 'number' WHEN label <> '' THEN 'link' END AS name, label, number FROM tried)
            SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS n, name,
                CASE WHEN name = 'number' THEN number ELSE label END AS value FROM named WHERE name IS NOT NULL""",
        "attributes_all_matches": r"""WITH segments AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]+ [a-z]+[^.]*')) AS s,
                generate_subscripts(regexp_extract_all(text, '[A-Z][a-z]+ [a-z]+[^.]*'), 1) AS i FROM documents),
            found AS (
                SELECT doc_id, i, 0 AS kind, generate_subscripts(regexp_extract_all(s, '(?i)\b(th[a-z]*) (an[a-z]*)'), 1) AS j, 'th' AS name,
                    unnest(regexp_extract_all(s, '(?i)\b(th[a-z]*) (an[a-z]*)')) AS value FROM segments
                UNION ALL
                SELECT doc_id, i, 1, 0, 'ion', 'yes' FROM segments WHERE regexp_matches(s, '(?i)tion'))
            SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, kind, j) - 1 AS n, name, value FROM found""",
        "wiki_attributes": f"""WITH {WIKI} SELECT id, (i - 1)::BIGINT AS n, attributes[i].name AS name, attributes[i].value AS value
            FROM (SELECT p_partkey AS id, attributes, unnest(range(1, len(attributes) + 1)) AS i FROM markup)""",
        "wiki_dump_scan": f"""WITH {WIKI} SELECT p_partkey AS id, (p_type = 'PROMO')::BIGINT AS ns, title, value FROM markup""",
        "changed_dumps": f"""WITH {WIKI} SELECT title, len(attributes)::BIGINT AS n_attributes, value FROM articles
            WHERE p_size BETWEEN 16 AND 35 OR p_size <= 15 AND p_partkey % 2 = 0""",
        "dump_topic_filter": f"WITH {WIKI} SELECT title, lower(category || '|' || second) AS categories FROM articles",
        "site_topic_filter": f"WITH {WIKI} SELECT title, categories FROM site",
        "title_join": f"""WITH {WIKI} SELECT title, extern_title, site_title, array_to_string(list_transform(attributes,
            lambda a: a.name || ':' || a.value), chr(9)) AS attributes, value FROM titles""",
        "brand_pairs": f"""WITH {WIKI}, a AS (SELECT split_part(title, ' ', 1) || 'x' AS k, len(attributes) AS n FROM articles),
            s AS (SELECT split_part(title, ' ', 1) || 'x' AS k, len(attributes) AS n FROM site)
            SELECT coalesce(a.k, s.k) AS title, count(*) AS n_rows, count(*) FILTER (a.k IS NOT NULL AND s.k IS NOT NULL) AS n_pairs,
                sum(coalesce(a.n, 0) + coalesce(s.n, 0))::BIGINT AS n_attributes FROM a FULL JOIN s ON lower(a.k) = lower(s.k) GROUP BY 1""",
        "attribute_strings": f"""WITH {WIKI} SELECT title, (i - 1)::BIGINT AS n, attributes[i].name AS name, attributes[i].value AS value
            FROM (SELECT title, attributes, unnest(range(1, len(attributes) + 1)) AS i FROM titles)""",
        "search_documents": f"WITH {WIKI} SELECT * FROM search_docs",
        "field_statistics": f"WITH {FIELDED} SELECT field, n_docs, round(avg_len, 6) AS avg_len FROM fstat",
        "fielded_search": f"WITH {FIELDED} SELECT query_id, doc_id, round(raw, 6) AS score FROM fhits",
        "fielded_search_top": f"""WITH {FIELDED} SELECT * FROM (SELECT query_id, doc_id, round(raw, 6) AS score,
            row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 9) DESC, doc_id) AS "rank" FROM fhits)
            WHERE "rank" <= 100""",
        "fielded_search_ranges": f"""WITH {FIELDED} SELECT query_id, doc_id, round(raw, 6) AS score, title,
            'https://en.wikipedia.org/wiki/' || {encoded('extern_title')} AS extern_url,
            'https://site.example/wiki/' || {encoded('site_title')} AS site_url
            FROM fhits JOIN (SELECT query_id, count(*) AS n FROM qt GROUP BY query_id) USING (query_id)
            JOIN search_docs USING (doc_id)
            WHERE found = n AND release BETWEEN 1950 AND 1980 AND word_size <= 35""",
        "fielded_search_query_ranges": f"""WITH {FIELDED} SELECT query_id, doc_id, round(raw, 6) AS score
            FROM fhits JOIN search_docs USING (doc_id) WHERE release >= 1945 + query_id % 20
            AND (query_id % 2 = 1 OR release <= 1960 + query_id % 20) AND (query_id % 3 <> 0 OR word_size <= 30)""",
        "fielded_search_must_not": f"""WITH {FIELDED}, serial AS (SELECT doc_id,
                5 * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * len / avg_len)) AS extra
                FROM fpost JOIN fdf USING (field, term) JOIN fstat USING (field) JOIN flen USING (field, doc_id)
                WHERE field = 'architecture' AND term = 'serial')
            SELECT query_id, doc_id, round(raw + extra, 6) AS score FROM fhits JOIN serial USING (doc_id)
            WHERE doc_id NOT IN (SELECT doc_id FROM fpost WHERE field = 'logic' AND term = 'transistor')""",
        "fielded_search_one_field": f"""WITH {FIELDED} SELECT query_id, doc_id, round(sum(score), 6) AS score
            FROM contributions WHERE field = 'company' GROUP BY ALL""",
        "range_search": f"""WITH {WIKI} SELECT doc_id, 0.0::DOUBLE AS score FROM search_docs
            WHERE clock_speed BETWEEN 10e6 AND 40e6""",
        "most_frequent_quantity": """SELECT l_suppkey, l_quantity FROM (SELECT l_suppkey, l_quantity,
            row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_quantity) AS n
            FROM lineitem GROUP BY l_suppkey, l_quantity) WHERE n = 1""",
        "document_number": r"""WITH found AS (SELECT doc_id, unnest(regexp_extract_all(text, '\d+'))::DOUBLE AS v FROM documents),
            best AS (SELECT doc_id, v, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, v) AS n
                FROM found GROUP BY doc_id, v)
            SELECT doc_id, CASE WHEN v IS NOT NULL THEN least(v, 2147483647)::INTEGER END AS number
            FROM documents LEFT JOIN (SELECT doc_id, v FROM best WHERE n = 1) USING (doc_id)""",
        "parsed_numbers": """SELECT event_id,
            round(CASE event_type WHEN 'error' THEN 16.0 WHEN 'view' THEN 1e18 ELSE value END, 6) AS number,
            CASE event_type WHEN 'error' THEN 16000 WHEN 'view' THEN 2147483647
                WHEN 'click' THEN trunc(least(value * 1e6, 2147483647)) ELSE trunc(least(value * 1e9, 2147483647)) END::INTEGER AS hertz
            FROM events""",
        "technologies": f"""WITH {WIKI} SELECT p_partkey AS id, CASE WHEN p_size > 25 THEN 'serial' ELSE 'parallel' END AS architecture,
            CASE p_type WHEN 'STANDARD' THEN 'vacuum-tubes' WHEN 'LARGE' THEN 'electro-mechanical' ELSE 'transistor' END AS logic
            FROM dump""",
    }
    for name, mode in (("raw", "raw"), ("log", "log"), ("max_tf", "max"), ("euc", "euc"), ("cos", "cos")):
        sql[f"search_batch_{name}"] = batch(mode)
    return sql
