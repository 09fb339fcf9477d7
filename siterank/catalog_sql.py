"""The bound queries as DuckDB SQL over the same tables, for comparing results.

The statements are written from the meaning of the operators, independently of the
DataFrame code, patterns included; only lists of fixed values are shared.
"""

from __future__ import annotations

from siterank.functions.urls import PATH_SAFE
from siterank.operators.pages import IGNORED_EXTENSIONS
from siterank.schemas import DOC_KEYWORDS

SQL: dict[str, str] = {}

# White space as the Spark side means it, spelled out for another regex library.
SPACES = (
    r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
SPACE_RUN = f"[{SPACES}]+"
WORD_RUN = f"[^{SPACES}]+"
# Letters and digits of any script; the same with the underscore, to split at.
LETTERS_DIGITS = r"[\p{L}\p{N}]+"
BETWEEN_WORDS = r"[^\p{L}\p{N}_]+"
# Parts of an address: 1 scheme, 2 and 3 host, 4 path, 5 and 6 query, 7 fragment.
ADDRESS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(?:#(.*))?$"
EDGE_SPACE = f"^[{SPACES}]+|[{SPACES}]+$"

PAGE_KEYWORDS = "('blog', 'en', 'fr', 'html')"
TITLE_KEYWORDS = "('the', 'and', 'de', 'der', 'la')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '{EDGE_SPACE}', '', 'g')"


def words(x: str) -> str:
    return f"regexp_extract_all({x}, '{WORD_RUN}')"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{LETTERS_DIGITS}')"


def url_part(x: str, group: int) -> str:
    return f"regexp_extract({x}, '{ADDRESS}', {group})"


def netloc(x: str) -> str:
    return url_part(x, 3)


def canonical_path(x: str) -> str:
    """Percent-escaped path, reserved characters kept."""
    out = f"url_encode(url_decode({x}))"
    for escape, char in PATH_SAFE.items():
        quoted = "''" if char == "'" else char
        out = f"replace({out}, '{escape}', '{quoted}')"
    return f"CASE WHEN {x} = '' THEN '/' ELSE {out} END"


def canonical(x: str) -> str:
    query = url_part(x, 6)
    args = (
        f"list_sort(list_transform(list_filter(string_split({query}, '&'), lambda a: a <> ''), "
        "lambda a: CASE WHEN contains(a, '=') THEN a ELSE a || '=' END))"
    )
    return (
        f"lower({url_part(x, 1)}) || '://' || lower({netloc(x)}) || "
        f"{canonical_path(url_part(x, 4))} || "
        f"CASE WHEN {query} = '' THEN '' ELSE '?' || array_to_string({args}, '&') END"
    )


def unescape(x: str) -> str:
    for entity, char in {
        "&quot;": '"',
        "&lt;": "<",
        "&gt;": ">",
        "&copy;": "©",
        "&middot;": "·",
        "&amp;": "&",
    }.items():
        x = f"replace({x}, '{entity}', '{char}')"
    return x


HREF = """(?is)<a\\s[^>]*?href\\s*=\\s*["'']([^"'']*)["'']"""
ANCHOR = """(?is)<a\\s[^>]*?href\\s*=\\s*["''][^"'']*["''][^>]*>.*?</a>"""
IGNORED = r"(?i)\.(" + "|".join(e.replace(".", r"\.") for e in IGNORED_EXTENSIONS) + ")$"

# Links of all pages; the hrefs of the sample pages are rooted paths.
PAGE_LINKS = f"""
anchors AS (
    SELECT page_id, url, unnest(regexp_extract_all(html, '{ANCHOR}')) AS a FROM pages
), hrefs AS (
    SELECT page_id, url, {canonical('url')} AS src, regexp_extract(a, '{HREF}', 1) AS href,
        regexp_replace(regexp_extract(a, '(?is)^<a[^>]*>(.*)</a>$', 1), '<[^>]*>', '', 'g') AS label
    FROM anchors
), links AS (
    SELECT page_id, src,
        lower({url_part('url', 1)}) || '://' || lower({netloc('url')}) || {canonical_path('href')} AS dst,
        {strip(f"regexp_replace(label, '{SPACE_RUN}', ' ', 'g')")} AS text,
        '' AS fragment
    FROM hrefs
    WHERE href LIKE '/%' AND NOT regexp_matches(href, '{IGNORED}')
)"""

ARTICLE_LINES = (
    "regexp_replace(regexp_replace(regexp_extract(html, '(?is)<article[^>]*>(.*)</article>', 1), "
    "'(?i)</?(p|h1|br)\\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g')"
)
CONTENT_LINES = (
    f"list_filter(list_transform(string_split({unescape(ARTICLE_LINES)}, chr(10)), "
    f"lambda l: array_to_string({words('l')}, ' ')), lambda l: l <> '')"
)
CONTENT = f"array_to_string({CONTENT_LINES}, chr(10))"
RAW_TITLE = "regexp_extract(html, '(?is)<title[^>]*>([^<]*)<', 1)"

# One row per page: what a crawl record of it holds.
PAGE_RECORDS = f"""
{PAGE_LINKS.strip()}, page_links AS (
    SELECT page_id, count(*) AS n_links, count(DISTINCT dst) AS n_targets FROM links GROUP BY page_id
), records AS (
    SELECT p.page_id, {netloc('url')} AS crawl_domain, {canonical('url')} AS url,
        {strip(unescape(RAW_TITLE))} AS title,
        {CONTENT} AS content,
        len(list_filter(regexp_extract_all(html, '(?is)<b>([^<]*)', 1), lambda b: {strip('b')} <> '')) AS n_snippets,
        list_transform(list_filter(regexp_extract_all(html, '(?is)<b>([^<]*)', 1),
            lambda b: {strip('b')} <> ''), lambda b: {strip(unescape('b'))}) AS snippets,
        coalesce(n_targets, 0) AS n_targets, coalesce(n_links, 0) AS n_links
    FROM pages p LEFT JOIN page_links l ON l.page_id = p.page_id
)"""

SQL["page_titles"] = f"SELECT page_id, {strip(RAW_TITLE)} AS title FROM pages WHERE regexp_matches(html, '(?is)<title[^>]*>[^<]*<')"

SQL["page_tag_texts"] = f"""
WITH t AS (
    SELECT page_id, list_filter(list_transform(
        regexp_extract_all(html, '(?is)<p(?:\\s[^>]*)?>([^<]*)', 1), lambda x: {strip('x')}), lambda x: x <> '') AS l
    FROM pages
)
SELECT page_id, unnest(range(len(l))) AS pos, unnest(l) AS text FROM t"""

SQL["page_links"] = f"WITH {PAGE_LINKS} SELECT page_id, src, dst, text, fragment FROM links"

SQL["grouped_links"] = f"""
WITH {PAGE_LINKS}
SELECT page_id, dst, count(*) AS n, string_agg(text, '|' ORDER BY text) AS texts
FROM links GROUP BY page_id, dst"""

SQL["main_content"] = f"SELECT page_id, {CONTENT} AS content FROM pages"

URL_PATH = f"regexp_replace({url_part('url', 4)}, ';[^/]*$', '')"
SQL["content_types"] = f"""
SELECT page_id, CASE WHEN {URL_PATH} LIKE '%.html' THEN 'text/html; charset=utf-8' ELSE 'text/plain' END AS content_type
FROM pages WHERE {URL_PATH} LIKE '%.html' OR {URL_PATH} LIKE '%/'"""

SQL["header_dates"] = """
SELECT event_id, CASE WHEN event_type <> 'error' THEN CAST(epoch(date_trunc('second', ts)) AS BIGINT) END AS date
FROM events"""

SQL["page_records"] = f"""
WITH {PAGE_RECORDS}
SELECT page_id, crawl_domain, url, title, len({words('content')}) AS content_len, n_snippets, n_targets, n_links
FROM records"""

SQL["canonical_urls"] = f"SELECT page_id, {canonical('url')} AS canonical FROM pages"

SQL["url_netloc"] = f"""
SELECT page_id, {netloc('url')} AS netloc, regexp_replace({netloc('url')}, '^www\\.', '') AS no_www,
    replace(replace({strip(f"lower({netloc('url')})")}, 'www.', ''), '.', '_') AS underscored
FROM pages"""


def url_keywords(x: str) -> str:
    path = f"regexp_replace({url_part(x, 4)}, ';[^/]*$', '')"
    return (
        f"len(list_filter(list_concat(list_concat(string_split({netloc(x)}, '.'), "
        f"regexp_split_to_array({path}, '{BETWEEN_WORDS}')), "
        f"regexp_split_to_array({url_part(x, 7)}, '{BETWEEN_WORDS}')), lambda w: w IN %s))"
    )


SQL["url_keyword_count"] = f"SELECT page_id, {url_keywords('url') % PAGE_KEYWORDS} AS n_keywords FROM pages"

KEYWORD_LIST = "[" + ", ".join(f"'{k}'" for k in DOC_KEYWORDS) + "]"
CANDIDATES = f"""
hosts AS (
    SELECT DISTINCT regexp_replace({netloc('url')}, '^www\\.', '') AS domain FROM pages
), keywords AS (
    SELECT unnest({KEYWORD_LIST}) AS word, unnest(range({len(DOC_KEYWORDS)})) AS i
), candidates AS (
    SELECT domain, 2 * i AS ord, 'https://' || word || '.' || domain AS candidate FROM hosts, keywords
    UNION ALL
    SELECT domain, 2 * i + 1, 'https://' || domain || '/' || word FROM hosts, keywords
)"""
SQL["start_candidates"] = f"WITH {CANDIDATES} SELECT domain, ord, candidate FROM candidates"

SQL["select_start"] = f"""
WITH {CANDIDATES}, found AS (
    SELECT domain, arg_min(candidate || '/home', ord) AS url FROM candidates
    WHERE length(candidate) % 5 = 0 GROUP BY domain
)
SELECT h.domain, coalesce(f.url, 'https://' || h.domain) AS start_url
FROM hosts h LEFT JOIN found f ON f.domain = h.domain
WHERE h.domain NOT LIKE 'spam%'"""

SQL["next_frontier"] = f"""
WITH {PAGE_LINKS}, fresh AS (
    SELECT DISTINCT {netloc('src')} AS domain, dst AS url FROM links
    EXCEPT SELECT {netloc(canonical('url'))}, {canonical('url')} FROM pages
), rated AS (
    SELECT domain, url, {url_keywords('url') % "('in', 'of', 'la', 'die')"} AS priority FROM fresh
)
SELECT domain, url, priority, row_number() OVER (PARTITION BY domain ORDER BY priority DESC, url) AS rank
FROM rated QUALIFY rank <= 5"""

SQL["dedupe_events"] = """
SELECT user_id, event_type, min(event_id) AS event_id, arg_min(value, event_id) AS value, count(*) - 1 AS url_num_appears
FROM events GROUP BY user_id, event_type"""

SQL["dedupe_documents"] = """
SELECT min(doc_id) AS doc_id, arg_min(source, doc_id) AS source, count(*) - 1 AS url_num_appears
FROM documents GROUP BY text"""

SQL["title_keyword_count"] = f"""
SELECT doc_id, len(list_distinct(list_filter({words("lower(string_split(text, chr(10))[1])")},
    lambda w: w IN {TITLE_KEYWORDS}))) AS term_in_title
FROM documents"""

CODE = f"array_to_string(list_transform(string_split(text, chr(10)), lambda l: {strip('l')}), chr(10))"
SQL["word_counts"] = f"""
SELECT doc_id, len({words(strip('text'))}) AS content_len, len({words(CODE)}) AS code_len, length({CODE}) AS code_chars
FROM documents"""

SQL["out_links"] = f"""
WITH {PAGE_LINKS}, targets AS (
    SELECT page_id, count(DISTINCT dst) AS n, string_agg(DISTINCT dst, ' ' ORDER BY dst) AS targets
    FROM links GROUP BY page_id
)
SELECT p.page_id, coalesce(n, 0) AS out_links_len, coalesce(targets, '') AS targets
FROM pages p LEFT JOIN targets t ON t.page_id = p.page_id"""

SQL["crawl_roundtrip"] = f"""
WITH {PAGE_RECORDS}
SELECT page_id, crawl_domain, url, title, len({words('content')}) AS content_len, n_links FROM records"""

HOST_STAT = f"SELECT {netloc('url')} AS domain, count(*) AS n_docs FROM pages GROUP BY domain"
SQL["index_stat"] = HOST_STAT
SQL["index_stat_merge"] = f"""
SELECT {netloc('url')} AS domain, count(*) + count(*) FILTER (url LIKE 'https:%') AS n_docs FROM pages GROUP BY domain"""

SQL["in_links"] = """
WITH e AS (
    SELECT l_partkey AS doc_id, CAST(l_suppkey AS VARCHAR) AS src, l_orderkey * 8 + l_linenumber AS ord, l_returnflag AS text
    FROM lineitem
), numbered AS (
    SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY src, ord) - 1) // 16 AS chunk FROM e
)
SELECT doc_id, chunk, string_agg(src, ' ' ORDER BY src, ord) AS in_urls, string_agg(text, ' ' ORDER BY src, ord) AS in_texts
FROM numbered GROUP BY doc_id, chunk"""

FEATURES = ["term_in_url", "term_in_title", "content_len", "code_len", "num_in_urls"]
PARTS = """
degrees AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey),
linked AS (
    SELECT p_partkey AS doc_id, p_brand AS crawl_file, p_name AS url,
        CASE WHEN p_size <> 13 THEN p_size END AS date,
        length(p_type) AS term_in_url, p_size % 3 AS term_in_title, p_size AS content_len,
        length(p_name) AS code_len, p_size % 7 AS out_links_len, coalesce(n, 0) AS num_in_urls
    FROM part LEFT JOIN degrees ON l_partkey = p_partkey
)"""
Z = ", ".join(
    f"(l.{f} - m_{f}) / CASE WHEN s_{f} <> 0 THEN s_{f} END AS normalized_{f}" for f in FEATURES
)
MOMENTS = ", ".join(f"avg({f}) AS m_{f}, stddev_samp({f}) AS s_{f}" for f in FEATURES)
IMPORTANCE = " + ".join(f"normalized_{f}" for f in ["term_in_url", "term_in_title", "code_len", "content_len"])
RATED = f"""
{PARTS.strip()}, moments AS (SELECT crawl_file, {MOMENTS} FROM linked GROUP BY crawl_file),
scored AS (SELECT l.*, {Z} FROM linked l JOIN moments m ON m.crawl_file = l.crawl_file),
rated AS (SELECT *, round({IMPORTANCE}, 9) AS importance, (num_in_urls + 1) // (out_links_len + 1) AS in_out_ratio FROM scored)"""

SQL["enriched"] = f"WITH {PARTS} SELECT doc_id, num_in_urls, out_links_len FROM linked"
SQL["in_out_ratio"] = f"WITH {PARTS} SELECT doc_id, (num_in_urls + 1) // (out_links_len + 1) AS in_out_ratio FROM linked"
SQL["feature_stats"] = f"""
WITH {PARTS}
SELECT crawl_file, count(*) AS n, {", ".join(f"round(avg({f}), 6) AS mean_{f}, round(stddev_samp({f}), 6) AS std_{f}" for f in FEATURES)}
FROM linked GROUP BY crawl_file"""
SQL["document_stats"] = f"""
WITH d AS (SELECT lang, source, len({words('text')}) AS content_len, n_chars AS chars FROM documents)
SELECT lang, source, count(*) AS n, {", ".join(f"round(avg({f}), 5) AS mean_{f}, round(stddev_samp({f}), 5) AS std_{f}" for f in ["content_len", "chars"])}
FROM d GROUP BY lang, source"""
SQL["zscores"] = f"""
WITH {RATED}
SELECT doc_id, {", ".join(f"round(normalized_{f}, 6) AS normalized_{f}" for f in FEATURES)}, round(importance, 6) AS importance
FROM rated"""
SQL["top_n_selected"] = f"""
WITH {RATED}, top AS (
    SELECT *, row_number() OVER (PARTITION BY crawl_file ORDER BY importance DESC NULLS LAST, url, doc_id) AS rank
    FROM rated QUALIFY rank <= 20
)
SELECT crawl_file, rank, doc_id, round(importance, 6) AS importance FROM top WHERE date IS NOT NULL"""
VECTOR = [*FEATURES, "in_out_ratio", *[f"normalized_{f}" for f in FEATURES]]
SQL["feature_vector"] = f"""
WITH {RATED}
SELECT doc_id, {", ".join(f"round(CAST(CAST(coalesce({f}, 0) AS FLOAT) AS DOUBLE), 3) AS f{i}" for i, f in enumerate(VECTOR))}
FROM rated"""

SQL["selected_pages"] = f"""
WITH {PAGE_RECORDS}, featured AS (
    SELECT crawl_domain AS crawl_file, url, {url_keywords('url') % PAGE_KEYWORDS} AS term_in_url,
        len(list_distinct(list_filter({words("lower(title)")}, lambda w: w IN {PAGE_KEYWORDS}))) AS term_in_title,
        len({words('content')}) AS content_len,
        len({words("array_to_string(snippets, chr(10))")}) AS code_len,
        n_targets AS out_links_len, page_id
    FROM records
), pages_once AS (
    SELECT crawl_file, url, arg_min(term_in_url, page_id) AS term_in_url, arg_min(term_in_title, page_id) AS term_in_title,
        arg_min(content_len, page_id) AS content_len, arg_min(code_len, page_id) AS code_len,
        arg_min(out_links_len, page_id) AS out_links_len, count(*) - 1 AS url_num_appears
    FROM featured GROUP BY crawl_file, url
), pairs AS (SELECT DISTINCT page_id, dst FROM links), degrees AS (
    SELECT crawl_domain AS crawl_file, dst, count(*) AS n FROM pairs JOIN records USING (page_id) GROUP BY crawl_domain, dst
), linked AS (
    SELECT p.*, coalesce(n, 0) AS num_in_urls FROM pages_once p LEFT JOIN degrees d ON d.crawl_file = p.crawl_file AND d.dst = p.url
), rated AS (
    SELECT *, (num_in_urls + 1) // (out_links_len + 1) AS in_out_ratio,
        round((content_len - avg(content_len) OVER w) / nullif(stddev_samp(content_len) OVER w, 0), 9) AS importance
    FROM linked WINDOW w AS (PARTITION BY crawl_file)
)
SELECT crawl_file, row_number() OVER (PARTITION BY crawl_file ORDER BY importance DESC NULLS LAST, url) AS rank, url,
    url_num_appears, term_in_url, term_in_title, content_len, code_len, out_links_len, num_in_urls, in_out_ratio,
    round(importance, 6) AS importance
FROM rated QUALIFY rank <= 3"""


def doc_url(i: str) -> str:
    return f"'https://' || source || '.example.org/docs/' || CAST({i} AS VARCHAR)"


LANGUAGE_CODE = f"array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda l: contains(l, '(')), lambda l: {strip('l')}), chr(10))"
DOCUMENT_LINKS = f"""
doc_links AS (
    SELECT DISTINCT doc_id, source, lang, {doc_url('doc_id')} AS url, unnest([{doc_url('(doc_id - doc_id % 40 + doc_id % 20)')}, {doc_url('(doc_id % 20)')}]) AS dst
    FROM documents
)"""
SQL["selected_documents"] = f"""
WITH {DOCUMENT_LINKS}, degrees AS (SELECT source, dst, count(*) AS n FROM doc_links GROUP BY source, dst),
outs AS (SELECT doc_id, count(*) AS out_links_len FROM doc_links GROUP BY doc_id),
linked AS (
    SELECT d.source AS crawl_file, {doc_url('d.doc_id').replace('source', 'd.source')} AS url, 1 AS term_in_url,
        len(list_distinct(list_filter({words("lower(string_split(text, chr(10))[1])")},
            lambda w: w IN ('docs', 'the', 'and', 'de', 'der', 'la')))) AS term_in_title,
        len({words('text')}) AS content_len, len({words(LANGUAGE_CODE)}) AS code_len, out_links_len, coalesce(n, 0) AS num_in_urls
    FROM documents d JOIN outs o ON o.doc_id = d.doc_id
    LEFT JOIN degrees g ON g.source = d.source AND g.dst = {doc_url('d.doc_id').replace('source', 'd.source')}
), rated AS (
    SELECT *, (num_in_urls + 1) // (out_links_len + 1) AS in_out_ratio,
        round((content_len - avg(content_len) OVER w) / nullif(stddev_samp(content_len) OVER w, 0)
            + (num_in_urls - avg(num_in_urls) OVER w) / nullif(stddev_samp(num_in_urls) OVER w, 0), 9) AS importance
    FROM linked WINDOW w AS (PARTITION BY crawl_file)
)
SELECT crawl_file, row_number() OVER (PARTITION BY crawl_file ORDER BY importance DESC NULLS LAST, url) AS rank, url,
    term_in_url, term_in_title, content_len, code_len, out_links_len, num_in_urls, in_out_ratio,
    round(importance, 6) AS importance
FROM rated QUALIFY rank <= 25"""
# The anchor texts are the language codes, in English stems, and the word "home".
SQL["indexed_document_stats"] = f"""
WITH {DOCUMENT_LINKS}, words AS (
    SELECT source, dst, lang AS term FROM doc_links
    UNION ALL SELECT source, dst, 'home' FROM doc_links WHERE dst = {doc_url('(doc_id % 20)')}
)
SELECT term, count(DISTINCT w.dst) AS df
FROM words w JOIN documents d ON w.dst = {doc_url('d.doc_id').replace('source', 'd.source')} AND w.source = d.source
GROUP BY term"""


def token_table(source: str, key: str, column: str) -> str:
    """One row per token; the position counts tokens of 40 bytes or more as well."""
    return f"""(
    SELECT {key}, pos, term FROM (
        SELECT {key}, unnest(range(len(t))) AS pos, unnest(t) AS term
        FROM (SELECT {key}, {tokens(column)} AS t FROM {source})
    ) WHERE strlen(term) < 40
)"""


DOC_TOKENS = f"doc_tokens AS {token_table('documents', 'doc_id', 'text')}"
SQL["document_postings"] = f"""
WITH {DOC_TOKENS}, lengths AS (SELECT doc_id, count(*) AS field_len FROM doc_tokens GROUP BY doc_id)
SELECT t.doc_id, term, count(*) AS tf, string_agg(CAST(pos AS VARCHAR), ' ' ORDER BY pos) AS positions,
    any_value(field_len) AS field_len
FROM doc_tokens t JOIN lengths l ON l.doc_id = t.doc_id GROUP BY t.doc_id, term"""
SQL["postings_stats"] = f"WITH {DOC_TOKENS} SELECT term, count(DISTINCT doc_id) AS df FROM doc_tokens GROUP BY term"
SQL["field_stats"] = f"""
WITH {DOC_TOKENS}, n AS (SELECT count(*) AS n_docs FROM documents), total AS (SELECT count(*) AS total_len FROM doc_tokens)
SELECT n_docs, total_len, round(total_len / n_docs, 6) AS mean_len FROM n, total"""


def subterms(term: str) -> str:
    """Sub-terms of a term: the first three separators become a mark to split at."""
    cut = f"regexp_replace({term}, '[^\\p{{L}}\\p{{N}}\\x01]+', chr(1))"
    for _ in range(2):
        cut = f"regexp_replace({cut}, '[^\\p{{L}}\\p{{N}}\\x01]+', chr(1))"
    parts = f"string_split({cut}, chr(1))"
    return (
        f"list_filter(CASE WHEN len({parts}) > 1 THEN list_concat([array_to_string({parts}, '')], "
        f"list_filter({parts}, lambda p: length(p) > 1)) ELSE [{term}] END, lambda f: f <> '')"
    )


BENCHMARK_CLAUSES = f"""
query_words AS (SELECT item_id AS query_id, unnest({words('lower(text)')}) AS term FROM benchmark),
forms AS (SELECT query_id, unnest({subterms('term')}) AS form FROM query_words),
clauses AS (SELECT query_id, form AS term, count(*) AS weight FROM forms WHERE strlen(form) < 40 GROUP BY query_id, form)"""


def bm25(weight: str, idf: str, tf: str, length: str, mean: str) -> str:
    return f"{weight} * {idf} * {tf} * 2.2 / ({tf} + 1.2 * (0.25 + 0.75 * {length} / {mean}))"


DOC_SCORES = f"""
{DOC_TOKENS}, {BENCHMARK_CLAUSES.strip()},
lengths AS (SELECT doc_id, count(*) AS field_len FROM doc_tokens GROUP BY doc_id),
tfs AS (
    SELECT doc_id, term, count(*) AS tf FROM doc_tokens
    WHERE term IN (SELECT term FROM clauses) GROUP BY doc_id, term
),
collection AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM doc_tokens) AS total),
idfs AS (
    SELECT term, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tfs, collection GROUP BY term
),
scores AS (
    SELECT query_id, doc_id, round(sum({bm25('weight', 'idf', 'tf', 'field_len', '(total / n)')}), 9) AS score
    FROM clauses JOIN tfs USING (term) JOIN idfs USING (term) JOIN lengths USING (doc_id), collection
    GROUP BY query_id, doc_id
)"""
SQL["bm25_topn"] = f"""
WITH {DOC_SCORES}
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
FROM scores QUALIFY rank <= 10"""

SQL["search_titles_deduped"] = f"""
WITH {DOC_SCORES}, ranked AS (
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
    FROM scores QUALIFY rank <= 20
), titled AS (
    SELECT r.*, string_split(text, chr(10))[1] AS title FROM ranked r JOIN documents d ON d.doc_id = r.doc_id
), firsts AS (
    SELECT * FROM titled QUALIFY row_number() OVER (PARTITION BY query_id, title ORDER BY rank) = 1
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank, doc_id, title, score
FROM firsts QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 10"""

SQL["phrase_match"] = f"""
WITH {DOC_TOKENS}, phrases AS (
    SELECT item_id AS query_id, {tokens('text')} AS t FROM benchmark
), wanted AS (SELECT query_id, len(t) AS n, unnest(range(len(t))) AS i, unnest(t) AS term FROM phrases),
starts AS (
    SELECT query_id, doc_id, pos - i AS base FROM wanted JOIN doc_tokens USING (term)
    GROUP BY query_id, doc_id, base HAVING count(*) = any_value(n)
)
SELECT query_id, doc_id, count(*) AS freq FROM starts GROUP BY query_id, doc_id"""

SQL["fielded_search"] = f"""
WITH docs AS (SELECT page_id, url, {strip(RAW_TITLE)} AS title FROM pages),
toks AS (
    SELECT page_id, 'url' AS field, pos, term FROM {token_table('docs', 'page_id', 'url')}
    UNION ALL SELECT page_id, 'title', pos, term FROM {token_table('docs', 'page_id', 'title')}
), lengths AS (SELECT page_id, field, count(*) AS field_len FROM toks GROUP BY page_id, field),
collection AS (SELECT field, sum(field_len) / (SELECT count(*) FROM pages) AS mean FROM lengths GROUP BY field),
sites AS (
    SELECT DISTINCT {netloc('url')} AS site, unnest({tokens('title')}) AS word FROM docs
), clauses AS (
    SELECT DISTINCT site, 'url' AS field, site AS value, 4.0 AS weight FROM sites
    UNION ALL SELECT site, 'title', word, 3.0 FROM sites
    UNION ALL SELECT site, 'url', word, 1.0 FROM sites
), split_clauses AS (SELECT *, {tokens('value')} AS t FROM clauses),
wanted AS (SELECT site, field, value, weight, len(t) AS n, unnest(range(len(t))) AS i, unnest(t) AS term FROM split_clauses),
dfs AS (SELECT field, term, count(DISTINCT page_id) AS df FROM toks GROUP BY field, term),
idfs AS (
    SELECT site, field, value, sum(ln(1 + ((SELECT count(*) FROM pages) - df + 0.5) / (df + 0.5))) AS idf
    FROM wanted JOIN dfs USING (field, term) GROUP BY site, field, value
), starts AS (
    SELECT site, field, value, any_value(weight) AS weight, page_id, pos - i AS base
    FROM wanted JOIN toks USING (field, term)
    GROUP BY site, field, value, page_id, base HAVING count(*) = any_value(n)
), freqs AS (
    SELECT site, field, value, any_value(weight) AS weight, page_id, count(*) AS tf FROM starts GROUP BY site, field, value, page_id
), scores AS (
    SELECT site, page_id, round(sum({bm25('weight', 'idf', 'tf', 'field_len', 'mean')}), 9) AS score
    FROM freqs JOIN idfs USING (site, field, value) JOIN lengths USING (page_id, field) JOIN collection USING (field)
    GROUP BY site, page_id
)
SELECT site, row_number() OVER (PARTITION BY site ORDER BY score DESC, page_id) AS rank, page_id, score
FROM scores QUALIFY rank <= 10"""

# Query strings of the user turns; the blanks and line ends return by decoding.
QUERY_TERMS = f"""
user_queries AS (SELECT conv_id * 1000 + turn AS query_id, text FROM conversations WHERE role = 'user'),
term_lists AS (SELECT query_id, text, {words('lower(text)')} AS t FROM user_queries),
terms AS (SELECT query_id, unnest(range(len(t))) AS pos, unnest(t) AS term FROM term_lists)"""
SQL["query_decode"] = f"WITH {QUERY_TERMS} SELECT query_id, text AS in_query FROM user_queries"
SQL["query_terms"] = f"WITH {QUERY_TERMS} SELECT query_id, pos, term FROM terms"
SQL["query_subterms"] = f"WITH {QUERY_TERMS} SELECT query_id, pos, array_to_string({subterms('term')}, ' ') AS subterms FROM terms"

EXPANDED = f"""
{QUERY_TERMS.strip()},
lang_sites(term, site) AS (VALUES ('in', 'docs.in.example'), ('in', 'in.example.org'), ('que', 'que.example.net'), ('der', 'der.example.com')),
code_terms(term) AS (VALUES ('la'), ('is'), ('ver')),
unique_sites(term, site) AS (VALUES ('la', 'lasite'), ('the', 'thesite'), ('the', 'another'), ('que', 'never')),
split_terms AS (SELECT query_id, pos, term, {subterms('term')} AS forms FROM terms),
own AS (SELECT query_id, pos, unnest(range(len(forms))) AS i, unnest(forms) AS value FROM split_terms),
langs AS (SELECT DISTINCT query_id, pos, site FROM own JOIN lang_sites ON lang_sites.term = own.value),
found AS (SELECT DISTINCT query_id, pos FROM langs),
others AS (SELECT * FROM terms t WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.query_id = t.query_id AND f.pos = t.pos)),
parts AS (
    SELECT query_id, pos, 0 AS kind, i AS k, '' AS site, 0 AS j, NULL AS field, value AS text, 1.0 AS boost FROM own
    UNION ALL SELECT f.query_id, f.pos, 1, 0, '', 0, 'title', term, 2.0 FROM found f JOIN terms t ON t.query_id = f.query_id AND t.pos = f.pos
    UNION ALL SELECT query_id, pos, 2, 0, site, 0, 'url', site, 4.0 FROM langs
    UNION ALL SELECT query_id, pos, 2, 0, site, 1, 'title', site, 2.0 FROM langs
    UNION ALL SELECT query_id, pos, 1, 0, '', 0, 'code', term, 1.5 FROM others WHERE term IN (SELECT term FROM code_terms)
    UNION ALL SELECT query_id, pos, 2, 0, site, 0, 'url', site, 4.0 FROM others JOIN unique_sites USING (term)
    UNION ALL SELECT query_id, pos, 2, 0, site, 1, 'title', site, 2.0 FROM others JOIN unique_sites USING (term)
), clauses AS (
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY pos, kind, k, site, j) - 1 AS seq, field, text, boost FROM parts
)"""
SQL["query_clauses"] = f"WITH {EXPANDED} SELECT query_id, seq, field, text, CAST(boost AS DOUBLE) AS boost FROM clauses"
SQL["query_expand"] = f"""
WITH {EXPANDED}, rendered AS (
    SELECT query_id, string_agg(CASE WHEN field IS NULL THEN text
        ELSE field || ':' || text || '^' || CASE WHEN boost = 1.5 THEN '1.5' ELSE CAST(CAST(boost AS INTEGER) AS VARCHAR) END END, ' ' ORDER BY seq) AS expanded_query
    FROM clauses GROUP BY query_id
)
SELECT l.query_id, coalesce(expanded_query, '') AS expanded_query, len(t) AS query_len
FROM term_lists l LEFT JOIN rendered r ON r.query_id = l.query_id"""


def page_events(kind: str) -> str:
    return (
        "SELECT e.ts, e.value, p.url FROM events e JOIN pages p "
        f"ON p.page_id = e.user_id % (SELECT count(*) FROM pages) WHERE event_type = '{kind}'"
    )


def domain_counts(kind: str) -> str:
    return f"SELECT {netloc('url')} AS domain, count(*) AS n FROM ({page_events(kind)}) GROUP BY domain"


SQL["impressions_by_domain"] = domain_counts("view")
SQL["clicks_by_domain"] = domain_counts("click")
SQL["stream_clicks"] = domain_counts("click")
# Pages with the same canonical URL are one document.
SQL["stream_index"] = f"""
SELECT {netloc('url')} AS domain, count(DISTINCT {canonical('url')}) AS n_docs FROM pages GROUP BY domain"""
SQL["top_domains"] = f"{domain_counts('view')} ORDER BY n DESC, domain LIMIT 3"
SQL["latency_summary"] = (
    "SELECT count(*) AS processed_queries, round(avg(CAST(round(value * 100) AS BIGINT)), 6) AS avg_latency FROM events"
)
SQL["latency_running_mean"] = """
SELECT event_id AS query_id, row_number() OVER w AS processed_queries, sum(CAST(round(value * 100) AS BIGINT)) OVER w / row_number() OVER w AS avg_latency
FROM events WINDOW w AS (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"""
SQL["index_totals"] = f"SELECT sum(n_docs) AS docs_in_index, count(*) AS domains_in_index FROM ({HOST_STAT})"


def top_list(counts: str, n: str) -> str:
    return (
        f"(SELECT string_agg(domain || '=' || {n}, ' ' ORDER BY {n} DESC, domain) "
        f"FROM (SELECT * FROM ({counts}) ORDER BY {n} DESC, domain LIMIT 3))"
    )


SQL["service_summary"] = f"""
SELECT sum(n_docs) AS docs_in_index, count(*) AS domains_in_index,
    {top_list(HOST_STAT, 'n_docs')} AS top_domains,
    (SELECT count(*) FROM events) AS processed_queries,
    (SELECT round(avg(CAST(round(value * 100) AS BIGINT)), 6) FROM events) AS avg_latency,
    {top_list(domain_counts('view'), 'n')} AS top_showed_domains,
    {top_list(domain_counts('click'), 'n')} AS top_clicked_domains
FROM ({HOST_STAT})"""
SQL["bm25_topn_blocks"] = SQL["bm25_topn"]
