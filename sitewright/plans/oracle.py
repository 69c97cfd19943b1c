"""DuckDB SQL for the results of the queries of the same names."""

from __future__ import annotations

from sitewright.config import BLOCKED_PHRASES, HINTS, PATHS, SHORT_PATHS, STOPWORDS, Config


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _values(xs) -> str:
    return ", ".join(f"({_q(x)})" for x in xs)


def _list(xs) -> str:
    return ", ".join(map(_q, xs))


# Patterns are written here anew, not taken from the code that they check.
_DIRECT = _q(r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b")
_BODY = _q(r"[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}")
_WRITTEN = _q(r"(?i)([a-z0-9._%+\-]+)\s*(?:\(|\[)?\s*(?:at|@)\s*(?:\)|\])?\s*([a-z0-9.\-]+)\s*(?:\(|\[)?\s*(?:dot|\.)\s*(?:\)|\])?\s*([a-z]{2,})")
_DECODE = [("(?i)&#64;|&commat;|%40", "@"), (r"(?i)\s*\[at\]\s*|\s*\(at\)\s*|\s+at\s+", "@"), (r"(?i)\s*\[dot\]\s*|\s*\(dot\)\s*|\s+dot\s+", "."), ("(?i)&#46;|&period;|%2e", "."), ("(?i)&amp;", "&")]
_TITLE = _q("(?is)<title[^>]*>(.*?)</title>")
_LINK, _TARGET = _q(r"(?i)<a\s[^>]*>"), _q(r"""(?i)\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_COMPANY_PATH = _q(r"(?i)^/(about|team|people|leadership|company|founder|chi-siamo|azienda|impressum|governance|directors|partners|management|contatti|contact|who-we-are)([^0-9A-Za-z_]|$)")
_SITEMAP_PATH, _SITEMAP_WORDS = _q("(/|.html?)$"), _q("(?i)about|team|leadership|people|founder|chi-siamo|azienda|impressum|governance|directors|partners|management")
_MAIL_LINK = _q(r"""(?i)<a\s[^>]*href=["']?mailto:([^"'?\s>]*)""")
#: Public suffixes of the tables' hosts, and of the domains of addresses in documents.
SUFFIXES = ["com", "net", "org", "it", "de", "fr", "es", "io", "eu", "uk", "co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br"]
_HOST = lambda c: f"regexp_replace(lower(regexp_extract(trim({c}), '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\\.', '')"
_PATH = lambda c: f"CASE WHEN regexp_extract({c}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract({c}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) END"
_ORIGIN = lambda c: f"regexp_extract({c}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"
_HINT = lambda c: " + ".join(f"CAST(contains(lower({c}), {_q(h)}) AS INT)" for h in HINTS)
_FOLD = lambda c: f"regexp_replace(strip_accents(lower({c})), '[^a-z]', '', 'g')"
_CSV = lambda c: f"'\"' || replace(trim(regexp_replace(coalesce({c}, ''), '[\\r\\n]+', ' ', 'g')), '\"', '\"\"') || '\"'"
_EMAILS = lambda c: f"list_distinct(regexp_extract_all(lower({c}), {_DIRECT}, 0))"
_SCOPE = lambda h, s: f"({h} = {s} OR ends_with({h}, '.' || {s}))"
_MAIL = lambda c: f"lower(split_part({c}, '@', 2))"
_LOCAL = lambda c: f"lower(split_part({c}, '@', 1))"


def _registrable(source: str, name: str) -> str:
    """CTEs for site and root of the host column of a CTE."""
    return f"""{name}_suffix(suffix) AS (VALUES {_values(SUFFIXES)}),
{name}_fit AS (SELECT host, suffix, row_number() OVER (PARTITION BY host ORDER BY length(suffix) DESC) AS k FROM (SELECT DISTINCT host FROM {source}) JOIN {name}_suffix ON ends_with(host, '.' || suffix)),
{name}_label AS (SELECT host, suffix, regexp_extract(left(host, length(host) - length(suffix) - 1), '([^.]+)$', 1) AS label FROM {name}_fit WHERE k = 1),
{name} AS (SELECT s.*, coalesce(l.label || '.' || l.suffix, s.host) AS site, coalesce(l.label, split_part(s.host, '.', 1)) AS root FROM {source} s LEFT JOIN {name}_label l ON s.host = l.host)"""


_UNESCAPE = lambda c: f"replace(replace(replace(replace(replace(replace({c}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')"
_P = f"WITH h AS (SELECT page_id, url, html, {_HOST('url')} AS host FROM pages),\n{_registrable('h', 'p')}"
_CLEAN = lambda c: f"regexp_replace({c}, '(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g')"
_LINKS = f"""{_P},
tag AS (SELECT page_id, site, url AS base, list_filter(regexp_extract_all({_CLEAN('html')}, {_LINK}), lambda x: regexp_matches(x, {_TARGET})) AS tags FROM p),
raw AS (SELECT page_id, site, base, {_UNESCAPE(f"regexp_extract(tag, {_TARGET}, 1) || regexp_extract(tag, {_TARGET}, 2) || regexp_extract(tag, {_TARGET}, 3)")} AS href, pos FROM (
SELECT page_id, site, base, unnest(tags) AS tag, generate_subscripts(tags, 1) - 1 AS pos FROM tag)),
cut AS (SELECT page_id, site, base, pos, href, regexp_replace(trim(href), '#.*$', '') AS r FROM raw WHERE trim(href) <> '' AND NOT starts_with(trim(href), '#')),
links AS (SELECT page_id, site, base, pos, CASE WHEN regexp_matches(r, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN r WHEN starts_with(r, '/') THEN {_ORIGIN('base')} || r ELSE regexp_replace(regexp_replace(base, '[?#].*$', ''), '[^/]*$', '') || r END AS url FROM cut)"""
_DOC_EMAILS = f"SELECT doc_id, unnest({_EMAILS('text')}) AS email FROM documents"
_MAIL_SITES = f"mails AS (SELECT DISTINCT {_MAIL('email')} AS site, email FROM ({_DOC_EMAILS}))"
_POINTS = [
    ("f.l", "CAST(contains(l, '.') AS INT)"), ("fl", "CAST(regexp_matches(l, '^[a-z]+$') AS INT) + CAST(regexp_matches(l, '^[a-z]{4,}$') AS INT)"), ("f_l", "CAST(contains(l, '_') AS INT)"),
    ("f-l", "CAST(contains(l, '-') AS INT)"), ("f0l", "CAST(regexp_matches(l, '^[a-z][a-z0-9]+$') AS INT)"), ("l", "CAST(regexp_matches(l, '^[a-z]+$') AS INT)"), ("f", "CAST(regexp_matches(l, '^[a-z]+$') AS INT)"),
]
_PATTERNS = lambda source: f"""SELECT site, pattern, score, n FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY score DESC, k) AS place FROM (
SELECT site, k, pattern, sum(points) AS score, count(*) AS n FROM (
{" UNION ALL ".join(f"SELECT site, {k} AS k, {_q(p)} AS pattern, {sql} AS points FROM (SELECT site, {_LOCAL('email')} AS l FROM {source})" for k, (p, sql) in enumerate(_POINTS))}
) GROUP BY site, k, pattern)) WHERE place = 1"""  # noqa: E731
_RANK = f"""CASE WHEN regexp_matches({_LOCAL('email')}, '^(owner|founder|ceo|titolare|amministratore|admin(istratore)?unico)$') THEN 6
WHEN regexp_matches({_LOCAL('email')}, '^[a-z]+\\.[a-z]+$') THEN 5 WHEN regexp_matches({_LOCAL('email')}, '^[a-z][a-z0-9]*[.-][a-z]+$') THEN 4
WHEN regexp_matches({_LOCAL('email')}, 'director|managing|partner|principal') THEN 3
WHEN regexp_matches({_LOCAL('email')}, '^(hello|info|contact|team|enquiries|support|office)$') THEN 2 ELSE 1 END"""
_BEST = lambda source: f"SELECT site, email, rank FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY rank DESC, email) AS k FROM (SELECT DISTINCT site, email, {_RANK} AS rank FROM {source})) WHERE k = 1"
_PAIRS = """pairs AS (SELECT source, doc_id, unnest(found) AS pair, generate_subscripts(found, 1) - 1 AS hit_ord FROM (SELECT source, doc_id, regexp_extract_all(text, '([A-Z][a-z]+) ([A-Z][a-z]+)', 0) AS found FROM documents)),
named AS (SELECT source, doc_id, hit_ord, split_part(pair, ' ', 1) AS first, split_part(pair, ' ', 2) AS last FROM pairs)"""
_HUMAN = f"""(first <> upper(first) AND last <> upper(last) AND regexp_matches({_FOLD('first')}, '[aeiou]') AND regexp_matches({_FOLD('last')}, '[aeiou]') AND length({_FOLD('last')}) >= 3
AND NOT regexp_matches({_FOLD('last')}, '(s|ing)$') AND {_FOLD('first')} NOT IN ({_list(STOPWORDS)}) AND {_FOLD('last')} NOT IN ({_list(STOPWORDS)}) AND {_FOLD('first')} || ' ' || {_FOLD('last')} NOT IN ({_list(BLOCKED_PHRASES)}))"""
_SCORES = f"""{_PAIRS},
scores AS (SELECT source AS site, {_FOLD('first')} || ' ' || {_FOLD('last')} AS name_key, sum(5) AS weight, 'Director' AS title, arg_min(first, doc_id * 1000000 + hit_ord) AS first, arg_min(last, doc_id * 1000000 + hit_ord) AS last FROM named WHERE {_HUMAN} GROUP BY 1, 2),
owners AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY weight DESC, last, first) AS k FROM scores WHERE weight >= 4) WHERE k = 1)"""
_COMPANY = f"""named AS (SELECT site, page_id, trim(regexp_extract({_UNESCAPE(f"trim(regexp_replace(regexp_extract(html, {_TITLE}, 1), '\\s+', ' ', 'g'))")}, '^([^|—-]*)', 1)) AS company FROM p WHERE html IS NOT NULL),
page_named AS (SELECT * FROM named WHERE company <> ''),
company AS (SELECT s.site, s.root, coalesce(c.company, upper(left(s.root, 1)) || substr(s.root, 2)) AS company FROM (SELECT DISTINCT site, root FROM p) s LEFT JOIN (SELECT site, arg_min(company, page_id) AS company FROM page_named GROUP BY site) c ON s.site = c.site)"""
_PAGE_EMAILS = f"found AS (SELECT DISTINCT site, unnest({_EMAILS('html')}) AS email FROM p)"
_DECODED = "text"
for _pattern, _plain in _DECODE:
    _DECODED = f"regexp_replace({_DECODED}, {_q(_pattern)}, '{_plain}', 'g')"
_BODY_OF = lambda c: f"list_distinct(regexp_extract_all({_DECODED.replace('(text,', f'({c},', 1)}, {_BODY}, 0))"
_MX = f"mx_hosts AS (SELECT DISTINCT {_MAIL('email')} AS host FROM ({_DOC_EMAILS})),\n{_registrable('mx_hosts', 'mx')}"
_SEEDS = lambda paths: f"SELECT site, 'https://' || site || paths[i + 1] AS url, i AS ord FROM (SELECT DISTINCT site FROM p), (SELECT [{_list(paths)}] AS paths), range(0, {len(paths)}) t(i)"
_RULES = [("/fr/%", 4, 0), ("/fr/8%", 5, 1), ("/%?page=%", 8, 0)]

_NAME = r"([A-Z][\p{L}'’-]+)"
_PAIR = rf"\b{_NAME}\s{_NAME}\b"
_ROLES = "Owner|Owner Manager|Founder|Co-Founder|CEO|President|Managing Director|Director|Partner|Principal|Proprietor|Titolare|Fondatore|Co-Fondatore|Amministratore Delegato|Direttore Generale|Proprietario|Amministratore Unico|Legale Rappresentante|Geschäftsführer|Inhaber|Président|Directeur Général|Dirigente|Managing Partner|Chairman|Chairwoman|Executive Director"
_ROLE_NAME = _q(rf"(?i)\b({_ROLES})\b[^.\n:]{{0,200}}?\b{_NAME}\s{_NAME}\b")
_SQUEEZE = lambda c: f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"
_BODY_TEXT = _SQUEEZE(_UNESCAPE("regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<head[^>]*>.*?</head>|<title[^>]*>.*?</title>', '', 'g'), '<[^>]*>', '', 'g')"))
_SEEN = _UNESCAPE(_UNESCAPE(f"regexp_replace({_CLEAN('html')}, '<[^>]*>', ' ', 'g')"))
_BOTH = f"SELECT page_id, x FROM (SELECT page_id, unnest([{_SEEN}, {_UNESCAPE('html')}]) AS x FROM pages WHERE html IS NOT NULL)"
_HEADINGS = f"""{_P}, heads AS (SELECT site, page_id, unnest(regexp_extract_all({_CLEAN('html')}, '(?is)<h[1-4][^>]*>(.*?)</h[1-4]>', 1)) AS raw, generate_subscripts(regexp_extract_all({_CLEAN('html')}, '(?is)<h[1-4][^>]*>(.*?)</h[1-4]>', 1), 1) - 1 AS pos FROM p),
blocks AS (SELECT site, page_id, pos, {_SQUEEZE(_UNESCAPE("regexp_replace(raw, '<[^>]*>', '', 'g')"))} AS block FROM heads),
cut AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS hit FROM (SELECT *, regexp_extract(block, {_q(_PAIR)}, 1) AS first, regexp_extract(block, {_q(_PAIR)}, 2) AS last FROM blocks) WHERE first <> ''),
people AS (SELECT * FROM cut WHERE regexp_matches(first, '^[A-Z][a-zÀ-ÖØ-öø-ÿ''’-]+$') AND regexp_matches(last, '^[A-Z][a-zÀ-ÖØ-öø-ÿ''’-]+$') AND {_HUMAN})"""

SQL: dict[str, str] = {
    "title_people": f"""{_P} SELECT site, page_id, hit_ord, regexp_extract(m, {_ROLE_NAME}, 1) AS title, regexp_extract(m, {_ROLE_NAME}, 2) AS first, regexp_extract(m, {_ROLE_NAME}, 3) AS last, 4 AS weight FROM (
SELECT site, page_id, unnest(found) AS m, generate_subscripts(found, 1) - 1 AS hit_ord FROM (SELECT site, page_id, regexp_extract_all({_BODY_TEXT}, {_ROLE_NAME}, 0) AS found FROM p))""",
    "heading_people": f"{_HEADINGS} SELECT site, page_id, pos AS hit_ord, left(block, 160) AS title, first, last, 2 AS weight FROM people",
    "dom_people": f"{_HEADINGS} SELECT site, page_id, 3 AS channel_ord, hit AS hit_ord, left(block, 160) AS title, first, last, 2 AS weight FROM people",
    "card_links": f"{_LINKS} SELECT site, page_id, url, rank FROM (SELECT site, page_id, url, row_number() OVER (PARTITION BY site ORDER BY page_id, pos) AS rank FROM links WHERE (ends_with(url, '.vcf') OR contains(url, 'vcard')) AND {_SCOPE(_HOST('url'), 'site')}) WHERE rank <= 3",
    "all_addresses": f"""SELECT DISTINCT page_id, email FROM (SELECT page_id, unnest({_EMAILS('x')}) AS email FROM ({_BOTH}) UNION ALL
SELECT page_id, lower(a || '@' || b || '.' || c) FROM (SELECT page_id, unnest(regexp_extract_all(x, {_WRITTEN}, 1)) AS a, unnest(regexp_extract_all(x, {_WRITTEN}, 2)) AS b, unnest(regexp_extract_all(x, {_WRITTEN}, 3)) AS c FROM ({_BOTH})))""",
    "site_emails": f"{_P}, {_PAGE_EMAILS} SELECT s.site AS domain, coalesce(f.email, '') AS email FROM (SELECT DISTINCT site FROM p) s LEFT JOIN found f ON s.site = f.site",
    "page_emails": f"SELECT page_id, unnest({_EMAILS('html')}) AS email FROM pages",
    "document_emails": _DOC_EMAILS,
    "conversation_emails": f"SELECT conv_id, turn, unnest({_EMAILS('text')}) AS email FROM conversations",
    "obfuscated_emails": f"""SELECT DISTINCT doc_id, lower(a || '@' || b || '.' || c) AS email FROM (
SELECT doc_id, unnest(regexp_extract_all(text, {_WRITTEN}, 1)) AS a, unnest(regexp_extract_all(text, {_WRITTEN}, 2)) AS b, unnest(regexp_extract_all(text, {_WRITTEN}, 3)) AS c FROM documents)""",
    "decoded_emails": f"SELECT doc_id, unnest({_BODY_OF('text')}) AS email FROM documents",
    "email_scope": f"{_P} SELECT page_id, email, {_SCOPE(_MAIL('email'), 'site')} AS in_scope FROM (SELECT page_id, site, unnest({_BODY_OF('html')}) AS email FROM p)",
    "hosts": f"SELECT page_id, {_HOST('url')} AS host, regexp_replace(lower(regexp_extract(trim(url), '^(?:[^:/]+://)?([^/?#]+)', 1)), '^www\\.', '') AS net_location FROM pages",
    "registrable_domains": f"{_P} SELECT DISTINCT host, site, root FROM p",
    "domain_lines": f"""SELECT page_id, CASE WHEN regexp_matches(h, '^[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}$') THEN h END AS domain, CASE WHEN contains(b, '.') THEN b END AS shell_domain FROM (
SELECT page_id, {_HOST("trim(regexp_replace(line, '#.*$', ''))")} AS h, lower(regexp_replace(regexp_replace(regexp_extract(regexp_replace(line, '#.*$', ''), '^[ \\t]*([^ \\t]*)', 1), '(?i)^https?://', ''), '(?i)^www\\.', '')) AS b
FROM (SELECT page_id, url || ' # note' AS line FROM pages))""",
    "page_links": f"{_LINKS} SELECT page_id, pos, url FROM links",
    "scored_links": f"{_LINKS} SELECT DISTINCT site, url, {_HINT('url')} AS score FROM links",
    "inner_links": f"{_LINKS} SELECT DISTINCT site, {_ORIGIN('url')} || ({_PATH('url')}) AS url FROM links WHERE {_SCOPE(_HOST('url'), 'site')} AND regexp_matches({_PATH('url')}, {_COMPANY_PATH})",
    "seed_frontier": f"{_P} {_SEEDS(PATHS)}",
    "short_seed_frontier": f"{_P} {_SEEDS(SHORT_PATHS)}",
    "frontier_budget": f"""{_P}, u AS (SELECT site, url, 0 AS r, ord FROM ({_SEEDS(PATHS)}) UNION ALL SELECT site, url, 1, min(page_id) FROM p GROUP BY site, url),
one AS (SELECT site, url, min(r * 10000000000 + ord) AS o FROM u GROUP BY site, url)
SELECT site, url, CAST(o // 10000000000 AS INT) AS src_rank, place FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY o, url) AS place FROM one) WHERE place <= 40""",
    "bfs_depth2": f"""{_LINKS}, edges AS (SELECT DISTINCT l.site, l.base AS src, l.url FROM links l),
zero AS (SELECT * FROM (SELECT site, url, row_number() OVER (PARTITION BY site ORDER BY min(page_id), url) AS place FROM p GROUP BY site, url) WHERE place <= 3),
one AS (SELECT site, url, 3 + row_number() OVER (PARTITION BY site ORDER BY o, {_HINT('url')} DESC, url) AS place FROM (
SELECT e.site, e.url, min(z.place) AS o FROM zero z JOIN edges e ON z.site = e.site AND z.url = e.src WHERE (e.site, e.url) NOT IN (SELECT (site, url) FROM zero) GROUP BY 1, 2)),
one_in AS (SELECT * FROM one WHERE place <= {Config().bfs_pages}),
two AS (SELECT x.site, url, (SELECT max(place) FROM (SELECT * FROM zero UNION ALL SELECT * FROM one_in) s WHERE s.site = x.site) + row_number() OVER (PARTITION BY x.site ORDER BY o, {_HINT('url')} DESC, url) AS place FROM (
SELECT e.site, e.url, min(z.place) AS o FROM one_in z JOIN edges e ON z.site = e.site AND z.url = e.src WHERE (e.site, e.url) NOT IN (SELECT (site, url) FROM zero) AND (e.site, e.url) NOT IN (SELECT (site, url) FROM one_in) GROUP BY 1, 2) x)
SELECT * FROM (SELECT site, url, 0 AS depth, place FROM zero UNION ALL SELECT site, url, 1, place FROM one_in UNION ALL SELECT site, url, 2, place FROM two) WHERE place <= {Config().bfs_pages}""",
    "sitemap_topk": f"""{_P} SELECT site, url, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY score DESC, url) AS rank FROM (
SELECT DISTINCT site, url, CAST(regexp_matches(url, {_SITEMAP_WORDS}) AS INT) AS score FROM p WHERE regexp_matches({_PATH('url')}, {_SITEMAP_PATH}))) WHERE rank <= {Config().sitemap_budget()}""",
    "hinted_sitemap_topk": f"{_P} SELECT site, url, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY score DESC, url) AS rank FROM (SELECT DISTINCT site, url, {_HINT('url')} AS score FROM p)) WHERE rank <= {Config().bfs_pages}",
    "dedupe_domains": f"SELECT arg_min(domain, page_id) AS domain, min(page_id) AS line_no FROM (SELECT page_id, CASE WHEN starts_with(url, 'https') THEN upper({_HOST('url')}) ELSE {_HOST('url')} END AS domain FROM pages) GROUP BY lower(domain)",
    "pending_domains": f"{_P}, {_PAGE_EMAILS} SELECT DISTINCT site AS domain FROM p WHERE site NOT IN (SELECT site FROM found)",
    "queue_total": f"{_P}, {_PAGE_EMAILS} SELECT count(DISTINCT site) AS n FROM p WHERE site NOT IN (SELECT site FROM found)",
    "page_company": f"{_P}, {_COMPANY} SELECT site, page_id, company FROM page_named",
    "site_company": f"{_P}, {_COMPANY} SELECT site, root, company FROM company",
    "quoted_titles": f"{_P}, {_COMPANY} SELECT page_id, {_CSV('company')} AS field FROM page_named",
    "human_names": f"WITH {_PAIRS} SELECT doc_id, hit_ord, first, last, {_HUMAN} AS human FROM named",
    "person_scores": f"WITH {_SCORES} SELECT site, name_key, weight, title, first, last FROM scores",
    "owner_pick": f"WITH {_SCORES} SELECT site, name_key, weight, title, first, last FROM owners",
    "pattern_scores": f"WITH {_MAIL_SITES} {_PATTERNS('mails')}",
    "ranked_emails": f"WITH {_MAIL_SITES} {_BEST('mails')}",
    "company_like": f"""WITH {_SCORES} SELECT site, first || ' ' || last AS person, true AS own_name,
(lower(first) IN ({_list(STOPWORDS)}) OR lower(last) IN ({_list(STOPWORDS)}) OR contains(lower(first || ' ' || last), 'zzyzx')) AS other_name FROM owners""",
    "mx_gate": f"{_P}, {_MX} SELECT DISTINCT site, site IN (SELECT site FROM mx) AS has_mx FROM p",
    "resolved_sites": f"""{_P}, {_COMPANY}, {_MX},
found AS (SELECT DISTINCT site, email FROM (SELECT site, trim(unnest(list_concat(regexp_extract_all(html, {_MAIL_LINK}, 1), {_BODY_OF('html')}))) AS email FROM p) WHERE email <> '' AND {_SCOPE(_MAIL('email'), 'site')}),
best AS ({_BEST('found')})
SELECT c.site, c.company, '' AS owner, CASE WHEN c.site IN (SELECT site FROM mx) THEN coalesce(b.email, '') ELSE '' END AS email,
CASE WHEN c.site IN (SELECT site FROM mx) AND b.email IS NOT NULL THEN 'observed' ELSE 'none' END AS email_origin FROM company c LEFT JOIN best b ON c.site = b.site""",
    "robots_gate": f"""WITH t AS (SELECT page_id, regexp_extract(url, '^[^/]*//[^/?#]*([^#]*)', 1) AS path FROM pages)
SELECT page_id, coalesce((SELECT arg_max(allow, n * 2 + allow) FROM (VALUES {", ".join(map(str, _RULES))}) r(pattern, n, allow) WHERE path LIKE pattern), 1) = 1 AS allowed FROM t""",
    "robots_by_origin": f"""WITH t AS (SELECT page_id, {_ORIGIN('url')} AS origin, {_PATH('url')} AS path, regexp_extract(url, '^[^/]*//[^/?#]*([^#]*)', 1) AS target FROM pages),
r AS (SELECT DISTINCT origin, page_id % 3 AS kind, CASE page_id % 3 WHEN 0 THEN regexp_extract(path, '^(/[^/]*)', 1) WHEN 1 THEN path ELSE right(path, 2) END AS part FROM t),
hits AS (SELECT t.page_id, max(CASE kind WHEN 2 THEN 5 ELSE length(part) END * 2 + CAST(kind = 1 AS INT)) AS best FROM t JOIN r ON t.origin = r.origin
AND CASE kind WHEN 2 THEN ends_with(target, part) AND length(target) >= 1 + length(part) ELSE starts_with(target, part) END GROUP BY t.page_id)
SELECT t.page_id, coalesce(best % 2 = 1, true) AS allowed FROM t LEFT JOIN hits ON hits.page_id = t.page_id""",
    "charset_bodies": """WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^\x01-\x7f]', '', 'g') AS x FROM documents),
d AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Windows-1252' WHEN 1 THEN 'ISO-8859-2' WHEN 2 THEN 'windows-1251' ELSE 'utf-16be' END AS charset,
CASE doc_id % 4 WHEN 1 THEN translate(x, 'acelnosz', 'ąćęłńóśż') WHEN 2 THEN translate(x, 'abvgdeziklmnoprstu', 'абвгдезиклмнопрсту') ELSE translate(x, 'aeiou', 'àéîõü') END AS y FROM t)
SELECT doc_id, charset, length(y) AS n_chars, sha256(y) AS sha256 FROM d""",
    "pacing_schedule": f"SELECT host, url, row_number() OVER (PARTITION BY host ORDER BY url) AS seq, (row_number() OVER (PARTITION BY host ORDER BY url) - 1) * {Config().rate_ms} AS earliest_ms FROM (SELECT DISTINCT {_HOST('url')} AS host, url FROM pages)",
    "backoff_waits": "SELECT page_id, unnest([600, 1200, 2400]) AS wait_ms FROM pages",
    "evidence_hashes": f"""{_P}, {_PAGE_EMAILS}, best AS ({_BEST('found')}), pats AS ({_PATTERNS('found')})
SELECT p.site AS domain, array_to_string(list_sort(list_distinct(list(sha256(p.url)))), ',') AS pages,
coalesce((SELECT array_to_string(list_sort(list_distinct(list(sha256(f.email)))), ',') FROM found f WHERE f.site = p.site), '') AS emails_found,
coalesce((SELECT max(pattern) FROM pats WHERE pats.site = p.site), '') AS pattern_hint, coalesce((SELECT max(sha256(email)) FROM best WHERE best.site = p.site), '') AS result FROM p GROUP BY p.site""",
    "csv_rows": f"""{_P}, {_COMPANY} SELECT site, {_CSV('company')} || ',' || {_CSV("'He said \"hi\"' || chr(10) || 'there'")} || ',""' AS row FROM company""",
    "content_gate": """SELECT page_id, status BETWEEN 200 AND 299 AND coalesce(regexp_matches(kind, 'text/html|application/xhtml\\+xml'), false) AS page,
status < 400 AND (kind IS NULL OR contains(kind, 'text') OR contains(kind, 'html')) AS text_page, coalesce(lower(regexp_extract(kind, 'charset=([^;]+)', 1)), '') AS charset FROM (
SELECT page_id, page_id % 5 * 100 + 100 AS status, CASE page_id % 4 WHEN 0 THEN 'text/html; charset=UTF-8' WHEN 1 THEN 'application/xhtml+xml' WHEN 2 THEN 'application/pdf' END AS kind FROM pages)""",
    "cache_merge": """SELECT url, sha256(url) AS url_sha, CAST(CASE WHEN k % 2 = 0 THEN 304 ELSE 200 END AS INT) AS status, CASE WHEN k % 2 = 0 THEN 'cached ' || n ELSE 'fresh' END AS body, CASE WHEN k % 2 = 0 THEN 'tag' END AS etag
FROM (SELECT url, min(page_id) AS k, min(length(html)) AS n FROM pages GROUP BY url)""",
    "format_by_path": "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'tsv' WHEN 1 THEN 'jsonl' ELSE 'csv' END AS kind FROM pages",
    "first_fetches": f"{_P} SELECT site, page_id, url, k FROM (SELECT site, page_id, url, row_number() OVER (PARTITION BY site ORDER BY page_id) AS k FROM p) WHERE k <= 5",
}
