"""DuckDB SQL for what the queries over the crawl made from the given pages give, from the pages' numbers and hosts alone."""

from __future__ import annotations


def _values(rows: list[tuple], columns: str) -> str:
    literal = lambda x: "NULL" if x is None else str(x) if isinstance(x, (bool, int)) else "'" + x.replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) t({columns})"


_PAGES = """WITH n AS (SELECT page_id, page_id // 8 AS g, page_id % 8 AS slot, regexp_extract(url, '//(?:www[.]|m[.])?([a-z]+)', 1) AS label FROM pages),
p AS (SELECT *, 'firm' || g AS root, 'firm' || g || CASE g % 3 WHEN 0 THEN '.it' WHEN 1 THEN '.co.uk' ELSE '.ch' END AS site,
['Anna', 'Marco', 'Paola', 'Ugo', 'Dora', 'Luisa'][g % 6 + 1] AS first, ['Rossi', 'Bianchi', 'Verdi', 'Neri', 'Lanza', 'Moreau', 'Foscolo'][g % 7 + 1] AS last,
['/', '/chi-siamo', '/contatti', '/team/', '/privato', '/deep', '/deeper', '/about'][slot + 1] AS path FROM n),
d AS (SELECT *, lower(first || '.' || last) AS mailbox, 'https://' || site AS base, CASE WHEN g % 9 = 0 THEN 'Studio ' || last ELSE 'Casa ' || upper(label[1]) || label[2:] END AS named FROM p),
f AS (SELECT DISTINCT g, root, site, base, first, last, mailbox FROM d)"""

#: Addresses by the page that holds them; channel 1 is a mail link's, 2 any. every: those that the search for written-out
#: addresses finds, which takes one dot.
_MAILS = """mails AS (SELECT site, page_id, slot, g, 'info@' || site AS email FROM d WHERE slot = 0
UNION ALL SELECT site, page_id, slot, g, unnest(['vendite', mailbox, 'a.neri', 'ordini']) || '@' || site FROM d WHERE slot = 2
UNION ALL SELECT site, page_id, slot, g, CASE slot WHEN 3 THEN 'capo' WHEN 4 THEN 'never' WHEN 5 THEN 'deep' || g ELSE 'deeper' || g END || '@' || site FROM d WHERE slot BETWEEN 3 AND 6),
every AS (SELECT site, page_id, slot, g, CASE WHEN slot IN (2, 3) AND regexp_matches(email, '^(vendite|capo)@') THEN replace(email, '.co.uk', '.co') ELSE email END AS email FROM mails UNION ALL SELECT site, page_id, slot, g, 'press@stampa.it' FROM d WHERE slot = 2)"""

#: A page can be chosen when it is one of the well-known paths and no rule is against it.
_CHOSEN = "chosen AS (SELECT * FROM d WHERE slot IN (0, 1, 2, 7) OR slot = 3 AND g % 4 <> 1)"
_COMPANY = """home AS (SELECT g, site, root, max(CASE WHEN g % 7 = 0 THEN NULL WHEN g % 5 = 0 THEN named || ' & Figli' ELSE named END) FILTER (slot = 0) AS stated, count(*) FILTER (slot = 1) AS n1 FROM d GROUP BY g, site, root),
company AS (SELECT site, root, coalesce(stated, 'Firm' || g) AS company FROM home)"""
_FOUND = f"""{_MAILS}, {_CHOSEN}, cards AS (SELECT site, g, 'card' || g || '@' || site AS email FROM d WHERE slot = 0),
found AS (SELECT DISTINCT m.site, m.email FROM mails m JOIN chosen c ON c.page_id = m.page_id UNION SELECT site, email FROM cards)"""
#: The owner is the site's one person, who does not count where the company has the same name; the address is made where mail is taken.
_RECORDS = f"""{_COMPANY}, {_FOUND},
whole AS (SELECT site, count(*) AS n FROM d GROUP BY site),
owned AS (SELECT f.site, c.company, CASE WHEN contains(c.company, f.last) OR NOT EXISTS (SELECT 1 FROM d WHERE d.g = f.g AND d.slot = CASE WHEN f.g % 4 = 0 THEN 0 ELSE 1 END) THEN '' ELSE f.first || ' ' || f.last END AS owner, f.g, lower(f.first || f.last) || '@' || f.site AS made FROM f JOIN company c ON c.site = f.site),
best AS (SELECT site, min(email) FILTER (regexp_matches(email, '^[a-z]+[.][a-z]+@')) AS personal, min(email) FILTER (NOT regexp_matches(email, '^[a-z]+[.][a-z]+@') AND starts_with(email, 'info@')) AS general, min(email) AS any FROM found GROUP BY site),
records AS (SELECT o.site, o.company, o.owner, CASE WHEN o.g % 5 = 4 OR b.any IS NULL THEN '' WHEN o.owner <> '' THEN o.made ELSE coalesce(b.personal, b.general, b.any) END AS email,
CASE WHEN o.g % 5 = 4 OR b.any IS NULL THEN 'none' WHEN o.owner <> '' THEN 'synthesized' ELSE 'observed' END AS email_origin FROM owned o LEFT JOIN best b ON b.site = o.site)"""
_CSV = lambda *cs: " || ',' || ".join(f"'\"' || replace({c}, '\"', '\"\"') || '\"'" for c in cs)

_TITLE = "SELECT site, page_id, 0 AS hit_ord, 'Titolare' AS title, first, last, 4 AS weight FROM d WHERE slot = 0 AND g % 4 = 0"
_HEADING = "SELECT site, page_id, 0 AS hit_ord, first || ' ' || last || ', CEO' AS title, first, last, 2 AS weight FROM d WHERE slot = 1 AND g % 4 = 2"
_LINKED = """SELECT site, page_id, 1 AS channel_ord, 0 AS hit_ord, 'Fondatore' AS title, first, last, 3 AS weight FROM d WHERE slot = 1 AND g % 4 = 3
UNION ALL SELECT site, page_id, 1, 1, 'Person', 'Carla', 'Fontana', 1 FROM d WHERE slot = 1 AND g % 4 = 3"""
_DOM = f"""{_LINKED} UNION ALL SELECT site, page_id, 2, 0, 'Founder', first, last, 3 FROM d WHERE slot = 1 AND g % 4 = 1
UNION ALL SELECT site, page_id, 3, unnest([0, 1]), first || ' ' || last || ', CEO', first, last, 2 FROM d WHERE slot = 1 AND g % 4 = 2"""
#: What paths a site's rules are against, for the three agents.
_AGENTS = """SELECT agent, base || path AS url, CASE WHEN g % 2 = 0 AND agent = 'nobody' THEN false WHEN g % 2 = 0 THEN path <> '/privato' WHEN g % 4 = 1 THEN NOT starts_with(path, '/team') ELSE true END AS allowed
FROM d, (VALUES ('sitewright'), ('nobody'), ('Other/1.0')) a(agent)"""
_SITES = "d.base || '/chi-siamo'"
_HOSTS = [
    ("shop.{}.ch", "{}.ch", "{}"), ("a.b.{}.pl", "{}.pl", "{}"), ("x.{}.co.nz", "{}.co.nz", "{}"), ("www.{}.co.uk", "{}.co.uk", "{}"), ("{}.sch.uk", "{}.sch.uk", "{}"), ("a.{}.sch.uk", "a.{}.sch.uk", "a"),
    ("city.kobe.jp", "city.kobe.jp", "city"), ("a.city.kobe.jp", "city.kobe.jp", "city"), ("b.{}.kobe.jp", "b.{}.kobe.jp", "b"), ("www.ck", "www.ck", "www"), ("a.{}.ck", "a.{}.ck", "a"), ("{}.com", "{}.com", "{}"),
    ("co.uk", "co.uk", "co"), ("{}", "{}", "{}"), ("a.{}.unknowntop", "{}.unknowntop", "{}"), ("deep.{}.com.br", "{}.com.br", "{}"),
]
_PLAIN = [(0, "caffè €A {}"), (1, "{}&lt;"), (2, "¬it; &unknown; ©2 {}"), (3, "–�\U0001f600{}"), (4, "{} a & b")]
_LISTED = [("listed", x) for x in ("{}", "b{}", "b{}", "c{}", "d{}")] + [("processed", x) for x in ("{}/x", "b{}", "c{}", "user@d{}:8080/y")] + [("first", x) for x in ("{}", "b{}", "c{}", "d{}")]
_RESULT = {
    "csv": ('"\' || site || \'","Casa ""&"" Figli","","info@\' || site || \'"', '"\' || site || \'","Vuoto, sì","",""'),
    "tsv": ("\"' || site || '\"\t\"Casa \"\"&\"\" Figli\"\t\"\"\t\"info@' || site || '\"", "\"' || site || '\"\t\"Vuoto, sì\"\t\"\"\t\"\""),
    "jsonl": ('{"domain":"\' || site || \'","company":" Casa \\"&\\"\\r\\nFigli ","owner":"","email":"info@\' || site || \'"}', '{"domain":"\' || site || \'","company":"Vuoto, sì","owner":"","email":""}'),
}
_WRITTEN = " UNION ALL ".join(f"SELECT '{kind}' AS kind, CASE WHEN g % 2 = 0 THEN '{even}' ELSE '{odd}' END AS line FROM f WHERE g % 4 < 3 UNION ALL SELECT '{kind} to do', site FROM f WHERE g % 4 = 3" for kind, (even, odd) in _RESULT.items())
_WALK = [("r1", 0, 1), ("r2", 0, 2), ("a", 1, 3), ("b", 1, 4), ("contact", 1, 5), ("z", 2, 6), ("about", 2, 7), ("y", 2, 8)]

SQL: dict[str, str] = {
    name: f"{_PAGES}{sql}"
    for name, sql in {
        "captured_title_people": f" {_TITLE}",
        "captured_heading_people": f" {_HEADING}",
        "captured_dom_people": f" {_DOM}",
        "captured_jsonld_people": f" {_LINKED}",
        "captured_card_links": " SELECT site, min(page_id) AS page_id, base || '/cards/' || g || '.vcf' AS url, 1 AS rank FROM d WHERE slot IN (0, 1) GROUP BY site, base, g",
        "captured_card_emails": " SELECT site, min(page_id) AS page_id, 0 AS channel, 0 AS hit_ord, 'card' || g || '@' || site AS email FROM d WHERE slot IN (0, 1) GROUP BY site, g",
        "captured_page_emails": f", {_MAILS} SELECT site, page_id, 2 AS channel, email FROM mails UNION ALL SELECT site, page_id, 1, email FROM mails WHERE slot = 0",
        "captured_mail_links": f", {_MAILS} SELECT site, page_id, 1 AS channel, email FROM mails WHERE slot = 0",
        "captured_addresses": f", {_MAILS} SELECT page_id, email FROM every",
        "captured_companies": f", {_COMPANY} SELECT site, root, company FROM company",
        "captured_links": """ SELECT page_id, pos, href FROM (SELECT page_id, unnest(list) AS href, generate_subscripts(list, 1) - 1 AS pos FROM (SELECT page_id, CASE slot WHEN 0 THEN ['/chi-siamo', '/contatti?x=1#y', 'mailto:info@' || site || '?subject=Ciao', '/cards/' || g || '.vcf', 'https://altro.it/about']
WHEN 1 THEN ['../cards/' || g || '.vcf'] WHEN 2 THEN ['mailto:a.neri@' || site || ',ordini@' || site, 'mailto:press@stampa.it', '/deep'] WHEN 5 THEN ['/deeper'] END AS list FROM d))""",
        "captured_inner_links": " SELECT site, base || unnest(['/chi-siamo', '/contatti']) AS url FROM d WHERE slot = 0",
        "captured_sitemap": f" SELECT \"by\", base || path AS url, score, rank FROM f, {_values([('words', '/team/', 1, 1), ('words', '/x.html', 0, 2), ('hints', '/team/', 1, 1), ('hints', '/x.html', 0, 2), ('hints', '/y.pdf', 0, 3)], '"by", path, score, rank')}",
        "captured_robots": f" {_AGENTS}",
        "captured_scores": f""" SELECT site, lower(first || ' ' || last) AS name_key, sum(weight + CASE WHEN title = 'Person' THEN 0 ELSE 3 END) AS weight, min(title) AS title, first, last FROM (
SELECT site, title, first, last, weight FROM ({_TITLE}) UNION ALL SELECT site, title, first, last, weight FROM ({_DOM})) GROUP BY site, first, last""",
        "captured_pages_chosen": f", {_CHOSEN} SELECT site, page_id FROM chosen",
        "owner_run": f", {_RECORDS} SELECT * FROM records",
        "owner_run_rows": f""", {_RECORDS} SELECT site, {_CSV("company", "owner", "email")} AS csv, '{{"company":"' || company || '","owner":"' || owner || '","email":"' || email || '"}}' AS json FROM records""",
        "owner_run_evidence": f""", {_RECORDS} SELECT r.site AS domain, (SELECT count(*) FROM chosen c WHERE c.site = r.site) AS pages, coalesce((SELECT string_agg(email, ' ' ORDER BY email) FROM found x WHERE x.site = r.site), '') AS emails, r.email AS result
FROM records r WHERE r.site IN (SELECT site FROM chosen)""",
        "committed_runs": f""", {_RECORDS} SELECT 'result' AS kind, site || ' ' || owner || ' ' || email AS line FROM records UNION ALL SELECT kind, site FROM f, (VALUES ('mark'), ('before the reset')) k(kind)
UNION ALL SELECT 'evidence', r.site || ' ' || (SELECT count(*) FROM found x WHERE x.site = r.site) FROM records r WHERE r.site IN (SELECT site FROM chosen)""",
        "crawl_run": f""", {_MAILS}, reached AS (SELECT e.site, e.email FROM every e WHERE e.slot IN (0, 2, 3) OR e.slot = 5 AND EXISTS (SELECT 1 FROM d WHERE d.g = e.g AND d.slot = 2) OR e.slot = 6 AND EXISTS (SELECT 1 FROM d WHERE d.g = e.g AND d.slot = 5))
SELECT f.site AS domain, coalesce(r.email, '') AS email FROM f LEFT JOIN (SELECT DISTINCT site, email FROM reached) r ON r.site = f.site UNION ALL SELECT 'no' || site, '' FROM f WHERE g % 4 = 0""",
        "crawl_order": f" SELECT site, u AS url, depth, place FROM f, {_values(_WALK, 'u, depth, place')}",
        "answered_pages": " SELECT page_id, base || path AS url, CASE slot WHEN 0 THEN 'caffè ' || g WHEN 1 THEN 'però tanto ' WHEN 2 THEN 'vecchia ' || g ELSE '€ ' || g END AS html FROM d WHERE slot IN (0, 1, 2, 7)",
        "cached_answers": " SELECT page_id, CASE slot WHEN 0 THEN 'caffè ' || g WHEN 1 THEN 'nuovo' ELSE '€ ' || g END AS html FROM d WHERE slot IN (0, 1, 7)",
        "answered_cards": " SELECT base || path AS url, 'EMAIL:' || mailbox || '@' || site AS body FROM d WHERE slot = 6",
        "suffix_rules": f" SELECT label, replace(h, '{{}}', label) AS host, replace(s, '{{}}', label) AS site, replace(r, '{{}}', label) AS root FROM (SELECT DISTINCT label FROM d), {_values(_HOSTS, 'h, s, r')}",
        "references": f" SELECT page_id, replace(x, '{{}}', label) AS plain FROM d JOIN {_values(_PLAIN, 'k, x')} ON page_id % 5 = k",
        "listed_domains": f" SELECT kind, replace(x, '{{}}', site) AS domain FROM f, {_values(_LISTED, 'kind, x')} UNION ALL SELECT 'named', site FROM f WHERE g < 3",
        "written_results": f" {_WRITTEN}",
        "planned_requests": """ SELECT CASE WHEN slot < 4 THEN 1 ELSE 2 END AS run, site AS host, 'https://www.' || site || path AS url, row_number() OVER w AS seq,
CASE WHEN slot < 4 THEN 0 ELSE 900 * (SELECT count(*) FROM d e WHERE e.g = d.g AND e.slot < 4) END + 900 * (row_number() OVER w - 1) AS earliest_ms, CASE WHEN slot < 4 THEN '{"X-A":"1"}' ELSE '{}' END AS headers
FROM d WINDOW w AS (PARTITION BY site, slot < 4 ORDER BY path)""",
        "streamed_addresses": f", {_MAILS} SELECT site, page_id, email FROM every",
        "streamed_new_addresses": f", {_MAILS} SELECT DISTINCT site, email FROM every",
    }.items()
}
