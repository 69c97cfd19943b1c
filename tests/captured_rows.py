"""The results of the queries over the captured crawl, written down by hand from what the operators are to do."""

from __future__ import annotations


def _sql(columns: str, rows: list[tuple]) -> str:
    """DuckDB SQL for the rows as they stand."""
    literal = lambda x: str(x) if isinstance(x, (bool, int)) else "'" + x.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) t({columns})"


_LEGNO, _LAW, _VUOTO = "rossilegno.it", "bianchi.co.uk", "vuoto.ch"
_PEOPLE = [(_LEGNO, 2, 1, 0, "Fondatore", "Dora", "Lanza", 3), (_LEGNO, 2, 1, 1, "Person", "Ugo", "Foscolo", 1)]
_ADDRESSES = [
    (_LEGNO, 1, "info@rossilegno.it"), (_LEGNO, 3, "vendite@rossilegno.it"), (_LEGNO, 3, "paola.verdi@rossilegno.it"), (_LEGNO, 3, "a.neri@rossilegno.it"), (_LEGNO, 3, "ordini@rossilegno.it"),
    (_LEGNO, 3, "press@stampa.it"), (_LAW, 4, "info@bianchi.co.uk"), (_LAW, 4, "ugo.bianchi@bianchi.co.uk"), (_LEGNO, 5, "capo@rossilegno.it"), (_LEGNO, 8, "never@rossilegno.it"),
]
_RESULTS = {
    "csv": ['"bianchi.co.uk","Bianchi ""&"" Sons","","ugo.bianchi@bianchi.co.uk"', '"vuoto.ch","Vuoto, sì","",""'],
    "tsv": ['"bianchi.co.uk"\t"Bianchi ""&"" Sons"\t""\t"ugo.bianchi@bianchi.co.uk"', '"vuoto.ch"\t"Vuoto, sì"\t""\t""'],
    "jsonl": ['{"domain":"bianchi.co.uk","company":" Bianchi \\"&\\"\\r\\nSons ","owner":"","email":"ugo.bianchi@bianchi.co.uk"}', '{"domain":"vuoto.ch","company":"Vuoto, sì","owner":"","email":""}'],
}
_HOME = "https://rossilegno.it"

SQL: dict[str, str] = {
    "captured_title_people": _sql("site, page_id, hit_ord, title, first, last, weight", [(_LEGNO, 1, 0, "Titolare", "André", "Moreau", 4), (_LAW, 4, 0, "Director", "Ugo", "Bianchi", 4)]),
    "captured_heading_people": _sql("site, page_id, hit_ord, title, first, last, weight", [(_LEGNO, 2, 0, "Marco Neri, CEO", "Marco", "Neri", 2)]),
    "captured_dom_people": _sql("site, page_id, channel_ord, hit_ord, title, first, last, weight", [
        *_PEOPLE, (_LEGNO, 2, 2, 0, "Founder", "Paola", "Verdi", 3), (_LEGNO, 2, 3, 0, "Marco Neri, CEO", "Marco", "Neri", 2), (_LEGNO, 2, 3, 1, "Marco Neri, CEO", "Marco", "Neri", 2),
    ]),
    "captured_jsonld_people": _sql("site, page_id, channel_ord, hit_ord, title, first, last, weight", _PEOPLE),
    "captured_card_links": _sql("site, page_id, url, rank", [(_LEGNO, 1, f"{_HOME}/cards/anna.vcf", 1)]),
    "captured_card_emails": _sql("site, page_id, channel, hit_ord, email", [(_LEGNO, 1, 0, 0, "anna@rossilegno.it")]),
    "captured_page_emails": _sql("site, page_id, channel, email", [
        (_LEGNO, 1, 1, "info@rossilegno.it"), (_LEGNO, 1, 2, "info@rossilegno.it"), (_LEGNO, 3, 2, "vendite@rossilegno.it"), (_LEGNO, 3, 2, "paola.verdi@rossilegno.it"), (_LEGNO, 3, 2, "a.neri@rossilegno.it"),
        (_LEGNO, 3, 2, "ordini@rossilegno.it"), (_LAW, 4, 2, "info@bianchi.co.uk"), (_LAW, 4, 2, "ugo.bianchi@bianchi.co.uk"), (_LEGNO, 5, 2, "capo@rossilegno.it"), (_LEGNO, 8, 2, "never@rossilegno.it"),
    ]),
    "captured_mail_links": _sql("site, page_id, channel, email", [(_LEGNO, 1, 1, "info@rossilegno.it")]),
    "captured_addresses": _sql("page_id, email", [r[1:] for r in _ADDRESSES]),
    "captured_companies": _sql("site, root, company", [(_LEGNO, "rossilegno", "Rossi Legno"), (_LAW, "bianchi", "Bianchi & Sons"), (_VUOTO, "vuoto", "Vuoto")]),
    "captured_links": _sql("page_id, pos, href", [
        (1, 0, "/chi-siamo"), (1, 1, "/contatti?x=1#y"), (1, 2, "mailto:info@rossilegno.it?subject=Ciao"), (1, 3, "/cards/anna.vcf"), (1, 4, "https://altro.it/about"), (2, 0, "../cards/anna.vcf"),
        (3, 0, "mailto:a.neri@rossilegno.it,ordini@rossilegno.it"), (3, 1, "mailto:press@stampa.it"),
    ]),
    "captured_inner_links": _sql("site, url", [(_LEGNO, f"{_HOME}/chi-siamo"), (_LEGNO, f"{_HOME}/contatti")]),
    "captured_sitemap": _sql('"by", url, score, rank', [
        ("words", f"{_HOME}/team/", 1, 1), ("words", f"{_HOME}/x.html", 0, 2), ("hints", f"{_HOME}/team/", 1, 1), ("hints", f"{_HOME}/x.html", 0, 2), ("hints", f"{_HOME}/y.pdf", 0, 3),
    ]),
    "captured_robots": _sql("agent, url, allowed", [
        ("sitewright", f"{_HOME}/", True), ("sitewright", f"{_HOME}/privato/x", False), ("sitewright", f"{_HOME}/privato/si", True),
        ("sitewright", "https://vuoto.ch/about", False), ("sitewright", "https://vuoto.ch/about/us", True), ("sitewright", "https://altro.it/x", True),
        ("nobody", f"{_HOME}/", False), ("nobody", f"{_HOME}/privato/x", False), ("nobody", f"{_HOME}/privato/si", False),
        ("nobody", "https://vuoto.ch/about", False), ("nobody", "https://vuoto.ch/about/us", True), ("nobody", "https://altro.it/x", True),
        ("Other/1.0", f"{_HOME}/", True), ("Other/1.0", f"{_HOME}/privato/x", False), ("Other/1.0", f"{_HOME}/privato/si", True),
        ("Other/1.0", "https://vuoto.ch/about", False), ("Other/1.0", "https://vuoto.ch/about/us", True), ("Other/1.0", "https://altro.it/x", True),
    ]),
    "captured_scores": _sql("site, name_key, weight, title, first, last", [
        (_LEGNO, "andre moreau", 7, "Titolare", "André", "Moreau"), (_LEGNO, "dora lanza", 6, "Fondatore", "Dora", "Lanza"), (_LEGNO, "ugo foscolo", 1, "Person", "Ugo", "Foscolo"),
        (_LEGNO, "paola verdi", 6, "Founder", "Paola", "Verdi"), (_LEGNO, "marco neri", 10, "Marco Neri, CEO", "Marco", "Neri"), (_LAW, "ugo bianchi", 7, "Director", "Ugo", "Bianchi"),
    ]),
    "captured_pages_chosen": _sql("site, page_id", [(_LEGNO, 1), (_LEGNO, 2), (_LEGNO, 3), (_LEGNO, 5), (_LAW, 4), (_VUOTO, 6)]),
    "owner_run": _sql("site, company, owner, email, email_origin", [
        (_LEGNO, "Rossi Legno", "Marco Neri", "marconeri@rossilegno.it", "synthesized"), (_LAW, "Bianchi & Sons", "", "ugo.bianchi@bianchi.co.uk", "observed"), (_VUOTO, "Vuoto", "", "", "none"),
    ]),
    "owner_run_rows": _sql("site, csv, json", [
        (_LEGNO, '"Rossi Legno","Marco Neri","marconeri@rossilegno.it"', '{"company":"Rossi Legno","owner":"Marco Neri","email":"marconeri@rossilegno.it"}'),
        (_LAW, '"Bianchi & Sons","","ugo.bianchi@bianchi.co.uk"', '{"company":"Bianchi & Sons","owner":"","email":"ugo.bianchi@bianchi.co.uk"}'),
        (_VUOTO, '"Vuoto","",""', '{"company":"Vuoto","owner":"","email":""}'),
    ]),
    "owner_run_evidence": _sql("domain, pages, emails, result", [
        (_LEGNO, 4, "a.neri@rossilegno.it anna@rossilegno.it capo@rossilegno.it info@rossilegno.it ordini@rossilegno.it paola.verdi@rossilegno.it vendite@rossilegno.it", "marconeri@rossilegno.it"),
        (_LAW, 1, "info@bianchi.co.uk ugo.bianchi@bianchi.co.uk", "ugo.bianchi@bianchi.co.uk"), (_VUOTO, 1, "", ""),
    ]),
    "crawl_run": _sql("domain, email", [*[(_LEGNO, e) for s, k, e in _ADDRESSES if s == _LEGNO and k != 8], (_VUOTO, ""), ("nessuno.it", "")]),
    "crawl_order": _sql("site, url, depth, place", [
        ("s", "r1", 0, 1), ("s", "r2", 0, 2), ("s", "a", 1, 3), ("s", "b", 1, 4), ("s", "contact", 1, 5), ("s", "z", 2, 6), ("s", "about", 2, 7), ("s", "y", 2, 8),
    ]),
    "answered_pages": _sql("page_id, url, html", [(1, "https://a.it/1", "caffè"), (2, "https://a.it/2", "però tanto "), (3, "https://a.it/3", "vecchia")]),
    "answered_cards": _sql("url, body", [("https://a.it/anna.vcf", "BEGIN:VCARD\nFN:Anna Rossi\nEMAIL:anna@rossilegno.it\nEMAIL:x@other.com\nEND:VCARD")]),
    "suffix_rules": _sql("host, site, root", [
        ("shop.example.ch", "example.ch", "example"), ("a.b.example.pl", "example.pl", "example"), ("x.example.co.nz", "example.co.nz", "example"), ("www.example.co.uk", "example.co.uk", "example"),
        ("example.sch.uk", "example.sch.uk", "example"), ("a.example.sch.uk", "a.example.sch.uk", "a"), ("city.kobe.jp", "city.kobe.jp", "city"), ("a.city.kobe.jp", "city.kobe.jp", "city"),
        ("b.c.kobe.jp", "b.c.kobe.jp", "b"), ("www.ck", "www.ck", "www"), ("a.b.ck", "a.b.ck", "a"), ("example.com", "example.com", "example"), ("co.uk", "co.uk", "co"),
        ("localhost", "localhost", "localhost"), ("a.example.unknowntop", "example.unknowntop", "example"), ("deep.name.com.br", "name.com.br", "name"),
    ]),
    "references": _sql("k, plain", [(0, "caffè €A"), (1, "&lt;"), (2, "¬it; &unknown; ©2"), (3, "–\ufffd\U0001f600"), (4, "a & b")]),
    "listed_domains": _sql("kind, domain", [
        ("listed", "a.it"), ("listed", "b.org"), ("listed", "b.org"), ("listed", "c.co.uk"), ("listed", "d.it"), ("processed", "a.it/x"), ("processed", "b.org"), ("processed", "c.co.uk"),
        ("processed", "user@d.it:8080/y"), ("first", "a.it"), ("first", "b.org"), ("first", "c.co.uk"), ("first", "d.it"), ("named", _LEGNO), ("named", _LAW), ("named", _VUOTO), ("named", _LEGNO),
    ]),
    "written_results": _sql("kind, line", [
        *[(kind, line) for kind, lines in _RESULTS.items() for line in lines], *[(f"{kind} done", d) for kind in _RESULTS for d in (_LAW, _VUOTO)], *[(f"{kind} after reset", _LAW) for kind in _RESULTS],
    ]),
    "planned_requests": _sql("run, host, url, seq, earliest_ms, headers", [
        (1, "a.it", "https://a.it/1", 1, 0, '{"X-A":"1"}'), (1, "a.it", "https://www.a.it/2", 2, 900, '{"X-A":"1"}'), (1, "b.it", "https://b.it/", 1, 0, '{"X-A":"1"}'),
        (2, "a.it", "https://a.it/3", 1, 1800, "{}"), (2, "c.it", "https://c.it/", 1, 0, "{}"),
    ]),
    "streamed_addresses": _sql("site, page_id, email", _ADDRESSES),
}
