"""Parameters and fixed values of the resolution engine."""

from __future__ import annotations

from dataclasses import dataclass

# They must be these for results to agree.
PATHS = [
    "", "/about", "/team", "/contact", "/directors", "/partners", "/leadership", "/people", "/management", "/company", "/founders",
    "/chi-siamo", "/contatti", "/azienda", "/fondatori", "/governance", "/impressum", "/legal", "/who-we-are", "/la-societa",
    "/equipo", "/sobre-nosotros", "/fundadores", "/contato", "/equipe", "/direction", "/notre-histoire", "/dirigenza",
]
SHORT_PATHS = ["/", "/contact", "/contacts", "/contatti", "/about", "/chi-siamo", "/privacy", "/cookie-policy", "/legal", "/impressum"]
TITLES = [
    "Owner", "Owner Manager", "Founder", "Co-Founder", "CEO", "President", "Managing Director", "Director", "Partner", "Principal", "Proprietor",
    "Titolare", "Fondatore", "Co-Fondatore", "Amministratore Delegato", "Direttore Generale", "Proprietario", "Amministratore Unico", "Legale Rappresentante",
    "Geschäftsführer", "Inhaber", "Président", "Directeur Général", "Dirigente", "Managing Partner", "Chairman", "Chairwoman", "Executive Director",
]
LINK_WORDS = [
    "about", "team", "people", "leadership", "company", "founder", "chi-siamo", "azienda", "impressum", "governance", "directors", "partners",
    "management", "contatti", "contact", "who-we-are",
]
SITEMAP_WORDS = ["about", "team", "leadership", "people", "founder", "chi-siamo", "azienda", "impressum", "governance", "directors", "partners", "management"]
HINTS = ["contact", "contatt", "about", "chi-siamo", "company", "team", "privacy", "cookie", "legal", "impressum", "support", "assistenza"]
STOPWORDS = [
    "our", "approach", "frequently", "asked", "mitcham", "office", "griffin", "chartered", "outsourced", "finance", "wimbledon", "online", "accounting",
    "team", "studio", "guesthouse", "limited", "ltd", "plc", "llp", "inc", "gmbh", "srl", "spa", "services", "service", "about", "contact", "careers", "jobs",
    "privacy", "policy", "terms", "conditions", "support", "bookkeeping", "audit", "tax", "consulting", "payroll", "systems", "advice", "solutions",
    "digital", "cloud", "innovation", "management", "accounts", "price", "cheap", "business", "company", "firm", "practice", "financial", "reports",
    "traders", "trading", "clients", "customers", "vendors", "suppliers", "invoices", "receipts", "working", "capital", "equity", "profit", "revenue", "income",
    "role", "job", "solution", "trust", "newsletter", "faq", "faqs", "events", "press", "news", "blog", "care", "contactus", "download", "resources", "library",
    "low", "cost", "more", "than", "loan", "account", "with", "sea", "inspection", "accountant", "accountants", "simplex", "ascot", "drummond", "sutherland", "black",
]
BLOCKED_PHRASES = ["low cost", "more than", "loan account", "accountant with", "sea inspection"]
PERSON_KEYS = ["founder", "founders", "member", "members", "employee", "employees", "author", "publisher", "creator"]
BLOCK_CLASSES = ["team-member", "member", "person", "card", "bio", "profile", "staff", "leader", "founder"]
# End of the fixed values.

#: Names under which countries register, by country, as the public suffix list has them; every top domain is a suffix by
#: the list's rule for names that it does not hold. sources.tables.suffix_file() reads the whole list where it is at hand.
SECOND_LEVEL = {
    "ar": "com edu gob int mil net org tur", "at": "ac co gv or", "au": "asn com edu gov id net org", "br": "adv art blog com edu eng gov ind inf mil net org",
    "cn": "ac com edu gov mil net org", "co": "com edu gov mil net nom org", "cy": "ac com gov ltd net org", "eg": "com edu gov net org", "gr": "com edu gov net org",
    "hk": "com edu gov idv net org", "hu": "co info org priv", "id": "ac co desa go mil net or sch web", "il": "ac co gov idf k12 muni net org", "in": "ac co edu firm gen gov ind mil net nic org res",
    "it": "edu gov", "jp": "ac ad co ed go gr lg ne or", "ke": "ac co go info me mobi ne or sc", "kr": "ac co go mil ne or pe re", "mx": "com edu gob net org", "my": "com edu gov mil name net org",
    "nz": "ac co cri geek gen govt health iwi kiwi maori mil net org parliament school", "pl": "com edu gov info net org", "pt": "com edu gov int net nome org publ", "ro": "arts com firm info nom nt org rec store tm www",
    "ru": "ac edu gov int mil", "sg": "com edu gov net org", "th": "ac co go in mi net or", "tr": "av bel biz com dr edu gen gov info k12 kep mil name net org pol tel tsk tv web", "tw": "club com ebiz edu game gov idv mil net org",
    "ua": "com edu gov in net org", "uk": "ac co gov ltd me net nhs org plc police", "vn": "ac biz com edu gov health info int name net org pro", "za": "ac agric alt co edu gov grondar law mil net ngo nic nis nom org school tm web",
}
#: Rules of the same list for any name under a suffix, and exceptions from those.
ANY_NAME = ["*.bd", "*.ck", "*.er", "*.fk", "*.jm", "*.kawasaki.jp", "*.kh", "*.kitakyushu.jp", "*.kobe.jp", "*.mm", "*.nagoya.jp", "*.np", "*.pg", "*.sapporo.jp", "*.sch.uk", "*.sendai.jp", "*.yokohama.jp"]
EXCEPTIONS = ["!city.kawasaki.jp", "!city.kitakyushu.jp", "!city.kobe.jp", "!city.nagoya.jp", "!city.sapporo.jp", "!city.sendai.jp", "!city.yokohama.jp", "!www.ck"]


@dataclass(frozen=True)
class Config:
    """Options of a run. The engine works on captured tables: rate, retries and backoff only shape the planned schedule."""

    max_pages: int = 16
    max_depth: int = 2
    bfs_pages: int = 60
    rate_ms: int = 900
    retries: int = 3
    backoff_ms: int = 600
    body_limit: int = 1_800_000
    strict: bool = True
    hash_evidence: bool = True
    sitemap: bool = True
    extra_paths: tuple[str, ...] = ()
    on_domain_only: bool = False
    mode: str = "intended"
    agent: str = "sitewright"
    headers: str = ""

    def page_budget(self) -> int:
        return max(3, self.max_pages)

    def sitemap_budget(self) -> int:
        return max(4, self.page_budget() // 2)
