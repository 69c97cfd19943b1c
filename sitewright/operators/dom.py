"""People out of elements by class and out of linked data: pages are read once into rows of elements, selectors are joins on them."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewright.config import BLOCK_CLASSES, PERSON_KEYS, TITLES
from sitewright.functions.names import PAIR, WHOLE, has_role, is_human_name
from sitewright.sources.tables import kept

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_HEADINGS, _UNREAD = ["h1", "h2", "h3", "h4"], ("script", "style")
_CARDS, _NAMES, _ROLES = ["h-card", "vcard", "hcard"], ["p-name", "fn", "name"], ["p-job-title", "title", "role"]
_ROLE = re.compile("|".join(TITLES), re.I)
_NAME = re.compile(r"^([A-Z](?:[^\W\d_]|['’-])+)\s+([A-Z](?:[^\W\d_]|['’-])+)$")
ELEMENT = "site string, page_id long, pre int, last int, tag string, classes array<string>, text string"
SCHEMA = "site string, page_id long, channel_ord int, hit_ord int, title string, first string, last string, weight int"


class Elements(HTMLParser):
    """Rows [pre, last, tag, classes, text] of a page's elements that have a class, are headings or hold linked data.

    pre is the place of an element's start tag among all, last that of the last one inside it: an element lies in another
    when its pre is after the other's and not after its last. What is left open ends where an end tag around it does. An
    element's text is a piece of the page's, which leaves scripts and styles out.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.n, self.length = 0, 0
        self.said: list[str] = []
        self.open: list[tuple[str, int, int, list | None]] = []  # tag, pre, place in the text, row
        self.rows: list[list] = []

    def handle_starttag(self, tag, attrs):
        named, row = dict(attrs), None
        classes = (named.get("class") or "").split()
        data = tag == "script" and named.get("type") == "application/ld+json"
        if classes or data or tag in _HEADINGS:
            row = [self.n, self.n, tag, classes, "" if data else (self.length, self.length)]
            self.rows.append(row)
        if tag not in _VOID:
            self.open.append((tag, self.n, self.length, row))
        self.n += 1

    def _end(self):
        tag, _, start, row = self.open.pop()
        if row is not None:
            row[1] = self.n - 1
            if not isinstance(row[4], str):
                row[4] = start, self.length

    def handle_endtag(self, tag):
        if any(x[0] == tag for x in self.open):
            while self.open[-1][0] != tag:
                self._end()
            self._end()

    def handle_data(self, data):
        top = self.open[-1] if self.open else None
        if top and top[0] in _UNREAD:
            if top[3] is not None and isinstance(top[3][4], str):
                top[3][4] += data
        else:
            self.said.append(data)
            self.length += len(data)

    def whole(self) -> list[list]:
        while self.open:
            self._end()
        text = "".join(self.said)
        return [[*row[:4], row[4] if isinstance(row[4], str) else text[slice(*row[4])]] for row in self.rows]


def page_elements(html: str) -> list[list]:
    page = Elements()
    page.feed(html)
    page.close()
    return page.whole()


def elements(pages: DataFrame) -> DataFrame:
    """ELEMENT: a row for each element of pages (site, page_id, html) that a selector may ask for, by one pass over each page.

    Pages without a class, a heading or linked data have none and are not handed to Python.
    """

    def read(batches):
        names = pa.schema([("site", pa.string()), ("page_id", pa.int64()), ("pre", pa.int32()), ("last", pa.int32()), ("tag", pa.string()), ("classes", pa.list_(pa.string())), ("text", pa.string())])
        for b in batches:
            rows = []
            for site, page, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                rows += [dict(zip(names.names, (site, page, *row), strict=True)) for row in page_elements(html.as_py())]
            yield pa.RecordBatch.from_pylist(rows, schema=names)

    some = F.coalesce("html", F.lit("")).rlike(r"(?i)class\s*=|<h[1-4]|ld\+json")
    return pages.filter(some).select("site", F.col("page_id").cast("long"), "html").mapInArrow(read, ELEMENT)


def of_class(found: DataFrame, classes: list[str]) -> DataFrame:
    """Elements that have any of the classes."""
    return found.filter(F.arrays_overlap("classes", F.array(*map(F.lit, classes))))


def inside(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """Pairs of an element of outer and one of inner that lies in it: site, page_id, pre of the outer, the inner one's as struct e."""
    o, i = outer.select("site", "page_id", "pre", "last"), inner.select(F.col("site").alias("_site"), F.col("page_id").alias("_page"), F.struct("pre", "classes", "text").alias("e"))
    same = (o["site"] == i["_site"]) & (o["page_id"] == i["_page"]) & (F.col("e.pre") > o["pre"]) & (F.col("e.pre") <= o["last"])
    return o.join(i, same).select("site", "page_id", "pre", "e")


def linked_people(text: str) -> list[tuple[str, str, str, int]]:
    """Person nodes and the values of the keys that name people, at any depth of lists and graphs; a bad node is passed over."""
    hits = []
    try:
        stack = [json.loads(text)]
    except ValueError:
        return hits
    while stack:
        node = stack.pop(0)
        if isinstance(node, list):
            stack = node + stack
        elif isinstance(node, dict):
            kind = node.get("@type")
            people = [node] if kind == "Person" or isinstance(kind, list) and "Person" in kind else []
            for key in PERSON_KEYS:
                v = node.get(key)
                people += v if isinstance(v, list) else [v] if isinstance(v, dict) else []
            for p in people:
                m = _NAME.match(p["name"].strip()) if isinstance(p, dict) and isinstance(p.get("name"), str) else None
                if m:
                    job = next((p[k] for k in ("jobTitle", "title", "role") if isinstance(p.get(k), str) and p[k]), "")
                    hits.append((job.strip() or "Person", m[1], m[2], 3 if _ROLE.search(job) else 1))
            if node.get("@graph"):
                stack = [node["@graph"], *stack]
    return hits


def _in_order(hits: DataFrame, channel: int, *order: str) -> DataFrame:
    """SCHEMA of hits, numbered within their page."""
    w = Window.partitionBy("site", "page_id").orderBy(*order)
    return hits.select("site", "page_id", F.lit(channel).alias("channel_ord"), (F.row_number().over(w) - 1).alias("hit_ord"), "title", "first", "last", "weight")


def linked_data_people(found: DataFrame) -> DataFrame:
    """SCHEMA: people of scripts of linked data; their JSON is read by a helper, a script at a time."""

    def read(batches):
        for b in batches:
            rows = [(site, page, pre, k, *hit) for site, page, pre, text in zip(*(c.to_pylist() for c in b.columns), strict=True) for k, hit in enumerate(linked_people(text))]
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32()]
            names = ["site", "page_id", "pre", "k", "title", "first", "last", "weight"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 8, kinds, strict=True)], names=names)

    scripts = found.filter("tag = 'script'").select("site", "page_id", "pre", "text")
    return _in_order(scripts.mapInArrow(read, "site string, page_id long, pre int, k int, title string, first string, last string, weight int"), 1, "pre", "k")


def _squeezed(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def card_people(found: DataFrame) -> DataFrame:
    """SCHEMA: people of contact cards: the texts of all elements in a card that are a name, and of those that are a role."""
    parts = inside(of_class(found, _CARDS), of_class(found, _NAMES + _ROLES)).groupBy("site", "page_id", "pre").agg(F.array_sort(F.collect_list("e")).alias("parts"))

    def text(classes: list[str]) -> Column:
        own = F.filter("parts", lambda p: F.arrays_overlap(p["classes"], F.array(*map(F.lit, classes))))
        return F.regexp_replace(F.array_join(F.transform(own, lambda p: p["text"]), ""), r"(?U)^\s+|\s+$", "")

    named = parts.select("site", "page_id", "pre", text(_NAMES).alias("name"), text(_ROLES).alias("role")).filter(F.col("name").rlike("(?U)" + WHOLE))
    first, last = (F.regexp_extract("name", "(?U)" + WHOLE, k) for k in (1, 2))
    hits = named.select("site", "page_id", "pre", F.when(F.col("role") == "", "Person").otherwise(F.col("role")).alias("title"), first.alias("first"), last.alias("last"), F.when(has_role(F.col("role")), 3).otherwise(1).alias("weight"))
    return _in_order(hits, 2, "pre")


def block_people(found: DataFrame, strict: bool = True) -> DataFrame:
    """SCHEMA: the first name in each heading, and each block of a class that people stand in; in strict mode in those with a role."""
    blocks = found.filter(F.col("tag").isin(_HEADINGS) | F.arrays_overlap("classes", F.array(*map(F.lit, BLOCK_CLASSES))) | F.contains(F.array_join("classes", " "), F.lit("team")))
    rows = blocks.select("site", "page_id", "pre", _squeezed(F.col("text")).alias("block"))
    rows = rows.filter((F.regexp_extract("block", PAIR, 1) != "") & (has_role(F.col("block")) | F.lit(not strict)))
    hits = rows.select("site", "page_id", "pre", F.substring("block", 1, 160).alias("title"), F.regexp_extract("block", PAIR, 1).alias("first"), F.regexp_extract("block", PAIR, 2).alias("last"), F.lit(2).alias("weight"))
    return _in_order(hits, 3, "pre").filter(is_human_name(F.col("first"), F.col("last")))


def dom_people(pages: DataFrame, strict: bool = True, linked_data: bool = True, cards: bool = True, blocks: bool = True) -> DataFrame:
    """SCHEMA: people of linked data (channel 1), contact cards (2) and blocks by class or heading that hold a human name (3).

    The elements of all pages are kept as a table, which the selectors read.
    """
    found = kept(elements(pages), "elements")
    out = [f for f, wanted in ((linked_data_people, linked_data), (card_people, cards)) if wanted]
    parts = [f(found) for f in out] + ([block_people(found, strict)] if blocks else [])
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionByName(part)
    return hits
