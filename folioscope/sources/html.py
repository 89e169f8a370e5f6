"""Page parsers: listing, abstract, search and bibliography pages, each to a struct with an error field.

One small tree is built for each page and the parsers are rules over its nodes; pages stream through Arrow
batches. A parser that finds its page incomplete reports why and returns nothing else.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime
from html.parser import HTMLParser
from urllib.parse import unquote, urlsplit

import pandas as pd
from pyspark.sql import DataFrame

from folioscope.functions.text import BARE_ID, DOI_ID, HOSTS, LABELLED_ID, PATH_ID, REFERENCE_LABEL, SPLIT_NAME
from folioscope.session import find_package

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    parts: list = field(default_factory=list)
    closed: bool = False

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(reversed([p for p in n.parts if isinstance(p, Node)]))

    def all(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n.tag in tags]

    def classes(self) -> set[str]:
        return {*(self.attrs.get("class") or "").split()}

    def text(self, skip: Callable[[Node], bool] = lambda n: False) -> str:
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            elif not skip(n):
                stack.extend(reversed(n.parts))
        return " ".join("".join(out).split())


class Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#", closed=True)
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs}, closed=tag in VOID)
        self.open[-1].parts.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.open[-1].parts.append(Node(tag, {k: v or "" for k, v in attrs}, closed=True))

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                self.open[i].closed = True
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        if self.open[-1].tag not in ("script", "style"):
            self.open[-1].parts.append(data)


def tree(html: str | None) -> Node:
    t = Tree()
    t.feed(html or "")
    t.close()
    return t.root


def meta(root: Node, name: str) -> list[str]:
    return [n.attrs.get("content", "") for n in root.all("meta") if name in (n.attrs.get("name"), n.attrs.get("property"))]


def parts_of(name: str) -> tuple[str, int | None]:
    """An identifier in lower case without its version, and the version."""
    m = re.fullmatch(r"(.*?)(?:v(\d+))?", name.lower())
    return m[1], int(m[2]) if m[2] else None


def names_in(href: str) -> list[str]:
    """Identifiers (as written) in a link: its path on a known host or without one, its DOI, labelled ones anywhere."""
    decoded = unquote(href.strip())
    try:
        link = urlsplit(decoded)
        host = (link.hostname or "").lower()
    except ValueError:
        return []
    out = [m[1] for m in re.finditer(DOI_ID, link.path)] + [m[1] for m in re.finditer(LABELLED_ID, decoded)]
    if not host or host in HOSTS:
        out += [m[1] for m in re.finditer(PATH_ID, link.path)]
    return out


def id_of(href: str) -> str | None:
    return next((parts_of(n)[0] for n in names_in(href)), None)


def ids_in(said: str) -> set[str]:
    joined = re.sub(SPLIT_NAME, r"\1\2", said)
    return {parts_of(m[1])[0] for p in (BARE_ID, LABELLED_ID) for m in re.finditer(p, joined)}


def utc_second(stamp: str) -> str | None:
    """An RFC 2822 time as a UTC second; one without a zone is no time."""
    try:
        at = parsedate_to_datetime(stamp)
    except (TypeError, ValueError):
        return None
    return None if at.tzinfo is None else at.astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def day_of(text: str) -> str | None:
    bare = re.sub(r"^[A-Za-z]+,\s*", "", text.strip())
    for pattern in ("%d %B %Y", "%d %b %Y"):
        try:
            return datetime.strptime(bare, pattern).date().isoformat()
        except ValueError:
            continue
    return None


SECTIONS = (("new", "new"), ("cross", "cross"), ("replacement", "replacement"))


def listing(html: str) -> dict:
    """Batches (day, section, ids in first-seen order) of a listing page."""
    root = tree(html)
    day, section, seen = None, "recent", {}
    days: list[str] = []
    everything: dict[str, None] = {}
    for n in root.walk():
        if n.tag in ("h1", "h2", "h3"):
            title = n.text()
            m = re.match(r"(?i)showing new listings for (.+)$", title)
            found = day_of(m[1]) if m else day_of(re.sub(r"\s*\(.*$", "", title))
            if found:
                day = found
                days.append(day)
                section = "recent" if not m else section
            for prefix, name in SECTIONS:
                if title.lower().startswith(prefix):
                    section = name
        inside = n.attrs.get("id") == "articles" or "articles" in n.classes()
        if inside:
            for dt in n.all("dt", "h1", "h2", "h3"):
                if dt.tag != "dt":
                    title = dt.text()
                    found = day_of(re.sub(r"\s*\(.*$", "", title))
                    day = found or day
                    section = next((s for p, s in SECTIONS if title.lower().startswith(p)), "recent" if found else section)
                    continue
                for a in dt.all("a"):
                    if (i := id_of(a.attrs.get("href", ""))) and day:
                        seen.setdefault((day, section), {})[i] = None
                        everything[i] = None
    text = root.text()
    for m in re.finditer(r"(?i)showing first (\d+) of (\d+)", text):
        if int(m[1]) < int(m[2]):
            return {"batches": [], "error": f"partial listing: {m[0]}"}
    total = re.search(r"(?i)total of (\d+)", text)
    if not seen:
        if total and int(total[1]) == 0 and days:
            return {"batches": [(d, "recent", []) for d in sorted({*days})], "error": None}
        return {"batches": [], "error": "no dated entries"}
    if total and int(total[1]) != len(everything):
        return {"batches": [], "error": f"total of {total[1]} but {len(everything)} ids"}
    return {"batches": [(d, s, [*ids]) for (d, s), ids in sorted(seen.items())], "error": None}


def abstract(html: str, expected: str | None = None) -> dict:
    """Metadata and version history of an abstract page."""
    root = tree(html)
    bad = lambda e: {"id": None, "version": None, "title": None, "authors": [], "abstract": None, "submitted": None, "updated": None, "submitted_at": None, "updated_at": None, "subjects": [], "error": e}
    links = [n.attrs.get("href", "") for n in root.all("link") if n.attrs.get("rel") == "canonical"]
    paper = (meta(root, "citation_arxiv_id") or [id_of(x) for x in links] or [None])[0]
    paper = paper.lower() if paper else None
    if not paper or (expected and paper != expected):
        return bad("no identity" if not paper else f"found {paper}, not {expected}")
    strip = lambda name: next((re.sub(rf"^{name}:\s*", "", n.text(), flags=re.I) for n in root.walk() if name.lower() in n.classes()), None)
    title = (meta(root, "citation_title") or [strip("Title")])[0]
    authors = meta(root, "citation_author") or [a for a in re.split(r"\s*,\s*", strip("Authors") or "") if a]
    summary = (meta(root, "citation_abstract") or meta(root, "og:description") or [strip("Abstract")])[0]
    if not (title and authors and summary):
        return bad("title, authors and abstract are needed")
    history = [(int(v), d) for v, d in re.findall(r"\[v(\d+)\]\s*(?:[A-Za-z]{3},\s*)?(\d{1,2} [A-Za-z]{3} \d{4})", root.text())]
    if [v for v, _ in history] != [*range(1, len(history) + 1)] or not history:
        return bad("version history has gaps")
    stamps = [utc_second(x) for x in re.findall(r"\[v\d+\]\s*((?:[A-Za-z]{3},\s*)?\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2} \S+)", root.text())]
    first, last = (stamps[0], stamps[-1]) if len(stamps) == len(history) else (None, None)
    subjects = sorted({s.strip() for n in root.walk() if "subjects" in n.classes() for s in re.sub(r"^Subjects:\s*", "", n.text()).split(";") if s.strip()})
    return {
        "id": paper, "version": history[-1][0], "title": " ".join(title.split()), "authors": authors, "abstract": " ".join(summary.split()),
        "submitted": first[:10] if first else day_of(history[0][1]), "updated": last[:10] if last else day_of(history[-1][1]),
        "submitted_at": first, "updated_at": last, "subjects": subjects, "error": None,
    }


def search(html: str) -> dict:
    """Newest-first ids, link to the next page and stated total of a search page."""
    root = tree(html)
    results = [n for n in root.walk() if "arxiv-result" in n.classes()]
    linked = [[*filter(None, (id_of(a.attrs.get("href", "")) for a in n.all("a")))] for n in results]
    ids = [found[0] for found in linked if found]
    total = re.search(r"(?i)\bof\s+([\d,]+)\s+results", root.text()) or re.search(r"(?i)produced (no) results", root.text())
    if not total:
        return {"ids": [], "next": None, "total": None, "error": "no stated total"}
    if len(ids) != len(results) or len({*ids}) != len(ids):
        return {"ids": [], "next": None, "total": None, "error": "a result has no id of its own"}
    step = next((a.attrs.get("href") for a in root.all("a") if "pagination-next" in a.classes()), None)
    return {"ids": ids, "next": step, "total": 0 if total[1] == "no" else int(total[1].replace(",", "")), "error": None}


REVERSE, LABELS = "ltx_bib_cited", {"ltx_bib_key", "ltx_role_refnum", "ltx_tag_bibitem"}
BOXES = {"ltx_bibliography", "bibliography", "reference-list", "references"}
WATERMARK = "watermark"


def identity(root: Node) -> tuple[set[str], set[int]]:
    """Identifiers and versions that the page states about itself: canonical links, metadata, base address, watermark."""
    said = [n.attrs.get("href", "") for n in root.all("link") if "canonical" in n.attrs.get("rel", "").lower().split()]
    said += [n.attrs.get("href", "") for n in root.all("base")]
    names = [x for h in said for x in names_in(h)] + meta(root, "citation_arxiv_id")
    for n in root.walk():
        if WATERMARK in (n.attrs.get("id", "") + " ".join(n.classes())).lower():
            names += [m[1] for m in re.finditer(LABELLED_ID, n.text())]
    found = [parts_of(n) for n in names if re.fullmatch(BARE_ID, n)]
    return {i for i, _ in found}, {v for _, v in found if v is not None}


def conflict(root: Node, expected: str | None, version: int | None) -> str | None:
    """Why the page isn't the expected paper's, or None; without expectations it need not state who it is."""
    ids, versions = identity(root)
    if len(ids) > 1 or len(versions) > 1:
        return "the page states more than one identity"
    if expected is not None:
        name, own = parts_of(expected)
        version = own if version is None else version
        if ids != {name}:
            return f"found {', '.join(ids) or 'no identity'}, not {name}"
    if version is not None and versions != {version}:
        return f"found {', '.join(f'v{v}' for v in versions) or 'no version'}, not v{version}"
    return None


def bibliography(
    html: str, expected: str | None = None, version: int | None = None, aliases: dict[str, str] | None = None
) -> dict:
    """Sorted distinct referenced ids of the page's References sections, of all of them together.

    An item counts by its text besides its label or by a link that leaves the page; a section without such
    an item, or not closed, is an error, and one that only lists citing papers is passed over. ``aliases``
    (title: id) name works cited before they had an id. The page's own identity comes from its metadata, never from its links.
    """
    root = tree(html)
    bad = lambda e: {"references": [], "error": e}
    boxes = [n for n in root.walk() if n.tag in ("section", "div") and (BOXES & n.classes() or n.attrs.get("id") in BOXES | {"bib"})]
    boxes = [n for n in boxes if any(h.text().lower() == "references" for h in n.all("h1", "h2", "h3", "h4", "h5", "h6"))]
    inner = {id(x) for n in boxes for x in n.walk() if x is not n}
    boxes = [n for n in boxes if id(n) not in inner]
    if not boxes:
        return bad("no References section")
    if why := conflict(root, expected, version):
        return bad(why)
    titles = {" ".join(t.lower().split()): i for t, i in (aliases or {}).items()}
    found: set[str] = set()
    complete = 0
    for box in boxes:
        items = [n for n in box.walk() if "ltx_bibitem" in n.classes()] or [n for n in box.all("li")]
        if not box.closed or any(not i.closed and i.tag != "li" for i in items):
            return bad("section isn't closed")
        whole, reverse = 0, 0
        for item in items:
            skipped = lambda n: REVERSE in n.classes()
            dropped = {id(x) for n in item.walk() if skipped(n) for x in n.walk()}
            hrefs = [a.attrs.get("href", "") for a in item.all("a") if id(a) not in dropped]
            said = item.text(lambda n: skipped(n) or bool(LABELS & n.classes()))
            bare = re.sub(REFERENCE_LABEL, "", said)
            if bare.casefold().startswith("cited by:") or (dropped and not bare):
                reverse += 1
                continue
            if not bare and all(h.strip().startswith("#") for h in hrefs):
                continue
            whole += 1
            found |= {parts_of(n)[0] for h in hrefs for n in names_in(h)} | ids_in(said)
            low = " ".join(said.lower().split())
            found |= {i for t, i in titles.items() if t in low}
        if not whole and not (reverse and reverse == len(items)):
            return bad("section without a reference")
        complete += bool(whole)
    if not complete:
        return bad("only citing papers are listed")
    return {"references": sorted(found), "error": None}


def page(html: str) -> dict:
    """Title, headings, links and visible characters of any page; error for an empty one."""
    root = tree(html)
    title = next((n.text() for n in root.all("title")), None)
    h1 = next((n.text() for n in root.all("h1")), None)
    links = [n.attrs["href"] for n in root.all("a") if n.attrs.get("href")]
    chars = len(root.text(lambda n: n.tag in ("script", "style", "head")))
    return {"title": title, "h1": h1, "links": links, "chars": chars, "error": None if title or chars else "empty page"}


def parse_pages(pages: DataFrame, key: str, html: str, parser: Callable[..., dict], fields: str, with_key: bool = False) -> DataFrame:
    """``parser`` over a column of pages; ``fields`` is the result's DDL (its names are the parser's keys). ``with_key``: the key is
    JSON with the id and version that the page is expected to be of, and the parser gets them too."""
    names = [f.strip().split(" ")[0] for f in re.split(r",(?![^<]*>)", fields)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if with_key:
                wanted = [json.loads(k) for k in b[key]]
                got = [parser(h, w.get("id"), w.get("version")) for h, w in zip(b[html], wanted)]
            else:
                got = [parser(h) for h in b[html]]
            yield pd.DataFrame({key: b[key], **{n: [g[n] for g in got] for n in names}})

    kind = dict(pages.dtypes)[key]
    find_package(pages.sparkSession)
    return pages.select(key, html).mapInPandas(run, f"{key} {kind}, {fields}")
