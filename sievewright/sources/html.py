"""HTML readers: a light element tree, and rules that read rows from it."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from email.utils import parsedate_to_datetime
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrow import by_slices

#: Tags of headings.
HEADINGS = {"h1", "h2", "h3", "h4"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
ITEMS = "url string, title string, summary string, published_at timestamp, ord int"
#: Fixed value: a date in words.
WRITTEN_DATE = re.compile(r"\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+\d{1,2},\s+\d{4}\b", re.I)


class Node:
    """An element; ``parts`` has texts and elements in order."""

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.parts = tag, attrs, []

    def events(self, enter: Callable[[Node], bool] = lambda node: True) -> Iterator[tuple[str, Node | str]]:
        """("text", text), ("in", element) and ("out", element) in page order, below this element.

        Elements that ``enter`` refuses have no content and no "out".  A stack
        is walked, so any depth will do.
        """
        left: list[tuple[str, Node | str]] = [("", p) for p in reversed(self.parts)]
        while left:
            kind, part = left.pop()
            if kind:
                yield kind, part
            elif isinstance(part, str):
                yield "text", part
            else:
                yield "in", part
                if enter(part):
                    left.append(("out", part))
                    left += [("", p) for p in reversed(part.parts)]

    def walk(self) -> Iterator[Node]:
        yield self
        yield from (p for kind, p in self.events() if kind == "in")

    def texts(self) -> Iterator[str]:
        return (p for kind, p in self.events() if kind == "text")

    def text(self) -> str:
        return " ".join("".join(self.texts()).split())

    def first(self, *tags: str) -> Node | None:
        return next((n for n in self.walk() if n is not self and n.tag in tags), None)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].parts.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        self.open[-1].parts.append(data)


def tree(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def parse_date(text: str | None) -> datetime | None:
    """ISO 8601, ``Jan 2, 2026``, ``January 2, 2026`` and RFC 2822; naive is UTC."""
    text = (text or "").strip()
    if not text:
        return None
    for read in (
        lambda t: datetime.fromisoformat(t.replace("Z", "+00:00")), lambda t: datetime.strptime(t, "%b %d, %Y"),
        lambda t: datetime.strptime(t, "%B %d, %Y"), parsedate_to_datetime,
    ):
        try:
            found = read(text)
        except (ValueError, TypeError, IndexError):
            continue
        return found.replace(tzinfo=timezone.utc) if found.tzinfo is None else found.astimezone(timezone.utc)
    return None


def allowed(url: str, include: list[str], exclude: list[str]) -> bool:
    return (not include or any(re.search(p, url) for p in include)) and not any(re.search(p, url) for p in exclude)


def listing(html: str, base: str, include=(), exclude=(), title_classes=()) -> list[tuple]:
    """One row for each link with a title of 12 characters or more."""
    rows, seen = [], set()
    for a in (n for n in tree(html).walk() if n.tag == "a" and n.attrs.get("href")):
        url = urljoin(base, a.attrs["href"])
        heading = a.first(*HEADINGS)
        marked = next((n for n in a.walk() if n is not a and any(re.search(p, n.attrs.get("class", "")) for p in title_classes)), None)
        title = (heading and heading.text()) or (marked and marked.text()) or a.text()
        summary, when = a.first("p"), a.first("time")
        if len(title) >= 12 and url.startswith(("http://", "https://")) and url not in seen and allowed(url, include, exclude):
            seen.add(url)
            rows.append((url, title, (summary and summary.text()) or None, parse_date(when and (when.attrs.get("datetime") or when.text()))))
    return rows


def cards(html: str, base: str, include=(), exclude=()) -> list[tuple]:
    """One row for each outermost ``article`` or ``div.card-post``."""
    rows, seen = [], set()

    def is_card(node: Node) -> bool:
        return node.tag == "article" or (node.tag == "div" and "card-post" in node.attrs.get("class", "").split())

    for card in (p for kind, p in tree(html).events(lambda node: not is_card(node)) if kind == "in" and is_card(p)):
        inner = [n for n in card.walk() if n is not card]
        links = [(urljoin(base, n.attrs["href"]), n.attrs.get("aria-label", "")) for n in inner if n.tag == "a" and n.attrs.get("href")]
        headings = [n.text() for n in inner if n.tag in HEADINGS or "card-title" in n.attrs.get("class", "").split()]
        title = next((t for t in headings if len(t) >= 8), "") or next((t for _, t in links if len(t.strip()) >= 8), "")
        url = next((u for u, _ in links if allowed(u, include, exclude)), None)
        if not title or url is None or url in seen:
            continue
        seen.add(url)
        summary = next((t for n in inner if n.tag == "p" and len(t := n.text()) >= 20 and t != title), None)
        when = next((n for n in inner if n.tag == "time"), None)
        written = WRITTEN_DATE.search(" ".join(" ".join(card.texts()).split()))
        rows.append((url, title, summary, parse_date((when and (when.attrs.get("datetime") or when.text())) or (written and written[0]))))
    return rows


def sections(html: str, base: str, heading_tags=("h3",), longest: int | None = 4000) -> list[tuple]:
    """One row for each heading with an id: its fragment URL, title and body.

    A second-level heading ``Date: yyyy-mm-dd`` dates the rows after it.  A
    heading or a rule ends the body, which is cut to ``longest`` characters;
    None keeps it whole.
    """
    rows: list[list] = []
    date, row = None, None
    ends = {"h2", *heading_tags}
    for kind, p in tree(html).events(lambda node: node.tag not in ends):
        if kind == "text" and row is not None:
            row[2].append(p)
        elif kind == "in" and p.tag == "hr":
            row = None
        elif kind == "in" and p.tag in ends:
            row, title = None, p.text().replace("\u200b", "")
            dated = re.fullmatch(r"Date:\s*(\d{4}-\d{2}-\d{2})", title, re.I)
            if p.tag == "h2" and dated:
                date = parse_date(dated[1])
            elif p.tag in heading_tags and p.attrs.get("id") and len(title) >= 4:
                row = [urljoin(base, "#" + p.attrs["id"]), title, [], date]
                rows.append(row)
    first = {r[0]: r for r in reversed(rows)}
    return [(u, t, " ".join("".join(body).split())[:longest] or None, when) for u, t, body, when in first.values()][::-1]


#: Elements without readable text, and elements that start a line.
UNREAD = {"script", "style", "noscript", "svg", "nav", "header", "footer", "form"}
LINES = {"article", "blockquote", "br", "div", "h1", "h2", "h3", "li", "p", "section"}


def readable_text(html: str, longest: int | None = 12_000) -> str:
    """Lines of readable text, white space made single, cut to ``longest`` characters; None keeps all.

    An unread element reaches to its own end tag; end tags of other elements
    don't end it.
    """
    parts = [p if kind == "text" else "\n" * (p.tag in LINES and not (kind == "out" and p.tag in VOID)) for kind, p in tree(html).events(lambda node: node.tag not in UNREAD)]
    lines = (" ".join(x.split()) for x in "".join(parts).splitlines())
    return "\n".join(filter(None, lines))[:longest]


READERS = {"listing": listing, "cards": cards, "sections": sections}


def read_html(pages: DataFrame, reader: str, html: str = "html", base: str = "url", **rules) -> DataFrame:
    """Rows of every page by one of READERS; the page's other columns stay."""
    parse = READERS[reader]
    kept = [c for c in pages.columns if c not in (html, "url", "title", "summary", "published_at", "ord")]
    rows = pages.select(*kept, F.col(html).cast("string").alias("_html"), F.coalesce(F.col(base), F.lit("")).alias("_base"))
    schema = rows.select(*kept).schema
    for name, kind in (("url", "string"), ("title", "string"), ("summary", "string"), ("published_at", "timestamp"), ("ord", "integer")):
        schema = schema.add(name, kind, True)

    def run(batches):
        for batch in batches:
            found = [(i, *row, n) for i, (h, b) in enumerate(zip(batch.column("_html").to_pylist(), batch.column("_base").to_pylist())) for n, row in enumerate(parse(h or "", b, **rules))]
            at = pa.array([f[0] for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(at) for c in kept), pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.string()), pa.array([f[3] for f in found], pa.string()),
                 pa.array([f[4] for f in found], pa.timestamp("us", "UTC")), pa.array([f[5] for f in found], pa.int32())], [*kept, "url", "title", "summary", "published_at", "ord"])

    return rows.mapInArrow(run, schema)


@F.arrow_udf(T.StringType())
def html_text(html: pa.Array) -> pa.Array:
    return by_slices(readable_text, html, pa.string())


@F.arrow_udf(T.StringType())
def whole_html_text(html: pa.Array) -> pa.Array:
    """As ``html_text``, uncut."""
    return by_slices(lambda h: readable_text(h, None), html, pa.string())
