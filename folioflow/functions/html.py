"""Fields of listing pages by CSS selectors, on the standard library's HTML parser.

The selector grammar is what listings need: tag, ``.class``, ``#id``,
``[attr]``, ``[attr=v]``, ``[attr$=v]``, ``[attr^=v]``, ``[attr*=v]``, descendant and
child steps, and comma-separated alternatives. Pages may leave tags unclosed.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.functions.jsonx import FIELD_KEYS, ITEM_KEYS

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag that closes an open element of these kinds.
CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
BLOCKS = frozenset("div article section ul ol table nav footer header main h1 h2 h3 h4 h5 h6 form".split())
MAX_ITEMS = 300


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "order")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None, order: int):
        self.tag, self.attrs, self.parent, self.order = tag, attrs, parent, order
        self.children: list[Node | str] = []

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def walk(self) -> Iterator[Node]:
        """Elements below, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            n = stack.pop()
            yield n
            stack += [c for c in reversed(n.children) if isinstance(c, Node)]

    def text(self) -> str:
        """Text below with white space as single spaces."""
        out: list[str] = []
        stack: list[Node | str] = [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.tag not in ("script", "style"):
                stack += reversed(n.children)
        return " ".join(" ".join(out).split())


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None, 0)
        self.count = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        closes = CLOSES.get(tag, set()) | ({"p"} if tag in BLOCKS else set())
        n = self.at
        while n.parent and n.tag not in ("ul", "ol", "table", "div", "article", "section"):
            if n.tag in closes:
                self.at = n.parent
                break
            n = n.parent
        self.count += 1
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at, self.count)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        n: Node | None = self.at
        while n and n.tag != tag:
            n = n.parent
        if n and n.parent:
            self.at = n.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


_STEP = re.compile(r"\s*(>)?\s*((?:[\w*-]+|\.[\w-]+|#[\w-]+|\[[^\]]*\])+)")
_PART = re.compile(r"([\w*-]+)|\.([\w-]+)|#([\w-]+)|\[\s*([\w-]+)\s*(?:([$^*~|]?=)\s*[\"']?([^\"'\]]*)[\"']?\s*)?\]")


def _steps(selector: str) -> list[tuple[bool, list[tuple]]]:
    """(child of the step before, conditions) for each step; ValueError for what isn't in the grammar."""
    out, at = [], 0
    selector = selector.strip()
    while at < len(selector):
        m = _STEP.match(selector, at)
        if not m or m.end() == at:
            raise ValueError(f"selector not understood: {selector}")
        out.append((bool(m.group(1)), [p.groups() for p in _PART.finditer(m.group(2))]))
        at = m.end()
        while at < len(selector) and selector[at].isspace():
            at += 1
    if not out:
        raise ValueError("empty selector")
    return out


def _fits(n: Node, conditions: list[tuple]) -> bool:
    for tag, cls, ident, attr, op, value in conditions:
        if tag and tag != "*" and n.tag != tag.lower():
            return False
        if cls and cls not in n.classes:
            return False
        if ident and n.attrs.get("id") != ident:
            return False
        if attr:
            have = n.attrs.get(attr)
            if have is None:
                return False
            if op and not {
                "=": have == value, "$=": have.endswith(value), "^=": have.startswith(value), "*=": value in have,
                "~=": value in have.split(), "|=": have == value or have.startswith(value + "-"),
            }[op]:
                return False
    return True


def _matches(n: Node, steps: list[tuple[bool, list[tuple]]], root: Node) -> bool:
    if not _fits(n, steps[-1][1]):
        return False
    if len(steps) == 1:
        return True
    up = n.parent
    if steps[-1][0]:
        return up is not None and up is not root.parent and up.tag != "" and _matches(up, steps[:-1], root)
    while up is not None and up.tag != "":
        if _matches(up, steps[:-1], root):
            return True
        up = up.parent
    return False


def select(root: Node, selector: str) -> list[Node]:
    """Elements below ``root`` that fit, in document order."""
    every = [_steps(s) for s in selector.split(",") if s.strip()]
    return [n for n in root.walk() if any(_matches(n, s, root) for s in every)]


def css_of(n: Node | None) -> str:
    """A short selector of an element: its first class, else its id, else its tag."""
    if n is None or not n.tag:
        return "body"
    if n.classes:
        return f".{n.classes[0]}"
    return f"#{n.attrs['id']}" if n.attrs.get("id") else n.tag


def _safe_select(root: Node, selector: str | None) -> list[Node]:
    if not selector:
        return []
    try:
        return select(root, selector)
    except ValueError:
        return []


def extract_items(html: str, url: str, selectors: dict[str, str], container: str = "article.node-paper") -> list[dict[str, str]]:
    """Listing rows {title, abstract, url}: of each container, else by position over the page.

    In a container the first title, all abstracts joined, the first link; without
    containers the n-th title takes the n-th group of abstracts, groups of
    max(1, abstracts // titles). Rows without title and abstract are left out.
    """
    root = parse(html)
    out = []
    boxes = _safe_select(root, container)
    if boxes:
        for box in boxes:
            title = next((n.text() for n in _safe_select(box, selectors.get("title"))), "")
            abstract = " ".join(n.text() for n in _safe_select(box, selectors.get("abstract"))).strip()
            href = next((n.attrs.get("href", "") for n in _safe_select(box, selectors.get("link"))), "")
            if title or abstract:
                out.append({"title": title, "abstract": abstract, "url": urljoin(url, href) if href else url})
        return out
    titles, abstracts = _safe_select(root, selectors.get("title")), _safe_select(root, selectors.get("abstract"))
    links = _safe_select(root, selectors.get("link"))
    group = max(1, len(abstracts) // len(titles)) if titles else 1
    for k, t in enumerate(titles):
        href = links[k].attrs.get("href", "") if k < len(links) else ""
        text = " ".join(n.text() for n in abstracts[k * group : (k + 1) * group])
        out.append({"title": t.text(), "abstract": text, "url": urljoin(url, href) if href else url})
    return out


def extract_texts(html: str, selectors: dict[str, str]) -> dict[str, list[str]]:
    """Texts of each selector; an error message for one that isn't understood."""
    root, out = parse(html), {}
    for key, selector in selectors.items():
        try:
            out[key] = [n.text() for n in select(root, selector)]
        except ValueError as e:
            out[key] = [f"error: {e}"]
    return out


def extract_detail(html: str, url: str, selectors: dict[str, str]) -> dict[str, str]:
    """{pdf_url, abstract} of a detail page."""
    root = parse(html)
    link = next((n.attrs.get("href", "") for n in _safe_select(root, selectors.get("pdf_link") or selectors.get("pdf"))), "")
    return {"pdf_url": urljoin(url, link) if link else "", "abstract": " ".join(n.text() for n in _safe_select(root, selectors.get("abstract")))}


def detect_item(root: Node, title_selector: str | None) -> tuple[str, list[str]]:
    """An item selector from the ancestors of titles: those with 5 to 500 titles, nearest to one each, then the most."""
    titles = _safe_select(root, title_selector)
    counts: Counter = Counter()
    for t in titles[:200]:
        up = t.parent
        for _ in range(3):
            if up is None or not up.tag:
                break
            counts[css_of(up)] += 1
            up = up.parent
    n = len(titles)
    ranked = sorted(((1.0 - abs(c - n) / max(n, 1), c, s) for s, c in counts.items() if 5 <= c <= 500), key=lambda x: (-x[0], -x[1]))
    found = [s for _, _, s in ranked[:10]] or ["body"]
    return found[0], found


def verify(html: str, selector_json: str) -> dict[str, object]:
    """Per-page counts for the verification of a selector: items and hits of each field in them."""
    try:
        given = json.loads(selector_json)
    except (TypeError, ValueError):
        given = {}
    given = given if isinstance(given, dict) else {}
    pick = lambda *keys: next((given[k].strip() for k in keys if isinstance(given.get(k), str) and given[k].strip()), None)
    fields = {field: pick(*keys) for field, keys in FIELD_KEYS.items()}
    root = parse(html)
    item = pick(*ITEM_KEYS) or detect_item(root, fields["title"])[0]
    boxes = ([root] if item == "body" else _safe_select(root, item))[:MAX_ITEMS]
    rows = []
    for box in boxes:
        first = {k: next(iter(_safe_select(box, s)), None) for k, s in fields.items()}
        rows.append({k: (n.attrs.get("href", "").strip() if k in ("pdf", "link") else n.text()) if n else "" for k, n in first.items()})
    titles = [r["title"] for r in rows if r["title"]]
    return {
        "item_selector": item, "n_items": len(rows),
        **{f"{k}_hits": sum(bool(r[k]) for r in rows) for k in fields},
        "distinct_titles": len(set(titles)), "title_chars": sum(map(len, titles)), "abstract_chars": sum(len(r["abstract"]) for r in rows),
    }


def listing_rows(pages: DataFrame, selectors: dict[str, str], container: str = "article.node-paper") -> DataFrame:
    """(page_id, pos, title, abstract, url): rows of every listing page (page_id, url, html)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = [
                (i, k, r["title"], r["abstract"], r["url"])
                for i, u, h in zip(x["page_id"], x["url"], x["html"])
                for k, r in enumerate(extract_items(h or "", u or "", selectors, container))
            ]
            yield pd.DataFrame(rows, columns=["page_id", "pos", "title", "abstract", "url"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInPandas(run, "page_id long, pos int, title string, abstract string, url string")


def detail_rows(pages: DataFrame, selectors: dict[str, str]) -> DataFrame:
    """(page_id, pdf_url, abstract) of every detail page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            found = [extract_detail(h or "", u or "", selectors) for u, h in zip(x["url"], x["html"])]
            yield pd.DataFrame({"page_id": x["page_id"], "pdf_url": [f["pdf_url"] for f in found], "abstract": [f["abstract"] for f in found]})

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInPandas(run, "page_id long, pdf_url string, abstract string")


def verified(pages: DataFrame, selector_json: str) -> DataFrame:
    """Counts of :func:`verify` for every page, from which rates and scores are plain arithmetic."""
    schema = (
        "page_id long, item_selector string, n_items int, title_hits int, abstract_hits int, pdf_hits int, authors_hits int, link_hits int, "
        "distinct_titles int, title_chars int, abstract_chars int"
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.strip().split(" ")[0] for c in schema.split(",")]
        for x in batches:
            rows = [{"page_id": i, **verify(h or "", selector_json)} for i, h in zip(x["page_id"], x["html"])]
            yield pd.DataFrame(rows, columns=names)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInPandas(run, schema)
