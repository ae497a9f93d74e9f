"""A small HTML reader for use inside Arrow tasks: text by blocks, main content, links, headings, menus."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin

VOID = set("area base br col embed hr img input link meta source track wbr".split())
#: Tags whose text is never shown, tags that begin and end a line, and page furniture by tag, role, class and id (fixed values).
HIDDEN = set("script style noscript svg iframe template canvas video audio object embed".split())
BLOCKS = set("p div li ul ol dl dt dd h1 h2 h3 h4 h5 h6 section article header footer nav aside main table thead tbody tr td th address blockquote form figure figcaption label option button pre hr br".split())
FURNITURE_TAGS = set("footer nav aside form button select".split())
FURNITURE_ROLES = set("navigation banner contentinfo search dialog".split())
FURNITURE_CLASSES = set("screen-reader-text sr-only skip-link site-header site-footer navbar navigation nav-menu main-menu menu mega-menu dropdown-menu mobile-menu offcanvas breadcrumb breadcrumbs sidebar widget-area social social-links share sharing modal popup".split())
FURNITURE_IDS = set("header footer nav navigation menu sidebar".split())
MAIN_IDS = ("main-content", "main", "content")
UNHELPFUL_ALT = re.compile(r"^(?:logo|image|img|photo|picture|banner|icon|slide|background|placeholder|untitled|\d+)$", re.I)
_SPACE = re.compile(r"[\s ]+")
#: An opening tag closes an open one of these without its end tag.
IMPLIED = {"a": {"a"}, "li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


class Node:
    __slots__ = ("tag", "attrs", "kids", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.kids, self.parent = tag, attrs, [], parent

    def walk(self):
        """This node and all below, in document order, without recursion."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(k for k in reversed(node.kids) if isinstance(k, Node))

    def classes(self) -> set[str]:
        return set(self.attrs.get("class", "").lower().split())


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {}, None)
        self.at = self.root

    def handle_starttag(self, tag, attrs):
        closes = IMPLIED.get(tag)
        if tag in BLOCKS and tag not in ("br", "option", "label", "button"):
            closes = (closes or set()) | {"p"}
        if closes and self.at.tag in closes:
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.kids.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag:
            self.at = self.at.parent

    def handle_endtag(self, tag):
        node = self.at
        while node is not self.root and node.tag != tag:
            node = node.parent
        if node is not self.root:
            self.at = node.parent

    def handle_data(self, data):
        self.at.kids.append(data)


def parse(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def flat(text: str) -> str:
    return _SPACE.sub(" ", text).strip()


def furniture(node: Node) -> bool:
    """Whether a node is page furniture; a header counts if it stands directly in the body or holds a menu."""
    if node.tag in FURNITURE_TAGS or node.attrs.get("role", "").lower() in FURNITURE_ROLES or node.attrs.get("aria-hidden", "").lower() == "true":
        return True
    names = node.classes()
    name = node.attrs.get("id", "").lower()
    if names & FURNITURE_CLASSES or name in FURNITURE_IDS or "cookie" in name or any("cookie" in c or "consent" in c for c in names):
        return True
    return node.tag == "header" and (node.parent is not None and node.parent.tag == "body" or any(k.tag == "nav" or "menu" in k.classes() for k in node.walk() if k is not node))


def lines(root: Node, without=lambda node: False) -> list[str]:
    """The node's text, one line for each block, hidden tags and unwanted nodes left out."""
    parts: list[str] = []
    stack: list = [root]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            parts.append(item)
            continue
        if item.tag in HIDDEN or item is not root and without(item):
            continue
        edge = ["\n"] if item.tag in BLOCKS else []
        stack.extend([*edge, *reversed(item.kids), *edge])
    return [x for x in map(flat, "".join(parts).replace("\r", " ").split("\n")) if x] if any(parts) else []


def text_of(node: Node) -> str:
    return flat(" ".join(lines(node)))


def main_root(root: Node) -> Node | None:
    """The element that holds the page's main content: the first of its kind with 200 characters or more."""
    tests = [lambda n: n.tag == "main", lambda n: n.attrs.get("role") == "main", *[lambda n, i=i: n.attrs.get("id") == i for i in MAIN_IDS], lambda n: "main-content" in n.classes(), lambda n: n.tag == "article"]
    for test in tests:
        first = next((n for n in root.walk() if test(n)), None)
        if first is not None and len(text_of(first)) >= 200:
            return first
    return None


def web_links(root: Node, page_url: str) -> Iterator[dict]:
    """The links of a page to addresses of the web, in document order, each address and text once."""
    seen = set()
    for node in root.walk():
        href = node.attrs.get("href", "").strip() if node.tag == "a" else ""
        if not href or href.startswith("#") or re.match(r"(?:mailto|tel|javascript):", href, re.I):
            continue
        try:
            full = urljoin(page_url, href)
        except ValueError:
            continue
        if not re.match(r"https?:", full, re.I):
            continue
        text = text_of(node) or flat(node.attrs.get("aria-label") or node.attrs.get("title") or "")
        if (full, text) not in seen:
            seen.add((full, text))
            yield {"href": full, "text": text}


def menu_groups(root: Node, page_url: str) -> list[dict]:
    """Lists of two links or more inside menus, with the labels above them, outermost first."""
    out, seen = [], set()
    for node in root.walk():
        if node.tag not in ("ul", "ol"):
            continue
        above, inside, trail = node.parent, False, []
        while above is not None:
            inside |= above.tag in ("nav", "header") or above.attrs.get("role") == "navigation" or bool(re.search("menu|nav|dropdown|mega", f"{above.attrs.get('class', '')} {above.attrs.get('id', '')}", re.I))
            if above.tag == "li":
                label = next((k for k in above.kids if isinstance(k, Node) and k.tag in ("a", "span", "button", "strong", "h2", "h3", "h4", "h5", "h6", "p", "div")), None)
                if label is not None:
                    trail.insert(0, flat(" ".join(lines(label, lambda n: n.tag in ("ul", "ol", "div"))))[:80])
            above = above.parent
        if not inside:
            continue
        links = []
        for item in (k for k in node.kids if isinstance(k, Node) and k.tag == "li"):
            found = next(web_links(item, page_url), None)
            if found:
                links.append({"href": urldefrag(found["href"]).url, "text": found["text"]})
        key = tuple(x["href"] for x in links)
        if len(links) >= 2 and key not in seen:
            seen.add(key)
            out.append({"trail": [t for t in trail if t], "links": links})
    return out


def read_page(html: str | None, page_url: str) -> dict:
    """All that the extractors need of a page."""
    root = parse(html)
    nodes = list(root.walk())
    body = next((n for n in nodes if n.tag == "body"), root)
    first = lambda tag: next((t for n in nodes if n.tag == tag and (t := text_of(n))), "")
    hrefs = [n.attrs["href"].strip() for n in nodes if n.tag == "a" and n.attrs.get("href")]
    unique = lambda xs: list(dict.fromkeys(x for x in xs if x))
    content_root = main_root(root)
    content = lines(content_root or body, furniture)
    if len("\n".join(content)) < 150:
        content = lines(body, lambda n: n.tag in ("nav", "footer") or n.attrs.get("role") == "navigation" or bool(n.classes() & {"menu", "navbar"}))
    area = [n for n in (content_root or body).walk() if not _inside_furniture(n, content_root or body)]
    heads = [{"level": n.tag, "text": text_of(n)} for n in area if n.tag in ("h1", "h2", "h3", "h4")]
    heads = [h for h in heads if h["text"]] or [{"level": n.tag, "text": t} for n in nodes if n.tag in ("h1", "h2", "h3", "h4") and (t := text_of(n))]
    alts = unique(flat(n.attrs.get("alt", "")) for n in area if n.tag == "img")
    full = lines(body)
    page = {
        "title": first("title") or first("h1") or "Untitled Page",
        "canonical_url": next((n.attrs.get("href") for n in nodes if n.tag == "link" and n.attrs.get("rel") == "canonical" and n.attrs.get("href")), page_url),
        "open_graph": {n.attrs["property"][3:]: n.attrs["content"].strip() for n in nodes if n.tag == "meta" and n.attrs.get("property", "").startswith("og:") and n.attrs.get("content")},
        "json_ld": [t for n in nodes if n.tag == "script" and n.attrs.get("type") == "application/ld+json" and (t := "".join(k for k in n.kids if isinstance(k, str)).strip())],
        "mailto": unique(h[7:].split("?")[0].strip() for h in hrefs if h[:7].lower() == "mailto:"),
        "tel": unique(h[4:].strip() for h in hrefs if h[:4].lower() == "tel:"),
        "links": list(web_links(root, page_url)),
        "menu_groups": menu_groups(root, page_url),
        "headings": heads,
        "image_alts": [a for a in alts if 4 <= len(a) <= 150 and not UNHELPFUL_ALT.match(a)],
        "full_text": "\n".join(full),
        "content_text": "\n".join(content),
    }
    for n in nodes:  # a tree of rings would stay in memory until the collector comes
        n.parent, n.kids = None, []
    return page


def _inside_furniture(node: Node, root: Node) -> bool:
    while node is not root and node is not None:
        if furniture(node):
            return True
        node = node.parent
    return False
