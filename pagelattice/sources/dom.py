"""A page's element tree from html, with the standard library only.

One regular-expression scan builds the tree. Implied end tags of p, li, dt,
dd, tr, td, th, option and thead/tbody are applied; html, head and body are
synthesised; script, style, textarea and title hold raw text. The adoption
agency of full html parsing is left out: misnested inline tags nest as written.
"""

from __future__ import annotations

import html as _html
import re
from functools import cached_property, lru_cache
from urllib.parse import urljoin, urlsplit

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+)>""",
    re.S,
)
_ATTR = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
# Fixed values of the html standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "textarea", "title"))
HEAD_ONLY = frozenset("title meta link base style script noscript template".split())
_CLOSES = {
    "li": ("li", ("ul", "ol", "menu")),
    "dt": ("dt dd", ("dl",)),
    "dd": ("dt dd", ("dl",)),
    "tr": ("tr td th", ("table",)),
    "td": ("td th", ("tr", "table")),
    "th": ("td th", ("tr", "table")),
    "option": ("option", ("select", "datalist")),
    "tbody": ("thead tbody tr td th", ("table",)),
    "thead": ("thead tbody tr td th", ("table",)),
}
_CLOSE_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr"
    " main menu nav ol p pre section table ul".split()
)
#: White space as the web counts it.
SPACE = re.compile(r"[\s ﻿]+")


def tidy(text: str) -> str:
    """White space collapsed and trimmed."""
    return SPACE.sub(" ", text).strip()


@lru_cache(50_000)
def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(raw):
        value = a or b or c
        out.setdefault(name.lower(), _html.unescape(value) if "&" in value else value)
    return out


@lru_cache(50_000)
def split_url(url: str):
    """(scheme, host, path, query, fragment) lower-cased where case does not matter; None if it is no absolute URL."""
    try:
        u = urlsplit(url.strip())
        host = (u.hostname or "") + (f":{u.port}" if u.port and u.port not in (80, 443) else "")
    except ValueError:
        return None
    if not u.scheme or (u.scheme in ("http", "https") and not host):
        return None
    return u.scheme.lower(), host, u.path or "/", u.query, u.fragment


class El:
    __slots__ = ("page", "tag", "attrs", "parent", "kids", "depth", "start", "end", "in_head")

    def __init__(self, page: Page, tag: str, attrs: dict, parent: El | None, in_head: bool):
        self.page, self.tag, self.attrs, self.parent, self.in_head = page, tag, attrs, parent, in_head
        self.kids: list[El] = []
        self.depth = parent.depth + 1 if parent else 0
        self.start = self.end = len(page.pieces)

    def get(self, name: str, default: str | None = None) -> str | None:
        return self.attrs.get(name, default)

    @property
    def raw(self) -> str:
        return "".join(self.page.pieces[self.start : self.end])

    @property
    def text(self) -> str:
        return tidy(self.raw)

    @property
    def classes(self) -> str:
        return self.attrs.get("class", "")

    def up(self):
        node = self.parent
        while node:
            yield node
            node = node.parent

    def inside(self, *tags: str) -> bool:
        return any(n.tag in tags for n in self.up())

    def below(self):
        for kid in self.kids:
            yield kid
            yield from kid.below()


class Page:
    """The tree of one page and what many rules ask of it."""

    def __init__(
        self,
        url: str,
        html: str | None,
        headers: dict[str, str] | None = None,
        status: int | None = None,
        rendered: str | None = None,
        redirects: list[tuple[str, int]] | None = None,
    ):
        self.url = url or ""
        self.headers = headers or {}
        self.status = status
        self.rendered = Page(url, rendered) if rendered is not None else None
        self.redirects = redirects or []
        self.html = html or ""
        self.pieces: list[str] = []
        self.all: list[El] = []
        self.tags: dict[str, list[El]] = {}
        self._values: dict[str, set[str]] | None = None
        self._build()

    def _add(self, tag: str, attrs: dict, parent: El | None, in_head: bool) -> El:
        el = El(self, tag, attrs, parent, in_head)
        if parent:
            parent.kids.append(el)
        self.all.append(el)
        self.tags.setdefault(tag, []).append(el)
        return el

    def _build(self) -> None:
        text = self.html
        root = self._add("html", {}, None, False)
        self.head = self._add("head", {}, root, True)
        self.body: El | None = None
        stack = [root, self.head]
        pieces = self.pieces

        def close(n: int) -> None:
            while len(stack) > n:
                stack.pop().end = len(pieces)

        def body() -> El:
            if self.body is None:
                close(1)
                self.body = self._add("body", {}, root, False)
                stack.append(self.body)
            return self.body

        at, size = 0, len(text)
        while at < size:
            m = _TOKEN.search(text, at)
            if m is None:
                break
            if m.start() > at:
                piece = text[at : m.start()]
                if self.body is None and piece.strip():
                    body()
                pieces.append(_html.unescape(piece) if "&" in piece else piece)
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                if tag in ("html", "body"):
                    continue
                if tag == "head":
                    if self.body is None:
                        close(1)
                    continue
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        close(i)
                        break
                continue
            attrs = attributes(m[3])
            if tag in ("html", "head", "body"):
                target = root if tag == "html" else self.head if tag == "head" else body()
                target.attrs = {**attrs, **target.attrs}
                continue
            in_head = self.body is None and tag in HEAD_ONLY
            if not in_head:
                body()
                if tag in _CLOSE_P and stack[-1].tag == "p":
                    close(len(stack) - 1)
                elif tag in _CLOSES:
                    names, fence = _CLOSES[tag]
                    listed = names.split()
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i].tag in fence:
                            break
                        if stack[i].tag in listed:
                            close(i)
            parent = (self.head if len(stack) < 2 else stack[-1]) if in_head else stack[-1]
            el = self._add(tag, attrs, parent, in_head)
            if tag in RAW:
                end = re.compile(rf"</{tag}\s*>", re.I).search(text, at)
                raw = text[at : end.start() if end else size]
                pieces.append(_html.unescape(raw) if tag in ("title", "textarea") else raw)
                el.end = len(pieces)
                at = end.end() if end else size
            elif tag not in VOID and not m[3].endswith("/"):
                stack.append(el)
        if at < size:
            body()
            pieces.append(_html.unescape(text[at:]))
        body()
        close(0)

    # --- lookups

    def q(self, *tags: str) -> list[El]:
        if len(tags) == 1:
            return self.tags.get(tags[0], [])
        wanted = set(tags)
        return [e for e in self.all if e.tag in wanted]

    def have(self, *tags: str) -> bool:
        return any(t in self.tags for t in tags)

    def meta(self, name: str, by: str = "name") -> str | None:
        """Content of the first such meta element, trimmed; None without one."""
        for e in self.q("meta"):
            if e.get(by) == name:
                return (e.get("content") or "").strip()
        return None

    def links_rel(self, rel: str) -> list[El]:
        return [e for e in self.q("link") if rel in (e.get("rel") or "").lower().split()]

    @cached_property
    def at(self):
        return split_url(self.url) or ("", "", "/", "", "")

    def resolve(self, href: str) -> str | None:
        try:
            got = urljoin(self.url, href.strip())
        except ValueError:
            return None
        return got if split_url(got) else None

    @cached_property
    def title(self) -> str:
        t = self.q("title")
        return t[0].text if t else ""

    @cached_property
    def description(self) -> str | None:
        return self.meta("description")

    @cached_property
    def h1(self) -> str | None:
        h = self.q("h1")
        return h[0].text if h else None

    @cached_property
    def headings(self) -> list[tuple[int, str]]:
        return [(int(e.tag[1]), e.text) for e in self.q("h1", "h2", "h3", "h4", "h5", "h6")]

    @cached_property
    def canonical(self) -> str | None:
        for e in self.q("link"):
            if e.get("rel") == "canonical":
                return (e.get("href") or "").strip()
        return None

    @cached_property
    def canonical_url(self) -> str | None:
        return self.resolve(self.canonical) if self.canonical else None

    @cached_property
    def body_text(self) -> str:
        return tidy(self.body.raw)

    @cached_property
    def low_text(self) -> str:
        return self.body_text.lower()

    @cached_property
    def anchors(self) -> list[tuple[El, str, str, str]]:
        """(element, href as written, href in lower case, text) of every anchor with an href."""
        return [(e, h, h.lower(), e.text) for e in self.q("a") if (h := e.get("href")) is not None]

    @cached_property
    def class_names(self) -> set[str]:
        return {name for v in self.values("class") for name in v.split()}

    def values(self, attr: str) -> set[str]:
        """The values of an attribute anywhere on the page."""
        if self._values is None:
            self._values = {}
            for e in self.all:
                for k, v in e.attrs.items():
                    self._values.setdefault(k, set()).add(v)
        return self._values.get(attr, set())

    @cached_property
    def ld_texts(self) -> list[str]:
        """The JSON-LD scripts as written."""
        return [e.raw for e in self.q("script") if e.get("type") == "application/ld+json"]

    @cached_property
    def main_text(self) -> str:
        """Body text without scripts, navigation, header, footer, asides and hidden parts."""
        skip = []
        drop = {"script", "style", "noscript", "nav", "footer", "header", "aside"}
        roles = {"navigation", "banner", "contentinfo", "complementary"}
        marks = {"nav", "navigation", "footer", "header", "sidebar", "menu"}
        for e in self.all:
            if e.in_head or not (e.start < e.end):
                continue
            a = e.attrs
            if (
                e.tag in drop
                or a.get("role") in roles
                or a.get("aria-hidden") == "true"
                or ("class" in a and marks & set(a["class"].split()))
            ):
                skip.append((e.start, e.end))
        out, i = [], self.body.start
        for s, t in sorted(skip):
            if s >= i:
                out += self.pieces[i:s]
            i = max(i, t)
        out += self.pieces[i : self.body.end]
        return tidy("".join(out))

    @cached_property
    def words(self) -> list[str]:
        return re.sub(r"[^a-z0-9_\s]", " ", self.main_text.lower()).split()

    @cached_property
    def links(self) -> list[dict]:
        """Followable links: resolved href, text, internal, nofollow."""
        out = []
        for e in self.q("a"):
            href = e.get("href")
            if href is None:
                continue
            href = href.strip()
            low = href.lower()
            if href in ("", "#") or low.startswith(("javascript:", "mailto:", "tel:", "data:")):
                continue
            full = self.resolve(href)
            if not full:
                continue
            out.append(
                {
                    "el": e,
                    "raw": href,
                    "href": full,
                    "text": (e.text or (e.get("title") or "").strip())[:200],
                    "internal": split_url(full)[1] == self.at[1],
                    "nofollow": "nofollow" in (e.get("rel") or ""),
                }
            )
        return out

    @cached_property
    def invalid_links(self) -> list[tuple[str, str]]:
        out = []
        for e in self.q("a"):
            href = e.get("href")
            if href is None:
                continue
            low = href.strip().lower()
            if low in ("", "#"):
                out.append((href, "empty"))
            elif low.startswith("javascript:"):
                out.append((href, "javascript"))
            elif not low.startswith(("mailto:", "tel:", "data:")) and not self.resolve(href):
                out.append((href, "malformed"))
        return out

    @cached_property
    def special_links(self) -> list[tuple[str, str, bool]]:
        out = []
        for e in self.q("a"):
            href = (e.get("href") or "").strip()
            low = href.lower()
            if low.startswith("tel:"):
                value = re.sub(r"[\s\-().+]", "", href[4:])
                out.append(("tel", href, bool(re.fullmatch(r"\d{7,15}", value))))
            elif low.startswith("mailto:"):
                value = href[7:].partition("?")[0]
                out.append(("mailto", href, bool(re.fullmatch(r"[^\s@]+@[^\s@]+\.[^\s@]+", value))))
        return out

    @cached_property
    def images(self) -> list[dict]:
        out = []
        for e in self.q("img"):
            src = e.get("src") or e.get("data-src") or ""
            if not src or src.startswith("data:"):
                continue
            out.append(
                {
                    "el": e,
                    "src": self.resolve(src) or src,
                    "alt": e.get("alt"),
                    "width": e.get("width"),
                    "height": e.get("height"),
                    "lazy": e.get("loading") == "lazy" or e.get("data-src") is not None,
                }
            )
        return out

    @cached_property
    def label_for(self) -> set:
        return {e.get("for") for e in self.q("label")}

    @cached_property
    def css(self) -> str:
        return "\n".join(e.raw for e in self.q("style"))

    @cached_property
    def inline_js(self) -> list[El]:
        kinds = (None, "", "text/javascript", "application/javascript", "module")
        return [e for e in self.q("script") if e.get("src") is None and e.get("type") in kinds]

    @cached_property
    def ld(self) -> list:
        """Parsed JSON-LD documents; None for one that does not parse."""
        import json

        out = []
        for e in self.q("script"):
            if e.get("type") == "application/ld+json":
                try:
                    out.append(json.loads(e.raw))
                except (ValueError, RecursionError):
                    out.append(None)
        return out

    @cached_property
    def items(self) -> list[tuple[str, dict]]:
        """(type, object) of every typed object at any depth of the JSON-LD."""
        out: list[tuple[str, dict]] = []

        def visit(x, deep: int = 0) -> None:
            if deep > 40:
                return
            if isinstance(x, list):
                for y in x:
                    visit(y, deep + 1)
            elif isinstance(x, dict):
                kind = x.get("@type")
                for k in kind if isinstance(kind, list) else [kind]:
                    if isinstance(k, str):
                        out.append((k, x))
                for k, y in x.items():
                    if k != "@type" and isinstance(y, (dict, list)):
                        visit(y, deep + 1)

        visit([d for d in self.ld if d is not None])
        return out

    @cached_property
    def top_items(self) -> list[tuple[str, dict]]:
        """(type, object) of the objects at the top and in @graph only."""
        out = []
        for d in self.ld:
            for x in d if isinstance(d, list) else [d]:
                if isinstance(x, dict):
                    graph = x.get("@graph")
                    for y in [x, *(graph if isinstance(graph, list) else [])]:
                        if isinstance(y, dict):
                            kind = y.get("@type")
                            out += [(k, y) for k in (kind if isinstance(kind, list) else [kind]) if isinstance(k, str)]
        return out

    def robots(self, *names: str) -> str:
        """Contents of the robots metas of these names, lower-cased."""
        return " , ".join(
            (e.get("content") or "").lower() for e in self.q("meta") if (e.get("name") or "").lower() in names
        )


def missing(obj: dict, fields) -> list[str]:
    """Fields absent, null, blank or empty."""
    return [f for f in fields if obj.get(f) is None or obj.get(f) == [] or (isinstance(obj[f], str) and not obj[f].strip())]
