"""DOM rules: core, content, social, htmlval, geo, i18n, legal, redirect."""

from __future__ import annotations

import re
from collections import Counter

from pagelattice.functions.text import STOP_WORDS, flesch, pixel_width, syllables
from pagelattice.plans.rules.registry import dom
from pagelattice.sources.dom import Page, missing, split_url, tidy
from pagelattice.sources.select import have, matches

NOINDEX = re.compile(r"\bnoindex\b|\bnone\b")


def _bare(url: str | None) -> str | None:
    return url[:-1].lower() if url and url.endswith("/") else url.lower() if url else None


def _same(a: str | None, b: str | None) -> bool:
    return _bare(a) == _bare(b)


def header_canonical(p: Page) -> str | None:
    m = re.search(r"""<([^>]+)>;\s*rel=["']?canonical""", p.headers.get("link", ""))
    return m[1] if m else None


def noindex(p: Page) -> bool:
    return bool(NOINDEX.search(p.robots("robots", "googlebot")) or NOINDEX.search(p.headers.get("x-robots-tag", "").lower()))


def text_rule(rule_id: str, weight: int, value, low: int, high: int, empty: str):
    """Length within low..high passes, outside warns; an empty text has its own status."""

    @dom(rule_id, weight)
    def run(p: Page) -> str:
        v = value(p)
        return empty if not v else "P" if low <= len(v) <= high else "W"


# core
dom("core-title-present")(lambda p: "P" if p.title else "F")
text_rule("core-title-length", 1, lambda p: p.title, 30, 60, "F")
dom("core-description-present")(lambda p: "P" if p.description else "F")
text_rule("core-description-length", 1, lambda p: p.description, 120, 160, "W")
dom("core-canonical-present")(lambda p: "P" if p.canonical else "F")
dom("core-viewport-present")(lambda p: "P" if p.meta("viewport") else "F")
dom("core-h1-present")(lambda p: "P" if p.h1 else "F")
dom("core-h1-single")(lambda p: {0: "F", 1: "P"}.get(len(p.q("h1")), "W"))


@dom("core-canonical-valid")
def _(p):
    if p.canonical is None:
        return "W"
    return "P" if re.match(r"https?://[^/\s]", p.canonical, re.I) and split_url(p.canonical) else "F"


@dom("core-favicon-present")
def _(p):
    icons = [e for e in p.q("link") if e.get("rel") == "icon"] or [
        e for e in p.q("link") if e.get("rel") == "shortcut icon"
    ]
    return "P" if icons and (icons[0].get("href") or "").strip() else "F"


def _header_conflict(p: Page, bad: str) -> str:
    a, b = p.canonical, header_canonical(p)
    return bad if a and b and not _same(a, b) else "P"


dom("core-canonical-header", 7)(lambda p: _header_conflict(p, "W"))
dom("core-canonical-conflicting", 8)(lambda p: _header_conflict(p, "F"))


@dom("core-nosnippet", 7)
def _(p):
    for text in (p.robots("robots", "googlebot"), p.headers.get("x-robots-tag", "").lower()):
        m = re.search(r"max-snippet:\s*(-?\d+)", text)
        if "nosnippet" in text or (m and int(m[1]) <= 0):
            return "W"
    return "P"


@dom("core-robots-meta", 5)
def _(p):
    text = p.robots("robots", "googlebot", "bingbot") + " " + p.headers.get("x-robots-tag", "").lower()
    bad = {"noindex", "nofollow", "noarchive", "nosnippet", "noimageindex", "none"}
    return "W" if bad & set(re.split(r"[,\s]+", text)) else "P"


@dom("core-canonical-to-homepage", 6)
def _(p):
    to = split_url(p.canonical_url) if p.canonical_url else None
    if not to or p.at[2] in ("", "/"):
        return "P"
    return "F" if to[2].rstrip("/") == "" else "P"


@dom("core-canonical-http-mismatch", 7)
def _(p):
    to = split_url(p.canonical_url) if p.canonical_url else None
    return "F" if to and to[0] != p.at[0] else "P"


dom("core-canonical-loop", 7)(lambda p: "W" if p.canonical_url and not _same(p.canonical_url, p.url) else "P")


@dom("core-canonical-to-noindex", 7)
def _(p):
    return "W" if noindex(p) and p.canonical_url and not _same(p.canonical_url, p.url) else "P"


# content
@dom("content-word-count", 4)
def _(p):
    n = len(p.words)
    return "F" if n < 100 else "W" if n < 300 else "P"


@dom("content-reading-level", 3)
def _(p):
    if len(p.words) < 50:
        return "P"
    sentences = max(1, sum(bool(s.strip()) for s in re.split(r"[.!?]+", p.main_text)))
    return "P" if 50 <= flesch(len(p.words), sentences, sum(map(syllables, p.words))) <= 80 else "W"


@dom("content-keyword-stuffing", 5)
def _(p):
    n = len(p.words)
    if n < 100:
        return "P"
    counts = Counter(w for w in p.words if len(w) >= 3 and w not in STOP_WORDS)
    high = [c / n for c in counts.values() if c / n >= 0.02]
    if any(d >= 0.05 for d in high) or len(high) >= 3:
        return "F"
    return "W" if high else "P"


@dom("content-article-links", 4)
def _(p):
    n = len(p.words)
    return "P" if n < 100 or 0.5 <= len(p.links) * 100 / n <= 5 else "W"


@dom("content-broken-html", 4)
def _(p):
    ids = Counter(e.get("id") for e in p.all if e.get("id"))
    issues = sum(c > 1 for c in ids.values())
    block = {"div", "p", "ul", "ol", "table", "section", "article"}
    inline = {"a", "span", "strong", "em", "b", "i", "button", "label"}
    issues += sum(e.tag in block and e.parent is not None and e.parent.tag in inline and e.parent.tag != "a" for e in p.all)
    issues += sum(e.get("src") is None or e.get("alt") is None for e in p.q("img"))
    issues += sum(e.get("href") is None and e.get("name") is None and e.get("id") is None for e in p.q("a"))
    issues += sum(not t for _, t in p.headings)
    issues += sum(not e.text and e.get("aria-label") is None for e in p.q("button"))
    issues += len(p.q("font", "center", "marquee", "blink", "big", "strike", "tt", "frame", "frameset"))
    return "F" if issues >= 4 else "W" if issues else "P"


@dom("content-meta-in-body", 8)
def _(p):
    bad = any(not e.in_head and not e.inside("svg", "head") and e.get("itemprop") is None for e in p.q("meta", "title"))
    rels = any(not e.in_head and (e.get("rel") or "") in ("canonical", "icon", "shortcut icon") for e in p.q("link"))
    return "F" if bad or rels else "P"


@dom("content-heading-hierarchy")
def _(p):
    levels = [n for n, _ in p.headings]
    if not levels:
        return "F"
    return "W" if levels[0] != 1 or any(b > a + 1 for a, b in zip(levels, levels[1:])) else "P"


dom("content-heading-length")(
    lambda p: "W" if any(0 < len(t) < 10 or len(t) > 70 for _, t in p.headings) else "P"
)
dom("content-heading-unique")(
    lambda p: "W" if any(c > 1 for c in Counter(t.lower() for _, t in p.headings if t).values()) else "P"
)


@dom("content-text-html-ratio", 7)
def _(p):
    r = len(p.body_text) / len(p.html) if p.html else 0
    return "F" if r < 0.10 else "W" if r < 0.25 else "P"


dom("content-title-same-as-h1", 6)(lambda p: "W" if p.title and p.h1 and p.title.lower() == p.h1.lower() else "P")


@dom("content-title-pixel-width", 7)
def _(p):
    w = pixel_width(p.title)
    return "F" if w > 620 else "W" if w > 580 else "P"


@dom("content-description-pixel-width", 6)
def _(p):
    w = pixel_width(p.description or "")
    return "F" if w > 990 else "W" if w > 920 else "P"


def _author(p: Page) -> str:
    if any(not missing(x, ["author"]) for _, x in p.items) or p.meta("author"):
        return "P"
    for e in p.all:
        if "author" in (e.get("rel") or "").split() or e.get("itemprop") == "author":
            return "P"
        if re.search(r"\b(?:author|byline)\b", e.classes, re.I) and 0 < len(e.text) < 100:
            return "P"
    return "W"


def _dates(p: Page) -> str:
    if any(not missing(x, [f]) for _, x in p.items for f in ("datePublished", "dateModified")):
        return "P"
    if any(e.get("datetime") for e in p.q("time")) or "last-modified" in p.headers:
        return "P"
    if any((e.get("property") or "").startswith("article:") and "time" in (e.get("property") or "") for e in p.q("meta")):
        return "P"
    return "P" if any(re.search(r"\b(?:date|published|updated)\b", e.classes) and e.text for e in p.all) else "W"


dom("eeat-author-byline", 8)(_author)
dom("eeat-content-dates", 8)(_dates)
dom("content-author-info", 3, registered=False)(_author)
dom("content-freshness", 3, registered=False)(_dates)


# social
def _og(p: Page, name: str) -> str | None:
    return p.meta(name, "property")


for _name in ("title", "description"):
    dom(f"social-og-{_name}")(lambda p, n=f"og:{_name}": "P" if _og(p, n) else "F")


def _absolute(rule_id: str, name: str) -> None:
    @dom(rule_id)
    def run(p: Page) -> str:
        v = _og(p, name)
        return "F" if not v else "P" if re.match(r"https?://", v, re.I) and split_url(v) else "W"


_absolute("social-og-image", "og:image")
_absolute("social-og-url", "og:url")


@dom("social-og-image-size")
def _(p):
    if not _og(p, "og:image"):
        return "F"
    w, h = (re.fullmatch(r"\s*(\d+).*", _og(p, f"og:image:{x}") or "") for x in ("width", "height"))
    if not w or not h:
        return "W"
    w, h = int(w[1]), int(h[1])
    return "F" if w < 200 or h < 200 else "P" if w >= 1200 and h >= 630 else "W"


@dom("social-twitter-card")
def _(p):
    v = p.meta("twitter:card") or p.meta("twitter:card", "property")
    return "F" if not v else "P" if v in ("summary", "summary_large_image", "app", "player") else "W"


@dom("social-og-url-canonical")
def _(p):
    og, c = _og(p, "og:url"), p.canonical
    if not c:
        return "W"
    return "F" if not og else "P" if _same(p.resolve(og), p.canonical_url) else "F"


# Addresses of share buttons, by platform, and their marks in the markup.
SHARE = [
    ("Facebook", r"facebook\.com/share"),
    ("Facebook", r"facebook\.com/sharer"),
    ("Twitter/X", r"twitter\.com/intent/tweet"),
    ("Twitter/X", r"twitter\.com/share"),
    ("Twitter/X", r"x\.com/intent/tweet"),
    ("LinkedIn", r"linkedin\.com/share"),
    ("LinkedIn", r"linkedin\.com/shareArticle"),
    ("Pinterest", r"pinterest\.com/pin/create"),
    ("Reddit", r"reddit\.com/submit"),
    ("WhatsApp", r"wa\.me/"),
    ("WhatsApp", r"whatsapp\.com/send"),
    ("WhatsApp", r"api\.whatsapp\.com/send"),
    ("Telegram", r"t\.me/share"),
    ("Telegram", r"telegram\.me/share"),
    ("Email", r"mailto:\?.*subject="),
]
SHARE_MARKS = [
    '[class*="share"]', '[class*="social-share"]', '[class*="sharing"]', '[id*="share"]', ".addthis_toolbox", ".addtoany_share",
    ".sharethis-inline", '[class*="sharethis"]', '[class*="addtoany"]', '[aria-label*="share"]', '[aria-label*="Share"]',
    "[data-share]", "[data-social-share]",
]
SHARE_SCRIPTS = r"addthis|sharethis|addtoany|socialshare"
# Addresses of social profiles, by platform, and where they stand.
PROFILES = [
    ("Facebook", r"^https?://(www\.)?facebook\.com/(?!sharer|share)[\w.-]+/?$"),
    ("Twitter/X", r"^https?://(www\.)?(twitter|x)\.com/(?!intent|share)[\w]+/?$"),
    ("Instagram", r"^https?://(www\.)?instagram\.com/[\w.]+/?$"),
    ("LinkedIn", r"^https?://(www\.)?linkedin\.com/(company|in)/[\w-]+/?$"),
    ("YouTube", r"^https?://(www\.)?youtube\.com/(@[\w]+|channel/[\w-]+|c/[\w-]+|user/[\w-]+)/?$"),
    ("TikTok", r"^https?://(www\.)?tiktok\.com/@[\w.]+/?$"),
    ("Pinterest", r"^https?://(www\.)?pinterest\.com/[\w]+/?$"),
    ("GitHub", r"^https?://(www\.)?github\.com/[\w-]+/?$"),
    ("Threads", r"^https?://(www\.)?threads\.net/@[\w.]+/?$"),
    ("Bluesky", r"^https?://bsky\.app/profile/[\w.-]+/?$"),
    ("Mastodon", r"^https?://[\w.-]+/@[\w]+/?$"),
]
PROFILE_PLACES = ["header", "footer", "nav", '[class*="social"]', '[class*="follow"]', '[id*="social"]', '[aria-label*="social"]']

_SHARE = [(k, re.compile(v, re.I | re.A)) for k, v in SHARE]
_SHARE_SCRIPTS = re.compile(SHARE_SCRIPTS, re.I)
_PROFILES = [(k, re.compile(v, re.I | re.A)) for k, v in PROFILES]


@dom("social-share-buttons")
def _(p):
    if len({k for _, href, _, _ in p.anchors for k, r in _SHARE if r.search(href)}) >= 2 or have(p, SHARE_MARKS):
        return "P"
    return "P" if any(_SHARE_SCRIPTS.search(e.get("src") or "") for e in p.q("script")) else "W"


def _profile(address: str) -> str | None:
    """The platform of a profile's address; the first that fits."""
    return next((k for k, r in _PROFILES if r.search(address)), None)


@dom("social-profiles")
def _(p):
    found = set()
    for d in p.ld:
        for x in d if isinstance(d, list) else [d]:
            same = x.get("sameAs") if isinstance(x, dict) else None
            found |= {_profile(v) for v in (same if isinstance(same, list) else [same]) if isinstance(v, str)}
    platforms = [(e, k) for e, href, _, _ in p.anchors if (k := _profile(href))]
    if platforms:
        found |= {k for e, k in platforms if any(matches(n, s) for n in e.up() for s in PROFILE_PLACES)}
        found.discard(None)
        found = found or {k for _, k in platforms}
    return "P" if len(found - {None}) >= 3 else "W"


# htmlval
# Elements that have no place in head.
_NOT_IN_HEAD = set(
    "div span p section article img a table ul ol li form button input h2 h3 h4 h5 h6 main nav footer aside header".split()
)


@dom("htmlval-missing-charset", 15)
def _(p):
    for e in p.q("meta"):
        if e.get("charset") or ("content-type" == (e.get("http-equiv") or "").lower() and "charset" in (e.get("content") or "")):
            return "P"
    return "W" if "charset=" in p.headers.get("content-type", "").lower() else "F"


@dom("htmlval-invalid-head", 10)
def _(p):
    # Such an element ends the head, so it is looked for in the source before </head>.
    head = re.search(r"<head\b[^>]*>(.*?)</head\s*>", p.html, re.I | re.S)
    inner = re.sub(r"<(script|style|noscript|template|title)\b.*?</\1\s*>", "", head[1], flags=re.I | re.S) if head else ""
    return "W" if _NOT_IN_HEAD & {t.lower() for t in re.findall(r"<([a-zA-Z][\w-]*)", inner)} else "P"


@dom("htmlval-noscript-in-head", 5)
def _(p):
    return "W" if any(k.tag not in ("link", "style", "meta") for e in p.q("noscript") if e.in_head for k in e.kids) else "P"


dom("htmlval-multiple-heads", 10)(lambda p: "F" if len(p.q("head")) > 1 else "P")
dom("htmlval-lorem-ipsum", 5)(
    lambda p: "F" if re.search(r"lorem\s+ipsum|dolor\s+sit\s+amet|consectetur\s+adipiscing", p.body_text, re.I) else "P"
)
dom("htmlval-multiple-titles", 12)(lambda p: "F" if len(p.q("title")) > 1 else "P")
dom("htmlval-multiple-descriptions", 10)(
    lambda p: "F" if sum(e.get("name") == "description" for e in p.q("meta")) > 1 else "P"
)

# geo
_SEMANTIC = "article section nav aside main header footer figure figcaption time mark details summary".split()


@dom("geo-semantic-html", 25)
def _(p):
    n = sum(t in p.tags for t in _SEMANTIC)
    return "P" if n >= 5 else "W" if n >= 3 else "F"


@dom("geo-content-structure", 25)
def _(p):
    levels = [n for n, _ in p.headings]
    n = (
        p.have("main", "article")
        + (len(set(levels)) >= 2 and levels[0] <= 2)
        + (sum(len(e.text.split()) for e in p.q("p")) >= 30)
        + p.have("ul", "ol", "table", "dl")
    )
    return "P" if n >= 4 else "W" if n == 3 else "F"


@dom("geo-llms-txt", 15)
def _(p):
    refs = [e.get("href") or "" for e in p.q("link", "a")] + [e.get("content") or "" for e in p.q("meta")]
    return "P" if any("llms.txt" in r.lower() for r in refs) else "W"


@dom("geo-schema-drift", 15)
def _(p):
    visible = p.body_text.lower()

    def there(v) -> bool:
        v = tidy(v).lower() if isinstance(v, str) else ""
        if not v or v in visible or v[:40] in visible:
            return True
        long = [w for w in re.findall(r"\w+", v) if len(w) > 3]
        return bool(long) and sum(w in visible for w in long) >= 0.6 * len(long)

    worst = "P"
    for _, x in p.items:
        for f in ("name", "headline"):
            if not there(x.get(f) or ""):
                return "F"
        a = x.get("author")
        a = a.get("name") if isinstance(a, dict) else a
        if not there(x.get("description") or "") or not there(a or ""):
            worst = "W"
    return worst


# i18n
def _alternates(p: Page) -> list[tuple[str, str]]:
    return [
        ((e.get("hreflang") or "").strip().lower(), (e.get("href") or "").strip())
        for e in p.q("link")
        if "alternate" in (e.get("rel") or "") and e.get("hreflang") is not None
    ]


def _self(p: Page, href: str) -> bool:
    to, here = split_url(p.resolve(href) or ""), p.at
    return bool(to) and (to[0], to[1], to[2].rstrip("/")) == (here[0], here[1], here[2].rstrip("/"))


@dom("i18n-lang-attribute", 10)
def _(p):
    lang = p.all[0].get("lang")
    return "F" if not (lang or "").strip() else "P" if re.fullmatch(r"[a-zA-Z]{2,3}(-[a-zA-Z0-9]{2,8})*", lang.strip()) else "W"


@dom("i18n-hreflang", 10)
def _(p):
    a = _alternates(p)
    if not a:
        return "P"
    codes = [c for c, _ in a]
    if any(not c or not re.fullmatch(r"x-default|[a-z]{2,3}(-[a-z0-9]{2,8})*", c) for c in codes) or len(set(codes)) < len(codes):
        return "F"
    if any(not re.match(r"https?://", h, re.I) for _, h in a) or not any(_self(p, h) for _, h in a):
        return "W"
    return "W" if len(a) > 1 and "x-default" not in codes else "P"


dom("i18n-hreflang-return-links", 12)(
    lambda p: "P" if not (a := _alternates(p)) or any(_self(p, h) for _, h in a) else "W"
)
dom("i18n-hreflang-to-noindex", 10)(lambda p: "F" if _alternates(p) and noindex(p) else "P")


@dom("i18n-hreflang-to-non-canonical", 10)
def _(p):
    own = [h for _, h in _alternates(p) if _self(p, h)]
    c = split_url(p.canonical_url) if p.canonical_url else None
    if not own or not c:
        return "P"
    to = split_url(p.resolve(own[0]))
    return "P" if (to[0], to[1], to[2]) == (c[0], c[1], c[2]) else "W"


@dom("i18n-hreflang-to-broken", 10)
def _(p):
    for _, h in _alternates(p):
        to = split_url(p.resolve(h) or "") if h else None
        if not h or h.startswith("#") or h.lower().startswith("javascript:") or not to or to[0] not in ("http", "https"):
            return "F"
    return "P"


dom("i18n-hreflang-to-redirect", 8)(
    lambda p: "W" if p.at[0] == "https" and any(h.lower().startswith("http://") for _, h in _alternates(p)) else "P"
)


@dom("i18n-hreflang-conflicting", 10)
def _(p):
    urls: dict[str, set] = {}
    for c, h in _alternates(p):
        urls.setdefault(c, set()).add(h)
    return "F" if any(len(u) > 1 for u in urls.values()) else "P"


@dom("i18n-hreflang-lang-mismatch", 8)
def _(p):
    own = [c for c, h in _alternates(p) if _self(p, h) and c != "x-default"]
    lang = (p.all[0].get("lang") or "").lower().split("-")[0]
    return "W" if own and lang and own[0].split("-")[0] != lang else "P"


dom("i18n-hreflang-multiple-methods", 6)(
    lambda p: "W" if _alternates(p) and "hreflang" in p.headers.get("link", "").lower() else "P"
)

# redirect
_JS_MOVE = re.compile(r"window\.location\s*[=.]|location\.href\s*=|location\.(?:replace|assign)\s*\(|document\.location\s*[=.]")


@dom("redirect-meta-refresh", 15)
def _(p):
    for e in p.q("meta"):
        if (e.get("http-equiv") or "").lower() == "refresh":
            m = re.match(r"\s*(\d+)", e.get("content") or "")
            return "W" if m and int(m[1]) > 0 else "F"
    return "P"


dom("redirect-javascript", 12)(lambda p: "W" if any(_JS_MOVE.search(e.raw) for e in p.inline_js) else "P")


@dom("redirect-resource", 10)
def _(p):
    if p.at[0] != "https":
        return "P"
    refs = [e.get("src") or "" for e in p.q("script", "img")] + [e.get("href") or "" for e in p.links_rel("stylesheet")]
    return "W" if any(r.lower().startswith("http://") for r in refs) else "P"


@dom("redirect-case-normalization", 8)
def _(p):
    c = p.canonical_url
    return "W" if c and c != p.url and c.lower() == p.url.lower() else "P"


@dom("url-http-https-duplicate", 4)
def _(p):
    c = split_url(p.canonical) if p.canonical and re.match(r"https?:", p.canonical, re.I) else None
    return "W" if c and c[0] != p.at[0] else "P"


# legal
_CONSENT = re.compile(
    r"cookie[-_]?(?:consent|banner|notice|modal|popup|bar)|(?:gdpr|consent|privacy|cc)[-_]?(?:consent|banner|notice|modal|popup|window)"
    r"|cookieyes|onetrust|cookiebot|termly|quantcast|trustarc|cookiepro|iubenda|osano|civic-cookie|cookie-law|cookies-eu|eucookie",
    re.I,
)
_CONSENT_BUTTON = re.compile(r"(?:accept|agree|reject|decline|manage|customize).*cookie|accept.*all|cookie.*(?:accept|agree|settings)|preferences", re.I)
_TRACKING = re.compile(r"google-analytics|googletagmanager|gtag\(|fbq\(|connect\.facebook|hotjar|segment\.com|mixpanel", re.I)


@dom("legal-cookie-consent", 15)
def _(p):
    scripts = " ".join((e.get("src") or "") + e.raw for e in p.q("script"))
    if _CONSENT.search(scripts) or any(_CONSENT.search(e.classes) or _CONSENT.search(e.get("id") or "") for e in p.all):
        return "P"
    if any(_CONSENT_BUTTON.search(e.text) for e in p.q("button", "a")):
        return "P"
    return "W" if _TRACKING.search(scripts) else "P"


@dom("redirect-loop", 15)
def _(p):
    urls = [u.lower() for u, _ in p.redirects]
    return "F" if len(set(urls)) < len(urls) else "P"


dom("redirect-broken", 15)(lambda p: "F" if p.redirects and (p.status or 0) >= 400 else "P")


@dom("url-repetitive-path", 4)
def _(p):
    parts = [s.lower() for s in p.at[2].split("/") if s]
    return "F" if any(a == b for a, b in zip(parts, parts[1:])) else "P"
