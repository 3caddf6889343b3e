"""DOM rules: performance, mobile, security, JavaScript rendering, technical, crawl paging."""

from __future__ import annotations

import re

from pagelattice.functions.wording import Wording
from pagelattice.plans.rules.head_content import noindex
from pagelattice.plans.rules.registry import dom
from pagelattice.sources.dom import Page, split_url


def _bytes(text: str) -> int:
    return len(text.encode("utf-8", "replace"))


@dom("perf-dom-size", 15)
def _(p):
    below = list(p.body.below())
    depth = max((e.depth for e in below), default=0)
    kids = max((len(e.kids) for e in [p.body, *below]), default=0)
    if len(below) > 1500 or depth > 48:
        return "F"
    return "W" if len(below) > 800 or depth > 32 or kids > 60 else "P"


@dom("perf-css-file-size", 10)
def _(p):
    n, kb = len(p.links_rel("stylesheet")), round(len(p.css) / 1024)
    return "F" if n > 6 or kb > 100 else "W" if n > 3 or kb > 50 else "P"


@dom("perf-font-loading", 15)
def _(p):
    google = [e.get("href") or "" for e in p.q("link") if "fonts.googleapis.com" in (e.get("href") or "")]
    faces = re.findall(r"@font-face\s*\{([^}]*)\}", p.css, re.I)
    preload = [e for e in p.links_rel("preload") if e.get("as") == "font"]
    if not google and not faces and not preload:
        return "P"
    swap = any("display=swap" in h for h in google)
    shown = any("font-display" in f for f in faces)
    if not swap and not shown and not preload:
        return "F"
    bad = any("display=swap" not in h for h in google) or any("font-display" not in f for f in faces)
    return "W" if bad or not preload or len(faces) + len(preload) > 6 else "P"


# Origins worth connecting to early.
_EARLY = set(
    "fonts.googleapis.com fonts.gstatic.com www.google-analytics.com www.googletagmanager.com connect.facebook.net"
    " platform.twitter.com cdn.jsdelivr.net cdnjs.cloudflare.com unpkg.com ajax.googleapis.com".split()
)


@dom("perf-preconnect", 15)
def _(p):
    refs = [e.get("src") for e in p.q("script", "img", "iframe")] + [e.get("href") for e in p.links_rel("stylesheet")]
    hosts = {u[1] for r in refs if r and (u := split_url(p.resolve(r) or ""))} - {p.at[1]}
    hinted = {
        u[1]
        for e in p.q("link")
        if (e.get("rel") or "") in ("preconnect", "dns-prefetch") and (u := split_url(p.resolve(e.get("href") or "") or ""))
    }
    return "W" if (hosts & _EARLY) - hinted else "P"


@dom("perf-render-blocking", 20)
def _(p):
    n = sum(
        e.in_head and e.get("src") is not None and e.get("async") is None and e.get("defer") is None and e.get("type") != "module"
        for e in p.q("script")
    )
    big = any(e.in_head and len(e.raw) > 10240 for e in p.inline_js)
    sheets = sum(e.in_head for e in p.links_rel("stylesheet"))
    return "F" if n > 2 else "W" if n or big or sheets > 5 else "P"


@dom("perf-lazy-above-fold", 15)
def _(p):
    first = p.images[:3]
    if first and first[0]["lazy"]:
        return "F"
    return "W" if any(i["lazy"] for i in first) else "P"


@dom("perf-lcp-hints", 10)
def _(p):
    found = None
    for i in p.images:
        near = " ".join([i["el"].classes, *(x.classes for x in list(i["el"].up())[:3])])
        if re.search(r"hero|banner|featured|cover", near, re.I):
            found = i
            break
    if found is None:
        found = next((i for i in p.images if int(re.match(r"\d*", i["width"] or "")[0] or 0) >= 400), None)
    if found is None:
        return "P"
    if found["lazy"]:
        return "F"
    pre = any(e.get("as") == "image" and p.resolve(e.get("href") or "") == found["src"] for e in p.links_rel("preload"))
    return "P" if pre and found["el"].get("fetchpriority") == "high" else "W"


def _slack(text: str) -> float:
    spare = sum(len(m) - 1 for m in re.findall(r" {2,}", text))
    return (text.count("\n") + spare + text.count("\t")) / max(1, len(text))


dom("perf-minify-css", 5)(lambda p: "W" if _bytes(p.css) > 500 and _slack(p.css) > 0.15 else "P")


@dom("perf-minify-js", 5)
def _(p):
    js = "\n".join(e.raw for e in p.inline_js)
    return "W" if _bytes(js) > 500 and (_slack(js) > 0.15 or re.search(r"/\*.*?\*/", js, re.S)) else "P"


@dom("perf-js-file-size", 5)
def _(p):
    n = sum(_bytes(e.raw) for e in p.inline_js)
    return "F" if n > 150 * 1024 else "W" if n > 50 * 1024 else "P"


@dom("perf-video-for-animations", 4)
def _(p):
    gif = any(re.search(r"\.gif(?:$|[?#])", i["src"], re.I) for i in p.images)
    gif = gif or any(e.get("type") == "image/gif" for e in p.q("source"))
    return "W" if gif or any(re.search(r"url\([^)]*\.gif", e.get("style") or "", re.I) for e in p.all) else "P"


# mobile
def _px(value: str, unit: str) -> float:
    return float(value) * {"px": 1, "em": 16, "rem": 16, "pt": 1.333, "%": 0.16}[unit]


_SIZE = re.compile(r"font-size\s*:\s*([\d.]*\d)\s*(px|rem|em|pt|%)([^;}]*)", re.I)


@dom("mobile-font-size", 15)
def _(p):
    sizes = [(_px(m[1], m[2].lower()), m[3]) for s in [p.css, *(e.get("style") or "" for e in p.all)] for m in _SIZE.finditer(s)]
    if any(n < 12 or (n < 16 and "!important" in rest) for n, rest in sizes):
        return "F"
    tight = re.search(r"line-height\s*:\s*(?:0?\.\d+|1(?:\.[01]\d*)?)\s*[;}]", p.css)
    return "W" if any(n < 16 for n, _ in sizes) or tight else "P"


@dom("mobile-horizontal-scroll", 15)
def _(p):
    wide = media = 0
    for e in p.all:
        style = e.get("style") or ""
        m = re.search(r"(?<![-\w])(?:min-)?width\s*:\s*(\d+)px", style)
        w = int(m[1]) if m else int(re.fullmatch(r"(\d*).*", e.get("width") or "", re.S)[1] or 0) if e.tag in ("img", "iframe", "table", "video") else 0
        if w > 400 and "max-width" not in style:
            wide += 1
            media += e.tag in ("img", "iframe")
        wide += "100vw" in style or (e.tag == "pre" and max(map(len, e.raw.split("\n")), default=0) > 100)
    wide += "100vw" in p.css
    return "F" if wide >= 5 or media >= 3 else "W" if wide else "P"


@dom("mobile-interstitials", 10)
def _(p):
    js = " ".join(e.raw for e in p.inline_js)
    if re.search(r"exit[-_]?intent|mouseleave.{0,80}(?:popup|modal)|(?:onload|load['\"]).{0,120}(?:popup|modal)", js, re.I | re.S):
        return "F"
    seen = "P"
    for e in p.all:
        mark = e.classes + " " + (e.get("id") or "")
        if re.search(r"popup|modal|overlay|interstitial|lightbox|newsletter-popup", mark, re.I):
            style = (e.get("style") or "").replace(" ", "")
            if "position:fixed" in style and ("width:100%" in style or "100vw" in style):
                return "F"
            seen = "W"
    return seen


dom("mobile-viewport-width", 10)(lambda p: "F" if re.search(r"width\s*=\s*\d+", p.meta("viewport") or "") else "P")
dom("mobile-multiple-viewports", 8)(lambda p: "F" if sum(e.get("name") == "viewport" for e in p.q("meta")) > 1 else "P")


# security
@dom("security-external-links", 3)
def _(p):
    for l in p.links:
        rel = l["el"].get("rel") or ""
        if l["el"].get("target") == "_blank" and not l["internal"] and "noopener" not in rel and "noreferrer" not in rel:
            return "W"
    return "P"


@dom("security-form-https", 5)
def _(p):
    plain = [e for e in p.q("form") if (e.get("action") or "").lower().startswith("http://")]
    return "F" if any((e.get("method") or "").lower() == "post" for e in plain) else "W" if plain else "P"


@dom("security-mixed-content", 8)
def _(p):
    if p.at[0] != "https":
        return "P"

    def plain(tags, key):
        return any((e.get(key) or "").lower().startswith("http://") for e in p.q(*tags))

    if plain(("script", "iframe", "embed"), "src") or plain(("object",), "data"):
        return "F"
    if any((e.get("href") or "").lower().startswith("http://") for e in p.links_rel("stylesheet")):
        return "F"
    return "W" if plain(("img", "video", "audio", "source"), "src") else "P"


# The policies that browsers know.
_POLICIES = set(
    "no-referrer no-referrer-when-downgrade origin origin-when-cross-origin same-origin strict-origin"
    " strict-origin-when-cross-origin unsafe-url".split()
)


@dom("security-referrer-policy", 2)
def _(p):
    v = p.headers.get("referrer-policy") or p.meta("referrer") or ""
    last = v.lower().split(",")[-1].strip()
    return "P" if last in _POLICIES and last != "unsafe-url" else "W"


# Patterns by the tokens' public formats.
_SECRETS = Wording(
    [
        r"\bAKIA[0-9A-Z]{16}\b",
        r"\bgh[pousr]_[A-Za-z0-9]{36,}\b",
        r"\bsk_live_[A-Za-z0-9]{16,}",
        r"\bxox[baprs]-[A-Za-z0-9-]{10,}",
        r"\bAIza[0-9A-Za-z_-]{35}\b",
        r"-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----",
        r"\b(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis)://[^\s:/@]+:[^\s@]+@",
    ],
    re.A,
)
dom("security-leaked-secrets", 10)(lambda p: "F" if _SECRETS.any(p.html) else "P")
dom("security-password-http", 10)(
    lambda p: "F" if p.at[0] == "http" and any((e.get("type") or "").lower() == "password" for e in p.q("input")) else "P"
)


@dom("security-protocol-relative", 6)
def _(p):
    for e in p.q("link", "script", "img", "source", "video", "audio", "iframe", "embed", "object"):
        for v in (e.get("src"), e.get("href") if e.tag == "link" else None, e.get("data"), *(e.get("srcset") or "").split(",")):
            if v and v.strip().startswith("//"):
                return "W"
    return "P"


# JavaScript rendering; `rendered` is the page after scripts ran, None if it was not captured
def _rendered(rule_id: str, weight: int, test) -> None:
    dom(rule_id, weight)(lambda p: "P" if p.rendered is None or test(p.rendered) else "F")


_rendered("js-rendered-title", 10, lambda r: r.title)
_rendered("js-rendered-description", 8, lambda r: r.description)
_rendered("js-rendered-h1", 8, lambda r: r.h1)
_rendered("js-rendered-canonical", 8, lambda r: r.canonical)


def _modified(rule_id: str, weight: int, value, bad: str) -> None:
    dom(rule_id, weight)(lambda p: bad if p.rendered is not None and value(p) != value(p.rendered) else "P")


_modified("js-title-modified", 8, lambda p: p.title, "W")
_modified("js-description-modified", 7, lambda p: p.description, "W")
_modified("js-h1-modified", 7, lambda p: p.h1, "W")
_modified("js-noindex-mismatch", 10, lambda p: "noindex" in p.robots("robots"), "F")


@dom("js-canonical-mismatch", 10)
def _(p):
    r = p.rendered
    return "F" if r is not None and p.canonical and r.canonical and p.canonical != r.canonical else "P"


@dom("js-rendered-content", 8)
def _(p):
    if p.rendered is None:
        return "P"
    a, b = len(p.body_text), len(p.rendered.body_text)
    return "F" if a < 100 and b > 500 else "W" if b > 3 * a else "P"


@dom("js-rendered-links", 7)
def _(p):
    if p.rendered is None:
        return "P"
    a, b = len(p.q("a")), len(p.rendered.q("a"))
    return "W" if b > 2 * a and b - a > 10 else "P"


@dom("js-ssr-check", 10)
def _(p):
    n = len(p.body_text)
    roots = [e for e in p.all if e.get("id") in ("root", "app", "__next", "__nuxt", "__svelte")]
    empty = any(not e.text for e in roots)
    if n < 200 and empty:
        return "F"
    asks = re.search(
        r"enable\s+javascript|javascript\s+(?:is\s+required|must\s+be\s+enabled)|requires\s+javascript",
        " ".join(e.raw for e in p.q("noscript")),
        re.I,
    )
    return "W" if n < 500 and (empty or asks) else "P"


# technical
@dom("technical-soft-404", 10)
def _(p):
    if p.status != 200:
        return "P"
    title, h1, body = p.title.lower(), (p.h1 or "").lower(), p.body_text.lower()
    if any(t in title for t in ("404", "not found", "page not found", "error")):
        return "F"
    if any(t in h1 for t in ("404", "not found", "page not found")):
        return "F"
    gone = (
        "not found", "doesn't exist", "does not exist", "no longer available", "page removed", "page has been removed",
        "page has been deleted", "could not be found", "cannot be found",
    )
    return "F" if len(body.split()) < 100 and any(t in body for t in gone) else "P"


@dom("technical-trailing-slash")
def _(p):
    styles = set()
    for l in p.links:
        path = split_url(l["href"])[2]
        if l["internal"] and path != "/" and not re.search(r"\.\w+$", path):
            styles.add(path.endswith("/"))
    return "W" if len(styles) > 1 else "P"


# crawl: paging
_PAGED = re.compile(r"[?&](?:page|p|pg|offset|start|paged)=\d+|/page/\d+/?$", re.I)


def _norm(url: str | None) -> str | None:
    u = split_url(url) if url else None
    return f"{u[0]}//{u[1]}{u[2].rstrip('/')}?{u[3]}" if u else None


def _paging(p: Page) -> dict[str, str]:
    return {r: e.get("href") or "" for r in ("next", "prev") for e in p.q("link", "a") if (e.get("rel") or "") == r}


def _page_no(url: str) -> int | None:
    u = split_url(url)
    m = re.search(r"(?:^|&)(?:page|p|pg|offset|start|paged)=(\d+)", u[3]) if u else None
    m = m or (re.search(r"/(?:page/)?(\d+)/?$", u[2]) if u else None)
    return int(m[1]) if m else None


@dom("crawl-pagination-canonical", 10)
def _(p):
    n = _page_no(p.url)
    if n is None:
        return "P"
    if not p.canonical_url:
        return "W"
    if _norm(p.canonical_url) == _norm(p.url):
        return "P"
    return "F" if n > 1 and (_page_no(p.canonical_url) or 1) == 1 else "W"


dom("crawl-pagination-broken", 6)(lambda p: "F" if any(not p.resolve(h) for h in _paging(p).values()) else "P")
dom("crawl-pagination-loop", 6)(
    lambda p: "F" if any(_norm(p.resolve(h)) == _norm(p.url) for h in _paging(p).values()) else "P"
)


@dom("crawl-pagination-sequence", 5)
def _(p):
    g = _paging(p)
    return "F" if len(g) == 2 and _norm(p.resolve(g["next"])) == _norm(p.resolve(g["prev"])) else "P"


dom("crawl-pagination-noindex", 6)(lambda p: "W" if _paging(p) and noindex(p) else "P")
dom("crawl-pagination-orphaned", 5)(lambda p: "W" if _PAGED.search(p.url) and not _paging(p) else "P")

# Types that give rich results.
_RICH = set(
    "Article NewsArticle BlogPosting Product Recipe Event FAQPage HowTo LocalBusiness Organization Person Review VideoObject"
    " Course JobPosting SoftwareApplication Book Movie MusicAlbum Dataset".split()
)
dom("crawl-schema-noindex-conflict", 15)(lambda p: "F" if noindex(p) and _RICH & {t for t, _ in p.top_items} else "P")
