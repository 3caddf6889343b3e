"""DOM rules: links, images, accessibility."""

from __future__ import annotations

import re
from collections import Counter

from pagelattice.plans.rules.registry import dom
from pagelattice.sources.dom import El, Page, split_url


def _n(value: str | None) -> int | None:
    """The leading integer of an attribute."""
    m = re.match(r"\s*(\d+)", value or "")
    return int(m[1]) if m else None


def _place(url: str) -> str:
    u = split_url(url)
    return f"{u[1]}{u[2]}?{u[3]}" if u else url


dom("links-internal-present")(
    lambda p: "P" if any(l["internal"] and l["href"].partition("#")[0] != p.url.partition("#")[0] for l in p.links) else "W"
)
# Where users' own links are expected; words of paid links; link texts that say nothing.
_UGC = "/comment /comments /forum /forums /discussion /user /users /profile /profiles /review /reviews".split()
_PAID = re.compile(r"sponsor|advertis|partner|paid", re.I)
VAGUE = [
    "click here", "click", "here", "read more", "more", "learn more", "info", "link", "this", "page", "website", "site", "go",
    "continue", "details",
]
GENERIC = [
    "click here", "here", "read more", "more", "learn more", "see more", "view more", "details", "link", "this", "this link", "go",
    "continue", "info", "information", "download", "pdf",
]
_VAGUE = {x + dots for x in VAGUE for dots in ("", "...")}
_GENERIC = re.compile("|".join(x.replace(" ", r"\s*") for x in GENERIC), re.I)


@dom("links-nofollow-appropriate")
def _(p):
    for l in p.links:
        if not l["internal"] and not l["nofollow"] and _PAID.search(l["text"]):
            return "W"
        if l["internal"] and l["nofollow"] and not any(u in l["href"].lower() for u in _UGC):
            return "W"
    return "P"


dom("links-anchor-text")(
    lambda p: "W" if any(len(t := l["text"].strip().lower()) < 2 or t in _VAGUE for l in p.links) else "P"
)
dom("links-dead-end-pages")(
    lambda p: "P" if any(l["internal"] and _place(l["href"]) != _place(p.url) for l in p.links) else "W"
)
dom("links-https-downgrade")(
    lambda p: "W" if p.at[0] == "https" and any(l["href"].startswith("http://") for l in p.links) else "P"
)
dom("links-external-count")(lambda p: "W" if sum(not l["internal"] for l in p.links) > 100 else "P")
dom("links-invalid")(lambda p: "W" if p.invalid_links else "P")
dom("links-tel-mailto")(lambda p: "W" if any(not ok for _, _, ok in p.special_links) else "P")
dom("links-orphan-pages")(lambda p: "P")


@dom("links-localhost", 8)
def _(p):
    urls = [l["href"] for l in p.links] + [e.get("href") or "" for e in p.q("link")]
    urls += [e.get("src") or "" for e in p.q("script", "img")]
    bad = re.compile(r"localhost|127\.0\.0\.1|0\.0\.0\.0|[a-z0-9]:(?:3000|8080|8000|4200|5173|5000)\b", re.I)
    return "F" if any(bad.search(u) for u in urls) else "P"


@dom("links-local-file", 8)
def _(p):
    bad = re.compile(r"file://|/Users/|/home/\w|[CD]:[\\/]")
    return "F" if any(bad.match((e.get("href") or e.get("src") or "").strip()) for e in p.q("a", "link", "script", "img")) else "P"


@dom("links-broken-fragment", 6)
def _(p):
    names = {e.get("id") for e in p.all} | {e.get("name") for e in p.q("a")}
    here = p.url.partition("#")[0]
    for l in p.links:
        base, _, fragment = l["href"].partition("#")
        if fragment and base == here and fragment not in names and fragment != "top":
            return "W"
    return "P"


@dom("links-excessive", 5)
def _(p):
    n = len(p.links)
    return "F" if n > 300 else "W" if n > 100 else "P"


@dom("links-onclick", 5)
def _(p):
    bad = re.compile(r"window\.location|location\.(?:href|assign|replace)|document\.location")
    return "F" if any(bad.search(e.get("onclick") or "") for e in p.q("a", "span", "div", "button")) else "P"


dom("links-whitespace-href", 4)(
    lambda p: "W" if any((h := e.get("href")) and h != h.strip() for e in p.q("a")) else "P"
)

# images
dom("images-alt-present", 20)(lambda p: "F" if any(i["alt"] is None for i in p.images) else "P")
# Alternative texts and file names that say nothing.
_ALTS = set(
    "image|picture|photo|img|pic|graphic|icon|logo|banner|untitled|screenshot|screen shot|placeholder|test|undefined|null|none"
    "|blank|spacer|.|-|_".split("|")
)
_FILES = re.compile(
    r"(?:IMG|DSC|DCIM)[_-]?\d+|(?:image|photo)\d*\.(?:jpg|png|gif|webp|avif)|screenshot[_-]?\d*|untitled|unnamed"
    r"|\d+\.(?:jpg|png|gif|webp|avif)|[a-f0-9]{32}\.|[a-f0-9-]{36}\.",
    re.I,
)


@dom("images-alt-quality", 15)
def _(p):
    for i in p.images:
        alt = (i["alt"] or "").strip()
        if not alt:
            continue
        words = alt.lower().split()
        if len(alt) < 5 or len(alt) > 125 or alt.lower() in _ALTS or re.search(r"\.(?:jpe?g|png|gif|webp|svg|avif)$", alt, re.I):
            return "W"
        if len(words) > 5 and max(Counter(words).values()) > 3:
            return "W"
    return "P"


dom("images-dimensions", 15)(lambda p: "W" if any(not i["width"] or not i["height"] for i in p.images) else "P")
dom("images-lazy-loading", 10)(lambda p: "W" if any(not i["lazy"] for i in p.images[3:]) else "P")


def _ext(src: str) -> str:
    return re.split(r"[?#]", src)[0].rpartition(".")[2].lower()


@dom("images-modern-format", 10)
def _(p):
    kinds = {_ext(i["src"]) for i in p.images}
    return "W" if kinds & {"jpg", "jpeg", "png", "gif", "bmp"} else "P"


_LARGE = re.compile(r"hero|banner|background|full-?width|cover|large|big|hd|4k|2x|3x|retina|original|raw|uncompressed", re.I)


@dom("images-size", 10)
def _(p):
    for i in p.images:
        w, h = _n(i["width"]) or 0, _n(i["height"]) or 0
        if _LARGE.search(i["src"]) or w >= 2000 or h >= 2000 or w * h >= 2_000_000:
            return "W"
    return "P"


@dom("images-responsive", 10)
def _(p):
    for i in p.images:
        w = _n(i["width"])
        if (w is None or w > 300) and i["el"].get("srcset") is None and not i["el"].inside("picture"):
            return "W"
    return "P"


@dom("images-figure-captions", 5)
def _(p):
    for f in p.q("figure"):
        tags = {e.tag for e in f.below()}
        if "figcaption" not in tags or "img" not in tags:
            return "W"
    return "P"


@dom("images-filename-quality", 5)
def _(p):
    for i in p.images:
        name = re.split(r"[?#]", i["src"])[0].rpartition("/")[2]
        if not name or _FILES.match(name) or len(name.rpartition(".")[0]) < 3:
            return "W"
    return "P"


@dom("images-inline-svg-size", 5)
def _(p):
    return "W" if any(len(m) > 5120 for m in re.findall(r"<svg\b.*?</svg\s*>", p.html, re.I | re.S)) else "P"


@dom("images-picture-element", 10)
def _(p):
    for e in p.q("picture"):
        tags = {k.tag for k in e.below()}
        if "img" not in tags or "source" not in tags:
            return "F"
    return "P"


@dom("images-alt-length", 6)
def _(p):
    n = max((len(i["alt"] or "") for i in p.images), default=0)
    return "F" if n > 250 else "W" if n > 125 else "P"


@dom("images-background-seo", 5)
def _(p):
    n = sum(
        bool(re.search(r"background(?:-image)?\s*:[^;]*url\(\s*['\"]?(?!data:)", e.get("style") or "", re.I)) for e in p.all
    )
    return "F" if n > 5 else "W" if n >= 2 else "P"


# accessibility
def _named(p: Page, e: El) -> bool:
    a = e.attrs
    if any((a.get(k) or "").strip() for k in ("aria-label", "aria-labelledby", "title", "alt", "placeholder")) or e.text:
        return True
    if e.tag == "input" and (a.get("value") or "").strip():
        return True
    if e.tag in ("input", "select", "textarea") and (e.inside("label") or a.get("id") in p.label_for):
        return True
    return any(k.tag == "img" and (k.get("alt") or "").strip() or k.tag == "title" and k.text for k in e.below())


_ROLES = {"button", "link", "checkbox", "radio", "tab", "menuitem", "option"}


@dom("a11y-aria-labels", 10)
def _(p):
    n = 0
    for e in p.all:
        if (
            e.tag in ("button", "select", "textarea")
            or (e.tag == "a" and e.get("href") is not None)
            or (e.tag == "input" and e.get("type") != "hidden")
            or e.get("role") in _ROLES
        ):
            n += not _named(p, e)
    return "F" if n > 5 else "W" if n else "P"


# Colour pairs with too little contrast.
_PALE = re.compile(r"(?<![-\w])color\s*:\s*(?:#(?:ccc|ddd|eee|aaa|bbb|999)\b|#(?:cccccc|dddddd|eeeeee|aaaaaa|bbbbbb|999999)|light(?:gr[ae]y|yellow))", re.I)


@dom("a11y-color-contrast", 8)
def _(p):
    for e in p.all:
        style = e.get("style")
        if style and ((_PALE.search(style) and e.text) or ("background-image" in style and e.text)):
            return "W"
    return "P"


@dom("a11y-focus-visible", 8)
def _(p):
    off = re.compile(r"outline\s*:\s*(?:none|0)\b", re.I)
    inline = sum(bool(off.search(e.get("style") or "")) for e in p.all)
    rules = re.findall(r"([^{}]*):focus[^{}]*\{([^}]*)\}", p.css)
    removed = [b for _, b in rules if off.search(b)]
    bare = [b for b in removed if not re.search(r"box-shadow|border|background", b)]
    issues = inline + len(bare)
    if not issues and not removed:
        return "P"
    if ":focus-visible" in p.css and issues <= 1:
        return "W"
    return "F" if issues > 3 else "W"


@dom("a11y-form-labels", 10)
def _(p):
    skip = {"hidden", "submit", "button", "reset", "image"}
    fields = [e for e in p.q("input", "select", "textarea") if (e.get("type") or "text").lower() not in skip]
    bad = sum(
        not (
            e.get("aria-label") or e.get("aria-labelledby") or e.get("title") or e.inside("label") or e.get("id") in p.label_for
        )
        for e in fields
    )
    if not bad:
        return "P"
    return "F" if bad > 3 or bad > 0.3 * len(fields) else "W"


@dom("a11y-heading-order", 8)
def _(p):
    levels = [n for n, _ in p.headings]
    if not levels:
        return "W"
    skips = sum(b > a + 1 for a, b in zip(levels, levels[1:]))
    first = levels[0] != 1
    if skips > 3 or (skips and first):
        return "F"
    return "W" if skips or first or levels.count(1) > 1 else "P"


@dom("a11y-landmark-regions", 6)
def _(p):
    roles = Counter(e.get("role") for e in p.all)
    mains = len(p.q("main")) + roles["main"]
    navs = p.q("nav")
    if not mains or not (navs or roles["navigation"]) or not (p.have("header") or roles["banner"]):
        return "W"
    if not (p.have("footer") or roles["contentinfo"]) or mains > 1:
        return "W"
    return "W" if len(navs) > 1 and any(not (e.get("aria-label") or e.get("aria-labelledby")) for e in navs) else "P"


@dom("a11y-link-text", 8)
def _(p):
    generic = other = 0
    targets: dict[str, set] = {}
    for e in p.q("a"):
        if e.get("href") is None:
            continue
        text = (e.get("aria-label") or e.text or "").strip()
        if not text:
            other += not any(k.tag == "img" and k.get("alt") for k in e.below())
            continue
        if _GENERIC.fullmatch(text):
            generic += 1
        elif len(text) < 2 or re.match(r"https?://|www\.", text):
            other += 1
        targets.setdefault(text.lower(), set()).add(e.get("href"))
    issues = generic + other + sum(len(v) > 1 for v in targets.values())
    return "P" if not issues else "F" if issues > 5 or generic > 3 else "W"


@dom("a11y-skip-link", 6)
def _(p):
    ids = {e.get("id") for e in p.all} | {e.get("name") for e in p.q("a")}
    for e in [e for e in p.q("a") if (e.get("href") or "").startswith("#")][:15]:
        if re.search(r"skip|jump|main|content", e.text + e.classes, re.I) and e.get("href")[1:] in ids:
            return "P"
    return "P" if not p.have("nav", "header") and len(p.q("a")) < 10 else "W"


@dom("a11y-table-headers", 6)
def _(p):
    worst = "P"
    for t in p.q("table"):
        inner = list(t.below())
        rows = [e for e in inner if e.tag == "tr"]
        cols = max((sum(k.tag in ("td", "th") for k in r.kids) for r in rows), default=0)
        if len(rows) < 2 or cols < 2 or t.get("role") in ("presentation", "none"):
            continue
        heads = [e for e in inner if e.tag == "th"]
        if not heads:
            return "F"
        if any(not e.get("scope") for e in heads) or not any(e.tag == "caption" for e in inner):
            worst = "W"
    return worst


@dom("a11y-touch-targets", 6)
def _(p):
    for e in p.all:
        if e.tag in ("a", "button", "input") or e.get("role") == "button":
            for m in re.finditer(r"(?<![-\w])(?:min-)?(?:width|height)\s*:\s*(\d+(?:\.\d+)?)px", e.get("style") or ""):
                if float(m[1]) < 44:
                    return "W"
    return "P"


@dom("a11y-video-captions", 8)
def _(p):
    good = bad = 0
    for v in p.q("video"):
        has = any(k.tag == "track" and k.get("kind") in ("captions", "subtitles") for k in v.below())
        good, bad = good + has, bad + (not has)
    bad += len(p.q("audio"))
    bad += sum(
        bool(re.search(r"youtube|vimeo", e.get("src") or "")) and "cc_load_policy=1" not in (e.get("src") or "")
        for e in p.q("iframe")
    )
    return "P" if not bad else "F" if bad > good else "W"


@dom("a11y-zoom-disabled", 10)
def _(p):
    v = (p.meta("viewport") or "").lower().replace(" ", "")
    m = re.search(r"maximum-scale=([\d.]+)", v)
    return "F" if re.search(r"user-scalable=(?:no|0)\b", v) or (m and float(m[1].strip(".") or 9) <= 1) else "P"
