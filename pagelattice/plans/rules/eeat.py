"""Rules on trust and expertise: who is behind a site, and how well it says so."""

from __future__ import annotations

import re
from collections import Counter

from pagelattice.functions.wording import Terms, Wording
from pagelattice.plans.rules import eeat_values as V
from pagelattice.plans.rules.registry import dom
from pagelattice.sources.dom import Page, split_url
from pagelattice.sources.select import find, have


class _Target:
    """Tells the links to one kind of page by their wording, their address as written, or parts of it."""

    def __init__(self, values: dict[str, list[str]]) -> None:
        self.text, self.path, self.part = Wording(values["text"]), Wording(values["path"]), values.get("part", [])

    def linked(self, p: Page, labels: bool = False) -> bool:
        """labels: whether a link's label and title count with its text."""
        for e, href, low, text in p.anchors:
            if labels:
                text = f"{text} {e.get('aria-label') or ''} {e.get('title') or ''}"
            if self.text.any(text) or self.path.any(href, low) or any(x in low for x in self.part):
                return True
        return False


_ABOUT, _CONTACT, _PRIVACY, _TERMS, _EDITORIAL = map(_Target, (V.ABOUT, V.CONTACT, V.PRIVACY, V.TERMS, V.EDITORIAL))


@dom("eeat-about-page", 8)
def _(p):
    if _ABOUT.linked(p):
        return "P"
    for e, _href, low, text in p.anchors:
        named = "about" in text.lower() or "/about" in low
        if named and (e.inside("nav", "header") or any(n.get("role") == "navigation" for n in e.up())):
            return "P"
    return "W"


_EMAIL, _PHONE, _POINT = Wording([V.EMAIL]), Wording([V.PHONE]), re.compile("ContactPoint", re.I)


@dom("eeat-contact-page", 8)
def _(p):
    if _CONTACT.linked(p):
        return "P"
    schemes = {href.partition(":")[0] for _, href, _, _ in p.anchors}
    ways = (
        "mailto" in schemes or ("@" in p.body_text and _EMAIL.any(p.body_text, p.low_text)),
        "tel" in schemes or _PHONE.any(p.body_text, p.low_text),
        have(p, V.CONTACT_FORM) or any(k.tag == "textarea" for f in p.q("form") for k in f.below()),
        have(p, V.CONTACT_ADDRESS),
        have(p, V.CONTACT_CHAT),
        any(_POINT.search(s) for s in p.ld_texts),
    )
    return "P" if sum(ways) >= 2 else ("W", 70) if sum(ways) == 1 else "W"


def _privacy(p: Page) -> str:
    return "P" if _PRIVACY.linked(p, labels=True) else "W"


def _terms(p: Page) -> str:
    if _TERMS.linked(p, labels=True):
        return "P"
    asked = have(p, V.NEEDS_TERMS) or any(
        words in e.raw for tag, listed in (("button", V.NEEDS_TERMS_BUTTONS), ("a", V.NEEDS_TERMS_LINKS)) for e in p.q(tag) for words in listed
    )
    return "W" if asked else "P"


dom("eeat-privacy-policy", 8)(_privacy)
dom("eeat-terms-of-service", 6)(_terms)
dom("legal-privacy-policy", 20, registered=False)(_privacy)
dom("legal-terms-of-service", 15, registered=False)(_terms)

_CREDENTIALS = Wording(V.CREDENTIALS, re.A), Wording(V.CREDENTIALS_ANY_CASE)
_SOCIAL = {k: re.compile(v, re.I) for k, v in V.AUTHOR_SOCIAL.items()}


def _roots(p: Page):
    """The objects of the JSON-LD: each document, and what its @graph holds at any depth."""

    def visit(x, deep: int = 0):
        if isinstance(x, dict) and deep < 40:
            yield x
            graph = x.get("@graph")
            for y in graph if isinstance(graph, list) else ():
                yield from visit(y, deep + 1)

    for d in p.ld:
        yield from visit(d)


@dom("eeat-author-expertise", 8)
def _(p):
    signals = 0
    box, bio, social = "", "", []
    seen: set[str] = set()
    for selector, e in find(p, V.AUTHOR_PLACES):
        if selector in seen:  # only the first element of each place counts
            continue
        seen.add(selector)
        text = e.text
        if len(text) > 10:
            box = text
            if len(text) > 100:
                bio = text
                signals += 1
            signals += any(k.tag == "a" and any(w in (k.get("href") or "") for w in ("author", "team", "about")) for k in e.below())
            break
    for x in _roots(p):
        author = x.get("author")
        if not isinstance(author, dict):
            continue
        told = author.get("description")
        if isinstance(told, str) and len(told) > 50:
            signals += 1
            bio = bio or told
        signals += bool(author.get("jobTitle"))
        same = author.get("sameAs")
        social += [k for s in (same if isinstance(same, list) else ()) if isinstance(s, str) for k, r in _SOCIAL.items() if r.search(s)]
    expert = any(c.any(box or bio) for c in _CREDENTIALS)
    signals += expert
    for e, href, _low, _text in p.anchors:
        if any(r.search(href) for r in _SOCIAL.values()):
            near = [e, *e.up()]
            if any("author" in n.classes or "bio" in n.classes or "byline" in n.classes.split() for n in near):
                social += [k for k, r in _SOCIAL.items() if r.search(href) and k not in social]
    signals += bool(social)
    if signals >= 3 or (signals >= 2 and (expert or len(bio) > 100 or len(social) >= 2)):
        return "P"
    return ("P", 80) if signals else "W"


_AUTHORITY = Wording(V.AUTHORITIES)


@dom("eeat-citations", 6)
def _(p):
    here = p.at[1].partition(":")[0]
    cited = outside = 0
    for _e, href, low, _text in p.anchors:
        if not href.startswith("http") or not (u := split_url(href)):
            continue
        host = u[1].partition(":")[0]
        outside += host != here
        if host != here and not host.endswith(f".{here}"):
            cited += _AUTHORITY.any(host, host) or _AUTHORITY.any(href, low)
    return "P" if cited >= 3 else ("P", 80) if cited else ("W", 60) if outside else "P"


_SIGNALS = [Wording(v) for v in V.EDITORIAL_SIGNALS.values()]


@dom("eeat-editorial-policy", 4)
def _(p):
    if _EDITORIAL.linked(p):
        return "P"
    n = sum(s.any(p.body_text, p.low_text) for s in _SIGNALS)
    n += any(x.get("reviewedBy") or x.get("correction") or x.get("editor") for x in _roots(p))
    if n:
        return "P", 80 if n >= 2 else 90
    return "W" if have(p, V.EDITORIAL_SITE) else "P"


_AFFILIATE, _DISCLOSED = Wording(V.AFFILIATE_LINKS), Wording(V.DISCLOSURES)


@dom("eeat-affiliate-disclosure", 5)
def _(p):
    paid = any(
        _AFFILIATE.any(href, low) or ("amazon" in href and "nofollow" in (e.get("rel") or "")) for e, href, low, _ in p.anchors
    ) or have(p, V.AFFILIATE_SELECTORS)
    if not paid:
        return "P"
    if _DISCLOSED.any(p.body_text, p.low_text):
        return "P" if any(_DISCLOSED.any(e.text) for _, e in find(p, V.DISCLOSURE_PLACES)) else ("P", 90)
    page = any("disclosure" in (t := e.text.lower()) or "affiliate" in t for _, e in find(p, V.DISCLOSURE_PAGES))
    return ("P", 90) if page else ("W", 40)


_TRUST = {k: (Wording(words), places) for k, (words, places) in V.TRUST.items()}
_RATED, _PROOF = re.compile(V.TRUST_SCHEMA, re.I), Wording([V.SOCIAL_PROOF])


@dom("eeat-trust-signals", 6)
def _(p):
    kinds = {k for k, (words, places) in _TRUST.items() if have(p, places) or words.any(p.body_text, p.low_text)}
    if any(_RATED.search(s) for s in p.ld_texts):
        kinds.add("reviews")
    n = len(kinds) + ("media" not in kinds and _PROOF.any(p.body_text, p.low_text))
    return "P" if n >= 3 or n == 0 else ("P", 90 if n == 2 else 80)


_YMYL = {k: (least, Terms(words)) for k, (least, words) in V.YMYL.items()}
_ASCII_WORD = re.compile(r"\w+", re.A)
_DISCLAIMERS = {k: Wording(words) for k, words in V.DISCLAIMERS.items()}


def ymyl(p: Page) -> list[str]:
    """The topics that can do harm that a page is about, by its title, description and main part."""
    # The first such element of the page, whichever place it is of.
    first = min((e for _, e in find(p, V.YMYL_PLACES)), key=lambda e: e.start, default=None)
    text = f"{p.title} {p.description or ''} {(first.text if first else '') or p.body_text}"
    low = text.lower()
    words = Counter(_ASCII_WORD.findall(low))
    return [k for k, (least, terms) in _YMYL.items() if terms.count(text, low, words) >= least]


dom("eeat-ymyl-detection", 5)(lambda p: "P")


@dom("eeat-disclaimers", 4)
def _(p):
    topics = ymyl(p)
    if not topics:
        return "P"
    needed = [k for k in topics if k in _DISCLAIMERS]
    text = " ".join(e.raw for _, e in find(p, V.DISCLAIMER_PLACES)) or p.body_text
    low = text.lower()
    found = sum(_DISCLAIMERS[k].any(text, low) for k in needed)
    other = _DISCLAIMERS["general"].any(text, low)
    if found + other and found >= len(needed):
        return "P"
    return ("P", 80) if found + other else "W"


_ADDRESSES = Wording(V.ADDRESSES)
_LOCAL = re.compile(V.LOCAL_BUSINESS, re.I)


def _postal(p: Page) -> bool:
    """Whether the JSON-LD names an address by at least two of its parts."""
    for x in _roots(p):
        kind, a = x.get("@type"), x.get("address")
        if isinstance(kind, str) and any(t in kind for t in V.ADDRESS_TYPES) and isinstance(a, dict):
            if sum(bool(a.get(f)) for f in V.ADDRESS_FIELDS) >= 2:
                return True
    return False


@dom("eeat-physical-address", 6)
def _(p):
    foot = " ".join(e.raw for _, e in find(p, ["footer", '[role="contentinfo"]', ".footer"]))
    part = {k: any(e.text for _, e in find(p, [f'[itemprop="{k}"]'])) for k in ("streetAddress", "addressLocality")}
    if (
        _postal(p)
        or any(10 < len(e.text) < 200 and _ADDRESSES.any(e.text) for _, e in find(p, V.ADDRESS_PLACES))
        or (foot and _ADDRESSES.any(foot))
        or have(p, ['iframe[src*="google.com/maps"]', 'iframe[src*="maps.google"]'])
        or all(part.values())
    ):
        return "P"
    return "W" if have(p, V.NEEDS_ADDRESS) or any(_LOCAL.search(s) for s in p.ld_texts) else "P"
