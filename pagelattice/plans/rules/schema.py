"""DOM rules on structured data."""

from __future__ import annotations

import re

from pagelattice.plans.rules.registry import dom
from pagelattice.sources.dom import Page, missing, split_url

# Required | recommended fields by type.
FIELDS = {
    "Article": ("headline author datePublished", "image publisher dateModified description"),
    "NewsArticle": ("headline author datePublished", "image publisher dateModified description"),
    "BlogPosting": ("headline author datePublished", "image publisher dateModified description"),
    "Product": ("name", "image description offers aggregateRating brand"),
    "Organization": ("name", "url logo contactPoint sameAs address"),
    "LocalBusiness": ("name address", "telephone openingHours priceRange image geo"),
    "Person": ("name", "image jobTitle sameAs url"),
    "WebSite": ("name url", "potentialAction publisher"),
    "WebPage": ("name", "description breadcrumb mainEntity"),
    "BreadcrumbList": ("itemListElement", ""),
    "FAQPage": ("mainEntity", ""),
    "HowTo": ("name step", "image totalTime estimatedCost supply tool"),
    "Recipe": ("name recipeIngredient recipeInstructions", "image author prepTime cookTime nutrition"),
    "Event": ("name startDate location", "endDate image description offers performer"),
    "Review": ("itemReviewed reviewRating author", "reviewBody datePublished"),
    "VideoObject": ("name thumbnailUrl uploadDate", "description contentUrl duration embedUrl"),
    "Course": ("name provider", "description offers"),
    "JobPosting": ("title description datePosted hiringOrganization", "validThrough employmentType jobLocation baseSalary"),
    "SoftwareApplication": ("name", "offers aggregateRating operatingSystem applicationCategory"),
}
_ARTICLES = {"Article", "NewsArticle", "BlogPosting", "TechArticle", "ScholarlyArticle"}
_LOCALS = set(
    "LocalBusiness Restaurant Store MedicalBusiness LegalService FinancialService RealEstateAgent Dentist Physician"
    " Attorney".split()
)
_ORGS = {"Organization", "Corporation", "NGO", "GovernmentOrganization"}


def _list(x) -> list:
    return x if isinstance(x, list) else [] if x is None else [x]


def _of(p: Page, types) -> list[dict]:
    return [x for t, x in p.items if t in types]


def _worst(*found: str) -> str:
    return "F" if "F" in found else "W" if "W" in found else "P"


@dom("schema-present", 25)
def _(p):
    if p.ld:
        return "P"
    return "W" if any("itemscope" in e.attrs or "typeof" in e.attrs or "property" in e.attrs and e.tag != "meta" for e in p.all) else "F"


@dom("schema-valid", 25)
def _(p):
    good = sum(d is not None for d in p.ld)
    return "W" if not p.ld else "P" if good == len(p.ld) else "F" if not good else "W"


@dom("schema-type", 25)
def _(p):
    if not p.ld:
        return "W"
    typed = [
        d is not None and any(isinstance(x, dict) and ("@type" in x or "@graph" in x) for x in _list(d)) for d in p.ld
    ]
    return "P" if all(typed) else "W" if any(typed) else "F"


@dom("schema-required-fields", 25)
def _(p):
    known = [(t, x) for t, x in p.top_items if t in FIELDS]
    if not known:
        return "W"
    if any(missing(x, FIELDS[t][0]) for t, x in known):
        return "F"
    return "W" if any(missing(x, FIELDS[t][1]) for t, x in known) else "P"


@dom("schema-article", 12)
def _(p):
    out = "P"
    for x in _of(p, _ARTICLES):
        if missing(x, ("headline", "author", "datePublished")):
            return "F"
        if isinstance(x.get("author"), str) or missing(x, ("image", "publisher", "dateModified", "description", "mainEntityOfPage")):
            out = "W"
    return out


@dom("schema-breadcrumb", 8)
def _(p):
    found = _of(p, {"BreadcrumbList"})
    if not found:
        return "P" if p.at[2] in ("", "/") else "W"
    return "P" if all(isinstance(x.get("itemListElement"), list) and len(x["itemListElement"]) >= 2 for x in found) else "W"


@dom("schema-faq", 8)
def _(p):
    for x in _of(p, {"FAQPage"}):
        questions = _list(x.get("mainEntity"))
        if not questions:
            return "F"
        for q in questions:
            answer = q.get("acceptedAnswer") if isinstance(q, dict) else None
            if not isinstance(q, dict) or missing(q, ["name"]) or not isinstance(answer, dict) or missing(answer, ["text"]):
                return "F"
    return "P"


@dom("schema-local-business", 10)
def _(p):
    out = "P"
    for x in _of(p, _LOCALS):
        if missing(x, ("name", "address")):
            return "F"
        a = x["address"]
        if not isinstance(a, dict) or missing(a, ("streetAddress", "addressLocality", "postalCode", "addressCountry")):
            out = "W"
        if missing(x, ("telephone", "openingHours", "geo", "priceRange", "image", "url")):
            out = "W"
    return out


@dom("schema-organization", 8)
def _(p):
    for x in _of(p, _ORGS):
        logo = x.get("logo")
        logo = logo.get("url") if isinstance(logo, dict) else logo
        if missing(x, ("name", "url", "logo", "sameAs", "contactPoint", "address")):
            return "W"
        if isinstance(logo, str) and not re.match(r"https?://", logo):
            return "W"
    return "P"


@dom("schema-product", 12)
def _(p):
    out = "P"
    for x in _of(p, {"Product", "ProductGroup"}):
        if missing(x, ("name", "image", "offers")):
            return "F"
        for o in _list(x["offers"]):
            if not isinstance(o, dict):
                return "F"
            price = ("price", "lowPrice")[o.get("@type") == "AggregateOffer"]
            if missing(o, (price, "priceCurrency") + (("availability",) if price == "price" else ())):
                return "F"
            if not re.search(r"schema\.org/\w+$|^(?:InStock|OutOfStock|PreOrder)", str(o.get("availability") or "InStock")):
                out = "W"
        if missing(x, ("description", "brand", "sku", "aggregateRating", "review")):
            out = "W"
    return out


@dom("schema-review", 10)
def _(p):
    out = "P"
    for t, x in p.items:
        if t == "Review":
            if missing(x, ("itemReviewed", "author")):
                return "F"
            r = x.get("reviewRating")
            if not isinstance(r, dict):
                out = "W"
            elif missing(r, ["ratingValue"]):
                return "F"
            elif missing(r, ["bestRating"]):
                out = "W"
        if t == "AggregateRating":
            if missing(x, ["ratingValue"]) or (missing(x, ["reviewCount"]) and missing(x, ["ratingCount"])):
                return "F"
            if missing(x, ["bestRating"]):
                out = "W"
    return out


@dom("schema-video", 10)
def _(p):
    out = "P"
    for x in _of(p, {"VideoObject"}):
        if missing(x, ("name", "thumbnailUrl", "uploadDate")):
            return "F"
        thumbs = [t for t in _list(x["thumbnailUrl"]) if isinstance(t, str)]
        if (
            missing(x, ("description", "contentUrl", "duration", "embedUrl", "interactionStatistic"))
            or any(not t.startswith("http") for t in thumbs)
            or not str(x.get("duration") or "PT").startswith("PT")
            or not re.match(r"\d{4}-\d{2}-\d{2}", str(x["uploadDate"]))
        ):
            out = "W"
    return out


@dom("schema-website-search", 8)
def _(p):
    if p.at[2] not in ("", "/"):
        return "P"
    sites = _of(p, {"WebSite"})
    if not sites:
        return "W"
    for x in sites:
        action = next((a for a in _list(x.get("potentialAction")) if isinstance(a, dict) and a.get("@type") == "SearchAction"), None)
        if missing(x, ("name", "url")) or action is None or missing(action, ["target"]) or missing(action, ["query-input"]):
            return "W"
    return "P"
