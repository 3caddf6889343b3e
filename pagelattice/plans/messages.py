"""Names, messages and advice of the rules, made from their ids: our own wording, by what a rule looks at and what it asks."""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelattice.plans.rules import CATEGORIES, RULES

# Words of ids that are written otherwise in text.
_SPELLED = {
    "h1": "H1", "url": "URL", "urls": "URLs", "css": "CSS", "js": "JavaScript", "html": "HTML", "http": "HTTP", "https": "HTTPS", "http2": "HTTP/2",
    "og": "Open Graph", "csp": "content security policy", "hsts": "HSTS", "ssl": "TLS", "lcp": "largest contentful paint", "cls": "layout shift",
    "inp": "interaction delay", "ttfb": "time to first byte", "fcp": "first contentful paint", "dom": "DOM", "robots": "robots", "txt": "file",
    "robotstxt": "robots file", "llms": "language-model", "ai": "AI", "seo": "search", "faq": "FAQ", "svg": "SVG", "alt": "alternative text",
    "aria": "ARIA", "ssr": "server rendering", "ymyl": "sensitive-topic", "tel": "telephone", "www": "www", "id": "id", "ids": "ids",
}

# What a rule asks, told by the words its id has, and what to do where it is not met. {0} is what the rule looks at.
_ADVICE = [
    (r"-present$|-exists$", "Add the missing {0}."),
    (r"-unique$", "Give every page its own {0}."),
    (r"-single$|multiple-", "Keep one and remove the others: {0}."),
    (r"-length$|-limit$|-pixel-width$", "Bring it within the recommended size: {0}."),
    (r"-size$|-weight$|-minify|minify-", "Make it smaller: {0}."),
    (r"broken|-404|-4xx|server-error|timeout", "Repair or remove what does not answer: {0}."),
    (r"redirect", "Lead straight to the final address: {0}."),
    (r"noindex|indexability|conflict|mismatch", "Make the statements agree: {0}."),
    (r"duplicate|repetitive", "Merge or tell apart what repeats: {0}."),
    (r"canonical", "Name one preferred address for the page: {0}."),
    (r"hreflang", "Let the language versions refer to each other: {0}."),
    (r"-modified$|rendered", "Send it with the first response, without scripts: {0}."),
    (r"loop", "Let nothing lead back to itself: {0}."),
    (r"valid$|-type$|required-fields", "Correct the form: {0}."),
    (r"sitemap", "Bring the list of pages up to date: {0}."),
    (r"policy|hsts|csp|frame|options|referrer", "Set the header: {0}."),
    (r"https|mixed-content|password|protocol", "Use encrypted addresses throughout: {0}."),
    (r"labels|captions|alt-|landmark|skip-link|headers|heading", "Say in text what is only shown: {0}."),
    (r"viewport|font|scroll|touch|zoom|interstitial", "Fit it to small screens: {0}."),
    (r"preconnect|lazy|render-blocking|lcp|fcp|ttfb|inp|cls|cache|brotli|compression|response-time", "Show the page sooner: {0}."),
    (r"-missing-|missing-", "Add what is missing: {0}."),
    (r"about|contact|author|expertise|editorial|trust|disclaim|disclosure|address|privacy|terms|citations", "Say who answers for the page, and how: {0}."),
    (r"schema|breadcrumb|article|product|review|video|faq|organization|business", "Complete the structured data: {0}."),
    (r"links|anchor|fragment|href", "Review the links: {0}."),
]
_OUTCOME = {"P": "met", "W": "should be better", "F": "not met"}


@cache
def name_of(rule_id: str) -> str:
    """A rule's name: the words of its id without its category."""
    words = rule_id.split("-")
    words = words[1:] if len(words) > 1 and words[0] in CATEGORIES else words
    text = " ".join(_SPELLED.get(w, w) for w in words)
    return text[:1].upper() + text[1:]


@cache
def advice_for(rule_id: str) -> str:
    """What to do where a rule is not met."""
    subject = name_of(rule_id)
    subject = subject if subject[:2].isupper() else subject[:1].lower() + subject[1:]
    found = next((advice for pattern, advice in _ADVICE if re.search(pattern, rule_id)), "Review this: {0}.")
    return found.format(subject)


def message(rule_id: str, status: str) -> str:
    return f"{name_of(rule_id)}: {_OUTCOME[status]}"


def _looked_up(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def with_messages(results: DataFrame) -> DataFrame:
    """Adds rule_name and message; a few hundred names travel with the plan, no join."""
    names = {r: name_of(r) for r in RULES}
    named = results.withColumn("rule_name", _looked_up(names, F.col("rule_id")))
    return named.withColumn("message", F.concat("rule_name", F.lit(": "), _looked_up(_OUTCOME, F.col("status"))))
