"""The rule registry: ids, categories, weights, and how each rule is evaluated.

A rule is one of
- ``dom``: a function of the parsed page, run in the one Arrow pass that parses html;
- ``native``: a SQL expression over url, status, headers and timings, run by Catalyst;
- ``site``: a DataFrame operator over all pages of an audit, with joins and windows.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

# Categories with their weights, in report order.
CATEGORIES = {
    "core": ("Core SEO", 12),
    "perf": ("Performance", 12),
    "links": ("Links", 8),
    "images": ("Images", 8),
    "security": ("Security", 8),
    "technical": ("Technical SEO", 7),
    "crawl": ("Crawlability", 5),
    "schema": ("Structured Data", 5),
    "js": ("JavaScript Rendering", 5),
    "content": ("Content", 5),
    "a11y": ("Accessibility", 4),
    "social": ("Social", 3),
    "eeat": ("E-E-A-T", 3),
    "url": ("URL Structure", 3),
    "redirect": ("Redirects", 3),
    "mobile": ("Mobile", 2),
    "i18n": ("Internationalization", 2),
    "htmlval": ("HTML Validation", 2),
    "geo": ("AI/GEO Readiness", 2),
    "legal": ("Legal Compliance", 1),
}
#: Score of a status where a rule gives none of its own.
SCORES = {"P": 100, "W": 50, "F": 0}
NAMES = {"P": "pass", "W": "warn", "F": "fail"}
_ALIAS = {"cwv": "perf"}


@dataclass(frozen=True)
class Rule:
    id: str
    category: str
    weight: int
    kind: str
    run: Any
    registered: bool = True


RULES: dict[str, Rule] = {}


def category_of(rule_id: str) -> str:
    """The category named by an id's first part."""
    first = rule_id.split("-", 1)[0]
    return _ALIAS.get(first, first)


def define(rule_id: str, weight: int, kind: str, run: Any, registered: bool = True) -> None:
    """Adds a rule; an unknown category, a weight outside 0..100 or a repeated id is an error."""
    category = category_of(rule_id)
    if category not in CATEGORIES:
        raise ValueError(f"{rule_id}: unknown category {category}")
    if not 0 <= weight <= 100:
        raise ValueError(f"{rule_id}: weight {weight} is not within 0..100")
    if not callable(run) and not isinstance(run, str):
        raise TypeError(f"{rule_id}: nothing to run")
    if rule_id in RULES:
        raise ValueError(f"{rule_id} is defined twice")
    RULES[rule_id] = Rule(rule_id, category, weight, kind, run, registered)


def dom(rule_id: str, weight: int = 1, registered: bool = True) -> Callable:
    """Decorator of a function page -> "P", "W", "F" or (status, score)."""

    def add(fn: Callable) -> Callable:
        define(rule_id, weight, "dom", fn, registered)
        return fn

    return add


def native(rule_id: str, weight: int, expression: str) -> None:
    """A rule as a SQL expression that gives P, W or F."""
    define(rule_id, weight, "native", expression)


def matches(pattern: str, rule_id: str) -> bool:
    """Whether an id matches a pattern in which * stands for any run of characters."""
    return re.fullmatch(".*".join(map(re.escape, pattern.split("*"))), rule_id) is not None


def selected(categories=(), enable=(), disable=()) -> list[Rule]:
    """Registered rules of the categories (all if empty); disable wins over enable, an empty enable means all."""
    return [
        r
        for r in RULES.values()
        if r.registered
        and (not categories or r.category in categories)
        and (not enable or any(matches(p, r.id) for p in enable))
        and not any(matches(p, r.id) for p in disable)
    ]
