"""robots.txt and sitemap texts."""

from __future__ import annotations

import re
from functools import lru_cache

# Directives that robots files may hold.
DIRECTIVES = {"user-agent", "disallow", "allow", "sitemap", "crawl-delay", "host", "clean-param", "request-rate", "visit-time", "noindex"}
# Crawlers of AI services.
AI_BOTS = "GPTBot ChatGPT-User Google-Extended CCBot anthropic-ai Claude-Web Bytespider PerplexityBot Amazonbot".split()


@lru_cache(2000)
def parse(text: str) -> tuple[tuple[tuple[str, ...], tuple[tuple[str, str], ...]], ...]:
    """Groups of (user agents, (directive, value) rules), in order, agents lower-cased."""
    groups: list[tuple[list[str], list[tuple[str, str]]]] = []
    for line in text.splitlines():
        line = line.partition("#")[0].strip()
        name, colon, value = line.partition(":")
        name, value = name.strip().lower(), value.strip()
        if not colon:
            continue
        if name == "user-agent":
            if not groups or groups[-1][1]:
                groups.append(([], []))
            groups[-1][0].append(value.lower())
        elif groups and name in ("allow", "disallow", "crawl-delay"):
            groups[-1][1].append((name, value))
    return tuple((tuple(a), tuple(r)) for a, r in groups)


def rules_for(text: str, agents: set[str]) -> list[tuple[str, str]]:
    return [r for a, rules in parse(text) if agents & set(a) for r in rules]


@lru_cache(20_000)
def path_pattern(rule: str) -> re.Pattern:
    """A path rule as a regular expression: * is any run; a final $ ends the path."""
    body = ".*".join(map(re.escape, rule.rstrip("$").split("*")))
    return re.compile(("" if rule.endswith("$") else "^") + body + ("$" if rule.endswith("$") else ""))


@lru_cache(256)
def _rules(text: str, agents: frozenset[str]) -> list[tuple[str, str]]:
    return list(rules_for(text, set(agents)))


def blocked(text: str, path: str, agents: set[str]) -> bool:
    """Disallowed by a rule that no Allow rule of at least its length overrides."""
    rules = _rules(text, frozenset(agents))
    longest = {"allow": -1, "disallow": -1}
    for kind, rule in rules:
        if kind in longest and rule and path_pattern(rule).search(path):
            longest[kind] = max(longest[kind], len(rule))
    return longest["disallow"] >= 0 and longest["allow"] < longest["disallow"]


def problems(text: str) -> list[str]:
    """What a line validator finds: missing colons, unknown directives, empty or misplaced values."""
    out, agent = [], False
    for line in text.splitlines():
        line = line.partition("#")[0].strip()
        if not line:
            continue
        name, colon, value = line.partition(":")
        name, value = name.strip().lower(), value.strip()
        if not colon:
            out.append("colon")
        elif name not in DIRECTIVES:
            out.append("directive")
        elif name == "user-agent":
            agent = True
            if not value:
                out.append("agent")
        elif name in ("allow", "disallow") and not agent:
            out.append("order")
        elif name == "sitemap" and not value:
            out.append("sitemap")
    return out if agent else [*out, "no user-agent"]


def sitemaps_named(text: str) -> list[str]:
    return [m.strip() for m in re.findall(r"(?im)^\s*sitemap:\s*(\S+)", text or "")]


def locations(sitemap: str | None) -> list[str]:
    return re.findall(r"<loc>\s*(.*?)\s*</loc>", sitemap or "", re.I | re.S)


def sitemap_problems(text: str) -> list[str]:
    out = []
    if not text.lstrip().startswith("<"):
        out.append("not xml")
    root = "urlset" if "<urlset" in text else "sitemapindex" if "<sitemapindex" in text else ""
    if not root:
        out.append("root")
    else:
        if f"</{root}>" not in text:
            out.append("closing tag")
        if "xmlns" not in text:
            out.append("namespace")
    if "<loc>" not in text:
        out.append("loc")
    return out


def ai_bots_blocked(text: str) -> int:
    """AI crawlers that a Disallow: / shuts out, by name or through *."""
    groups = parse(text or "")
    every = any("*" in a and ("disallow", "/") in r for a, r in groups)
    n = 0
    for bot in AI_BOTS:
        own = [r for a, r in groups if bot.lower() in a]
        n += any(("disallow", "/") in r for r in own) if own else every
    return n
