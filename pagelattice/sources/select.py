"""Simple selectors over a page: tag, .class, [attr], [attr="v"], [attr*="v"], and a tag with one attribute test."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import cache

from pagelattice.sources.dom import El, Page

_FORM = re.compile(r"""([a-z0-9]*)(?:\.([\w-]+)|\[([\w-]+)(?:(\*?)="([^"]*)")?\])?""")


@cache
def _parts(selector: str) -> tuple[str, str | None, str | None, str | None, str | None]:
    m = _FORM.fullmatch(selector)
    if m is None:
        raise ValueError(f"selector {selector} is not supported")
    return m.groups()


def matches(e: El, selector: str) -> bool:
    tag, name, attr, part, value = _parts(selector)
    if tag and e.tag != tag:
        return False
    if name:
        return name in e.classes.split()
    if attr:
        held = e.get(attr)
        return held is not None and (value is None or (value in held if part else value == held))
    return True


def find(page: Page, selectors: Iterable[str]) -> list[tuple[str, El]]:
    """(selector, element) of all matches, selector by selector, each in document order."""
    out = []
    for s in selectors:
        if have(page, [s]):
            tag = _parts(s)[0]
            out += [(s, e) for e in (page.q(tag) if tag else page.all) if matches(e, s)]
    return out


def have(page: Page, selectors: Iterable[str]) -> bool:
    """Whether any selector matches; whole-page attribute values are looked through before elements are."""
    for s in selectors:
        tag, name, attr, part, value = _parts(s)
        if tag and not page.have(tag):
            continue
        if name:
            if name in page.class_names and (not tag or any(matches(e, s) for e in page.q(tag))):
                return True
        elif attr:
            held = page.values(attr)
            if value is None:
                found = bool(held)
            elif part:
                found = any(value in v for v in held)
            else:
                found = value in held
            if found and (not tag or any(matches(e, s) for e in page.q(tag))):
                return True
        elif tag:
            return True
    return False
