"""Lists of patterns searched in texts, most of which hold none of them.

Every pattern is given the letters it cannot match without; where a text,
lower-cased once, lacks them, the pattern is not run.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable


def _needs(tree) -> tuple[str, ...]:
    """Lower-case strings without digits of which a match holds at least one; () if none can be told."""
    best: tuple[str, ...] = ()
    run = ""
    runs: list[str] = []
    for op, arg in tree:
        op = str(op)
        if op == "LITERAL" and not chr(arg).isdigit():
            run += chr(arg).lower()
            continue
        if op == "MAX_REPEAT" and len(arg[2]) == 1 and str(arg[2][0][0]) == "LITERAL" and not chr(arg[2][0][1]).isdigit():
            runs.append(run + chr(arg[2][0][1]).lower() * arg[0])
            run = ""
            continue
        runs.append(run)
        run = ""
        inner: tuple[str, ...] = ()
        if op == "SUBPATTERN":
            inner = _needs(arg[3])
        elif op == "BRANCH":
            each = [_needs(b) for b in arg[1]]
            inner = tuple(x for e in each for x in e) if all(each) else ()
        elif op in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] > 0:
            inner = _needs(arg[2])
        if inner and min(map(len, inner)) > (min(map(len, best)) if best else 0):
            best = inner
    longest = max([*runs, run], key=len)
    if longest and (not best or len(longest) >= min(map(len, best))):
        return (longest,)
    return best


class Wording:
    """Some patterns, case aside unless told otherwise; letters and digits are ASCII's by default, as web scripts have it."""

    def __init__(self, patterns: Iterable[str], flags: int = re.I | re.A) -> None:
        by: dict[tuple[str, ...], list[re.Pattern]] = {}
        for p in patterns:
            by.setdefault(_needs(re._parser.parse(p, flags)), []).append(re.compile(p, flags))
        self._always = by.pop((), [])
        # Each string with the patterns that a text holding it may match.
        self._by = [(need, found) for needs, found in by.items() for need in needs]

    @property
    def needs(self) -> list[str]:
        """Strings of which every text that matches holds one, in lower case; without them there must be no pattern."""
        if self._always:
            raise ValueError("a pattern may match without any letters of its own")
        return [need for need, _ in self._by]

    def candidates(self, low: str) -> list[re.Pattern]:
        """The patterns that may match a text of these lower-case letters, each once."""
        found = [p for need, p in self._by if need in low]
        if len(found) < 2:
            return [*self._always, *(found[0] if found else ())]
        return [*self._always, *dict.fromkeys(x for p in found for x in p)]

    def any(self, text: str, low: str | None = None) -> bool:
        """Whether a pattern is found; low is the text in lower case, if at hand."""
        return any(p.search(text) for p in self.candidates(text.lower() if low is None else low))

    def count(self, text: str, low: str | None = None) -> int:
        """Matches of all patterns together."""
        return sum(sum(1 for _ in p.finditer(text)) for p in self.candidates(text.lower() if low is None else low))


_LISTED = re.compile(r"\\b\((.*)\)\\b")


class Terms:
    """Patterns of the form \\b(term|term)\\b, counted by looking words up.

    A pattern is run only where a term of several words, or of other signs than
    letters and digits, may stand in the text: such terms take their words from
    others, so that looking up would count too much.
    """

    def __init__(self, patterns: Iterable[str]) -> None:
        self._lists = []
        for p in patterns:
            terms = _LISTED.fullmatch(p)[1].split("|")
            plain = [t for t in terms if re.fullmatch(r"[a-z0-9]+", t)]
            other = [t for t in terms if t not in plain]
            self._lists.append((plain, Wording(other), re.compile(p, re.I | re.A)))

    def count(self, text: str, low: str, words: Counter[str]) -> int:
        """words: how often each ASCII word stands in low."""
        return sum(
            sum(1 for _ in whole.finditer(text)) if other.any(text, low) else sum(words[t] for t in plain if t in words)
            for plain, other, whole in self._lists
        )
