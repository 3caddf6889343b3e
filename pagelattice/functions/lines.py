"""Html to text lines: one regular-expression pass, no DOM.

A *line* is the text between two line ends (start and end tags of block
elements, every ``br`` and ``hr``), with other tags dropped, entities decoded,
white space collapsed and empty lines left out. ``head``, ``script``,
``style``, ``noscript``, ``template`` and comments hold no lines.
"""

from __future__ import annotations

import html as _html
import re

# The elements whose tags end a line.
BLOCK = frozenset(
    "p div section article main aside header footer nav ul ol li dl dt dd table thead tbody tr td th"
    " h1 h2 h3 h4 h5 h6 form figure figcaption blockquote pre body html".split()
)
VOID_BREAKS = frozenset(("br", "hr"))

_HIDDEN = re.compile(
    r"<(?=[!?shntSHNT])(?:!--.*?(?:-->|\Z)"
    r"|(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|head\b[^>]*>.*?(?:</head\s*>|(?=<body\b)|\Z)"
    r"|[!?][^>]*>)",
    re.I | re.S,
)
_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+)>""")
_CLASS = re.compile(r"""\b(?:class|id|role)\s*=\s*["']?([^"'>\s]+)""", re.I)


def text_of(raw: str) -> str:
    """Raw text with entities decoded and white space (no-break space too) collapsed."""
    if "&" in raw:
        raw = _html.unescape(raw)
    return " ".join(raw.split())


def lines(html: str | None) -> list[str]:
    """The lines of a page in document order; null or empty html has none."""
    if not html:
        return []
    out: list[str] = []
    buf = ""
    parts = _TAG.split(_HIDDEN.sub("", html))
    # parts: text, slash, name, attributes, text, ...
    it = iter(parts)
    buf = next(it)
    for _slash, name, _attrs, text in zip(it, it, it, it):
        low = name.lower()
        if low in BLOCK or low in VOID_BREAKS:
            if buf and (t := text_of(buf)):
                out.append(t)
            buf = text
        else:
            buf += text
    if buf and (t := text_of(buf)):
        out.append(t)
    return out


def blocks(html: str | None) -> list[tuple[str, str, int]]:
    """(line, path of open block elements, characters inside links) in document order.

    A path is ``/tag/tag.class...``, a step's class being its first class, id
    or role. An end tag closes back to the nearest open element of its name;
    one that was never opened closes nothing.
    """
    if not html:
        return []
    out: list[tuple[str, str, int]] = []
    it = iter(_TAG.split(_HIDDEN.sub("", html)))
    buf = next(it)
    names: list[str] = []
    paths = [""]
    steps: dict[tuple[str, str], str] = {}
    linked = 0
    in_link = False
    for slash, name, attrs, text in zip(it, it, it, it):
        low = name.lower()
        if low in BLOCK:
            if buf and (t := text_of(buf)):
                out.append((t, paths[-1], linked))
            buf = text
            linked = len(text) if in_link else 0
            if slash:
                if names and names[-1] == low:
                    names.pop()
                    paths.pop()
                elif low in names:
                    i = len(names) - 1
                    while names[i] != low:
                        i -= 1
                    del names[i:], paths[i + 1 :]
            else:
                names.append(low)
                if attrs:
                    step = steps.get((low, attrs))
                    if step is None:
                        c = _CLASS.search(attrs)
                        step = steps[low, attrs] = f"/{low}.{c[1]}" if c else f"/{low}"
                    paths.append(paths[-1] + step)
                else:
                    paths.append(f"{paths[-1]}/{low}")
        elif low in VOID_BREAKS:
            if buf and (t := text_of(buf)):
                out.append((t, paths[-1], linked))
            buf = text
            linked = len(text) if in_link else 0
        else:
            buf += text
            if low == "a":
                in_link = not slash
            if in_link:
                linked += len(text)
    if buf and (t := text_of(buf)):
        out.append((t, paths[-1], linked))
    return out
