"""Blocks of a page's text and their compressed size, for the spam operator; and what a proper sentence is."""

from __future__ import annotations

import zlib

from pagelattice.llm.words import LANGUAGES as LANGUAGES

#: Shorter sentences, or sentences with fewer function words, are slogans.
SENTENCE_WORDS, SENTENCE_SHARE = 7, 0.12
ENDS = frozenset('.!?…»”"')
#: Blocks shorter than this say nothing on redundancy and join their neighbours.
BLOCK_CHARS = 400


def text_blocks(lines: list[tuple[str, str]]) -> list[str]:
    """Consecutive (line, path) pairs joined by their container, short blocks merged with the ones before."""
    out: list[str] = []
    last = None
    for text, path in lines:
        holder = path.rpartition("/")[0]
        if out and (holder == last or len(out[-1]) < BLOCK_CHARS):
            out[-1] += "\n" + text
        else:
            out.append(text)
        last = holder
    if len(out) > 1 and len(out[-1]) < BLOCK_CHARS:
        tail = out.pop()
        out[-1] += "\n" + tail
    return out


def deflated(block: str) -> tuple[int, int]:
    """(bytes, compressed bytes) of a block, letter case aside."""
    data = block.lower().encode("utf-8", "replace")
    return len(data), len(zlib.compress(data, 6))
