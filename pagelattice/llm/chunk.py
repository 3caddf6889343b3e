"""Some parsed pages side by side: their lines and tokens as flat arrays, so that measures are numpy sums.

Every token is looked up once in a table of what is known of it alone: its
word ids and hashes, whether it is a function word, which language it tells,
whether a short residue message could have it. A line is (text, path of open block
elements, characters inside links), as `functions.lines.blocks` gives it.
"""

from __future__ import annotations

import zlib

import numpy as np
import xxhash

from pagelattice.llm import residue_rules
from pagelattice.llm.words import FUNCTION_WORDS, TELLING, words

Line = tuple[str, str, int]
#: Tokens kept between chunks: bounds the worker's memory.
MOST_TOKENS = 400_000


class _Table(dict):
    """token -> its number; the columns hold what is known of the token alone."""

    def __init__(self) -> None:
        self.crc: list[int] = []
        self.function: list[bool] = []
        self.foreign: list[bool] = []
        self.tells: list[int] = []
        self.short: list[bool] = []
        self.grams: list[int] = []
        self.latin: list[int] = []
        self.first: list[int] = []
        self.n_words: list[int] = []
        self.hashes: list[int] = []
        self.lower: list[int] = []
        self._arrays: tuple[int, dict[str, np.ndarray]] = (-1, {})

    def __missing__(self, token: str) -> int:
        n = self[token] = len(self)
        low = token.lower()
        found = words(token)
        grams, latin = residue_rules.latin_grams(found)
        self.crc.append(zlib.crc32(low.encode("utf-8", "replace")))
        self.function.append(low in FUNCTION_WORDS)
        self.foreign.append(any(w in residue_rules.FOREIGN for w in found))
        self.tells.append(TELLING.get(low, 0))
        self.short.append(residue_rules.short_word(low))
        self.grams.append(grams)
        self.latin.append(latin)
        self.first.append(len(self.hashes))
        self.n_words.append(len(found))
        self.hashes.extend(xxhash.xxh3_64_intdigest(w) for w in found)
        self.lower.append(n)
        if low != token:
            self.lower[n] = self[low]
        return n

    def column(self, name: str) -> np.ndarray:
        size, arrays = self._arrays
        if size != len(self):
            self._arrays = size, arrays = len(self), {}
        if name not in arrays:
            arrays[name] = np.array(getattr(self, name), np.uint64 if name == "hashes" else None)
        return arrays[name]


_table = _Table()


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers starts[i], ..., starts[i] + sizes[i] - 1 of all i, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes - starts, sizes)


def sort_parts(values: np.ndarray, sizes: np.ndarray) -> None:
    """Sorts each of the consecutive parts of these sizes in place."""
    start = 0
    for end in np.cumsum(sizes).tolist():
        values[start:end].sort()
        start = end


class Chunk:
    """Flat arrays over the lines and tokens of some pages."""

    def __init__(self, pages: list[list[Line]]) -> None:
        global _table
        if len(_table) > MOST_TOKENS:
            _table = _Table()
        self.table = _table
        self.pages = pages
        self.counts = np.fromiter(map(len, pages), np.int64, len(pages))
        self.page = np.repeat(np.arange(len(pages)), self.counts)
        self.texts = [t for p in pages for t, _, _ in p]
        tokens = "\n".join(self.texts).split()
        # White space within a line is single spaces.
        self.n_tokens = np.fromiter((t.count(" ") + 1 for t in self.texts), np.int64, len(self.texts))
        self.tokens = np.fromiter(map(_table.__getitem__, tokens), np.int64, len(tokens))
        self.sizes = np.fromiter(map(len, self.texts), np.int64, len(self.texts))

    def of_lines(self, column: str) -> np.ndarray:
        """Sums of a token column over each line."""
        if not len(self.tokens):
            return np.zeros(len(self.texts), np.int64)
        return np.add.reduceat(self.table.column(column)[self.tokens].astype(np.int64), np.cumsum(self.n_tokens) - self.n_tokens)

    def per_page(self, values: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
        """Sums of a line column over each page, of the lines in mask."""
        where = slice(None) if mask is None else mask
        return np.bincount(self.page[where], weights=values[where], minlength=len(self.pages)).astype(np.int64)

    def distinct(self, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(page, token) of the distinct tokens, letter case aside, of each page's lines in mask."""
        n = max(1, len(self.table))
        low = self.table.column("lower")[self.tokens]
        page = np.repeat(self.page, self.n_tokens)
        kept = np.repeat(mask, self.n_tokens)
        key = (page * n + low)[kept]
        sort_parts(key, np.bincount(page[kept], minlength=len(self.pages)))
        key = key[np.r_[True, key[1:] != key[:-1]][: len(key)]]
        return key // n, key % n

    def word_hashes(self, line: np.ndarray) -> np.ndarray:
        """Hashes of the words of consecutive lines, given as their numbers, in order."""
        begin = np.cumsum(self.n_tokens) - self.n_tokens
        tokens = self.tokens[ranges(begin[line], self.n_tokens[line])]
        first, n = self.table.column("first")[tokens], self.table.column("n_words")[tokens]
        return self.table.column("hashes")[ranges(first, n)]
