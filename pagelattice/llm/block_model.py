"""Bidirectional LSTM over a page's lines, in numpy.

Each line (a leaf of the page) is one step. Its input joins the mean vector of
its hashed tag-path steps, the mean vector of its hashed words, and a few
measures (length, links, place, share of the site's pages with this line). The
network reads the whole page in both directions, so every label depends on the
whole document. Weights come from `train_blocks.py`.
"""

from __future__ import annotations

import re
import zlib
from pathlib import Path
from typing import NamedTuple

import numpy as np

from pagelattice.llm.chunk import Chunk, ranges

N_PATH, N_WORD, E_PATH, E_WORD, N_NUM, HIDDEN = 512, 4096, 8, 8, 16, 12
N_IN = E_PATH + E_WORD + N_NUM
WEIGHTS = Path(__file__).with_name("block_weights.npz")
#: Pages that run through the recurrence side by side.
LANES = 256

_ids: dict[str, int] = {}


def _id(text: str, size: int) -> int:
    got = _ids.get(text)
    if got is None:
        if len(_ids) > 400_000:
            _ids.clear()
        got = _ids[text] = zlib.crc32(text.encode("utf-8", "replace"))
    return got % size


def _path_ids(path: str) -> tuple[int, int, int, int]:
    steps = path.split("/")
    leaf, parent, above = steps[-1], steps[-2] if len(steps) > 1 else "", steps[-3] if len(steps) > 2 else ""
    tags = "/".join(s.partition(".")[0] for s in steps[-4:])
    return (
        _id("0" + leaf, N_PATH),
        _id("1" + parent, N_PATH),
        _id("2" + above, N_PATH),
        _id("3" + tags, N_PATH),
    )


_paths: dict[str, tuple[tuple[int, int, int, int], bool, bool]] = {}
_DIGIT = re.compile(r"\d")


_END = frozenset('.!?…»”"')
HEADS = ("h2", "h3", "h4", "h5", "h6")


def container(path: str) -> str:
    """The element that holds the headline: its parent, or the next one above a plain wrapper."""
    up = path.rpartition("/")[0]
    return up.rpartition("/")[0] if up.endswith("/div") and up.count("/") > 3 else up


def _path_of(path: str) -> tuple[tuple[int, int, int, int], bool, bool]:
    """(ids, is a headline, is a subheading) of a path."""
    if len(_paths) > 100_000:
        _paths.clear()
    tag = path.rpartition("/")[2].partition(".")[0]
    got = _paths[path] = _path_ids(path), tag == "h1", tag in HEADS
    return got


class Features(NamedTuple):
    """Of all lines of some pages, one after the other."""

    nums: np.ndarray  # [lines, N_NUM] measures
    paths: np.ndarray  # [lines, 4] ids of path steps
    words: np.ndarray  # ids of all words
    word_counts: np.ndarray  # [lines] words of each line


def features(chunk: Chunk, shares: list[tuple[float, int] | None]) -> Features:
    """Measures, path ids and word ids of each line; shares holds a line's share and number of the site's pages."""
    pages, counts, texts, size, page = chunk.pages, chunk.counts, chunk.texts, chunk.sizes, chunk.page
    total = len(texts)
    table: dict[str, int] = {}
    at = np.array([table.setdefault(q, len(table)) for p in pages for _, q, _ in p], np.int64)
    linked = np.array([n for p in pages for _, _, n in p], np.float64)
    share, held = np.array([s or (0.0, 0) for s in shares], np.float64).reshape(total, 2).T
    known = [_paths.get(q) or _path_of(q) for q in table]
    names = list(table)
    ids = np.array([k[0] for k in known], np.int64).reshape(-1, 4)
    is_h1, is_head = (np.array([k[i] for k in known], bool)[at] for i in (1, 2))
    begin = np.cumsum(counts) - counts
    index = np.arange(total) - begin[page]
    # The first headline of each page; -1 where there is none.
    h1 = np.full(len(pages), -1, np.int64)
    where = np.flatnonzero(is_h1)[::-1]
    h1[page[where]] = index[where]
    bases: dict[str | None, int] = {None: 0}
    base = np.zeros(len(pages), np.int64)
    for p in np.flatnonzero(h1 >= 0).tolist():
        base[p] = bases.setdefault(container(pages[p][h1[p]][1]), len(bases))
    held_bases = list(bases)
    pair, back = np.unique(base[page] * len(names) + at, return_inverse=True)
    inside = [b is not None and names[i % len(names)].startswith(b) for i in pair.tolist() for b in (held_bases[i // len(names)],)]
    _, cell = np.unique(page * max(len(names), 1) + at, return_inverse=True)
    chars = np.bincount(cell, weights=size)[cell] if total else np.zeros(0)
    of_page = np.bincount(page, weights=size, minlength=len(pages))[page]
    nums = np.empty((total, N_NUM), np.float32)
    for k, column in enumerate(
        (
            np.frexp(size)[1] / 8,
            np.array([t[-1] in _END for t in texts], bool),
            np.minimum(1.0, linked / np.maximum(size, 1)),
            share,
            np.sqrt(np.minimum(held, 64)) / 8,
            is_h1,
            is_head,
            index / counts[page],
            np.array(inside, bool)[back] if total else np.zeros(0, bool),
            index < h1[page],
            [len(_DIGIT.findall(t)) / n if n < 80 else 0.0 for t, n in zip(texts, size.tolist())],
            np.array(["»" in t or "|" in t for t in texts], bool),
            np.r_[False, (at[1:] == at[:-1]) & (page[1:] == page[:-1])][:total],
            chars / np.maximum(of_page, 1),
            np.frexp(chunk.n_tokens)[1] / 6,
            h1[page] >= 0,
        )
    ):
        nums[:, k] = column
    words = chunk.table.column("crc")[chunk.tokens] % N_WORD if total else np.zeros(0, np.int64)
    return Features(nums, ids[at] if total else np.zeros((0, 4), np.int64), words, chunk.n_tokens)


def inputs(w: dict, f: Features) -> np.ndarray:
    """One input row per line."""
    x = np.empty((len(f.nums), N_IN), np.float32)
    x[:, :E_PATH] = w["path"][f.paths].mean(1)
    starts = np.cumsum(f.word_counts) - f.word_counts
    if len(x):
        x[:, E_PATH : E_PATH + E_WORD] = np.add.reduceat(w["word"][f.words], starts, axis=0) / f.word_counts[:, None]
    x[:, E_PATH + E_WORD :] = f.nums
    return x


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-v))


def recur(pre: np.ndarray, wh: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states [steps, lanes, hidden] from input gates [steps, lanes, 4 hidden]; padding carries the state on."""
    steps, lanes, _ = pre.shape
    k = wh.shape[0]
    h = np.zeros((lanes, k), np.float32)
    c = np.zeros((lanes, k), np.float32)
    out = np.empty((steps, lanes, k), np.float32)
    for t in range(steps):
        g = pre[t] + h @ wh
        s = _sigmoid(g[:, : 3 * k])
        z = np.tanh(g[:, 3 * k :])
        i, f, o = s[:, :k], s[:, k : 2 * k], s[:, 2 * k :]
        m = mask[t][:, None]
        c_new = f * c + i * z
        tc = np.tanh(c_new)
        h_new = o * tc
        if keep is not None:
            keep.append((i, f, o, z, c, tc, h, m))
        c = np.where(m, c_new, c)
        h = np.where(m, h_new, h)
        out[t] = h
    return out


def pad(x: np.ndarray, sizes: list[int] | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[steps, lanes, inputs] and the mask of real steps, from the rows of consecutive pages."""
    sizes = np.asarray(sizes)
    mask = np.arange(sizes.max())[None, :] < sizes[:, None]  # [lanes, steps]
    out = np.zeros((*mask.shape, x.shape[1]), np.float32)
    out[mask] = x
    return np.ascontiguousarray(out.transpose(1, 0, 2)), np.ascontiguousarray(mask.T)


def scores(w: dict, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Logit of "main" per step and lane; both directions take each step together."""
    steps, lanes, _ = x.shape
    k = w["hf"].shape[0]
    # A logistic gate is a tanh of half the input, so that one tanh serves all gates.
    half = np.r_[np.full(3 * k, 0.5), np.ones(k)].astype(np.float32)
    pre = np.empty((steps, 2, lanes, 4 * k), np.float32)
    pre[:, 0] = (x @ w["xf"] + w["bf"]) * half
    pre[:, 1] = ((x @ w["xb"] + w["bb"]) * half)[::-1]
    wh = np.stack([w["hf"], w["hb"]]) * half
    open_ = np.stack([mask, mask[::-1]], 1)[..., None]
    h = np.zeros((2, lanes, k), np.float32)
    c = np.zeros((2, lanes, k), np.float32)
    out = np.empty((steps, 2, lanes, k), np.float32)
    for t in range(steps):
        g = np.matmul(h, wh)
        g += pre[t]
        np.tanh(g, out=g)
        s = g[..., : 3 * k]
        s *= 0.5
        s += 0.5
        c_new = s[..., k : 2 * k] * c
        c_new += s[..., :k] * g[..., 3 * k :]
        h_new = np.tanh(c_new)
        h_new *= s[..., 2 * k :]
        if open_[t].all():
            c, h = c_new, h_new
        else:
            c = np.where(open_[t], c_new, c)
            h = np.where(open_[t], h_new, h)
        out[t] = h
    return out[:, 0] @ w["of"] + out[::-1, 1] @ w["ob"] + x @ w["ox"] + w["o0"]


def load(path: Path = WEIGHTS) -> dict:
    with np.load(path) as f:
        return {k: f[k].astype(np.float32) for k in f.files}


def label(w: dict, chunk: Chunk, shares: list[tuple[float, int] | None]) -> np.ndarray:
    """A boolean per line of the chunk: belongs to the main content."""
    out = np.zeros(len(chunk.texts), bool)
    if not len(out):
        return out
    x = inputs(w, features(chunk, shares))
    begin = np.cumsum(chunk.counts) - chunk.counts
    order = np.argsort(chunk.counts, kind="stable")
    order = order[chunk.counts[order] > 0]
    for at in range(0, len(order), LANES):
        lanes = order[at : at + LANES]
        sizes = chunk.counts[lanes]
        rows = ranges(begin[lanes], sizes)
        padded, mask = pad(x[rows], sizes)
        out[rows] = scores(w, padded, mask).T[mask.T] > 0
    return out
