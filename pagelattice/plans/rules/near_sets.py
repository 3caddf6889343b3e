"""Near copies among the pages of an audit: trigram sets and their exact join in memory.

A block of pages travels as packed texts, a tenth of what its trigrams take; the
sets are made where they are joined.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bits of a set's parity map; join rows and pairs handled together.
BITS, ROWS, PAIRS = 1024, 1 << 21, 1 << 17


def mix(x: np.ndarray) -> np.ndarray:
    """The last steps of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def trigram_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sizes): the distinct runs of three words of each text, ascending by text; words are parted by one blank."""
    lists = pc.split_pattern(texts.cast(pa.large_string()), " ")
    words = lists.flatten().dictionary_encode()
    names = words.dictionary.to_pylist()
    known = np.frombuffer(b"".join(hashlib.blake2b(w.encode(), digest_size=8).digest() for w in names), dtype="<u8")
    h = known[words.indices.to_numpy(zero_copy_only=False)] if names else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    if len(h) < 3:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    run = mix(mix(mix(h[:-2]) + h[1:-1]) + h[2:])
    inside = owner[:-2] == owner[2:]
    run, owner = run[inside], owner[:-2][inside]
    order = np.lexsort((run, owner))
    run, owner = run[order], owner[order]
    new = np.ones(len(run), bool)
    new[1:] = (run[1:] != run[:-1]) | (owner[1:] != owner[:-1])
    return run[new], np.bincount(owner[new], minlength=len(texts))


def _parity(bit: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Per set, which bits an odd number of its members has: two sets differ in at least as many members as bits."""
    n = len(start) - 1
    out = np.zeros((n, BITS // 64), np.uint64)
    for at in range(0, n, 2048):
        to = min(at + 2048, n)
        row = np.repeat(np.arange(to - at), np.diff(start[at : to + 1]))
        odd = np.bincount(row * BITS + bit[start[at] : start[to]], minlength=(to - at) * BITS).astype(np.uint8) & 1
        out[at:to] = np.packbits(odd.reshape(to - at, BITS), axis=1).view(np.uint64)
    return out


def levels(place: np.ndarray, side: np.ndarray, texts: pa.Array, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """(level, size) of each text: 2 if an earlier one's set has a Jaccard similarity over `high`, 1 over `low`, else 0.

    `place` is the rank in crawl order. With texts of two sides, only those of different sides are compared, but
    equal sets always are. Exact, by prefix filtering: with the members in one order, rare ones first, sets of
    similarity `low` share one early in both, at places that leave enough members after them; pairs found so are
    ruled out only by their parity maps, then compared. A later text that has its highest level is not compared again.
    """
    member, size = trigram_sets(texts)
    level = np.zeros(len(size), np.int8)
    start = np.r_[0, np.cumsum(size)]
    seen: dict[bytes, int] = {}
    for i in np.argsort(place, kind="stable").tolist():
        if size[i] and seen.setdefault(hashlib.blake2b(member[start[i] : start[i + 1]].tobytes(), digest_size=16).digest(), i) != i:
            level[i] = 2
    firsts = np.array(sorted(seen.values()), np.int64)
    firsts = firsts[np.argsort(size[firsts], kind="stable")]
    if len(firsts) < 2:
        return level, size
    # From here on, sets are the first ones of their class, numbered by size.
    n, place, side = size[firsts], place[firsts], side[firsts].astype(np.int64)
    taken = np.repeat(start[firsts] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
    member = member[taken]
    start = np.r_[0, np.cumsum(n)]
    parity = _parity((member & np.uint64(BITS - 1)).astype(np.int64), start)
    order = np.argsort(member)
    ranked = member[order]
    new = np.r_[True, ranked[1:] != ranked[:-1]]
    df = np.diff(np.r_[np.flatnonzero(new), len(ranked)])
    rank = np.empty(len(df), np.int32)
    rank[np.argsort(df, kind="stable")] = np.arange(len(df), dtype=np.int32)
    inverse = np.empty(len(member), np.int32)
    inverse[order] = (np.cumsum(new) - 1).astype(np.int32)
    del order, ranked, new, taken, member
    owner = np.repeat(np.arange(len(n), dtype=np.int64), n)
    key = (owner << 32) | rank[inverse]
    key.sort()
    sets = (key & 0xFFFFFFFF).astype(np.int32)
    del key, inverse, rank
    pos = np.arange(len(sets)) - start[owner]
    share = low / (1 + low)

    def needed(total: np.ndarray) -> np.ndarray:
        """Members that sets of so many in all must share."""
        return np.ceil(share * total - 1e-9).astype(np.int64)

    probe = np.flatnonzero(pos <= (n - np.ceil(low * n - 1e-9))[owner])
    held = np.flatnonzero(pos <= (n - needed(2 * n))[owner])
    indexed = (sets[held].astype(np.int64) << 33) | (side[owner[held]] << 32) | owner[held]
    by = np.argsort(indexed)
    indexed, x_at = indexed[by], held[by]
    y = owner[probe]
    other = 1 - side[y] if side.any() and not side.all() else side[y]
    base = (sets[probe].astype(np.int64) << 33) | (other << 32)
    least = np.searchsorted(n, np.ceil(low * n - 1e-9), "left")
    begin = np.searchsorted(indexed, base | least[y])
    count = np.searchsorted(indexed, base | y) - begin
    some = np.flatnonzero(count > 0)
    probe, begin, count = probe[some], begin[some], count[some]
    got = np.zeros(len(n), np.int8)

    def compare(a: np.ndarray, b: np.ndarray) -> None:
        """Sets the level of the later of each pair."""
        later, earlier = np.where(place[a] > place[b], a, b), np.where(place[a] > place[b], b, a)
        by = np.argsort(later, kind="stable")
        later, earlier = later[by], earlier[by]
        nth = np.arange(len(later)) - np.searchsorted(later, later)
        done, most = 0, 1
        while len(later):
            now = nth < done + most
            for i, j in zip(later[now].tolist(), earlier[now].tolist()):
                both = len(np.intersect1d(sets[start[i] : start[i + 1]], sets[start[j] : start[j + 1]], assume_unique=True))
                s = both / (n[i] + n[j] - both)
                got[i] = max(got[i], 2 if s > high else 1 if s > low else 0)
            left = ~now & (got[later] < 2)
            later, earlier, nth = later[left], earlier[left], nth[left]
            done, most = done + most, 2 * most

    upto = np.cumsum(count)
    at = 0
    while at < len(probe):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + ROWS, "right")))
        c = count[at:to]
        p = np.repeat(probe[at:to], c)
        q = x_at[np.repeat(begin[at:to] - np.r_[0, np.cumsum(c)[:-1]], c) + np.arange(c.sum())]
        a, b = owner[p], owner[q]
        need = needed(n[a] + n[b])
        fits = (np.minimum(n[a] - pos[p], n[b] - pos[q]) >= need) & (got[np.where(place[a] > place[b], a, b)] < 2)
        pairs = np.unique((a[fits] << 32) | b[fits])
        at = to
        for k in range(0, len(pairs), PAIRS):
            a, b = pairs[k : k + PAIRS] >> 32, pairs[k : k + PAIRS] & 0xFFFFFFFF
            apart = np.bitwise_count(parity[a] ^ parity[b]).sum(axis=1, dtype=np.int64)
            near = apart <= n[a] + n[b] - 2 * needed(n[a] + n[b])
            compare(a[near], b[near])
    level[firsts] = np.maximum(level[firsts], got)
    return level, size
