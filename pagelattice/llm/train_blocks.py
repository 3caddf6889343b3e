"""Trains the block model: python -m pagelattice.llm.train_blocks TABLES_FOLDER [PAGES].

The tables carry no labels, so rules label a bounded sample of pages (PAGES,
4,000 by default) of sites with enough pages to tell what repeats. The rules
use what is only known offline: the whole site's repetition, phrase patterns
shared by many sites, and the place of the headline. The network sees neither
the patterns nor the class names it must generalise over; it has to learn from
paths, words, measures and context.
"""

from __future__ import annotations

import random
import re
import sys
from collections import Counter, defaultdict

import numpy as np

from pagelattice.functions.lines import blocks
from pagelattice.llm import block_model as M
from pagelattice.llm.chunk import Chunk

#: Upper bound of labelled pages, in all and of one crawl.
SAMPLE, PER_CRAWL = 4000, 30
#: Shares of lines whose word or path vector is hidden in training, so that neither alone decides.
HIDE_WORDS, HIDE_PATH = 0.65, 0.4
_DIGITS = re.compile(r"\d+")
# How dates, counters, breadcrumbs and teasers begin in the four languages.
_META = re.compile(
    r"^(?:posted on|veröffentlicht am|publié le|publicado el|page \d+ of|seite \d+ von|page \d+ sur|página \d+ de"
    r"|you are here|sie sind hier|vous êtes ici|está aquí|read next|weiterlesen|à lire ensuite|siga leyendo"
    r"|©|by the .* editorial|written by|reviewed by|built with)\b",
    re.I,
)
_CELL = ("td", "th", "dt", "dd", "blockquote", "pre")


def weak_labels(page: list, common: set, site: dict, brand: str) -> list[int] | None:
    """1 for main lines, by rule; None for pages without a headline."""
    leafs = [p.rpartition("/")[2].partition(".")[0] for _, p, _ in page]
    if "h1" not in leafs:
        return None
    h1 = leafs.index("h1")
    base = M.container(page[h1][1])
    out = []
    for i, (text, path, _) in enumerate(page):
        leaf = leafs[i]
        sentence = text[-1] in ".!?…" and len(text) > 40
        if i == h1:
            out.append(1)
            continue
        if i < h1 or not path.startswith(base) or _META.search(text):
            out.append(0)
            continue
        steps = path[len(base) + 1 :].split("/")
        up = steps[-2].partition(".")[0] if len(steps) > 1 else ""
        if leaf in _CELL or leaf in ("h1", "h2"):
            out.append(1)
        elif leaf == "li" and not any("nav" in s for s in steps):
            out.append(1)
        elif masked(text, brand) in common or site.get(text, 0) > 1:
            out.append(0)
        elif up in ("div", "section", "article", "aside") and leaf in ("p", "div", "h3", "section") and not sentence:
            out.append(0)
        else:
            out.append(1)
    return out


def masked(text: str, brand: str) -> str:
    text = _DIGITS.sub("0", text)
    return re.sub(re.escape(brand), "BRAND", text, flags=re.I) if brand else text


def sample(folder: str, limit: int) -> tuple[list, list, list, list]:
    """(pages, supports, labels, crawls) for training."""
    import pandas as pd

    df = pd.read_parquet(f"{folder}/pages.parquet", columns=["crawl_id", "url", "html"])
    df = df[df.html.notna()]
    pages = [blocks(h) for h in df.html]
    brands = [re.sub(r"^https?://(?:www\.|shop\.|blog\.)?", "", u).split("/")[0].split(".")[0].split("-")[0] for u in df.url]
    count: dict = defaultdict(Counter)
    heads: dict = defaultdict(set)
    size = Counter(df.crawl_id)
    spread: dict = defaultdict(set)
    for c, p, b in zip(df.crawl_id, pages, brands):
        head = next((t for t, q, _ in p if q.rpartition("/")[2].startswith("h1")), "")
        for t in {t for t, _, _ in p}:
            count[c][t] += 1
            heads[c, t].add(head)
            if len(t) < 90:
                spread[masked(t, b)].add(c)
    common = {t for t, cs in spread.items() if len(cs) >= 5 and not t.startswith(("Update ", "Tags:"))}
    todo = [i for i, c in enumerate(df.crawl_id) if size[c] >= 30]
    random.Random(5).shuffle(todo)
    out: tuple[list, list, list, list] = ([], [], [], [])
    crawl = list(df.crawl_id)
    taken: Counter = Counter()
    for i in todo:
        c = crawl[i]
        if taken[c] >= PER_CRAWL:
            continue
        if sum(len(t) > 40 and t[-1:] in ".!?…" and count[c][t] < 4 for t, _, _ in pages[i]) < 3:
            continue  # residue, spam and stubs teach nothing about main content
        need = max(5, 0.1 * size[c])
        site = {t: n for t, n in count[c].items() if n >= need and len(heads[c, t]) >= 5}
        got = weak_labels(pages[i], common, site, brands[i])
        if got:
            out[0].append(pages[i])
            out[1].append(support_of(count[c], size[c]))
            out[2].append(got)
            taken[c] += 1
            out[3].append(c)
        if len(out[0]) >= limit:
            break
    return out


_support: dict = {}


def support_of(count: Counter, size: int) -> dict:
    """As the operator gives it: lines on at least 3 pages and 4 % of the crawl."""
    if id(count) not in _support:
        _support[id(count)] = {t: (n / size, n) for t, n in count.items() if n >= 3 and n >= 0.04 * size}
    return _support[id(count)]


def _back(keep: list, wh: np.ndarray, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the input gates and of the recurrent weights."""
    k = wh.shape[0]
    pre = np.zeros((len(keep), grad.shape[1], 4 * k), np.float32)
    dwh = np.zeros_like(wh)
    dh = np.zeros((grad.shape[1], k), np.float32)
    dc = np.zeros_like(dh)
    for t in range(len(keep) - 1, -1, -1):
        i, f, o, z, c, tc, h, m = keep[t]
        dh = dh + grad[t]
        mh = np.where(m, dh, 0)
        mc = np.where(m, dc, 0) + mh * o * (1 - tc * tc)
        g = np.concatenate(
            [mc * z * i * (1 - i), mc * c * f * (1 - f), mh * tc * o * (1 - o), mc * i * (1 - z * z)], axis=1
        )
        pre[t] = g
        dwh += h.T @ g
        dh = np.where(m, g @ wh.T, dh)
        dc = np.where(m, mc * f, dc)
    return pre, dwh


def train(pages: list, supports: list, labels: list, epochs: int = 18, lanes: int = 48, rate: float = 0.01) -> dict:
    rng = np.random.default_rng(3)
    k = M.HIDDEN

    def init(*s: int) -> np.ndarray:
        return rng.normal(0, 1 / max(1, s[0]) ** 0.5, s).astype(np.float32)

    w = {
        "path": rng.normal(0, 0.1, (M.N_PATH, M.E_PATH)).astype(np.float32),
        "word": rng.normal(0, 0.1, (M.N_WORD, M.E_WORD)).astype(np.float32),
        "xf": init(M.N_IN, 4 * k), "xb": init(M.N_IN, 4 * k), "hf": init(k, 4 * k), "hb": init(k, 4 * k),
        "bf": np.zeros(4 * k, np.float32), "bb": np.zeros(4 * k, np.float32),
        "of": init(k), "ob": init(k), "ox": init(M.N_IN) * 0.1, "o0": np.zeros((), np.float32),
    }
    m1 = {a: np.zeros_like(v) for a, v in w.items()}
    m2 = {a: np.zeros_like(v) for a, v in w.items()}
    feats = [M.features(Chunk([p]), [s.get(t) for t, _, _ in p]) for p, s in zip(pages, supports)]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(pages))
        order = order[np.argsort([len(pages[i]) // 8 for i in order], kind="stable")]
        batches = [order[a : a + lanes] for a in range(0, len(order), lanes)]
        rng.shuffle(batches)
        loss = wrong = seen = 0.0
        lr = rate * (1 - epoch / epochs)
        for batch in batches:
            step += 1
            got = M.Features(*(np.concatenate(x) for x in zip(*(feats[i] for i in batch))))
            ys = [y for i in batch for y in labels[i]]
            sizes = [len(labels[i]) for i in batch]
            flat_x = M.inputs(w, got)
            seen_words = (rng.random(len(flat_x)) >= HIDE_WORDS)[:, None]
            seen_path = (rng.random(len(flat_x)) >= HIDE_PATH)[:, None]
            flat_x[:, : M.E_PATH] *= seen_path
            flat_x[:, M.E_PATH : M.E_PATH + M.E_WORD] *= seen_words
            x, mask = M.pad(flat_x, sizes)
            y, _ = M.pad(np.array(ys, np.float32)[:, None], sizes)
            kf, kb = [], []
            fwd = M.recur(x @ w["xf"] + w["bf"], w["hf"], mask, kf)
            bwd = M.recur((x @ w["xb"] + w["bb"])[::-1], w["hb"], mask[::-1], kb)[::-1]
            s = fwd @ w["of"] + bwd @ w["ob"] + x @ w["ox"] + w["o0"]
            p = M._sigmoid(s)
            d = np.where(mask, p - y[..., 0], 0).astype(np.float32)
            wrong += ((p > 0.5) != (y[..., 0] > 0.5))[mask].sum()
            seen += mask.sum()
            d /= mask.sum()
            gf, ghf = _back(kf, w["hf"], d[..., None] * w["of"])
            gb, ghb = _back(kb, w["hb"], (d[..., None] * w["ob"])[::-1])
            gb = gb[::-1]
            dx = gf @ w["xf"].T + gb @ w["xb"].T + d[..., None] * w["ox"]
            flat = np.concatenate([dx[:n, j] for j, n in enumerate(sizes)])
            g = {
                "xf": np.einsum("tbi,tbo->io", x, gf), "xb": np.einsum("tbi,tbo->io", x, gb), "hf": ghf, "hb": ghb,
                "bf": gf.sum((0, 1)), "bb": gb.sum((0, 1)), "of": np.einsum("tb,tbk->k", d, fwd),
                "ob": np.einsum("tb,tbk->k", d, bwd), "ox": np.einsum("tb,tbi->i", d, x), "o0": d.sum(),
                "path": np.zeros_like(w["path"]), "word": np.zeros_like(w["word"]),
            }
            for col in range(got.paths.shape[1]):
                np.add.at(g["path"], got.paths[:, col], flat[:, : M.E_PATH] * seen_path / got.paths.shape[1])
            n_words = got.word_counts
            np.add.at(
                g["word"],
                got.words,
                np.repeat(flat[:, M.E_PATH : M.E_PATH + M.E_WORD] * seen_words / n_words[:, None], n_words, axis=0),
            )
            for a in w:
                m1[a] = 0.9 * m1[a] + 0.1 * g[a]
                m2[a] = 0.999 * m2[a] + 0.001 * g[a] ** 2
                w[a] = (
                    w[a] - lr * (m1[a] / (1 - 0.9**step)) / (np.sqrt(m2[a] / (1 - 0.999**step)) + 1e-8) - 1e-5 * lr * w[a]
                ).astype(np.float32)
            loss += float(-(np.log(np.where(y[..., 0] > 0.5, p, 1 - p) + 1e-7))[mask].sum())
        print(f"epoch {epoch}: loss {loss / seen:.5f}, wrong {wrong / seen:.5%}", flush=True)
    return w


def main(folder: str, limit: int = SAMPLE) -> None:
    pages, supports, labels, crawls = sample(folder, limit)
    # Whole crawls are held out: what repeats on a site must not be known from training.
    out = [i for i, c in enumerate(crawls) if c % 6 == 0]
    kept = [i for i, c in enumerate(crawls) if c % 6]
    print(f"{len(pages)} pages, {len(out)} held out, share of main lines {np.mean([y for l in labels for y in l]):.3f}")
    w = train(*([x[i] for i in kept] for x in (pages, supports, labels)))
    got = M.label(w, Chunk([pages[i] for i in out]), [supports[i].get(t) for i in out for t, _, _ in pages[i]])
    wrong = int((got != np.array([y for i in out for y in labels[i]], bool)).sum())
    print(f"held out: {wrong} of {sum(len(labels[i]) for i in out)} lines differ")
    np.savez_compressed(M.WEIGHTS, **{k: v.astype(np.float16) for k, v in w.items()})


if __name__ == "__main__":
    main(sys.argv[1], *(int(x) for x in sys.argv[2:3]))
