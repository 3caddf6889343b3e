"""One pass over the parsed pages that serves the residue, spam and main-content operators.

The pass needs to know which lines a site repeats, so these are counted first;
the counts travel to the pages as one array per crawl. Copied pages share their
content too. Pages with few words of their own are therefore set aside and
judged by the lines that the other pages share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagelattice.llm import block_model, redundancy, residue_rules
from pagelattice.llm.chunk import Chunk
from pagelattice.llm.parsed import CHUNK, line_counts, unpack
from pagelattice.session import durable, small_side

#: A line is the site's, not the page's, from so many pages and this share of the crawl.
SITE_PAGES, SITE_SHARE = 3, 0.04
#: With less of its words on lines of its own, a page may be a copy: only lines that so many other pages hold are the site's.
OWN_PART = 0.5
#: With fewer words of its own even then, a page's redundancy is measured on all its lines.
OWN_WORDS = 10
#: Crawls whose counts a task keeps at hand.
SITES = 64

_FACTS = (
    "page_id bigint, crawl_id bigint, lang string, words int, proper int, distinct_words int,"
    " sizes array<int>, packed array<int>, reals int,"
    " messages array<struct<text string, kind string, strong boolean, real boolean>>"
)
_MESSAGE = pa.struct([("text", pa.string()), ("kind", pa.string()), ("strong", pa.bool_()), ("real", pa.bool_())])
_TYPES = (pa.string(), *[pa.int32()] * 3, pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.list_(_MESSAGE))
_PARSED = ("hashes", "text", "paths", "place", "linked")


def site_support(parsed: DataFrame, min_pages: int = SITE_PAGES, min_share: float = SITE_SHARE) -> DataFrame:
    """(crawl_id, keys, counts, size): per crawl, the hashes of lines its pages share, and on how many pages each stands.

    At most (mean lines of a page) / min_share entries per crawl.
    """
    counts = durable(line_counts(parsed).where((F.col("a") == 0) | (F.col("support") >= min_pages)))
    sizes = counts.where("a = 0").select("crawl_id", F.col("support").alias("size"))
    return durable(
        counts.where("a <> 0")
        .join(small_side(sizes), "crawl_id")
        .where(F.col("support") >= min_share * F.col("size"))
        .groupBy("crawl_id")
        .agg(
            F.collect_list(F.struct("a", F.col("support").cast("int").alias("n"))).alias("x"),
            F.max("size").alias("size"),
        )
        .select("crawl_id", F.col("x.a").alias("keys"), F.col("x.n").alias("counts"), "size")
    )


class Sites:
    """The share of the crawl of each shared line, by crawl; a bounded number of crawls is kept between batches."""

    def __init__(self) -> None:
        self._tables: dict[int | None, dict[int, tuple[float, int]]] = {None: {}}

    def of(self, batch: pa.RecordBatch, row: int, crawl: int | None, first: int) -> dict[int, tuple[float, int]]:
        """The table of a row's crawl; keys, counts and size stand in the columns from number `first` on."""
        got = self._tables.get(crawl)
        if got is None:
            if len(self._tables) > SITES:
                self._tables = {None: {}}
            keys, counts, size = (batch.column(first + i)[row].as_py() for i in range(3))
            got = self._tables[crawl] = {k: (n / size, n) for k, n in zip(keys or (), counts or ())}
        return got


def _real(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(lines that read as sentences and are long enough, lines that consist of proper sentences)."""
    ends = np.array([t[-1] in redundancy.ENDS for t in chunk.texts], bool)
    fair = ends & (chunk.of_lines("function") >= redundancy.SENTENCE_SHARE * chunk.n_tokens)
    proper = np.zeros(len(fair), bool)
    for i in np.flatnonzero(fair & (chunk.n_tokens >= redundancy.SENTENCE_WORDS)).tolist():
        t = chunk.texts[i]
        proper[i] = chunk.n_tokens[i] >= redundancy.SENTENCE_WORDS * (1 + t.count(". ") + t.count("! ") + t.count("? "))
    return fair & (chunk.sizes >= residue_rules.REAL_CHARS), proper


_classified: dict[str, tuple[str, str, bool] | None] = {}


def _residue(text: str) -> tuple[str, str, bool] | None:
    """(normalised message, kind, strong) of a line that is residue."""
    if text not in _classified:
        if len(_classified) > 100_000:
            _classified.clear()
        message = residue_rules.normalise(text)
        got = residue_rules.classify(message)
        _classified[text] = (message, *got) if got else None
    return _classified[text]


def facts_of(chunk: Chunk, known: np.ndarray) -> list[list]:
    """The facts' columns from `lang` on, of the pages of a chunk; known marks the site's lines."""
    n = len(chunk.pages)
    own = ~known
    real, proper = _real(chunk)
    # Residue may stand on the site's lines too: a template that fails, fails on many pages.
    may = (chunk.n_tokens < 2) | ((chunk.n_tokens <= residue_rules.SHORT) & (chunk.of_lines("short") > 0))
    may[list(residue_rules.with_needs(list(map(str.lower, chunk.texts))))] = True
    grams = chunk.of_lines("grams")
    may |= (grams > 0) & (chunk.of_lines("foreign") == 0) & residue_rules.is_latin(grams, chunk.of_lines("latin"))
    messages: list[dict[str, dict]] = [{} for _ in range(n)]
    for i in np.flatnonzero(may).tolist():
        text = chunk.texts[i]
        if (got := _residue(text)) is not None:
            held = messages[chunk.page[i]].setdefault(text, {"text": got[0], "kind": got[1], "strong": got[2], "real": False})
            held["real"] |= bool(real[i] and own[i])
    at = np.flatnonzero(real & own)
    reals = np.bincount(np.array([p for p, _ in {(int(chunk.page[i]), chunk.texts[i]) for i in at}], np.int64), minlength=n)
    words = chunk.per_page(chunk.n_tokens, own)
    counted = own | (words < OWN_WORDS)[chunk.page]
    words = chunk.per_page(chunk.n_tokens, counted)
    in_proper = chunk.per_page(chunk.n_tokens, counted & proper)
    page, token = chunk.distinct(counted)
    kinds = np.bincount(page, minlength=n)
    tells = chunk.table.column("tells")[token]
    votes = np.zeros((n, len(redundancy.LANGUAGES)), np.int64)
    np.add.at(votes, (page, tells), 1)
    votes[:, 0] = 0
    lang = [redundancy.LANGUAGES[i] if v[i] else "" for i, v in zip(votes.argmax(1).tolist(), votes)]
    sizes, packed = [], []
    begin = 0
    for lines in chunk.pages:
        mine = [(t, p) for (t, p, _), c in zip(lines, counted[begin : begin + len(lines)].tolist()) if c]
        begin += len(lines)
        got = [redundancy.deflated(b) for b in redundancy.text_blocks(mine)]
        sizes.append([a for a, _ in got])
        packed.append([b for _, b in got])
    return [lang, words.tolist(), in_proper.tolist(), kinds.tolist(), sizes, packed, reals.tolist(), [list(m.values()) for m in messages]]


class Extra(NamedTuple):
    """Columns made in the same pass from the main lines: their DDL, and a function of a chunk and a mask of its main lines."""

    fields: str
    make: Callable[[Chunk, np.ndarray], list[pa.Array]]


def _names(fields: str) -> list[str]:
    return [f.name for f in StructType.fromDDL(fields).fields]


def shared_by_others(aside: DataFrame, support: DataFrame) -> DataFrame:
    """(crawl_id, keys): per crawl, the lines of the pages set aside that are the site's by its other pages alone."""
    pages = durable(aside.groupBy("crawl_id").agg(F.count(F.lit(1)).alias("aside")))
    held = aside.select("crawl_id", F.explode("shared").alias("a")).groupBy("crawl_id", "a").agg(F.count(F.lit(1)).alias("held"))
    others = F.col("n") - F.col("held")
    return (
        support.join(small_side(pages), "crawl_id")
        .select("crawl_id", "size", "aside", F.explode(F.arrays_zip("keys", "counts")).alias("x"))
        .select("crawl_id", "size", "aside", F.col("x.keys").alias("a"), F.col("x.counts").alias("n"))
        .join(held, ["crawl_id", "a"])
        .where((others >= SITE_PAGES) & (others >= SITE_SHARE * (F.col("size") - F.col("aside"))))
        .groupBy("crawl_id")
        .agg(F.collect_list("a").alias("keys"))
    )


def page_facts(parsed: DataFrame, support: DataFrame, extra: Extra | None = None) -> DataFrame:
    """Per page with html: word and sentence counts, block sizes raw and compressed, and its residue messages; durable.

    With extra, the block labeller reads every page too, and the columns made
    from the main lines follow. Pages with few words of their own are judged in
    a second pass over these pages alone: copies of a page share all their
    lines, so what these share with each other is not yet the site's.
    """
    names = _names(_FACTS)
    more = _names(extra.fields) if extra else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sites = Sites()
        weights = block_model.load() if extra else None
        for whole in batches:
            for start in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(start, CHUNK)
                crawls = batch.column(1).to_pylist()
                hashes, pages = unpack(batch, 2)
                tables = [sites.of(batch, i, c, 7) for i, c in enumerate(crawls)]
                chunk = Chunk(pages)
                shares = [t.get(h) for t, found in zip(tables, hashes) for h in found]
                known = np.array([s is not None for s in shares], bool)
                few = chunk.per_page(chunk.n_tokens, ~known) < OWN_PART * chunk.per_page(chunk.n_tokens)
                few &= chunk.per_page(known.astype(np.int64)) > 0
                aside = [list({h for h in found if h in t}) if f else None for f, t, found in zip(few, tables, hashes)]
                cols = [pa.array([None if f else v for f, v in zip(few, c)], t) for c, t in zip(facts_of(chunk, known), _TYPES)]
                if extra:
                    cols += extra.make(chunk, block_model.label(weights, chunk, shares))
                yield pa.record_batch([*batch.columns[:2], *cols, pa.array(aside, pa.list_(pa.int64()))], names=[*names, *more, "shared"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int | None, frozenset] = {}
        for whole in batches:
            for start in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(start, CHUNK)
                known = []
                hashes, pages = unpack(batch, 2)
                for i, (crawl, found) in enumerate(zip(batch.column(1).to_pylist(), hashes)):
                    if crawl not in tables:
                        if len(tables) > SITES:
                            tables.clear()
                        tables[crawl] = frozenset(batch.column(7)[i].as_py() or ())
                    known += [h in tables[crawl] for h in found]
                made = facts_of(Chunk(pages), np.array(known, bool))
                cols = [pa.array(c, t) for c, t in zip(made, _TYPES)]
                yield pa.record_batch([*batch.columns[:2], *cols, *batch.columns[8:]], names=[*names, *more])

    fields = f"{_FACTS}, {extra.fields}" if extra else _FACTS
    side = small_side(support)
    first = durable(
        parsed.join(side, "crawl_id", "left")
        .select("page_id", "crawl_id", *_PARSED, "keys", "counts", "size")
        .mapInArrow(run, f"{fields}, shared array<bigint>")
    )
    aside = first.where("shared is not null")
    others = durable(shared_by_others(aside, support))
    # Rows stored twice have ids of their own; the few pages set aside meet their parsed lines by id.
    few = durable(aside.select("page_id", *more))
    held = [F.col(c).alias(f"parsed_{c}") for c in _PARSED]  # the extra columns may have the same names
    judged = (
        parsed.select("page_id", "crawl_id", *held)
        .join(small_side(few), "page_id")
        .join(small_side(others), "crawl_id", "left")
        .select("page_id", "crawl_id", *(f"parsed_{c}" for c in _PARSED), "keys", *more)
        .mapInArrow(again, fields)
    )
    return first.where("shared is null").select(*names, *more).unionAll(durable(judged))
