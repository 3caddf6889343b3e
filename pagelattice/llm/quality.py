"""Per-document text statistics, and which documents are not running prose."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.llm.words import FUNCTION_WORDS, WORD

STATS = (
    "doc_id bigint, n_words bigint, mean_word_length double, symbol_ratio double, n_lines bigint,"
    " end_punctuation double, common_share double, function_share double, words_per_line double,"
    " field_alignment double, column_alignment double, indent_period double, length_autocorrelation double, distinct_share double,"
    " non_prose boolean"
)

_NAMES = [x.split()[0] for x in STATS.split(", ")]
# What may separate columns.
_DELIMITERS = ("\t", "|", ";", ",", "  ", "=>", "=", ":", "...", " / ", " > ")
_ENDS = (".", "!", "?", "…", '"', "»", "”", "“", "'", ")", "’")
_BULLET = re.compile(r"^\s*(?:[-*•·–—+>]|\[[ xX]?\]|\(?\d{1,3}[.)]|[a-z][.)])\s+")
#: Least share of function words in prose; entries have fewer words a line; tables align in this share of lines.
PROSE_FUNCTION, ENTRY_WORDS, ALIGNED = 0.14, 6.5, 0.6
#: Autocorrelation of indents or line lengths from which lines follow a pattern.
PERIOD = 0.5
#: Words of ordinary prose, and their share of function words, that every text is thought to have besides its own: without
#: them a few words would tell nothing. Of the lines that share a trait, one is the trait itself.
USUAL_WORDS, USUAL_FUNCTION = 4, 0.35
#: Share of lines with the same ending from which they are entries.
ALIKE = 0.5
#: Symbols beyond this share of the characters are markup, code or garbage.
SYMBOLS = 0.3


def _share(n: int, of: int) -> float:
    """The share of lines that follow the first of their kind."""
    return max(0, n - 1) / of


def _alignment(lines: list[str]) -> tuple[float, float]:
    """(by field, by column): shares of the lines that the best column separator cuts alike.

    By field: into the commonest number of fields. By column: with the separator
    at the commonest position, as in tables set with blanks.
    """
    by_field = by_column = 0.0
    n = len(lines)
    text = "\n".join(lines)
    for d in _DELIMITERS:
        if d not in text:
            continue
        counts = Counter(c for line in lines if (c := line.count(d)))
        by_field = max(by_field, _share(max(counts.values()), n))
        places: Counter[int] = Counter()
        for line in lines:
            at = line.find(d)
            while at >= 0:
                places[at] += 1
                at = line.find(d, at + len(d))
        by_column = max(by_column, _share(max(places.values()), n))
    return by_field, by_column


def _autocorrelation(x: np.ndarray) -> float:
    """Largest autocorrelation at lags up to a quarter of the lines, at most 4; a constant series has 1, one value 0.

    At each lag, the terms that a series of this length cannot have count as 0.
    """
    n = len(x)
    if n < 2:
        return 0.0
    c = x - x.mean()
    power = float(c @ c)
    if power < 1e-9:
        return _share(n, n)
    return max((float(c[lag:] @ c[:-lag]) / power for lag in range(1, min(4, n // 2) + 1)), default=0.0)


def measure(text: str, common: frozenset) -> tuple | None:
    """The statistics of one text, and whether it is not prose; None for blank text."""
    if not text or not text.strip():
        return None
    lines = [x for x in text.split("\n") if x.strip()]
    raw = WORD.findall(text)
    words = list(map(str.lower, raw))
    n, n_lines = len(words), len(lines)
    chars = sum(map(len, text.split()))
    symbols = (chars - sum(map(len, raw))) / chars
    stripped = [x.rstrip() for x in lines]
    n_ends = sum(x.endswith(_ENDS) for x in stripped)
    ends, closed = n_ends / n_lines, _share(n_ends, n_lines)
    n_function = sum(w in FUNCTION_WORDS or w in common for w in words)
    function = n_function / n if n else 0.0
    likely = (n_function + USUAL_FUNCTION * USUAL_WORDS) / (n + USUAL_WORDS)
    per_line = n / n_lines
    by_field, by_column = _alignment(lines)
    aligned = max(by_field, by_column)
    indents = np.array([len(x) - len(x.lstrip()) for x in lines], float)
    indent = _autocorrelation(indents) if indents.any() else 0.0
    lengths = _autocorrelation(np.array(list(map(len, stripped)), float))
    # Entries made after one pattern end alike, line after line.
    tails = Counter(" ".join(x.lower().split()[-2:]) for x in stripped)
    alike = _share(tails.most_common(1)[0][1], n_lines)
    bullets = _share(sum(bool(_BULLET.match(x)) for x in lines), n_lines)
    regular = max(aligned, indent, lengths, bullets)
    non_prose = (
        n == 0
        or symbols > SYMBOLS
        or likely < PROSE_FUNCTION
        or (alike >= ALIKE and per_line < 2 * ENTRY_WORDS)
        or (
            per_line < ENTRY_WORDS
            and (closed >= 0.75 or aligned >= ALIGNED or regular >= PERIOD or likely < 2 * PROSE_FUNCTION)
            and not (function >= 0.3 and ends < 0.5 and aligned < ALIGNED)
        )
    )
    return (
        n,
        sum(map(len, words)) / n if n else 0.0,
        symbols,
        n_lines,
        ends,
        sum(w in common for w in words) / n if n else 0.0,
        function,
        per_line,
        by_field,
        by_column,
        indent,
        lengths,
        len(set(words)) / n if n else 0.0,
        bool(non_prose),
    )


def text_statistics(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """One row per document, in STATS' columns; a map over rows, nothing moves.

    Null and blank texts have n_words 0, null measures and are not "non-prose".
    common_words is a list of function words; WORD_LIMIT is the most of them
    that is sent along (a larger table is refused, not cut).
    """
    rows = common_words.select(F.lower("word")).where("word is not null").distinct().limit(WORD_LIMIT + 1).collect()
    if len(rows) > WORD_LIMIT:
        raise ValueError(f"common_words holds more than {WORD_LIMIT} words")
    common = frozenset(r[0] for r in rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blank = (0, *[None] * 2, 0, *[None] * 9, False)
        types = (pa.int64(), pa.float64(), pa.float64(), pa.int64(), *[pa.float64()] * 9, pa.bool_())
        for batch in batches:
            got = [measure(t, common) or blank for t in batch.column(1).to_pylist()]
            cols = list(zip(*got)) if got else [()] * 14
            yield pa.record_batch([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], names=_NAMES)

    return documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, STATS)


#: Most words that may be sent to every task.
WORD_LIMIT = 20_000
