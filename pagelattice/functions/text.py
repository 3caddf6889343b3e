"""Small text measures: syllables, readability, pixel width. Plain Python, used inside the page pass."""

from __future__ import annotations

import re
from functools import lru_cache

# Common words that carry no topic.
STOP_WORDS = frozenset(
    # articles and conjunctions
    "a an the and or but nor so yet for"
    # prepositions
    " in on at to of with by from as into through during before after above below between under over out up down about against"
    " among around"
    # pronouns
    " i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its"
    " itself they them their theirs themselves what which who whom this that these those"
    # verbs
    " is are was were be been being have has had having do does did doing will would could should may might must can shall"
    # others
    " all each every both few more most other some such no not only own same than too very just also now here there when where"
    " why how any if then because while although though once until unless however therefore"
    # numbers and fillers
    " one two three first second new get make like even still well back way much many".split()
)
# The least reading ease of each level, easiest first.
READING_LEVELS = (
    (90, "very easy"),
    (80, "easy"),
    (70, "fairly easy"),
    (60, "standard"),
    (50, "fairly difficult"),
    (30, "difficult"),
    (0, "very difficult"),
)


def reading_level(ease: float) -> str:
    """The level of a reading ease."""
    return next(name for least, name in READING_LEVELS if ease >= least)


@lru_cache(100_000)
def syllables(word: str) -> int:
    """Vowel groups, silent endings aside; at least one."""
    if len(word) <= 3:
        return 1
    word = re.sub(r"(?:[^laeiouy]es|ed|[^laeiouy]e)$", "", word)
    return max(1, len(re.findall(r"[aeiouy]{1,2}", re.sub(r"^y", "", word))))


def flesch(words: int, sentences: int, syllable_count: int) -> float:
    """Reading ease, held within 0..100."""
    score = 206.835 - 1.015 * words / max(1, sentences) - 84.6 * syllable_count / max(1, words)
    return min(100.0, max(0.0, score))


def pixel_width(text: str) -> int:
    """Estimated width: capitals 9.5, small letters and digits 7.5, spaces and thin marks 4, others 7.5; halves round up."""
    total = 0.0
    for c in text:
        total += 9.5 if "A" <= c <= "Z" else 4.0 if c in " .,:;!|" else 7.5
    return int(total + 0.5)
