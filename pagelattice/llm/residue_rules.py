"""Rules that tell what a normalised message is: placeholder, filler, error, scripts notice, or none of these."""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import cache
from itertools import accumulate

from pagelattice.functions.wording import Wording
from pagelattice.llm.words import FUNCTION_WORDS, WORD

try:
    import ahocorasick
except ImportError:  # the strings are then looked for one by one
    ahocorasick = None

_ADDRESS = re.compile(r"https?://\S+|[\w.+-]+@[\w-]+\.\w+|\bwww\.\S+")
_HEX = re.compile(r"\b(?=[0-9a-f-]*\d)[0-9a-f]{8,}(?:-[0-9a-f]{4,})*\b", re.I)
_NUMBER = re.compile(r"\d+(?:[.,:/-]\d+)*")
_DIGIT = re.compile(r"\d")


def normalise(line: str) -> str:
    """Lower case, with addresses, dates and numbers masked: what messages of different sites have in common."""
    if "@" in line or "://" in line or "www." in line:
        line = _ADDRESS.sub("@", line)
    if _DIGIT.search(line):
        line = _NUMBER.sub("0", _HEX.sub("0", line))
    return line.lower()


# Template syntax of common engines and printed values of missing data.
PLACEHOLDER = [
    r"\{\{.*?\}\}",
    r"\$\{.*?\}",
    r"#\{.*?\}",
    r"<%.*?%>",
    r"\{%.*?%\}",
    r"%%\w[\w.]*%%",
    r"\[\[[\w. ]+\]\]",
    r"__[a-z][\w.]*__",
    r"\[object object\]",
]
NO_VALUE = [
    r"translation_key_not_found",
    r"missing translation",
    r"translation missing",
    r"has no value$",
]
# Printed values of missing data that are a whole line.
NO_VALUE_LINE = r"^(?:undefined|null|none|nan|n/a)(?: [a-z€$%]{1,4})?$|^%[sd]$"
# Wording of drafts, in the four languages.
FILLER = [
    r"lorem ipsum",
    r"^(?:todo|tbd|fixme|xxx|tba)\b",
    r"^(?:x{3,}\s*)+$",
    r"(?:sample|dummy|placeholder|example|filler) text\b",
    r"\bplaceholder$",
    r"insert (?:your )?(?:text|title|content)",
    r"(?:text|headline|title|content) goes here",
    r"write something about",
    r"describe your ",
    r"replace before launch",
    r"^untitled(?: \w+)?$",
    r"coming soon\W*$",
    r"text here\b",
    r"texto? de ejemplo",
    r"sustituir\.?$",
    r"contenido (?:de )?ejemplo",
    r"próximamente",
    r"à (?:compléter|venir)\b",
    r"texte (?:d.exemple|ici)",
    r"(?:text|inhalt) folgt\b",
    r"hier (?:eingeben|einfügen)",
    r"platzhalter",
    r"beispieltext",
    r"mustertext",
    r"blindtext",
]
# Wording of servers and error pages, in the four languages.
ERROR = [
    r"access (?:is |was )?denied",
    r"request (?:was|has been) blocked",
    r"^forbidden\b",
    r"\bforbidden$",
    r"not authori[sz]ed",
    r"database connection",
    r"connection (?:was )?(?:refused|reset|timed out)",
    r"internal server error",
    r"unexpected condition",
    r"bad gateway",
    r"gateway time-?out",
    r"service (?:is )?(?:temporarily )?unavailable",
    r"no backend",
    r"upstream sent",
    r"invalid reply",
    r"too many requests",
    r"more requests than allowed",
    r"slow down: ",
    r"fatal error",
    r"uncaught \w*error",
    r"stack trace",
    r"exception in ",
    r"(?:page|file|address|site|url|item|document) (?:was |could )?not (?:be )?found",
    r"could not find (?:the|this|that|your) (?:page|address|file|item|url|link|article|document|post|product|entry)",
    r"page (?:is )?(?:missing|gone)",
    r"nothing lives at this",
    r"no longer (?:available|exists?|this address|here)",
    r"there is no longer",
    r"does not exist",
    r"has (?:been )?moved",
    r"maintenance (?:work|mode|break)",
    r"(?:for|under|scheduled) maintenance",
    r"we (?:will|.ll) be (?:right )?back",
    r"be right back",
    r"try again later",
    r"something went wrong",
    r"an error (?:has )?occurred",
    r"(?:^|\b)(?:error|erreur|fehler|http) ?(?:code )?0\b",
    r"\b0 (?:bad gateway|service unavailable|internal server|not found|forbidden|gone\b|unauthorized)",
    r"page introuvable",
    r"introuvable$",
    r"n.existe (?:plus|pas)",
    r"a été (?:retiré|supprimé|déplacé)",
    r"accès refusé",
    r"en maintenance",
    r"contenu demandé",
    r"service indisponible",
    r"page demandée",
    r"ya no existe",
    r"no hay nada en",
    r"no (?:se )?(?:ha )?encontrad[oa]",
    r"página no (?:encontrada|existe|disponible)",
    r"acceso denegado",
    r"en mantenimiento",
    r"no disponible",
    r"gibt es nicht",
    r"nicht gefunden",
    r"leider nichts",
    r"nicht (?:mehr )?(?:verfügbar|erreichbar|vorhanden)",
    r"zugriff verweigert",
    r"wartungsarbeiten",
    r"seite fehlt",
    r"existiert nicht",
]
# Notices that scripts are required, or that something is still loading.
SCRIPTS = [
    r"(?:enable|activate|allow|need|require|requires|turn on|switch on)\w* (?:\w+ ){0,3}(?:javascript|scripts?|scripting)",
    r"(?:javascript|scripts?|scripting) (?:is|are|was|has been) (?:\w+ )?(?:turned off|disabled|blocked|required|needed|off)",
    r"(?:blocks?|blocked|disabled?) (?:\w+ )?(?:javascript|scripts?|scripting)",
    r"scripting (?:is )?disabled",
    r"drawn by a script",
    r"(?:est|es|ist) (?:nécessaire|necesario|erforderlich|nötig)",
    r"activ(?:e|ez|er|ar) (?:le |el )?javascript",
    r"aktivieren sie (?:bitte )?javascript",
    r"sans javascript",
    r"sin javascript",
    r"ohne javascript",
    r"javascript (?:aktivieren|activé)",
    r"checking your browser",
    r"please wait while",
    r"(?:^|\b)loading(?:…|\.\.\.)",
    r"veuillez patienter",
    r"bitte warten",
    r"espere por favor",
    r"browser is too old",
]
# Lines that say nothing alone; a message only where many sources have them.
WEAK_LINE = (
    r"^(?:sorry|oops|vaya|hoppla|oups|dead end|new page|not available|not found|nothing here|page missing|loading"
    r"|this page has moved on|sin contenido|neue seite|nouvelle page|página nueva|please wait|ref 0|0)\W*$"
)
# The vocabulary of the usual mock Latin ("Lorem ipsum") of text generators.
LOREM = frozenset(
    "a ac accumsan ad adipiscing aenean aliqua aliquam aliquet amet anim ante aptent arcu at auctor augue bibendum blandit"
    " cillum class commodo condimentum congue consectetur consequat conubia convallis cras culpa cum cupidatat curabitur"
    " cursus dapibus deserunt diam dictum dignissim dolor dolore donec duis egestas eget eiusmod eleifend elementum elit enim"
    " erat eros esse est et etiam eu euismod ex excepteur exercitation facilisis fames faucibus felis fermentum feugiat"
    " fringilla fugiat fusce gravida habitant hendrerit iaculis id imperdiet in incididunt integer interdum ipsum irure justo"
    " labore lacinia lacus laoreet lectus leo libero ligula lobortis lorem luctus maecenas magna malesuada massa mattis mauris"
    " metus minim molestie mollis mollit morbi nam nec neque netus nibh nisi nisl non nostra nostrud nulla nullam nunc"
    " occaecat odio officia orci ornare pariatur pellentesque pharetra phasellus placerat porta porttitor posuere praesent"
    " pretium proident proin pulvinar purus quam qui quis quisque reprehenderit rhoncus risus rutrum sagittis sapien"
    " scelerisque sed sem semper senectus sint sit sodales sollicitudin sunt suscipit suspendisse tellus tempor tempus"
    " tincidunt tortor tristique turpis ullamco ullamcorper ultrices ultricies urna ut varius vehicula vel velit venenatis"
    " veniam vestibulum vitae vivamus viverra volutpat voluptate vulputate".split()
)
#: Function words of real languages that mock Latin does not have.
FOREIGN = FUNCTION_WORDS - LOREM


def _grams(word: str) -> list[str]:
    edged = f"^{word}$"
    return [edged[i : i + 3] for i in range(len(edged) - 2)]


_LATIN = frozenset(g for w in LOREM for g in _grams(w))
#: Mock Latin: least share of three-letter runs that the vocabulary has too, short lines being drawn to what other
#: languages share with it by so many runs of weight; and the least words.
LATIN_SHARE, LATIN_USUAL, LATIN_WEIGHT, LATIN_WORDS = 0.7, 0.4, 20, 4


def latin_grams(found: list[str]) -> tuple[int, int]:
    """(three-letter runs of the words made of letters only, how many of these mock Latin has)."""
    grams = [g for w in found if w.isalpha() for g in _grams(w)]
    return len(grams), sum(g in _LATIN for g in grams)


def is_latin(grams: float, latin: float) -> bool:
    return latin + LATIN_USUAL * LATIN_WEIGHT >= LATIN_SHARE * (grams + LATIN_WEIGHT)


#: A line is a message if this share of its sentences is.
MESSAGE_PART = 0.5
#: A placeholder among more other words is an example within a text.
BESIDE = 10
_SENTENCE_END = re.compile(r"(?<=[.!?…])\s+|\n+")
#: A line of so many characters may read as sentences.
REAL_CHARS = 40


_PLACEHOLDER, _NO_VALUE, _FILLER, _ERROR, _SCRIPTS = (Wording(x, re.U) for x in (PLACEHOLDER, NO_VALUE, FILLER, ERROR, SCRIPTS))
_IN_PLACE = re.compile("|".join(PLACEHOLDER))
_NO_VALUE_LINE, _WEAK_LINE = re.compile(NO_VALUE_LINE), re.compile(WEAK_LINE)
#: Every longer message holds one of these strings, in lower case.
NEEDS = sorted({n for w in (_PLACEHOLDER, _NO_VALUE, _FILLER, _ERROR, _SCRIPTS) for n in w.needs})
#: Messages that are a whole line have at most so many words, and one of these words unless they have one word in all.
SHORT = 5
SHORT_WORDS = frozenset(re.findall(r"[^\W\d_]{3,}|n/a", NO_VALUE_LINE + WEAK_LINE))


def with_needs(texts: list[str]) -> set[int]:
    """The places of the texts, in lower case, that hold a string of NEEDS; one pass over all letters."""
    if ahocorasick is None:
        return {i for i, t in enumerate(texts) if any(n in t for n in NEEDS)}
    ends = list(accumulate(len(t) + 1 for t in texts))
    return {bisect_right(ends, end) for end, _ in _automaton().iter("\n".join(texts))}


@cache
def _automaton():
    made = ahocorasick.Automaton()
    for n in NEEDS:
        made.add_word(n, 1)
    made.make_automaton()
    return made


def could_be(line: str) -> bool:
    """Whether a line may be a message by its wording; mock Latin is told by `is_latin`."""
    tokens = line.lower().split()
    return len(tokens) < 2 or bool(with_needs([line.lower()])) or (len(tokens) <= SHORT and any(map(short_word, tokens)))


def short_word(token: str) -> bool:
    """Whether a lower-case token has a word of the messages that are a whole line."""
    return token in SHORT_WORDS or not SHORT_WORDS.isdisjoint(WORD.findall(token))


def classify(message: str) -> tuple[str, bool] | None:
    """(kind, strong) of a normalised message, or None. A weak one counts only if it recurs across sources."""
    if _PLACEHOLDER.any(message, message) and len(WORD.findall(_IN_PLACE.sub(" ", message))) <= BESIDE:
        return "placeholder", True
    if _NO_VALUE_LINE.search(message) or _NO_VALUE.any(message, message):
        return "placeholder", True
    found = WORD.findall(message)
    if len(found) >= LATIN_WORDS and FOREIGN.isdisjoint(found) and is_latin(*latin_grams(found)):
        return "filler", True
    return _of_sentences(message)


def _of_sentences(message: str) -> tuple[str, bool] | None:
    """The first kind of the sentences, if enough of them are residue by strong wording; weak wording must be alone."""
    if not _WEAK_LINE.search(message) and not any(w.candidates(message) for w in (_FILLER, _ERROR, _SCRIPTS)):
        return None
    parts = [x for x in _SENTENCE_END.split(message) if WORD.search(x)]
    got = [g for x in parts if (g := _worded(x))]
    strong = [g for g in got if g[1]]
    if strong and len(strong) >= MESSAGE_PART * len(parts):
        return strong[0]
    return got[0] if len(parts) == 1 and got else None


def _worded(message: str) -> tuple[str, bool] | None:
    if _FILLER.any(message, message):
        return "filler", True
    if _ERROR.any(message, message):
        return "error", True
    if _SCRIPTS.any(message, message):
        return "scripts", True
    if _WEAK_LINE.search(message):
        return "weak", False
    return None

