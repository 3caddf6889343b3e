"""Word lists and measures shared by the corpus operators."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\W_]+")

# Frequent function words of the four languages, to tell sentences from lists.
FUNCTION_WORDS = frozenset(
    (
        "the of and a to in is was that for it on with as by at this but which not or be are from had have one so an no"
        " before after when our more than their his her its we you they each every some another any until while since"
        " because although into over if there will can could would should out"
        " der die das und zu den dem des mit von ist für auf nicht ein eine einen als auch nach bei aus was aber im zum"
        " nur wie trotz ohne sodass doch vor seit wir sie es sind war wurde nur zum"
        " le la les de du et à en un une que qui dans pour pas sur par plus avec ce mais au est sans si depuis après"
        " avant comme malgré ont été son sa ses nous vous"
        " el los las y del al por con para se lo su como más pero es sin desde así muy sobre ha han"
    ).split()
)

# Telling function words, each of one language only.
TELLS = {
    "en": "the of and to is was that for it on with this which each every some their our",
    "de": "der die das und den mit von ist für auf nicht ein eine nach bei aus im zum",
    "fr": "le et à une qui dans pour pas sur avec ce mais au est du",
    "es": "el los las y una por con se lo al del su pero",
}
LANGUAGES = ("", *TELLS)
#: word -> number of its language in LANGUAGES
TELLING = {w: i for i, lang in enumerate(LANGUAGES) if lang for w in TELLS[lang].split()}


def words(text: str) -> list[str]:
    """Maximal runs of letters and digits, lower-cased."""
    if "İ" in text:  # the one letter whose lower case holds a mark that is no letter
        return [w.lower() for w in WORD.findall(text)]
    return WORD.findall(text.lower())
