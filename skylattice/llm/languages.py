"""Languages as far as sentence boundaries need them: abbreviations, function words to tell one from another, labels."""

from __future__ import annotations

import unicodedata
from functools import lru_cache


#: Abbreviations that end no sentence whatever follows (titles, "for example" and the like), by language.
ALWAYS = {
    "en": "mr mrs ms dr sgt prof gen col lt capt st hon messrs vs e.g i.e cf viz",
    "de": "dr prof hr frl z bzw ca vgl evtl bspw sog",
    "fr": "dr prof m mm mme mlle mlles mgr",
    "es": "dr prof sr sra srta dra d dña ud uds lic",
    "ru": "ул см ср т.е напр г-н г-жа",
    "el": "κα κος κ",
    "hi": "डॉ श्री प्रो",
    "ar": "د أ م",
}
#: Abbreviations before a number, a letter or a lower-case word; before a capitalised word the sentence may end.
BEFORE_NUMBER = {
    "en": "no nos nr num p pp pg fig figs tab sec sect ch chap vol ver rev temp lat long wp approx min max std avg est cmd art arts",
    "de": "nr p abb tab tabl kap bd std min max fig temp ca",
    "fr": "no nº p pp fig tab chap vol env approx art min max temp",
    "es": "nº núm p pág págs fig tab cap vol aprox art min max temp",
    "ru": "ок рис табл стр гл п №",
    "el": "σελ εικ πίν",
    "hi": "से कि मी रु",
    "ar": "ص",
}
#: Second letters of abbreviations of two letters, by language and first letter.
TWO_PART = {"en": {"p": "s", "n": "b"}, "de": {"z": "b", "d": "h", "u": "a", "o": "ä"}, "ru": {"т": "деп", "и": "д"}, "el": {"π": "χ"}}
#: Common words that take a letter as their name, so that "section B." may end a sentence.
NAMED_BY_LETTER = {
    "en": "annex appendix area block category chapter class column exhibit figure gate grid group hall item level line option part phase plan point row section sector site stage step table track type unit zone",
    "de": "abschnitt anhang bereich block fall feld gruppe halle klasse punkt phase schritt stufe tabelle teil typ zone",
    "fr": "annexe bloc cas classe figure groupe hall ligne niveau partie phase plan point section secteur site tableau type zone",
    "es": "anexo bloque caso clase figura fila grupo nivel parte fase plan punto sección sector tabla tipo zona",
}
#: Words before an ordinal number written with a full stop.
BEFORE_ORDINAL = {"de": "am im zum vom dem den der des das die beim bis ab seit ein einen einem eines ihrem seinem zur"}
#: Frequent function words that tell the languages in Latin script apart.
FUNCTION_WORDS = {
    "en": "the and of to is was it that for on with as at by from are be this were had has not but or which when before after",
    "de": "der die das und ist nicht mit den von zu im ein eine auf für dem war wurde nach bei sich auch wird vor einem",
    "fr": "le les des et est une dans que qui pour pas sur au du avec par il elle ont été cette mais avant après",
    "es": "el los las y en una que por con para del se su al como más fue está pero este antes después",
}
LATIN = tuple(FUNCTION_WORDS)
#: Labels of three letters whose first two aren't the usual label.
_THREE = {"ger": "de", "spa": "es", "rus": "ru", "ell": "el", "gre": "el", "hin": "hi", "ara": "ar", "urd": "ar", "ur": "ar"}


def _table(values: dict[str, str]) -> dict[str, frozenset[str]]:
    return {k: frozenset(unicodedata.normalize("NFC", v).split()) for k, v in values.items()}


_ALWAYS, _BEFORE_NUMBER, _NAMED, _ORDINAL, _FUNCTION = map(_table, (ALWAYS, BEFORE_NUMBER, NAMED_BY_LETTER, BEFORE_ORDINAL, FUNCTION_WORDS))
#: Code points of the longest abbreviation: a longer word is none.
LONGEST = max(len(w) for t in (_ALWAYS, _BEFORE_NUMBER) for words in t.values() for w in words)


def language_of(label: str | None) -> str | None:
    """The language a label names however spelled, or None if it is none known here."""
    low = (label or "").strip().lower()
    low = _THREE.get(low[:3], _THREE.get(low[:2], low[:2]))
    return low if low in ALWAYS else None


def detect(text: str, label: str | None = None) -> tuple[str, ...]:
    """Languages in Latin script whose function words a text has: those with two or more different ones, else the one with
    most. For the language of its label one is enough."""
    words = set(text.lower().split())
    counts = {k: len(words & v) + (k == label and not words.isdisjoint(v)) for k, v in _FUNCTION.items()}
    most = min(2, max(counts.values()))
    return tuple(k for k, n in counts.items() if n >= most) if most else ()


class Abbreviations:
    """The tables that count in a text of the given languages; those of other scripts always do, as no word is in two."""

    def __init__(self, languages: tuple[str, ...]) -> None:
        used = [k for k in ALWAYS if k in languages or k not in LATIN]
        union = lambda t: frozenset().union(*(t.get(k, ()) for k in used))
        self.always, self.before_number, self.named, self.ordinal = map(union, (_ALWAYS, _BEFORE_NUMBER, _NAMED, _ORDINAL))
        self.two_part: dict[str, str] = {}
        for k in used:
            for first, second in TWO_PART.get(k, {}).items():
                self.two_part[first] = self.two_part.get(first, "") + second


@lru_cache(maxsize=64)
def abbreviations(languages: tuple[str, ...]) -> Abbreviations:
    """The tables of some languages; of all where none is known."""
    return Abbreviations(languages or LATIN)
