"""English stems by Porter's rules (1980) as one column expression.

A step reads its word several times, so each is bound before the next reads it, and the expression stays as long as the rules.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.functions.text import bound

# Consonant and vowel runs; a first y is a consonant, which a capital says.
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
SOME, ONE, MORE = f"^(?:{_C})?{_V}{_C}", f"^(?:{_C})?{_V}{_C}(?:{_V})?$", f"^(?:{_C})?{_V}{_C}{_V}{_C}"
VOWEL = f"^(?:{_C})?{_V}"
SHORT_END = f"^{_C}[aeiouy][^aeiouwxyY]$"

# The published suffixes of steps 2, 3 and 4 and what takes their place.
STEP_2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _without(word: Column, n: int) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - n)


def _suffixes(word: Column, rules: dict[str, str], measure: str) -> Column:
    """The longest suffix of the rules that the word has decides, whether what stands before it is long enough or not."""
    out = None
    for suffix, to in sorted(rules.items(), key=lambda x: (-len(x[0]), x[0])):
        changed = F.when(_without(word, len(suffix)).rlike(measure), F.concat(_without(word, len(suffix)), F.lit(to))).otherwise(word)
        out = F.when(word.endswith(suffix), changed) if out is None else out.when(word.endswith(suffix), changed)
    return out.otherwise(word)


def _plural(w: Column) -> Column:
    return F.when(w.endswith("sses") | w.endswith("ies"), _without(w, 2)).when(w.endswith("ss"), w).when(w.endswith("s"), _without(w, 1)).otherwise(w)


def _past(w: Column) -> Column:
    """The word without ed or ing; a bar at its end says that one of them went."""
    cut = F.when(w.endswith("eed"), F.when(_without(w, 3).rlike(SOME), _without(w, 1)).otherwise(w))
    for ending in ("ed", "ing"):
        cut = cut.when(w.endswith(ending) & _without(w, len(ending)).rlike(VOWEL), F.concat(_without(w, len(ending)), F.lit("|")))
    return cut.otherwise(w)


def _mended(w: Column) -> Column:
    bare = _without(w, 1)
    again = F.when(bare.rlike("(?:at|bl|iz)$"), F.concat(bare, F.lit("e"))).when(bare.rlike(r"([^aeiouylsz])\1$"), _without(w, 2)).when(bare.rlike(SHORT_END), F.concat(bare, F.lit("e"))).otherwise(bare)
    return F.when(w.endswith("|"), again).otherwise(w)


def _last_y(w: Column) -> Column:
    return F.when(w.endswith("y") & _without(w, 1).rlike(VOWEL), F.concat(_without(w, 1), F.lit("i"))).otherwise(w)


def _long_endings(w: Column) -> Column:
    ion = w.endswith("ion") & _without(w, 3).rlike("[st]$")
    return F.when(ion, F.when(_without(w, 3).rlike(MORE), _without(w, 3)).otherwise(w)).otherwise(_suffixes(w, dict.fromkeys(STEP_4, ""), MORE))


def _last_e(w: Column) -> Column:
    return F.when(w.endswith("e") & (_without(w, 1).rlike(MORE) | _without(w, 1).rlike(ONE) & ~_without(w, 1).rlike(SHORT_END)), _without(w, 1)).otherwise(w)


def _last_l(w: Column) -> Column:
    return F.when(w.endswith("ll") & w.rlike(MORE), _without(w, 1)).otherwise(w)


STEPS = [_plural, _past, _mended, _last_y, lambda w: _suffixes(w, STEP_2, SOME), lambda w: _suffixes(w, STEP_3, SOME), _long_endings, _last_e, _last_l]


def stem(word: Column) -> Column:
    """The stem of a lower-case word. Words below three letters, and those with other characters than a to z, are their own."""
    out = F.regexp_replace(word, "^y", "Y")
    for step in STEPS:
        out = bound(out, step)
    return F.when(word.rlike("^[a-z]{3,}$"), F.lower(out)).otherwise(word)
