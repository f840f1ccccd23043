"""The Porter stemmer, from the published algorithm."""

from __future__ import annotations

# The suffix tables of the published algorithm's steps 2, 3 and 4.
STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"),
]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]

def _longest_first(table: list) -> list:
    return sorted(table, key=lambda x: -len(x[0] if isinstance(x, tuple) else x))


_STEP2, _STEP3, _STEP4 = map(_longest_first, (STEP2, STEP3, STEP4))
# All suffixes of a step, for one test whether there is any.
_ENDS2, _ENDS3, _ENDS4 = tuple(e for e, _ in STEP2), tuple(e for e, _ in STEP3), tuple(STEP4)
_kinds = str.maketrans("abcdefghijklmnopqrstuvwxyz", "vcccvcccvcccccvcccccvcccyc")


def _shape(stem: str) -> str:
    """Consonants and vowels of a stem as c and v; y is a vowel behind a consonant."""
    out = stem.translate(_kinds)
    at = out.find("y")
    while at >= 0:
        out = out[:at] + ("v" if at and out[at - 1] == "c" else "c") + out[at + 1 :]
        at = out.find("y", at)
    return out


def _measure(stem: str) -> int:
    """How often vowels are followed by consonants."""
    return _shape(stem).count("vc")


def _short_end(stem: str) -> bool:
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _replaced(word: str, table: list[tuple[str, str]], ends: tuple[str, ...]) -> str:
    for end, new in table if word.endswith(ends) else ():
        if word.endswith(end):
            stem = word[: -len(end)]
            return stem + new if _measure(stem) > 0 else word
    return word


def porter_stem(word: str) -> str:
    """Stem of a lower-case word; words of one or two letters, or with other signs than a-z, stay."""
    if len(word) < 3 or not (word.isascii() and word.isalpha() and word.islower()):
        return word
    w = word
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        stem = next((w[: -len(e)] for e in ("ed", "ing") if w.endswith(e)), None)
        if stem is not None and "v" in _shape(stem):
            w = stem
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _short_end(w):
                w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _replaced(_replaced(w, _STEP2, _ENDS2), _STEP3, _ENDS3)
    for end in _STEP4 if w.endswith(_ENDS4) else ():
        if w.endswith(end):
            stem = w[: -len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e"):
        stem = w[:-1]
        if _measure(stem) > 1 or _measure(stem) == 1 and not _short_end(stem):
            w = stem
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w
