"""Porter's stemmer (1980), with the three departures of its author's own code: words of one or two letters stay as they are,
``bli`` becomes ``ble``, and ``logi`` becomes ``log``."""

from __future__ import annotations

from functools import lru_cache

STEP2 = {
    "a": (("ational", "ate"), ("tional", "tion")),
    "c": (("enci", "ence"), ("anci", "ance")),
    "e": (("izer", "ize"),),
    "l": (("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous")),
    "o": (("ization", "ize"), ("ation", "ate"), ("ator", "ate")),
    "s": (("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous")),
    "t": (("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")),
    "g": (("logi", "log"),),
}
STEP3 = {
    "e": (("icate", "ic"), ("ative", ""), ("alize", "al")),
    "i": (("iciti", "ic"),),
    "l": (("ical", "ic"), ("ful", "")),
    "s": (("ness", ""),),
}
STEP4 = {
    "a": ("al",),
    "c": ("ance", "ence"),
    "e": ("er",),
    "i": ("ic",),
    "l": ("able", "ible"),
    "n": ("ant", "ement", "ment", "ent"),
    "o": ("ion", "ou"),
    "s": ("ism",),
    "t": ("ate", "iti"),
    "u": ("ous",),
    "v": ("ive",),
    "z": ("ize",),
}


def _consonants(word: str) -> list[bool]:
    out: list[bool] = []
    for i, c in enumerate(word):
        out.append(c not in "aeiou" and not (c == "y" and i > 0 and out[i - 1]))
    return out


def measure(stem: str) -> int:
    """How many runs of consonants follow a run of vowels."""
    kinds = _consonants(stem)
    return sum(1 for x, y in zip(kinds, kinds[1:], strict=False) if not x and y)


def _has_vowel(stem: str) -> bool:
    return not all(_consonants(stem))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _consonants(word)[-1]


def _short(word: str) -> bool:
    if len(word) < 3 or word[-1] in "wxy":
        return False
    kinds = _consonants(word)
    return kinds[-3] and not kinds[-2] and kinds[-1]


def step1a(w: str) -> str:
    if w.endswith("sses") or w.endswith("ies"):
        return w[:-2]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def step1b(w: str) -> str:
    if w.endswith("eed"):
        return w[:-1] if measure(w[:-3]) > 0 else w
    for end in ("ed", "ing"):
        if w.endswith(end):
            stem = w[: -len(end)]
            if not _has_vowel(stem):
                return w
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if _double(stem):
                return stem if stem[-1] in "lsz" else stem[:-1]
            return stem + "e" if measure(stem) == 1 and _short(stem) else stem
    return w


def _replace(w: str, table: dict, key: str) -> str:
    for end, new in table.get(key, ()):
        if w.endswith(end):
            stem = w[: -len(end)]
            return stem + new if measure(stem) > 0 else w
    return w


def step4(w: str) -> str:
    for end in STEP4.get(w[-2:-1], ()):
        if w.endswith(end):
            stem = w[: -len(end)]
            if end == "ion" and not stem.endswith(("s", "t")):
                continue
            return stem if measure(stem) > 1 else w
    return w


@lru_cache(maxsize=200_000)
def porter(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) <= 2:
        return word
    w = step1b(step1a(word))
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _replace(w, STEP2, w[-2:-1])
    w = _replace(w, STEP3, w[-1:])
    w = step4(w)
    if w.endswith("e") and (measure(w[:-1]) > 1 or (measure(w[:-1]) == 1 and not _short(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and measure(w) > 1 else w
