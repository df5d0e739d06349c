"""Porter's suffix stripping for English words (Porter 1980), for vocabularies: each distinct word is stemmed once."""

from __future__ import annotations

_VOWELS = frozenset("aeiou")
# Suffix rules of steps 2, 3 and 4 of the published algorithm.
_STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"),
    ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"),
    ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"),
    ("biliti", "ble"),
)
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous",
    "ive", "ize",
)


def _shape(word: str) -> str:
    """``v`` for vowels and ``c`` for consonants; y is a vowel behind a consonant."""
    out = ""
    for i, letter in enumerate(word):
        vowel = letter in _VOWELS or (letter == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    """How often a vowel is followed by a consonant."""
    return _shape(stem).count("vc")


def _doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short_end(word: str) -> bool:
    """Consonant, vowel, consonant, the last not w, x or y."""
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _replaced(word: str, rules: tuple[tuple[str, str], ...]) -> str:
    fits = [(s, r) for s, r in rules if word.endswith(s)]
    if not fits:
        return word
    suffix, other = max(fits, key=lambda rule: len(rule[0]))
    stem = word[: -len(suffix)]
    return stem + other if _measure(stem) > 0 else word


def porter(word: str) -> str:
    """The stem of a lower-case word; words that are not plain ASCII letters stay as they are."""
    if len(word) < 3 or not (word.isascii() and word.isalpha()):
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    cut = None
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    elif word.endswith("ed") and "v" in _shape(word[:-2]):
        cut = word[:-2]
    elif word.endswith("ing") and "v" in _shape(word[:-3]):
        cut = word[:-3]
    if cut is not None:
        if cut.endswith(("at", "bl", "iz")):
            cut += "e"
        elif _doubled(cut) and cut[-1] not in "lsz":
            cut = cut[:-1]
        elif _measure(cut) == 1 and _short_end(cut):
            cut += "e"
        word = cut
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(_replaced(word, _STEP2), _STEP3)
    fits = [s for s in _STEP4 if word.endswith(s)]
    if fits:
        stem = word[: -max(map(len, fits))]
        if _measure(stem) > 1 and (not word.endswith("ion") or max(fits, key=len) != "ion" or stem.endswith(("s", "t"))):
            word = stem
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _short_end(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word
