"""English stems by the published Porter2 algorithm."""

from __future__ import annotations

from functools import lru_cache

# Fixed values of the published algorithm.
_VOWELS = frozenset("aeiouy")
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_LI = frozenset("cdeghkmnrt")
_WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_WHOLE |= {w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")}
_KEPT = frozenset(("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"))
_STARTS = ("gener", "commun", "arsen")
_STEP2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less"}
_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize")


def _region(word: str, start: int) -> int:
    """Where the part after the first non-vowel that follows a vowel begins."""
    for i in range(start + 1, len(word)):
        if word[i] not in _VOWELS and word[i - 1] in _VOWELS:
            return i + 1
    return len(word)


def _short_end(word: str) -> bool:
    if len(word) == 2:
        return word[0] in _VOWELS and word[1] not in _VOWELS
    return len(word) > 2 and word[-1] not in _VOWELS and word[-1] not in "wxY" and word[-2] in _VOWELS and word[-3] not in _VOWELS


def _ending(word: str, endings) -> str:
    return max((e for e in endings if word.endswith(e)), key=len, default="")


@lru_cache(1 << 16)
def stem(word: str) -> str:
    """The stem of one lower-case word."""
    if len(word) <= 2:
        return word
    if word in _WHOLE:
        return _WHOLE[word]
    word = word.removeprefix("'")
    marked = ""
    for c in word:  # a y that begins a word or follows a vowel is a consonant
        marked += "Y" if c == "y" and (not marked or marked[-1] in _VOWELS) else c
    word = marked
    r1 = next((len(s) for s in _STARTS if word.startswith(s)), None)
    r1 = _region(word, 0) if r1 is None else r1
    r2 = _region(word, r1)

    for e in ("'s'", "'s", "'"):
        if word.endswith(e):
            word = word[: -len(e)]
            break
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and any(c in _VOWELS for c in word[:-2]):
        word = word[:-1]
    if word in _KEPT:
        return word

    e = _ending(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if e in ("eed", "eedly"):
        if len(word) - len(e) >= r1:
            word = word[: -len(e)] + "ee"
    elif e and any(c in _VOWELS for c in word[: -len(e)]):
        word = word[: -len(e)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(_DOUBLES):
            word = word[:-1]
        elif r1 >= len(word) and _short_end(word):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _VOWELS:
        word = word[:-1] + "i"

    e = _ending(word, (*_STEP2, "ogi", "li"))
    if e and len(word) - len(e) >= r1:
        if e == "ogi":
            word = word[:-1] if word.endswith("logi") else word
        elif e == "li":
            word = word[:-2] if word[-3:-2] in _LI else word
        else:
            word = word[: -len(e)] + _STEP2[e]
    e = _ending(word, (*_STEP3, "ative"))
    if e and len(word) - len(e) >= r1:
        if e == "ative":
            word = word[:-5] if len(word) - 5 >= r2 else word
        else:
            word = word[: -len(e)] + _STEP3[e]
    e = _ending(word, (*_STEP4, "ion"))
    if e and len(word) - len(e) >= r2 and (e != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(e)]
    if word.endswith("e"):
        if len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not _short_end(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.lower()
