"""The Porter stemmer, with the two usual departures bli -> ble and logi -> log, as tables of rules."""

from __future__ import annotations

from functools import lru_cache

# Suffixes and replacements of the algorithm's steps, each applied where the stem's measure is high enough.
STEP_3 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP_4 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_5 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _shape(word: str) -> str:
    """c and v for each letter; y is a vowel after a consonant."""
    out = ""
    for c in word:
        out += "v" if c in "aeiou" or c == "y" and out[-1:] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _short_end(word: str) -> bool:
    """Consonant, vowel, consonant other than w, x and y."""
    return len(word) > 2 and _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _double_end(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _inflections(word: str) -> str:
    if word.endswith("s"):
        if word.endswith("sses"):
            word = word[:-2]
        elif word.endswith("ies"):
            word = word[:-3] + "i"
        elif not word.endswith("ss"):
            word = word[:-1]
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    ending = _longest(word, ("ed", "ing"))
    if ending and "v" in _shape(word[: -len(ending)]):
        word = word[: -len(ending)]
        if word.endswith(("at", "bl", "iz")):
            return word + "e"
        if _double_end(word):
            return word if word[-1] in "lsz" else word[:-1]
        if _measure(word) == 1 and _short_end(word):
            return word + "e"
    return word


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters stay."""
    if len(word) <= 2:
        return word
    word = _inflections(word)
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for rules in (STEP_3, STEP_4):
        if (end := _longest(word, rules)) and _measure(word[: -len(end)]) > 0:
            word = word[: -len(end)] + rules[end]
    if (end := _longest(word, [s for s in STEP_5 if s != "ion" or word[:-3].endswith(("s", "t"))])) and _measure(word[: -len(end)]) > 1:
        word = word[: -len(end)]
    whole = word
    if word.endswith("e") and ((m := _measure(word)) > 1 or m == 1 and not _short_end(word[:-1])):
        word = word[:-1]
    if word.endswith("l") and _double_end(word) and _measure(whole) > 1:
        word = word[:-1]
    return word
