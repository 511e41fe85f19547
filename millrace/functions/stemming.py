"""Porter's algorithm for suffix stripping (1980), from its published rules."""

from __future__ import annotations

import re
from functools import lru_cache

# Suffixes and what they become, of the steps that ask for a measure.
STEP_2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
STEP_3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def _rules(text: str) -> list[tuple[str, str]]:
    return sorted((tuple(r.split(":")) for r in text.split()), key=lambda r: -len(r[0]))


_TWO, _THREE = _rules(STEP_2), _rules(STEP_3)
_FOUR = sorted(STEP_4.split(), key=len, reverse=True)


def _shape(word: str) -> str:
    """c for consonants, v for vowels; y is a vowel behind a consonant."""
    out = ""
    for ch in word:
        vowel = ch in "aeiou" or (ch == "y" and out[-1:] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _shape(word)))


def _short(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _swap(word: str, rules: list[tuple[str, str]]) -> str:
    for end, new in rules:
        if word.endswith(end):
            head = word[: -len(end)]
            return head + new if _measure(head) > 0 else word
    return word


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for end in ("ed", "ing"):
            if word.endswith(end) and "v" in _shape(word[: -len(end)]):
                word = word[: -len(end)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif _double(word) and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _short(word):
                    word += "e"
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(_swap(word, _TWO), _THREE)
    for end in _FOUR:
        if word.endswith(end):
            head = word[: -len(end)]
            if _measure(head) > 1 and (end != "ion" or head[-1:] in ("s", "t")):
                word = head
            break
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _short(word[:-1])):
            word = word[:-1]
    if _measure(word) > 1 and _double(word) and word[-1] == "l":
        word = word[:-1]
    return word
