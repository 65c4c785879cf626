"""Suffix stripping of English words, after the algorithm that M. F. Porter published in 1980."""

from __future__ import annotations

import re
from functools import lru_cache


# Suffixes and what takes their place, by step of the publication.
_STEP_2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
_STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _shape(w: str) -> str:
    """c and v per letter; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(w):
        out += "v" if ch in "aeiou" or ch == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short_end(w: str) -> bool:
    return len(w) >= 3 and _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


def _replace(w: str, rules: list[tuple[str, str]]) -> str:
    for end, new in sorted(rules, key=lambda r: -len(r[0])):
        if w.endswith(end):
            stem = w[: len(w) - len(end)]
            return stem + new if _measure(stem) > 0 else w
    return w


@lru_cache(maxsize=100_000)
def stem(w: str) -> str:
    """Words of up to two letters stay as they are."""
    if len(w) <= 2:
        return w
    if w.endswith("s"):
        w = w[:-2] if w.endswith(("sses", "ies")) else w if w.endswith("ss") else w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and "v" in _shape(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _short_end(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _replace(_replace(w, _STEP_2), _STEP_3)
    for end in sorted([*_STEP_4, "ion"], key=len, reverse=True):
        if w.endswith(end):
            s = w[: len(w) - len(end)]
            if _measure(s) > 1 and (end != "ion" or s.endswith(("s", "t"))):
                w = s
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        w = w[:-1] if m > 1 or m == 1 and not _short_end(w[:-1]) else w
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w


_TOKEN = re.compile(r"[a-z0-9]+")


def tokens(text: str | None) -> list[str] | None:
    """Lower-case words, those of more than three letters stemmed; null for null."""
    return None if text is None else [stem(t) if len(t) > 3 else t for t in _TOKEN.findall(text.lower())]


def plain_tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())
