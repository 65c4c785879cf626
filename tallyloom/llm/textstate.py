"""Reading a model answer: its tags, sentences and open tail, and the strings of sentences and words that prefixes are looked up among.

Pure Python, used inside Arrow batches.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

INVISIBLE = "​‌‍⁠﻿­"
_SPLIT = re.compile(r"(?<=[.!?…。！？])[\"”’')\]]*\s+|</?[a-zA-Z]\w*>\s*|\s*\n\s*")
_TERMINAL = re.compile(r"[.!?…。！？।][\"”’'»)\]*]*$")
_PARTIAL = re.compile(r"(?:�+|&#?[a-zA-Z0-9]{0,8}|\\u?[0-9a-fA-F]{0,4}|</?\w*)$")
_MARKS = ".!?…。！？।\"”’'»)]* \t"
_ENTITIES = ("amp", "lt", "gt", "quot", "apos", "nbsp", "ndash", "mdash", "hellip", "lsquo", "rsquo", "ldquo", "rdquo")
_BLOCKS = (("<think>", "</think>"), ("<answer>", "</answer>"), ("<map>", "</map>"))
_NUMBER = r"(?:[-+~≈]?\d[\d.,/e+]*(?:\s\d+/\d+|\s?[½¼¾])?|[½¼¾]|(?:one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|twenty|half)(?:\s+and\s+(?:a\s+)?(?:half|(?:three\s+)?quarters?))?)"
_AMOUNT = rf"{_NUMBER}(?:[\s-]*[^\s\d]{{1,14}}(?:[\s.]+[^\s\d]{{1,12}})?)?"
_QUANTITY = re.compile(rf"(?:(?:the|my|final|best|correct|answer|estimate|is|it|about|approx\.?|roughly|around|i|count|there|are|so|hence|:)\s+|[~≈]\s*)*{_AMOUNT}(?:[\s,]*(?:and\s+)?{_AMOUNT})?", re.I)
_LINK = re.compile(r"\b(?:of|the|an?|is|are|that|to|for|from|with|and)$")
_ITEM = r"[^\W\d_]+(?:[ -][^\W\d_]+){0,2}"
_ITEMS = re.compile(rf"{_ITEM}(?:, {_ITEM})*")
_GRAMMAR = re.compile(r"\b(?:the|is|are|a|an|of|in|on|to|that|it|i)\b", re.I)


def structurally_cut(text: str, tail: str) -> bool:
    """Ends inside a character, an entity, an escape, a tag or a block; or its open tail with a joining mark, or inside a bracket or quotation."""
    end = text.rstrip()
    last = end[-12:]
    if ("�" in last or "&" in last or "\\" in last or "<" in last) and (m := _PARTIAL.search(last)):
        hit = m.group()
        if hit[0] != "&" or len(hit) > 1 and (hit[1] == "#" or any(e.startswith(hit[1:].lower()) for e in _ENTITIES)):
            return True
    if tail and (tail[-1] in ",;:([{–—“" and any(c.isalnum() for c in tail) or tail.count("“") > tail.count("”") or tail.count("(") > tail.count(")")):
        return True
    if "<" in end:
        for opened, closed in _BLOCKS:
            if opened in end and end.count(opened) > end.count(closed):
                return True
    return False


@lru_cache(maxsize=50_000)
def is_quantity(tail: str) -> bool:
    """Nothing but a number with at most a unit of two words, maybe two such, after words like `the answer is`."""
    return bool(_QUANTITY.fullmatch(tail)) and not _LINK.search(tail)


@lru_cache(maxsize=50_000)
def is_item_list(tail: str) -> bool:
    """Nothing but names, as of options: `washing machine, desk`."""
    return bool(_ITEMS.fullmatch(tail)) and not _GRAMMAR.search(tail)


#: Words per window.
WINDOW = 3
#: What stands before strings of whole sentences and of windows, and after a string that a sentence ends with.
SENTENCE, WORDS, END = "1", "2", "\n"


def normal(piece: str) -> str:
    return " ".join(piece.split())


class Tally:
    """Counts over whole texts, of every sentence and of every window of WINDOW words.

    A window is written with a blank behind it where its sentence goes on, with END where it ends. The last
    word of an open tail may be broken off, so that windows of tails leave it out.
    """

    def __init__(self) -> None:
        self.sentences: Counter[str] = Counter()
        self.tails: Counter[str] = Counter()

    def add(self, text: str) -> str:
        """Counts a text; its open tail, or ''."""
        low = text.lower().rstrip()
        if not low:
            return ""
        if low[-1] == ">" or _TERMINAL.search(low[-8:]):
            self.sentences.update(_SPLIT.split(low))
            return ""
        *pieces, tail = _SPLIT.split(low)
        if pieces:
            self.sentences.update(pieces)
        self.tails[tail] += 1
        return tail

    def strings(self) -> Counter[str]:
        out: Counter[str] = Counter()
        for piece, n in self.sentences.items():
            words = piece.rstrip(_MARKS).split()
            if words:
                out[SENTENCE + " ".join(words) + END] += n
                last = len(words)
                for i in range(last):
                    j = i + WINDOW
                    out[WORDS + " ".join(words[i:j]) + (" " if j < last else END)] += n
        for piece, n in self.tails.items():
            words = piece.split()[:-1]
            for i in range(len(words)):
                out[WORDS + " ".join(words[i : i + WINDOW]) + " "] += n
        return out

    def __len__(self) -> int:
        return len(self.sentences) + len(self.tails)
