"""Quantities recorded in different units: read every stated value, find its unit, convert it to m, m2 or s.

Method: a unit string is segmented by dynamic programming over tries of qualifiers (square), prefixes
(milli), roots (metre), plurals and exponents. An ambiguous string (`ms`: milliseconds or metres; `′`: feet or
minutes) is read once per dimension; the score of the parts plus a prior of the dimension decides. The prior is the field's own: how
often the unambiguous values of the same field, under questions for the same dimension, are of each dimension. A value without a
unit takes the one its question asks for, else the one of its source's note.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import cut

LENGTH, AREA, TIME = "length", "area", "time"
COMMON = {LENGTH: "m", AREA: "m2", TIME: "s"}
#: Counts that every field has beforehand, of the dimension asked for and of each other one; and the log prior of another one where there is no field.
COUNT_ASKED, COUNT_OTHER, PRIOR_OTHER = 10.0, 0.2, -4.0
#: The note table is broadcast only up to this many rows.
BROADCAST_ROWS = 10_000

# The parts of unit names, (text, meaning, log weight).
QUALIFIERS = [("square ", 2, 0.0), ("square", 2, -0.2), ("sq. ", 2, 0.0), ("sq.", 2, 0.0), ("sq ", 2, 0.0), ("sq", 2, -0.2), ("quadrat", 2, 0.0)]
PREFIXES = [("milli", 1e-3, 0.0), ("zenti", 1e-2, 0.0), ("centi", 1e-2, 0.0), ("dezi", 1e-1, 0.0), ("deci", 1e-1, 0.0), ("kilo", 1e3, 0.0), ("m", 1e-3, -0.5), ("c", 1e-2, -0.5), ("d", 1e-1, -2.0), ("k", 1e3, -0.5)]
ROOTS = [
    ("meter", "m", 0.0), ("metre", "m", 0.0), ("metro", "m", -0.5), ("mtr", "m", -0.2), ("m", "m", -0.5), ("㎡", "m2", 0.0),
    ("inches", "in", 0.0), ("inch", "in", 0.0), ("in", "in", -0.5), ("zoll", "in", 0.0), ("″", "in", -0.7), ('"', "in", -0.7), ("”", "in", -0.7), ("''", "in", -0.7), ("′′", "in", -0.7),
    ("feet", "ft", 0.0), ("foot", "ft", 0.0), ("fuß", "ft", 0.0), ("fuss", "ft", 0.0), ("ft", "ft", -0.3), ("′", "ft", -0.7), ("'", "ft", -0.7), ("’", "ft", -0.7), ("sf", "ft2", -0.5), ("sqft", "ft2", -0.2),
    ("yard", "yd", 0.0), ("yd", "yd", -0.3),
    ("second", "s", 0.0), ("sekunden", "s", 0.0), ("sekunde", "s", 0.0), ("sec", "s", -0.2), ("sek", "s", -0.2), ("s", "s", -0.6), ("″", "s", -1.2), ('"', "s", -1.2),
    ("minute", "min", 0.0), ("min", "min", -0.3), ("′", "min", -1.2), ("'", "min", -1.2), ("m", "min", -2.0),
    ("hour", "h", 0.0), ("stunden", "h", 0.0), ("stunde", "h", 0.0), ("std", "h", -0.3), ("hr", "h", -0.3), ("h", "h", -0.6),
]
PLURALS = [("(s)", None, 0.0), ("s", None, -0.4), ("n", None, -0.4), ("es", None, -0.6)]
EXPONENTS = [("²", 2, 0.0), ("^2", 2, 0.0), ("2", 2, -0.1), ("**2", 2, -0.1)]
#: Root to its dimension and factor to the common unit.
BASE = {"m": (LENGTH, 1.0), "in": (LENGTH, 0.0254), "ft": (LENGTH, 0.3048), "yd": (LENGTH, 0.9144), "m2": (AREA, 1.0), "ft2": (AREA, 0.3048**2), "s": (TIME, 1.0), "min": (TIME, 60.0), "h": (TIME, 3600.0)}
_NAMES = {1e-3: "m", 1e-2: "c", 1e-1: "d", 1e3: "k", 1.0: ""}


def _trie(entries: list[tuple]) -> dict:
    root: dict = {}
    for text, meaning, weight in entries:
        node = root
        for ch in text:
            node = node.setdefault(ch, {})
        node.setdefault("", []).append((meaning, weight))
    return root


#: Layers in the order in which parts may follow; each but the root may be left out.
_LAYERS = [(_trie(QUALIFIERS), False), (_trie(PREFIXES), False), (_trie(ROOTS), True), (_trie(PLURALS), False), (_trie(EXPONENTS), False)]


def _matches(trie: dict, s: str, at: int) -> Iterator[tuple[int, object, float]]:
    node = trie
    for end in range(at, len(s)):
        if (node := node.get(s[end])) is None:
            return
        for meaning, weight in node.get("", ()):
            yield end + 1, meaning, weight


def _reading(parts: tuple) -> tuple[str, str, float] | None:
    """(unit, dimension, factor) of (qualifier, prefix, root, plural, exponent), None if they don't go together."""
    power, prefix, root, _, exponent = parts
    dim, factor = BASE[root]
    square = power or exponent
    if power and exponent or square and dim != LENGTH or prefix and root not in ("m", "s"):
        return None
    prefix = prefix or 1.0
    if square:
        name = f"{_NAMES[prefix]}{root}2"
        return name, AREA, (prefix * factor) ** 2
    return f"{_NAMES[prefix]}{root}", dim, prefix * factor


@lru_cache(maxsize=100_000)
def readings(text: str) -> dict[str, tuple[float, tuple[str, str, float]]]:
    """The best reading of a whole unit string in each dimension: dimension -> (score, (unit, dimension, factor))."""
    s = text.lower().strip().rstrip(".")
    # states[position] = (score, parts) of the layers passed so far; the tries end long strings that are no unit
    states: dict[int, list[tuple[float, tuple]]] = {0: [(0.0, ())]} if s else {}
    for trie, needed in _LAYERS:
        after: dict[int, list[tuple[float, tuple]]] = {}
        for at, found in states.items():
            for score, parts in found:
                if not needed:
                    after.setdefault(at, []).append((score, (*parts, None)))
                start = at + (len(s[at:]) - len(s[at:].lstrip(" ")) if needed else 0)
                for end, meaning, weight in _matches(trie, s, start):
                    after.setdefault(end, []).append((score + weight, (*parts, meaning)))
        states = after
    best: dict[str, tuple[float, tuple[str, str, float]]] = {}
    for score, parts in states.get(len(s), ()):
        if (r := _reading(parts)) is not None and (r[1] not in best or score > best[r[1]][0]):
            best[r[1]] = score, r
    return best


def segment(text: str, asked: str | None, only: bool = False) -> tuple[str, str, float] | None:
    """The best reading (unit, dimension, factor) of a whole unit string, given the dimension asked for; `only` takes no other."""
    best = readings(text)
    if only:
        return best[asked][1] if asked in best else None
    return max(best.values(), key=lambda x: x[0] + (0.0 if asked is None or x[1][1] == asked else PRIOR_OTHER))[1] if best else None


_WORDNUM = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split())}
_FRACTIONS = {"½": 0.5, "¼": 0.25, "¾": 0.75, "⅓": 1 / 3, "⅔": 2 / 3, "⅛": 0.125, "⅜": 0.375, "⅝": 0.625, "⅞": 0.875}
_NUMBER = re.compile(r"(?<![\w.,])[-−+]?(?:\d+\s+\d+/\d+|\d+/\d+|\d[\d.,]*(?:e[+-]?\d+)?\s?[½¼¾⅓⅔⅛⅜⅝⅞]?|[½¼¾⅓⅔⅛⅜⅝⅞])|(?<=[a-z′'])\d+(?:[.,]\d+)?", re.I)
_SPOKEN = re.compile(rf"({'|'.join(_WORDNUM)})(?:\s+and\s+(?:a\s+)?(half|(?:three\s+)?quarters?))?(?![\w])", re.I)
_UNIT = re.compile(r"\s?-?\s?([′'’″\"”]{1,2}|(?:square|sq\.?|quadrat)?\s?(?:㎡|[^\W\d_]+(?:\(s\))?)(?:\^2|²|\*\*2|2(?!\d))?)", re.I)
_LEAD = re.compile(r"^(?:[\s~≈*`\"(]+|(?:approx(?:imately)?|about|roughly|around|circa|ca|nearly|almost|it(?: is|'s)|it|is|the answer(?: is)?|the (?:final |correct )?answer(?: is)?|my estimate(?: is)?|answer|antwort|etwa|ungefähr|estimate|i (?:would )?(?:say|estimate|guess|count|measure)|so|hence|therefore|equals?)\b[\s:=.~]*)+", re.I)
_JOIN = re.compile(r"\s*(?:and|und|,)?\s*", re.I)
_SENTENCE = re.compile(r"(?<=[\w)\]][.!?])\s+(?=[A-ZÄÖÜ~])|\n+")
_ANSWER = re.compile(r"<answer>(.*?)</answer>", re.S)
_BLOCK = re.compile(r"<(think|map)>.*?</\1>", re.S)
_GROUPED = re.compile(r"\d{1,3}(?:,\d{3})+(?:\.\d+)?(?!\d)")


def number(text: str) -> float | None:
    """`1,230` is grouped, `9,5` a decimal comma; mixed fractions and exponents are read."""
    s = text.strip().replace("−", "-").lower()
    total = 0.0
    if s and s[-1] in _FRACTIONS:
        total, s = _FRACTIONS[s[-1]], s[:-1].strip()
        if not s:
            return total
    try:
        if "/" in s:
            whole, _, frac = s.rpartition(" ")
            a, b = frac.split("/")
            return float(whole or 0) + float(a) / float(b)
        s = s.rstrip(".,")
        m = re.fullmatch(r"[-+]?" + _GROUPED.pattern, s)
        s = s.replace(",", "") if m else s.replace(",", ".")
        return float(s) + total
    except (ValueError, ZeroDivisionError):
        return None


def answer_part(text: str) -> str | None:
    """The final answer: the last answer block, else what follows closed reasoning; None if reasoning never ends."""
    if "<" in text:
        if found := _ANSWER.findall(text):
            return found[-1]
        text = _BLOCK.sub(" ", text)
        if "<think>" in text:
            return None
        text = re.sub(r"</?[a-zA-Z]\w*>?", " ", text)
    return text


_APART = re.compile(r"\s?((?:square|sq\.?)\s+[^\W\d_]+)", re.I)


def _unit_at(s: str, at: int, asked: str | None, only: bool) -> tuple[int, tuple[str, str, float], str] | None:
    """(end, reading, unit string) of the unit at a position."""
    m = _UNIT.match(s, at)
    if not m:
        return None
    raw = m.group(1)
    r = segment(raw, asked, only)
    if r is None:
        # `sq. ft.`: the qualifier and the root may be apart
        m = _APART.match(s, at)
        if not m or (r := segment(raw := re.sub(r"\s+", " ", m.group(1)), asked, only)) is None:
            return None
    end = m.end(1)
    return end + (s[end : end + 1] == "."), r, raw


def hypotheses(text: str | None, asked: str) -> list[tuple[str | None, float, list[tuple[float, tuple[str, str, float] | None]]]]:
    """(dimension, score, quantities) for every dimension in which the value's first unit can be read; one without a dimension if it has no unit."""
    said: list[str] = []
    found = quantities(text, asked, said=said)
    if not found or found[0][1] is None:
        return [(None, 0.0, found)] if found else []
    out = []
    for dim, (score, _) in readings(said[0]).items():
        other = found if found[0][1][1] == dim else quantities(text, dim, only=True)
        if other and other[0][1] is not None:
            out.append((dim, score, other))
    return out


def quantities(text: str | None, asked: str | None, only: bool = False, said: list[str] | None = None) -> list[tuple[float, tuple[str, str, float] | None]]:
    """The value stated as the final answer, as (number, unit or None); two entries or more for `2 ft 5 in`; [] for none. Unit strings are added to `said`."""
    if not text or (part := answer_part(text)) is None:
        return []
    for chunk in reversed([c for c in _SENTENCE.split(part.strip()) if c and c.strip()]):
        bare = _LEAD.sub("", chunk.strip())
        if (m := _SPOKEN.match(bare)) is not None:
            value = float(_WORDNUM[m.group(1).lower()]) + {None: 0.0, "half": 0.5, "quarter": 0.25}.get(m.group(2) and m.group(2).lower(), 0.75)
            hit = _unit_at(bare, m.end(), asked, only)
            if hit:
                if said is not None:
                    said.append(hit[2])
                return [(value, hit[1])]
            if re.match(r"\s*(?:[.,;!)*\"]|$)", bare[m.end() :]):
                return [(value, None)]
        if not (m := _NUMBER.search(chunk)):
            continue
        out: list[tuple[float, tuple[str, str, float] | None]] = []
        at = m.start()
        while m and m.start() == at and (value := number(m.group())) is not None:
            hit = _unit_at(chunk, m.end(), asked, only)
            if hit and said is not None:
                said.append(hit[2])
            if out and (hit is None or hit[1][1] != out[0][1][1]):
                break
            out.append((value, hit and hit[1]))
            if hit is None:
                break
            at = _JOIN.match(chunk, hit[0]).end()
            m = _NUMBER.match(chunk, at)
        if out:
            return out
    return []


_AREA_Q = re.compile(r"\barea\b|size of (?:this|the) room|how (?:large|big) is (?:this|the) room|floor space|fläche|raumgröße|square (?:m|f|y|c)", re.I)
_TIME_Q = re.compile(r"for how long|how long (?:does|did|do|has|have|was|were|will|is .*\b(?:seen|shown|visible|doing|video|clip))|\bduration\b|how much time|wie lange|how many (?:milli)?(?:seconds|minutes|hours)|\bdauer", re.I)
_LENGTH_Q = re.compile(r"how (?:far|tall|high|wide|deep|long|broad|thick)|\bdistance\b|\bdepth\b|dimension|\blength\b|longest side|\bwidth\b|\bheight\b|abstand|längste|entfern|wie (?:lang|weit|hoch|breit|tief)|\bapart\b|diameter|breite|höhe|länge", re.I)
_ASKED_IN = re.compile(r"(?:\bin|nearest|unit:?|einheit:?|units of|using|as)\s+((?:square |sq\.? ?)?[^\s?.!,()]+)\W*$", re.I)
_ASKED_MANY = re.compile(r"how many ((?:square |sq\.? ?)?[a-z]+)", re.I)


@lru_cache(maxsize=50_000)
def dimension(question: str) -> str | None:
    """What one quantity the question asks for."""
    return AREA if _AREA_Q.search(question) else TIME if _TIME_Q.search(question) else LENGTH if _LENGTH_Q.search(question) else None


@lru_cache(maxsize=50_000)
def asked_unit(question: str, dim: str) -> tuple[str, str, float] | None:
    """The unit a question names at its end, `(unit: cm)`, `in square feet`, `to the nearest inch`, or `how many seconds`."""
    q = question.strip()
    for text in [*reversed(re.findall(r"\((?:unit:?\s*)?([^()]{1,20})\)", q)), *(m.group(1) for m in (_ASKED_IN.search(q), _ASKED_MANY.search(q)) if m)]:
        if (r := segment(text, dim)) and r[1] == dim:
            return r
    return None


def note_units(note: str | None) -> dict[str, str]:
    """Per dimension the unit that a free-text note on a source names first; the preposition `in` is no unit here."""
    found: dict[str, str] = {}
    words = re.findall(r"[^\W\d_]+[²2]?|[㎡]|sq\.", note or "")
    for i, w in enumerate(words):
        if w.lower() in ("in", "as", "m2") and w.lower() != "m2":
            continue
        pair = f"{w.rstrip('.')} {words[i + 1]}" if w.lower().rstrip(".") in ("square", "sq") and i + 1 < len(words) else None
        if i and words[i - 1].lower().rstrip(".") in ("square", "sq"):
            continue
        r = segment(pair or w, None)
        if r and r[0] not in ("min",) or r and len(w) > 2:
            if len(w) > 2 or w in ("m", "s", "h", "cm", "mm", "ft", "yd", "ms", "m²", "m2", "㎡", "cm²", "sq"):
                found.setdefault(r[1], r[0])
    return found


def _factor(unit: str) -> float:
    return segment(unit, None)[2]


_OUT = "tab string, row_id bigint, field string, asked string, unit_from string, hyps array<struct<dim: string, score: double, common_value: double, parts: array<struct<value: double, unit: string>>>>"


def _entry(dim: str | None, score: float, total: float | None, parts: list[tuple[float, str | None]]) -> dict:
    return {"dim": dim, "score": score, "common_value": total, "parts": [{"value": v, "unit": u} for v, u in parts]}


def read_values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row per stated value with its readings, one for each dimension that its unit may have."""
    for pdf in batches:
        out = []
        for tab, row_id, field, q, text, nl, na, nt in zip(*(pdf[c] for c in ("tab", "row_id", "field", "question", "text", "note_length", "note_area", "note_time"))):
            if not q or (dim := dimension(q)) is None:
                continue
            hyps = hypotheses(text, dim)
            if not hyps:
                continue
            source = "value"
            if hyps[0][0] is None:
                number, source = hyps[0][2][0][0], "question"
                r = asked_unit(q, dim)
                if r is None:
                    name = {LENGTH: nl, AREA: na, TIME: nt}[dim]
                    source, r = "note", segment(name, dim) if isinstance(name, str) else None
                if r is None:
                    out.append((tab, row_id, field, dim, None, [_entry(None, 0.0, None, [(number, None)])]))
                    continue
                hyps = [(r[1], 0.0, [(number, r)])]
            out.append((tab, row_id, field, dim, source, [_entry(d, score, sum(v * r[2] for v, r in found), [(v, r[0]) for v, r in found]) for d, score, found in hyps]))
        yield pd.DataFrame(out, columns=["tab", "row_id", "field", "asked", "unit_from", "hyps"])


def field_priors(read: DataFrame) -> dict[str, float]:
    """`tab|field|asked|dimension` -> log prior, from the values whose unit has one dimension: as many entries as fields times nine."""
    sure = read.where("unit_from = 'value' AND size(hyps) = 1").groupBy("tab", "field", "asked", F.col("hyps")[0]["dim"].alias("dim")).agg(F.count("*").alias("n")).collect()
    counts: dict[tuple, dict[str, int]] = {}
    for r in sure:
        counts.setdefault((r.tab, r.field, r.asked), {})[r.dim] = r.n
    out = {}
    for (tab, field, asked), n in counts.items():
        weight = {d: n.get(d, 0) + (COUNT_ASKED if d == asked else COUNT_OTHER) for d in COMMON}
        for d, x in weight.items():
            out["|".join((tab, field, asked, d))] = math.log(x / sum(weight.values()))
    return out


def convert_values(values: DataFrame, notes: DataFrame) -> DataFrame:
    """One row per stated unit of `values` (tab, row_id bigint, field, source, question, text).

    notes: (source, note). Output: value and unit as stated, where the unit came from (value, question or
    note), the whole value in the common unit of its dimension. Texts that state no quantity, questions that
    ask for none, nulls and empty texts give no row; a value whose unit nothing tells has a null unit.
    Repeated deliveries give one row. Further columns are ignored; empty tables give an empty result.
    """
    from pyspark.sql.types import StringType

    @F.pandas_udf("length string, area string, time string")
    def units(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([{k: note_units(x).get(k) for k in (LENGTH, AREA, TIME)} for x in s], columns=[LENGTH, AREA, TIME])

    card = notes.where("source is not null").groupBy("source").agg(F.min("note").alias("note")).select("source", units(F.col("note").cast(StringType())).alias("u"))
    card = card.select("source", F.col("u.length").alias("note_length"), F.col("u.area").alias("note_area"), F.col("u.time").alias("note_time"))
    if notes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        card = F.broadcast(card)
    stated = values.where(F.col("question").isNotNull() & F.col("text").isNotNull() & F.col("row_id").isNotNull() & (F.length("text") > 0))
    stated = stated.where(F.col("question").rlike(f"(?i){_AREA_Q.pattern}|{_TIME_Q.pattern}|{_LENGTH_Q.pattern}"))
    joined = stated.join(card, "source", "left").select("tab", "row_id", "field", "question", "text", "note_length", "note_area", "note_time")
    read = cut(joined.mapInPandas(read_values, _OUT))  # texts are read once, for the priors and for the values
    priors = field_priors(read)
    known = F.create_map(*(F.lit(x) for pair in priors.items() for x in pair)) if priors else F.create_map().cast("map<string,double>")
    prior = lambda dim: F.coalesce(F.try_element_at(known, F.concat_ws("|", "tab", "field", "asked", dim)), F.when(dim == F.col("asked"), 0.0).otherwise(PRIOR_OTHER))
    ranked = F.transform("hyps", lambda h: F.struct((h["score"] + prior(h["dim"])).alias("rank"), h.alias("h")))
    best = F.when(F.size("hyps") == 1, F.col("hyps")[0]).otherwise(F.array_max(ranked)["h"])
    common = F.create_map(*(F.lit(x) for pair in COMMON.items() for x in pair))
    chosen = read.select("tab", "row_id", "field", "unit_from", best.alias("b"))
    return chosen.select("tab", "row_id", "field", "unit_from", "b.dim", "b.common_value", F.explode("b.parts").alias("p")).select(
        "tab", "row_id", "field", "p.value", "p.unit", "unit_from", "common_value", F.try_element_at(common, F.col("dim")).alias("common_unit")
    ).distinct()
