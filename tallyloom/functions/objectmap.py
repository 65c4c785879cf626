"""Object maps: names to points on a grid. Parsing of answer text, and the greedy matching score.

The score is a fold over candidate pairs sorted by (distance, response index, solution index), in the JVM.
Text that is no JSON goes through one Arrow function.
"""

from __future__ import annotations

import ast
import math
import re

import pandas as pd
from pyspark.sql import Column, functions as F

from . import text

POINTS = "map<string,array<array<int>>>"
# What counts as a number and as a name.
_NUMBERS = re.compile(r"-?\d+(?:\.\d+)?")
_ELEMENT = re.compile(text.ELEMENT)
_NAME = re.compile(r"^[^\w\s]*([\w\s]+)[^\w\s]*$")


def _whole(x: object) -> int | None:
    if isinstance(x, bool):
        return None
    if isinstance(x, (int, float)):
        return int(x) if math.isfinite(x) else None
    m = _ELEMENT.match(x.strip()) if isinstance(x, str) else None
    return int(float(m.group(1))) if m else None


def point(x: object) -> list[int] | None:
    """A pair of numbers, a pair inside one more bracket, or the first two numbers of a text; decimals lose their fraction."""
    if isinstance(x, str):
        found = _NUMBERS.findall(x)
        return [int(float(v)) for v in found[:2]] if len(found) >= 2 else None
    if not isinstance(x, (list, tuple)):
        return None
    if len(x) == 1 and isinstance(x[0], (list, tuple, str)):
        return point(x[0])
    if len(x) != 2:
        return None
    a, b = map(_whole, x)
    return None if a is None or b is None else [a, b]


def points(x: object) -> list[list[int]]:
    """The valid points of a list; anything but a list is tried as one point, so a flat list of two numbers gives none."""
    found = [point(v) for v in x] if isinstance(x, list) else [point(x)]
    return [p for p in found if p is not None]


def from_mapping(d: dict, names: set[str]) -> dict[str, list[list[int]]]:
    out: dict[str, list[list[int]]] = {}
    for key, value in d.items():
        m = _NAME.match(str(key).lower().strip())
        name = m.group(1).strip() if m else None
        if name in names and (found := points(value)):
            out.setdefault(name, []).extend(found)
    return out


def from_prose(s: str, names: set[str]) -> dict[str, list[list[int]]]:
    """Each accepted mention of a name owns the numbers up to the next one, taken in pairs.

    Mentions are swept by (start, longer first); one that begins within the last accepted is dropped unless it
    reaches further, in which case it takes its place.
    """
    hits = sorted((m.start(), -m.end(), n) for n in names for m in re.finditer(rf"(?<![a-zA-Z]){re.escape(n)}(?![a-zA-Z])", s, re.I))
    kept: list[tuple[int, int, str]] = []
    for start, end, name in ((a, -b, n) for a, b, n in hits):
        if kept and start < kept[-1][1]:
            if end > kept[-1][1]:
                kept[-1] = (start, end, name)
            continue
        kept.append((start, end, name))
    out: dict[str, list[list[int]]] = {}
    for k, (_, end, name) in enumerate(kept):
        region = s[end : kept[k + 1][0] if k + 1 < len(kept) else len(s)]
        v = [int(float(x)) for x in _NUMBERS.findall(region)]
        if pairs := [[v[i], v[i + 1]] for i in range(0, len(v) - 1, 2)]:
            out.setdefault(name, []).extend(pairs)
    return out


def parse_text(s: str | None, object_names: list[str]) -> dict[str, list[list[int]]]:
    """A literal mapping if the text is one (maybe inside `str{...}`), else what its prose says."""
    if not isinstance(s, str) or not s.strip():
        return {}
    names = {n.lower().strip() for n in object_names}
    bare = s.strip()
    inner = re.fullmatch(r"str\s*(\{.*\})", bare, re.S)
    body = inner.group(1) if inner else bare
    if body.startswith("{") and body.endswith("}"):
        try:
            d = ast.literal_eval(body)
            if isinstance(d, dict):
                return from_mapping(d, names)
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            pass
    return from_prose(bare, names)


def _parse_batch(s: pd.Series, names: pd.Series) -> pd.Series:
    return pd.Series([parse_text(a, [] if b is None else list(b)) for a, b in zip(s, names)])


def parse(c: Column, names: Column) -> Column:
    """Text to an object map; a JSON object whose keys are all known lower-case names never leaves the JVM."""
    fast = F.from_json(c, POINTS, {"allowSingleQuotes": "true"})
    known = F.transform(names, lambda n: F.trim(F.lower(n)))
    clean = F.forall(F.map_entries(fast), lambda e: F.array_contains(known, e["key"]) & e["value"].isNotNull() & F.forall(e["value"], lambda p: p.isNotNull() & (F.size(p) == 2) & F.get(p, F.lit(0)).isNotNull() & F.get(p, F.lit(1)).isNotNull()))
    usable = fast.isNotNull() & (F.size(fast) > 0) & clean
    slow = F.pandas_udf(_parse_batch, POINTS)
    return F.when(usable, fast).otherwise(slow(F.when(usable, F.lit("")).otherwise(c), names))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.pow(F.get(a, F.lit(0)) - F.get(b, F.lit(0)), 2) + F.pow(F.get(a, F.lit(1)) - F.get(b, F.lit(1)), 2))


def _type_score(response: Column, solution: Column, n: Column) -> Column:
    """Greedy closest pairs of one object type, each worth max(0, 1 - d / (n sqrt 2)), over the larger number of points."""
    candidates = F.array_sort(
        F.flatten(
            F.transform(response, lambda a, i: F.transform(solution, lambda b, j: F.struct(distance(a, b).alias("d"), i.alias("r"), j.alias("s"))))
        )
    )
    start = F.struct(F.lit(0.0).alias("total"), F.array().cast("array<int>").alias("rs"), F.array().cast("array<int>").alias("ss"))

    def step(acc: Column, c: Column) -> Column:
        worth = F.greatest(F.lit(0.0), 1 - c["d"] / (n * F.lit(math.sqrt(2.0))))
        free = ~F.array_contains(acc["rs"], c["r"]) & ~F.array_contains(acc["ss"], c["s"])
        taken = F.struct((acc["total"] + worth).alias("total"), F.array_append(acc["rs"], c["r"]).alias("rs"), F.array_append(acc["ss"], c["s"]).alias("ss"))
        return F.when(free, taken).otherwise(acc)

    return F.aggregate(candidates, start, step, lambda acc: acc["total"]) / F.greatest(F.size(response), F.size(solution))


def map_score(response: Column, solution: Column, n: int = 10) -> Column:
    """Solution-weighted mean of the type scores; two empty maps score 1, an empty solution against a response is null."""
    size = F.lit(float(n))
    none = F.array().cast("array<array<int>>")
    entries = F.map_entries(solution)
    total = F.aggregate(entries, F.lit(0), lambda acc, e: acc + F.size(e["value"]))

    def weighted(acc: Column, e: Column) -> Column:
        mine = F.coalesce(F.try_element_at(response, e["key"]), none)
        score = F.when((F.size(mine) == 0) | (F.size(e["value"]) == 0), 0.0).otherwise(_type_score(mine, e["value"], size))
        return acc + score * F.size(e["value"])

    said = F.aggregate(F.map_entries(response), F.lit(0), lambda acc, e: acc + F.size(e["value"]))
    return F.when((total == 0) & (said == 0), 1.0).when(total > 0, F.aggregate(entries, F.lit(0.0), weighted) / total)
