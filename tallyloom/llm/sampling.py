"""Sample matching target category proportions by min-cost flow on cross-classified cells.

Cells are category x stratum. Arcs from the source carry each category's floor and target, cell arcs its
availability, arcs to the sink the strata's margins, and slack arcs what cannot be met: a category falls short
where its slack arc carries flow. Flow is counted in UNITs of a record, so that targets and margins need no rounding;
the fractions of the cells are then rounded at random, by shifting mass along cycles and paths of fractional cells,
which keeps every cell's expectation and each category's and stratum's total next to its own. Records are drawn at
random within cells: a count of hash buckets finds the bucket at which a cell's quota ends, and only that bucket is sorted.

The driver holds at most MAX_CELLS cells. With more, the rarer strata share cells by a hash: targets, floors
and shortfalls stay exact, margins hold for the large strata and for each group of small ones.
"""

from __future__ import annotations

import heapq
import math
import random

from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut

#: Hash buckets per cell for the draw.
DRAW_BUCKETS = 4096
#: Costs of missing a floor, of missing a target, of leaving a stratum's margin.
FLOOR_COST, TARGET_COST, MARGIN_COST = 10_000, 100, 1
#: Flow units per record.
UNIT = 1000
#: Cells that the driver holds; with more, rare strata share cells.
MAX_CELLS = 200_000


class Flow:
    """Min-cost flow, primal-dual: one Dijkstra per path cost, then blocking flows over the arcs of no reduced cost."""

    def __init__(self) -> None:
        self.arcs: list[list] = []  # to, capacity, cost; arc ^ 1 is the reverse
        self.out: dict[object, list[int]] = {}

    def add(self, a: object, b: object, capacity: int, cost: int) -> int:
        for x, y, c, k in ((a, b, capacity, cost), (b, a, 0, -cost)):
            self.out.setdefault(x, []).append(len(self.arcs))
            self.out.setdefault(y, [])
            self.arcs.append([y, c, k])
        return len(self.arcs) - 2

    def _price(self, s: object, t: object, potential: dict) -> bool:
        order = {v: i for i, v in enumerate(self.out)}
        dist, heap = {s: 0}, [(0, order[s], s)]
        while heap:
            d, _, v = heapq.heappop(heap)
            if d > dist[v]:
                continue
            for e in self.out[v]:
                w, c, k = self.arcs[e]
                if c > 0 and (nd := d + k + potential[v] - potential[w]) < dist.get(w, 1 << 60):
                    dist[w] = nd
                    heapq.heappush(heap, (nd, order[w], w))
        if t not in dist:
            return False
        for v in potential:
            potential[v] += min(dist.get(v, dist[t]), dist[t])
        return True

    def _block(self, s: object, t: object, potential: dict) -> bool:
        """One blocking flow over the arcs of no reduced cost; False if there is no path."""
        free = lambda v, e: self.arcs[e][1] > 0 and self.arcs[e][2] + potential[v] == potential[self.arcs[e][0]]
        level, queue = {s: 0}, [s]
        for v in queue:
            for e in self.out[v]:
                if free(v, e) and self.arcs[e][0] not in level:
                    level[self.arcs[e][0]] = level[v] + 1
                    queue.append(self.arcs[e][0])
        if t not in level:
            return False
        at, path, v = dict.fromkeys(level, 0), [], s
        while True:
            if v == t:
                amount = min(self.arcs[e][1] for e in path)
                for e in path:
                    self.arcs[e][1] -= amount
                    self.arcs[e ^ 1][1] += amount
                path, v = [], s
            while at[v] < len(self.out[v]) and not (free(v, e := self.out[v][at[v]]) and level.get(self.arcs[e][0]) == level[v] + 1):
                at[v] += 1
            if at[v] < len(self.out[v]):
                path.append(e)
                v = self.arcs[e][0]
            elif path:
                v = self.arcs[path.pop() ^ 1][0]
                at[v] += 1
            else:
                return True

    def run(self, s: object, t: object) -> None:
        potential = dict.fromkeys(self.out, 0)
        while self._price(s, t, potential):
            while self._block(s, t, potential):
                pass

    def on(self, e: int) -> int:
        return self.arcs[e ^ 1][1]


def round_cells(cells: dict[tuple, int], rng: random.Random) -> dict[tuple, int]:
    """Whole numbers for cells given in UNITs: each cell, row and column next to its own value, each cell with its value as expectation."""
    value = dict(cells)
    near: dict[tuple, dict[tuple, None]] = {}
    for (a, b), v in value.items():
        if v % UNIT:
            near.setdefault((0, a), {})[1, b] = None
            near.setdefault((1, b), {})[0, a] = None
    cell = lambda x, y: (x[1], y[1]) if x[0] == 0 else (y[1], x[1])
    ends = [v for v in near if len(near[v]) == 1]
    nodes = list(near)
    while near:
        while ends and (ends[-1] not in near or len(near[ends[-1]]) != 1):
            ends.pop()
        while nodes and nodes[-1] not in near:
            nodes.pop()
        walk = [(ends or nodes)[-1]]  # along fractional cells to a dead end or round a cycle
        position, last = {walk[0]: 0}, None
        while True:
            onward = next((x for x in near[walk[-1]] if x != last), None)
            if onward is None:
                break
            last = walk[-1]
            walk.append(onward)
            if onward in position:
                walk = walk[position[onward] :]
                break
            position[onward] = len(walk) - 1
        steps = [cell(x, y) for x, y in zip(walk, walk[1:])]
        rest = [value[k] % UNIT for k in steps]
        up = min((UNIT - f if i % 2 == 0 else f) for i, f in enumerate(rest))
        down = min((f if i % 2 == 0 else UNIT - f) for i, f in enumerate(rest))
        move = up if rng.random() * (up + down) < down else -down
        for i, k in enumerate(steps):
            value[k] += move if i % 2 == 0 else -move
            if value[k] % UNIT == 0:
                x, y = (0, k[0]), (1, k[1])
                for v, w in ((x, y), (y, x)):
                    near[v].pop(w)
                    if not near[v]:
                        del near[v]
                    elif len(near[v]) == 1:
                        ends.append(v)
    return {k: v // UNIT for k, v in value.items()}


def quotas(cells: dict[tuple[str, str], int], targets: dict[str, float], n: int, min_rows: int, seed: int = 5) -> tuple[dict[tuple[str, str], int], dict[str, float]]:
    """Cell -> number of records to draw, and category -> records missing on its slack arc, given cell -> available records and category -> share."""
    names = sorted(targets)
    wanted = {c: math.ceil(targets[c] * n * UNIT - 1e-6) for c in names}
    usable = {k: a for k, a in cells.items() if k[0] in targets and a > 0}
    strata = sorted({s for _, s in usable})
    per = dict.fromkeys(strata, 0)
    for (_, s), a in usable.items():
        per[s] += a
    total, floor = sum(per.values()) or 1, min_rows * UNIT
    size = sum(max(wanted[c], floor) for c in names)
    g, arc, slack = Flow(), {}, {}
    for c in names:
        g.add("S", ("c", c), floor, 0)
        g.add("S", ("c", c), max(0, wanted[c] - floor), 0)
        slack[c] = [g.add(("c", c), ("slack", c), floor, FLOOR_COST), g.add(("c", c), ("slack", c), max(0, wanted[c] - floor), TARGET_COST)]
        g.add(("slack", c), "T", max(wanted[c], floor), 0)
    for (c, s), a in sorted(usable.items()):
        arc[c, s] = g.add(("c", c), ("s", s), a * UNIT, 0)
    for s in strata:
        g.add(("s", s), "T", size * per[s] // total, 0)
        g.add(("s", s), "T", size, MARGIN_COST)
    g.run("S", "T")
    return round_cells({k: g.on(e) for k, e in arc.items()}, random.Random(seed)), {c: sum(map(g.on, slack[c])) / UNIT for c in names}


def category(col):
    """Uneven spellings of a category as one: lower case, words joined by `_`."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(col)), r"[^\p{L}\p{N}]+", "_"), r"^_+|_+$", "")
    return F.when(s != "", s)


def _coarse(distinct: DataFrame, categories: int) -> DataFrame:
    """`distinct` with the stratum of a record's cell: its own for the largest strata, a shared one for the others, so that there are at most MAX_CELLS cells."""
    keep = max(1, MAX_CELLS // (2 * max(1, categories)))
    large = distinct.groupBy("stratum").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "stratum").limit(keep).select("stratum", F.col("stratum").alias("own"))
    return distinct.join(large, "stratum", "left").withColumn("cell", F.coalesce(F.concat(F.lit("="), "own"), F.concat(F.lit("#"), F.pmod(F.xxhash64("stratum"), F.lit(keep))))).drop("own")


def draw(records: DataFrame, targets: dict[str, float], sample_pct: int, min_rows: int, seed: int = 5) -> tuple[DataFrame, DataFrame]:
    """The sample (record_id, category, stratum), and a report per category.

    records: (record_id bigint, category string, stratum string). Repeated ids count once, null ids not at
    all; a null category counts towards the sample's size but is never drawn; a null stratum is a stratum.
    Report: category, target_share, sample_size, available, wanted, drawn, missing, falls_short; missing is the flow
    on the category's slack arcs, the records that its target or floor lacks, and falls_short whether there is any.
    An empty table draws none.
    """
    spark = records.sparkSession
    distinct = records.where("record_id is not null").groupBy("record_id").agg(F.min("category").alias("category"), F.coalesce(F.min("stratum"), F.lit("")).alias("stratum"))
    distinct = cut(distinct.select("record_id", category(F.col("category")).alias("category"), "stratum"))
    names = list(targets)
    n = distinct.count() * sample_pct // 100
    wanted_only = distinct.where(F.col("category").isin(names))
    counted = wanted_only.groupBy("category", "stratum").agg(F.count("*").alias("n"))
    many = counted.limit(MAX_CELLS + 1).count() > MAX_CELLS
    pool = _coarse(wanted_only, len(names)) if many else wanted_only.withColumn("cell", F.col("stratum"))
    rows = pool.groupBy("category", "cell").agg(F.count("*").alias("n")).collect()  # MAX_CELLS at most
    cells = {(r.category, r.cell): r.n for r in rows}
    quota, missing = quotas(cells, targets, n, min_rows, seed)
    drawn = spark.createDataFrame([(c, s, q) for (c, s), q in quota.items() if q], "category string, cell string, quota bigint")
    h = F.xxhash64("record_id", F.lit(seed))
    pool = pool.join(F.broadcast(drawn), ["category", "cell"]).withColumn("h", h).withColumn("bucket", F.pmod("h", F.lit(DRAW_BUCKETS)))
    per = pool.groupBy("category", "cell", "quota", "bucket").agg(F.count("*").alias("n"))
    w = Window.partitionBy("category", "cell").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = per.select("category", "cell", "bucket", "n", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    placed = pool.join(before, ["category", "cell", "bucket"])
    inside = placed.where("before + n <= quota")
    edge = placed.where("before < quota and before + n > quota")
    rank = F.row_number().over(Window.partitionBy("category", "cell", "bucket").orderBy("h", "record_id"))
    edge = edge.withColumn("rank", rank).where("rank <= quota - before").drop("rank")
    sample = inside.unionByName(edge).select("record_id", "category", "stratum")
    have, got = dict.fromkeys(names, 0), dict.fromkeys(names, 0)
    for (c, s), a in cells.items():
        have[c] += a
        got[c] += quota.get((c, s), 0)
    report = [(c, share, n, have[c], share * n, got[c], missing[c], missing[c] > 0) for c, share in sorted(targets.items())]
    return sample, spark.createDataFrame(report, "category string, target_share double, sample_size bigint, available bigint, wanted double, drawn bigint, missing double, falls_short boolean")
