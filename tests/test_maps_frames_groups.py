import math
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import frames, objectmap
from tallyloom.operators import curation, groups, reports, rewards

NAMES = ["table", "coffee table", "chair"]


@pytest.mark.parametrize(
    "said,expected",
    [
        ('{"chair": [[1, 2], [3, 4]]}', {"chair": [[1, 2], [3, 4]]}),
        ("{'Chair': [(1.9, 2)]}", {"chair": [[1, 2]]}),
        ("str{'table': [[5, 5]]}", {"table": [[5, 5]]}),
        ("{'chair': [3, 4]}", {}),
        ("{'chair': (3, 4)}", {"chair": [[3, 4]]}),
        ("{'unknown': [[1, 2]]}", {}),
        ("coffee table at 1, 2 and table (3, 4), chair 5 6 7", {"coffee table": [[1, 2]], "table": [[3, 4]], "chair": [[5, 6]]}),
        ("tables 1 2", {}),
        ("", {}),
        (None, {}),
    ],
)
def test_parse_text(said, expected):
    assert objectmap.parse_text(said, NAMES) == expected


def test_parse_column_takes_both_paths(spark):
    rows = [(1, '{"chair": [[1, 2]]}'), (2, "{'Chair': [(1, 2)]}"), (3, "chair 4 5"), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "i int, s string").withColumn("n", F.array(*map(F.lit, NAMES)))
    got = {r.i: r.m for r in df.select("i", objectmap.parse(F.col("s"), F.col("n")).alias("m")).collect()}
    assert got == {1: {"chair": [[1, 2]]}, 2: {"chair": [[1, 2]]}, 3: {"chair": [[4, 5]]}, 4: {}, 5: {}}


def brute(resp, sol, n):
    total = sum(map(len, sol.values()))
    if not total:
        return None if sum(map(len, resp.values())) else 1.0
    out = 0.0
    for k, s in sol.items():
        r = resp.get(k, [])
        if not r or not s:
            continue
        pairs = sorted((math.dist(a, b), i, j) for i, a in enumerate(r) for j, b in enumerate(s))
        ri, sj, acc = set(), set(), 0.0
        for d, i, j in pairs:
            if i not in ri and j not in sj:
                ri.add(i)
                sj.add(j)
                acc += max(0.0, 1 - d / (n * math.sqrt(2)))
        out += acc / max(len(r), len(s)) * len(s)
    return out / total


def test_map_score_against_brute_force(spark):
    rng = random.Random(3)
    pts = lambda: [[rng.randint(0, 4), rng.randint(0, 4)] for _ in range(rng.randint(0, 3))]
    make = lambda: {k: pts() for k in rng.sample(NAMES, rng.randint(0, 3))}
    rows = [(i, make(), make()) for i in range(120)] + [(900, {}, {}), (901, {"chair": [[1, 1]]}, {})]
    df = spark.createDataFrame(rows, "i int, r map<string,array<array<int>>>, s map<string,array<array<int>>>")
    got = {x.i: x.v for x in df.select("i", objectmap.map_score(F.col("r"), F.col("s")).alias("v")).collect()}
    for i, r, s in rows:
        e = brute(r, s, 10)
        assert got[i] == (pytest.approx(e) if e is not None else None), (r, s)


def test_frames(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert [one(frames.round_by(F.lit(n), 28)) for n in (14, 42, 70, 15)] == [0, 56, 56, 28]  # halves to the even multiple
    assert one(frames.smart_resize(F.lit(1), F.lit(300))) is None
    r = one(frames.smart_resize(F.lit(10), F.lit(10)))
    assert (r.height, r.width) == (56, 56)
    assert one(frames.frame_indices(F.lit(10), F.lit(1))) == [0]
    assert one(frames.frame_indices(F.lit(10), F.lit(4))) == [0, 3, 6, 9]
    assert one(frames.truncated_indices(F.lit(10), F.lit(3))) == [0, 4, 9]
    assert one(frames.smart_nframes(F.lit(1), F.lit(1.0))) is None
    assert one(frames.padded_even(F.array(F.lit(1), F.lit(2), F.lit(3)))) == [1, 2, 3, 3]
    s = one(frames.sampled_frames(F.lit(90), F.lit(0.0), 4, 1))
    assert (s.n, s.duration, list(s.timestamps)) == (3, 3, [0, 1, 2])


def test_given_pixels_and_transposed_sides(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    budget = lambda given: one(frames.pixel_budget(F.lit(10), 1000, 200, 100, given))
    assert (budget(None), budget(F.lit(50)), budget(F.lit(10**6))) == (200.0, 50.0, 200.0)
    size = lambda h, w, t: tuple(one(frames.capped_size(F.lit(h), F.lit(w), transposed=t)))
    assert (size(896, 448, False), size(896, 448, True), size(100, 200, True)) == ((448, 224), (224, 448), (100, 200))


def test_regrouped(spark):
    rows = spark.createDataFrame([(i, i) for i in range(9)], "rn bigint, v int")
    owners = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "item bigint, process int")
    got = sorted((r.process, r.local, r.v) for r in groups.regrouped(rows, owners, 2).collect())
    assert got == [(0, 0, 2), (0, 1, 3), (1, 0, 0), (1, 1, 1), (1, 2, 4), (1, 3, 5)]


def test_unknown_tasks_raise_unless_told_otherwise(spark):
    df = spark.createDataFrame([("route_planning", "B", "B"), ("cooking", "B", "B")], "t string, p string, a string")
    for score in (reports.vsi_score, reports.spar_score):
        with pytest.raises(Exception, match="unknown task"):
            df.select(score(F.col("t"), F.col("p"), F.col("a"))).collect()
    assert [r[0] for r in df.coalesce(1).select(reports.vsi_score(F.col("t"), F.col("p"), F.col("a"), strict=False)).collect()] == [1.0, None]


def test_sub_task_report(spark):
    got = {(r.scope, r.name): (r.n, r.value) for r in reports.sti_report(spark.createDataFrame([("a", 1.0), ("b", 0.0), (None, 1.0)], "task string, score double"), sub_tasks=["a"]).collect()}
    assert got == {("task", "a"): (1, 1.0), ("task", "b"): (1, 0.0), ("task", "sr_sub"): (1, 1.0), ("overall", "overall"): (3, pytest.approx(2 / 3))}
    assert {r.name: r.value for r in reports.vsi_report(spark.createDataFrame([], "task string, score double")).collect()} == {"object_rel_direction": 0.0, "overall": 0.0}


def test_advantages_and_bonuses(spark):
    rows = [(1, i, a, n, True) for i, (a, n) in enumerate([(0.5, 319), (0.5, 320), (0.0, 400), (0.9, 512)])] + [(2, 0, 0.5, 400, True), (2, 1, 0.0, 400, True)] + [(3, i, 0.4, 513, False) for i in range(3)]
    df = spark.createDataFrame(rows, "group_id bigint, gen_idx int, acc double, length int, is_video boolean")
    got = {(r.group_id, r.gen_idx): r.len_bonus for r in groups.length_bonus(df).collect()}
    assert got == {(1, 0): 0.0, (1, 1): 0.2, (1, 2): 0.0, (1, 3): 0.2, (2, 0): 0.0, (2, 1): 0.0, (3, 0): 0.0, (3, 1): 0.0, (3, 2): 0.0}
    adv = groups.advantages(df, "acc").groupBy("group_id").agg(F.sum("advantage").alias("s"), F.max("group_std").alias("d")).collect()
    assert all(abs(r.s) < 1e-9 for r in adv) and {r.group_id: r.d for r in adv}[3] == pytest.approx(0.0)
    shuffled = spark.createDataFrame([(1, 0.1), (2, 0.9)], "group_id bigint, acc double")
    t = {(r.group_id, r.gen_idx): (r.acc_t, r.temporal) for r in groups.temporal_bonus(df, shuffled).collect()}
    assert t[1, 0] == (0.8, 1.0) and t[1, 2] == (0.0, 1.0) and t[2, 0] == (0.5, 0.0) and t[3, 0] == (0.4, 0.5)


def test_completion_mask(spark):
    df = spark.createDataFrame([([5, 0, 7, 0],), ([1, 2],), ([0, 1],)], "ids array<bigint>")
    got = [(r.n, r.m) for r in df.select(groups.completion_length(F.col("ids"), 0).alias("n"), groups.completion_mask(F.col("ids"), 0).alias("m")).collect()]
    assert got == [(2, [1, 1, 0, 0]), (2, [1, 1]), (1, [1, 0])]


def test_shards_cover_all_rows_evenly(spark):
    for n, w in ((10, 4), (7, 3), (3, 4), (60, 7), (0, 3)):
        df = curation.numbered(spark.range(n), ["id"]).withColumn("shard", curation.shard_of(F.col("rn"), F.lit(n), w))
        got = [r.shard for r in df.orderBy("rn").collect()]
        sizes = [n // w + (i < n % w) for i in range(w)]
        assert got == [i for i, k in enumerate(sizes) for _ in range(k)]


def test_direction_roll_up_needs_all_three(spark):
    rows = [("object_rel_direction_easy", 1.0), ("object_rel_direction_hard", 1.0), ("route_planning", 0.5), (None, 1.0)]
    got = {r.name: r.value for r in reports.vsi_report(spark.createDataFrame(rows, "task string, score double")).collect()}
    # the medium level is missing: easy is gone, hard stays, the roll-up is 0 and counts
    assert got == {"object_rel_direction": 0.0, "object_rel_direction_hard": 1.0, "route_planning": 0.5, "overall": 0.5}


def test_spar_view_change_is_in_no_tier(spark):
    rows = [("view_change_infer", "a", 1.0), ("position_matching", "a", 0.5), ("depth_prediction_oc", "b", 0.2)]
    got = {(r.scope, r.image_type, r.name): r.value for r in reports.spar_report(spark.createDataFrame(rows, "task string, image_type string, score double")).collect()}
    assert got["tier", None, "Middle"] == 0.5 and got["tier", None, "High"] is None and got["overall", None, "overall"] == pytest.approx((1 + 0.5 + 0.2) / 3)


def test_map_guided_reward(spark):
    maps = spark.createDataFrame([("v1", {"chair": [[1, 2]]}, ["chair"])], "video_id string, cognitive_map map<string,array<array<int>>>, object_list array<string>")
    say = lambda m: f"<think>t</think><map>{m}</map><answer>B</answer>"
    rows = [(1, "multiple choice", say('{"chair": [[1, 2]]}'), "<answer>B</answer>", "x/v1.mp4"), (2, "multiple choice", say("none"), "<answer>B</answer>", "x/v1.mp4"), (3, "multiple choice", say("none"), "<answer>C</answer>", "x/v1.mp4"), (4, "multiple choice", "<answer>B</answer>", "<answer>B</answer>", "x/v9.mp4"), (5, "other", "<answer>B</answer>", "<answer>B</answer>", None)]
    df = spark.createDataFrame(rows, "i int, problem_type string, completion string, solution string, path string")
    twice = maps.withColumn("at", F.lit(2)).unionByName(spark.createDataFrame([("v1", {"chair": [[9, 9]]}, ["chair"], 1), (None, {"chair": [[9, 9]]}, ["chair"], 3)], "video_id string, cognitive_map map<string,array<array<int>>>, object_list array<string>, at int"))
    assert {r.i: r.reward for r in rewards.map_guided(df, twice, order="at").collect()} == {r.i: r.reward for r in rewards.map_guided(df, maps).collect()} == {1: 2.0, 2: 0.0, 3: 0.0, 4: 1.0, 5: 0.0}


def test_rewards_by_type(spark):
    wrap = lambda s: f"<answer>{s}</answer>"
    rows = [
        (1, "OCR", wrap("one two three"), wrap("one two four"), pytest.approx(2 / 3)), (2, "OCR", wrap("x"), wrap("a b"), 0.0), (3, "free-form", wrap("a lamp stands here"), wrap("a lamp stands here"), pytest.approx(1.0)),
        (4, "regression", wrap("1,000"), wrap("1000"), pytest.approx(1.0)), (5, "regression", wrap("many"), wrap("10"), 0.0), (6, "numerical", wrap("9"), wrap("10"), 0.9), (7, "numerical", wrap("9"), wrap("0"), 0.0),
        (8, "multiple choice", wrap(" B "), wrap("B"), 1.0), (9, "multiple choice", wrap("b"), wrap("B"), 0.0), (10, "unheard of", wrap("B"), wrap("B"), 0.0), (11, None, None, None, 0.0), (12, "multiple choice", "B", wrap("B"), 0.0),
    ]
    df = spark.createDataFrame([r[:4] for r in rows], "i int, t string, c string, s string")
    got = {r.i: r.v for r in df.select("i", rewards.base_reward(F.col("t"), F.col("c"), F.col("s")).alias("v")).collect()}
    assert got == {r[0]: r[4] for r in rows}
    with pytest.raises(KeyError):
        rewards.total_reward(["nothing"], F.col("t"), F.col("c"), F.col("s"))
