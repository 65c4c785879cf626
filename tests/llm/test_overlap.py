import random

import pandas as pd
import pytest

from tallyloom.llm import joins, overlap


@pytest.mark.parametrize(
    "path,key",
    [("train/video/hall_0000010_00_480p.MP4 ", "hall_0000010_00"), ("media\\video\\Hall_0000010_00.avi", "hall_0000010_00"), ("/store/SR/HALL%5F0000010%5F00.mkv?t=3", "hall_0000010_00"), ("clip00300104", "clip_00300104"), ("./x//CLIP00300104.PNG", "clip_00300104"), ("", ""), ("///", ""), (None, "")],
)
def test_clip_key(path, key):
    assert overlap.clip_key(path) == key


def test_edits_against_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        w = "".join(rng.choice("abcd") for _ in range(rng.randint(3, 7)))
        i = rng.randrange(len(w) - 1)
        swapped, dropped, changed = w[:i] + w[i + 1] + w[i] + w[i + 2 :], w[:i] + w[i + 1 :], w[:i] + "z" + w[i + 1 :]
        assert overlap.edits(w, swapped) <= 1 and overlap.edits(w, dropped) == 1 and overlap.edits(w, changed) == 1
    assert overlap.edits("", "abc") == 3 and overlap.edits("lamp", "piano") > 2


QS = ["How many {} are there in this room?", "What is the distance between the {} and the {} in meters?", "Which of these objects ({}, {}, {}) is closest to the {}?", "Does a {} start before or after the {}?"]
THINGS = ["lamp", "sofa", "wardrobe", "television", "microwave", "bicycle", "curtain", "kettle"]


def ask(rng):
    q = rng.choice(QS)
    return q.format(*rng.sample(THINGS, q.count("{}")))


def slip(q, rng):
    words = q.split(" ")
    long = [i for i, w in enumerate(words) if len(w) > 5 and w.isalpha()]
    if long:
        i = rng.choice(long)
        w = words[i]
        at = rng.randrange(1, len(w) - 2)
        words[i] = w[:at] + w[at + 1] + w[at] + w[at + 2 :]
    return " ".join(words)


@pytest.mark.parametrize("size", [20_000, 40, 9])
def test_overlaps_against_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(overlap, "SHARD_TEXTS", size)  # the hot video is split, at 9 on both sides into many parts
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 3 if size == 9 else 50_000)
    rng = random.Random(4)
    clips = ["hot_001_00"] * 6 + [f"hall_{i:03d}_00" for i in range(6)]
    evals = [("e", i, rng.choice(clips), ask(rng)) for i in range(120)]
    forms = [lambda q: q, lambda q: f"Question: {q.lower()}", lambda q: q.replace("?", ", please?"), lambda q: slip(q, rng), lambda q: q + "\nOptions:\nA. 1\nB. 2", lambda q: q.replace("in meters", "(m)")]
    train, truth = [], set()
    for i in range(400):
        clip, q = rng.choice(clips), ask(rng)
        if rng.random() < 0.5:
            _, _, clip, q = rng.choice(evals)
        train.append((i, f"train/x/{clip.upper()}_480p.mp4", rng.choice(forms)(q), "src"))
        truth |= {(t, e, i) for t, e, c, text in evals if c == clip and text == q}
    E = spark.createDataFrame([(*r, 0) for r in evals + [("e", 900, None, "x y"), ("e", 901, "hot_001_00", None), ("e", None, "hot_001_00", evals[0][3]), evals[0]]], "tab string, eval_id bigint, clip string, text string, n int")
    T = spark.createDataFrame([(*r, 0) for r in train + [(9000, None, "x", "s"), (9001, "hot_001_00.mp4", None, "s"), (9002, "hot_001_00.mp4", "", None), (9003, "hot_001_00.mp4", "lamp " * 30_000, "s"), train[0]]], "problem_id bigint, clip string, text string, data_source string, n int")
    got = {(r.tab, r.eval_id, r.problem_id) for r in overlap.find_overlaps(E, T).collect()}
    assert got == truth and len(truth) > 100
    classes = overlap.overlap_classes(E, T).collect()
    assert len({(r.tab, r.eval_id, r.problem_id) for r in classes}) == len(classes) <= len(truth) and sum(r.n_eval * r.n_train for r in classes) >= len(truth)
    assert overlap.find_overlaps(E.limit(0), T).count() == 0 == overlap.find_overlaps(E, T.limit(0)).count()


def test_other_objects_numbers_and_directions_are_other_questions():
    left = pd.DataFrame([("v", overlap.canonical(q)) for q in ("How tall is the stool in feet?", "Turn left at frame 12", "What happens at the start of the video?")], columns=["clip", "text"])
    right = pd.DataFrame([("v", overlap.canonical(q)) for q in ("How tall is the stove in feet?", "Turn right at frame 12", "Turn left at frame 13", "What happens at the end of the video?", "How tall is the stool in cm?")], columns=["clip", "text"])
    assert not len(overlap.match_shard((0, 0), left, right))


def brute_coverage(words, matched):
    inside = {j for i, p in enumerate(overlap._passages(words)) if p in matched for j in (i, min(i + 1, len(words) - 1))}
    return len(inside) / len(words)


def test_coverage_merges_intervals():
    rng = random.Random(2)
    for _ in range(500):
        words = [rng.choice("abcdef") for _ in range(rng.randint(1, 8))]
        matched = {p for p in overlap._passages(words) if rng.random() < 0.5}
        assert overlap.coverage(words, matched) == pytest.approx(brute_coverage(words, matched))


@pytest.mark.parametrize("least,found", [(0.5, True), (0.8, True), (0.81, False), (1.0, False)])
def test_the_threshold_decides_on_texts_with_words_put_in(monkeypatch, least, found):
    monkeypatch.setattr(overlap, "MIN_COVERAGE", least)
    left, right = (pd.DataFrame([("v", overlap.canonical(q))], columns=["clip", "text"]) for q in ("How tall is the filing cabinet in millimetres?", "How tall is the filing cabinet expessed in millimetres?"))
    got = overlap.match_shard((), left, right)
    assert len(got) == found and (not found or got["coverage"][0] == 0.8)


def test_verdict_on_a_pair_does_not_depend_on_the_other_videos_of_its_shard():
    evals = [("v", "How many stools are in the picture of a bathroom?"), ("u", "Does the carefully drawn bathrom appear?")]
    train = [("v", "Carefully: How many stools are in the picture of a bathrom?"), *(("u", f"Is bathrom {i} seen by itself?") for i in range(9))]
    left, right = (pd.DataFrame([(c, overlap.canonical(q)) for c, q in rows], columns=["clip", "text"]) for rows in (evals, train))
    alone = overlap.match_shard((0, 0), left[:1], right[:1])
    together = overlap.match_shard((0, 0), left, right)
    assert len(alone) == 1 and alone.equals(together[together["clip"] == "v"].reset_index(drop=True))


def test_words_of_a_split_video_count_in_all_its_shards(spark, monkeypatch):
    rows = [(1, "v", "How many stools stand in the bathrom?", "s"), *((10 + i, "v", f"Is bathrom {i} seen by itself?", "s") for i in range(9))]
    E = spark.createDataFrame([("e", 1, "v", "How many stools stand in the bathroom?")], "tab string, eval_id bigint, clip string, text string")
    T = spark.createDataFrame(rows, "problem_id bigint, clip string, text string, data_source string")
    for size in (20_000, 1):
        monkeypatch.setattr(overlap, "SHARD_TEXTS", size)
        assert overlap.find_overlaps(E, T).count() == 0  # too frequent in the video to be a slip
