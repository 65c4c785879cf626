import random

import pandas as pd
import pytest

from tallyloom.llm import textstate as ts, truncation

SENTENCES = ["The {} is placed against the wall.", "Looking at the {}, the view stops in front of the door.", "I count {} of them in the room.", "The answer is {}."]
NAMES = ["lamp", "wardrobe", "mirror", "television", "piano", "cushion"]


def corpus(rng, n=400):
    return [" ".join(rng.choice(SENTENCES).format(rng.choice(NAMES)) for _ in range(rng.randint(1, 4))) for _ in range(n)]


@pytest.mark.parametrize(
    "s,cut",
    [("<think>a", True), ("<think>a</think><answer>B", True), ("<think>a</think>\n<answ", True), ("x &am", True), ("x \\u20", True), ("caf�", True), ("first there is the lamp,", True), ("<think>a</think><answer>B</answer>", False), ("B", False), ("A & B", False), ("5 < 6", False), ("", False), ("R&D is fine.", False), ("so,", True), ("-", False), (":", False), ("The label says “Öppna", True), ("the side (left", True), ("(A) left", False)],
)
def test_structure(s, cut):
    assert ts.structurally_cut(s, ts.Tally().add(s)) is cut


@pytest.mark.parametrize("s,yes", [("two and a half m", True), ("The answer is 14′ 10″", True), ("the option that", False), ("from the two ear", False), ("8 ft 1 in", True), ("I can see seven cha", False), ("one of the", False)])
def test_quantity(s, yes):
    assert ts.is_quantity(s) is yes


def brute(rows):
    """(n_end, n_on, n_in) of every probe, by comparing it with every string."""
    out = {}
    for p, _, probe in rows:
        if probe:
            after = [(s[len(p) :], n) for s, n, _ in rows if s != p and s.startswith(p)]
            out[p] = (sum(n for a, n in after if a == ts.END), sum(n for a, n in after if a != ts.END), sum(n for a, n in after if a[0].isalpha()), sum(n for a, n in after if a != ts.END and not a[0].isalpha() and a[0] != " "))
    return out


def strings_of(rng, n, longest, alphabet="ab ,\né🙂"):
    words = sorted({"".join(rng.choice(alphabet) for _ in range(rng.randint(1, longest))).replace("\n", "") + rng.choice(["", "", ts.END]) for _ in range(n)} - {""})
    return [(w, rng.randint(0, 3), rng.random() < 0.5 and not w.endswith(ts.END)) for w in words]


def test_sweep_against_brute_force():
    rows = sorted(strings_of(random.Random(1), 150, 7, "ab "))
    frames = [pd.DataFrame(rows[i : i + 9], columns=["s", "n", "probe"]) for i in range(0, len(rows), 9)]
    got = {s: x for f in truncation.sweep(iter(frames)) for s, *x in map(tuple, f.itertuples(index=False))}
    got = {s: tuple(x) for s, x in got.items()}
    assert got == brute(rows)


def test_parts_are_swept_apart():
    rows = [("ab", 0, True), ("abc", 3, False), ("ab", 0, True), ("abd", 5, False), ("ab", 0, True), ("ab", 0, True), ("ab" + ts.END, 2, False)]
    got = [x for f in truncation.sweep(iter([pd.DataFrame(rows, columns=["s", "n", "probe"])])) for x in f.itertuples(index=False, name=None)]
    assert got == [("ab", 0, 3, 3, 0), ("ab", 0, 5, 5, 0), ("ab", 0, 0, 0, 0), ("ab", 2, 0, 0, 0)]


@pytest.mark.parametrize("hot", [10**9, 20])
def test_probes_of_every_length_meet_all_their_continuations(spark, monkeypatch, hot):
    rng = random.Random(5)
    rows = {r[0]: r for r in strings_of(rng, 300, 12) + [("the same beginning"[: rng.randint(3, 18)] + s, n, p) for s, n, p in strings_of(rng, 300, 12, "ab ")]}.values()
    expected = brute(list(rows))
    df = spark.createDataFrame(list(rows), "s string, n bigint, probe boolean")
    assert sum(len(s) < truncation.PREFIX and x[1] > 0 for s, x in expected.items()) > 10
    monkeypatch.setattr(truncation, "HOT", hot)
    got = {r.s: (r.n_end, r.n_on, r.n_in, r.n_mark) for r in truncation.prefix_join(df).collect()}
    assert {s: got.get(s, (0, 0, 0, 0)) for s in expected} == expected and set(got) <= set(expected)


def test_windows_of_closed_sentences_and_open_tails():
    tally = ts.Tally()
    assert tally.add("One two three four. And so") == "and so" and tally.add("Yes.") == "" and tally.add("  ") == ""
    one = {"1one two three four\n", "2one two three ", "2two three four\n", "2three four\n", "2four\n", "1yes\n", "2yes\n", "2and "}
    assert set(tally.strings()) == one


def frame(spark, rows):
    return spark.createDataFrame([(*r, "extra") for r in rows], "tab string, row_id bigint, run string, text string, s string")


def test_cut_values_are_found_and_whole_ones_not(spark):
    rng = random.Random(2)
    whole = corpus(rng)
    rows = [("t", i, "r", w) for i, w in enumerate(whole)]
    rows += [("t", 1000 + i, "r", w.rstrip(".")) for i, w in enumerate(["The answer is lamp.", "I count six of them in the room.", "B", "12 cm", "mirror, lamp"])]
    cut = ["The piano is placed aga", "Looking at the mirror, the view stops in front of the", "The wardrobe is placed against the wall. Looking at the telev", "<think>The lamp", "The lamp is placed against the wall. The mirr&am"]
    rows += [("t", 2000 + i, "r", w) for i, w in enumerate(cut)]
    rows += [rows[-1], ("t", 3000, "r", None), ("t", 3001, "r", ""), ("t", None, "r", "The piano is placed aga"), ("t", 3002, None, "The answer is lamp. " * 30_000)]
    found = truncation.find_truncated(frame(spark, rows)).collect()
    assert sorted(r.row_id for r in found) == [2000, 2001, 2002, 2003, 2004]
    assert {r.row_id: r.evidence for r in found} == {2000: "sentence", 2001: "sentence", 2002: "sentence", 2003: "structure", 2004: "structure"}
    assert truncation.find_truncated(frame(spark, rows).limit(0)).count() == 0


def test_without_the_join_little_is_found(spark, monkeypatch):
    rng = random.Random(4)
    rows = [("t", i, "r", w) for i, w in enumerate(corpus(rng))]
    rows += [("t", 1000 + i, "r", w[: rng.randint(len(w) // 2, len(w) - 4)]) for i, w in enumerate(corpus(rng, 60))]
    df = frame(spark, rows)
    found = truncation.find_truncated(df).count()
    monkeypatch.setattr(truncation, "prefix_join", lambda strings: strings.where("false").selectExpr("s", "n n_end", "n n_on", "n n_in", "n n_mark"))
    assert found > 45 and truncation.find_truncated(df).count() < found / 4


@pytest.mark.parametrize("limit", [24, 40])
def test_field_limits_below_100_show(spark, limit):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcdefg ") for _ in range(rng.randint(8, 90))) for _ in range(80)]
    got = {r.run: r for r in truncation.field_limits(truncation.scanned(frame(spark, [("t", i, "cutter", w[:limit]) for i, w in enumerate(texts)] + [("t", i, "free", w) for i, w in enumerate(texts)] + [("t", i, "few", w) for i, w in enumerate(["no", "maybe"] * 30)]))).collect()}
    assert set(got) == {"cutter"} and got["cutter"].field_limit == limit


def test_field_limit_shows_and_rates_add_up(spark):
    long = "The lamp is placed against the wall. " * 10
    rows = [("t", i, "cutter", f"{NAMES[i % 6]:_<10}, {long}"[:120]) for i in range(8)] + [("t", 50 + i, "fine", long.strip()[: 37 * 4 - 1]) for i in range(3)]
    rows += [("t", 100 + i, "cutter", long[: 37 * 3 - 1]) for i in range(2)]
    got = {r.run_name: r for r in truncation.truncation_rates(frame(spark, rows)).collect()}
    assert got["cutter"].field_limit == 120 and got["cutter"].n_cut == 8 and got["cutter"].n_rows == 10
    assert got["fine"].n_cut == 0 and got["fine"].cut_share == 0.0


