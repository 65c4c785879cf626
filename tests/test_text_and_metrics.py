"""Table-driven tests of extractors and scores, edge rows first."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import metrics, text


def values(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}").orderBy("i").select(expr).collect()]


@pytest.mark.parametrize(
    "make,cases",
    [
        (text.extract_answer_text, {"<answer> B </answer>": "B", "no tag": "None", "<answer>a\nb</answer><answer>c</answer>": "a\nb", "<answer>open": "None", "": "None"}),
        (text.extract_answer, {"x": "", "<answer>4</answer>": "4"}),
        (text.number_word_or_digits, {"5 chairs and a table": "1", "twenty one": "1", "-3": "3", "1,200": "1", "Ninety": "90", "3.5 m": "3.5", "none": "None", "someone": "None"}),
        (text.option_letter, {"B. chair": "B", "b": "b", "B.": "B", "  C ": "C", "The C": "The C", "E": "E"}),
        (text.normalized_or_stripped, {"(c)": "C", "Answer: d": "D", "Ans='B'": "B", "option a": "A", "B is correct": "B", "it is E.": "E", " zzz ": "zzz"}),
        (text.first_letter, {"Based on the video": "B", "The best answer is C": "C", "": "", "one two three four five six seven eight nine ten eleven": "", "The correct option D": "D"}),
        (text.to_float, {"1e3": 1000.0, " 2.5 ": 2.5, "1d": None, "1_0": 10.0, ".5": 0.5, "x": None, "": None}),
        (text.normalized_number, {"1,234.5": 1234.5, "a": None}),
        (text.file_stem, {"a/b/c.tar.gz": "c.tar", "x/.hidden": ".hidden", "plain": "plain"}),
        (text.yes_no, {"Yes, it is": "yes", "nope": "no", "maybe": None}),
        (text.has_empty_tags, {"<a></a>": True, "<a>x</a>": False, "</a></b>": True}),
        (text.first_token, {"B.. x": "B"}),
    ],
)
def test_text(spark, make, cases):
    got = values(spark, [(k,) for k in [*cases, None]], "s string", make(F.col("s")))
    assert got[:-1] == list(cases.values())
    assert got[-1] is None


def test_number_in_takes_last_only_for_multi_view(spark):
    rows = [("2^10",), ("1.5 and 7",), ("none",)]
    assert values(spark, rows, "s string", text.number_in(F.col("s"), True)) == [0.0, 7.0, -1.0]
    assert values(spark, rows, "s string", text.number_in(F.col("s"), False)) == [2.0, 1.5, None]


def test_instructions(spark):
    got = values(spark, [("move_right:1,move_left:2",), ("a:1,a:3",), ("a:1, b:2",), ("a",), ("a:x",)], "s string", text.parse_instruction(F.col("s")))
    assert got == [{"move_right": 1.0, "move_left": 2.0}, {"a": 3.0}, {"a": 1.0, " b": 2.0}, None, None]


def test_matches(spark):
    rows = [("", "B"), ("b", "B"), ("B. x", "B"), ("xb", "B"), (None, "B")]
    assert values(spark, rows, "p string, t string", metrics.contained_match(F.col("p"), F.col("t"))) == [1.0, 1.0, 1.0, 0.0, None]
    rows = [("A", "A. left"), ("A) left", "A. left"), ("B.", "A. left"), ("left", "A. left"), ("A", ""), ("same", "same")]
    assert values(spark, rows, "p string, t string", metrics.choice_match(F.col("p"), F.col("t"))) == [1.0, 1.0, 0.0, 0.0, 0.0, 1.0]


def test_rule_match(spark):
    q, a = "Which?\nSentence A: the lamp\nCaption B: x: y\nno option", "Sentence A: the lamp"
    rows = [("A", q, a), ("A.", q, a), ("Sentence A", q, a), ("the lamp", q, a), ("(A) the lamp", q, a), (a, q, a), ("B", q, a), ("Caption B", q, a), ("C", q, a), ("", q, a), (None, q, a), ("A", "no options", a), ("A", None, a), ("A", q, None), ("A", q, "odd")]
    got = values(spark, rows, "s string, q string, a string", metrics.rule_match(F.col("s"), F.col("q"), F.col("a")))
    assert got == [1.0] * 6 + [0.0, 0.0] + [None] * 5 + [0.0, 0.0]


def test_run_together_lead_ins_stay(spark):
    assert values(spark, [("The best option is: C",)], "s string", text.first_letter(F.col("s"), prefixes=text.FUSED_PREFIXES)) == ["C"]
    assert values(spark, [("Best answer: D",)], "s string", text.first_letter(F.col("s"), prefixes=text.FUSED_PREFIXES)) == ["B"]


def mra(err):
    return sum(err <= 1 - (0.5 + i * ((0.95 - 0.5) / 9)) for i in range(10)) / 10


def test_relative_accuracy_on_random_numbers(spark):
    rng = random.Random(1)
    rows = [(rng.choice([0.0, 1.0, 2.0, 10.0, rng.uniform(0, 20)]), rng.choice([1.0, 2.0, -3.0, 10.0, rng.uniform(0.1, 20)])) for _ in range(300)]
    got = values(spark, rows, "p double, t double", metrics.relative_accuracy(metrics.signed_error(F.col("p"), F.col("t"))))
    assert got == [mra(abs(p - t) / t) for p, t in rows]
    assert values(spark, [("3", "0"), ("x", "2"), ("2", "2"), (None, "2")], "p string, t string", metrics.number_task_score(F.col("p"), F.col("t"))) == [0.0, 0.0, 1.0, 0.0]
    assert values(spark, [(3.0, 0.0), (0.0, 0.0)], "p double, t double", metrics.absolute_error(F.col("p"), F.col("t"))) == [3.0, 0.0]


def test_view_change(spark):
    rows = [("move_right:1", "move_right:1"), ("bad", "move_right:1"), ("move_right:2,move_left:1", "move_right:1"), ("move_right:2", "move_right:1")]
    assert values(spark, rows, "p string, t string", metrics.view_change_score(F.col("p"), F.col("t"))) == [1.0, 0.0, 1.0, pytest.approx((4 + mra(0.5)) / 5)]


def wer(r, h):
    r, h = r.split(), h.split()
    d = list(range(len(h) + 1))
    for i, w in enumerate(r, 1):
        row = [i]
        for j, x in enumerate(h):
            row.append(d[j] if x == w else 1 + min(d[j], d[j + 1], row[-1]))
        d = row
    return d[-1] / max(1, len(r))


def lcs(a, b):
    d = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(d[j] + 1 if x == y else max(d[j + 1], row[-1]))
        d = row
    return d[-1]


def test_word_errors_and_rouge_against_brute_force(spark):
    rng = random.Random(2)
    say = lambda: " ".join(rng.choice("a b c d".split()) for _ in range(rng.randint(0, 7)))
    rows = [(say(), say()) for _ in range(120)] + [("", ""), ("a", ""), ("", "a b")]
    got = values(spark, rows, "r string, h string", metrics.word_error_rate(F.col("r"), F.col("h")))
    assert got == pytest.approx([wer(r, h) for r, h in rows])

    def f1(r, h, common):
        if not common:
            return 0.0
        p, q = common / len(h), common / len(r)
        return 2 * p * q / (p + q)

    def expected(r, h):
        r, h = r.split(), h.split()
        out = [f1(r, h, sum(min(r.count(w), h.count(w)) for w in set(h)))]
        r2, h2 = list(zip(r, r[1:])), list(zip(h, h[1:]))
        out.append(f1(r2, h2, sum(min(r2.count(w), h2.count(w)) for w in set(h2))))
        out.append(f1(r, h, lcs(r, h)))
        return sum(out) / 3

    got = values(spark, rows, "r string, h string", metrics.mean_rouge(F.col("r"), F.col("h"), stemming=False))
    assert got == pytest.approx([expected(r, h) for r, h in rows])


def test_format_and_regression(spark):
    ok = "<think>a\nb</think> \n<answer>1</answer>"
    assert values(spark, [(ok,), (ok + " ",), ("x" + ok,), (None,)], "s string", metrics.format_score(F.col("s"))) == [1.0, 0.0, 0.0, None]
    got = values(spark, [("10", "10"), ("5", "10"), ("x", "1"), ("0", "0"), ("30", "10")], "p string, t string", metrics.regression_score(F.col("p"), F.col("t")))
    assert got == pytest.approx([1.0, 0.5, 0.0, 0.0, 0.0], abs=1e-6)


def test_reasoning_split(spark):
    raw = "Question: how? Answer: <think>one</think>x<think> two </think><think>open<answer>Answer: 7</answer>"
    got = values(spark, [(raw,), ("plain",)], "s string", text.split_reasoning(F.col("s")))
    assert tuple(got[0]) == ("how?", "one two", "7")
    assert tuple(got[1]) == ("plain", "", None)
    got = values(spark, [("q<think>t</think><answer> Answer: 3, not Answer: 4 </answer>",)], "s string", text.split_reasoning(F.col("s")))
    assert got[0].answer == "3, not Answer: 4"


def test_camera_distance_and_time(spark):
    got = values(spark, [("(1000,0), 2", "(0,0), 2"), ("(5,5)", "(5,5)")], "p string, t string", metrics.camera_distance(F.col("p"), F.col("t")))
    assert got == [1.0, 0.0] and math.isclose(got[0], 1.0)
    assert values(spark, [(3661,), (90000,)], "s int", text.format_time(F.col("s"))) == ["01h01m01s", "01h00m00s"]
    assert re.fullmatch("data:image;base64,.*", values(spark, [(b"x",)], "b binary", text.data_url(F.col("b")))[0])


@pytest.mark.parametrize(
    "word,expected",
    [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("rationalize", "ration"), ("goodness", "good"), ("electrical", "electr"), ("adjustment", "adjust"), ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"), ("controll", "control"), ("roll", "roll"), ("is", "is")],
)
def test_stems_of_the_publication(word, expected):
    from tallyloom.functions import stemming

    assert stemming.stem(word) == expected


def test_stemmed_rouge_joins_forms(spark):
    rows = [("he stacked the boxes", "he stacks the box"), ("a", None), ("", "")]
    assert values(spark, rows, "r string, h string", metrics.mean_rouge(F.col("r"), F.col("h"))) == [pytest.approx(1.0), 0.0, 0.0]
