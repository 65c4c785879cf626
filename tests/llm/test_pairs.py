import random
import re

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import pairs

Q = "How many lamps are there in this room?"


@pytest.mark.parametrize(
    "text,defect",
    [
        (None, "empty"), ("", "empty"), ("​", "empty"), ("\xa0\n", "empty"), ("<think></think><answer></answer>", "empty"), ("[no response]", "empty"), ("N/A", "empty"),
        ("I cannot determine the answer from the video provided.", "refusal"), ("Das kann ich leider nicht beantworten.", "refusal"), ("无法回答这个问题。", "refusal"), ("<think>dark</think>I cannot answer this", "refusal"),
        (" \n" * 400, "empty"), ("<think>" + "​ " * 300 + "</think><answer> </answer>", "empty"), ((Q + " ") * 40, "copy"), (Q, "copy"), ("Question: how many lamps are there in this room", "copy"), (f"{Q} {Q}", "copy"), (f"{Q}\nOptions:\nA. 1\nB. 2", "copy"),
        ("Die richtige Antwort ist B.", "language"), ("房间里一共有2个。", "language"), ("Je compte 2 objets dans cette pièce", "language"),
        (f"{Q} There are 4.", None), ("I can't see every corner, but B is the only option that fits.", None), ("The label says “Öppna dörren”, hence C.", None), ("4", None), ("b", None), ("Unable to find a better match than C.", None),
    ],
)
def test_labels(text, defect):
    got = pairs.label({"tab": ["t"], "row_id": [1], "question": [Q], "options": [None], "text": [text]})
    assert (got[0][5] if got else None) == defect


@pytest.mark.parametrize("n", [1, 60])
def test_emptiness_does_not_depend_on_length(n):
    why = "the lamp " * n
    for text in (f"<think>{why}</think><answer></answer>", f"<think>{why}</think><answer>N/A</answer>", f"{'  ' * 10 * n}N/A"):
        assert pairs.is_empty(text)
    for text in (f"<think>{why}</think><answer>B</answer>", f"<think>{why}</think>", f"<think>{why}</think><answer>", why):
        assert not pairs.is_empty(text)


def test_german_question_takes_german_answers():
    assert not pairs.is_foreign("Wie viele Lampen sind in diesem Raum zu sehen?", "Es sind 4 zu sehen.")
    assert pairs.is_foreign("Wie viele Lampen sind in diesem Raum zu sehen?", "There are four of them in the room.")


def test_copies_cost_less_than_other_text():
    assert pairs.copied_share(Q, Q) < 0.3 < pairs.COPY_SHARE < pairs.copied_share(Q, "Something wholly different, about tables and doors")


def test_without_compression_there_are_no_copies(monkeypatch):
    assert pairs.is_copy(Q, None, Q)
    monkeypatch.setattr(pairs, "copied_share", lambda p, r: 1.0)
    assert not pairs.is_copy(Q, None, Q)


@pytest.mark.parametrize(
    "text,copy",
    [("How many lamps are ther in this rom?", True), ("how many lamps are there in this rooms", True), ("You asked: How many lamp are there in this room", True), ("How many lamps are there in this room? 4", False), ("How many lamps are there in that hall?", False), ("There are lamps in this room", False), ("How many lamps are there in this room, please?", False)],
)
def test_copies_with_slips(text, copy):
    assert pairs.is_copy(Q, None, text) is copy


@pytest.mark.parametrize("q,text", [("Left?", "left"), ("a?", "A?"), ("怎么走？", "怎么走？")])
def test_short_copies(q, text):
    assert pairs.is_copy(q, None, text) == (pairs.copied_share(pairs._plain(q), pairs._plain(text)) <= pairs.COPY_SHARE)


def test_copies_with_long_options_that_the_table_does_not_hold():
    lines = ["A. the wardrobe behind the glass door", "B. a kettle next to the oven", "C. my bicycle under those windows", "D. two pianos facing north"]
    assert pairs.is_copy(Q, None, "\n".join([Q, "Options:", *lines]))
    assert not pairs.is_copy(Q, None, "\n".join([Q, "Options:", *lines, "Four, I think."]))


@pytest.mark.parametrize("words", [2800, 9000])
def test_the_window_is_as_long_as_the_prompt(words):
    rng = random.Random(8)
    q = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(words))
    assert len(q) > 19_000 and pairs.copied_share(q, q) < 0.02
    assert pairs.is_copy(q, None, f"Question: {q}") and not pairs.is_copy(q, None, f"{q} four")


@pytest.mark.parametrize("lang", pairs.REFUSALS)
def test_every_refusal_phrase_has_an_anchor_and_holds_it(lang):
    phrases = pairs.alternatives(pairs.REFUSALS[lang])
    assert "|".join(phrases) == pairs.REFUSALS[lang]
    for phrase in phrases:
        parsed = list(re._parser.parse(phrase))
        assert pairs.required(parsed)
        for text in list(pairs.spelled(parsed) or ())[:50]:
            assert re.search(phrase, text) and pairs.is_refusal(text)


@pytest.mark.parametrize("text,yes", [("无法回答。", True), ("抱歉。", True), ("죄송합니다", True), ("できません", True), ("Sorry.", False), ("B", False)])
def test_short_refusals(text, yes):
    assert pairs.is_refusal(text) is yes
    assert [r[5] for r in pairs.label({"tab": ["t"], "row_id": [1], "question": [Q], "options": [None], "text": [text]})] == (["refusal"] if yes else [])


@pytest.mark.parametrize("text", ["Bunu cevaplayamam.", "Bu soruyu yanıtlayamam.", "È impossibile rispondere."])
def test_refusals_in_few_words(text):
    assert pairs.is_refusal(text)


def test_pairs_have_one_defect_each(spark):
    rows = [("t", 1, None, Q, ["A. 1", None], "I cannot answer this <think>"), ("t", 2, None, Q, None, None), ("t", 3, None, None, None, "4"), ("t", 3, None, None, None, "4"), ("t", None, None, Q, None, None), ("t", 4, "r", Q, None, "<think>The lamp"), ("t", 5, "r", None, None, "word " * 50_000 + "ends here."), ("u", 1, "r", Q, None, "Die richtige Antwort ist B, weil das <think>")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "tab string, row_id bigint, run string, question string, options array<string>, text string, w string")
    got = {(r.tab, r.row_id): r.defect for r in pairs.find_defects(df).collect()}
    assert got == {("t", 1): "refusal", ("t", 2): "empty", ("t", 4): "truncated", ("u", 1): "truncated"}
    assert pairs.find_defects(df.limit(0)).count() == 0
    assert pairs.find_defects(df.withColumn("row_id", F.lit(None).cast("bigint"))).count() == 0
