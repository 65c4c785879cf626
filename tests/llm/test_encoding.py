import math
import random
from collections import Counter

import pytest

from tallyloom.llm import encoding

WORDS = "lámpara está detrás señala sillón próximo größer Tür Küche für weiße façade naïve à côté fenêtre déjà São três coração łóżko źle część лампа стоит рядом окном камера 机の上にランプ 椅子は動かされました 24 m² ±90° “keep” – • € £20 ★★☆ 🙂 É Ä Ø".split(" ")


def test_undo_is_the_inverse_of_garbling():
    rng, n = random.Random(5), 0
    for _ in range(400):
        chain, w = rng.choice(encoding.CHAINS), rng.choice(WORDS)
        g = encoding.garble(w, chain)
        if g and "�" not in g and g != w:
            n += 1
            assert encoding.undo(g, chain) == w, (chain, w, g)
    assert n > 80


def test_find_garbled(spark):
    rng = random.Random(6)
    vocab = [w for w in WORDS if w]
    say = lambda: " ".join(rng.choice(vocab if rng.random() < 0.4 else ["the", "lamp", "stands", "here"]) for _ in range(25))
    clean = [(i, say()) for i in range(1200)]
    chains = [("cp1252", "utf_8", 1), ("cp1252", "utf_8", 2), ("cp437", "utf_8", 1), ("cp1251", "utf_8", 1), ("mac_roman", "utf_8", 1)]
    bad = []
    for i in range(60):
        t = say()
        half = t.split(" ")
        g = encoding.garble(" ".join(half[10:]), chains[i % len(chains)])
        bad.append((5000 + i, " ".join(half[:10]) + " " + g, t))
    rows = clean + [(i, g) for i, g, _ in bad] + [(9000, None), (9001, ""), (9002, "plain ASCII & more"), (9003, "a lost � sign"), (5000, bad[0][1]), (9004, "naïve lamp " * 20_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, gain string")
    got = {r.doc_id: r for r in encoding.find_garbled(df).collect()}
    assert set(got) - {i for i, _, _ in bad} == {9003}
    assert len(set(got)) >= 59 and got[9003].lost and got[9003].restored is None
    right = sum(i in got and got[i].restored == t for i, _, t in bad)
    assert right >= 50, right
    assert encoding.find_garbled(df.limit(0)).count() == 0


def test_candidates_are_what_undo_gives():
    for w in [w for w in WORDS if not w.isascii()] + [encoding.garble(w, c) for w in WORDS[:20] for c in encoding.MADE_BY]:
        numbers, at, texts = encoding.candidates(w) if w else ([], [], [])
        expected = {k: was for k, c in enumerate(encoding.CHAINS) if w and (was := encoding.undo(w, c)) not in (None, w) and "�" not in was and was.isprintable()}
        assert {k: texts[i] for k, i in zip(numbers, at)} == expected


def brute_score(model, text):
    """The interpolated log likelihood by hand, one trigram at a time."""

    def place(*codes):
        h = 1469598103
        for c in codes:
            h = (h * 1000003 ^ c) & 0xFFFFFFFFFFFF
        return (h ^ h >> 23) & ((1 << encoding.BITS) - 1)

    codes, total = [2, 3, *(48 if c in "0123456789" else ord(c.lower()) if c.isascii() else ord(c) for c in text), 4], 0.0
    tri, tri_of, bi, bi_of, uni = model.counts
    for a, b, c in zip(codes, codes[1:], codes[2:]):
        if max(a, b, c) > 127:
            p = encoding.WEIGHTS[0] * tri[place(1, a, b, c)] / max(1, tri_of[place(2, a, b)]) + encoding.WEIGHTS[1] * bi[place(3, b, c)] / max(1, bi_of[place(4, b)])
            total += math.log(min(1, p + encoding.WEIGHTS[2] * uni[place(5, c)] / model.total + encoding.WEIGHTS[3] / 1000))
    return total


def test_scores_against_brute_force(spark):
    distinct = spark.createDataFrame([(w, i + 1) for i, w in enumerate(WORDS) if not w.isascii()] + [("Öl", 0)], "piece string, n bigint")
    model = encoding.train(distinct)
    texts = [*WORDS, "Größe 12é", "", "ab"]
    assert model.scores(texts) == pytest.approx([brute_score(model, t) for t in texts]) and len(model.scores([])) == 0
    for w, gains in zip(WORDS, model.gains(WORDS)):
        own = brute_score(model, w)
        every = {k: brute_score(model, was) - own for k, c in enumerate(encoding.CHAINS) if (was := encoding.undo(w, c)) not in (None, w) and "�" not in was and was.isprintable()}
        assert gains == pytest.approx({k: g for k, g in every.items() if g > 0})


def test_the_margin_is_validated_on_clean_and_garbled_texts(spark):
    posted = spark.createDataFrame([(i, k, False, "x", 1) for k in (encoding.OUT, encoding.MADE) for i in range(100)] + [(500, encoding.SIGNED, False, "x", 1)], "doc_id bigint, kind int, lost boolean, piece string, n bigint")
    gain = lambda k, i: 1.7 if k == encoding.OUT and i < 5 else 3.2 if k == encoding.MADE and i < 1 else 9.0 if k == encoding.MADE else 0.1
    sums = spark.createDataFrame([(i, k, gain(k, i), 0) for k in (encoding.OUT, encoding.MADE) for i in range(100)] + [(500, encoding.SIGNED, 50.0, 0)], "doc_id bigint, kind int, gain double, k int")
    assert encoding.validated(posted, sums) == {"margin": 2.5, "n_clean": 100, "n_garbled": 100, "clean_flagged": 0.0, "recall": 1.0}
    assert encoding.validated(posted.limit(0), sums.limit(0))["n_clean"] == 0


def test_made_texts_are_garbled_in_whole_or_in_part():
    found, kinds = Counter({w: 2 for w in ("größer", "Küche", "weiße", "schön", "für")}), Counter()
    for seed in range(300):
        got = encoding.made(found, seed)
        if got:
            assert not any(encoding._LOST.search(p) for p in got)
            kinds["part" if any(p in got for p in found) else "whole"] += 1
    assert min(kinds["part"], kinds["whole"]) > 40 and encoding.made(Counter({"ok": 1}), 1) is None


def test_long_texts_are_judged_whole(spark):
    rng = random.Random(9)
    vocab = [w for w in WORDS if w]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(30))) for i in range(400)] + [(1000, "the lamp " * 30_000 + encoding.garble("größer für weiße Küche", ("cp1252", "utf_8", 1)))]
    assert 1000 in {r.doc_id for r in encoding.judged(spark.createDataFrame(rows, "doc_id bigint, text string"))[0].collect()}


def test_repeated_rows_count_once(spark):
    rng = random.Random(12)
    vocab = [w for w in WORDS if w]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(30))) for i in range(300)] + [(1000, encoding.garble("größer für weiße Küche", ("cp1252", "utf_8", 1)))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    once = {r.doc_id: round(r.gain, 6) for r in encoding.judged(df)[0].collect()}
    last = df.where("doc_id = 1000")
    again = {r.doc_id: round(r.gain, 6) for r in encoding.judged(df.unionByName(last).unionByName(last))[0].collect()}
    assert 1000 in once and once == again
