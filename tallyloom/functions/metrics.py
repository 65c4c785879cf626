"""Scores of a row as column expressions; any failure of a row is a null inside and a 0 at the edge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from . import text, wordscores
from .binding import let

#: The ten confidence levels of mean relative accuracy, as binary doubles of 0.5 + i * (0.45 / 9).
LEVELS = [0.5 + i * ((0.95 - 0.5) / 9) for i in range(10)]
ONE, ZERO = 1.0, 0.0


def exact_match(pred: Column, truth: Column) -> Column:
    return (F.lower(pred) == F.lower(truth)).cast("double")


def contained_match(pred: Column, truth: Column) -> Column:
    """Equal, or contained in the truth (so "" scores 1), or the first character equal, without regard to case."""
    p, t = F.lower(pred), F.lower(truth)
    return F.when((p == t) | F.contains(t, p) | (F.substring(p, 1, 1) == t), ONE).when(p.isNotNull() & t.isNotNull(), ZERO)


def strict_match(pred: Column, truth: Column) -> Column:
    return (pred == truth).cast("double")


def choice_match(pred: Column, truth: Column) -> Column:
    """Equal; or a letter A-D alone, before `.` or before `)` equal to the truth's first character. An empty truth scores 0."""
    first = F.substring(truth, 1, 1)
    hit = F.when(pred == truth, ONE)
    for pattern in (r"\A[A-D]\z", r"\A[A-D]\.", r"\A[A-D]\)"):
        hit = hit.when(pred.rlike(pattern), (F.substring(pred, 1, 1) == first).cast("double"))
    return hit.when(pred.isNotNull() & truth.isNotNull(), ZERO)


def rule_match(said: Column, question: Column, answer: Column) -> Column:
    """An answer matched by rule against the `name: text` options below a question: 1 or 0, null where it is none of them.

    It may be an option whole, its text (also behind `) `), or its name, with or without the kind of option before it
    and a dot behind; of several readings the name goes before the text. The truth is an option whole.
    """
    options = F.filter(F.slice(F.split(question, "\n"), 2, 1 << 20), lambda o: F.contains(o, F.lit(": ")))
    part = lambda i: F.transform(options, lambda o: F.get(F.split(o, ": "), F.lit(i)))
    texts, names = part(1), part(0)
    bare = F.transform(names, lambda n: F.regexp_replace(n, "Sentence |Option |Caption ", ""))
    behind = F.get(F.split(said, r"\) "), F.lit(1))
    last = lambda found, *forms: F.try_element_at(F.filter(found, lambda x: F.coalesce(x.isin(*forms), F.lit(False))), F.lit(-1))
    pick = F.coalesce(last(F.concat(names, bare), said, F.replace(said, F.lit("."), F.lit(""))), last(texts, said, behind), last(options, said))
    head, tail = F.get(F.split(answer, ": "), F.lit(0)), F.get(F.split(answer, ": "), F.lit(1))
    right = (pick == answer) | (pick == F.substring_index(answer, ":", 1)) | (pick == tail) | (pick == F.get(F.split(head, r"\s+"), F.lit(1)))
    return F.when(pick.isNotNull(), F.coalesce(right, F.lit(False)).cast("double"))


def signed_error(pred: Column, truth: Column) -> Column:
    """|p - t| / t with the sign of t; null at t = 0."""
    return let(F.struct(pred.alias("p"), truth.alias("t")), lambda s: F.try_divide(F.abs(s["p"] - s["t"]), s["t"]))


def absolute_error(pred: Column, truth: Column) -> Column:
    """|(p - t) / t|, or |p| at t = 0."""
    return let(F.struct(pred.alias("p"), truth.alias("t")), lambda s: F.when(s["t"] == 0, F.abs(s["p"])).otherwise(F.abs(F.try_divide(s["p"] - s["t"], s["t"]))))


def relative_accuracy(error: Column) -> Column:
    """The share of the confidence levels c with error <= 1 - c."""
    return let(error, lambda e: reduce(lambda a, b: a + b, ((e <= F.lit(1 - c)).cast("int") for c in LEVELS)).cast("double") / F.lit(10.0))


def choice_task_score(pred: Column, truth: Column) -> Column:
    """Multiple choice of the spatial benchmark: the option letter after removal of `Answer:`, compared without regard to case."""
    return exact_match(text.option_letter(text.without_answer_mark(pred)), truth)


def number_task_score(pred: Column, truth: Column) -> Column:
    """Numeric answers of the spatial benchmark: relative accuracy of the first number; 0 for no number and for a zero truth."""
    p, t = text.to_float(text.number_word_or_digits(pred)), text.to_float(truth)
    return F.coalesce(relative_accuracy(signed_error(p, t)), F.lit(ZERO))


def spatial_number_score(pred: Column, truth: Column, take_last: Column) -> Column:
    """Numeric answers of the image benchmark: multi-view tasks take the last number (-1 for none), others the first."""
    return F.coalesce(relative_accuracy(absolute_error(text.number_in(pred, take_last), text.to_float(truth))), F.lit(ZERO))


# Signed axes of a change of view, (positive, negative).
AXES = [("move_right", "move_left"), ("move_up", "move_down"), ("move_forward", "move_backward"), ("rotate_right", "rotate_left"), ("rotate_up", "rotate_down")]


def view_change_score(pred: Column, truth: Column) -> Column:
    """Mean over the five axes of the relative accuracy of the truth against the prediction, in this order; 0 if either is malformed."""

    def axis(m: Column, a: str, b: str) -> Column:
        part = lambda k: F.coalesce(F.try_element_at(m, F.lit(k)), F.lit(0.0))
        return part(a) - part(b)

    def mean(s: Column) -> Column:
        each = [relative_accuracy(absolute_error(axis(s["t"], a, b), axis(s["p"], a, b))) for a, b in AXES]
        return F.when(s["p"].isNotNull() & s["t"].isNotNull(), reduce(lambda a, b: a + b, each) / F.lit(5.0))

    both = F.struct(text.parse_instruction(pred).alias("p"), text.parse_instruction(truth).alias("t"))
    return F.coalesce(let(both, mean), F.lit(ZERO))


def camera_distance(pred: Column, truth: Column) -> Column:
    """Euclidean distance of (x / 1000, y / 1000, depth)."""
    p, t = text.coordinate_and_depth(pred), text.coordinate_and_depth(truth)
    return F.sqrt(F.pow((p["x"] - t["x"]) / 1000, 2) + F.pow((p["y"] - t["y"]) / 1000, 2) + F.pow(p["depth"] - t["depth"], 2))


def word_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Levenshtein distance on words over the number of reference words (1 at least)."""
    return wordscores.error_rate(reference, hypothesis)


def clamp01(c: Column) -> Column:
    """Into [0, 1]; null stays null, which least and greatest would pass over."""
    return let(c, lambda x: F.when(x < ZERO, ZERO).when(x > ONE, ONE).otherwise(x))


def regression_score(pred: Column, truth: Column) -> Column:
    """1 less the clamped relative difference, 0 for anything that is no number."""
    both = F.struct(text.normalized_number(pred).alias("p"), text.normalized_number(truth).alias("t"))
    return F.coalesce(let(both, lambda s: 1 - clamp01((F.abs(s["p"] - s["t"]) + F.lit(1e-9)) / (F.abs(s["t"]) + F.lit(1e-9)))), F.lit(ZERO))


def format_score(c: Column) -> Column:
    """1 if the whole text is one think block followed by one answer block."""
    return c.rlike(r"(?s)\A<think>.*?</think>\s*<answer>.*?</answer>\z").cast("double")


def mean_rouge(reference: Column, hypothesis: Column, stemming: bool = True) -> Column:
    """Mean F1 of single words, word pairs and the longest common subsequence; 0 where a text is null."""
    s = wordscores.rouge_scores(reference, hypothesis, stemming)
    return F.coalesce(let(s, lambda x: (x["unigram"] + x["bigram"] + x["longest"]) / F.lit(3.0)), F.lit(ZERO))
