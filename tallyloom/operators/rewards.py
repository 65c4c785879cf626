"""Rewards of a completion against its solution, by problem type, with the optional object-map bonus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import metrics, objectmap, text

ZERO = 0.0


def base_reward(problem_type: Column, completion: Column, solution: Column) -> Column:
    """By type: multiple choice (equal after stripping), numerical (relative accuracy), OCR (1 - word errors), free-form (mean of three n-gram F1s), regression; any failure and any other type 0."""
    said, truth = text.extract_answer(completion), text.extract_answer(solution)
    number = metrics.relative_accuracy(metrics.signed_error(text.to_float(text.number_word_or_digits(said)), text.to_float(truth)))
    out = (
        F.when(problem_type == "multiple choice", (text.strip(said) == text.strip(truth)).cast("double"))
        .when(problem_type == "numerical", number)
        .when(problem_type == "OCR", metrics.clamp01(1 - metrics.word_error_rate(F.when(problem_type == "OCR", truth), F.when(problem_type == "OCR", said))))
        .when(problem_type == "free-form", metrics.clamp01(metrics.mean_rouge(F.when(problem_type == "free-form", truth), F.when(problem_type == "free-form", said))))
        .when(problem_type == "regression", metrics.regression_score(said, truth))
    )
    return F.coalesce(out, F.lit(ZERO))


def format_reward(completion: Column) -> Column:
    return F.coalesce(metrics.format_score(completion), F.lit(ZERO))


def with_map_bonus(reward: Column, problem_type: Column, completion: Column, score: Column) -> Column:
    """A right choice, or a number above one half, gains the map's score if the text holds a map; a map worth nothing takes the reward away."""
    eligible = F.when(problem_type == "multiple choice", reward == 1.0).when(problem_type == "numerical", reward > 0.5).otherwise(F.lit(False))
    has_map = F.contains(completion, F.lit("<map>")) & F.contains(completion, F.lit("</map>"))
    return F.when(eligible & has_map, F.when(F.coalesce(score, F.lit(ZERO)) > 0, reward + score).otherwise(ZERO)).otherwise(reward)


def map_guided(rows: DataFrame, maps: DataFrame, n: int = 10, order: str | None = None) -> DataFrame:
    """`reward` with the map bonus. rows: problem_type, completion, solution, path; maps: video_id, cognitive_map, object_list.

    A map-bearing text whose video has no map scores 0. Of several maps of a video the last in `order` counts, any without one.
    """
    one = F.max_by(F.struct("cognitive_map", "object_list"), F.col(order)) if order else F.any_value(F.struct("cognitive_map", "object_list"))
    maps = maps.where("video_id is not null").groupBy("video_id").agg(one.alias("m")).select("video_id", "m.*")
    keyed = rows.withColumn("video_id", text.file_stem(F.col("path"))).join(maps, "video_id", "left")
    keyed = keyed.withColumn("_said", objectmap.parse(text.extract_map_text(F.col("completion")), F.col("object_list")))
    score = objectmap.map_score(F.col("_said"), F.col("cognitive_map"), n)
    return keyed.withColumn("reward", with_map_bonus(base_reward(F.col("problem_type"), F.col("completion"), F.col("solution")), F.col("problem_type"), F.col("completion"), score)).drop("cognitive_map", "object_list", "video_id", "_said")


def debug_entry(at: Column, reward: Column, completion: Column, solution: Column) -> Column:
    """The lines of a log entry about one reward."""
    head = F.concat(F.lit("------------- "), F.date_format(at, "dd-HH-mm-ss-SSSSSS"), F.lit(" Accuracy reward: "), reward.cast("string"), F.lit(" -------------\n"))
    return F.concat(head, F.lit("Content: "), completion, F.lit("\nSolution: "), solution, F.lit("\n"))


#: Reward functions by name: (problem_type, completion, solution) -> column.
REGISTRY: dict[str, Callable[[Column, Column, Column], Column]] = {
    "accuracy": base_reward,
    "format": lambda problem_type, completion, solution: format_reward(completion),
}


def total_reward(names: list[str], problem_type: Column, completion: Column, solution: Column) -> Column:
    """The sum of registered rewards; an unknown name raises KeyError."""
    out = F.lit(ZERO)
    for name in names:
        out = out + REGISTRY[name](problem_type, completion, solution)
    return out
