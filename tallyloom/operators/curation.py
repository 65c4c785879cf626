"""Dataset curation: reasoning clean-up, filters, exclusion lists, deterministic sampling, shuffling and sharding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text
from ..session import cut

BROADCAST_ROWS = 100_000


def _small(df: DataFrame) -> DataFrame:
    """Broadcast only what is counted and small; otherwise the join is left to the planner."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def clean_reasoning(raw: DataFrame, response: str = "response") -> DataFrame:
    """problem and solution (`<think>..</think>`, a blank line, `<answer>..</answer>`) of raw responses; null responses give nulls."""
    parts = text.split_reasoning(F.col(response))
    body = F.concat(F.lit("<think>"), parts["thinking"], F.lit("</think>"))
    answer = F.when(parts["answer"].isNotNull(), F.concat(F.lit("\n\n<answer>"), parts["answer"], F.lit("</answer>"))).otherwise("")
    return raw.withColumns({"problem": parts["problem"], "solution": F.concat(body, answer)})


def ingest_annotations(raw: DataFrame, line: str = "line") -> DataFrame:
    """image_path, problem, solution, original_question and original_answer of raw annotations, JSON texts with a response, an image's path, a question and an answer.

    A text that is no JSON, or lacks one of the four, gives nulls throughout.
    """
    data = F.from_json(F.col(line), "gpt4o_response string, image_path string, question string, answer string")
    whole = data["gpt4o_response"].isNotNull() & data["image_path"].isNotNull() & data["question"].isNotNull() & data["answer"].isNotNull()
    got = clean_reasoning(raw.withColumns({"_d": F.when(whole, data)}).withColumn("_r", F.col("_d.gpt4o_response")), "_r")
    return got.withColumns({"image_path": F.col("_d.image_path"), "original_question": F.col("_d.question"), "original_answer": F.col("_d.answer")}).drop("_d", "_r")


def keep_clean(df: DataFrame, problem: str = "problem", solution: str = "solution", height: str | None = None, width: str | None = None, least: int = 28) -> DataFrame:
    """Rows without empty or adjacent tag pairs in the solution, without `Answer:` in the problem, with images large enough; rows of null solutions are dropped."""
    ok = ~text.has_empty_tags(F.col(solution)) & ~F.contains(F.col(problem), F.lit("Answer:"))
    if height and width:
        ok = ok & (F.col(height) >= least) & (F.col(width) >= least)
    return df.where(ok)


def exclude_listed(df: DataFrame, listed: DataFrame, path: str, name: str) -> DataFrame:
    """Rows whose path's base name is not on the list; null paths stay."""
    keyed = df.withColumn("_base", F.substring_index(F.col(path), "/", -1))
    names = listed.where(F.col(name).isNotNull()).select(F.col(name).alias("_base")).distinct()
    return keyed.join(_small(names), "_base", "left_anti").drop("_base")


def with_media(df: DataFrame, media: DataFrame, key: str) -> DataFrame:
    """Rows whose media exist."""
    return df.join(media.select(key).distinct(), key, "left_semi")


def stable_order(key: Column, seed: int) -> Column:
    """A portable pseudo-random order of ids: two rounds of a multiplicative hash on whole numbers below 2^31."""
    h = F.pmod(key.cast("bigint") * 48271 + seed * 16807 + 12345, F.lit(2147483647))
    return F.pmod(h * 69621 + 1013904223, F.lit(2147483647))


def sample_n(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in stable pseudo-random order, the same for every caller."""
    return df.orderBy(stable_order(F.col(key), seed), F.col(key)).limit(n)


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    return df.orderBy(stable_order(F.col(key), seed), F.col(key))


def numbered(df: DataFrame, order: list[str], name: str = "rn") -> DataFrame:
    """Row numbers from 0 over the whole order, without a single-task window: ranges are sorted apart and their counts added up."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = cut(df.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id()))  # both uses read the same ranges
    local = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    counted = parts.groupBy("_p").agg(F.count("*").alias("_n"))
    before = counted.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # one row per range
    return parts.withColumn("_local", local).join(F.broadcast(before), "_p").withColumn(name, F.col("_local") + F.col("_before")).drop("_p", "_local", "_before")


def shard_of(rn: Column, total: Column, shards: int) -> Column:
    """The contiguous shard of a row: the first total mod shards ones hold one more row."""
    q, r = F.floor(total / shards), F.pmod(total, F.lit(shards))
    edge = r * (q + 1)
    return F.when(rn < edge, F.floor(rn / (q + 1))).otherwise(r + F.floor((rn - edge) / F.greatest(q, F.lit(1)))).cast("bigint")


def batch_of(rn: Column, size: int) -> Column:
    return F.floor(rn / size)


def shuffled_frames(frames: Column, seed: int) -> Column:
    """A permutation of a list, the same at every run."""
    keyed = F.transform(frames, lambda f, i: F.struct(stable_order(i, seed).alias("k"), f.alias("f")))
    return F.transform(F.array_sort(keyed), lambda s: s["f"])
