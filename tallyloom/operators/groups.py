"""Group-relative statistics of generations: bonuses, means, deviations, advantages, token-level KL and loss.

A generation table has one row per (group_id, gen_idx). Group statistics are windows over group_id, which share
one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.binding import let


def _w(group: str = "group_id") -> Window:
    return Window.partitionBy(group)


def repeat_generations(prompts: DataFrame, n: int) -> DataFrame:
    """Each prompt's row once per generation, gen_idx 0 to n - 1."""
    return prompts.withColumn("gen_idx", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def temporal_bonus(rows: DataFrame, shuffled: DataFrame, share: float = 0.8, bonus: float = 0.3, least: float = 0.1) -> DataFrame:
    """acc_t and temporal: +bonus to rows above `least` in groups whose mean is at least `share` of the mean on shuffled frames.

    temporal is 1.0 or 0.0 by that test, 0.5 where a group has no shuffled rows or is no video.
    """
    means = shuffled.groupBy("group_id").agg(F.avg("acc").alias("shuffled_mean"))
    joined = rows.join(means, "group_id", "left").withColumn("own_mean", F.avg("acc").over(_w()))
    applies = F.col("shuffled_mean").isNotNull() & F.coalesce("is_video", F.lit(False))
    better = F.col("own_mean") >= share * F.col("shuffled_mean")
    acc = F.col("acc") + F.when(applies & better & (F.col("acc") > least), bonus).otherwise(0.0)
    state = F.when(~applies, 0.5).when(better, 1.0).otherwise(0.0)
    return joined.withColumns({"acc_t": acc, "temporal": state}).drop("shuffled_mean", "own_mean")


def length_bonus(rows: DataFrame, acc: str = "acc", length: str = "length", low: int = 320, high: int = 512, bonus: float = 0.2, least: float = 0.1) -> DataFrame:
    """len_bonus: +bonus to rows above `least` with a length in [low, high], where more than one row of the group is above `least`."""
    many = F.count_if(F.col(acc) > least).over(_w()) > 1
    return rows.withColumn("len_bonus", F.when(many & (F.col(acc) > least) & F.col(length).between(low, high), bonus).otherwise(0.0))


def advantages(rows: DataFrame, reward: str = "reward", eps: float = 1e-4) -> DataFrame:
    """group_mean, group_std (of the sample) and advantage; a group of one has a null deviation and advantage."""
    mean, std = F.avg(reward).over(_w()), F.stddev_samp(reward).over(_w())
    out = rows.withColumns({"group_mean": mean, "group_std": std})
    return out.withColumn("advantage", (F.col(reward) - F.col("group_mean")) / (F.col("group_std") + eps))


def saturation(rows: DataFrame, reward: str = "reward", wrong: float = 1.0, right: float = 2.0) -> DataFrame:
    """The shares of groups whose rewards are all at most `wrong`, and all at least `right`."""
    per = rows.groupBy("group_id").agg(F.bool_and(F.col(reward) <= wrong).alias("w"), F.bool_and(F.col(reward) >= right).alias("r"))
    return per.agg(F.avg(F.col("w").cast("double")).alias("all_wrong"), F.avg(F.col("r").cast("double")).alias("all_correct"))


def completion_length(ids: Column, eos: int) -> Column:
    """Tokens up to and including the first end mark, all of them without one."""
    at = F.array_position(ids, F.lit(eos))
    return F.when(at == 0, F.size(ids)).otherwise(at).cast("bigint")


def completion_mask(ids: Column, eos: int) -> Column:
    return let(completion_length(ids, eos), lambda n: F.transform(ids, lambda x, i: F.when(i < n, 1).otherwise(0)))


def token_kl(logp: Column, ref: Column, limit: float = 10.0) -> Column:
    """exp(x) - x - 1 per token, x the clamped difference of the reference's and the policy's log-probability."""
    clamped = F.zip_with(logp, ref, lambda p, r: F.greatest(F.lit(-limit), F.least(F.lit(limit), r - p)))
    return F.transform(clamped, lambda x: F.exp(x) - x - 1)


def masked_mean(values: Column, mask: Column) -> Column:
    zipped = F.arrays_zip(values.alias("v"), mask.alias("m"))
    total = F.aggregate(zipped, F.lit(0.0), lambda a, z: a + z["v"] * z["m"])
    return F.try_divide(total, F.aggregate(mask, F.lit(0), lambda a, m: a + m.cast("int")))


def sequence_loss(kl: Column, mask: Column, advantage: Column, beta: float) -> Column:
    """Masked mean of -(advantage - beta * kl): the probability ratio's value is one."""
    return masked_mean(F.transform(kl, lambda k: -(advantage - beta * k)), mask)


def masked_labels(ids: Column, ignored: list[int], mark: int = -100) -> Column:
    """Labels with padding and visual tokens marked as ignored."""
    return F.transform(ids, lambda x: F.when(x.isin(ignored), mark).otherwise(x))


def keep_last_tokens(ids: Column, n: int) -> Column:
    return F.slice(ids, F.greatest(F.size(ids) - n + 1, F.lit(1)), n)


def process_slice(rows: DataFrame, process: int, per_process: int, order: str = "rn") -> DataFrame:
    """The rows of one process, by position."""
    return rows.where(F.col(order).between(process * per_process, (process + 1) * per_process - 1))


def regrouped(rows: DataFrame, owners: DataFrame, per_item: int, order: str = "rn") -> DataFrame:
    """Gathered rows given back to their processes: each item of `owners` (item, process) owns per_item rows, in order; `local` is the position among the process's own."""
    owned = rows.withColumn("item", F.floor(F.col(order) / per_item)).join(owners, "item")
    return owned.withColumn("local", F.row_number().over(Window.partitionBy("process").orderBy(order)) - 1)
