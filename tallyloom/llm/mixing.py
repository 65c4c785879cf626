"""Mixing sources to target weights by pivotal dependent rounding.

Every text of a source has the same expected number of copies, min(cap, target / available). Its fraction is
rounded by pairs: probability mass, measured in tokens, moves at random from one text to the other until one
of them is integral, which keeps the source's expected size exactly and every text's expectation. Pairs are
formed within buckets of a bounded size; each bucket leaves at most one fractional text, and these residuals
are paired again, level by level, until one per source is left.
"""

from __future__ import annotations

import math
import random

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut
from .sizes import TOKENIZER, with_tokens

#: Texts per bucket of the first level, and residuals per group of the next ones.
BUCKET, FAN_IN = 20_000, 1_000
EPS = 1e-9


def pivot(p: list[float], weight: list[float], rng: random.Random) -> tuple[list[float], int | None]:
    """Round probabilities by pairs, keeping sum(p * weight); at most one, at the given position, stays fractional."""
    p = list(p)
    open_at: int | None = None
    for i in range(len(p)):
        if p[i] < EPS or p[i] > 1 - EPS:
            p[i] = float(round(p[i]))
            continue
        if open_at is None:
            open_at = i
            continue
        j, wi, wj = open_at, weight[i], weight[open_at]
        up, down = min((1 - p[i]) * wi, p[j] * wj), min(p[i] * wi, (1 - p[j]) * wj)
        move = up if rng.random() < down / (up + down) else -down
        p[i], p[j] = p[i] + move / wi, p[j] - move / wj
        left = [k for k in (j, i) if EPS < p[k] < 1 - EPS]
        for k in (j, i):
            if k not in left:
                p[k] = float(round(p[k]))
        open_at = left[0] if left else None
    return p, open_at


_SCHEMA = "source string, bucket bigint, doc_id bigint, n_tokens bigint, copies bigint, p double"


def _round_group(seed: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id"], ascending=[False, True]).reset_index(drop=True)  # what stays open at the end is a short text
        rng = random.Random(f"{seed}|{key[0]}|{key[1]}|{len(pdf)}")
        p, at = pivot(pdf["p"].tolist(), pdf["n_tokens"].astype(float).tolist(), rng)
        whole = [int(round(x)) if k != at else 0 for k, x in enumerate(p)]
        pdf["copies"] += whole
        pdf["p"] = [x if k == at else 0.0 for k, x in enumerate(p)]
        return pdf[["source", "bucket", "doc_id", "n_tokens", "copies", "p"]]

    return run


def plan(sized: DataFrame, targets: DataFrame, total_pct: int) -> DataFrame:
    """Per source of `targets` (source, target_share, max_repeats): its tokens, target tokens and expected copies of a text."""
    total = sized.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("all_tokens"))
    have = sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_docs"))
    goals = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    out = goals.join(have, "source", "left").crossJoin(total)  # a single row
    mix = F.col("all_tokens") * F.lit(total_pct / 100.0)
    out = out.select("source", "target_share", F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"), mix.alias("mix_tokens"))
    out = out.withColumn("target_tokens", F.coalesce("target_share", F.lit(0.0)) * F.col("mix_tokens"))
    rate = F.when(F.col("tokens") > 0, F.least(F.col("max_repeats").cast("double"), F.col("target_tokens") / F.col("tokens"))).otherwise(0.0)
    return out.withColumn("rate", rate)


def mix(docs: DataFrame, targets: DataFrame, total_pct: int, seed: int = 11, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, n_tokens, copies) with copies > 0, and the plan.

    documents: (doc_id bigint, source string, text string). Texts of null or untargeted sources count towards
    the total but are not used; null and empty texts and null ids are left out, repeated ids count once;
    further columns are ignored. A source without documents, or too few for its share, is used up to its cap.
    """
    sized = with_tokens(docs, tokenizer, ("source",))
    planned = cut(plan(sized, targets, total_pct))
    rates = planned.where("rate > 0").select("source", "rate", F.ceil(F.col("n_docs") / BUCKET).alias("n_buckets"))
    spread = sized.where("n_tokens > 0").join(rates, "source")
    start = spread.select(
        "source", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("n_buckets")).alias("bucket"), "doc_id", "n_tokens",
        F.floor("rate").alias("copies"), (F.col("rate") - F.floor("rate")).alias("p"),
    )
    current = cut(start.groupBy("source", "bucket").applyInPandas(_round_group(seed), _SCHEMA))
    done = current.where("p = 0")
    buckets = rates.agg(F.max("n_buckets")).first()[0] or 1
    level = 1
    while buckets > 1:
        group = current.where("p > 0").withColumn("bucket", F.floor(F.col("bucket") / FAN_IN))
        current = cut(group.groupBy("source", "bucket").applyInPandas(_round_group(seed + level), _SCHEMA))
        done = done.unionByName(current.where("p = 0"))
        buckets, level = math.ceil(buckets / FAN_IN), level + 1
    last = current.where("p > 0")
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(seed + 1000)), F.lit(1_000_000)) < F.col("p") * 1_000_000
    done = done.unionByName(last.withColumn("copies", F.col("copies") + F.when(drawn, 1).otherwise(0)).withColumn("p", F.lit(0.0)))
    return done.where("copies > 0").select("doc_id", "source", "n_tokens", "copies"), planned


def shares(mixed: DataFrame, planned: DataFrame) -> DataFrame:
    """Per targeted source: tokens asked for and reached, its share of the mix made, and what the mix as a whole lacks.

    falls_short is read from the mix: fewer tokens than asked for were reached although every text is used as often as it may be.
    """
    got = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("reached_tokens"), F.max("copies").alias("most_copies"))
    out = planned.join(got, "source", "left").withColumn("reached_tokens", F.coalesce("reached_tokens", F.lit(0)))
    made = F.sum("reached_tokens").over(Window.partitionBy())  # one row per source
    used_up = F.col("reached_tokens") >= F.col("max_repeats") * F.col("tokens")
    return out.select(
        "source", "target_share", F.round(F.col("reached_tokens") / F.nullif(made, F.lit(0)), 6).alias("reached_share"), F.round("target_tokens", 3).alias("target_tokens"), "reached_tokens", "tokens", "max_repeats",
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"), (used_up & (F.col("reached_tokens") < F.col("target_tokens") - 1e-6)).alias("falls_short"), F.round(F.col("mix_tokens") - made, 3).alias("mix_lacks_tokens"),
    )
