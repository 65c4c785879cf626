"""Queries of the training-data operators over the project's tables, each over whole tables and whole texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import table
from . import encoding, mixing, overlap, packing, pairs, sampling, truncation


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """Values of problem 1: (tab, row_id, run, text)."""
    parts = [("vsi_result", "predicted_answer"), ("spar_result", "predicted_answer"), ("tempcompass_result", "prediction")]
    frames = [table(spark, d, t).select(F.lit(t).alias("tab"), "row_id", F.col("run_name").alias("run"), F.col(c).alias("text")) for t, c in parts]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of problem 2: (tab, row_id, run, question, options, text)."""

    def part(t: str, row_id: str, run: str | None, q: str, opts: bool, text: str) -> DataFrame:
        return table(spark, d, t).select(
            F.lit(t).alias("tab"), F.col(row_id).alias("row_id"), (F.col(run) if run else F.lit(None).cast("string")).alias("run"),
            F.col(q).alias("question"), (F.col("options") if opts else F.lit(None).cast("array<string>")).alias("options"), F.col(text).alias("text"),
        )

    return (
        part("vsi_result", "row_id", "run_name", "question", False, "predicted_answer")
        .unionByName(part("spar_result", "row_id", "run_name", "question", False, "predicted_answer"))
        .unionByName(part("tempcompass_annotation", "question_id", None, "question", True, "solution"))
        .unionByName(part("training_example", "problem_id", None, "problem", True, "solution"))
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.find_truncated(_answers(spark, d)).select("tab", "row_id")


def p1_evidence(spark: SparkSession, d: str) -> DataFrame:
    """How many cut rows of each table were found by which evidence."""
    return truncation.find_truncated(_answers(spark, d)).groupBy("tab", "evidence").agg(F.count("*").alias("n_rows"))


def p1_truncation_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_rates(_answers(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.find_defects(_pairs(spark, d))


def p2_defect_counts(spark: SparkSession, d: str) -> DataFrame:
    return p2_found(spark, d).groupBy("tab", "defect").agg(F.count("*").alias("n_rows"))


#: Tables that a sample plan may name: their record id and the field that cross-classifies their categories.
_PLAN_TABLES = {"vsi_annotation": ("id", "dataset"), "training_example": ("problem_id", "data_source")}


def _plans(spark: SparkSession, d: str) -> list[tuple[str, DataFrame, DataFrame]]:
    """(plan, sample, report) of every row of sample_plan, a fixed small table."""
    targets: dict[str, dict[str, float]] = {}
    for r in table(spark, d, "sample_target").where("category is not null").collect():
        targets.setdefault(r.plan_name, {})[r.category] = r.target_share
    out = []
    for r in table(spark, d, "sample_plan").collect():
        record_id, stratum = _PLAN_TABLES[r.tab]
        records = table(spark, d, r.tab).select(F.col(record_id).alias("record_id"), F.col(r.field).alias("category"), F.col(stratum).alias("stratum"))
        out.append((r.plan_name, *sampling.draw(records, targets.get(r.plan_name, {}), r.sample_pct, r.min_rows)))
    return out


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def p4_sample(spark: SparkSession, d: str) -> DataFrame:
    """The drawn records of every plan."""
    return _union([s.select(F.lit(p).alias("plan_name"), "record_id", "category", "stratum") for p, s, _ in _plans(spark, d)])


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return _union([r.select(F.lit(p).alias("plan_name"), "*") for p, _, r in _plans(spark, d)])


def p4_shortfalls(spark: SparkSession, d: str) -> DataFrame:
    """What the report says of each category before the draw."""
    return p4_report(spark, d).select("plan_name", "category", "target_share", "sample_size", "available", "falls_short")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_report(spark, d).where("falls_short").select("plan_name", "category")


def _param(spark: SparkSession, d: str, name: str) -> int:
    return table(spark, d, "job_param").where(F.col("param_name") == name).agg(F.max("setting")).first()[0]


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), _param(spark, d, "container_tokens"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).where("n_parts > 1").select("doc_id").distinct()


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(_packed(spark, d), _param(spark, d, "container_tokens"))


def p6_placed(spark: SparkSession, d: str) -> DataFrame:
    """Documents placed, containers filled beyond the capacity, documents split though they fit, parts missing or placed twice."""
    packed, capacity = packing.cut(_packed(spark, d)), _param(spark, d, "container_tokens")
    over = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("used")).where(F.col("used") > capacity).agg(F.count("*").alias("n_over"))
    per = packed.groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("part").alias("parts"), F.max("n_parts").alias("n_parts"), F.sum("n_tokens").alias("tokens"))
    return per.agg(
        F.count("*").alias("n_docs"), F.coalesce(F.sum(F.expr(f"IF(n_parts > 1 AND tokens <= {capacity}, 1, 0)")), F.lit(0)).alias("n_split_needlessly"),
        F.coalesce(F.sum(F.expr("IF(n <> n_parts OR parts <> n_parts, 1, 0)")), F.lit(0)).alias("n_incomplete"),
    ).crossJoin(over)  # fmt: skip  # one row each


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_target"), _param(spark, d, "mix_total_pct"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(*_mixed(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_shares(spark, d).where("falls_short").select("source")


def p7_limits(spark: SparkSession, d: str) -> DataFrame:
    """Per targeted source its documents, the cap on copies, documents used beyond it, and documents used that are not the source's."""
    mixed, planned = _mixed(spark, d)
    docs = table(spark, d, "documents").where("doc_id is not null and text <> ''").select("doc_id", F.col("source").alias("own")).dropDuplicates(["doc_id"])
    used = mixed.join(docs, "doc_id", "left").join(planned.select("source", "max_repeats"), "source")
    bad = used.groupBy("source").agg(F.sum(F.expr("IF(copies > max_repeats, 1, 0)")).alias("n_over"), F.sum(F.expr("IF(own <=> source, 0, 1)")).alias("n_foreign"), (F.count("*") - F.countDistinct("doc_id")).alias("n_twice"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return planned.join(bad, "source", "left").select("source", "n_docs", "max_repeats", zero("n_over"), zero("n_foreign"), zero("n_twice"))


def _splits(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    vsi, temp, train = table(spark, d, "vsi_annotation"), table(spark, d, "tempcompass_annotation"), table(spark, d, "training_example")

    def known(df: DataFrame, tab: str, i: str, clip: str, text: str) -> DataFrame:
        return df.select(F.lit(tab).alias("tab"), F.col(i).alias("eval_id"), F.col(clip).alias("clip"), F.col(text).alias("text"))

    evals = known(vsi, "vsi_annotation", "id", "scene_name", "question")
    for text in ("question", "problem"):
        evals = evals.unionByName(known(temp, "tempcompass_annotation", "question_id", "video_id", text))
    return evals, train.select("problem_id", F.col("path").alias("clip"), F.col("problem").alias("text"), "data_source")


def _overlaps(spark: SparkSession, d: str) -> DataFrame:
    return overlap.find_overlaps(*_splits(spark, d))


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping texts with the sizes of their classes of copies, copies not expanded into pairs."""
    return overlap.overlap_classes(*_splits(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _overlaps(spark, d).select("tab", "eval_id", "problem_id")


def p5_overlap_counts(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping pairs, evaluation records and training records per split and data source."""
    return _overlaps(spark, d).groupBy("tab", "data_source").agg(
        F.count("*").alias("n_pairs"), F.countDistinct("eval_id").alias("n_eval"), F.countDistinct("problem_id").alias("n_train")
    )


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.judged(table(spark, d, "documents"))[0].select("doc_id")


def p8_restored(spark: SparkSession, d: str) -> DataFrame:
    """The garbled documents with the chain found and the text as it was, where a chain was found."""
    return encoding.find_garbled(table(spark, d, "documents")).withColumn("gain", F.round("gain", 3))


def p8_validation(spark: SparkSession, d: str) -> DataFrame:
    """The margin, and on how many held-out clean texts and garbled ones made from them it was validated, with which shares found."""
    check = encoding.judged(table(spark, d, "documents"))[2]
    return spark.createDataFrame([tuple(check.values())], "margin double, n_clean bigint, n_garbled bigint, clean_flagged double, recall double")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1:2].isdigit() and callable(v)}


_SPELLED = "nullif(regexp_replace(regexp_replace(lower(trim({})), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), '')"
_RECORDS = (
    f"r AS (SELECT 'vsi_annotation' AS tab, id AS k, min({_SPELLED.format('question_type')}) AS c FROM vsi_annotation WHERE id IS NOT NULL GROUP BY id"
    f" UNION ALL SELECT 'training_example', problem_id, min({_SPELLED.format('data_type')}) FROM training_example WHERE problem_id IS NOT NULL GROUP BY problem_id),"
    " p AS (SELECT s.plan_name, s.tab, s.min_rows, count(*) * any_value(s.sample_pct) // 100 AS n FROM sample_plan s JOIN r USING (tab) GROUP BY ALL),"
    " f AS (SELECT t.plan_name, t.category, t.target_share, p.n, p.min_rows, (SELECT count(*) FROM r WHERE r.tab = p.tab AND r.c = t.category) AS available FROM sample_target t JOIN p USING (plan_name))"
)
_SHORT = "available < target_share * n - 1e-9 OR available < min_rows"


def oracle_sql() -> dict[str, str]:
    """SQL of what needs no tokenizer, model or random draw; the rest is tested against brute force and round trips."""
    return {
        "p6_placed": "SELECT count(DISTINCT doc_id) AS n_docs, 0 AS n_split_needlessly, 0 AS n_incomplete, 0 AS n_over FROM documents WHERE doc_id IS NOT NULL AND text <> ''",
        "p7_limits": "SELECT t.source, count(DISTINCT d.doc_id) AS n_docs, max(t.max_repeats) AS max_repeats, 0 AS n_over, 0 AS n_foreign, 0 AS n_twice FROM mix_target t LEFT JOIN documents d ON d.source = t.source AND d.text <> '' WHERE t.source IS NOT NULL GROUP BY t.source",
        "p4_found": f"WITH {_RECORDS} SELECT plan_name, category FROM f WHERE {_SHORT}",
        "p4_shortfalls": f"WITH {_RECORDS} SELECT plan_name, category, target_share, n AS sample_size, available, ({_SHORT}) AS falls_short FROM f",
    }
