"""Grouped accuracy reports as long tables (scope, name, n, value), each from one pass over scored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import metrics

# Task families of the benchmarks.
VSI_CHOICE = ["object_rel_direction_easy", "object_rel_direction_medium", "object_rel_direction_hard", "object_rel_distance", "route_planning", "obj_appearance_order"]
VSI_NUMBER = ["object_abs_distance", "object_counting", "object_size_estimation", "room_size_estimation"]
VSI_DIRECTIONS = ["object_rel_direction_easy", "object_rel_direction_medium", "object_rel_direction_hard"]
SPAR_CHOICE = ["obj_spatial_relation_oo", "obj_spatial_relation_oc_mv", "obj_spatial_relation_oo_mv", "spatial_imagination_oc", "spatial_imagination_oo", "spatial_imagination_oc_mv", "spatial_imagination_oo_mv", "position_matching", "camera_motion_infer", "distance_infer_center_oo", "distance_infer_center_oo_mv"]
SPAR_NUMBER = ["depth_prediction_oc", "depth_prediction_oo", "distance_prediction_oc", "distance_prediction_oo", "depth_prediction_oc_mv", "depth_prediction_oo_mv", "distance_prediction_oo_mv", "distance_prediction_oc_mv"]
SPAR_VIEW = ["view_change_infer"]
SPAR_LOW = SPAR_NUMBER
SPAR_MIDDLE = ["view_change_infer", "position_matching", "camera_motion_infer"]
SPAR_HIGH = ["obj_spatial_relation_oo", "obj_spatial_relation_oc_mv", "obj_spatial_relation_oo_mv", "spatial_imagination_oc", "spatial_imagination_oo", "spatial_imagination_oc_mv", "spatial_imagination_oo_mv", "distance_infer_center_oo", "distance_infer_center_oo_mv"]
STI_SPATIAL = ["Dimensional Measurement", "Displacement & Path Length", "Ego-Centric Orientation", "Spatial Relation", "Speed & Acceleration", "Trajectory Description"]
LONG_PERCEPTION = ["S2E", "S2O", "S2A", "E2O", "O2E", "T2E", "T2O", "T2A"]
LONG_RELATION = ["E3E", "O3O", "SSS", "SOS", "SAA", "T3E", "T3O", "TOS", "TAA"]


def family(task: Column, choice: list[str], number: list[str], special: list[str] = ()) -> Column:
    """`choice`, `number` or `special`; an unknown task raises when its row is evaluated."""
    out = F.when(task.isin(choice), "choice").when(task.isin(number), "number")
    if special:
        out = out.when(task.isin(list(special)), "special")
    return out.when(task.isNotNull(), F.raise_error(F.concat(F.lit("unknown task: "), task)))


def _known(score: Column, task: Column, strict: bool) -> Column:
    return score.otherwise(F.when(task.isNotNull(), F.raise_error(F.concat(F.lit("unknown task: "), task)))) if strict else score


def vsi_score(task: Column, pred: Column, truth: Column, strict: bool = True) -> Column:
    """The score of a row by its task; an unknown task raises, or is null if not strict."""
    return _known(F.when(task.isin(VSI_CHOICE), metrics.choice_task_score(pred, truth)).when(task.isin(VSI_NUMBER), metrics.number_task_score(pred, truth)), task, strict)


def spar_score(task: Column, pred: Column, truth: Column, strict: bool = True) -> Column:
    multi = task.endswith("_mv")
    return _known(
        F.when(task.isin(SPAR_CHOICE), metrics.contained_match(pred, truth))
        .when(task.isin(SPAR_NUMBER), metrics.spatial_number_score(pred, truth, multi))
        .when(task.isin(SPAR_VIEW), metrics.view_change_score(pred, truth)),
        task, strict,
    )


def task_means(scored: DataFrame, task: str, score: str) -> DataFrame:
    """(name, n, value) per task; null tasks are left out, null scores are skipped."""
    return scored.where(F.col(task).isNotNull()).groupBy(F.col(task).alias("name")).agg(F.count(score).alias("n"), F.avg(score).alias("value"))


def _long(df: DataFrame, scope: str) -> DataFrame:
    return df.select(F.lit(scope).alias("scope"), "name", "n", "value")


def _listed(means: DataFrame) -> DataFrame:
    """All means in one row, so that what is made of them needs no second scan; as many entries as there are tasks."""
    return means.agg(F.collect_list(F.struct("name", "n", "value")).alias("m"))


def _sum(entries: Column, field: str) -> Column:
    return F.aggregate(F.filter(entries, lambda e: e[field].isNotNull()), F.lit(0).cast("double"), lambda a, e: a + e[field])


def _mean(entries: Column) -> Column:
    return F.try_divide(_sum(entries, "value"), F.size(F.filter(entries, lambda e: e["value"].isNotNull())))


def _entry(name: str, n: Column, value: Column) -> Column:
    return F.struct(F.lit(name).alias("name"), n.cast("bigint").alias("n"), value.cast("double").alias("value"))


def _with_overall(entries: DataFrame) -> DataFrame:
    """Rows of the entries e and of their macro mean."""
    e = F.col("e")
    scoped = F.concat(F.transform(e, lambda x: F.struct(F.lit("task").alias("scope"), x.alias("x"))), F.array(F.struct(F.lit("overall").alias("scope"), _entry("overall", _sum(e, "n"), _mean(e)).alias("x"))))
    return entries.select(F.explode(scoped).alias("r")).select("r.scope", "r.x.*")


def vsi_report(scored: DataFrame, task: str = "task", score: str = "score") -> DataFrame:
    """Tasks, with the direction tasks rolled up to their mean (0 if any is missing; those before the first missing one are dropped), and the macro mean."""
    m = F.col("m")
    easy, medium, hard = (F.array_contains(F.transform(m, lambda e: e["name"]), t) for t in VSI_DIRECTIONS)
    of_directions = F.filter(m, lambda e: e["name"].isin(VSI_DIRECTIONS))
    rolled = _entry("object_rel_direction", _sum(of_directions, "n"), F.when(easy & medium & hard, _sum(of_directions, "value") / 3).otherwise(0.0))
    n_gone = F.when(~easy, 0).when(~medium, 1).when(~hard, 2).otherwise(3)
    gone = F.slice(F.array(*map(F.lit, VSI_DIRECTIONS)), F.lit(1), n_gone)
    kept = F.filter(m, lambda e: ~F.array_contains(gone, e["name"]))
    return _with_overall(_listed(task_means(scored, task, score)).select(F.concat(kept, F.array(rolled)).alias("e")))


def sti_report(scored: DataFrame, task: str = "task", score: str = "score", sub_tasks: list[str] = STI_SPATIAL) -> DataFrame:
    """Tasks, the mean over the listed sub-tasks as one more task (0 without any), and the macro mean over all of them."""
    m = F.col("m")
    mine = F.filter(m, lambda e: e["name"].isin(sub_tasks))
    sub = _entry("sr_sub", _sum(mine, "n"), F.coalesce(_mean(mine), F.lit(0.0)))
    return _with_overall(_listed(task_means(scored, task, score)).select(F.concat(m, F.array(sub)).alias("e")))


def spar_report(scored: DataFrame, task: str = "task", image_type: str = "image_type", score: str = "score") -> DataFrame:
    """Per task, per image type and task, their macro means and tiers, overall and per image type, from one grouping-sets pass.

    Tiers are unweighted means of their tasks' means; the view-change task counts in none, as the name that it is
    reported under is not the one on the tier's list. Columns: scope (task, overall, tier), image_type (null: all), name, value.
    """
    rows = scored.where(F.col(task).isNotNull()).select(F.col(task).alias("name"), F.col(image_type).alias("it"), F.col(score).alias("v"))
    both = rows.groupingSets([["name"], ["name", "it"]], "name", "it").agg(F.grouping("it").alias("every"), F.avg("v").alias("value"))
    tasks = both.where("every = 1 or it is not null").select("name", F.when(F.col("every") == 0, F.col("it")).alias("image_type"), "value")
    tier = F.when(F.col("name").isin(SPAR_VIEW), None).when(F.col("name").isin(SPAR_LOW), "Low").when(F.col("name").isin(SPAR_MIDDLE), "Middle").when(F.col("name").isin(SPAR_HIGH), "High")
    rolled = tasks.groupBy("image_type").agg(
        F.avg("value").alias("overall"), *(F.avg(F.when(tier == t, F.col("value"))).alias(t) for t in ("Low", "Middle", "High"))
    )
    wide = rolled.select("image_type", F.explode(F.array(*(F.struct(F.lit(s).alias("scope"), F.lit(n).alias("name"), F.col(n).alias("value")) for s, n in (("overall", "overall"), ("tier", "Low"), ("tier", "Middle"), ("tier", "High"))))).alias("e")).select("e.scope", "image_type", "e.name", "e.value")
    return tasks.select(F.lit("task").alias("scope"), "image_type", "name", "value").unionByName(wide)


def cube_report(scored: DataFrame, a: str, b: str, score: str) -> DataFrame:
    """Micro means per (a, b), per a, per b and over all, nulls as keys left out at their level: one exchange for four levels."""
    rows = scored.select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(score).alias("v"))
    out = rows.cube("a", "b").agg(F.grouping("a").alias("ga"), F.grouping("b").alias("gb"), F.count("v").alias("n"), F.avg("v").alias("value"))
    named = out.where("(ga = 1 or a is not null) and (gb = 1 or b is not null)")
    level = F.when((F.col("ga") == 0) & (F.col("gb") == 0), f"{a}_{b}").when(F.col("ga") == 0, a).when(F.col("gb") == 0, b).otherwise("overall")
    return named.select(level.alias("scope"), F.col("a").alias(a), F.col("b").alias(b), "n", "value")


def long_video_report(scored: DataFrame, category: str = "category", score: str = "score", perception: list[str] = LONG_PERCEPTION, relation: list[str] = LONG_RELATION) -> DataFrame:
    """Per category, micro overall, and micro means of two families of categories (null for an empty family)."""
    c, v = F.col(category), F.col(score)
    per = scored.where(c.isNotNull()).groupBy(c.alias("name")).agg(F.count(v).alias("n"), F.avg(v).alias("value"))
    one = scored.agg(
        F.struct(F.lit("overall").alias("name"), F.count(v).alias("n"), F.avg(v).alias("value")).alias("o"),
        *(F.struct(F.lit(k).alias("name"), F.count(F.when(c.isin(f), v)).alias("n"), F.avg(F.when(c.isin(f), v)).alias("value")).alias(k) for k, f in (("perception", perception), ("relation", relation))),
    )
    tops = one.select(F.explode(F.array("o", "perception", "relation")).alias("e")).select("e.*")
    return _long(per, "category").unionByName(_long(tops, "overall"))


def micro_report(scored: DataFrame, score: str = "score") -> DataFrame:
    return scored.agg(F.lit("overall").alias("name"), F.count(score).alias("n"), F.avg(score).alias("value"))


def metrics_json(report: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    """A report as one JSON object of names and values, names in order."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(name).alias("key"), F.col(value).alias("value"))))
    return report.where(F.col(name).isNotNull()).agg(F.to_json(F.map_from_entries(entries)).alias("metrics"))


def interval_means(log: DataFrame, step: str, metric: str, value: str, every: int, prefix: str = "") -> DataFrame:
    """Mean of each buffered metric per log interval of `every` steps."""
    return log.groupBy(F.floor(F.col(step) / every).alias("interval"), F.concat(F.lit(prefix), F.col(metric)).alias("metric")).agg(F.count(value).alias("n"), F.avg(value).alias("value"))
