"""Queries over the reference's operators, each with the SQL that must give the same rows.

SQL is put together from fragments that restate an operator for another engine.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import frames, metrics, objectmap, text, wordscores
from ..operators import curation, groups, predict, prompts, reports, rewards
from ..session import table
from ..sources import tables
from ..streaming import scoring

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# SQL fragments ------------------------------------------------------------------------------------------------


def q_strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def q_tag(x: str, tag: str, default: str) -> str:
    p = f"(?s)<{tag}>(.*?)</{tag}>"
    return f"CASE WHEN regexp_matches({x}, '{p}') THEN {q_strip(f'''regexp_extract({x}, '{p}', 1)''')} WHEN {x} IS NOT NULL THEN '{default}' END"


def q_guarded(x: str) -> str:
    return f"CASE WHEN contains({x}, '<answer>') THEN {q_tag(x, 'answer', 'None')} ELSE {x} END"


def q_number_word(x: str) -> str:
    low = q_strip(f"lower({x})")
    cases = " ".join(rf"WHEN regexp_matches({low}, '\b{w}\b') THEN '{d}'" for w, d in text.NUMBER_WORDS)
    return rf"CASE {cases} WHEN regexp_matches({low}, '\d+(?:\.\d+)?') THEN regexp_extract({low}, '(\d+(?:\.\d+)?)', 1) WHEN {x} IS NOT NULL THEN 'None' END"


def q_option(x: str) -> str:
    first = q_strip(f"split_part({x}, ' ', 1)")
    return rf"CASE WHEN regexp_matches({first}, '\A[A-D]\.?\z') THEN left({first}, 1) ELSE {q_strip(x)} END"


def q_float(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '{text._FLOAT}') THEN try_cast(replace({q_strip(x)}, '_', '') AS DOUBLE) END"


def q_letter(x: str, letters: str = "ABCD", prefixes: list[str] | None = None) -> str:
    s = q_strip(x)
    for p in prefixes or (text.ANSWER_PREFIXES if letters == "ABCD" else text.ANSWER_PREFIXES[:10]):
        s = f"replace({s}, '{p}', '')"
    return f"regexp_extract({s}, '([{letters}])', 1)"


def q_normalized(x: str) -> str:
    parts = ", ".join(f"nullif(upper(regexp_extract({x}, '(?im){p.replace(chr(39), chr(39) * 2)}', 1)), '')" for p in text.OPTION_PATTERNS)
    return f"coalesce({parts}, {q_strip(x)})"


def q_mra(error: str) -> str:
    return "(" + " + ".join(f"CAST(({error}) <= CAST({1 - c!r} AS DOUBLE) AS INT)" for c in metrics.LEVELS) + ") / 10.0::DOUBLE"


def q_in(values: list[str]) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def q_category(x: str) -> str:
    return f"nullif(regexp_replace(regexp_replace(lower(trim({x})), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), '')"


_ONCE = "QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY logged_at) = 1"


def _once(df: DataFrame) -> DataFrame:
    return df.drop("logged_at").dropDuplicates(["row_id"])


def _task(c: str):
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.col(c))), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(s != "", s)


# Benchmark reports ----------------------------------------------------------------------------------------------


def _vsi(spark: SparkSession, d: str) -> DataFrame:
    return _once(table(spark, d, "vsi_result").select("row_id", "scene_name", "ground_truth", "predicted_answer", "question_type", "video_duration", "run_name", "logged_at")).withColumn("task", _task("question_type"))


_VSI_SQL = f"vsi AS (SELECT row_id, scene_name, ground_truth, predicted_answer, {q_category('question_type')} AS task, video_duration, run_name FROM vsi_result {_ONCE})"
_SPAR_SQL = f"spar AS (SELECT row_id, ground_truth, predicted_answer, {q_category('task')} AS task, image_type FROM spar_result {_ONCE})"
_CHOICE, _NUMBER = q_in(reports.VSI_CHOICE), q_in(reports.VSI_NUMBER)
_DURATION = "CASE WHEN video_duration < 60 THEN 'short' WHEN video_duration < 120 THEN 'medium' WHEN video_duration IS NOT NULL THEN 'long' END"


@query(f"""
WITH {_VSI_SQL}, scored AS (
  SELECT task, {_DURATION} AS duration, CAST({q_letter(q_guarded('predicted_answer'))} = ground_truth AS INT)::DOUBLE AS score FROM vsi WHERE task IN {_CHOICE}),
cubed AS (SELECT duration, task, grouping(duration) AS ga, grouping(task) AS gb, count(score) AS n, avg(score) AS value FROM scored GROUP BY CUBE (duration, task))
SELECT CASE WHEN ga = 0 AND gb = 0 THEN 'duration_task' WHEN ga = 0 THEN 'duration' WHEN gb = 0 THEN 'task' ELSE 'overall' END AS scope, duration, task, n, round(value, 6) AS value
FROM cubed WHERE (ga = 1 OR duration IS NOT NULL) AND (gb = 1 OR task IS NOT NULL)""")
def report_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    """Per (duration, task), per duration, per task and overall: letters against truths."""
    rows = _vsi(spark, d).where(F.col("task").isin(reports.VSI_CHOICE))
    bucket = F.when(F.col("video_duration") < 60, "short").when(F.col("video_duration") < 120, "medium").when(F.col("video_duration").isNotNull(), "long")
    said = text.first_letter(text.guarded_answer(F.col("predicted_answer"), True))
    scored = rows.select("task", bucket.alias("duration"), metrics.strict_match(said, F.col("ground_truth")).alias("score"))
    return reports.cube_report(scored, "duration", "task", "score").withColumn("value", F.round("value", 6))


_VSI_SCORE = f"""CASE WHEN task IN {_CHOICE} THEN CAST(lower({q_option(f"replace({q_guarded('predicted_answer')}, 'Answer:', '')")}) = lower(ground_truth) AS INT)::DOUBLE
 WHEN task IN {_NUMBER} THEN coalesce({q_mra(f"abs(({q_float(q_number_word(q_guarded('predicted_answer')))}) - t) / nullif(t, 0)")}, 0.0::DOUBLE) END"""


@query(f"""
WITH {_VSI_SQL}, scored AS (SELECT task, {_VSI_SCORE} AS score FROM (SELECT *, {q_float('ground_truth')} AS t FROM vsi)),
means AS (SELECT task AS name, count(score) AS n, avg(score) AS value FROM scored WHERE task IS NOT NULL GROUP BY task),
rolled AS (SELECT 'object_rel_direction' AS name, coalesce(sum(n), 0)::BIGINT AS n, CASE WHEN count(*) = 3 THEN avg(value) ELSE 0 END AS value FROM means WHERE name IN {q_in(reports.VSI_DIRECTIONS)}),
entries AS (SELECT * FROM means WHERE name NOT IN {q_in(reports.VSI_DIRECTIONS)} UNION ALL SELECT * FROM rolled)
SELECT 'task' AS scope, name, n, round(value, 6) AS value FROM entries
UNION ALL SELECT 'overall', 'overall', sum(n)::BIGINT, round(avg(value), 6) FROM entries""")
def report_vsi(spark: SparkSession, d: str) -> DataFrame:
    rows = _vsi(spark, d).where(F.col("task").isNotNull())
    said = text.guarded_answer(F.col("predicted_answer"), True)
    scored = rows.select("task", reports.vsi_score(F.col("task"), said, F.col("ground_truth"), strict=False).alias("score"))
    return reports.vsi_report(scored).withColumn("value", F.round("value", 6))


@query(f"""
WITH {_VSI_SQL} SELECT row_id, task, CASE WHEN task IN {_CHOICE} THEN 'choice' ELSE 'number' END AS family,
 CASE WHEN task IN {_CHOICE} THEN {q_option(f"replace({q_guarded('predicted_answer')}, 'Answer:', '')")} ELSE {q_number_word(q_guarded('predicted_answer'))} END AS extracted,
 round({_VSI_SCORE}, 6) AS score FROM (SELECT *, {q_float('ground_truth')} AS t FROM vsi WHERE task IS NOT NULL)""")
def vsi_row_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every row's family, extracted answer and score."""
    rows = _vsi(spark, d).where(F.col("task").isNotNull())
    said = text.guarded_answer(F.col("predicted_answer"), True)
    fam = reports.family(F.col("task"), reports.VSI_CHOICE, reports.VSI_NUMBER)
    got = F.when(fam == "choice", text.option_letter(text.without_answer_mark(said))).otherwise(text.number_word_or_digits(said))
    return rows.select("row_id", "task", fam.alias("family"), got.alias("extracted"), F.round(reports.vsi_score(F.col("task"), said, F.col("ground_truth"), strict=False), 6).alias("score"))


_PRED = q_guarded("predicted_answer")
_SPAR_SCORE = f"""CASE WHEN task IN {q_in(reports.SPAR_CHOICE)} THEN CASE WHEN lower(p) = lower(ground_truth) OR contains(lower(ground_truth), lower(p)) OR left(lower(p), 1) = lower(ground_truth) THEN 1.0 WHEN p IS NOT NULL AND ground_truth IS NOT NULL THEN 0.0 END
 WHEN task IN {q_in(reports.SPAR_NUMBER)} THEN coalesce({q_mra("CASE WHEN t = 0 THEN abs(v - t) ELSE abs((v - t) / t) END")}, 0.0) END::DOUBLE"""
_SPAR_SCORED = rf"""scored AS (SELECT row_id, task, image_type, v, {_SPAR_SCORE} AS score FROM (
  SELECT *, try_cast(CASE WHEN ends_with(task, '_mv') THEN coalesce(list_extract(found, -1), CASE WHEN p IS NOT NULL THEN '-1' END) ELSE list_extract(found, 1) END AS DOUBLE) AS v, {q_float('ground_truth')} AS t
  FROM (SELECT *, regexp_extract_all(p, '\d+\.\d+|\d+') AS found FROM (SELECT *, {_PRED} AS p FROM spar)) WHERE task IS NOT NULL))"""


def _spar(spark: SparkSession, d: str) -> DataFrame:
    rows = _once(table(spark, d, "spar_result").select("row_id", "ground_truth", "predicted_answer", "task", "image_type", "logged_at")).withColumn("task", _task("task"))
    said = text.guarded_answer(F.col("predicted_answer"), True)
    return rows.where(F.col("task").isNotNull()).select("row_id", "task", "image_type", text.number_in(said, F.col("task").endswith("_mv")).alias("v"), reports.spar_score(F.col("task"), said, F.col("ground_truth"), strict=False).alias("score"))


@query(f"""
WITH {_SPAR_SQL}, {_SPAR_SCORED},
tasks AS (SELECT task AS name, image_type, value FROM (SELECT task, image_type, grouping(image_type) AS every, avg(score) AS value FROM scored GROUP BY GROUPING SETS ((task), (task, image_type))) WHERE every = 1 OR image_type IS NOT NULL),
tiers AS (SELECT *, CASE WHEN name = 'view_change_infer' THEN NULL WHEN name IN {q_in(reports.SPAR_LOW)} THEN 'Low' WHEN name IN {q_in(reports.SPAR_MIDDLE)} THEN 'Middle' WHEN name IN {q_in(reports.SPAR_HIGH)} THEN 'High' END AS tier FROM tasks),
groups AS (SELECT DISTINCT image_type FROM tasks)
SELECT 'task' AS scope, image_type, name, round(value, 6) AS value FROM tasks
UNION ALL SELECT 'overall', image_type, 'overall', round(avg(value), 6) FROM tasks GROUP BY image_type
UNION ALL SELECT 'tier', g.image_type, t.tier, round((SELECT avg(value) FROM tiers x WHERE x.tier = t.tier AND x.image_type IS NOT DISTINCT FROM g.image_type), 6) FROM groups g, (VALUES ('Low'), ('Middle'), ('High')) t(tier)""")
def report_spar(spark: SparkSession, d: str) -> DataFrame:
    return reports.spar_report(_spar(spark, d)).withColumn("value", F.round("value", 6))


@query(f"WITH {_SPAR_SQL}, {_SPAR_SCORED} SELECT row_id, task, v AS number_found, round(score, 6) AS score FROM scored")
def spar_row_scores(spark: SparkSession, d: str) -> DataFrame:
    return _spar(spark, d).select("row_id", "task", F.col("v").alias("number_found"), F.round("score", 6).alias("score"))


@query(f"""
WITH {_VSI_SQL}, scored AS (SELECT task, CAST({q_normalized(q_guarded('predicted_answer'))} = ground_truth AS INT)::DOUBLE AS score FROM vsi WHERE task IN {_CHOICE}),
means AS (SELECT task AS name, count(score) AS n, avg(score) AS value FROM scored GROUP BY task),
entries AS (SELECT * FROM means UNION ALL SELECT 'sr_sub', coalesce(sum(n), 0)::BIGINT, coalesce(avg(value), 0) FROM means WHERE name IN {q_in(reports.VSI_DIRECTIONS)})
SELECT 'task' AS scope, name, n, round(value, 6) AS value FROM entries UNION ALL SELECT 'overall', 'overall', sum(n)::BIGINT, round(avg(value), 6) FROM entries""")
def report_sub_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Tasks, a sub-task mean that counts as one more task, and their macro mean."""
    rows = _vsi(spark, d).where(F.col("task").isin(reports.VSI_CHOICE))
    said = text.normalized_or_stripped(text.guarded_answer(F.col("predicted_answer"), True))
    scored = rows.select("task", metrics.strict_match(said, F.col("ground_truth")).alias("score"))
    return reports.sti_report(scored, sub_tasks=reports.VSI_DIRECTIONS).withColumn("value", F.round("value", 6))


_PERCEPTION, _RELATION = ["obj_appearance_order", "route_planning"], ["object_rel_distance", "object_rel_direction_easy"]


@query(f"""
WITH {_VSI_SQL}, scored AS (SELECT task AS category, CAST({q_letter(q_guarded('predicted_answer'), 'ABCDE')} = ground_truth AS INT)::DOUBLE AS score FROM vsi WHERE task IN {_CHOICE})
SELECT 'category' AS scope, category AS name, count(score) AS n, round(avg(score), 6) AS value FROM scored GROUP BY category
UNION ALL SELECT 'overall', 'overall', count(score), round(avg(score), 6) FROM scored
UNION ALL SELECT 'overall', 'perception', count(score), round(avg(score), 6) FROM scored WHERE category IN {q_in(_PERCEPTION)}
UNION ALL SELECT 'overall', 'relation', count(score), round(avg(score), 6) FROM scored WHERE category IN {q_in(_RELATION)}""")
def report_families(spark: SparkSession, d: str) -> DataFrame:
    rows = _vsi(spark, d).where(F.col("task").isin(reports.VSI_CHOICE))
    said = text.first_letter(text.guarded_answer(F.col("predicted_answer"), True), "ABCDE")
    scored = rows.select(F.col("task").alias("category"), metrics.strict_match(said, F.col("ground_truth")).alias("score"))
    return reports.long_video_report(scored, perception=_PERCEPTION, relation=_RELATION).withColumn("value", F.round("value", 6))


_TEMP_SQL = f"temp AS (SELECT row_id, run_name, {q_tag('answer', 'answer', 'None')} AS a, {q_guarded('prediction')} AS p FROM tempcompass_result {_ONCE})"
_CHOICE_MATCH = r"""CASE WHEN p = a THEN 1.0 WHEN regexp_matches(p, '\A[A-D]\z') OR regexp_matches(p, '\A[A-D]\.') OR regexp_matches(p, '\A[A-D]\)') THEN CAST(left(p, 1) = left(a, 1) AS INT) WHEN p IS NOT NULL AND a IS NOT NULL THEN 0.0 END::DOUBLE"""


def _temp(spark: SparkSession, d: str) -> DataFrame:
    rows = _once(table(spark, d, "tempcompass_result").select("row_id", "run_name", "answer", "prediction", "logged_at"))
    return rows.select("row_id", "run_name", text.extract_answer_text(F.col("answer")).alias("a"), text.guarded_answer(F.col("prediction"), True).alias("p"))


@query(f"WITH {_TEMP_SQL} SELECT 'overall' AS name, count(score) AS n, round(avg(score), 6) AS value FROM (SELECT {_CHOICE_MATCH} AS score FROM temp)")
def report_choice_micro(spark: SparkSession, d: str) -> DataFrame:
    scored = _temp(spark, d).select(metrics.choice_match(F.col("p"), F.col("a")).alias("score"))
    return reports.micro_report(scored).withColumn("value", F.round("value", 6))


@query(f"""WITH {_TEMP_SQL}, m AS (SELECT run_name AS name, round(avg({_CHOICE_MATCH}), 4) AS value FROM temp WHERE run_name IS NOT NULL GROUP BY run_name)
SELECT '{{' || string_agg('"' || name || '":' || value::VARCHAR, ',' ORDER BY name) || '}}' AS metrics FROM m""")
def metrics_as_json(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy per run as one JSON object."""
    scored = _temp(spark, d).select("run_name", metrics.choice_match(F.col("p"), F.col("a")).alias("score"))
    means = reports.task_means(scored, "run_name", "score").withColumn("value", F.round("value", 4))
    return reports.metrics_json(means)


@query(f"""WITH {_TEMP_SQL} SELECT row_id, p AS prediction, a AS answer, {_CHOICE_MATCH} AS score, CASE WHEN starts_with(lower({q_strip('p')}), 'yes') THEN 'yes' WHEN starts_with(lower({q_strip('p')}), 'no') THEN 'no' END AS yes_no,
 regexp_replace(split_part(p, ' ', 1), '\\.+$', '') AS first_token, {q_letter('p', 'ABCD', text.FUSED_PREFIXES)} AS fused_letter FROM temp""")
def choice_row_scores(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p")
    return _temp(spark, d).select("row_id", p.alias("prediction"), F.col("a").alias("answer"), metrics.choice_match(p, F.col("a")).alias("score"), text.yes_no(p).alias("yes_no"), text.first_token(p).alias("first_token"), text.first_letter(p, prefixes=text.FUSED_PREFIXES).alias("fused_letter"))


@query(r"""WITH p AS (SELECT p_partkey, p_brand AS a, p_type AS b, CASE p_partkey % 8 WHEN 0 THEN 'Option A: ' || p_brand WHEN 1 THEN p_brand WHEN 2 THEN 'Option B' WHEN 3 THEN 'A.' WHEN 4 THEN 'B' WHEN 5 THEN '(A) ' || p_brand WHEN 6 THEN 'Option A.' ELSE 'none of them' END AS said FROM part)
SELECT p_partkey, CASE p_partkey % 8 WHEN 7 THEN NULL WHEN 2 THEN 0.0 WHEN 4 THEN 0.0 ELSE 1.0 END::DOUBLE AS score FROM p""")
def rule_scores(spark: SparkSession, d: str) -> DataFrame:
    """Answers matched by rule against the options below a question."""
    k, brand = F.col("p_partkey") % 8, F.col("p_brand")
    first = F.concat(F.lit("Option A: "), brand)
    said = F.when(k == 0, first).when(k == 1, brand).when(k == 2, "Option B").when(k == 3, "A.").when(k == 4, "B").when(k == 5, F.concat(F.lit("(A) "), brand)).when(k == 6, "Option A.").otherwise("none of them")
    question = F.concat(F.lit("Which?\n"), first, F.lit("\nOption B: "), "p_type")
    return table(spark, d, "part").select("p_partkey", metrics.rule_match(said, question, first).alias("score"))


# Scores over derived inputs ----------------------------------------------------------------------------------------

_E = "floor(value)::BIGINT"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "user_id", "event_type", F.floor("value").alias("v"))


def _vci_sql(a: str, b: str) -> str:
    def axis(x: str, p: str, q: str) -> str:
        part = lambda k: rf"coalesce(try_cast(nullif(regexp_extract({x}, '(?:^|,){k}:(-?[0-9.]+)', 1), '') AS DOUBLE), 0)"
        return f"({part(p)} - {part(q)})"

    err = lambda t, p: f"CASE WHEN {p} = 0 THEN abs({t} - {p}) ELSE abs(({t} - {p}) / {p}) END"
    return "(" + " + ".join(q_mra(err(axis(b, p, q), axis(a, p, q))) for p, q in metrics.AXES) + ") / 5"


@query(f"""WITH e AS (SELECT event_id, 'move_right:' || (user_id % 7) || ',move_up:' || (user_id % 5) || ',rotate_left:' || (event_id % 4) AS p, 'move_left:' || (event_id % 3) || ',move_up:' || (user_id % 6) || ',rotate_left:' || (user_id % 4) AS t FROM events)
SELECT event_id, round({_vci_sql('p', 't')}, 6) AS score FROM e""")
def view_change(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    mod = lambda c, n: (F.col(c) % n).cast("string")
    p = F.concat(F.lit("move_right:"), mod("user_id", 7), F.lit(",move_up:"), mod("user_id", 5), F.lit(",rotate_left:"), mod("event_id", 4))
    t = F.concat(F.lit("move_left:"), mod("event_id", 3), F.lit(",move_up:"), mod("user_id", 6), F.lit(",rotate_left:"), mod("user_id", 4))
    return e.select("event_id", F.round(metrics.view_change_score(p, t), 6).alias("score"))


@query("""SELECT event_id, round(sqrt(((user_id % 50 - event_id % 40) / 1000.0::DOUBLE) ** 2 + ((user_id % 30 - event_id % 20) / 1000.0::DOUBLE) ** 2 + (user_id % 9 - event_id % 8) ** 2), 6) AS distance FROM events""")
def camera_distances(spark: SparkSession, d: str) -> DataFrame:
    make = lambda c, a, b, z: F.concat(F.lit("("), (F.col(c) % a).cast("string"), F.lit(","), (F.col(c) % b).cast("string"), F.lit("),"), (F.col(c) % z).cast("string"))
    return _events(spark, d).select("event_id", F.round(metrics.camera_distance(make("user_id", 50, 30, 9), make("event_id", 40, 20, 8)), 6).alias("distance"))




@query(r"""
WITH t AS (SELECT question_id, any_value(question) AS question, any_value(problem) AS problem FROM tempcompass_annotation WHERE question IS NOT NULL AND problem IS NOT NULL GROUP BY question_id),
w AS (SELECT question_id, list_filter(regexp_split_to_array(question, '\s+'), lambda x: x <> '') AS r, list_filter(regexp_split_to_array(problem, '\s+'), lambda x: x <> '') AS h FROM t),
f AS (SELECT question_id, r, h, list_reduce(list_concat([struct_pack(k := 0, d := list_transform(range(len(h) + 1), lambda i: i::INT))], list_transform(range(1, len(r) + 1), lambda i: struct_pack(k := i::INT, d := []::INT[]))),
  lambda a, b: struct_pack(k := b.k, d := list_reduce(list_concat([[ (a.d[1] + 1)::INT ]], list_transform(range(1, len(h) + 1), lambda j: [j::INT])), lambda acc, j: list_append(acc, (CASE WHEN h[j[1]] = r[b.k] THEN a.d[j[1]] ELSE 1 + least(a.d[j[1]], a.d[j[1] + 1], acc[-1]) END)::INT)))) AS last FROM w)
SELECT question_id, round(last.d[-1]::DOUBLE / greatest(1, len(r)), 6) AS wer FROM f""")
def word_errors(spark: SparkSession, d: str) -> DataFrame:
    """Word error rate of each problem against its question."""
    t = table(spark, d, "tempcompass_annotation").where("question is not null and problem is not null").groupBy("question_id").agg(F.max("question").alias("question"), F.max("problem").alias("problem"))
    return t.select("question_id", F.round(metrics.word_error_rate(F.col("question"), F.col("problem")), 6).alias("wer"))


def _q_gram(n: int) -> str:
    g = lambda w: w if n == 1 else f"list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1])"
    return f"SELECT question_id, {g('r')} AS r, {g('h')} AS h FROM w"


def _q_f1(n: int) -> str:
    both = "list_sum(list_transform(list_distinct(h), lambda g: least(len(list_filter(h, lambda x: x = g)), len(list_filter(r, lambda x: x = g)))))"
    return f"(SELECT question_id, coalesce(2 * (b / nullif(len(h), 0)) * (b / nullif(len(r), 0)) / nullif(b / nullif(len(h), 0) + b / nullif(len(r), 0), 0), 0) AS f FROM (SELECT *, coalesce({both}, 0)::DOUBLE AS b FROM ({_q_gram(n)})))"


@query(rf"""
WITH t AS (SELECT question_id, any_value(question) AS question, any_value(problem) AS problem FROM tempcompass_annotation WHERE question IS NOT NULL AND problem IS NOT NULL GROUP BY question_id),
w AS (SELECT question_id, list_filter(regexp_split_to_array(lower(question), '[^a-z0-9]+'), lambda x: x <> '') AS r, list_filter(regexp_split_to_array(lower(problem), '[^a-z0-9]+'), lambda x: x <> '') AS h FROM t)
SELECT a.question_id, round(a.f, 6) AS unigram, round(b.f, 6) AS bigram FROM {_q_f1(1)} a JOIN {_q_f1(2)} b USING (question_id)""")
def ngram_scores(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "tempcompass_annotation").where("question is not null and problem is not null").groupBy("question_id").agg(F.max("question").alias("question"), F.max("problem").alias("problem"))
    scores = t.select("question_id", wordscores.rouge_scores(F.col("question"), F.col("problem"), stemming=False).alias("s"))
    return scores.select("question_id", F.round("s.unigram", 6).alias("unigram"), F.round("s.bigram", 6).alias("bigram"))


@query(rf"""
WITH t AS (SELECT question_id, any_value(question) AS question, any_value(problem) AS problem FROM tempcompass_annotation WHERE question IS NOT NULL AND problem IS NOT NULL GROUP BY question_id),
w AS (SELECT question_id, list_filter(regexp_split_to_array(lower(question), '[^a-z0-9]+'), lambda x: x <> '') AS r, list_filter(regexp_split_to_array(lower(problem), '[^a-z0-9]+'), lambda x: x <> '') AS h FROM t),
l AS (SELECT question_id, len(r) AS nr, len(h) AS nh, list_reduce(list_concat([struct_pack(k := 0, d := list_transform(range(len(h) + 1), lambda i: 0))], list_transform(range(1, len(r) + 1), lambda i: struct_pack(k := i::INT, d := []::INT[]))),
  lambda a, b: struct_pack(k := b.k, d := list_reduce(list_concat([[0]], list_transform(range(1, len(h) + 1), lambda j: [j::INT])), lambda acc, j: list_append(acc, (CASE WHEN h[j[1]] = r[b.k] THEN a.d[j[1]] + 1 ELSE greatest(a.d[j[1] + 1], acc[-1]) END)::INT)))).d[-1] AS common FROM w)
SELECT l.question_id, round((a.f + b.f + coalesce(2.0::DOUBLE * common / nullif(nr + nh, 0), 0)) / 3, 6) AS rouge FROM l JOIN {_q_f1(1)} a USING (question_id) JOIN {_q_f1(2)} b USING (question_id)""")
def rouge_scores(spark: SparkSession, d: str) -> DataFrame:
    """Mean F1 of words, pairs and longest common subsequence, of words as they stand; training_rewards has the stemmed one."""
    t = table(spark, d, "tempcompass_annotation").where("question is not null and problem is not null").groupBy("question_id").agg(F.max("question").alias("question"), F.max("problem").alias("problem"))
    return t.select("question_id", F.round(metrics.mean_rouge(F.col("question"), F.col("problem"), stemming=False), 6).alias("rouge"))


@query(f"""WITH {_VSI_SQL}, n AS (SELECT row_id, {q_float("replace(ground_truth, ',', '')")} AS t, {q_float("replace(" + q_guarded('predicted_answer') + ", ',', '')")} AS p FROM vsi)
SELECT row_id, round(CASE WHEN p IS NULL OR t IS NULL THEN 0 ELSE 1 - least(1.0::DOUBLE, (abs(p - t) + 1e-9) / (abs(t) + 1e-9)) END, 6) AS score FROM n""")
def regression_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = _vsi(spark, d)
    return rows.select("row_id", F.round(metrics.regression_score(text.guarded_answer(F.col("predicted_answer"), True), F.col("ground_truth")), 6).alias("score"))


@query(r"""WITH v AS (SELECT row_id, predicted_answer FROM vsi_result QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY logged_at) = 1)
SELECT row_id, CAST(regexp_matches(predicted_answer, '(?s)\A<think>.*?</think>\s*<answer>.*?</answer>\z') AS INT)::DOUBLE AS score FROM v""")
def format_scores(spark: SparkSession, d: str) -> DataFrame:
    return _vsi(spark, d).select("row_id", metrics.format_score(F.col("predicted_answer")).alias("score"))


# Object maps ------------------------------------------------------------------------------------------------------


@query("""
WITH p AS (SELECT vec_id, label, [[(vec_id * 7 % 10)::INT, (vec_id * 3 % 10)::INT], [(vec_id * 5 % 10)::INT, (vec_id % 10)::INT]] AS r, [[(vec_id * 2 % 10)::INT, (vec_id * 9 % 10)::INT], [(vec_id * 6 % 10)::INT, (vec_id * 4 % 10)::INT], [(vec_id % 7)::INT, (vec_id % 9)::INT]] AS s FROM embeddings),
c AS (SELECT vec_id, list_sort(flatten(list_transform(range(1, len(r) + 1), lambda i: list_transform(range(1, len(s) + 1), lambda j: struct_pack(d := sqrt((r[i][1] - s[j][1])::DOUBLE ** 2 + (r[i][2] - s[j][2])::DOUBLE ** 2), i := i::INT, j := j::INT))))) AS pairs FROM p),
f AS (SELECT vec_id, list_reduce(list_concat([struct_pack(d := 0.0::DOUBLE, i := 0, j := 0, total := 0.0::DOUBLE, ri := []::INT[], sj := []::INT[])], list_transform(pairs, lambda x: struct_pack(d := x.d, i := x.i, j := x.j, total := 0.0::DOUBLE, ri := []::INT[], sj := []::INT[]))),
  lambda a, x: CASE WHEN list_contains(a.ri, x.i) OR list_contains(a.sj, x.j) THEN a ELSE struct_pack(d := x.d, i := x.i, j := x.j, total := a.total + greatest(0.0::DOUBLE, 1 - x.d / (10 * sqrt(2.0::DOUBLE))), ri := list_append(a.ri, x.i), sj := list_append(a.sj, x.j)) END) AS z FROM c)
SELECT vec_id, round(z.total / 3, 6) AS score FROM f""")
def map_matching(spark: SparkSession, d: str) -> DataFrame:
    """Greedy matching of two points against three on a grid of ten."""
    v = F.col("vec_id")
    at = lambda a, b: F.array((v * a % 10).cast("int"), (v * b % 10).cast("int"))
    r = F.create_map(F.lit("thing"), F.array(at(7, 3), at(5, 1)))
    s = F.create_map(F.lit("thing"), F.array(at(2, 9), at(6, 4), F.array((v % 7).cast("int"), (v % 9).cast("int"))))
    return table(spark, d, "embeddings").select("vec_id", F.round(objectmap.map_score(r, s), 6).alias("score"))


_OBJECTS = ["aquarium", "bathtub", "bench", "bicycle", "chair", "coffee table", "cushion", "desk", "lamp", "mirror", "piano", "rug", "sofa", "stove", "table", "wardrobe"]


@query(rf"""WITH v AS (SELECT row_id, {q_tag('predicted_answer', 'map', '')} AS m FROM (SELECT row_id, predicted_answer FROM vsi_result {_ONCE}) WHERE contains(predicted_answer, '</map>')),
k AS (SELECT row_id, m, list_filter(json_keys(m), lambda k: k IN {q_in(_OBJECTS)} AND json_array_length(json_extract(m, '$."' || k || '"')) > 0) AS keys FROM v)
SELECT row_id, array_to_string(list_sort(keys), ',') AS objects, coalesce(list_sum(list_transform(keys, lambda k: json_array_length(json_extract(m, '$."' || k || '"')))), 0)::INT AS n_points FROM k""")
def maps_in_answers(spark: SparkSession, d: str) -> DataFrame:
    """The object map each answer states, and the number of its points; maps that are no JSON are tested against examples."""
    said = text.extract_map_text(F.col("predicted_answer"))
    rows = _vsi(spark, d).where(F.contains("predicted_answer", F.lit("</map>")))
    rows = rows.withColumn("m", objectmap.parse(said, F.array(*map(F.lit, _OBJECTS))))
    m = F.col("m")
    return rows.select("row_id", F.array_join(F.array_sort(F.map_keys(m)), ",").alias("objects"), F.aggregate(F.map_values(m), F.lit(0), lambda a, p: a + F.size(p)).alias("n_points"))


# Generations ------------------------------------------------------------------------------------------------------

_GEN = f"g AS (SELECT event_id // 8 AS group_id, event_id % 8 AS gen_idx, ({_E} % 11) / 10.0::DOUBLE AS acc, {_E} * 3 % 700 AS length, user_id % 2 = 0 AS is_video FROM events)"


def _generations(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    return e.select(F.floor(F.col("event_id") / 8).alias("group_id"), (F.col("event_id") % 8).alias("gen_idx"), ((F.col("v") % 11) / F.lit(10.0)).alias("acc"), (F.col("v") * 3 % 700).alias("length"), (F.col("user_id") % 2 == 0).alias("is_video"))


@query(f"""
WITH {_GEN}, b AS (SELECT *, acc + CASE WHEN count_if(acc > 0.1) OVER w > 1 AND acc > 0.1 AND length BETWEEN 320 AND 512 THEN 0.2 ELSE 0 END AS reward FROM g WINDOW w AS (PARTITION BY group_id))
SELECT group_id, gen_idx, round(reward, 6) AS reward, round(avg(reward) OVER w, 6) AS group_mean, round(stddev_samp(reward) OVER w, 6) AS group_std, round((reward - avg(reward) OVER w) / (stddev_samp(reward) OVER w + 1e-4), 4) AS advantage FROM b WINDOW w AS (PARTITION BY group_id)""")
def group_advantage(spark: SparkSession, d: str) -> DataFrame:
    rows = groups.length_bonus(_generations(spark, d))
    out = groups.advantages(rows.withColumn("reward", F.col("acc") + F.col("len_bonus")))
    return out.select("group_id", "gen_idx", *(F.round(c, 6).alias(c) for c in ("reward", "group_mean", "group_std")), F.round("advantage", 4).alias("advantage"))


@query(f"""
WITH {_GEN}, s AS (SELECT group_id, avg((length % 9) / 10.0::DOUBLE) AS sm FROM g WHERE gen_idx < 4 AND group_id % 5 <> 0 GROUP BY group_id),
j AS (SELECT g.*, s.sm, avg(acc) OVER (PARTITION BY g.group_id) AS om FROM g LEFT JOIN s USING (group_id))
SELECT group_id, gen_idx, round(acc + CASE WHEN sm IS NOT NULL AND is_video AND om >= 0.8::DOUBLE * sm AND acc > 0.1 THEN 0.3 ELSE 0 END, 6) AS acc_t,
 CASE WHEN sm IS NULL OR NOT is_video THEN 0.5 WHEN om >= 0.8::DOUBLE * sm THEN 1.0 ELSE 0.0 END::DOUBLE AS temporal FROM j""")
def temporal_contrast(spark: SparkSession, d: str) -> DataFrame:
    """Bonus where ordered frames do at least nearly as well as shuffled ones."""
    g = _generations(spark, d)
    shuffled = g.where("gen_idx < 4 and group_id % 5 <> 0").select("group_id", ((F.col("length") % 9) / F.lit(10.0)).alias("acc"))
    return groups.temporal_bonus(g, shuffled).select("group_id", "gen_idx", F.round("acc_t", 6).alias("acc_t"), "temporal")


@query(f"""WITH {_GEN} SELECT round(avg(CAST(w AS INT)), 6) AS all_wrong, round(avg(CAST(r AS INT)), 6) AS all_correct FROM (SELECT bool_and(acc <= 0.8) AS w, bool_and(acc >= 0.2) AS r FROM g GROUP BY group_id)""")
def saturated_groups(spark: SparkSession, d: str) -> DataFrame:
    out = groups.saturation(_generations(spark, d), "acc", wrong=0.8, right=0.2)
    return out.select(F.round("all_wrong", 6).alias("all_wrong"), F.round("all_correct", 6).alias("all_correct"))


_TOKENS_SQL = f"tok AS (SELECT event_id, list_transform(range(1, 13), lambda i: (({_E} + i * 7) % 10)::BIGINT) AS ids, list_transform(range(1, 13), lambda i: -((({_E} + i) % 30)::DOUBLE) / 2) AS lp, list_transform(range(1, 13), lambda i: -(((user_id + i * 3) % 30)::DOUBLE) / 2) AS rp FROM events)"


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    seq = F.sequence(F.lit(1), F.lit(12))
    return _events(spark, d).select(
        "event_id", F.transform(seq, lambda i: ((F.col("v") + i * 7) % 10).cast("bigint")).alias("ids"),
        F.transform(seq, lambda i: -((F.col("v") + i) % 30).cast("double") / 2).alias("lp"), F.transform(seq, lambda i: -((F.col("user_id") + i * 3) % 30).cast("double") / 2).alias("rp"),
    )


_X = "greatest(-10.0::DOUBLE, least(10.0::DOUBLE, rp[i] - lp[i]))"


@query(f"""
WITH {_TOKENS_SQL}, m AS (SELECT *, CASE WHEN list_position(ids, 0) IS NULL OR list_position(ids, 0) = 0 THEN len(ids) ELSE list_position(ids, 0) END::BIGINT AS n FROM tok),
k AS (SELECT *, list_transform(range(1, 13), lambda i: exp({_X}) - ({_X}) - 1) AS kl, list_transform(range(1, 13), lambda i: CASE WHEN i <= n THEN 1 ELSE 0 END) AS mask FROM m)
SELECT event_id, n AS length, array_to_string(mask, '') AS mask, round(list_sum(list_transform(range(1, 13), lambda i: kl[i] * mask[i])) / n, 4) AS mean_kl,
 round(list_sum(list_transform(range(1, 13), lambda i: -(0.5::DOUBLE - 0.04::DOUBLE * kl[i]) * mask[i])) / n, 4) AS loss,
 array_to_string(list_transform(ids, lambda x: CASE WHEN x IN (0, 3) THEN -100 ELSE x END), ' ') AS labels, array_to_string(ids[-5:], ' ') AS last_tokens FROM k""")
def token_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Lengths to the end mark, masks, KL and loss means, masked labels, and the last tokens kept."""
    ids = F.col("ids")
    rows = _tokens(spark, d).withColumn("mask", groups.completion_mask(ids, 0)).withColumn("kl", groups.token_kl(F.col("lp"), F.col("rp")))
    joined = lambda c, sep: F.array_join(F.transform(c, lambda x: x.cast("string")), sep)
    return rows.select(
        "event_id", groups.completion_length(ids, 0).alias("length"), joined(F.col("mask"), "").alias("mask"), F.round(groups.masked_mean(F.col("kl"), F.col("mask")), 4).alias("mean_kl"),
        F.round(groups.sequence_loss(F.col("kl"), F.col("mask"), F.lit(0.5), 0.04), 4).alias("loss"), joined(groups.masked_labels(ids, [0, 3]), " ").alias("labels"), joined(groups.keep_last_tokens(ids, 5), " ").alias("last_tokens"),
    )


@query(f"""SELECT event_id // 500 AS interval, 'eval_' || event_type AS metric, count(value) AS n, round(avg({_E}), 6) AS value FROM events GROUP BY ALL""")
def logged_means(spark: SparkSession, d: str) -> DataFrame:
    return reports.interval_means(_events(spark, d), "event_id", "event_type", "v", 500, "eval_").withColumn("value", F.round("value", 6))


@query(f"""SELECT event_id % 4 AS process, max({_E}) AS runtime, round(avg({_E}), 6) AS mean_length FROM events GROUP BY ALL""")
def process_totals(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).groupBy((F.col("event_id") % 4).alias("process")).agg(F.max("v").alias("runtime"), F.round(F.avg("v"), 6).alias("mean_length"))


@query(f"""SELECT p.c_custkey AS prompt_id, g.gen_idx::INT AS gen_idx, p.c_mktsegment AS segment FROM customer p, (SELECT unnest(range(0, 4)) AS gen_idx) g WHERE (p.c_custkey * 4 + g.gen_idx) BETWEEN 400 AND 799""")
def repeated_generations(spark: SparkSession, d: str) -> DataFrame:
    """Prompts repeated per generation and flattened; the rows of one process by position."""
    rows = groups.repeat_generations(table(spark, d, "customer").select(F.col("c_custkey").alias("prompt_id"), F.col("c_mktsegment").alias("segment")), 4)
    return groups.process_slice(rows.withColumn("rn", F.col("prompt_id") * 4 + F.col("gen_idx")), 1, 400).select("prompt_id", "gen_idx", "segment")


# Rewards ----------------------------------------------------------------------------------------------------------

_TRAIN = "tr AS (SELECT problem_id, any_value(problem_type) AS problem_type, any_value(solution) AS solution, any_value(path) AS path FROM training_example GROUP BY problem_id)"
_TRUTH, _SAID = "coalesce(regexp_extract(s, '(?s)<answer>(.*?)</answer>', 1), '')", "said"


_KIND = "CASE WHEN problem_type = 'free-form' AND problem_id % 2 = 0 THEN 'OCR' ELSE problem_type END"
_PLAIN = "list_filter(regexp_split_to_array(lower(truth), '[^a-z0-9]+'), lambda x: x <> '')"
_BLANKS = r"list_filter(regexp_split_to_array(truth, '\s+'), lambda x: x <> '')"
_COMMON = "(CASE WHEN k = 1 THEN least(len(list_filter(w, lambda x: x = 'b')), 1) ELSE least(len(list_filter(w, lambda x: x = '2')), 1) + least(len(list_filter(w, lambda x: x = '5')), 1) END)"
_LONGEST = f"(CASE WHEN k = 2 AND list_contains(w, '2') AND list_contains(w[list_position(w, '2'):], '5') THEN 2 ELSE least({_COMMON}, 1) END)"
_ROUGE = f"""CASE WHEN len(w) = 0 THEN 0 WHEN k = 0 THEN (2 + CAST(len(w) > 1 AS INT)) / 3.0::DOUBLE ELSE (2.0::DOUBLE * {_COMMON} / (k + len(w))
 + CASE WHEN k = 2 AND len(w) > 1 AND len(list_filter(range(1, len(w)), lambda i: w[i] = '2' AND w[i + 1] = '5')) > 0 THEN 2.0::DOUBLE / len(w) ELSE 0 END + 2.0::DOUBLE * {_LONGEST} / (k + len(w))) / 3 END"""
_ERRORS = f"CASE WHEN k = 0 THEN 1 WHEN len(b) = 0 THEN 0 WHEN list_contains(b, said) THEN 1.0::DOUBLE / len(b) ELSE 0 END"


def q_rewards(rows: str) -> str:
    """accuracy of `rows` (problem_id, problem_type, s, k, ...): k 0 says the truth, 1 `B`, 2 `2.5`."""
    return f"""x AS (SELECT *, CASE WHEN k = 0 THEN {q_strip(_TRUTH)} WHEN k = 1 THEN 'B' ELSE '2.5' END AS said0, {q_strip(_TRUTH)} AS truth FROM {rows}), y AS (SELECT *, {q_strip('said0')} AS said FROM x),
z AS (SELECT *, {q_float(q_number_word('said'))} AS p, {q_float('truth')} AS t, {q_float("replace(said, ',', '')")} AS pr, {q_float("replace(truth, ',', '')")} AS trr, {_PLAIN} AS w, {_BLANKS} AS b FROM y),
scored AS (SELECT *, coalesce(CASE problem_type WHEN 'multiple choice' THEN CAST(said = truth AS INT)::DOUBLE WHEN 'numerical' THEN {q_mra('abs(p - t) / nullif(t, 0)')} WHEN 'OCR' THEN {_ERRORS} WHEN 'free-form' THEN {_ROUGE}
 WHEN 'regression' THEN CASE WHEN pr IS NOT NULL AND trr IS NOT NULL THEN 1 - least(1.0::DOUBLE, (abs(pr - trr) + 1e-9) / (abs(trr) + 1e-9)) END END, 0)::DOUBLE AS accuracy FROM z)"""


@query(f"""
WITH {_TRAIN}, c AS (SELECT problem_id, {_KIND} AS problem_type, solution AS s, problem_id % 3 AS k FROM tr), {q_rewards('c')}
SELECT problem_id, problem_type, round(accuracy, 6) AS accuracy, f AS format, round(accuracy + f, 6) AS total FROM (SELECT *, CASE WHEN k = 2 OR s IS NULL AND k = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS f FROM scored)""")
def training_rewards(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy and format rewards of completions made from the solutions, of all types; half of the free-form rows count as OCR."""
    t = table(spark, d, "training_example").groupBy("problem_id").agg(F.max("problem_type").alias("problem_type"), F.max("solution").alias("solution"))
    kind = F.when((F.col("problem_type") == "free-form") & (F.col("problem_id") % 2 == 0), "OCR").otherwise(F.col("problem_type"))
    k = F.col("problem_id") % 3
    said = F.when(k == 0, text.extract_answer(F.col("solution"))).when(k == 1, "B").otherwise("2.5")
    completion = F.concat(F.when(k == 2, "").otherwise("<think>so</think>"), F.lit("<answer>"), said, F.lit("</answer>"))
    rows = t.withColumns({"problem_type": kind, "completion": completion})
    args = (F.col("problem_type"), F.col("completion"), F.col("solution"))
    return rows.select("problem_id", "problem_type", F.round(rewards.total_reward(["accuracy"], *args), 6).alias("accuracy"), rewards.total_reward(["format"], *args).alias("format"), F.round(rewards.total_reward(["accuracy", "format"], *args), 6).alias("total"))


_STEM = r"regexp_replace(regexp_extract(path, '[^/]*$'), '(.)\.[^.]*$', '\1')"
_LAMPS = "[[(n * 7 % 10)::INT, (n * 3 % 10)::INT], [(n * 5 % 10)::INT, (n % 10)::INT]]"
_SAID_LAMPS = "[[(problem_id % 10)::INT, (problem_id * 3 % 10)::INT], [(problem_id * 7 % 10)::INT, (problem_id % 7)::INT]]"


@query(f"""
WITH {_TRAIN}, c AS (SELECT problem_id, problem_type, solution AS s, CASE WHEN problem_id % 4 = 2 THEN 1 ELSE 0 END AS k, problem_id % 4 AS form, {_STEM} AS stem FROM tr WHERE problem_type IN ('multiple choice', 'numerical')), {q_rewards('c')},
m AS (SELECT *, length(stem) AS n FROM scored), q AS (SELECT *, {_LAMPS} AS sol, {_SAID_LAMPS} AS resp FROM m),
pairs AS (SELECT *, list_sort(flatten(list_transform(range(1, 3), lambda i: list_transform(range(1, 3), lambda j: struct_pack(d := sqrt((resp[i][1] - sol[j][1])::DOUBLE ** 2 + (resp[i][2] - sol[j][2])::DOUBLE ** 2), i := i::INT, j := j::INT))))) AS ps FROM q),
two AS (SELECT *, list_filter(ps, lambda x: x.i <> ps[1].i AND x.j <> ps[1].j)[1] AS other FROM pairs),
lamps AS (SELECT *, (greatest(0.0::DOUBLE, 1 - ps[1].d / (10 * sqrt(2.0::DOUBLE))) + greatest(0.0::DOUBLE, 1 - other.d / (10 * sqrt(2.0::DOUBLE)))) / 2 AS lamp, CASE WHEN problem_id % 5 = 0 THEN 0 ELSE greatest(0.0::DOUBLE, 1 - abs(n % 10 - problem_id % 10) / (10 * sqrt(2.0::DOUBLE))) END AS sofa FROM two),
total AS (SELECT *, CASE WHEN form = 3 OR stem IS NULL OR n % 7 = 0 THEN 0 ELSE (2 * lamp + sofa) / 3 END AS score FROM lamps)
SELECT problem_id, problem_type, round(CASE WHEN form <> 1 AND s IS NOT NULL AND (CASE WHEN problem_type = 'numerical' THEN accuracy > 0.5 ELSE accuracy = 1.0 END) THEN CASE WHEN score > 0 THEN accuracy + score ELSE 0 END ELSE accuracy END, 6) AS reward FROM total""")
def map_guided_rewards(spark: SparkSession, d: str) -> DataFrame:
    """Choice and number rewards with the bonus of the object map that a completion states, against the map of its video; every seventh length of a name has none, every video has an older map too."""
    t = table(spark, d, "training_example").groupBy("problem_id").agg(*(F.max(c).alias(c) for c in ("problem_type", "solution", "path"))).where(F.col("problem_type").isin("multiple choice", "numerical"))
    whole = lambda x: x.cast("int")
    n = F.length("video_id")
    point = lambda a, b: F.array(whole(a % 10), whole(b % 10))
    videos = t.select(text.file_stem(F.col("path")).alias("video_id")).where(F.col("video_id").isNotNull() & (n % 7 != 0)).distinct()
    newest = F.create_map(F.lit("lamp"), F.array(point(n * 7, n * 3), point(n * 5, n)), F.lit("sofa"), F.array(point(n, F.lit(0))))
    older = F.create_map(F.lit("lamp"), F.array(point(F.lit(0), F.lit(0))))
    maps = videos.withColumn("at", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("cognitive_map", F.when(F.col("at") == 2, newest).otherwise(older)).withColumn("object_list", F.map_keys("cognitive_map"))
    p, form = F.col("problem_id"), F.col("problem_id") % 4
    said = F.when(form == 2, "B").otherwise(text.extract_answer(F.col("solution")))
    sofa = F.when(p % 5 == 0, "").otherwise(F.format_string(', "sofa": [[%d, 0]]', p % 10))
    stated = F.when(form == 1, "").when(form == 3, '<map>{"ghost": [[1, 1]]}</map>').otherwise(F.concat(F.format_string('<map>{"lamp": [[%d, %d], [%d, %d]]', p % 10, p * 3 % 10, p * 7 % 10, p % 7), sofa, F.lit("}</map>")))
    rows = t.withColumn("completion", F.concat(F.lit("<think>so</think>"), stated, F.lit("<answer>"), said, F.lit("</answer>")))
    return rewards.map_guided(rows, maps, order="at").select("problem_id", "problem_type", F.round("reward", 6).alias("reward"))


@query("""SELECT event_id, '------------- ' || strftime(ts, '%d-%H-%M-%S-%f') || ' Accuracy reward: ' || ((event_id % 11) / 10.0)::DOUBLE::VARCHAR || ' -------------' || chr(10) || 'Content: ' || event_type || chr(10) || 'Solution: ' || user_id || chr(10) AS entry FROM events""")
def debug_log(spark: SparkSession, d: str) -> DataFrame:
    """The log entry of each reward."""
    e = table(spark, d, "events")
    return e.select("event_id", rewards.debug_entry(F.col("ts"), (F.col("event_id") % 11) / F.lit(10.0), F.col("event_type"), F.col("user_id").cast("string")).alias("entry"))


@query("""WITH o AS (SELECT event_id, (event_id // 4 * 7) % 3 AS process FROM events) SELECT event_id, process, row_number() OVER (PARTITION BY process ORDER BY event_id) - 1 AS local FROM o""")
def regrouped(spark: SparkSession, d: str) -> DataFrame:
    """Gathered generations given back to the processes that own their items, four each."""
    rows = table(spark, d, "events").select("event_id")
    owners = rows.select(F.floor(F.col("event_id") / 4).alias("item")).distinct().withColumn("process", F.col("item") * 7 % 3)
    return groups.regrouped(rows, owners, 4, "event_id").select("event_id", "process", "local")


@query(f"""WITH m AS (SELECT event_id, user_id % 2 AS k, ({_E} % 11) / 10.0::DOUBLE AS r, (({_E} // 11) % 4) / 10.0::DOUBLE AS s, event_id % 3 <> 0 AS has_map FROM events)
SELECT event_id, round(CASE WHEN has_map AND (CASE WHEN k = 0 THEN r = 1.0 ELSE r > 0.5 END) THEN CASE WHEN s > 0 THEN r + s ELSE 0 END ELSE r END, 6) AS reward FROM m""")
def map_bonus(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    kind = F.when(F.col("user_id") % 2 == 0, "multiple choice").otherwise("numerical")
    said = F.when(F.col("event_id") % 3 != 0, "<map>{}</map>").otherwise("none")
    r, s = (F.col("v") % 11) / F.lit(10.0), (F.floor(F.col("v") / 11) % 4) / F.lit(10.0)
    return e.select("event_id", F.round(rewards.with_map_bonus(r, kind, said, s), 6).alias("reward"))


# Prompts ----------------------------------------------------------------------------------------------------------

_OPT = "tr AS (SELECT problem_id, any_value(problem) AS problem, any_value(problem_type) AS problem_type, any_value(options) AS options, any_value(path) AS path, any_value(data_type) AS data_type, any_value(data_source) AS data_source FROM training_example GROUP BY problem_id)"


def _training(spark: SparkSession, d: str) -> DataFrame:
    cols = ["problem", "problem_type", "options", "path", "data_type", "data_source", "solution"]
    return table(spark, d, "training_example").groupBy("problem_id").agg(*(F.max(c).alias(c) for c in cols))


@query(f"""WITH {_OPT} SELECT problem_id, CASE WHEN problem_type = 'multiple choice' AND options IS NOT NULL THEN problem || 'Options:' || chr(10) || coalesce(array_to_string(list_transform(options, lambda x: x || chr(10)), ''), '') ELSE problem END AS block,
 CASE WHEN len(options) > 0 THEN chr(10) || 'Options:' || chr(10) || array_to_string(options, chr(10)) ELSE '' END AS suffix,
 coalesce(array_to_string(list_transform(range(1, len(options) + 1), lambda i: chr((64 + i)::INT) || '. ' || options[i] || chr(10)), ''), '') AS lettered FROM tr""")
def option_prompts(spark: SparkSession, d: str) -> DataFrame:
    o = F.col("options")
    return _training(spark, d).select("problem_id", prompts.options_block(F.col("problem"), o, F.col("problem_type")).alias("block"), prompts.options_suffix(o).alias("suffix"), F.coalesce(prompts.lettered(o), F.lit("")).alias("lettered"))


@query("""SELECT p_partkey, 'B ' || p_type || chr(10) || 'A ' || p_brand AS keyed, 'From ' || p_size || ' seconds to ' || (p_size + 5) || ' seconds. ' || p_name || chr(10) || 'B ' || p_type || chr(10) || 'A ' || p_brand AS ranged, chr(65 + (p_partkey % 5)::INT) AS letter, CASE WHEN p_size % 2 = 0 THEN 128 ELSE 1024 END AS max_tokens FROM part""")
def keyed_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Candidates in their map's order, and questions on a stretch of time with them below."""
    options = F.create_map(F.lit("B"), F.col("p_type"), F.lit("A"), F.col("p_brand"))
    kind = F.when(F.col("p_size") % 2 == 0, "default").otherwise("thinking")
    ranged = prompts.ranged_question(F.col("p_name"), F.col("p_size"), F.col("p_size") + 5, options)
    return table(spark, d, "part").select("p_partkey", prompts.keyed(options).alias("keyed"), ranged.alias("ranged"), prompts.answer_letter((F.col("p_partkey") % 5).cast("int")).alias("letter"), prompts.max_tokens(kind).alias("max_tokens"))


@query("""SELECT p_partkey, '[{"role":"user","content":[{"type":"video","video":' || to_json(p_brand) || '},{"type":"text","text":' || to_json(p_name) || '}]}]' AS with_video, '[{"role":"user","content":[{"type":"image"},{"type":"text","text":' || to_json(p_name) || '}]}]' AS without_path,
 '[{"role":"system","content":"You watch videos."},{"role":"user","content":' || to_json(p_name) || '}]' AS plain FROM part""")
def messages_as_json(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as JSON, null fields left out: with a medium and its path, with a medium alone, of text alone."""
    name = F.col("p_name")
    return table(spark, d, "part").select(
        "p_partkey", prompts.without_nulls(prompts.user_message(F.lit("video"), F.col("p_brand"), name)).alias("with_video"),
        prompts.without_nulls(prompts.user_message(F.lit("image"), F.lit(None).cast("string"), name)).alias("without_path"), prompts.without_nulls(prompts.plain_messages("You watch videos.", name)).alias("plain"),
    )


@query(f"""WITH {_SPAR_SQL}, q AS (SELECT row_id, {q_category('task')} AS task, question FROM spar_result WHERE question IS NOT NULL {_ONCE})
SELECT row_id, 'Look.' || chr(10) || question || chr(10) || CASE WHEN task IN {q_in(reports.SPAR_NUMBER)} THEN 'Say a number.' WHEN task IN {q_in(reports.SPAR_CHOICE)} THEN CASE WHEN task IN ('position_matching', 'camera_motion_infer') THEN 'Boxes run to 1000.' ELSE '' END || chr(10) || 'Say a letter.' WHEN task = 'view_change_infer' THEN chr(10) END AS prompt
FROM q WHERE task IN {q_in(reports.SPAR_NUMBER + reports.SPAR_CHOICE + reports.SPAR_VIEW)}""")
def task_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Prompts by the family of a row's task."""
    rows = _once(table(spark, d, "spar_result").select("row_id", "question", "task", "logged_at")).withColumn("task", _task("task")).where(F.col("question").isNotNull())
    families = reports.SPAR_NUMBER, reports.SPAR_CHOICE, reports.SPAR_VIEW
    prompt = prompts.task_prompt(F.col("question"), F.col("task"), *families, "Look.", {"number": "Say a number.", "choice": "Say a letter."}, "Boxes run to 1000.", ["position_matching", "camera_motion_infer"])
    return rows.where(F.col("task").isin([t for f in families for t in f])).select("row_id", prompt.alias("prompt"))


_TEMPLATES = {"default": "Q: {Question}", "multiple choice": "Pick one. {Question}", "numerical": "Give a number. {Question}"}
_SUFFIXES = {"multiple choice": " Answer with a letter.", "numerical": " Answer with a number.", "free-form": " Answer with a text.", "regression": " Answer with a value."}
_VALUES = lambda d: ", ".join(f"('{k}', '{v}')" for k, v in d.items())
_ASKED = "CASE WHEN problem_type = 'multiple choice' AND options IS NOT NULL THEN problem || 'Options:' || chr(10) || coalesce(array_to_string(list_transform(options, lambda x: x || chr(10)), ''), '') ELSE problem END"


@query(f"""WITH {_OPT}, t(kind, template) AS (VALUES {_VALUES(_TEMPLATES)}), x(kind, suffix) AS (VALUES {_VALUES(_SUFFIXES)})
SELECT problem_id, replace(coalesce(t.template, 'Q: {{Question}}'), '{{Question}}', problem) AS prompt, 'Question: ' || {_ASKED} || chr(10) || 'Think first.' || coalesce(x.suffix, '') AS typed
FROM tr LEFT JOIN t ON problem_type = t.kind LEFT JOIN x ON problem_type = x.kind""")
def template_prompts(spark: SparkSession, d: str) -> DataFrame:
    """A template by prompt kind; and one template for all, with what each problem type asks for behind it."""
    rows = prompts.with_template(_training(spark, d), _TEMPLATES, "problem_type", "default")
    asked = prompts.options_block(F.col("problem"), F.col("options"), F.col("problem_type"))
    typed = prompts.typed_prompt(asked, F.col("problem_type"), "Question: {Question}\nThink first.", _SUFFIXES)
    return rows.select("problem_id", prompts.filled(F.col("template"), Question=F.col("problem")).alias("prompt"), typed.alias("typed"))


_MAPPED = "Map {object_list} as {map_example}. Question: {Question}"


@query(f"""WITH {_OPT}, x(kind, suffix) AS (VALUES {_VALUES(_SUFFIXES)})
SELECT problem_id, CASE WHEN data_source = 'SR_dataset' THEN 'Map [''lamp'', "cook''s table"] as {{"lamp": [[1, 2]]}}. Question: ' || {_ASKED} ELSE 'Question: ' || {_ASKED} END || coalesce(x.suffix, '') AS prompt,
 CASE WHEN path IS NULL THEN NULL WHEN regexp_matches(path, '^https?://') THEN 'http' WHEN regexp_matches(path, '^file://') THEN 'file_url' WHEN regexp_matches(path, '^data:image') THEN 'data_url' ELSE 'path' END AS media,
 (CASE WHEN data_type IN ('image', 'video') THEN 2 ELSE 0 END + 1)::INT AS n_vision, path AS first_medium, regexp_replace(regexp_extract(path, '[^/]*$'), '(.)\\.[^.]*$', '\\1') AS stem FROM tr LEFT JOIN x ON problem_type = x.kind""")
def message_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Prompts that ask for an object map where the source has one, in conversations, and the vision parts found in several of them."""
    rows = _training(spark, d)
    points = F.array(F.array(F.lit(1), F.lit(2)))
    question = prompts.options_block(F.col("problem"), F.col("options"), F.col("problem_type"))
    prompt = prompts.map_aware(question, F.create_map(F.lit("lamp"), points, F.lit("cook's table"), points), F.col("data_source"), F.col("problem_type"), "Question: {Question}", _MAPPED, _SUFFIXES, '{"lamp": [[1, 2]]}')
    kind = F.coalesce("data_type", F.lit("none"))
    chat = prompts.sft_messages("You watch videos.", kind, F.col("path"), prompt, F.col("solution"))
    user = prompts.user_message(kind, F.col("path"), prompt)
    addressed = prompts.user_message(F.lit("image_url"), F.col("path"), prompt)
    parts = prompts.vision_parts_of_all(F.array(addressed, chat, user))
    return rows.select(
        "problem_id", F.get(F.get(user, F.lit(0))["content"], F.lit(1))["text"].alias("prompt"), prompts.media_kind(F.col("path")).alias("media"), F.size(parts).alias("n_vision"),
        F.get(parts, F.lit(0))["image_url"].alias("first_medium"), text.file_stem(F.col("path")).alias("stem"),
    )


# Curation, sampling, shards ------------------------------------------------------------------------------------------


@query(r"""
SELECT p_partkey, p_name AS problem, '<think>' || p_brand || ' ' || p_type || '</think>' || chr(10) || chr(10) || '<answer>' || p_size || '</answer>' AS solution FROM part WHERE p_size >= 28 AND p_partkey % 5 > 1""")
def curated(spark: SparkSession, d: str) -> DataFrame:
    """Raw responses taken apart, put together and filtered: by size, without answer marks in problems, without empty tags in solutions."""
    k = F.col("p_partkey") % 5
    name = F.concat("p_name", F.when(k == 0, " Answer: so").otherwise(""))
    brand, kind = F.when(k == 1, "").otherwise(F.col("p_brand")), F.when(k == 1, "").otherwise(F.concat(F.lit(" "), "p_type"))
    said = F.when(k == 1, "").otherwise(F.concat(F.lit("Answer: "), F.col("p_size").cast("string")))
    raw = table(spark, d, "part").select("p_partkey", F.col("p_size").alias("h"), (F.col("p_size") * 2).alias("w"), F.concat(F.lit("Question: "), name, F.lit(" Answer: <think>"), brand, F.lit("</think> then <think> "), kind, F.lit("</think><answer>"), said, F.lit("</answer>")).alias("response"))
    return curation.keep_clean(curation.clean_reasoning(raw), height="h", width="w").select("p_partkey", "problem", "solution")


@query(f"""SELECT p_partkey, p_name AS problem, '<think>' || p_brand || ' ' || p_type || '</think>' || chr(10) || chr(10) || '<answer>' || p_size || ' Answer: yes</answer>' AS solution, 'im/' || p_partkey || '.png' AS image_path, p_type AS original_question, p_brand AS original_answer
FROM part WHERE p_partkey % 7 > 1 UNION ALL SELECT p_partkey, NULL, NULL, NULL, NULL, NULL FROM part WHERE p_partkey % 7 <= 1""")
def ingested(spark: SparkSession, d: str) -> DataFrame:
    """Annotations read from JSON texts: a mark before an answer goes, one within it stays; broken and incomplete texts give nulls."""
    p = table(spark, d, "part")
    mark = F.when(F.col("p_partkey") % 2 == 0, "Answer: ").otherwise("")
    response = F.concat(F.lit("Question: "), "p_name", F.lit(" Answer: <think>"), "p_brand", F.lit("</think> then <think>"), "p_type", F.lit("</think><answer>"), mark, F.col("p_size").cast("string"), F.lit(" Answer: yes</answer>"))
    image = F.concat(F.lit("im/"), F.col("p_partkey").cast("string"), F.lit(".png"))
    whole = F.to_json(F.struct(response.alias("gpt4o_response"), image.alias("image_path"), F.col("p_type").alias("question"), F.when(F.col("p_partkey") % 7 != 1, F.col("p_brand")).alias("answer")))
    raw = p.select("p_partkey", F.when(F.col("p_partkey") % 7 == 0, F.expr("substring(p_name, 1, 5)")).otherwise(whole).alias("line"))
    return curation.ingest_annotations(raw).select("p_partkey", "problem", "solution", "image_path", "original_question", "original_answer")


@query(r"""SELECT problem_id, path FROM training_example WHERE path IS NULL OR regexp_extract(path, '[^/]*$') NOT IN (SELECT scene_name || '.mp4' FROM vsi_annotation WHERE scene_name IS NOT NULL)""")
def leakage_excluded(spark: SparkSession, d: str) -> DataFrame:
    """Training rows whose file is not on the list of evaluation files."""
    listed = table(spark, d, "vsi_annotation").select(F.concat("scene_name", F.lit(".mp4")).alias("file_name"))
    return curation.exclude_listed(table(spark, d, "training_example").select("problem_id", "path"), listed, "path", "file_name")


@query("SELECT row_id FROM vsi_result WHERE scene_name IN (SELECT scene_name FROM vsi_annotation WHERE dataset = 'oakfloor')")
def with_existing_media(spark: SparkSession, d: str) -> DataFrame:
    media = table(spark, d, "vsi_annotation").where("dataset = 'oakfloor'").select("scene_name")
    return curation.with_media(table(spark, d, "vsi_result").select("row_id", "scene_name"), media, "scene_name").select("row_id")


def _q_stable(x: str, seed: int) -> str:
    return f"(((({x}) * 48271 + {seed * 16807 + 12345}) % 2147483647) * 69621 + 1013904223) % 2147483647"


@query(f"SELECT o_orderkey FROM orders ORDER BY {_q_stable('o_orderkey', 42)}, o_orderkey LIMIT 500")
def sampled_rows(spark: SparkSession, d: str) -> DataFrame:
    return curation.sample_n(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 500)


@query(f"""WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY {_q_stable('o_orderkey', 42)}, o_orderkey) - 1 AS rn FROM orders)
SELECT o_orderkey, rn, ntile(7) OVER (ORDER BY rn) - 1 AS shard, rn // 64 AS batch FROM n""")
def shards_and_batches(spark: SparkSession, d: str) -> DataFrame:
    """Rows in a stable shuffled order, numbered, in contiguous shards and batches."""
    rows = table(spark, d, "orders").select("o_orderkey").withColumn("k", curation.stable_order(F.col("o_orderkey"), 42))
    total = F.lit(rows.count())
    out = curation.numbered(rows, ["k", "o_orderkey"])
    return out.select("o_orderkey", "rn", curation.shard_of(F.col("rn"), total, 7).alias("shard"), curation.batch_of(F.col("rn"), 64).alias("batch"))


@query(f"""SELECT event_id, array_to_string(list_transform(list_sort(list_transform(range(0, 6), lambda i: struct_pack(k := {_q_stable('i', 7)}, f := i * 10 + user_id % 3))), lambda s: s.f), ' ') AS frames FROM events""")
def permuted_frames(spark: SparkSession, d: str) -> DataFrame:
    fr = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: i * 10 + F.col("user_id") % 3)
    return _events(spark, d).select("event_id", F.array_join(F.transform(curation.shuffled_frames(fr, 7), lambda x: x.cast("string")), " ").alias("frames"))


# Joins, set operations, sources ----------------------------------------------------------------------------------------


@query("""WITH dim AS (SELECT scene_name AS video_id, max(question) AS q, min(id) AS first_id FROM vsi_annotation WHERE scene_name IS NOT NULL GROUP BY scene_name),
s AS (SELECT problem_id, lower(regexp_replace(regexp_extract(path, '[^/]*$'), '(.)\\.[^.]*$', '\\1')) AS stem FROM training_example)
SELECT problem_id, stem, first_id FROM s LEFT JOIN dim ON stem = video_id""")
def stem_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Training rows with the dimension row of their file stem, if there is one."""
    dim = table(spark, d, "vsi_annotation").where("scene_name is not null").groupBy(F.col("scene_name").alias("stem")).agg(F.min("id").alias("first_id"))
    rows = table(spark, d, "training_example").select("problem_id", F.lower(text.file_stem(F.col("path"))).alias("stem"))
    return rows.join(dim, "stem", "left").select("problem_id", "stem", "first_id")


@query("""WITH a AS (SELECT lower(trim(question_type)) AS name, count(*) AS n_a FROM vsi_annotation WHERE question_type IS NOT NULL GROUP BY 1), b AS (SELECT lower(trim(question_type)) AS name, count(*) AS n_b FROM vsi_result WHERE question_type IS NOT NULL GROUP BY 1)
SELECT name, coalesce(n_a, 0) AS n_a, coalesce(n_b, 0) AS n_b FROM a FULL JOIN b USING (name)""")
def key_union(spark: SparkSession, d: str) -> DataFrame:
    """All keys of two sides, whatever side they are of."""
    per = lambda t, n: table(spark, d, t).where("question_type is not null").groupBy(F.lower(F.trim("question_type")).alias("name")).agg(F.count("*").alias(n))
    return per("vsi_annotation", "n_a").join(per("vsi_result", "n_b"), "name", "full").select("name", F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"))


@query("""SELECT o_custkey, arg_max(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey)) AS last_order FROM orders GROUP BY o_custkey""")
def last_rows(spark: SparkSession, d: str) -> DataFrame:
    """The last row per key wins."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.struct("o_orderdate", "o_orderkey").alias("at"))
    return tables.last_per_key(o, "o_custkey", "at").select("o_custkey", F.col("o_orderkey").alias("last_order"))


@query("""SELECT tab, run_name, count(*) AS n FROM (SELECT 'vsi' AS tab, run_name FROM vsi_result UNION ALL SELECT 'spar', run_name FROM spar_result UNION ALL SELECT 'tempcompass', run_name FROM tempcompass_result) GROUP BY ALL""")
def merged_results(spark: SparkSession, d: str) -> DataFrame:
    """Result tables of different columns as one."""
    parts = [table(spark, d, f"{t}_result").withColumn("tab", F.lit(t)).select("tab", "run_name", *c) for t, c in (("vsi", ["scene_name"]), ("spar", ["image_type"]), ("tempcompass", []))]
    return tables.union_tables(parts).groupBy("tab", "run_name").agg(F.count("*").alias("n"))


@query("""SELECT name, bool_or(s = 1) AND bool_or(s = 2) AS in_both FROM (SELECT scene_name AS name, 1 AS s FROM vsi_annotation WHERE scene_name IS NOT NULL UNION ALL SELECT scene_name, 2 FROM documents WHERE scene_name IS NOT NULL) GROUP BY name""")
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    """Distinct names of two tables, and whether both have them."""
    a, b = (table(spark, d, t).where("scene_name is not null").select(F.col("scene_name").alias("name")).distinct() for t in ("vsi_annotation", "documents"))
    both = a.intersect(b).withColumn("in_both", F.lit(True))
    return both.unionByName(a.union(b).distinct().exceptAll(both.select("name")).withColumn("in_both", F.lit(False)))


_KINDS = ["lines.json", "array.json", "jsonl", "csv", "tsv", "parquet"]


@query(" UNION ALL ".join(f"SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey, '{k}' AS kind FROM nation" for k in _KINDS))
def source_kinds(spark: SparkSession, d: str) -> DataFrame:
    """A table written as JSON lines, a JSON array, CSV, TSV and Parquet, and read back by extension."""
    base, nation = _scratch(spark, "source_kinds"), table(spark, d, "nation")
    frames_ = []
    for kind in _KINDS:
        path = f"{base}.{kind}"
        w = nation.write.mode("overwrite")
        if kind == "array.json":  # one document by its nature
            nation.agg(F.to_json(F.collect_list(F.struct(*nation.columns))).alias("value")).write.mode("overwrite").text(path)
        else:
            w.parquet(path) if kind == "parquet" else w.option("header", True).option("sep", "," if kind == "csv" else "\t").csv(path) if kind in ("csv", "tsv") else w.json(path)
        frames_.append(tables.read_table(spark, path).select(*(F.col(c).cast("string").alias(c) for c in ("n_nationkey", "n_name", "n_regionkey"))).withColumn("kind", F.lit(kind)))
    return tables.union_tables(frames_)


def _scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder."""
    from ..session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get() + f"/{name}"


@query("SELECT id, question, ground_truth, predicted_answer, task, image_type, promt FROM spar_result")
def typed_results(spark: SparkSession, d: str) -> DataFrame:
    """Result rows written as JSON lines and read under their declared schema."""
    path = _scratch(spark, "typed_results")
    columns = [c.split()[0] for c in tables.RESULT_SCHEMAS["spar"].split(", ")]
    tables.write_results(table(spark, d, "spar_result").select(*columns), path, mode="overwrite")
    return tables.read_table(spark, path, fmt="jsonl", schema=tables.RESULT_SCHEMAS["spar"])


@query("SELECT event_id, event_id % 4 AS rank, row_number() OVER (ORDER BY event_id % 4, event_id) - 1 AS place FROM events")
def merged_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Rows of four ranks, one after the other."""
    rows = table(spark, d, "events").select("event_id", (F.col("event_id") % 4).alias("rank"))
    return curation.numbered(rows, ["rank", "event_id"], "place")


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def existing_files(spark: SparkSession, d: str) -> DataFrame:
    """The tables of a list of files, those that do not exist left out."""
    names = {f"{d}/nation.parquet": ("n_nationkey", "n_name"), f"{d}/missing.parquet": ("x", "y"), f"{d}/region.parquet": ("r_regionkey", "r_name")}
    found = [tables.read_table(spark, p).select(F.col(names[p][0]).alias("n_nationkey"), F.col(names[p][1]).alias("n_name")) for p in tables.existing(spark, list(names))]
    return tables.union_tables(found)


@query("SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{f}', '{m}')" for t, (fs, m) in tables.CATALOGUE.items() for f in fs) + ") AS c(task, file, media)")
def benchmark_files(spark: SparkSession, d: str) -> DataFrame:
    """The data files and media folders of the benchmarks."""
    return tables.catalogue(spark).select("task", F.explode("files").alias("file"), "media")


@query("SELECT row_id, upper(promt) AS predicted_answer FROM tempcompass_result WHERE promt IS NOT NULL")
def predicted_texts(spark: SparkSession, d: str) -> DataFrame:
    """The boundary of inference, with a stand-in for the model."""
    rows = table(spark, d, "tempcompass_result").where("promt is not null").select("row_id", "promt")
    return predict.predicted(rows, lambda texts: [t.upper() for t in texts]).select("row_id", "predicted_answer")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(avg(floor(value)), 6) AS value FROM events GROUP BY ALL")
def streamed_means(spark: SparkSession, d: str) -> DataFrame:
    """Daily means of events read as a stream of files, all that are there at once."""
    path = _scratch(spark, f"streamed_means_{uuid.uuid4().hex}")
    columns = ", ".join(f"`{c}` {t}" for c, t in table(spark, d, "events").dtypes)
    events = scoring.result_stream(spark, d, columns, "parquet", glob="events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    means = scoring.windowed_means(events, F.floor("value").cast("double"), "event_type", "ts", "10000 days", "1 day")
    name = f"streamed_means_{uuid.uuid4().hex}"
    means.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", path).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).withColumns({"start": F.col("start").cast("timestamp_ntz"), "value": F.round("value", 6)})


@query(r"""SELECT event_id, lpad(((floor(value)::BIGINT * 100 % 86400) // 3600)::VARCHAR, 2, '0') || 'h' || lpad((((floor(value)::BIGINT * 100 % 86400) % 3600) // 60)::VARCHAR, 2, '0') || 'm' || lpad(((floor(value)::BIGINT * 100 % 86400) % 60)::VARCHAR, 2, '0') || 's' AS elapsed,
 'data:image;base64,' || base64(encode(event_type)) AS url, strftime(ts, '%Y%m%d_%H%M%S') AS run_dir FROM events""")
def formatted(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", text.format_time(F.floor("value") * 100).alias("elapsed"), text.data_url(F.encode("event_type", "utf-8")).alias("url"), text.run_directory(F.col("ts")).alias("run_dir"))


# Frames -------------------------------------------------------------------------------------------------------------


def _q_half_even(x: str) -> str:
    return f"(CASE WHEN {x} - floor({x}) = 0.5 THEN 2 * round({x} / 2) ELSE floor({x} + 0.5) END)"


@query(f"""
WITH p AS (SELECT p_partkey, (p_partkey * 37 % 4000 + 10)::DOUBLE AS h, (p_partkey * 91 % 5000 + 10)::DOUBLE AS w FROM part),
r AS (SELECT *, greatest(28, {_q_half_even('(h / 28)')} * 28) AS h1, greatest(28, {_q_half_even('(w / 28)')} * 28) AS w1, sqrt(h * w / 12845056.0::DOUBLE) AS down, sqrt(3136.0::DOUBLE / (h * w)) AS up FROM p)
SELECT p_partkey, CASE WHEN greatest(h, w) / least(h, w) <= 200 THEN CASE WHEN h1 * w1 > 12845056 THEN floor(h / down / 28) * 28 WHEN h1 * w1 < 3136 THEN ceil(h * up / 28) * 28 ELSE h1 END END::BIGINT AS height,
 CASE WHEN greatest(h, w) / least(h, w) <= 200 THEN CASE WHEN h1 * w1 > 12845056 THEN floor(w / down / 28) * 28 WHEN h1 * w1 < 3136 THEN ceil(w * up / 28) * 28 ELSE w1 END END::BIGINT AS width,
 CASE WHEN greatest(h, w) <= 448 THEN h ELSE floor(h * (448.0::DOUBLE / greatest(h, w))) END::BIGINT AS capped_height, CASE WHEN greatest(h, w) <= 448 THEN w ELSE floor(w * (448.0::DOUBLE / greatest(h, w))) END::BIGINT AS capped_width,
 CASE WHEN greatest(h, w) <= 448 THEN h ELSE floor(w * (448.0::DOUBLE / greatest(h, w))) END::BIGINT AS turned_height FROM r""")
def resized(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    h, w = (k * 37 % 4000 + 10).cast("double"), (k * 91 % 5000 + 10).cast("double")
    s, c = frames.smart_resize(h, w), frames.capped_size(h, w)
    turned = frames.capped_size(h, w, transposed=True)
    return table(spark, d, "part").select("p_partkey", s["height"].alias("height"), s["width"].alias("width"), c["height"].alias("capped_height"), c["width"].alias("capped_width"), turned["height"].alias("turned_height"))


@query(f"""
WITH o AS (SELECT o_orderkey, o_orderkey % 900 + 1 AS total, (o_orderkey % 30 + 1)::DOUBLE AS vf FROM orders),
n AS (SELECT *, floor(least(greatest(total / vf * 2.0::DOUBLE, 4.0::DOUBLE), floor(least(768, total) / 2.0::DOUBLE) * 2, total::DOUBLE) / 2) * 2 AS n0, {_q_half_even('((total % 17) / 2.0::DOUBLE)')} * 2 AS n1 FROM o)
SELECT o_orderkey, CASE WHEN n0 >= 2 AND n0 <= total THEN n0 END::BIGINT AS n_frames, CASE WHEN n1 >= 2 AND n1 <= total THEN n1 END::BIGINT AS n_given, round(8 / greatest(total::DOUBLE, 1e-6) * vf, 6) AS sample_fps,
 array_to_string(list_transform(range(0, 5), lambda i: {_q_half_even('(i * ((total - 1)::DOUBLE / 4))')}::BIGINT), ' ') AS rounded, array_to_string(list_transform(range(0, 5), lambda i: floor(i * ((total - 1)::DOUBLE / 4))::BIGINT), ' ') AS truncated,
 greatest(least(602112.0::DOUBLE, 90316800.0::DOUBLE / total * 2), 105369.0::DOUBLE) AS pixels, least((o_orderkey % 50 * 20000)::DOUBLE, greatest(least(602112.0::DOUBLE, 90316800.0::DOUBLE / total * 2), 105369.0::DOUBLE)) AS given_pixels FROM n""")
def frame_counts(spark: SparkSession, d: str) -> DataFrame:
    """Frames taken, indices rounded and truncated, rates and pixel budgets."""
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 900 + 1).alias("total"), (F.col("o_orderkey") % 30 + 1).cast("double").alias("vf"))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    t = F.col("total")
    return o.select(
        "o_orderkey", frames.smart_nframes(t, F.col("vf")).alias("n_frames"), frames.rounded_nframes(t % 17, t).alias("n_given"), F.round(frames.sample_fps(F.lit(8), t, F.col("vf")), 6).alias("sample_fps"),
        joined(frames.frame_indices(t, F.lit(5))).alias("rounded"), joined(frames.truncated_indices(t, F.lit(5))).alias("truncated"), frames.pixel_budget(t, 90316800, 602112, 128 * 28 * 28).alias("pixels"), frames.pixel_budget(t, 90316800, 602112, 128 * 28 * 28, F.col("o_orderkey") % 50 * 20000).alias("given_pixels"),
    )


@query("""
WITH o AS (SELECT o_orderkey, o_orderkey % 900 + 1 AS total, (o_orderkey % 31)::DOUBLE AS vf FROM orders), r AS (SELECT *, CASE WHEN vf > 0 THEN vf ELSE 30 END AS rate FROM o),
n AS (SELECT *, floor(total / rate)::BIGINT AS duration, greatest(1, least(32, floor(total / rate)))::BIGINT AS n FROM r),
i AS (SELECT *, list_transform(range(0, n), lambda k: floor(k * ((total - 1)::DOUBLE / greatest(n - 1, 1)))::BIGINT) AS idx FROM n)
SELECT o_orderkey, n, duration, array_to_string(idx, ' ') AS indices, array_to_string(list_transform(idx, lambda x: floor(x / rate)::BIGINT), ' ') AS stamps, len(idx) + len(idx) % 2 AS padded FROM i""")
def frame_samples(spark: SparkSession, d: str) -> DataFrame:
    """Frames sampled at a rate with their time stamps, and the length after padding to even."""
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 900 + 1).alias("total"), (F.col("o_orderkey") % 31).cast("double").alias("vf"))
    s = frames.sampled_frames(F.col("total"), F.col("vf"), 32, 1)
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    return o.select("o_orderkey", s.alias("s")).select("o_orderkey", "s.n", "s.duration", joined(F.col("s.indices")).alias("indices"), joined(F.col("s.timestamps")).alias("stamps"), F.size(frames.padded_even(F.col("s.indices"))).cast("bigint").alias("padded"))


# Keyed zips, pairs, retries --------------------------------------------------------------------------------------------


@query(f"""WITH {_GEN}, s AS (SELECT group_id, gen_idx, length % 5 AS solution FROM g WHERE gen_idx % 3 <> 0) SELECT g.group_id, g.gen_idx, g.acc, s.solution FROM g JOIN s USING (group_id, gen_idx)""")
def keyed_zip(spark: SparkSession, d: str) -> DataFrame:
    """Generations beside their solutions by key, where the reference pairs them by position."""
    g = _generations(spark, d)
    s = g.where("gen_idx % 3 <> 0").select("group_id", "gen_idx", (F.col("length") % 5).alias("solution"))
    return g.join(s, ["group_id", "gen_idx"]).select("group_id", "gen_idx", "acc", "solution")


@query("""WITH p AS (SELECT vec_id, unnest(range(0, 3)) AS r FROM embeddings), q AS (SELECT vec_id, unnest(range(0, 2)) AS s FROM embeddings)
SELECT p.vec_id, p.r::INT AS r, q.s::INT AS s, round(sqrt(((p.r * 3 + p.vec_id) % 10 - (q.s * 7 + p.vec_id) % 10)::DOUBLE ** 2 + (p.r - q.s)::DOUBLE ** 2), 6) AS distance FROM p JOIN q USING (vec_id)""")
def point_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Candidate pairs of points within an object, from nested arrays without a join."""
    v = F.col("vec_id")
    ints = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    r = F.transform(ints(3), lambda i: F.array(((i * 3 + v) % 10).cast("int"), i.cast("int")))
    s = F.transform(ints(2), lambda j: F.array(((j * 7 + v) % 10).cast("int"), j.cast("int")))
    pairs = F.flatten(F.transform(r, lambda a, i: F.transform(s, lambda b, j: F.struct(i.alias("r"), j.alias("s"), F.round(objectmap.distance(a, b), 6).alias("distance")))))
    return table(spark, d, "embeddings").select("vec_id", F.explode(pairs).alias("e")).select("vec_id", "e.r", "e.s", "e.distance")


@query("""SELECT event_id, round(3.0::DOUBLE * 2.0::DOUBLE ** (event_id % 5) * (1 + (user_id % 10) / 100.0::DOUBLE), 6) AS delay, event_type AS query, 'gold' AS choice FROM events""")
def retry_delays(spark: SparkSession, d: str) -> DataFrame:
    """Back-off delays of retries, beside a single-choice prompt row."""
    e = _events(spark, d)
    prompt = prompts.single_choice(F.col("event_type"), F.lit("gold"))
    return e.select("event_id", F.round(frames.backoff_delay(F.col("event_id") % 5, spread=(F.col("user_id") % 10) / F.lit(10.0)), 6).alias("delay"), prompt["query"].alias("query"), F.element_at(prompt["choices"], prompt["gold_index"] + 1).alias("choice"))


@query(f"""WITH {_VSI_SQL} SELECT count(CASE WHEN task IN {_CHOICE} THEN 1 END) AS n_choice, count(CASE WHEN task IN {_NUMBER} THEN 1 END) AS n_number, round(avg(CASE WHEN task IN {_NUMBER} THEN video_duration END), 6) AS mean_duration, max(video_duration) AS longest FROM vsi""")
def family_aggregates(spark: SparkSession, d: str) -> DataFrame:
    """Aggregates of task families in one pass, by condition instead of by filter."""
    t = F.col("task")
    return _vsi(spark, d).agg(F.count(F.when(t.isin(reports.VSI_CHOICE), 1)).alias("n_choice"), F.count(F.when(t.isin(reports.VSI_NUMBER), 1)).alias("n_number"), F.round(F.avg(F.when(t.isin(reports.VSI_NUMBER), F.col("video_duration"))), 6).alias("mean_duration"), F.max("video_duration").alias("longest"))
