"""Prompts and conversations as nested columns; templates are data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MULTIPLE_CHOICE = "multiple choice"


def options_block(problem: Column, options: Column, problem_type: Column) -> Column:
    """The problem with its options below `Options:`, one per line, for multiple choice; else the problem alone."""
    block = F.concat(problem, F.lit("Options:\n"), F.array_join(F.transform(options, lambda x: F.concat(x, F.lit("\n"))), ""))
    return F.when((problem_type == MULTIPLE_CHOICE) & options.isNotNull(), block).otherwise(problem)


def options_suffix(options: Column) -> Column:
    return F.when(F.size(options) > 0, F.concat(F.lit("\nOptions:\n"), F.array_join(options, "\n"))).otherwise("")


def lettered(options: Column) -> Column:
    """`A. text` lines in order."""
    return F.array_join(F.transform(options, lambda x, i: F.concat(F.chr(i + 65), F.lit(". "), x, F.lit("\n"))), "")


def keyed(options: Column) -> Column:
    """`key text` lines of a map, in its order."""
    return F.array_join(F.transform(F.map_entries(options), lambda e: F.concat_ws(" ", e["key"], e["value"])), "\n")


def time_range(question: Column, start: Column, end: Column) -> Column:
    return F.concat(F.lit("From "), start.cast("string"), F.lit(" seconds to "), end.cast("string"), F.lit(" seconds. "), question)


def ranged_question(question: Column, start: Column, end: Column, candidates: Column) -> Column:
    """A question on a stretch of a video with its keyed candidates below."""
    return F.concat(time_range(question, start, end), F.lit("\n"), keyed(candidates))


def answer_letter(index: Column) -> Column:
    return F.chr(index + 65)


def max_tokens(prompt_type: Column) -> Column:
    return F.when(prompt_type == "default", 128).otherwise(1024)


def filled(template: Column, **values: Column) -> Column:
    """A template with its {name} places filled."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def with_template(rows: DataFrame, templates: dict[str, str], kind: str, fallback: str, strict: bool = False) -> DataFrame:
    """`template` by the row's prompt kind, the fallback's for unknown kinds, or an error if strict: a map literal, no join."""
    return rows.withColumn("template", _looked_up(templates, F.col(kind), None if strict else templates[fallback]))


def _looked_up(values: dict[str, str], key: Column, default: str | None) -> Column:
    known = F.create_map(*(F.lit(x) for pair in values.items() for x in pair))
    missing = F.raise_error(F.concat(F.lit("unknown prompt kind: "), F.coalesce(key, F.lit("null")))).cast("string") if default is None else F.lit(default)
    return F.coalesce(F.try_element_at(known, key), missing)


def typed_prompt(question: Column, problem_type: Column, template: str, suffixes: dict[str, str], strict: bool = False) -> Column:
    """The template with its {Question}, and behind it what the problem type asks for; without an entry nothing, or an error if strict."""
    return F.concat(filled(F.lit(template), Question=question), _looked_up(suffixes, problem_type, None if strict else ""))


def task_prompt(question: Column, task: Column, number: list[str], choice: list[str], special: list[str], pre: str, suffixes: dict[str, str], note: str, noted: list[str]) -> Column:
    """Lead-in, question and what the task's family asks for, line by line; choice tasks have a line for a note, empty but for the `noted`. An unknown task raises."""
    line = lambda *parts: F.concat_ws("\n", F.lit(pre), question, *parts)
    return (
        F.when(task.isin(number), line(F.lit(suffixes["number"])))
        .when(task.isin(choice), line(F.when(task.isin(noted), note).otherwise(""), F.lit(suffixes["choice"])))
        .when(task.isin(special), line(F.lit(""), F.lit("")))
        .when(task.isNotNull(), F.raise_error(F.concat(F.lit("unknown task: "), task)))
    )


def listed(names: Column) -> Column:
    """Names as a bracketed list in quotes: single ones, double ones around a name that holds a single one."""
    quoted = F.transform(names, lambda n: F.when(F.contains(n, F.lit("'")), F.concat(F.lit('"'), n, F.lit('"'))).otherwise(F.concat(F.lit("'"), n, F.lit("'"))))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def map_aware(question: Column, cognitive_map: Column, data_source: Column, problem_type: Column, plain: str, mapped: str, suffixes: dict[str, str], example: str, source: str = "SR_dataset") -> Column:
    """A prompt that asks rows of the mapped source for an object map too.

    Its template has {Question}, {object_list} and {map_example}; the names are those of the row's map. A row of
    that source without a map has no prompt.
    """
    suffix = _looked_up(suffixes, problem_type, "")
    with_map = filled(F.lit(mapped), Question=question, object_list=listed(F.map_keys(cognitive_map)), map_example=F.lit(example))
    return F.concat(F.when(data_source == source, with_map).otherwise(filled(F.lit(plain), Question=question)), suffix)


def single_choice(problem: Column, solution: Column) -> Column:
    """(query, choices, gold_index): a prompt whose only choice is its solution."""
    return F.struct(problem.alias("query"), F.array(solution).alias("choices"), F.lit(0).alias("gold_index"))


def _part(kind: Column, text: Column | None = None, media: Column | None = None) -> Column:
    null = F.lit(None).cast("string")
    media = null if media is None else media
    return F.struct(
        kind.alias("type"), (null if text is None else text).alias("text"),
        F.when(kind == "image", media).alias("image"), F.when(kind == "image_url", media).alias("image_url"), F.when(kind == "video", media).alias("video"),
    )


def user_message(data_type: Column, path: Column, question: Column) -> Column:
    """One user turn: the medium and the question."""
    content = F.array(_part(data_type, media=path), _part(F.lit("text"), text=question))
    return F.array(F.struct(F.lit("user").alias("role"), content.alias("content")))


def plain_messages(system: str, problem: Column) -> Column:
    """A system turn and a user turn of text alone."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(turn("system", F.lit(system)), turn("user", problem))


def sft_messages(system: str, data_type: Column, path: Column, question: Column, answer: Column) -> Column:
    turn = lambda role, *parts: F.struct(F.lit(role).alias("role"), F.array(*parts).alias("content"))
    return F.array(
        turn("system", _part(F.lit("text"), text=F.lit(system))),
        turn("user", _part(data_type, media=path), _part(F.lit("text"), text=question)),
        turn("assistant", _part(F.lit("text"), text=answer)),
    )


def without_nulls(messages: Column) -> Column:
    """Messages as JSON, null fields left out."""
    return F.to_json(messages)


def vision_parts(messages: Column) -> Column:
    """The parts of a conversation that hold an image, an image's address or a video, or are of such a type, in order."""
    parts = F.flatten(F.transform(messages, lambda m: m["content"]))
    return F.filter(parts, lambda p: p["image"].isNotNull() | p["image_url"].isNotNull() | p["video"].isNotNull() | p["type"].isin("image", "image_url", "video"))


def vision_parts_of_all(conversations: Column) -> Column:
    """The same over several conversations, one after the other."""
    return vision_parts(F.flatten(conversations))


def media_kind(path: Column) -> Column:
    """Where an image comes from: data URL, http(s), file URL or a plain path."""
    return F.when(path.rlike("^data:image"), "data_url").when(path.rlike("^https?://"), "http").when(path.rlike("^file://"), "file_url").when(path.isNotNull(), "path")
