"""Extraction and normalisation of answer texts as column expressions, all evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .binding import let

# Number words in the order in which they are looked for, with their digits.
NUMBER_WORDS = [
    ("one", "1"), ("two", "2"), ("three", "3"), ("four", "4"), ("five", "5"), ("six", "6"), ("seven", "7"), ("eight", "8"), ("nine", "9"), ("ten", "10"),
    ("eleven", "11"), ("twelve", "12"), ("thirteen", "13"), ("fourteen", "14"), ("fifteen", "15"), ("sixteen", "16"), ("seventeen", "17"), ("eighteen", "18"), ("nineteen", "19"), ("twenty", "20"),
    ("thirty", "30"), ("forty", "40"), ("fifty", "50"), ("sixty", "60"), ("seventy", "70"), ("eighty", "80"), ("ninety", "90"), ("zero", "0"), ("a", "1"), ("an", "1"),
]
# Lead-ins that are removed, in this order, before an option letter is looked for; the last two only with four options.
ANSWER_PREFIXES = [
    "The best answer is", "The correct answer is", "The answer is", "The answer", "The best option is", "The correct option is",
    "Best answer:", "Best option:", "Answer:", "Option:", "The correct answer", "The correct option",
]
# The same lead-ins as one benchmark has them, two pairs of them run together.
FUSED_PREFIXES = [
    "The best answer is", "The correct answer is", "The answer is", "The answer", "The best option isThe correct option is",
    "Best answer:Best option:", "Answer:", "Option:", "The correct answer", "The correct option",
]
# Phrasings of an option, tried in this order without regard to case, line by line.
OPTION_PATTERNS = [
    r"\(([A-E])\)",
    r"Ans\s*=\s*['\"]?([A-E])['\"]?",
    r"Answer\s*[:=]\s*([A-E])",
    r"Option\s+([A-E])",
    r"\b([A-E])\s*(?:is|was)\s*correct",
    r"\b([A-E])[\.\)]\s*$",
]

# Fixed value: an element of a point, in brackets of any kind.
ELEMENT = r"^[<\[(]*(-?\d+(?:\.\d+)?)[>\])]*$"

_BLANK = r"^\s+|\s+$"


def strip(c: Column) -> Column:
    """All white space at both ends."""
    return F.regexp_replace(c, _BLANK, "")


def tag_body(c: Column, tag: str, default: str) -> Column:
    """The first body of a tag, stripped, over line ends; `default` without the tag; null for null."""
    pattern = f"(?s)<{tag}>(.*?)</{tag}>"
    return F.when(c.rlike(pattern), strip(F.regexp_extract(c, pattern, 1))).when(c.isNotNull(), default)


def extract_answer_text(c: Column) -> Column:
    return tag_body(c, "answer", "None")


def extract_answer(c: Column) -> Column:
    return tag_body(c, "answer", "")


def extract_map_text(c: Column) -> Column:
    return tag_body(c, "map", "")


def guarded_answer(c: Column, mode_ok: bool) -> Column:
    """The answer tag's body only in a thinking mode and where the tag opens, else the text as it is."""
    return F.when(F.lit(mode_ok) & F.contains(c, F.lit("<answer>")), extract_answer_text(c)).otherwise(c)


def number_word_or_digits(c: Column) -> Column:
    """The first listed number word found as a word, else the first unsigned number, else "None"."""
    words = F.array(*(F.lit(w) for w, _ in NUMBER_WORDS))
    digits = F.array(*(F.lit(d) for _, d in NUMBER_WORDS))
    pattern = rf"\b({'|'.join(w for w, _ in NUMBER_WORDS)})\b"

    def read(low: Column) -> Column:
        first = F.array_min(F.transform(F.regexp_extract_all(low, F.lit(pattern), F.lit(1)), lambda w: F.array_position(words, w)))
        found = F.nullif(F.regexp_extract(low, r"(\d+(?:\.\d+)?)", 1), F.lit(""))
        return F.coalesce(F.try_element_at(digits, first.cast("int")), found, F.when(low.isNotNull(), "None"))

    return let(strip(F.lower(c)), read)


def option_letter(c: Column) -> Column:
    """A leading A-D with at most a full stop, as the first word, else the stripped text."""
    def read(t: Column) -> Column:
        return let(strip(F.substring_index(t, " ", 1)), lambda first: F.when(first.rlike(r"\A[A-D]\.?\z"), F.substring(first, 1, 1)).otherwise(strip(t)))

    return let(c, read)


def normalized_option(c: Column) -> Column:
    """An option letter by phrasing: (X), Ans='X', Answer: X, Option X, X is correct, trailing X. or X), upper-cased; null if none."""
    return let(c, lambda t: F.coalesce(*(F.nullif(F.upper(F.regexp_extract(t, f"(?im){p}", 1)), F.lit("")) for p in OPTION_PATTERNS)))


def normalized_or_stripped(c: Column) -> Column:
    return F.coalesce(normalized_option(c), strip(c))


def first_letter(c: Column, letters: str = "ABCD", prefixes: list[str] | None = None) -> Column:
    """Lead-ins (by default those that go with the letters) removed anywhere; "" if more than ten words hold no letter; else the first letter found anywhere, or ""."""
    s = strip(c)
    for p in prefixes or (ANSWER_PREFIXES if letters == "ABCD" else ANSWER_PREFIXES[:10]):
        s = F.replace(s, F.lit(p), F.lit(""))
    # beyond ten words without a letter the answer is "" as well, so the first letter found says it all
    return F.regexp_extract(s, f"([{letters}])", 1)


def number_in(c: Column, last: Column | bool) -> Column:
    """The last (or first) unsigned number not right after `^`; -1 for no last one, null for no first one."""
    take = F.lit(last) if isinstance(last, bool) else last

    def read(found: Column) -> Column:
        end = F.coalesce(F.try_element_at(found, F.lit(-1)), F.when(found.isNotNull(), "-1"))
        return F.when(take, end).otherwise(F.try_element_at(found, F.lit(1)))

    return let(F.regexp_extract_all(c, F.lit(r"(?<!\^)\d+\.\d+|(?<!\^)\d+"), F.lit(0)), read).try_cast("double")


_FLOAT = r"\A\s*[+-]?(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+(?:_\d+)*)?\s*\z"


def to_float(c: Column) -> Column:
    """A number in plain, decimal or exponent notation, null for anything else."""
    return let(c, lambda t: F.when(t.rlike(_FLOAT), F.replace(strip(t), F.lit("_"), F.lit("")).try_cast("double")))


def normalized_number(c: Column) -> Column:
    return to_float(F.replace(c, F.lit(","), F.lit("")))


def file_stem(c: Column) -> Column:
    """The base name without its last extension; a leading dot is no extension."""
    return F.regexp_replace(F.substring_index(c, "/", -1), r"(?<=.)\.[^.]*$", "")


def first_token(c: Column) -> Column:
    """The first word without trailing full stops."""
    return F.regexp_replace(F.get(F.split(c, " "), F.lit(0)), r"\.+$", "")


def parse_instruction(c: Column) -> Column:
    """"k:v,k:v" as a map of doubles, the last of equal keys winning; null if any item is malformed."""
    def item(x: Column, i: Column) -> Column:
        return let(F.split(x, ":"), lambda p: F.struct(F.get(p, F.lit(0)).alias("k"), F.when(F.size(p) == 2, to_float(F.get(p, F.lit(1)))).alias("v"), i.alias("i")))

    def build(items: Column) -> Column:
        last = F.filter(items, lambda s: ~F.exists(items, lambda o: (o["k"] == s["k"]) & (o["i"] > s["i"])))
        good = F.forall(items, lambda s: s["v"].isNotNull())
        return F.when(good, F.map_from_entries(F.transform(last, lambda s: F.struct(s["k"], s["v"]))))

    return let(F.transform(F.split(c, ","), item), build)


def coordinate_and_depth(c: Column) -> Column:
    """(x, y) and a number from text such as "(12,30), 4.5"; a missing half is zero."""
    xy = F.regexp_extract_all(c, F.lit(r"\(\s*(-?\d+(?:\.\d+)?)\s*,\s*(-?\d+(?:\.\d+)?)\s*\)"), F.lit(0))
    pair = F.regexp_extract_all(F.coalesce(F.get(xy, F.lit(0)), F.lit("")), F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0))
    rest = F.regexp_extract_all(F.regexp_replace(c, r"\([^)]*\)", " "), F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0))
    part = lambda a, i: F.coalesce(F.get(a, F.lit(i)).try_cast("double"), F.lit(0.0))
    return F.when(c.isNotNull(), F.struct(part(pair, 0).alias("x"), part(pair, 1).alias("y"), part(rest, 0).alias("depth")))


def yes_no(c: Column) -> Column:
    """`yes` or `no` by the text's beginning, else null."""
    low = F.lower(strip(c))
    return F.when(low.startswith("yes"), "yes").when(low.startswith("no"), "no")


def without_answer_mark(c: Column) -> Column:
    return F.replace(c, F.lit("Answer:"), F.lit(""))


def split_reasoning(c: Column) -> Column:
    """A raw response as problem, reasoning and final answer.

    The problem is what precedes the first <think>, without a leading `Question:` and trailing `Answer:`; all
    closed think bodies are joined by a blank; the final answer follows the last <answer>, without a leading `Answer:`.
    """
    parts = F.split(c, "<think>")
    problem = strip(F.regexp_replace(F.regexp_replace(strip(F.get(parts, F.lit(0))), r"^Question:", ""), r"Answer:\s*$", ""))
    closed = F.filter(F.slice(parts, F.lit(2), F.size(parts)), lambda p: F.contains(p, F.lit("</think>")))
    thinking = F.array_join(F.transform(closed, lambda p: strip(F.substring_index(p, "</think>", 1))), " ")
    tail = F.element_at(F.split(c, "<answer>"), -1)
    answer = F.regexp_replace(strip(F.substring_index(tail, "</answer>", 1)), r"^Answer:\s*", "")
    return F.struct(problem.alias("problem"), thinking.alias("thinking"), F.when(F.contains(c, F.lit("<answer>")), answer).alias("answer"))


def has_empty_tags(c: Column) -> Column:
    return c.rlike(r"<[^>]+></[^>]+>")


def format_time(sec: Column) -> Column:
    """HHhMMmSSs of seconds within a day."""
    s = F.pmod(F.floor(sec), F.lit(86400))
    return F.format_string("%02dh%02dm%02ds", F.floor(s / 3600).cast("int"), F.floor(F.pmod(s, F.lit(3600)) / 60).cast("int"), F.pmod(s, F.lit(60)).cast("int"))


def data_url(c: Column, kind: str = "image") -> Column:
    return F.concat(F.lit(f"data:{kind};base64,"), F.base64(c))


def number_of(c: Column) -> Column:
    """A coordinate element freed of brackets, as a number."""
    return F.regexp_extract(c, ELEMENT, 1).try_cast("double")


def run_directory(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd_HHmmss")
