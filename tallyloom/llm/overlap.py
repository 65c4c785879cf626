"""Same or near-same records across splits: evaluation questions that also occur in training.

Method: the passages of each normalised evaluation question are its pairs of neighbouring words and its rarest word. They are
sharded by video; per shard one Aho-Corasick automaton of them scans every training text of the shard's videos, after
slips of the pen are read as the evaluation word nearest to them. Matched intervals are merged into the coverage of
an evaluation record, the share of its words inside them. A record covered to MIN_COVERAGE or more overlaps if a check
of the words holds: the training text has all its words in order and at most MAX_EXTRA others, none of which asks for anything.

Both sides are first reduced to distinct (video, normalised question), so copies are compared once. Shards have a
bounded number of texts: small videos share one, a large video is split on both sides, each part of its evaluation
texts meeting each part of its training texts. What a word is, known or a slip, is decided by its video alone, so no verdict depends on
the sharding. Members are joined back by (video, normalised question).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut
from .joins import join_per_key

#: Distinct texts of a video per shard and side; beyond it, the side is split.
SHARD_TEXTS = 20_000
#: Texts of small videos per shard; shards per shuffle partition at least.
GROUP_TEXTS, SHARDS = 100_000, 1
#: Share of an evaluation record's words that matched passages must cover.
MIN_COVERAGE = 0.6
#: At most so many words of a training text may lie outside what it covers.
MAX_EXTRA = 3

# Words that carry no content of a question, and names of units.
_EMPTY = frozenset(
    "the this that these those a an please kindly could can would will should may i you me we us tell say answer following question q is are was were do does did be been has have had"
    " of to in on at for by with as it its there here based video clip watch look see according given now then so and or measured expressed counted unit units stated nearest frage bitte der die das den dem des ein eine ist sind im in von zu".split()
)
_UNITS = {
    "m": "m meter meters metre metres metern", "cm": "cm centimeter centimeters centimetre centimetres zentimeter zentimetern", "mm": "mm millimeter millimeters millimetre millimetres",
    "inch": "inch inches", "ft": "ft feet foot", "yd": "yd yds yard yards", "s": "s sec secs second seconds sekunden", "ms": "ms millisecond milliseconds", "min": "min mins minute minutes", "h": "h hr hour hours",
    "sqm": "sqm m² m2 quadratmeter quadratmetern", "sqft": "sqft ft² ft2 sf", "sqyd": "sqyd yd² yd2", "sqcm": "sqcm cm² cm2",
}
_UNIT_OF = {w: f"[{k}]" for k, v in _UNITS.items() for w in v.split()}
_WORD = re.compile(r"[^\W_]+[²]?")
_OPTIONS = re.compile(r"\n\s*(?:options|choices|optionen)\s*:.*", re.S | re.I)
_SQUARE = re.compile(r"\b(?:square|sq\.?)\s+(m|ft|cm|yd|meter|metre|feet|foot|yard|centimet)\w*", re.I)
_HALF_RANK = re.compile(r"\b(first|second)\s+half\b")


def _singular(w: str) -> str:
    return w[:-1] if len(w) > 3 and w[-1] == "s" and w[-2] != "s" else w


@lru_cache(maxsize=100_000)
def canonical(text: str | None) -> str:
    """The content words of a question, in order, units under one name and plurals without their s."""
    if not text:
        return ""
    s = text.lower()
    s = _OPTIONS.sub("", s) if "\n" in s else s
    s = _SQUARE.sub(lambda m: {"m": "sqm", "f": "sqft", "c": "sqcm", "y": "sqyd"}[m.group(1)[0]], s) if "sq" in s else s
    s = _HALF_RANK.sub(r"\1half", s) if "half" in s else s
    return " ".join(_UNIT_OF.get(w) or _singular(w) for w in _WORD.findall(s) if w not in _EMPTY)


_QUERY = re.compile(r"[?#].*", re.S)
_ESCAPES = re.compile(r"%5f|%20|%2d|(%2f|%5c|\\)")
_SUFFIX = re.compile(r"\.[a-z][a-z0-9]{1,4}$")
_JOINT = re.compile(r"([a-z])([0-9])")
_APART = re.compile(r"[^a-z0-9]+")
_ENCODED = re.compile(r"(?:_(?:[0-9]{3,4}_?p|[hx]_?26[45]|hevc|av_?1|hd|sd|lowres|hires|copy|compressed|reencoded|re_encoded|transcoded|[0-9]+_?fps|[0-9]+_?k|small|web))+$")


@lru_cache(maxsize=100_000)
def clip_key(path: str | None) -> str:
    """Scene or clip name of a path, whatever its folder, file type, re-encoding suffix or spelling: letters and numbers joined by `_`; '' for none."""
    if not path:
        return ""
    s = _ESCAPES.sub(lambda m: "/" if m.group(1) else "_", _QUERY.sub("", path.strip().lower()))
    s = _SUFFIX.sub("", s.rstrip("/").rpartition("/")[2].strip())
    return _ENCODED.sub("", _APART.sub("_", _JOINT.sub(r"\1_\2", s)).strip("_"))


@lru_cache(maxsize=100_000)
def _deletes(w: str, n: int = 1) -> frozenset[str]:
    out = frozenset(w[:i] + w[i + 1 :] for i in range(len(w)))
    return out if n == 1 else out.union(*(_deletes.__wrapped__(x) for x in out))


def edits(a: str, b: str) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours between two words."""
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            best = min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, older[j - 2] + 1)
            row.append(best)
    return row[-1]


class Speller:
    """Reads a slip of the pen as the known word nearest to it: one edit away, two in words of LONG letters with the same first one.

    A word too frequent beside the known one to be a slip is left as it is.
    """

    LONG = 6

    def __init__(self, known: set[str], seen: Counter[str]) -> None:
        self.known, self.seen, self.index, self.memo = known, seen, {}, {}
        for w in known:
            if len(w) >= 4 and w[0] != "[" and not any(c.isdigit() for c in w):
                for d in (w, *_deletes(w, 2 if len(w) >= self.LONG else 1)):
                    self.index.setdefault(d, []).append(w)

    def __call__(self, w: str) -> str:
        if w in self.known or len(w) < 3 or w[0] == "[" or any(c.isdigit() for c in w):
            return w
        if w not in self.memo:
            long = len(w) >= self.LONG
            near = {k for d in (w, *_deletes(w, 2 if long else 1)) for k in self.index.get(d, ())}
            ranked = sorted((e, k) for k in near if (e := edits(w, k)) <= (2 if long and k[0] == w[0] else 1))
            ranked = [k for e, k in ranked if not (self.seen[w] >= 3 and self.seen[w] >= (0.2 if e == 1 else 0.05) * self.seen[k])]
            self.memo[w] = ranked[0] if ranked else w
        return self.memo[w]


class Video:
    """What the evaluation texts of a video are looked up by: the words of each, listed under its rarest one."""

    def __init__(self) -> None:
        self.texts: dict[str, list[str]] = {}
        self.known: set[str] = set()
        self.seen: Counter[str] = Counter()
        self.by_anchor: dict[str, list[str]] = {}
        self.speller: Speller | None = None

    def prepare(self) -> Iterator[str]:
        """Sets anchors and speller; gives the passages."""
        count = Counter(w for words in self.texts.values() for w in set(words))
        for text, words in self.texts.items():
            anchor = min(words, key=lambda w: (count[w], w))
            self.by_anchor.setdefault(f" {anchor} ", []).append(text)
            yield f" {anchor} "
            yield from _passages(words)
        self.speller = Speller(self.known, self.seen)


def _passages(words: list[str]) -> list[str]:
    return [f" {x} {y} " for x, y in zip(words, words[1:])] or [f" {words[0]} "]


def coverage(words: list[str], matched: set[str]) -> float:
    """Share of words inside the merged intervals of the matched passages."""
    inside, to = 0, 0
    for i, p in enumerate(_passages(words)):
        if p in matched:
            end = min(i + 2, len(words))
            inside += end - max(i, to)
            to = end
    return inside / len(words)


def in_order(words: list[str], among: list[str]) -> bool:
    rest = iter(among)
    return all(w in rest for w in words)


def match_shard(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Evaluation (clip, text) against training (clip, text) of one shard: (clip, eval_text, train_text, coverage).

    Rows of `left` with an `n` are no texts but the words of a split video: n is 0 or more for words of its training texts, -1 for evaluation words.
    """
    columns = ["clip", "eval_text", "train_text", "coverage"]
    if not len(left) or not len(right):
        return pd.DataFrame(columns=columns)
    videos: dict[str, Video] = {}
    split = set()
    for clip, text, n in zip(left["clip"], left["text"], left["n"] if "n" in left else [None] * len(left)):
        video = videos.setdefault(clip, Video())
        if n is None or n != n:
            video.texts[text] = text.split()
            video.known.update(video.texts[text])
        else:
            split.add(clip)
            if n < 0:
                video.known.add(text)
            else:
                video.seen[text] = int(n)
    of_clip: dict[str, list[str]] = {}
    for clip, text in zip(right["clip"], right["text"]):
        if clip in videos:
            of_clip.setdefault(clip, []).append(text)
            if clip not in split:
                videos[clip].seen.update(text.split())
    automaton = ahocorasick.Automaton()
    for clip in of_clip:
        for passage in videos[clip].prepare():
            automaton.add_word(passage, passage)
    if not len(automaton):
        return pd.DataFrame(columns=columns)
    automaton.make_automaton()
    out = []
    for clip, texts in of_clip.items():
        video = videos[clip]
        for text in texts:
            words = [video.speller(w) for w in text.split()]
            matched = {passage for _, passage in automaton.iter(f" {' '.join(words)} ")}
            for anchor in matched & video.by_anchor.keys():
                for asked in video.by_anchor[anchor]:
                    own = video.texts[asked]
                    if len(words) - len(own) > MAX_EXTRA or (c := coverage(own, matched)) < MIN_COVERAGE or not in_order(own, words):
                        continue
                    extra = Counter(words)
                    extra.subtract(own)
                    if not any(w in video.known or w[0] == "[" or w.isdigit() for w in (+extra)):
                        out.append((clip, asked, text, c))
    return pd.DataFrame(out, columns=columns)


def _normalised(df: DataFrame, *ids: str) -> DataFrame:
    """(*ids, clip, text) of the rows that have an id, a clip name and a question with content words."""
    types = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            clips = [clip_key(x) for x in b.column("clip").to_pylist()]
            texts = [canonical(x) for x in b.column("text").to_pylist()]
            keep = pa.array([i for i, (c, t) in enumerate(zip(clips, texts)) if c and t], pa.int64())
            columns = [*(b.column(i) for i in ids), pa.array(clips, pa.string()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([x.take(keep) for x in columns], names=[*ids, "clip", "text"])

    schema = ", ".join(f"{c} {types[c]}" for c in ids) + ", clip string, text string"
    return df.where(F.col(ids[-1]).isNotNull() & F.col("clip").isNotNull() & F.col("text").isNotNull()).select(*ids, "clip", "text").mapInArrow(run, schema)


def overlapping_texts(e: DataFrame, t: DataFrame) -> DataFrame:
    """(clip, eval_text, train_text, coverage) of the distinct texts that overlap, given normalised (clip, text) of both sides."""
    e_texts, t_texts = e.select("clip", "text").distinct(), t.select("clip", "text").distinct()
    count = lambda df, name: df.groupBy("clip").agg(F.count("*").alias(name))
    per = cut(count(t_texts, "n_t").join(count(e_texts, "n_e"), "clip"))
    groups = int(e.sparkSession.conf.get("spark.sql.shuffle.partitions")) * SHARDS
    total = per.agg(F.coalesce(F.sum(F.col("n_t") + F.col("n_e")), F.lit(0))).first()[0]
    groups = max(groups, math.ceil(total / GROUP_TEXTS))
    parts = lambda n: F.ceil(F.col(n) / SHARD_TEXTS).cast("int")
    large = cut(per.where((F.col("n_t") > SHARD_TEXTS) | (F.col("n_e") > SHARD_TEXTS)).select("clip", parts("n_t").alias("k_t"), parts("n_e").alias("k_e")))
    def placed(texts: DataFrame, own: str, other: str) -> DataFrame:
        """A text of a large video goes to the part that its hash says, against every part of the other side."""
        known = join_per_key(texts, large, ["clip"], "left", kept=True)
        mine = F.pmod(F.xxhash64("text"), F.coalesce(own, F.lit(1))).cast("int").alias(own[-1])
        all_of = F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)).alias(other[-1])
        shard = F.when(F.col(own).isNotNull(), F.col("clip")).otherwise(F.pmod(F.xxhash64("clip"), F.lit(groups)).cast("string"))
        return known.select("clip", "text", "n", shard.alias("shard"), mine, all_of)

    none = F.lit(None).cast("bigint")
    words = lambda df, n: join_per_key(df, large, ["clip"], kept=True).select("clip", F.explode(F.split("text", " ")).alias("text")).groupBy("clip", "text").agg(n.alias("n"))
    of_large = words(t_texts, F.count("*")).unionByName(words(e_texts, F.lit(-1).cast("bigint"))).join(large, "clip")
    every = F.explode(F.expr("flatten(transform(sequence(0, k_t - 1), x -> transform(sequence(0, k_e - 1), y -> struct(x AS t, y AS e))))")).alias("at")
    of_large = of_large.select("clip", "text", "n", F.col("clip").alias("shard"), every).select("clip", "text", "n", "shard", "at.e", "at.t")
    left = placed(e_texts.withColumn("n", none), "k_e", "k_t").unionByName(of_large)
    right = placed(t_texts.withColumn("n", none), "k_t", "k_e").drop("n")
    keys = ["shard", "e", "t"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(match_shard, "clip string, eval_text string, train_text string, coverage double")


def _sides(evals: DataFrame, training: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides normalised once; of training only what shows a video of the evaluation splits."""
    e = cut(_normalised(evals, "tab", "eval_id").distinct())
    clips = e.select("clip").distinct()
    return e, cut(join_per_key(_normalised(training, "data_source", "problem_id"), clips, ["clip"], "left_semi").distinct())


def find_overlaps(evals: DataFrame, training: DataFrame) -> DataFrame:
    """Pairs (tab, eval_id, problem_id, data_source, coverage).

    evals: (tab, eval_id bigint, clip string, text string), one row per text under which a record is known;
    training: (problem_id bigint, clip string, text string, data_source string). Rows with a null id, clip or
    text, or a text without content words match nothing; repeated rows give one pair. Empty tables give an
    empty result; further columns are ignored.
    """
    e, t = _sides(evals, training)
    hits = overlapping_texts(e, t)
    pairs = hits.join(e.withColumnRenamed("text", "eval_text"), ["clip", "eval_text"]).join(t.withColumnRenamed("text", "train_text"), ["clip", "train_text"])
    return pairs.groupBy("tab", "eval_id", "problem_id").agg(F.max("data_source").alias("data_source"), F.max("coverage").alias("coverage"))


def overlap_classes(evals: DataFrame, training: DataFrame) -> DataFrame:
    """One row per overlapping pair of texts, whatever the number of their copies: (tab, eval_id, problem_id, n_eval, n_train, coverage), the ids those of the class representatives, its least members."""
    e, t = _sides(evals, training)
    e_class = e.groupBy("clip", F.col("text").alias("eval_text")).agg(F.min(F.struct("tab", "eval_id")).alias("first"), F.count("*").alias("n_eval"))
    t_class = t.groupBy("clip", F.col("text").alias("train_text")).agg(F.min("problem_id").alias("problem_id"), F.countDistinct("problem_id").alias("n_train"))
    return overlapping_texts(e, t).join(e_class, ["clip", "eval_text"]).join(t_class, ["clip", "train_text"]).select("first.tab", "first.eval_id", "problem_id", "n_eval", "n_train", F.round("coverage", 6).alias("coverage"))
