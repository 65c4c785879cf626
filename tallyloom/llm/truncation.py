"""Text cut off by field limits: find values that end before their text is complete.

Method: prefix self-join. The last sentence of every value that nothing closes (its tail) is looked up among
the sentences of all values: how often is it a strict prefix of a longer one, how often does a sentence end
with it. A value that is a strict prefix of a longer copy has such a tail, so whole values need no join of their
own. The tail's last three, two and one words are looked up likewise among all windows of three words,
for sentences that no other value repeats; the last word of a tail may be broken off anywhere. All these strings
are hashed by a fixed-length prefix, each bucket is sorted, and one linear sweep counts.

From the counts comes the share of ends: the share of a single word's ends is the prior of two
words, theirs of three, theirs of the whole sentence (additive smoothing). Below MAX_ENDS the tail is cut. Where no
string decides, the value alone may: it ends inside a character, entity, tag, bracket or block, or has the length at which its
run's values pile up. Every find says what decided: sentence, words, word, structure or limit.

Cost: one Arrow pass over the texts (no shuffle of texts), then a shuffle of counts per distinct sentence and
window, combined per batch of sentences before it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut
from . import textstate as ts
from .joins import join_per_key

#: A string's bucket is chosen by this many leading characters.
PREFIX = 8
#: A bucket of more strings than HOT is split by so many leading characters into so many parts.
HOT, LONG_PREFIX, PARTS = 500_000, 24, 64
#: A tail is cut if its strings end with it in less than this share.
MAX_ENDS = 0.02
#: Weight of the shorter string's share in a longer one's; the share of ends of a string never seen.
SMOOTHING, UNSEEN = 3.0, 0.5
#: A tail repeated so often that no sentence continues is a whole answer, unless its last word is one of the language's most frequent, above this share of all words.
COPIES, FREQUENT = 5, 0.01
#: A length is a field limit if it is a run's largest, so many values of it differ, and it is so many times as frequent as those of its upper half.
LIMIT_MIN, LIMIT_TIMES = 5, 4.0
FLUSH = 100_000

_SCHEMA = "kind string, tab string, row_id bigint, run string, s string, w string, a bigint, b bigint, strings array<string>, counts array<bigint>"
_ARROW = {"string": pa.string(), "bigint": pa.int64(), "array<string>": pa.list_(pa.string()), "array<bigint>": pa.list_(pa.int64())}
_TYPES = {name: _ARROW[kind] for name, kind in map(str.split, _SCHEMA.split(", "))}
#: Strings per row of counts.
PACK = 5_000


def _batch(n: int, **columns: list) -> pa.RecordBatch:
    """Rows of _SCHEMA; a column left out is null."""
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in _TYPES.items()], names=list(_TYPES))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return _batch(len(rows), **dict(zip(_TYPES, map(list, zip(*rows)))))


def scan(batches: Iterator[pa.RecordBatch], further: Callable[[dict[str, list]], list[tuple]] | None = None) -> Iterator[pa.RecordBatch]:
    """Rows: `tail` (a row with an open tail s, of length a; b adds 1 for an item list and 2 for a structural cut), `str` counts in packs, `len` counts with masks of hashes, and what `further` gives."""
    tally, lengths = ts.Tally(), {}

    def flush() -> Iterator[pa.RecordBatch]:
        found = tally.strings()
        texts, counts = list(found), list(found.values())
        packs = [(texts[i : i + PACK], counts[i : i + PACK]) for i in range(0, len(texts), PACK)]
        if packs:
            yield _batch(len(packs), kind=["str"] * len(packs), strings=[t for t, _ in packs], counts=[n for _, n in packs])
        if lengths:
            yield _rows([("len", t, m, r, None, None, k, n) for (t, r, k), (n, m) in lengths.items()])

    for batch in batches:
        columns = {c: batch.column(c).to_pylist() for c in batch.schema.names}
        out = further(columns) if further else []
        for tab, row_id, run, text in zip(columns["tab"], columns["row_id"], columns["run"], columns["text"]):
            if text is None:
                continue
            tail = tally.add(text)
            seen = lengths.setdefault((tab, run, len(text)), [0, 0])
            seen[0] += 1
            seen[1] |= 1 << hash(text) % 50
            if row_id is None:
                continue
            structure = ts.structurally_cut(text, tail)
            whole = not tail or ts.is_quantity(tail)
            if structure or not whole:
                out.append(("tail", tab, row_id, run, None if whole else ts.normal(tail), None, len(text), ts.is_item_list(tail) + 2 * structure))
        if out:
            yield _rows(out)
        if len(tally) + len(lengths) > FLUSH:
            yield from flush()
            tally, lengths = ts.Tally(), {}
    yield from flush()


_COUNTS = ("n_end", "n_on", "n_in", "n_mark")


def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted (s, n, probe) rows: for each probe how many strings end with it (n_end), go on (n_on), go on within the word (n_in), and with a mark (n_mark).

    Parts follow one another, each sorted without equal strings: a string not above the last one begins a new part.
    """
    stack: list[list] = []
    last = ""
    for pdf in batches:
        done = []
        for s, n, probe in zip(pdf["s"], pdf["n"], pdf["probe"]):
            while stack and (s <= last or not s.startswith(stack[-1][0])):
                done.append(tuple(stack.pop()))
            last = s
            for top in stack:
                after = s[len(top[0]) :]
                if after == ts.END:
                    top[1] += n
                elif after:
                    top[2] += n
                    if after[0].isalpha():
                        top[3] += n
                    elif after[0] != " ":
                        top[4] += n
            if probe:
                stack.append([s, 0, 0, 0, 0])
        if done:
            yield pd.DataFrame(done, columns=["s", *_COUNTS])
    if stack:
        yield pd.DataFrame([tuple(x) for x in stack], columns=["s", *_COUNTS])


def prefix_join(strings: DataFrame) -> DataFrame:
    """(s, n_end, n_on, n_in, n_mark) of the probes among distinct (s, n, probe), n the times a string occurs.

    A probe of under PREFIX characters is looked up among the counts of all beginnings of its length. Other
    strings meet in the bucket of their first PREFIX characters. A bucket of more than HOT strings is split by
    LONG_PREFIX characters; its shorter probes go to every part, counted in one, and their finds are added up.
    """
    whole = F.length("s") >= PREFIX
    keyed = strings.where(whole).withColumn("bucket", F.xxhash64(F.substring("s", 1, PREFIX)))
    hot = cut(keyed.groupBy("bucket").agg(F.count("*").alias("size")).where(f"size > {HOT}").select("bucket", F.lit(True).alias("hot")))
    swept_as = "s string, " + ", ".join(f"{c} bigint" for c in _COUNTS)
    if hot.isEmpty():  # every string is in one place
        found = keyed.repartition("bucket").sortWithinPartitions("s").select("s", "n", "probe").mapInPandas(sweep, swept_as)
    else:
        placed = keyed.join(hot, "bucket", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
        home = F.when(~F.col("hot"), 0).otherwise(F.pmod(F.xxhash64(F.substring("s", 1, LONG_PREFIX)), F.lit(PARTS))).cast("int")
        everywhere = F.col("hot") & F.col("probe") & (F.length("s") < LONG_PREFIX)
        placed = placed.withColumn("home", home).withColumn("part", F.explode(F.when(everywhere, F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(home))))
        once = F.when(F.col("part") == F.col("home"), 1).otherwise(0)
        rows = placed.select("bucket", "part", "s", (F.col("n") * once).alias("n"), "probe")
        swept = rows.repartition("bucket", "part").sortWithinPartitions("part", "s").select("s", "n", "probe").mapInPandas(sweep, swept_as)
        found = swept.groupBy("s").agg(*(F.sum(c).alias(c) for c in _COUNTS))
    heads = strings.groupBy(F.substring("s", 1, PREFIX).alias("head")).agg(F.sum("n").alias("n"))
    begun = heads.select(F.explode(F.expr(f"transform(sequence(1, least(length(head), {PREFIX - 1})), i -> struct(substring(head, 1, i) AS s, substring(head, i + 1) AS rest))")).alias("x"), "n")
    when = {"n_end": f"x.rest = '{ts.END}'", "n_on": f"x.rest <> '{ts.END}'", "n_in": r"x.rest RLIKE '^\\p{L}'", "n_mark": rf"x.rest <> '{ts.END}' AND x.rest RLIKE '^[^\\p{{L}} ]'"}
    begun = begun.where("x.rest <> ''").groupBy("x.s").agg(*(F.sum(F.expr(f"IF({w}, n, 0)")).alias(c) for c, w in when.items()))
    return found.unionByName(strings.where(~whole & F.col("probe")).select("s").join(begun, "s"))


def _probes(tails: DataFrame) -> DataFrame:
    """Distinct (s, t, item, words, keys): t the copies of a tail; keys its strings, longest first, windows only where shorter than the tail."""
    distinct = tails.where("s is not null").groupBy("s", F.expr("b % 2 = 1").alias("item")).agg(F.count("*").alias("t")).withColumn("words", F.split("s", " "))
    window = lambda k: F.when((F.size("words") > k) | F.lit(k == 1), F.concat(F.lit(ts.WORDS), F.array_join(F.expr(f"slice(words, -{k}, {k})"), " ")))
    return distinct.select("s", "item", "t", F.size("words").alias("words"), F.array(F.concat(F.lit(ts.SENTENCE), "s"), *(window(k) for k in range(ts.WINDOW, 0, -1))).alias("keys"))


def _judged(tails: DataFrame, counts: DataFrame) -> DataFrame:
    """(s, item, evidence) of the distinct tails that are cut, given (s, n) of strings, maybe in several rows each."""
    probes = cut(_probes(tails))
    each = probes.select("s", "item", F.posexplode("keys").alias("level", "key")).where("key is not null")
    wanted = each.select(F.col("key").alias("s"), F.lit(0).cast("bigint").alias("n"), F.lit(True).alias("probe"))
    opened = probes.select(F.concat(F.lit(ts.SENTENCE), "s").alias("s"), F.col("t").alias("n"), F.lit(False).alias("probe"))
    strings = cut(counts.withColumn("probe", F.lit(False)).unionByName(opened).unionByName(wanted).groupBy("s").agg(F.sum("n").alias("n"), F.max("probe").alias("probe")))
    found = each.join(prefix_join(strings).withColumnRenamed("s", "key"), "key")
    at = lambda c, k: F.coalesce(F.max(F.when(F.col("level") == k, F.col(c))), F.lit(0)).alias(f"{c}{k}")
    levels = range(ts.WINDOW + 1)
    wide = probes.drop("keys").join(found.groupBy("s", "item").agg(*(at(c, k) for k in levels for c in _COUNTS)), ["s", "item"], "left").na.fill(0)
    share = F.lit(UNSEEN)
    for k in reversed(levels):
        own = F.when(F.col("item"), F.col("t") - 1).otherwise(0) if k == 0 else F.lit(0)  # an answer that is but a name may stand open
        on = F.col(f"n_on{k}") - F.when(F.col("item"), F.col(f"n_mark{k}")).otherwise(0)  # what follows a comma is no part of a list of names
        share = (F.col(f"n_end{k}") + own + SMOOTHING * share) / (F.col(f"n_end{k}") + own + on + SMOOTHING)
    last = ts.WINDOW
    broken = F.expr(f"n_in{last} > 0 AND n_in{last} = n_on{last} AND n_end{last} = 0")
    seen = F.expr("n_on0 + n_end0 > 0")
    n_words = strings.where(F.col("s").startswith(ts.WORDS)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = F.expr(f"n_on{last} - n_in{last}") > FREQUENT * n_words
    is_cut = F.when((F.col("t") >= COPIES) & (F.col("n_on0") == 0) & ~frequent, False).when((F.col("words") <= ts.WINDOW) & ~seen, broken).otherwise(share < MAX_ENDS)
    evidence = F.when(seen, "sentence").when(F.expr(" OR ".join(f"n_on{k} + n_end{k} > 0" for k in levels[1:-1])), "words").otherwise("word")
    return wide.where(is_cut).select("s", "item", evidence.alias("evidence"))


def find_truncated(values: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Rows (tab, row_id, evidence) of `values` (tab string, row_id bigint, run string, text string) whose text is cut.

    Null and empty texts and null row ids give no row; repeated deliveries give one row; further columns
    are ignored. A text that ends with a closing tag, a terminal mark or a quantity is whole. An empty
    table gives an empty result. `seen`, if given, is the result of `scanned(values)`.
    """
    seen = scanned(values) if seen is None else seen
    tails = seen.where("kind = 'tail'").select("tab", "row_id", "run", "s", "a", "b")
    verdict = _judged(tails, seen.where("kind = 'str'").select(F.explode(F.arrays_zip(F.col("strings").alias("s"), F.col("counts").alias("n"))).alias("x")).select("x.s", "x.n"))
    limits = field_limits(seen).select("tab", F.coalesce("run", F.lit("")).alias("run"), F.col("field_limit").alias("a"), F.lit(True).alias("at_limit"))
    keyed = tails.select("tab", "row_id", F.coalesce("run", F.lit("")).alias("run"), "a", "s", F.expr("b % 2 = 1").alias("item"), F.expr("b >= 2").alias("structure"))
    judged = join_per_key(join_per_key(keyed, verdict, ["s", "item"], "left"), limits, ["tab", "run", "a"], "left")
    evidence = F.coalesce("evidence", F.when(F.col("structure"), "structure"), F.when(F.col("at_limit"), "limit"))
    return judged.select("tab", "row_id", evidence.alias("evidence")).where("evidence is not null").groupBy("tab", "row_id").agg(F.min("evidence").alias("evidence"))


def scanned(values: DataFrame, further: Callable[[dict[str, list]], list[tuple]] | None = None) -> DataFrame:
    """The Arrow pass over all texts, kept so that it runs once; `further` may add rows of the same columns from each batch."""
    columns = values if further else values.select("tab", "row_id", "run", "text")
    return cut(columns.mapInArrow(partial(scan, further=further), _SCHEMA))


def field_limits(seen: DataFrame) -> DataFrame:
    """Per table and run the length at which values pile up, however short: the largest one, against those down to half of it."""
    lengths = seen.where("kind = 'len'").groupBy("tab", "run", "a").agg(F.sum("b").alias("n"), F.expr("bit_count(bit_or(row_id))").alias("differ"))
    top = lengths.groupBy("tab", "run").agg(F.max(F.struct("a", "n", "differ")).alias("top")).select("tab", "run", "top.*").withColumnsRenamed({"a": "field_limit", "n": "n_at_limit"})
    near = lengths.alias("l").join(top.alias("t"), F.expr("l.tab = t.tab AND l.run <=> t.run AND 2 * l.a >= t.field_limit AND l.a < t.field_limit")).groupBy("t.tab", "t.run").agg(F.sum("l.n").alias("n_below"))
    both = top.alias("t").join(near.alias("b"), F.expr("t.tab = b.tab AND t.run <=> b.run"), "left").select("t.tab", "t.run", "field_limit", "n_at_limit", "differ", F.coalesce("n_below", F.lit(0)).alias("n_below"))
    return both.where(f"differ >= {LIMIT_MIN} AND field_limit > 1 AND n_at_limit >= {LIMIT_TIMES} * n_below / floor(field_limit / 2)").select("tab", "run", "n_at_limit", "field_limit")


def truncation_rates(values: DataFrame) -> DataFrame:
    """Per table and run: distinct rows, cut rows, their share, and the field limit if one shows."""
    seen = scanned(values)
    found = find_truncated(values, seen).select("tab", "row_id", F.lit(1).alias("is_cut"))
    rows = values.where("row_id is not null").groupBy("tab", "row_id").agg(F.max("run").alias("run"))
    per = rows.join(found, ["tab", "row_id"], "left").groupBy("tab", "run").agg(F.count("*").alias("n_rows"), F.count("is_cut").alias("n_cut"))
    limits = field_limits(seen).select("tab", F.coalesce("run", F.lit("")).alias("k"), "field_limit")
    return (
        per.withColumn("k", F.coalesce("run", F.lit("")))
        .join(limits, ["tab", "k"], "left")
        .select("tab", F.col("run").alias("run_name"), "n_rows", "n_cut", F.round(F.col("n_cut") / F.col("n_rows"), 6).alias("cut_share"), "field_limit")
    )
