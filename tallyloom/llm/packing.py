"""Filling fixed-capacity containers: shortest-pack-first over the length histogram.

Lengths are placed longest first, each into the packing pattern with the least room that still takes it;
only counts per pattern are updated, so the work depends on the capacity, not on the number of texts. The
patterns are then joined back to documents by their rank within a length: lengths and ranks are one position, and
its slot is found by binary search, so that the join gives one row per item. A text longer than the capacity
gives full containers of its own and one rest, which is packed as any other item.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut
from .sizes import TOKENIZER, with_tokens

#: Ranks within a length are made in so many buckets per shuffle partition, so that no length's items meet in one task.
BUCKETS = 4
#: Slots are broadcast up to this many (16 bytes each); beyond, items meet them by blocks of so many positions.
BROADCAST_SLOTS, BLOCK = 4_000_000, 4096


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Slots (length, rank_from, rank_to, container_from) and the number of containers.

    Items rank_from <= rank < rank_to of a length go to containers container_from + rank - rank_from.
    """
    # A pattern is (room, count, items), items the lengths it holds; patterns of one room are a stack.
    rooms: list[int] = []
    by_room: dict[int, list[tuple[int, tuple[int, ...]]]] = {}

    def put(room: int, count: int, items: tuple[int, ...]) -> None:
        if room not in by_room:
            by_room[room] = []
            bisect.insort(rooms, room)
        by_room[room].append((count, items))

    def take(room: int) -> tuple[int, tuple[int, ...]]:
        got = by_room[room].pop()
        if not by_room[room]:
            del by_room[room]
            rooms.pop(bisect.bisect_left(rooms, room))
        return got

    for length in sorted((k for k, n in histogram.items() if k > 0 and n > 0), reverse=True):
        left = histogram[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                each = min(left, capacity // length)
                put(capacity - each * length, left // each, (length,) * each)
                left %= each
                continue
            room = rooms[at]
            count, items = take(room)
            used = min(count, left)
            put(room - length, used, (*items, length))
            if count > used:
                put(room, count - used, items)
            left -= used
    slots, rank, container = [], {}, 0
    for room in rooms:
        for count, items in by_room[room]:
            for length in items:
                at = rank.get(length, 0)
                slots.append((length, at, at + count, container))
                rank[length] = at + count
            container += count
    return slots, container


def items(docs: DataFrame, capacity: int, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, part, n_parts, n_tokens) of what is to be placed: whole texts, and the stretches of texts beyond the capacity."""
    sized = with_tokens(docs, tokenizer).where("n_tokens > 0")
    n_parts = F.ceil(F.col("n_tokens") / capacity).cast("int")
    split = sized.withColumn("n_parts", n_parts).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)))
    return split.select("doc_id", "part", "n_parts", F.least(F.lit(capacity), F.col("n_tokens") - F.col("part") * capacity).cast("int").alias("n_tokens"))


def _by_search(ranked: DataFrame, starts: np.ndarray, first: np.ndarray) -> DataFrame:
    """container_id of (pos, ...) by binary search among the broadcast slots."""
    shared = ranked.sparkSession.sparkContext.broadcast((starts, first))
    kept = ["doc_id", "part", "n_parts", "n_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, containers = shared.value
        for b in batches:
            pos = b.column("pos").to_numpy()
            slot = np.searchsorted(at, pos, side="right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(containers[slot] + pos - at[slot]), *(b.column(c) for c in kept)], names=["container_id", *kept])

    return ranked.select("pos", *kept).mapInArrow(run, "container_id bigint, doc_id bigint, part int, n_parts int, n_tokens bigint")


def _by_blocks(ranked: DataFrame, starts: np.ndarray, first: np.ndarray) -> DataFrame:
    """The same by an equi-join: a slot is listed in every block of positions that it reaches, an item looks in its own block."""
    ends = np.append(starts[1:], np.iinfo(np.int64).max)
    last = int(ranked.agg(F.coalesce(F.max("pos"), F.lit(0))).first()[0])
    table = ranked.sparkSession.createDataFrame(list(zip(starts.tolist(), np.minimum(ends, last + 1).tolist(), first.tolist())), "pos_from bigint, pos_to bigint, container_from bigint").where("pos_to > pos_from")
    listed = table.withColumn("block", F.explode(F.sequence(F.floor(F.col("pos_from") / BLOCK), F.floor((F.col("pos_to") - 1) / BLOCK))))
    met = ranked.withColumn("block", F.floor(F.col("pos") / BLOCK)).join(listed, "block").where("pos >= pos_from AND pos < pos_to")
    return met.select((F.col("container_from") + F.col("pos") - F.col("pos_from")).alias("container_id"), "doc_id", "part", "n_parts", "n_tokens")


def pack(docs: DataFrame, capacity: int, tokenizer: str = TOKENIZER) -> DataFrame:
    """(container_id, doc_id, part, n_parts, n_tokens): every text of documents (doc_id bigint, text string) placed once.

    No container holds more than `capacity` tokens and only texts beyond it are split. Null and empty texts
    and null ids need no room and are left out; repeated ids count once; further columns are ignored; an empty
    table gives an empty result. The histogram, at most `capacity` rows, is planned on the driver; the slots
    grow with the capacity and not with the data.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    placed = items(docs, capacity, tokenizer)
    spark = docs.sparkSession
    histogram = {r.n_tokens: r.n for r in placed.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}
    slots, _ = plan(histogram, capacity)
    offset, total = {}, 0
    for length in sorted(histogram):
        offset[length], total = total, total + histogram[length]
    slots = sorted((offset[length] + a, container) for length, a, _, container in slots)
    starts, first = (np.array([x[i] for x in slots], dtype=np.int64) for i in (0, 1))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions")) * BUCKETS
    keyed = placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "part"), F.lit(buckets)))
    # a position is the number of items of shorter lengths, of the same length in earlier buckets, and before it in its bucket
    per = cut(keyed.groupBy("n_tokens", "bucket").agg(F.count("*").alias("n")))
    lengths = spark.createDataFrame(list(offset.items()), "n_tokens int, offset bigint")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("n_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = per.select("n_tokens", "bucket", before.alias("before")).join(lengths, "n_tokens").select("n_tokens", "bucket", (F.col("before") + F.col("offset")).alias("before"))
    local = F.row_number().over(Window.partitionBy("n_tokens", "bucket").orderBy("doc_id", "part")) - 1
    ranked = keyed.withColumn("local", local).join(start, ["n_tokens", "bucket"])
    ranked = ranked.select((F.col("local") + F.col("before")).alias("pos"), "doc_id", "part", "n_parts", F.col("n_tokens").cast("bigint").alias("n_tokens"))
    return (_by_search if len(starts) <= BROADCAST_SLOTS else _by_blocks)(ranked, starts, first)


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, tokens, the share of space filled, and the fewest containers the tokens could need."""
    per = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("used"))
    return per.agg(
        F.count("*").alias("n_containers"), F.coalesce(F.sum("used"), F.lit(0)).alias("n_tokens"), F.max("used").alias("most_used"),
        F.round(F.sum("used") / (F.count("*") * capacity), 6).alias("filled"), F.ceil(F.sum("used") / capacity).alias("fewest"),
    )
