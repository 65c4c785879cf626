"""Garbled text from a wrong character encoding: find the records, restore them where possible.

Method: a smoothed character trigram model (interpolated, hashed into tables of a fixed size) is trained on records
that show no sign of a wrong decoding. A piece of text beyond ASCII is scored as it stands and under every
encode-decode chain; a document's gain is the best chain's sum over its pieces. A document is garbled if its gain passes a
margin, or if it holds replacement or C1 control characters. The margin is validated on a tenth of the records without signs,
all of them, held out of the training, and on garbled ones made from them, in whole or in one piece: it is the middle one of those
with the least share of clean texts flagged plus garbled ones missed.

Texts are read once. What is shuffled are their pieces beyond ASCII; each distinct piece of the corpus is scored once,
and scores are joined back to documents. Trigrams of ASCII characters alone are left out: no chain changes them. The model
has a fixed size, so collecting and broadcasting it is bounded whatever the corpus.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut
from .joins import join_per_key

#: Bits of the hash tables of trigrams, their contexts, and bigrams; characters share the last.
BITS = 18
#: Weights of trigram, bigram, character and uniform estimates.
WEIGHTS = (0.70, 0.20, 0.0999, 0.0001)
#: Margins tried; one record in so many is held out.
MARGINS, HELD = tuple(x / 2 for x in range(2, 61)), 10
#: Margins whose shares of mistakes differ by less are equally good.
TOLERANCE = 0.002
#: A chain must gain this much on a piece for the piece to be restored.
TOKEN_MARGIN = 2.0
#: Scores of up to so many pieces are broadcast, a kilobyte or two each.
BROADCAST_PIECES = 20_000
#: Pieces scored at once.
FLUSH = 2_000

# Encodings a text may have been read in wrongly, and those it may have been written in.
READ_AS = ["cp1252", "cp437", "cp850", "mac_roman", "cp1251", "cp1250", "cp866", "koi8_r", "iso8859_2", "iso8859_15", "cp1253", "cp1254", "cp1257", "mac_cyrillic", "cp852"]
WRITTEN_IN = ["utf_8", "cp1252", "cp1250", "iso8859_2", "cp1251", "koi8_r", "cp866", "mac_roman", "mac_cyrillic", "cp437", "cp850", "cp852", "shift_jis", "euc_jp", "gbk", "big5", "euc_kr"]

_TOKEN = re.compile(r"[^ \t\r\n\x0b\x0c]*[^\x00-\x7f][^ \t\r\n\x0b\x0c]*")
#: Within a token, runs of ideographs and kana are apart from the rest.
_WIDE = re.compile(r"([　-ヿ㐀-鿿가-힣＀-￯]+)")
_LOST = re.compile(r"[�\x80-\x9f]")
_SIGNS = re.compile(
    r"[�\x80-\x9f─-▟]|[ÂÃâÐÑÅÄ][\x80-\xbf€‚ƒ„…†‡ˆ‰Š‹Œ‘’“”•–—˜™š›œŸž]|[А-я][a-zA-Z]|[a-zA-Z][А-я]|[√≈∞∂∫∏∑ﬂ]|[¡-ÿ]{4}|[ГВР][¤¬­®°±²³µ¶·¸»ЁЂЃЄЅІЇЈЉЊЋЌЎЏ]|â€|‚Ä|ÔÇ|Γ[ÇΓ]"
)


def _table(name: str) -> dict[int, int]:
    """char -> byte of an encoding that leaves undefined bytes as they are."""
    encode = {}
    for b in range(256):
        try:
            ch = bytes([b]).decode(name)
        except UnicodeDecodeError:
            ch = chr(b)
        encode.setdefault(ord(ch), b)
    for b in range(128, 160):  # readers that pass C1 bytes through
        encode.setdefault(b, b)
    return encode


class _Encode(dict):
    def __missing__(self, k: int) -> int:
        return 0x100  # cannot be a byte


_ENCODE = {name: _Encode(_table(name)) for name in READ_AS}
#: (read as, written in, times) of every chain.
CHAINS = [(a, b, n) for a in READ_AS for b in WRITTEN_IN if a != b for n in ((1, 2) if b == "utf_8" else (1,))]


#: Chains that clean records are garbled by to validate the margin: frequent mistakes.
MADE_BY = [("cp1252", "utf_8", 1), ("cp1252", "utf_8", 2), ("mac_roman", "utf_8", 1), ("cp437", "utf_8", 1), ("cp1251", "utf_8", 1), ("iso8859_2", "cp1252", 1), ("cp1252", "cp1251", 1), ("cp1252", "shift_jis", 1)]


def undo(text: str, chain: tuple[str, str, int]) -> str | None:
    """The text before it was read in chain[0] instead of chain[1], chain[2] times; None if it cannot have been."""
    read, written, times = chain
    for _ in range(times):
        try:
            text = text.translate(_ENCODE[read]).encode("latin-1").decode(written)
        except (UnicodeDecodeError, UnicodeEncodeError):
            return None
    return text


def garble(text: str, chain: tuple[str, str, int]) -> str | None:
    read, written, times = chain
    for _ in range(times):
        try:
            raw = text.encode(written)
            text = "".join(chr(b) if (c := bytes([b]).decode(read, "replace")) == "�" else c for b in raw)
        except UnicodeEncodeError:
            return None
    return text


def pieces(token: str) -> list[str]:
    return [p for p in _WIDE.split(token) if p and not p.isascii()]


def candidates(piece: str) -> tuple[list[int], list[int], list[str]]:
    """(chain numbers, for each the position of its text, distinct texts) of all chains that undo something; a reading that cannot hold the piece rules out all its chains at once."""
    numbers, at, texts = [], [], {}
    for read, chains in _BY_READING.items():
        try:
            raw = piece.translate(_ENCODE[read]).encode("latin-1")
        except UnicodeEncodeError:
            continue
        for k, written, times in chains:
            try:
                was = raw.decode(written)
                if times == 2:
                    was = was.translate(_ENCODE[read]).encode("latin-1").decode(written)
            except (UnicodeDecodeError, UnicodeEncodeError):
                continue
            if was != piece and "�" not in was and was.isprintable():
                numbers.append(k)
                at.append(texts.setdefault(was, len(texts)))
    return numbers, at, list(texts)


_BY_READING: dict[str, list[tuple[int, str, int]]] = {}
for _k, (_read, _written, _times) in enumerate(CHAINS):
    _BY_READING.setdefault(_read, []).append((_k, _written, _times))


def _mixed(*codes: np.ndarray | int) -> np.ndarray:
    h = np.full(codes[-1].shape, 1469598103, np.uint64)
    for c in codes:
        h = (h * np.uint64(1000003) ^ (np.uint64(c) if isinstance(c, int) else c)) & np.uint64(0xFFFFFFFFFFFF)
    return (h ^ h >> np.uint64(23)).astype(np.int64) & ((1 << BITS) - 1)


def _grams(texts: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(number of its text, table positions) of every trigram with a character beyond ASCII, each text between marks, letters of ASCII lower case, digits alike."""
    codes = np.frombuffer("".join(f"\2\3{t}\4" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    codes = np.where((codes >= 65) & (codes <= 90), codes + np.uint64(32), np.where((codes >= 48) & (codes <= 57), np.uint64(48), codes))
    owner = np.repeat(np.arange(len(texts)), [len(t) + 3 for t in texts])
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    keep = (owner[:-2] == owner[2:]) & ((a > 127) | (b > 127) | (c > 127))
    a, b, c = a[keep], b[keep], c[keep]
    return owner[2:][keep], [_mixed(1, a, b, c), _mixed(2, a, b), _mixed(3, b, c), _mixed(4, b), _mixed(5, c)]


class Model:
    """Hashed counts: trigram, its context, bigram, its context, character."""

    def __init__(self, counts: np.ndarray) -> None:
        self.counts = counts
        self.total = float(counts[4].sum()) or 1.0

    def scores(self, texts: list[str]) -> np.ndarray:
        """Log likelihood of each text."""
        if not texts:
            return np.zeros(0)
        owner, places = _grams(texts)
        tri, tri_of, bi, bi_of, uni = (table[x].astype(np.float64) for table, x in zip(self.counts, places))
        p = WEIGHTS[0] * tri / np.maximum(tri_of, 1) + WEIGHTS[1] * bi / np.maximum(bi_of, 1) + WEIGHTS[2] * uni / self.total + WEIGHTS[3] / 1000
        return np.bincount(owner, np.log(np.minimum(p, 1.0)), len(texts))

    def gains(self, found: list[str]) -> list[dict[int, float]]:
        """For each piece: chain number -> how much likelier the piece is undone; only gains."""
        tried = [candidates(p) for p in found]
        scores = self.scores([*found, *(w for _, _, texts in tried for w in texts)])
        out, at = [], len(found)
        for own, (numbers, places, texts) in zip(scores, tried):
            gain = scores[at : at + len(texts)] - own
            at += len(texts)
            out.append({k: float(gain[i]) for k, i in zip(numbers, places) if gain[i] > 0})
        return out

    def restore(self, text: str, k: int) -> str:
        found = list(dict.fromkeys(p for token in _TOKEN.findall(text) for p in pieces(token)))
        was = [undo(p, CHAINS[k]) for p in found]
        scores = self.scores(found + [w or p for p, w in zip(found, was)])
        fixed = {p: w for i, (p, w) in enumerate(zip(found, was)) if w and scores[len(found) + i] - scores[i] > TOKEN_MARGIN}
        return _TOKEN.sub(lambda m: "".join(fixed.get(p, p) for p in _WIDE.split(m.group())), text)


def _pieces_of(text: str) -> Counter[str]:
    return Counter(p for token in _TOKEN.findall(text) for p in pieces(token))


def made(found: Counter[str], seed: int) -> Counter[str] | None:
    """Pieces of a text garbled by a chain chosen by the seed, every second one in one piece only; None where the chain changes nothing or leaves lost characters."""
    rng = random.Random(seed)
    chain, order = rng.choice(MADE_BY), sorted(found)
    chosen = set(order if rng.random() < 0.5 else [rng.choice(order)])
    out: Counter[str] = Counter()
    changed = False
    for p in order:
        g = garble(p, chain) if p in chosen else p
        g = p if g is None else g
        if _LOST.search(g):
            return None
        changed |= g != p
        for q, n in _pieces_of(g).items():
            out[q] += n * found[p]
    return out if changed else None


#: Kinds of posted documents: without and with signs of a wrong decoding, held out, and made from held-out ones.
PLAIN, SIGNED, OUT, MADE = range(4)


def _post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, kind, lost, piece, n): the pieces of every text beyond ASCII; a text with lost characters has a row without a piece."""
    for batch in batches:
        rows: list[tuple] = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            found = _pieces_of(text)
            if _LOST.search(text):
                rows.append((doc_id, SIGNED, True, None, 0))
            kind = SIGNED if _SIGNS.search(text) else OUT if (doc_id * 2654435761 >> 7) % HELD == 0 else PLAIN
            rows += [(doc_id, kind, False, p, n) for p, n in found.items()]
            if kind == OUT and found and (garbled := made(found, doc_id)):
                rows += [(doc_id, MADE, False, p, n) for p, n in garbled.items()]
        columns = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.bool_(), pa.string(), pa.int64()))], names=["doc_id", "kind", "lost", "piece", "n"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, bucket, n) of the trigrams of distinct pieces (piece, n)."""
    for batch in batches:
        texts, n = batch.column("piece").to_pylist(), batch.column("n").to_numpy()
        if not texts:
            continue
        owner, places = _grams(texts)
        parts = [np.unique(x, return_inverse=True) for x in places]
        sums = [np.bincount(inverse, n[owner], len(x)).astype(np.int64) for x, inverse in parts]
        part = np.repeat(np.arange(5, dtype=np.int32), [len(x) for x, _ in parts])
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.concatenate([x for x, _ in parts])), pa.array(np.concatenate(sums))], names=["part", "bucket", "n"])


def train(distinct: DataFrame) -> Model:
    """A model of pieces (piece, n); at most 5 * 2^BITS counts come to the driver, whatever the corpus."""
    rows = distinct.where("n > 0").select("piece", "n").mapInArrow(_count, "part int, bucket bigint, n bigint").groupBy("part", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((5, 1 << BITS), dtype=np.float32)
    if len(rows):
        counts[rows["part"], rows["bucket"]] = rows["n"]
    return Model(counts)


def _gains(distinct: DataFrame, model: Model) -> DataFrame:
    """(piece, chains, gains) of the pieces that some chain makes likelier."""
    shared = distinct.sparkSession.sparkContext.broadcast(model.counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(shared.value)
        for batch in batches:
            texts = batch.column("piece").to_pylist()
            for i in range(0, len(texts), FLUSH):
                block = texts[i : i + FLUSH]
                found = [(p, list(g), list(g.values())) for p, g in zip(block, m.gains(block)) if g]
                columns = list(zip(*found)) or [()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.list_(pa.int32())), pa.array(columns[2], pa.list_(pa.float64()))], names=["piece", "chains", "gains"])

    return distinct.select("piece").mapInArrow(run, "piece string, chains array<int>, gains array<double>")


def _sums(posted: DataFrame, gains: DataFrame) -> DataFrame:
    """(doc_id, made, kind, gain, k) of every posted document with a gain: the best chain's sum over its pieces, the first of equals."""
    met = join_per_key(posted.where("piece is not null"), gains, ["piece"], broadcast_rows=BROADCAST_PIECES).dropDuplicates(["doc_id", "kind", "piece"])  # a repeated row counts once
    each = met.select("doc_id", "kind", "n", F.explode(F.arrays_zip("chains", "gains")).alias("x"))
    per = each.groupBy("doc_id", "kind", F.col("x.chains").alias("k")).agg(F.sum(F.col("n") * F.col("x.gains")).alias("gain"))
    return per.groupBy("doc_id", "kind").agg(F.max(F.struct(F.col("gain"), (-F.col("k")).alias("minus"))).alias("best")).select("doc_id", "kind", F.col("best.gain").alias("gain"), (-F.col("best.minus")).alias("k"))


def validated(posted: DataFrame, sums: DataFrame) -> dict:
    """The margin with the least share of clean held-out texts flagged plus garbled ones missed, the middle of the first run of equals, and both shares."""
    totals = {r.kind: r.n for r in posted.where(f"kind IN ({OUT}, {MADE})").groupBy("kind").agg(F.countDistinct("doc_id").alias("n")).collect()}
    passed = F.expr(f"size(filter(array({', '.join(map(str, MARGINS))}), m -> gain > m))")
    rows = sums.where(f"kind IN ({OUT}, {MADE})").groupBy("kind", passed.alias("k")).agg(F.count("*").alias("n")).collect()
    share = lambda kind, i: sum(r.n for r in rows if r.kind == kind and r.k > i) / max(1, totals.get(kind, 0))
    at = [(share(OUT, i) + 1 - share(MADE, i), m, share(OUT, i), share(MADE, i)) for i, m in enumerate(MARGINS)]
    least = min(at)[0] + TOLERANCE
    first = next(i for i, x in enumerate(at) if x[0] <= least)
    run = next((i for i in range(first, len(at)) if at[i][0] > least), len(at)) - first
    _, margin, flagged, recall = at[first + (run - 1) // 2]
    return {"margin": margin, "n_clean": totals.get(OUT, 0), "n_garbled": totals.get(MADE, 0), "clean_flagged": flagged, "recall": recall}


def judged(docs: DataFrame) -> tuple[DataFrame, Model, dict]:
    """(doc_id, gain, k, lost) of the garbled documents, the model, and how its margin validated."""
    texts = docs.where("doc_id IS NOT NULL AND octet_length(text) > length(text)").select("doc_id", "text")
    posted = cut(texts.mapInArrow(_post, "doc_id bigint, kind int, lost boolean, piece string, n bigint"))
    distinct = cut(posted.where("piece is not null").groupBy("piece").agg(F.sum(F.expr(f"IF(kind = {PLAIN}, n, 0)")).alias("n")))
    model = train(distinct)
    sums = cut(_sums(posted, _gains(distinct, model)))
    check = validated(posted, sums)
    beyond = sums.where(f"kind <> {MADE}").where(F.col("gain") > check["margin"]).groupBy("doc_id").agg(F.max("gain").alias("gain"), F.max_by("k", "gain").alias("k"))
    lost = posted.where("lost").select("doc_id", F.lit(True).alias("lost")).distinct()
    return beyond.join(lost, "doc_id", "full").select("doc_id", F.coalesce("gain", F.lit(0.0)).alias("gain"), "k", F.coalesce("lost", F.lit(False)).alias("lost")), model, check


def find_garbled(docs: DataFrame) -> DataFrame:
    """(doc_id, gain, chain, lost, restored) of garbled documents of (doc_id bigint, text string).

    restored is null where no chain passes the margin (only lost characters remain). Null, empty and ASCII
    texts are never garbled, null ids are left out; repeated rows give one; further columns are ignored; an empty
    table gives an empty result.
    """
    found, model, _ = judged(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model.counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(shared.value)
        for batch in batches:
            ks = batch.column("k").to_pylist()
            restored = [None if k is None else m.restore(t, k) for k, t in zip(ks, batch.column("text").to_pylist())]
            chains = [None if k is None else " ".join(map(str, CHAINS[k])) for k in ks]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("gain"), pa.array(chains, pa.string()), batch.column("lost"), pa.array(restored, pa.string())], names=["doc_id", "gain", "chain", "lost", "restored"])

    texts = docs.where("doc_id IS NOT NULL AND octet_length(text) > length(text)").select("doc_id", "text").join(found, "doc_id").dropDuplicates(["doc_id"])
    return texts.select("doc_id", "text", "gain", "k", "lost").mapInArrow(run, "doc_id bigint, gain double, chain string, lost boolean, restored string")
