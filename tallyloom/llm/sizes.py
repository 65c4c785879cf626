"""Sizes of texts in tokens of a public tokenizer; its file's path is a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from ..session import cut

#: Where the vocabulary lies if no path is given.
TOKENIZER = os.environ.get("TALLYLOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: A text is encoded in stretches of about so many characters, cut at line ends or blanks, so that one long text costs no more memory than its stretches.
STRETCH = 200_000
_loaded: dict[str, object] = {}


def encoder(path: str):
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def count_tokens(text: str | None, path: str = TOKENIZER) -> int:
    if not text:
        return 0
    enc, n, at = encoder(path), 0, 0
    while len(text) - at > STRETCH:
        end = max(text.rfind("\n", at, at + STRETCH), text.rfind(" ", at, at + STRETCH))
        end = end if end > at else at + STRETCH
        n += len(enc.encode_ordinary(text[at:end]))
        at = end
    return n + len(enc.encode_ordinary(text[at:]))


def shipped(spark: SparkSession, path: str) -> str:
    """Sends the vocabulary file to the executors, once per application; its name there."""
    name = os.path.basename(path)
    if not any(x.rsplit("/", 1)[-1] == name for x in spark.sparkContext.listFiles):
        spark.sparkContext.addFile(path)
    return name


def with_tokens(docs: DataFrame, path: str = TOKENIZER, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, n_tokens) of documents with a text, each doc_id once, kept so that texts are encoded once."""
    types = dict(docs.dtypes)
    columns = ["doc_id", *keep]
    name = shipped(docs.sparkSession, path)
    schema = ", ".join(f"{c} {types[c]}" for c in columns) + ", n_tokens bigint"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        local = SparkFiles.get(name)
        for pdf in batches:
            pdf["n_tokens"] = [count_tokens(t, local) for t in pdf["text"]]
            yield pdf[[*columns, "n_tokens"]]

    sized = docs.where("doc_id is not null and text is not null").select(*columns, "text").mapInPandas(run, schema)
    return cut(sized.dropDuplicates(["doc_id"]))
