"""The boundary of model inference: typed columns in and out, the model given by the caller."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def predicted(rows: DataFrame, model: Callable[[list[str]], list[str]], prompt: str = "promt", out: str = "predicted_answer", batch: int = 64) -> DataFrame:
    """`out` from `prompt` by an opaque model, batch by batch; a batch that fails gives empty texts."""
    kept = [c for c in rows.columns if c != out]
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c != out) + f", `{out}` string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            said: list[str] = []
            for at in range(0, len(pdf), batch):
                part = pdf[prompt].iloc[at : at + batch].tolist()
                try:
                    got = list(model(part))
                    said += got if len(got) == len(part) else [""] * len(part)
                except Exception:  # noqa: BLE001 - the model is foreign code
                    said += [""] * len(part)
            pdf[out] = said
            yield pdf[[*kept, out]]

    return rows.mapInPandas(run, schema)
