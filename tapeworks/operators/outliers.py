"""Row filters that depend on the last row accepted."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def _in_order(df: DataFrame, by: list[str], ts: str, step, out: str) -> DataFrame:
    """``df`` with a boolean that ``step(state, row arrays) -> (flags, state)`` makes in order; one state per key is carried over batches."""
    ordered = df.repartition(*by).sortWithinPartitions(*by, ts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for pdf in batches:
            flags = np.empty(len(pdf), bool)
            for k, rows in pdf.groupby(by, sort=False, dropna=False).indices.items():
                if k != key:
                    key, state = k, None
                flags[rows], state = step(state, pdf.iloc[rows])
            yield pdf.assign(**{out: flags})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", {out} boolean"
    return ordered.mapInPandas(run, schema)


def accepted(ticks: DataFrame, share: float = 0.2, by: list[str] | None = None) -> DataFrame:
    """``ok``: the price is within ``share`` of the last price that was ok."""

    def step(last, rows):
        flags = np.empty(len(rows), bool)
        for i, p in enumerate(rows["px"].to_numpy()):
            flags[i] = last is None or abs(p - last) <= share * last
            if flags[i]:
                last = p
        return flags, last

    return _in_order(ticks, by or ["symbol"], "ts", step, "ok")


def sampled(ticks: DataFrame, seconds: float, by: list[str] | None = None) -> DataFrame:
    """``kept``: at least ``seconds`` since the last row that was kept."""

    def step(last, rows):
        at = rows["ts"].to_numpy().astype("datetime64[us]").astype(np.int64)
        flags = np.zeros(len(rows), bool)
        i = 0
        while i < len(at):
            if last is not None:
                i = max(i, int(np.searchsorted(at, last + int(seconds * 1e6))))
                if i >= len(at):
                    break
            flags[i], last = True, int(at[i])
            i += 1
        return flags, last

    return _in_order(ticks, by or ["symbol"], "ts", step, "kept")
