"""Structured Streaming forms of the operators that only look back."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POOL = "sequence string, row long, q long, pool array<long>"


def sequence_pool(candidates: DataFrame, frames: int) -> DataFrame:
    """``sequence, row, q, pool``: for each query of a stream (sequence, row, q, candidates) the sorted union of the
    candidates of the last ``frames`` queries of its sequence.

    State per sequence is the last ``frames - 1`` lists. Rows must arrive in order within a sequence; one at or before the
    last row seen is late and dropped.
    """
    if frames < 1:
        raise ValueError("frames must be at least 1")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, held = state.get if state.exists else (-1, [])
        held = [list(x) for x in held]
        out = []
        for row in pd.concat(list(batches)).sort_values("row", kind="stable").itertuples():
            if row.row <= last:
                continue
            held = [*held, [int(c) for c in row.candidates]][-frames:]
            last = int(row.row)
            out.append((key[0], last, int(row.q), sorted({c for x in held for c in x if c >= 0})))
        state.update((last, held[-(frames - 1) :] if frames > 1 else []))
        yield pd.DataFrame(out, columns=["sequence", "row", "q", "pool"])

    return candidates.groupBy("sequence").applyInPandasWithState(step, POOL, "last long, held array<array<long>>", "append", "NoTimeout")


def running_moments(rows: DataFrame, column: str = "features") -> DataFrame:
    """``pos, n, mean, std`` over a stream of feature vectors, for output mode ``complete``; partial moments merge in the state."""
    each = rows.select(F.posexplode(column).alias("pos", "value"))
    return each.groupBy("pos").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(1.0)).alias("std"))
