"""Admission by anchored fixed windows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def admit(events: DataFrame, key: str, at: str, ident: str, limit: int, window_s: int) -> DataFrame:
    """key, ident, admitted: a key's window opens at its first event and, when it is over, at the next one;
    at most limit events of a window are admitted.

    Windows follow from each other, so a key's events are read in order: as a
    stream of a sorted partition, with one key's state in memory at a time.
    """

    def run(batches):
        who, reset, n = None, 0, 0
        for pdf in batches:
            out = []
            for k, t in zip(pdf["k"], pdf["t"], strict=True):
                if k != who or t >= reset:
                    who, reset, n = k, t + window_s * 1_000_000, 0
                n += 1
                out.append(n <= limit)
            yield pd.DataFrame({"k": pdf["k"], "i": pdf["i"], "admitted": out})

    rows = events.select(F.col(key).alias("k"), F.unix_micros(F.col(at).cast("timestamp")).alias("t"), F.col(ident).alias("i"))
    out = rows.repartition("k").sortWithinPartitions("k", "t", "i").mapInPandas(run, "k long, i long, admitted boolean")
    return out.select(F.col("k").alias(key), F.col("i").alias(ident), "admitted")
