"""The admission limiter over a stream: per key a window anchored at its first request, kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def admit_stream(events: DataFrame, key: str, at: str, tie: str, limit: int, window_s: int) -> DataFrame:
    """events(key long, at timestamp, tie long), a stream -> key, tie, admitted. The state of a key is two numbers; a batch's
    rows are taken in order of time, and later batches go on from there."""
    span = window_s * 1_000_000

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        reset, n = state.get if state.exists else (-(1 << 62), 0)
        rows = pd.concat(list(parts)).sort_values([at, tie], kind="stable")
        out = []
        for now in rows[at].astype("datetime64[us]").astype("int64"):
            if now >= reset:
                reset, n = now + span, 0
            n += 1
            out.append(n <= limit)
        state.update((int(reset), n))
        yield pd.DataFrame({key: k[0], tie: rows[tie].to_numpy(), "admitted": out})

    schema = f"{key} long, {tie} long, admitted boolean"
    return events.select(key, at, tie).groupBy(key).applyInPandasWithState(run, schema, "reset long, n long", "append", GroupStateTimeout.NoTimeout)
