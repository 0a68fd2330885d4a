"""Control and state that depend on the order of rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def worker_levels(rates: DataFrame, least: int, start: int = 16, low: int = 1, high: int = 64, step: int = 2) -> DataFrame:
    """(start, workers) after each window in order. Windows are aggregates of time: few rows, folded by one task."""

    def fold(f: pd.DataFrame) -> pd.DataFrame:
        workers, out = start, []
        for r in f.sort_values("start").itertuples():
            if r.n >= least:
                share = r.errors / r.n
                if share > 0.05:
                    workers = max(low, workers // 2)
                elif share < 0.02:
                    workers = min(high, workers + step)
            out.append((r.start, workers))
        return pd.DataFrame(out, columns=["start", "workers"])

    return rates.select("start", "n", "errors").groupBy().applyInPandas(fold, "start timestamp, workers bigint")


def trust_updates(df: DataFrame) -> DataFrame:
    """Streamed (variant, ordinal, good BOOLEAN) to (variant, trust): +0.05 for good rows, -0.05 for others, within 0 and 1, kept as state."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        trust = state.get[0] if state.exists else 0.5
        for f in frames:
            for good in f.sort_values("ordinal")["good"]:
                trust = min(1.0, max(0.0, trust + (0.05 if good else -0.05)))
        state.update((trust,))
        yield pd.DataFrame({"variant": [key[0]], "trust": [trust]})

    return df.groupBy("variant").applyInPandasWithState(update, "variant string, trust double", "trust double", "update", GroupStateTimeout.NoTimeout)
