"""Bars, signals and cooldowns over streams, with the results of their batch forms."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def hourly_bars(trades: DataFrame, late: str = "2 hours", width: str = "1 hour") -> DataFrame:
    """Bars of a stream of (symbol, ts, price, quantity); a window is final once the watermark has passed it."""
    rows = trades.withWatermark("ts", late)
    bars = rows.groupBy("symbol", F.window("ts", width)).agg(F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.sum("quantity").alias("volume"))
    return bars.select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume")


def new_signals(signals: DataFrame, late: str = "2 days") -> DataFrame:
    """Each (rule, symbol, day) once."""
    return signals.withWatermark("ts", late).dropDuplicatesWithinWatermark(["rule", "symbol", "day"])


def cooldown(hits: DataFrame, gap: int) -> DataFrame:
    """hits (symbol, at) that are gap after the last one kept of their symbol; the state of a symbol is that one number.

    Rows of a batch are taken in order; a batch must not hold rows older than those before it.
    """

    def keep(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        kept = []
        for at in sorted(x for part in parts for x in part["at"]):
            if last is None or at - last >= gap:
                kept.append(at)
                last = at
        if last is not None:
            state.update((int(last),))
        yield pd.DataFrame({"symbol": key[0], "at": pd.Series(kept, dtype="int64")})

    return hits.groupBy("symbol").applyInPandasWithState(keep, "symbol string, at long", "last long", "append", GroupStateTimeout.NoTimeout)


def one_open(signals: DataFrame) -> DataFrame:
    """signals (rule, symbol, at, hold) that come when their rule holds nothing of their symbol; the state is the time at which it is free again.

    Rows of a batch are taken in order; a batch must not hold rows older than those before it.
    """

    def keep(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        free = state.get[0] if state.exists else None
        kept = []
        for at, hold in sorted((int(a), int(h)) for part in parts for a, h in zip(part["at"], part["hold"])):
            if free is None or at >= free:
                kept.append((*key, at, hold))
                free = at + hold
        if free is not None:
            state.update((free,))
        yield pd.DataFrame(kept, columns=["rule", "symbol", "at", "hold"])

    return signals.groupBy("rule", "symbol").applyInPandasWithState(keep, "rule string, symbol string, at long, hold long", "free long", "append", GroupStateTimeout.NoTimeout)
