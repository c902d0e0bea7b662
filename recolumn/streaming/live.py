"""Streaming forms of a few operators: an extension, the batch operators do not need it.

Event times must be timestamps with a time zone: watermarks reject timestamp_ntz, so
`events` casts first.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def events(rows: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Interactions of an events stream with a watermark on `ts`."""
    item = F.get_json_object("props", "$.k").cast("long")
    return rows.select("user_id", item.alias("item_id"), "event_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", lateness)


def live_popularity(stream: DataFrame, window: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Interactions of each item by window; late rows beyond the watermark are left out."""
    return stream.groupBy(F.window("ts", window, slide or window).alias("w"), "item_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "item_id", "n")


def token_budget(calls: DataFrame, limit: int) -> DataFrame:
    """Token sums by minute of a stream (ts with a watermark, tokens)."""
    return calls.groupBy(F.window("ts", "1 minute").alias("w")).agg(F.sum("tokens").alias("tokens")).select(F.col("w.start").alias("minute"), "tokens", (F.col("tokens") > limit).alias("over"))


def recent_items(stream: DataFrame, n: int = 10) -> DataFrame:
    """After each micro-batch, the changed users' n latest items; the state of a user is n rows."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(zip(*state.get, strict=True)) if state.exists else []
        for part in parts:
            kept += list(zip(part.ts.astype("int64").tolist(), part.event_id.tolist(), part.item_id.tolist(), strict=True))
        kept = sorted(set(kept), reverse=True)[:n]
        state.update(tuple(list(c) for c in zip(*kept, strict=True)))
        yield pd.DataFrame({"user_id": [key[0]], "items": [[i for _, _, i in kept]]})

    saved = "ts array<long>, event_id array<long>, item_id array<long>"
    return stream.groupBy("user_id").applyInPandasWithState(step, "user_id long, items array<long>", saved, "update", GroupStateTimeout.NoTimeout)
