"""Fence events, proximity to fixed places and expiry over streams of positions.

State is kept per object: its last position, and for each fence nothing more, as being inside follows from it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import globs
from ..operators.joins import SMALL

EVENTS = "id string, seq long, hook string, detect string"


def km_between(lat1, lon1, lat2, lon2):
    a, b = np.radians(lat1), np.radians(lat2)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 6371.0 * 2 * np.arctan2(np.sqrt(h), np.sqrt(np.maximum(0.0, 1 - h)))


def fence_events(changes: DataFrame, fences: DataFrame, detect: list[str] | None = None) -> DataFrame:
    """Messages (id, seq, hook, detect) for a stream of changes (id string, seq, lat, lon) at a fence table (hook, flat, flon, fkm) of checked size.

    Changes of one object are taken in seq order within each micro-batch. Outside is silent unless listed in `detect`.
    """
    known = fences.select("hook", "flat", "flon", "fkm").limit(SMALL + 1).collect()
    if len(known) > SMALL:
        raise ValueError(f"more than {SMALL} fences")
    hooks = [r["hook"] for r in known]
    lat, lon, km = (np.array([r[c] for r in known], float) for c in ("flat", "flon", "fkm"))
    wanted = set(detect or ["enter", "exit", "cross", "inside"])

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else (math.nan, math.nan)
        out = []
        for _, row in pd.concat(list(batches)).sort_values("seq").iterrows():
            now = km_between(row["lat"], row["lon"], lat, lon) <= km
            if math.isnan(last[0]):
                was = crossed = np.zeros(len(km), bool)
            else:
                was = km_between(last[0], last[1], lat, lon) <= km
                dx, dy = row["lat"] - last[0], row["lon"] - last[1]
                n = dx * dx + dy * dy
                t = np.clip(((lat - last[0]) * dx + (lon - last[1]) * dy) / n, 0, 1) if n else np.zeros(len(km))
                crossed = km_between(lat, lon, last[0] + t * dx, last[1] + t * dy) <= km
            for i, hook in enumerate(hooks):
                kind = "inside" if was[i] and now[i] else "exit" if was[i] else "enter" if now[i] else "cross" if crossed[i] else "outside"
                for said in {"enter": ("enter", "inside"), "exit": ("exit", "outside"), "cross": ("cross", "outside")}.get(kind, (kind,)):
                    if said in wanted:
                        out.append((key[0], int(row["seq"]), hook, said))
            last = (float(row["lat"]), float(row["lon"]))
        state.update(last)
        yield pd.DataFrame(out, columns=["id", "seq", "hook", "detect"])

    return changes.groupBy("id").applyInPandasWithState(step, EVENTS, "lat double, lon double", "append", GroupStateTimeout.NoTimeout)


def expiries(changes: DataFrame, ttl_ms: int, delay: str = "0 seconds") -> DataFrame:
    """Rows (id, gone) for objects of a stream (id string, ts timestamp) that were silent for ttl_ms in event time."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"id": [key[0]], "gone": [pd.Timestamp(last + ttl_ms, unit="ms")]})
            return
        newest = max(int(b["ts"].max().value // 1_000_000) for b in batches)
        if state.exists:
            newest = max(newest, state.get[0])
        state.update((newest,))
        state.setTimeoutTimestamp(max(newest + ttl_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"id": pd.Series([], dtype=str), "gone": pd.Series([], dtype="datetime64[ns]")})

    return changes.withWatermark("ts", delay).groupBy("id").applyInPandasWithState(step, "id string, gone timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def subscribed(messages: DataFrame, channels: list[str] = (), patterns: list[str] = ()) -> DataFrame:
    """Messages (channel, ..) of channels, or of those that match a pattern."""
    return messages.where(F.col("channel").isin(list(channels)) | globs.matches(F.col("channel"), list(patterns)) if patterns else F.col("channel").isin(list(channels)))


def latest(changes: DataFrame, path: str, checkpoint: str):
    """Upsert a change stream (id, seq, ..) into a Parquet table at `path`, one version a batch: path/version=n holds the state after batch n."""
    from ..operators.search import last_write

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if number:
            rows = rows.unionByName(spark.read.parquet(f"{path}/version={number - 1}"))
        last_write(rows.withColumn("deleted", F.lit(False)), ["id"]).select(*batch.columns).write.mode("overwrite").parquet(f"{path}/version={number}")

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
