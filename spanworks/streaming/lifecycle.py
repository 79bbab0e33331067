"""Event-time windows and stateful anchors, for streams and tables alike."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.state import ACTIONS, NEW_ANCHOR, fold_anchor


def _timed(events: DataFrame, late: str) -> DataFrame:
    """Streams get a watermark, which wants instants; tables stay as they are."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, event_type, n, total) in tumbling windows. A watermark bounds the state on a stream; tables ignore it."""
    marked = _timed(events, late)
    found = marked.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return found.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "1 hour", late: str = "2 days") -> DataFrame:
    """(user_id, start, end, n) of sessions that a gap ends."""
    marked = _timed(events, late)
    found = marked.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def anchor_stream(events: DataFrame, key: str = "user_id") -> DataFrame:
    """The anchor lifecycle on a stream: keyed state, of one small row an anchor, updated batch by batch."""
    names = list(NEW_ANCHOR)

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = dict(zip(names, state.get)) if state.exists else dict(NEW_ANCHOR)
        for rows in batches:
            for event in rows.sort_values(["ts", "event_id"])["event_type"]:
                now = fold_anchor(now, ACTIONS.get(event, "observe"))
        state.update(tuple(now[n] for n in names))
        yield pd.DataFrame([{key: name[0], **now}])

    fields = "state string, pinned boolean, useful long, ignored long, seen long"
    return events.select(key, "ts", "event_id", "event_type").groupBy(key).applyInPandasWithState(step, f"{key} long, {fields}", fields, "update", GroupStateTimeout.NoTimeout)
