"""A streaming form of trace reconstruction: a trace is finished when no span has come for a while."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FINISHED = "trace_id string, spans long, start long, end long, route string"


def windowed_counts(spans: DataFrame, time: str, key: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Spans by window and key; rows later than the watermark are left out of closed windows."""
    return spans.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("spans")).select(F.col("window.start").alias("start"), key, "spans")


def finished_traces(spans: DataFrame, time: str, late: str = "10 minutes", idle_ms: int = 60_000) -> DataFrame:
    """One row for each trace that has been idle for ``idle_ms`` of event time.

    ``spans``: trace_id, span_id, name, start (long), end (long) and ``time``. State is the trace's spans until then.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (rows,) = state.get
            found = sorted({tuple(r) for r in rows})
            state.remove()
            yield pd.DataFrame([(key[0], len(found), min(r[0] for r in found), max(r[3] for r in found), ">".join(r[2] for r in found))], columns=["trace_id", "spans", "start", "end", "route"])
            return
        rows = list(state.get[0]) if state.exists else []
        newest = 0
        for pdf in batches:
            rows += list(zip(pdf["start"].tolist(), pdf["span_id"].tolist(), pdf["name"].tolist(), pdf["end"].tolist()))
            newest = max(newest, int(pdf[time].max().timestamp() * 1000))
        state.update((rows,))
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame(columns=["trace_id", "spans", "start", "end", "route"])

    kept = spans.withWatermark(time, late).groupBy("trace_id")
    return kept.applyInPandasWithState(fold, FINISHED, "rows array<struct<start: long, span_id: string, name: string, end: long>>", "append", GroupStateTimeout.EventTimeTimeout)
