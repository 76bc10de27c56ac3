"""Tracking as a stateful stream: the state of each series is carried over micro-batches.

A frame may be split over micro-batches: its rows are held until a later frame of its series arrives, or the
time-out comes, and are linked then.  Frames that arrive after a later one has been linked are too late and are
dropped, as behind a watermark of one frame.  The state of a series ends with its time-out.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumenframe.operators.tracking import TrackingConfig, TrackState, advance, track_columns, track_schema


def link_stream(points: DataFrame, series: str, *, axes: tuple[str, ...] = ("x", "y"), config: TrackingConfig = TrackingConfig(), timeout_ms: int | None = None) -> DataFrame:
    """Tracks from a stream of centroid rows (series, frame, label, axes)."""
    config.validate()
    kind = dict(points.dtypes)[series]
    columns = [series, *track_columns(axes)]

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        last, state, waiting = pickle.loads(held.get[0]) if held.exists else (-(2**31), TrackState(), None)
        pdf = pd.concat([x for x in [waiting, *([] if held.hasTimedOut else batches)] if x is not None])
        pdf = pdf[pdf["frame"] > last].sort_values(["frame", "label"])
        newest = None if held.hasTimedOut or not len(pdf) else int(pdf["frame"].max())
        rows = []
        for frame, group in pdf.groupby("frame", sort=True):
            if frame != newest:
                rows += [(key[0], *r) for r in advance(state, int(frame), group["label"].astype(int).tolist(), group[list(axes)].to_numpy(float), config)]
                last = int(frame)
        if held.hasTimedOut:
            held.remove()
        else:
            held.update((pickle.dumps((last, state, pdf[pdf["frame"] == newest])),))
            if timeout_ms:
                held.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(rows, columns=columns)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout
    return points.select(series, "frame", "label", *axes).groupBy(series).applyInPandasWithState(step, f"`{series}` {kind}, {track_schema(axes)}", "state binary", "append", timeout)


