"""Tracks that arrive as a stream: how far each has gone so far."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import geodesic
from ..functions.ellipsoid import WGS84, Ellipsoid


def stream_track_lengths(points: DataFrame, track: str, order: str, e: Ellipsoid = WGS84) -> DataFrame:
    """``points`` (track, order, lat, lon) with step and so_far, as ``track_lengths`` gives them for a table.

    Of each track the state holds its last point and the length up to it. Points are taken in order within a batch;
    those that come in a later batch go on from the last, so a stream must bring each track's points in order.
    """
    kinds = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    schema = f"{track} {kinds[track]}, {order} {kinds[order]}, lat double, lon double, step double, so_far double"

    def go_on(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        lat, lon, gone = state.get if state.exists else (float("nan"), float("nan"), 0.0)
        before = pd.DataFrame({"lat": [lat, *rows["lat"][:-1]], "lon": [lon, *rows["lon"][:-1]]})
        step = geodesic.inverse(before["lat"].to_numpy(), before["lon"].to_numpy(), rows["lat"].to_numpy(float), rows["lon"].to_numpy(float), e, ("s12",))["s12"]
        if not state.exists:
            step[0] = 0.0
        out = rows[[track, order, "lat", "lon"]].assign(step=step, so_far=gone + step.cumsum())
        state.update((float(rows["lat"].iloc[-1]), float(rows["lon"].iloc[-1]), float(out["so_far"].iloc[-1])))
        yield out

    return points.groupBy(track).applyInPandasWithState(go_on, schema, "lat double, lon double, so_far double", "append", GroupStateTimeout.NoTimeout)
