"""Tracks over a stream in two batches are those of the whole table."""

import pytest

from geoplane.operators.geodesics import track_lengths
from geoplane.streaming.tracks import stream_track_lengths

SCHEMA = "track string, seq int, lat double, lon double"


def test_tracks_go_on_over_batches(spark, tmp_path):
    rows = [("a", 1, 0.0, 0.0), ("a", 2, 1.0, 1.0), ("b", 1, 50.0, 0.0), ("a", 3, 2.0, 1.0), ("b", 2, 50.0, 10.0), ("b", 3, 50.0, 0.0)]
    points = spark.createDataFrame(rows, SCHEMA)
    want = {(r.track, r.seq): r.so_far for r in track_lengths(points, "track", ["seq"]).collect()}
    source = str(tmp_path / "in")
    got = {}
    for batch in (rows[:3], rows[3:]):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = stream_track_lengths(spark.readStream.schema(SCHEMA).parquet(source), "track", "seq")
        query = stream.writeStream.foreachBatch(lambda df, _: got.update({(r.track, r.seq): r.so_far for r in df.collect()})).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    assert got == {k: pytest.approx(v) for k, v in want.items()}
