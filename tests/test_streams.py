"""Engines on streams give what they give on a batch."""

import random

import pytest
from pyspark.sql import functions as F

from wayfold.engines import registry
from wayfold.operators import evaluate
from wayfold.sources import telemetry
from wayfold.streaming import engines, folds, views


def inputs(spark):
    r = random.Random(6)
    names = [n for n in registry.SENSORS if not n.startswith(("quat", "linear"))]
    samples = [(s, 100_000_000 * i, *(r.gauss(0, 0.4) + (9.81 if n == "accel_z" else 0) for n in names)) for s in (1, 2, 3, 4, 5) for i in range(1, 90 if s < 5 else 20)]
    fixes = [(s, 1000 * i, 48.0 + i / 90_000, 11.0 + s / 100_000, 8.0, 5.0, 4.0 if i % 4 else 60.0) for s in (1, 2, 3) for i in range(1, 9)]
    samples = spark.createDataFrame(samples, "session_id long, timestamp_nanos long, " + ", ".join(f"{n} double" for n in names))
    gps = spark.createDataFrame(fixes, "session_id long, t_ms long, lat double, lon double, speed double, bearing double, accuracy double")
    seeds = spark.createDataFrame([(s, 48.0, 11.0, 10.0 * s, 5.0, 0) for s in range(1, 6)], "session_id long, lat double, lon double, bearing double, speed double, boot_offset_ms long")
    changes = spark.createDataFrame([(2, 3000, [(48.0, 11.0), (48.001, 11.0002)])], "session_id long, t_ms long, points array<struct<lat:double,lon:double>>")
    resets = spark.createDataFrame([(3, 4000, 48.0005, 11.0, 0.0, 2.0)], "session_id long, t_ms long, lat double, lon double, bearing double, speed double")
    return samples, seeds, gps, changes, resets


@pytest.mark.parametrize("engine", ["fusion", "iekf"])
def test_stream_is_the_batch(spark, tmp_path, engine):
    samples, seeds, gps, changes, resets = inputs(spark)
    rows = registry.event_rows(samples, seeds, gps, changes=changes, resets=resets)
    rows = rows.withColumn("event_time", F.timestamp_millis(F.greatest("t_ms", F.lit(1)))).cache()
    # Files of three seconds each, rows of any order within; some come up to a second late.
    early = F.when(F.col("kind") == registry.FIX, F.col("t_ms") + 900).otherwise(F.col("t_ms"))
    for k in range(4):
        part = rows.where(F.floor(early / 3000) == k).orderBy(F.xxhash64("session_id", "t_ms", "kind"))
        part = part if k < 3 else part.union(rows.where("session_id = 1 and kind = 3 and t_ms = 100"))  # one far too late
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = engines.run_stream(stream, engine, blocks=3).writeStream.format("memory").queryName(f"made_{engine}").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    names = ["session_id", "timestamp_nanos", "dr_lat", "dr_lon", "heading_deg", "confidence_m", "snap_mode", "stationary", "gnss_rejects", "steps"]
    pick = lambda df: sorted(map(tuple, df.select(*(F.round(n, 9).alias(n) if n in ("dr_lat", "dr_lon", "heading_deg", "confidence_m") else n for n in names)).collect()))
    got = pick(spark.table(f"made_{engine}"))
    whole = pick(registry.run(samples, seeds, gps, engine, "fused", changes=changes, resets=resets))
    # All but the last two seconds, which wait for what may still come.
    last = 8_900 - 2000
    assert got == [r for r in whole if r[1] // 1_000_000 <= last] and len(got) > 250
    assert folds.late_rows(query) == 1


def test_live_view_is_renewed_at_each_trigger(spark, tmp_path):
    schema = "session_id long, t_ms long, lat double"
    add = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    folder = str(tmp_path / "view")
    assert views.read_view(spark, folder) is None
    add([(1, 5, 48.0), (1, 9, 48.1), (2, 3, 49.0)])
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = views.live_view(stream, folder, ["session_id"], ["t_ms"]).option("checkpointLocation", str(tmp_path / "state")).start()
    state = lambda: sorted(map(tuple, views.read_view(spark, folder).collect()))
    query.processAllAvailable()
    assert state() == [(1, 9, 48.1, 2), (2, 3, 49.0, 1)]
    add([(1, 7, 0.0), (2, 4, 49.5)])  # the first comes late and changes nothing but the count
    query.processAllAvailable()
    assert state() == [(1, 9, 48.1, 3), (2, 4, 49.5, 2)]
    add([(3, 1, 50.0)])
    query.processAllAvailable()
    query.stop()
    assert state() == [(1, 9, 48.1, 3), (2, 4, 49.5, 2), (3, 1, 50.0, 1)] and len(views.versions(spark, folder)) == 2


def test_exported_csv_reads_back(spark, tmp_path):
    rows = [(1, "gps", 48.0, None, float("nan"), "a,\"b\""), (2, "dr", None, 49.25, None, "two\nlines")]
    table = spark.createDataFrame(rows, "session_id long, row_kind string, gps_lat double, dr_lat double, position_error_m double, note string")
    evaluate.write_csv(table, str(tmp_path / "nav"))
    lines = "".join(p.read_text() for p in sorted((tmp_path / "nav").glob("part-*")))
    assert "NaN" in lines and lines.startswith("session_id,row_kind,gps_lat,dr_lat,position_error_m,note")
    back = evaluate.read_csv(spark, str(tmp_path / "nav"), table.schema)
    assert sorted(map(repr, map(tuple, back.collect()))) == sorted(map(repr, rows))


def test_sources_read_and_stream_the_same(spark, tmp_path):
    fixes = [
        '{"session_id": 1, "timestamp_ms": 5, "latitude": 48.0, "longitude": 11.0, "speed": 3.5, "bearing": 90, "accuracy": 4}',
        '{"session_id": 1, "timestamp_ms": 6, "latitude": 48.0, "longitude": 11.0, "speed": -1, "bearing": 400, "accuracy": 0, "new": 1}',
        '{"session_id": 1, "timestamp_ms": 7, "latitude": 148.0, "longitude": 11.0}', "not json",
    ]
    (tmp_path / "gps").mkdir()
    (tmp_path / "gps" / "a.json").write_text("\n".join(fixes))
    pick = lambda df: sorted(map(tuple, df.select("t_ms", "lat", "speed", "bearing", "accuracy").collect()))
    assert pick(telemetry.gps_source(spark, str(tmp_path / "gps"))) == [(5, 48.0, 3.5, 90.0, 4.0), (6, 48.0, None, None, None)]
    query = telemetry.gps_source(spark, str(tmp_path / "gps"), stream=True).writeStream.format("memory").queryName("fixes").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert pick(spark.table("fixes")) == pick(telemetry.gps_source(spark, str(tmp_path / "gps")))
    (tmp_path / "imu").mkdir()
    (tmp_path / "imu" / "a.json").write_text('{"session_id": 1, "timestamp_nanos": 9, "accel_x": 0.5, "quat_w": 1.0}')
    row = telemetry.imu_source(spark, str(tmp_path / "imu")).first()
    assert (row["timestamp_nanos"], row["accel_x"], row["quat_w"], row["mag_x"]) == (9, 0.5, 1.0, None)


def test_route_cache_is_replaced(spark, tmp_path):
    folder, schema = str(tmp_path / "cache"), "start array<double>, destination array<double>, source string, timestamp long, points array<array<double>>"
    for points in ([[48.0, 11.0], [48.1, 11.1]], [[48.0, 11.0], [48.2, 11.2], [48.3, 11.3]]):
        telemetry.save_routes(spark.createDataFrame([([48.0, 11.0], [1.0, 2.0], "s", 5, points)], schema), folder)
        read = telemetry.read_routes(spark, folder).select(telemetry.cached_route(F.col("json"), (48.001, 11.0), (1.0, 2.0)).alias("p")).collect()
        assert [r["p"] for r in read] == [points]
    assert [p.name for p in tmp_path.iterdir()] == ["cache"]
