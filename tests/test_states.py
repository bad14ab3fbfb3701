"""Stored states: percentiles from merged sketches, windows of a stream, a running table that stops and starts again."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from skydrift.operators import bands, runs
from skydrift.streaming import monitors


@pytest.fixture(scope="module")
def pixels(spark):
    """A band of 200,000 values, one of a few, one without any."""
    many = spark.range(200_000, numPartitions=6).select(F.lit("a").alias("view"), F.lit("x").alias("band"), (F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 7.0).alias("value"), (F.col("id") % 9).alias("part"))
    few = spark.createDataFrame([("a", "y", float(i), i % 9) for i in range(100)] + [("a", "z", None, 1)], "view string, band string, value double, part long")
    return many.unionByName(few)


@pytest.mark.parametrize("k", [200, 4096])
def test_percentiles_of_merged_states_keep_their_rank(spark, pixels, tmp_path, k):
    bands.band_moments(pixels, ["view", "band", "part"], k=k).write.parquet(str(tmp_path / "state"))
    got = {r.band: r for r in bands.finish_moments(bands.merge_band_moments(spark.read.parquet(str(tmp_path / "state")))).collect()}
    v = np.array([r[0] for r in pixels.where("band = 'x'").select("value").collect()])
    for p, q in ((0.02, got["x"].p2), (0.98, got["x"].p98)):
        assert abs((v <= q).mean() - p) <= bands.rank_error(k)
    assert (got["y"].p2, got["y"].p98, got["y"].n) == (1.0, 97.0, 100)
    assert "z" not in got
    empty = {r.band: r for r in bands.finish_moments(bands.band_moments(pixels, k=k)).collect()}["z"]
    assert (empty.n, empty.p2, empty.std) == (0, None, 0.0)
    held = bands.percentile_ranks(pixels, bands.approx_band_percentiles(pixels, ["band"], [0.02, 0.98], k=k), ["band"], [0.02, 0.98], error=bands.rank_error(k)).collect()
    assert {r.band for r in held} == {"x", "y"} and all(r.p2_within and r.p98_within for r in held)


def events(day, hours):
    return [(dt.datetime(2024, 1, day, h, m), "b", float(h * 100 + m)) for h in hours for m in range(60)]


def test_windows_have_percentiles_and_drop_late_rows(spark, tmp_path):
    schema = "ts timestamp, band string, value double"
    for i, rows in enumerate([events(1, [0, 1, 2]), events(1, [5]), [(dt.datetime(2024, 1, 1, 0, 5), "b", 9e9)] + events(1, [9])]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/part={i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    out = {r.window_start.hour: r for r in monitors.run_to_table(monitors.stream_band_stats(stream, k=4096), "windows").collect()}
    assert sorted(out) == [0, 1, 2, 5]
    for h, r in out.items():
        assert (r.n, r.p2, r.p98, r.max) == (60, h * 100 + 1.0, h * 100 + 58.0, h * 100 + 59.0)


ROW = "init string, train_variant string, variant string, test_iou_water double, test_iou double, severity double"


def ladder(i):
    rng = np.random.default_rng(i)
    return [("distilled" if j % 3 else "scratch", "clean", f"psf_l{j % 4 + 1}", None if j % 11 == 0 else 1e6 + float(rng.normal()), float(rng.normal()), j / 40) for j in range(40)] + [("scratch", "clean", f"snr_l{i + 1}", 0.5, None, None)]


def test_running_table_restarts_from_its_state(spark, tmp_path):
    feed, base = tmp_path / "in", str(tmp_path / "base")
    add = lambda i: spark.createDataFrame(ladder(i), ROW).coalesce(1).write.parquet(str(feed / f"part={i}"))
    stream = lambda: spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(str(feed / "*"))
    add(0), add(1)
    monitors.RunningTable(spark, base).run(stream())
    # the rows of the first run are gone: what follows can only come from the state
    add(2)
    seen = []
    again = monitors.RunningTable(spark, base)
    merge = again.add
    again.add = lambda batch, epoch: (seen.append(batch.count()), merge(batch, epoch))
    got = again.run(stream())
    assert seen == [41] and again.versions() == [1, 2]
    want = runs.ladder_summary(spark.createDataFrame([r for i in range(3) for r in ladder(i)], ROW))
    key = lambda r: (r.init, r.variant)
    a, b = (sorted(d.collect(), key=key) for d in (got, want))
    assert [key(r) for r in a] == [key(r) for r in b] and got.columns == want.columns
    for x, y in zip(a, b):
        for c in got.columns:
            assert getattr(x, c) == (pytest.approx(getattr(y, c), rel=1e-9, abs=1e-7) if isinstance(getattr(y, c), float) else getattr(y, c)), c


def test_replayed_batch_counts_once(spark, tmp_path):
    t = monitors.RunningTable(spark, str(tmp_path / "base"))
    with pytest.raises(ValueError, match="no state"):
        t.table()
    one, two = (spark.createDataFrame(ladder(i), ROW) for i in range(2))
    t.add(one, 0), t.add(two, 1), t.add(two, 1)
    n = t.table().agg(F.sum("n_seeds")).first()[0]
    assert n == sum(r[3] is not None for i in range(2) for r in ladder(i))
