"""Drift monitors on streams, built from watermarked windows and stream joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs
from ..operators import bands, runs
from ..session import shared_dir


def event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Watermarks need TIMESTAMP; zone-free times are taken as the session's zone."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def stream_band_stats(stream: DataFrame, window: str = "1 hour", watermark: str = "10 minutes", slide: str | None = None,
                      keys: tuple[str, ...] = ("band",), ts: str = "ts", value: str = "value", probs: tuple[float, ...] = (0.02, 0.98), k: int = bands.SKETCH) -> DataFrame:
    """Windowed n, mean, population std, min, max and percentiles per key.

    State is a few numbers and a quantile sketch of at most about three times ``k``
    numbers per open window; percentiles are exact up to ``k`` rows of a window, and
    within ``bands.rank_error(k)`` of the rank beyond. Rows later than the watermark
    are dropped.
    """
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    g = event_time(stream, ts).withWatermark(ts, watermark).groupBy(w, *keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"),
        bands.quantile_sketch(value, k).alias("_s"),
    )
    pct = [bands.sketch_quantile("_s", p).alias(f"p{p * 100:g}") for p in probs]
    return g.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "n", "mean", "std", "min", "max", *pct)


def stream_drift_monitor(stats: DataFrame, baseline: DataFrame, threshold_pct: float = 10.0, key: str = "band") -> DataFrame:
    """Windowed statistics against a fixed baseline (key, mean, std)."""
    b = baseline.select(key, F.col("mean").alias("base_mean"), F.col("std").alias("base_std"))
    j = stats.join(b, key)
    pct = exprs.percent_change(F.col("base_mean"), F.col("mean"))
    return j.select(
        "window_start", key, "n", (F.col("mean") - F.col("base_mean")).alias("mean_diff"), pct.alias("mean_pct_change"),
        (F.col("std") - F.col("base_std")).alias("std_change"), (F.abs(pct) > threshold_pct).alias("drifted"),
    )


def stream_prediction_drift(a: DataFrame, b: DataFrame, bound: str = "10 minutes", watermark: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Flip rate per window of two prediction feeds (item_id, ts, predicted_class).

    A prediction meets its counterpart when both arrive within ``bound`` of one
    another; that bound is also what lets old state be dropped.
    """
    l = event_time(a).select(F.col("item_id").alias("a_item"), F.col("ts").alias("a_ts"), F.col("predicted_class").alias("a_class"))
    r = event_time(b).select(F.col("item_id").alias("b_item"), F.col("ts").alias("b_ts"), F.col("predicted_class").alias("b_class"))
    l, r = l.withWatermark("a_ts", watermark), r.withWatermark("b_ts", watermark)
    near = (F.col("b_ts") >= F.col("a_ts") - F.expr(f"INTERVAL {bound}")) & (F.col("b_ts") <= F.col("a_ts") + F.expr(f"INTERVAL {bound}"))
    j = l.join(r, (F.col("a_item") == F.col("b_item")) & near)
    g = j.groupBy(F.window("a_ts", window)).agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("a_class") != F.col("b_class")).alias("flips")
    )
    return g.select(F.col("window.start").alias("window_start"), "pairs", "flips", (F.col("flips") / F.col("pairs")).alias("flip_rate"))


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process what is available, into a parquet table in the shared folder, and read it."""
    spark = stream.sparkSession
    base = shared_dir(spark, name)
    q = (
        stream.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/table").option("checkpointLocation", f"{base}/log")
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/table")


class RunningTable:
    """A ladder table kept current from mergeable states: a batch reads its own rows and the last state, never older rows.

    ``base`` is a folder that the caller names, on storage that all executors see; a
    later process that names it again goes on from there. Every micro-batch writes
    ``state/version=<batch>``: n, mean, m2, min and max of each cell, merged from the
    batch and the state before it. A batch replayed after a failure finds the state
    that it started from and writes the same version again, so nothing counts twice.
    Versions before the last two are deleted.
    """

    def __init__(self, spark: SparkSession, base: str, metric: str = "test_iou_water"):
        self.spark, self.base, self.metric = spark, base.rstrip("/"), metric

    def _folder(self) -> tuple:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/state")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def versions(self) -> list[int]:
        """Completed versions, oldest first."""
        fs, path = self._folder()
        if not fs.exists(path):
            return []
        done = [x.getPath() for x in fs.listStatus(path) if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS"))]
        return sorted(int(p.getName().split("=")[1]) for p in done)

    def _read(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.base}/state/version={version}")

    def add(self, batch: DataFrame, epoch: int) -> None:
        """Merges one micro-batch into the state."""
        before = [v for v in self.versions() if v < epoch]
        state = runs.ladder_state(batch, self.metric)
        if before:
            state = runs.merge_ladder_states(state.unionByName(self._read(before[-1])))
        state.write.mode("overwrite").parquet(f"{self.base}/state/version={epoch}")
        fs, path = self._folder()
        for v in before[:-1]:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path, f"version={v}"), True)

    def run(self, rows: DataFrame) -> DataFrame:
        """Takes in what the stream has since the last call and returns the current table."""
        q = rows.writeStream.foreachBatch(self.add).option("checkpointLocation", f"{self.base}/log").trigger(availableNow=True).start()
        q.awaitTermination()
        return self.table()

    def table(self) -> DataFrame:
        versions = self.versions()
        if not versions:
            raise ValueError(f"{self.base} has no state yet")
        return runs.finish_ladder_states(self._read(versions[-1]))


def stream_run_refresh(spark: SparkSession, rows: DataFrame, name: str = "ladder", metric: str = "test_iou_water", base: str | None = None) -> DataFrame:
    """The ladder table of all run rows that have arrived, through :class:`RunningTable` in ``base`` or a fresh folder."""
    return RunningTable(spark, base or shared_dir(spark, name), metric).run(rows)
