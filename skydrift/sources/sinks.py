"""Writers: reports, flat tables, normalisation files, the embedding cache."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scans


def write_drift_report(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).json(path)


def write_stats_csv(df: DataFrame, path: str, digits: int = 3, mode: str = "error") -> None:
    cols = [F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(*cols).write.mode(mode).csv(path, header=True)


def write_normalization_config(stats: DataFrame, path: str, mode: str = "error") -> None:
    """``{band: {mean, std}}``; one entry per band, so one small row."""
    pairs = F.array_sort(F.collect_list(F.struct("band", F.struct("mean", "std"))))
    stats.agg(F.to_json(F.map_from_entries(pairs)).alias("value")).coalesce(1).write.mode(mode).text(path)


def save_embeddings(df: DataFrame, path: str, mode: str = "error") -> None:
    """Partitioned by domain and layer; rows are spread first, as one layer may hold most of them."""
    cols = df.select("item_id", F.col("embedding").cast("array<float>").alias("embedding"), "domain", "layer")
    cols.write.mode(mode).partitionBy("domain", "layer").parquet(path)


def write_bucketed(df: DataFrame, path: str, by: Sequence[str], buckets: int, table: str | None = None) -> DataFrame:
    """The table in ``buckets`` files by a hash of ``by``, registered under a name that keeps this; returns it.

    Two tables written with the same ``by`` (in their own names of it) and ``buckets``
    join on it without an exchange, and a grouping by it or by more needs none either.
    Views and labels that are read again and again are written so once: by the patch for
    label joins and per-patch statistics, by the whole pixel position for aligning views.
    """
    name = table or f"skydrift_{uuid.uuid4().hex}"
    by = list(by)
    df.repartition(buckets, *by).write.format("parquet").bucketBy(buckets, *by).sortBy(*by).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def cached_embeddings(spark: SparkSession, path: str, build: Callable[[], DataFrame], keys: Sequence[str] = ()) -> DataFrame:
    """Reuses the cache if it is there, else builds and stores it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        save_embeddings(build(), path)
    return scans.load_embeddings(spark, path)
