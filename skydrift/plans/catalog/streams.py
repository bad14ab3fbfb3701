"""Streams over the event log, and the model hooks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ...operators import prediction as Q
from ...streaming import monitors as Mo
from .. import adapters as A
from ..adapters import r, rnd, with_ctes
from ..registry import query

WINDOW, LATE = "1 hour", "10 minutes"

# a window is final once the newest event is later than its end by the watermark delay
_CLOSED = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"
_WIN = f"""SELECT * FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS w, event_type AS band, count(value) AS n, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, max(value) AS max, quantile_disc(value, 0.02) AS p2, quantile_disc(value, 0.98) AS p98
    FROM events GROUP BY 1, 2) WHERE w + INTERVAL 1 HOUR <= {_CLOSED}"""


def events_stream(spark, sf):
    schema = A.table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf).select(
        "event_id", "user_id", "ts", F.col("event_type").alias("band"), "value", F.get_json_object("props", "$.k").cast("int").alias("k")
    )


def _text(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


@query("stream_band_stats", f"""
    SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, band, n, {r('mean')} AS mean, {r('std')} AS std, {r('min')} AS min, {r('max')} AS max, {r('p2')} AS p2, {r('p98')} AS p98 FROM ({_WIN})""")
def stream_band_stats(spark, sf):
    s = Mo.run_to_table(Mo.stream_band_stats(events_stream(spark, sf), WINDOW, LATE), "band-stats")
    return A.rounded(s.select(_text("window_start"), "band", "n", "mean", "std", "min", "max", "p2", "p98"))


@query("stream_drift_monitor", f"""
    SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, band, n, {r('x.mean - b.mean')} AS mean_diff, {r('(x.mean - b.mean) / b.mean * 100')} AS mean_pct_change, {r('x.std - b.std')} AS std_change,
           abs((x.mean - b.mean) / b.mean * 100) > 10 AS drifted FROM ({_WIN}) x JOIN (SELECT event_type AS band, avg(value) AS mean, stddev_pop(value) AS std FROM events GROUP BY 1) b USING (band)""")
def stream_drift_monitor(spark, sf):
    base = A.table(spark, sf, "events").groupBy(F.col("event_type").alias("band")).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    m = Mo.stream_drift_monitor(Mo.stream_band_stats(events_stream(spark, sf), WINDOW, LATE), base)
    d = Mo.run_to_table(m, "drift-monitor")
    return A.rounded(d.select(_text("window_start"), "band", "n", "mean_diff", "mean_pct_change", "std_change", "drifted"))


@query("stream_prediction_drift", f"""
    SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, pairs, flips, {r('flips / pairs')} AS flip_rate FROM (
        SELECT time_bucket(INTERVAL 1 HOUR, ts) AS w, count(*) AS pairs, count(*) FILTER (WHERE k % 7 = 0 AND k % 4 <> 0) AS flips
        FROM (SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events) GROUP BY 1)
    WHERE w + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 20 MINUTE FROM events)""")
def stream_prediction_drift(spark, sf):
    """Two feeds of the same items, the second up to nine minutes later.

    A window is final when neither feed can add to it: the watermark delay and
    the join bound have both passed.
    """
    a = events_stream(spark, sf).select(F.col("event_id").alias("item_id"), "ts", (F.col("k") % 4).alias("predicted_class"))
    later = F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("k") % 10, F.lit(0))
    b = events_stream(spark, sf).select(F.col("event_id").alias("item_id"), later.alias("ts"), F.when(F.col("k") % 7 == 0, 0).otherwise(F.col("k") % 4).alias("predicted_class"))
    d = Mo.run_to_table(Mo.stream_prediction_drift(a, b), "prediction-drift")
    return A.rounded(d.select(_text("window_start"), "pairs", "flips", "flip_rate"))


@query("stream_run_refresh", f"""
    SELECT band AS init, 'clean' AS train_variant, 'psf_l' || (k % 4 + 1) AS variant, 'psf' AS factor, (k % 4 + 1)::INT AS level, count(*) AS n_seeds, {r('avg(value)')} AS mean,
           {r('coalesce(stddev_samp(value), 0)')} AS std, {r('min(value)')} AS min, {r('max(value)')} AS max
    FROM (SELECT event_type AS band, value, json_extract_string(props, '$.k')::INT AS k FROM events) GROUP BY ALL""")
def stream_run_refresh(spark, sf):
    rows = events_stream(spark, sf).select(
        F.col("band").alias("init"), F.lit("clean").alias("train_variant"), F.concat(F.lit("psf_l"), (F.col("k") % 4 + 1).cast("string")).alias("variant"), "user_id",
        F.col("value").alias("test_iou_water"), F.col("value").alias("test_iou"), F.lit(0.5).alias("severity"),
    )
    t = Mo.stream_run_refresh(spark, rows)
    return A.rounded(t.select("init", "train_variant", "variant", "factor", "level", "n_seeds", "mean", "std", "min", "max"))


# --- model hooks ------------------------------------------------------------------------
def _softmax_model():
    def predict(x: np.ndarray) -> np.ndarray:
        z = np.stack([x[:, k::10].sum(axis=1) for k in range(10)], axis=1) * 20.0
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    return predict


@query("with_predictions", with_ctes("top3", f"SELECT item_id, predicted_class, classes[2] AS second_class, {r('probability')} AS probability FROM top3 WHERE view = 'a'"))
def with_predictions(spark, sf):
    v = A.vectors(spark, sf).select("item_id", F.col("a").alias("features"))
    p = Q.with_predictions(v, _softmax_model, "features", 64)
    return p.select("item_id", "predicted_class", F.col("topk")[1]["class"].alias("second_class"), rnd("probability").alias("probability"))


def _two_layers():
    return lambda x: np.concatenate([x[:, :32] * 2.0, x[:, 32:] + 1.0], axis=1)


@query("with_embeddings", with_ctes("vectors", f"SELECT item_id, unnest([0, 1])::INT AS layer, {r('unnest([list_sum([x * 2 FOR x IN a[1:32]]), list_sum([x + 1 FOR x IN a[33:64]])])')} AS total FROM vectors"))
def with_embeddings(spark, sf):
    from ...functions import vec

    v = A.vectors(spark, sf).select("item_id", F.col("a").alias("features"))
    e = Q.with_embeddings(v, _two_layers, "features", 64, ["item_id"], 32)
    return A.rounded(e.select("item_id", "layer", vec.total(F.col("embedding")).alias("total")))


@query("with_segmentation", with_ctes("vectors", "SELECT patch_index, (i // 8)::INT AS y, (i % 8)::INT AS x, (v > m)::INT AS pred FROM (SELECT item_id AS patch_index, unnest(range(0, 64)) AS i, unnest(a) AS v, list_sum(a) / 64 AS m FROM vectors)"))
def with_segmentation(spark, sf):
    p = A.vectors(spark, sf).select(F.col("item_id").alias("patch_index"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.col("a").alias("pixels"))
    return Q.with_segmentation(p, lambda img: (img > img.mean()).astype("int32"))
