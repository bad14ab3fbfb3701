"""Class predictions of two views: flips, overlap, divergence, loss; model hooks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C
from ..functions import exprs, vec


def predictions_from_probs(df: DataFrame, probs: str = "probs", k: int = 3) -> DataFrame:
    top = exprs.top_k_classes(F.col(probs), k)
    return (
        df.withColumn("topk", top)
        .withColumn("predicted_class", F.col("topk")[0]["class"])
        .withColumn("probability", F.col("topk")[0]["p"])
    )


def array_overlap(a, b):
    """Number of classes two ranked lists share."""
    names = lambda c: F.transform(c, lambda s: s["class"])
    return F.size(F.array_intersect(names(a), names(b)))


def pair_predictions(df: DataFrame, a: str, b: str) -> DataFrame:
    side = lambda v, t: df.where(F.col("view") == v).select(
        "item_id", *[F.col(c).alias(f"{t}_{c}") for c in ("predicted_class", "probability", "topk")]
    )
    return side(a, "a").join(side(b, "b"), "item_id")


def class_drift(pairs: DataFrame, k: int = 3) -> DataFrame:
    """Flip, probability change (b minus a) and top-k overlap per item."""
    return pairs.select(
        "item_id", "a_predicted_class", "b_predicted_class",
        (F.col("a_predicted_class") != F.col("b_predicted_class")).alias("class_flip"),
        (F.col("b_probability") - F.col("a_probability")).alias("probability_change"),
        (array_overlap(F.col("a_topk"), F.col("b_topk")) / F.lit(float(k))).alias("top3_consistency"),
    )


def class_flip_summary(drift: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return drift.agg(
        n.alias("total_pairs"), F.count_if("class_flip").alias("class_flips_count"),
        F.coalesce(F.count_if("class_flip") / n, F.lit(0.0)).alias("class_flip_rate"),
        F.coalesce(F.avg("probability_change"), F.lit(0.0)).alias("avg_probability_change"),
        F.coalesce(F.max(F.abs("probability_change")), F.lit(0.0)).alias("max_probability_change"),
        F.coalesce(F.avg("top3_consistency"), F.lit(0.0)).alias("avg_top3_consistency"),
    )


def flipped_rows(drift: DataFrame) -> DataFrame:
    return drift.where("class_flip").select(
        "item_id", F.col("a_predicted_class").alias("from_class"), F.col("b_predicted_class").alias("to_class")
    )


def prediction_divergence(pairs: DataFrame, student: str, teacher: str, temperature: float = 4.0, mode: str = "kl",
                          valid=None, reduce: str = "mean") -> DataFrame:
    """Mean KL(teacher || student) * T^2 over rows, or logit MSE.

    With ``valid`` only those rows count and the denominator is at least 1.
    ``reduce='sum'`` returns the plain sum, for a batch-size denominator.
    """
    s, t = vec.as_double(student), vec.as_double(teacher)
    if mode == "mse":
        per = vec.sq_dist(s, t) / F.size(s)
    elif mode == "kl":
        ls, lt = vec.log_softmax(s, temperature), vec.log_softmax(t, temperature)
        per = vec.total(F.zip_with(ls, lt, lambda x, y: F.exp(y) * (y - x))) * F.lit(temperature**2)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    d = pairs.select(per.alias("_l"), (F.lit(True) if valid is None else valid).alias("_ok"))
    n = F.count_if("_ok")
    s_ok = F.sum(F.when(F.col("_ok"), F.col("_l")))
    value = s_ok if reduce == "sum" else (s_ok / F.greatest(n, F.lit(1)))
    return d.agg(n.alias("n"), F.coalesce(value, F.lit(0.0)).alias("divergence"))


def log_loss(df: DataFrame, logits: str, label: str, gamma: float = 0.0, alpha: Sequence[float] | None = None,
             ignore: int = C.IGNORE_LABEL) -> DataFrame:
    """Focal / weighted cross-entropy over valid rows; gamma 0 is cross-entropy.

    Averaged over rows, not over class weights.
    """
    logp = vec.log_softmax(vec.as_double(logits))
    ok = F.col(label) != ignore
    lp = F.get(logp, F.greatest(F.col(label), F.lit(0)))
    loss = -F.pow(1.0 - F.exp(lp), F.lit(float(gamma))) * lp
    if alpha is not None:
        w = F.array(*[F.lit(float(x)) for x in alpha])
        loss = loss * F.get(w, F.greatest(F.col(label), F.lit(0)))
    return df.agg(
        F.count_if(ok).alias("n"),
        (F.coalesce(F.sum(F.when(ok, loss)), F.lit(0.0)) / F.greatest(F.count_if(ok), F.lit(1))).alias("loss"),
    )


# --- model hooks ------------------------------------------------------------------------
def with_predictions(df: DataFrame, make_predict: Callable, features: str, width: int, k: int = 3, batch_size: int = 256) -> DataFrame:
    """Adds class, probability and top-k from a user model.

    ``make_predict`` loads the model once per worker and returns a function from
    a (batch, width) array to a (batch, classes) array of probabilities.
    """
    udf = predict_batch_udf(
        make_predict, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size, input_tensor_shapes=[[width]]
    )
    return predictions_from_probs(df.withColumn("probs", udf(F.col(features).cast("array<double>"))), "probs", k).drop("probs")


def with_embeddings(df: DataFrame, make_embed: Callable, features: str, width: int, keep: Sequence[str], dim: int,
                    batch_size: int = 256) -> DataFrame:
    """(keep..., layer, embedding) rows from a user encoder.

    The encoder returns a (batch, layers * dim) array, layers side by side.
    """
    udf = predict_batch_udf(
        make_embed, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size, input_tensor_shapes=[[width]]
    )
    flat = df.select(*keep, udf(F.col(features).cast("array<double>")).alias("_e"))
    layers = F.transform(
        F.sequence(F.lit(0), (F.size("_e") / dim).cast("int") - 1), lambda i: F.slice(F.col("_e"), i * dim + 1, dim)
    )
    return flat.select(*keep, F.posexplode(layers).alias("layer", "embedding"))


def with_segmentation(patches: DataFrame, segment: Callable, pixels: str = "pixels") -> DataFrame:
    """(patch_index, y, x, pred) rows from a user segmenter, one patch per call.

    ``segment`` maps a (height, width) array to a label map of the same shape; a
    batch of patches is processed at a time and nothing is grouped.
    """

    def run(batches):
        for pdf in batches:
            for idx, h, w, px in zip(pdf["patch_index"], pdf["height"], pdf["width"], pdf[pixels]):
                pred = np.asarray(segment(np.asarray(px, dtype="float64").reshape(h, w)))
                yy, xx = np.divmod(np.arange(h * w), w)
                yield pd.DataFrame({"patch_index": idx, "y": yy, "x": xx, "pred": pred.ravel()})

    return patches.select("patch_index", "height", "width", pixels).mapInPandas(run, "patch_index long, y int, x int, pred int")
