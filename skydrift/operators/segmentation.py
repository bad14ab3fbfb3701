"""Label-map quality and drift. Every metric derives from one confusion table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import order


def confusion_matrix(df: DataFrame, keys: Sequence[str] = (), label: str = "label", pred: str = "pred", ignore: int = C.IGNORE_LABEL) -> DataFrame:
    """Counts by (label, pred) over rows with a valid label."""
    return (
        df.where(F.col(label) != ignore)
        .groupBy(*keys, F.col(label).alias("label"), F.col(pred).alias("pred"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _safe(num, den):
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def binary_from_counts(tp, fp, fn, tn) -> dict:
    """iou, dice, accuracy, f1_score; an empty denominator gives 0."""
    precision, recall = _safe(tp, tp + fp), _safe(tp, tp + fn)
    return {
        "iou": _safe(tp, tp + fp + fn),
        "dice": _safe(2 * tp, 2 * tp + fp + fn),
        "accuracy": _safe(tp + tn, tp + fp + fn + tn),
        "f1_score": _safe(2 * precision * recall, precision + recall),
    }


def binary_metrics(cm: DataFrame, keys: Sequence[str] = (), positive: int = 1) -> DataFrame:
    y, p, n = F.col("label") == positive, F.col("pred") == positive, F.col("n")
    count = lambda cond, name: F.coalesce(F.sum(F.when(cond, n)), F.lit(0)).alias(name)
    g = cm.groupBy(*keys).agg(count(y & p, "tp"), count(~y & p, "fp"), count(y & ~p, "fn"), count(~y & ~p, "tn"))
    m = binary_from_counts(*[F.col(c) for c in ("tp", "fp", "fn", "tn")])
    return g.select(*keys, "tp", "fp", "fn", "tn", *[v.alias(k) for k, v in m.items()])


def segmentation_drift(df: DataFrame, keys: Sequence[str] = ("patch_index",), label: str = "label", a: str = "pred_a",
                       b: str = "pred_b", positive: int = 1, ignore: int = C.IGNORE_LABEL) -> DataFrame:
    """Binary metrics of a and of b against truth, a against b, and b minus a.

    Three confusion tables from one scan and one shuffle. The agreement compares
    the two predictions on all rows, valid or not.
    """
    ok = F.col(label) != ignore
    is_ = lambda c: F.col(c) == positive
    aggs = []
    for t, (truth, guess, where) in {"a": (label, a, ok), "b": (label, b, ok), "ab": (a, b, F.lit(True))}.items():
        y, p = is_(truth), is_(guess)
        for name, cond in (("tp", y & p), ("fp", ~y & p), ("fn", y & ~p), ("tn", ~y & ~p)):
            aggs.append(F.count_if(cond & where).alias(f"{t}_{name}"))
    g = df.groupBy(*keys).agg(*aggs)
    m = {t: binary_from_counts(*[F.col(f"{t}_{c}") for c in ("tp", "fp", "fn", "tn")]) for t in ("a", "b", "ab")}
    names = {"iou": "iou", "dice": "dice", "accuracy": "accuracy", "f1_score": "f1"}
    return g.select(
        *keys,
        *[m["a"][k].alias(f"raw_{s}") for k, s in names.items()],
        *[m["b"][k].alias(f"simulated_{s}") for k, s in names.items()],
        m["ab"]["iou"].alias("agreement_iou"), m["ab"]["dice"].alias("agreement_dice"),
        *[(m["b"][k] - m["a"][k]).alias(f"{s}_drift") for k, s in names.items()],
    )


def segmentation_drift_summary(drift: DataFrame) -> DataFrame:
    """Means, population stds, mean and largest absolute drift, mean and least agreement."""
    z = lambda c, n: F.coalesce(c, F.lit(0.0)).alias(n)
    aggs = [F.count(F.lit(1)).alias("total_pairs")]
    for side in ("raw", "simulated"):
        for m in ("iou", "dice", "f1"):
            aggs += [z(F.avg(f"{side}_{m}"), f"avg_{side}_{m}"), z(F.stddev_pop(f"{side}_{m}"), f"std_{side}_{m}")]
    for m in ("iou", "dice", "f1"):
        aggs += [z(F.avg(f"{m}_drift"), f"avg_{m}_drift"), z(F.max(F.abs(f"{m}_drift")), f"max_{m}_drift")]
    aggs += [z(F.avg("agreement_iou"), "avg_prediction_agreement"), z(F.min("agreement_iou"), "min_prediction_agreement")]
    return drift.agg(*aggs)


def per_class_iou(cm: DataFrame, keys: Sequence[str] = (), classes: Sequence[int] | None = None) -> DataFrame:
    """IoU, F1 and label support per class; IoU is null for an empty union.

    ``classes`` lists classes that must appear even without a pixel.
    """
    k = list(keys)
    side = F.explode(
        F.array(
            F.struct(F.col("label").alias("c"), F.col("n").alias("support"), F.lit(0).cast("long").alias("guessed"),
                     F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0).alias("hit")),
            F.struct(F.col("pred").alias("c"), F.lit(0).cast("long").alias("support"), F.col("n").alias("guessed"),
                     F.lit(0).cast("long").alias("hit")),
        )
    )
    t = cm.select(*k, side.alias("s")).groupBy(*k, F.col("s.c").alias("class")).agg(
        F.sum("s.support").alias("support"), F.sum("s.guessed").alias("guessed"), F.sum("s.hit").alias("hit")
    )
    if classes is not None:
        lst = F.explode(F.array(*[F.lit(int(c)) for c in classes])).alias("class")
        grid = cm.select(*k).distinct().select(*k, lst) if k else cm.limit(1).select(lst)
        t = order.join_null_safe(grid, t, [*k, "class"], "left").select(
            *k, "class", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("support", "guessed", "hit")]
        )
    union = F.col("support") + F.col("guessed") - F.col("hit")
    return t.select(
        *k, "class", "support",
        F.when(union > 0, F.col("hit") / union).alias("iou"),
        F.when(union > 0, 2.0 * F.col("hit") / (F.col("support") + F.col("guessed"))).alias("f1"),
    )


def mean_iou(per_class: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Macro mean over classes that occur in truth or prediction."""
    return per_class.groupBy(*keys).agg(F.coalesce(F.avg("iou"), F.lit(0.0)).alias("mean_iou"))


def mean_iou_fixed(per_class: DataFrame, n_classes: int, keys: Sequence[str] = ()) -> DataFrame:
    """Macro mean with a constant denominator; classes that do not occur count as 0."""
    return per_class.groupBy(*keys).agg((F.coalesce(F.sum("iou"), F.lit(0.0)) / F.lit(float(n_classes))).alias("mean_iou_fixed"))


def accuracy(cm: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    hit = F.sum(F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0))
    return cm.groupBy(*keys).agg((hit / F.sum("n")).alias("accuracy"))


def macro_f1(per_class: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return per_class.groupBy(*keys).agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"))


def domain_gap_iou(cm: DataFrame, source: str, target: str, view: str = "view") -> DataFrame:
    """Mean IoU on the source view minus that on the target view."""
    m = mean_iou(per_class_iou(cm, [view]), [view])
    return m.agg(
        F.max(F.when(F.col(view) == source, F.col("mean_iou"))).alias("source_iou"),
        F.max(F.when(F.col(view) == target, F.col("mean_iou"))).alias("target_iou"),
    ).withColumn("domain_gap_iou", F.col("source_iou") - F.col("target_iou"))


def per_scene_iou(df: DataFrame, scene: str, label: str = "label", pred: str = "pred", positive: int = 1, ignore: int = C.IGNORE_LABEL) -> DataFrame:
    """Positive-class IoU per scene; null for a scene without any positive."""
    ok, y, p = F.col(label) != ignore, F.col(label) == positive, F.col(pred) == positive
    g = df.groupBy(scene).agg(F.count_if(ok & y & p).alias("inter"), F.count_if(ok & (y | p)).alias("union_px"))
    return g.select(scene, "inter", "union_px", F.when(F.col("union_px") > 0, F.col("inter") / F.col("union_px")).alias("iou"))


def dominant_class(df: DataFrame, patch: str = "patch_index", label: str = "label", ignore: int = C.IGNORE_LABEL) -> DataFrame:
    """Most frequent valid class, the lowest code on ties, -1 if none is valid."""
    n = df.groupBy(patch, label).agg(F.count(F.lit(1)).alias("_n"))
    valid = F.col(label) != ignore
    best = F.max(F.when(valid, F.struct(F.col("_n"), (-F.col(label)).alias("neg"))))
    return n.groupBy(patch).agg(best.alias("_b")).select(
        patch, F.coalesce((-F.col("_b.neg")), F.lit(ignore)).cast("int").alias("dominant_class")
    )


def class_fraction(df: DataFrame, cls: int, patch: str = "patch_index", label: str = "label", ignore: int = C.IGNORE_LABEL) -> DataFrame:
    """Share of one class among valid pixels; null if there are none."""
    return df.groupBy(patch).agg(
        F.avg(F.when(F.col(label) != ignore, (F.col(label) == cls).cast("double"))).alias("fraction")
    )


def class_frequencies(df: DataFrame, label: str = "label", ignore: int = C.IGNORE_LABEL) -> DataFrame:
    g = df.where(F.col(label) != ignore).groupBy(F.col(label).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("freq", F.col("n") / g.agg(F.sum("n")).scalar())


def class_weights(freq: DataFrame, scheme: str = "inverse_sqrt", beta: float = 0.999, n_total: float = 1e4) -> DataFrame:
    """Per-class weights of mean 1, and whether they are close to uniform."""
    f = F.greatest(F.col("freq"), F.lit(1e-12))
    raw = {
        "none": F.lit(1.0),
        "inverse": 1.0 / f,
        "inverse_sqrt": 1.0 / F.sqrt(f),
        "effective": F.lit(1.0 - beta)
        / F.greatest(1.0 - F.pow(F.lit(beta), F.greatest(F.col("freq") * n_total, F.lit(1.0))), F.lit(1e-12)),
    }[scheme]
    w = freq.withColumn("_w", raw)
    t = w.agg(F.struct(F.avg("_w").alias("mean"), F.max("_w").alias("hi"), F.min("_w").alias("lo"))).scalar()
    flat = F.lit(False) if scheme == "none" else t["hi"] / F.greatest(t["lo"], F.lit(1e-12)) < 1.05
    return w.select("class", "freq", (F.col("_w") / t["mean"]).alias("weight"), flat.alias("near_uniform"))


def chance_miou(freq: DataFrame) -> DataFrame:
    """Macro IoU of a uniform random guess, and of one that matches the prior."""
    c = freq.agg(F.count(F.lit(1)).cast("double")).scalar()
    f = F.col("freq")
    t = freq.withColumn("_c", c)
    u = 1.0 / F.col("_c")
    return t.agg(
        F.avg((f * u) / (f + u - f * u)).alias("chance_miou"), F.avg((f * f) / (2.0 * f - f * f)).alias("prior_matched_miou")
    )


def dead_classes(df: DataFrame, threshold: float = 0.01, cls: str = "class", iou: str = "iou") -> DataFrame:
    """Classes at or under the threshold in every run; a missing value counts as 0."""
    g = df.groupBy(cls).agg(F.max(F.coalesce(iou, F.lit(0.0))).alias("best_iou"))
    return g.where(F.col("best_iou") <= threshold)
