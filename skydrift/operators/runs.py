"""Experiment runs: curves, best epochs, ladder tables, paired seed deltas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import exprs
from .pairing import baseline_join


# --- histories: (run, attempt, epoch, metric, value) -----------------------------
def collapse_epochs(history: DataFrame, keys: Sequence[str] = ("run", "epoch", "metric")) -> DataFrame:
    """One value per epoch: the largest logged."""
    return history.groupBy(*keys).agg(F.max("value").alias("value"))


def longest_attempt(history: DataFrame) -> DataFrame:
    """The attempt with most epochs of every run, the first name on ties."""
    n = history.groupBy("run", "attempt").agg(F.count_distinct("epoch").alias("epochs"))
    w = Window.partitionBy("run").orderBy(F.desc("epochs"), "attempt")
    return n.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def latest_per_group(df: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    """Newest row per group with a partial maximum: no sort, a hot group stays cheap."""
    rest = [c for c in df.columns if c not in (*keys, by)]
    best = F.max_by(F.struct(by, *rest), F.struct(by, *rest)).alias("_b")
    return df.where(F.col(by).isNotNull()).groupBy(*keys).agg(best).select(*keys, "_b.*")


def best_epoch(curve: DataFrame, mode: str = "max", keys: Sequence[str] = ("run", "metric")) -> DataFrame:
    """Epoch of the best value, the first one on ties; ``min`` for lower-is-better."""
    if mode == "max":
        pick = F.max(F.struct("value", (-F.col("epoch")).alias("neg")))
        epoch = -F.col("_b.neg")
    else:
        pick = F.min(F.struct("value", F.col("epoch").alias("neg")))
        epoch = F.col("_b.neg")
    g = curve.where(F.col("value").isNotNull()).groupBy(*keys).agg(pick.alias("_b"))
    return g.select(*keys, F.col("_b.value").alias("best_value"), epoch.alias("best_epoch"))


def metric_curve(curve: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Metrics side by side per run and epoch, each with its change since the last epoch."""
    picks = [F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in metrics]
    wide = curve.where(F.col("metric").isin(list(metrics))).groupBy("run", "epoch").agg(*picks)
    w = Window.partitionBy("run").orderBy("epoch")
    return wide.select("run", "epoch", *metrics, *[(F.col(m) - F.lag(m).over(w)).alias(f"{m}_change") for m in metrics])


def run_summary(curve: DataFrame, metrics: Sequence[str], best_metric: str, warmup: int = C.WARMUP_EPOCHS) -> DataFrame:
    """Per run: epochs, best value and its epoch, mean and sd of each metric after warm-up."""
    aggs = [
        (F.max("epoch") + 1).alias("epochs"),
        F.max(F.when((F.col("metric") == best_metric) & F.col("value").isNotNull(), F.struct("value", (-F.col("epoch")).alias("neg")))).alias("_b"),
    ]
    for m in metrics:
        v = F.when((F.col("metric") == m) & (F.col("epoch") >= warmup), F.col("value"))
        aggs += [F.avg(v).alias(f"{m}_mean"), F.stddev_samp(v).alias(f"{m}_sd")]
    g = curve.groupBy("run").agg(*aggs)
    return g.select(
        "run", "epochs", F.col("_b.value").alias("best_value"), (-F.col("_b.neg")).alias("best_epoch"),
        *[c for m in metrics for c in (f"{m}_mean", f"{m}_sd")],
    )


# --- run records -------------------------------------------------------------------
def flatten_run_records(records: DataFrame, severity: DataFrame | None = None,
                        pretrained_prefixes: Sequence[str] = tuple(C.PRETRAINED_MODEL_PREFIXES)) -> DataFrame:
    """One row per run and test condition.

    The matched condition is added when the cross-condition results lack it.
    Every metric takes the first of its candidate keys that is present.
    """
    parts = F.split("sim_root", "/")
    train = F.when(F.element_at(parts, -1) == "v1.1", F.try_element_at(parts, F.lit(-2))).otherwise(F.element_at(parts, -1))
    model = F.coalesce("model", F.lit("student"))
    scratch = F.coalesce("scratch", F.lit(False))
    family = F.lit(False)
    for prefix in pretrained_prefixes:
        family = family | model.startswith(prefix)
    init = (
        F.when(family, F.when(scratch, "random").otherwise("pretrained"))
        .otherwise(F.when(scratch, "scratch").otherwise("distilled"))
    )
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    r = records.select(
        "tag", model.alias("model"), "seed", "freeze", "epochs_run", "best_val_iou", init.alias("init"), train.alias("train_variant"),
        F.coalesce("test", empty).alias("_test"),
        F.coalesce(F.map_entries("cross_condition"), F.array().cast("array<struct<key:string,value:map<string,double>>>")).alias("_cross"),
    )
    matched = F.struct(F.col("train_variant").alias("key"), F.col("_test").alias("value"))
    has = F.exists("_cross", lambda e: e["key"] == F.col("train_variant"))
    rows = r.withColumn("_row", F.explode(F.when(has, F.col("_cross")).otherwise(F.concat("_cross", F.array(matched)))))
    v = F.col("_row.key")
    out = rows.select(
        "tag", "train_variant", v.alias("variant"), exprs.variant_factor(v).alias("factor"), exprs.variant_level(v).alias("level"),
        "init", "seed", "freeze", "epochs_run", "best_val_iou", "model",
        *[exprs.pick_metric(F.col("_row.value"), keys).alias(name) for name, keys in C.METRIC_KEYS.items()],
    )
    if severity is None:
        return out.withColumn("severity", F.lit(None).cast("double"))
    return out.join(severity.select(F.col("name").alias("variant"), "severity"), "variant", "left")


def variant_position(name: Column) -> Column:
    """Place of a variant on the ladder; unknown ones last."""
    table = F.create_map(*[F.lit(x) for i, v in enumerate(C.ladder_order()) for x in (v, i)])
    return F.coalesce(F.try_element_at(table, name), F.lit(C.UNKNOWN_VARIANT_POSITION))


def custom_order(df: DataFrame) -> DataFrame:
    """Ladder order: distilled first, then by trained-on, tested-on and seed."""
    return df.orderBy(
        (F.col("init") != "distilled"), variant_position(F.col("train_variant")), variant_position(F.col("variant")),
        *([F.coalesce("seed", F.lit(0))] if "seed" in df.columns else []),
    )


def ladder_summary(rows: DataFrame, metric: str = "test_iou_water", overall: str = "test_iou") -> DataFrame:
    """n, mean, sd (0 for one), min, max per init, trained-on, tested-on; mean overall IoU."""
    k = ["init", "train_variant", "variant"]
    g = rows.groupBy(*k).agg(
        F.count(metric).alias("n_seeds"), F.avg(metric).alias("mean"), F.coalesce(F.stddev_samp(metric), F.lit(0.0)).alias("std"),
        F.min(metric).alias("min"), F.max(metric).alias("max"), F.avg(overall).alias("mean_test_iou"), F.max("severity").alias("severity"),
    ).where("n_seeds > 0")
    return g.select(
        *k, exprs.variant_factor(F.col("variant")).alias("factor"), exprs.variant_level(F.col("variant")).alias("level"),
        "severity", "n_seeds", "mean", "std", "min", "max", "mean_test_iou",
    )


_CELL = ["init", "train_variant", "variant"]


def ladder_state(rows: DataFrame, metric: str = "test_iou_water", overall: str = "test_iou") -> DataFrame:
    """Mergeable state per init, trained-on, tested-on: enough for :func:`ladder_summary` of any union of parts."""
    return rows.groupBy(*_CELL).agg(
        F.count(metric).alias("n"), F.avg(metric).alias("mean"), (F.var_pop(metric) * F.count(metric)).alias("m2"), F.min(metric).alias("min"), F.max(metric).alias("max"),
        F.count(overall).alias("overall_n"), F.avg(overall).alias("overall_mean"), F.max("severity").alias("severity"),
    )


def merge_ladder_states(states: DataFrame) -> DataFrame:
    """States of parts as one; the spread between parts joins that within them, around the pooled mean."""
    both = states.withColumn("_p", F.struct("n", "mean", "m2"))
    g = both.groupBy(*_CELL).agg(
        F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.nullif(F.sum("n"), F.lit(0))).alias("mean"), F.collect_list(F.when(F.col("n") > 0, F.col("_p"))).alias("_parts"),
        F.min("min").alias("min"), F.max("max").alias("max"), F.sum("overall_n").alias("overall_n"),
        (F.sum(F.col("overall_n") * F.col("overall_mean")) / F.nullif(F.sum("overall_n"), F.lit(0))).alias("overall_mean"), F.max("severity").alias("severity"),
    )
    spread = F.aggregate("_parts", F.lit(0.0), lambda s, p: s + p["m2"] + p["n"] * F.pow(p["mean"] - F.col("mean"), F.lit(2.0)))
    return g.withColumn("m2", spread).select(*_CELL, "n", "mean", "m2", "min", "max", "overall_n", "overall_mean", "severity")


def finish_ladder_states(states: DataFrame) -> DataFrame:
    """The table of :func:`ladder_summary` from states."""
    v = F.col("variant")
    return states.where("n > 0").select(
        *_CELL, exprs.variant_factor(v).alias("factor"), exprs.variant_level(v).alias("level"), "severity", F.col("n").alias("n_seeds"), "mean",
        F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1))).otherwise(F.lit(0.0)).alias("std"), "min", "max", F.col("overall_mean").alias("mean_test_iou"),
    )


def paired_seed_delta(rows: DataFrame, metric: str = "test_iou_water", baseline: str = "clean") -> DataFrame:
    """Drop from the clean test set, measured seed by seed.

    Without a shared seed the difference of means is given. The verdict relates
    the mean drop to the spread of the drops.
    """
    k = ["init", "train_variant", "variant"]
    paired = baseline_join(rows, metric, baseline).groupBy(*k).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.avg(F.col(metric) - F.col("baseline")).alias("_d"),
        F.stddev_samp(F.col(metric) - F.col("baseline")).alias("_s"),
    )
    means = rows.where(F.col(metric).isNotNull()).groupBy(*k).agg(F.avg(metric).alias("_mean"))
    base = means.where(F.col("variant") == baseline).select("init", "train_variant", F.col("_mean").alias("_base"))
    j = means.where(F.col("variant") != baseline).join(base, ["init", "train_variant"]).join(paired, k, "left")
    n = F.coalesce("n_pairs", F.lit(0)).cast("long")
    sd = F.coalesce("_s", F.lit(0.0))
    delta = F.coalesce("_d", F.col("_mean") - F.col("_base"))
    ratio = F.when((n >= 2) & (sd > 0), F.abs(delta) / sd)
    verdict = (
        F.when(n < 2, "n/a (1 seed)").when(sd == 0, "exact").when(F.abs(delta) / sd < 2, "within noise").otherwise("clear")
    )
    return j.select(*k, n.alias("n_pairs"), delta.alias("delta"), sd.alias("sd"), ratio.alias("ratio"), verdict.alias("verdict"))


def sweep_ranking(df: DataFrame, keys: Sequence[str], metric: str) -> DataFrame:
    """count, mean, std, max per group (nulls form a group), best mean first."""
    g = df.groupBy(*keys).agg(
        F.count(metric).alias("count"), F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"), F.max(metric).alias("max")
    )
    return g.orderBy(F.desc_nulls_last("mean"))


def best_row(df: DataFrame, metric: str, ties: Sequence[str] = ()) -> DataFrame:
    """The overall winner (take-ordered)."""
    return df.where(F.col(metric).isNotNull()).orderBy(F.desc(metric), *ties).limit(1)


def job_status_summary(jobs: DataFrame, statuses: Sequence[str] = ("done", "skipped", "failed"), at: str = "finished_at") -> DataFrame:
    """Per variant: jobs by status, seconds, files, and per split the last result.

    ``runs`` maps a split to (status, n_files, seconds) of its job with the highest
    ``at``; a split that ran twice shows its last run only.
    """
    last = F.max_by(F.struct("status", "n_files", "seconds"), at)
    per = jobs.groupBy("variant", "split").agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in statuses], F.sum("seconds").alias("seconds"), F.sum("n_files").alias("n_files"), last.alias("_last"))
    return per.groupBy("variant").agg(
        *[F.sum(c).alias(c) for c in (*statuses, "seconds", "n_files")],
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("split").isNotNull(), F.struct("split", "_last"))))).alias("runs"),
    )


def vector_catalog_summary(vectors: DataFrame, head_keys: Sequence[str], suffix: str, expected_size: int | None = None) -> DataFrame:
    """Per name: tensors, first head key present and its size, keys with a suffix."""
    pos = F.create_map(*[F.lit(x) for i, k in enumerate(head_keys) for x in (k, i)])
    rank = F.try_element_at(pos, F.col("key"))
    g = vectors.groupBy("name").agg(
        F.count(F.lit(1)).alias("n_tensors"),
        F.min(F.when(rank.isNotNull(), F.struct(rank.alias("r"), F.col("key"), F.size("values").alias("size")))).alias("_h"),
        F.count_if(F.col("key").endswith(suffix)).alias("suffix_keys"),
    )
    size = F.col("_h.size")
    flag = F.lit(False) if expected_size is None else F.coalesce(size != expected_size, F.lit(True))
    return g.select("name", "n_tensors", F.col("_h.key").alias("head_key"), size.alias("head_size"), "suffix_keys", flag.alias("unexpected"))
