"""Significance tests: statistics by aggregation, tail probabilities on result rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import order, tails


def welch_ttest(df: DataFrame, run_a: str, run_b: str, keys: Sequence[str] = ("metric",), run: str = "run", value: str = "value",
                alpha: float = 0.01, with_p: bool = True) -> DataFrame:
    """Two runs, unequal variances. Adds the p-value and a flag unless turned off."""
    side = lambda r: F.when(F.col(run) == r, F.col(value))
    g = df.where(F.col(run).isin(run_a, run_b)).groupBy(*keys).agg(
        *[
            f(side(r)).alias(f"{n}_{t}")
            for t, r in (("a", run_a), ("b", run_b))
            for n, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))
        ]
    )
    va, vb = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    t = (F.col("mean_a") - F.col("mean_b")) / F.sqrt(va + vb)
    dof = F.pow(va + vb, F.lit(2.0)) / (F.pow(va, F.lit(2.0)) / (F.col("n_a") - 1) + F.pow(vb, F.lit(2.0)) / (F.col("n_b") - 1))
    ok = (F.col("n_a") > 1) & (F.col("n_b") > 1) & (va + vb > 0)
    out = g.select(*keys, "n_a", "n_b", "mean_a", "mean_b", F.when(ok, t).alias("t"), F.when(ok, dof).alias("dof"))
    if not with_p:
        return out
    p = tails.t_pvalue(F.col("t"), F.col("dof"))
    return out.withColumn("p_value", p).withColumn("significant", F.coalesce(F.col("p_value") < alpha, F.lit(False)))


def wilcoxon_signed_rank(df: DataFrame, x: str, y: str, with_p: bool = True) -> DataFrame:
    """Paired differences without zeros, mean ranks for ties, normal approximation.

    Equal absolute differences are counted first, so the ranking works on
    distinct values and never sorts all rows in one place.
    """
    d = df.select((F.col(x) - F.col(y)).alias("_d")).where(F.col("_d").isNotNull() & (F.col("_d") != 0))
    cells = d.groupBy(F.abs("_d").alias("_abs")).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("_d") > 0).alias("_pos"), F.count_if(F.col("_d") < 0).alias("_neg")
    )
    run = order.prefix_sum(cells, [], "_abs", "_n", "_upto")
    rank = F.col("_upto") - F.col("_n") + (F.col("_n") + 1) / 2.0
    t = F.col("_n").cast("double")
    s = run.agg(
        F.sum("_n").alias("n"), F.sum(rank * F.col("_pos")).alias("w_plus"), F.sum(rank * F.col("_neg")).alias("w_minus"),
        F.sum(t * t * t - t).alias("_ties"),
    )
    n = F.col("n").cast("double")
    mean, var = n * (n + 1) / 4.0, n * (n + 1) * (2 * n + 1) / 24.0 - F.col("_ties") / 48.0
    stat = F.least("w_plus", "w_minus")
    out = s.select("n", "w_plus", "w_minus", stat.alias("statistic"), ((stat - mean) / F.sqrt(var)).alias("z"))
    return out.withColumn("p_value", tails.normal_pvalue(F.col("z"))) if with_p else out
