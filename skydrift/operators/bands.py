"""Band statistics of two views and how far they moved.

Inputs are long tables ``(keys..., band, value)`` unless noted. Moments are
built-in aggregates with map-side partials; exact percentiles go through
``functions.order`` so one band holding most pixels is never one task's work.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import exprs, order, select
from ..session import stored


def valid_pixels(df: DataFrame, value: str = "value", nodata: float | None = None, positive_only: bool = True) -> DataFrame:
    """Pixels that count: positive ones, or all but the no-data value."""
    out = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    if nodata is not None:
        out = out.where(F.col(value) != F.lit(nodata))
    return out.where(F.col(value) > 0) if positive_only else out


def filter_cloud(manifest: DataFrame, max_pct: float | None = 5.0) -> DataFrame:
    if max_pct is None:
        return manifest
    return manifest.where(F.col("thick_cloud_pct") + F.col("thin_cloud_pct") <= max_pct)


def band_stats(
    df: DataFrame,
    keys: Sequence[str] = ("view",),
    value: str = "value",
    expected: DataFrame | None = None,
    bounded_groups: bool = False,
) -> DataFrame:
    """mean, std (population), min, max, median, p25, p75 of valid pixels.

    ``expected`` lists (keys, band) groups that must appear; those without a
    valid pixel get zeros. ``bounded_groups`` says every group is one image, so
    Spark's per-group percentile map is small whatever the table size.
    """
    k = [*keys, "band"]
    aggs = [
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    ]
    valid, probs = valid_pixels(df, value), [0.25, 0.5, 0.75]
    if bounded_groups:
        stats = valid.groupBy(*k).agg(*aggs, F.percentile(value, F.array(*[F.lit(p) for p in probs])).alias("pct"))
    else:
        stats = select.stats_with_percentiles(valid, k, value, aggs, probs)
    stats = stats.select(
        *k, "mean", "std", "min", "max",
        F.col("pct")[1].alias("median"), F.col("pct")[0].alias("p25"), F.col("pct")[2].alias("p75"),
    )
    if expected is None:
        return stats
    names = ["mean", "std", "min", "max", "median", "p25", "p75"]
    full = order.join_null_safe(expected.select(*k).distinct(), stats, k, "left")
    return full.select(*k, *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names])


#: Size parameter of a quantile sketch; a group keeps about three times as many numbers at most.
SKETCH = 4096


def rank_error(k: int = SKETCH) -> float:
    """How far, as a share of the rows, the rank of a sketch's quantile may be off (with 99% confidence); none up to k rows."""
    return 2.296 / k**0.9021


def quantile_sketch(value, k: int = SKETCH) -> Column:
    """Mergeable KLL sketch of a column, as binary; nulls do not count."""
    return F.kll_sketch_agg_double((F.col(value) if isinstance(value, str) else value).cast("double"), k)


def sketch_quantile(sketch: str, p: float) -> Column:
    """Quantile of a sketch; null for one without rows."""
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(float(p))))


def band_moments(df: DataFrame, keys: Sequence[str] = ("view", "band"), value: str = "value", k: int = SKETCH) -> DataFrame:
    """Mergeable one-pass state per group: n, mean, m2, min, max and a quantile sketch."""
    return df.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        (F.var_pop(value) * F.count(value)).alias("m2"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        quantile_sketch(value, k).alias("sketch"),
    )


def merge_band_moments(states: DataFrame, keys: Sequence[str] = ("view", "band")) -> DataFrame:
    """Combine stored partial states; the result equals one pass over all rows.

    Between-part spread is added to the within-part spread (Chan et al.), around
    the pooled mean so that large means do not cancel digits. Sketches merge within
    the rank error of a single one.
    """
    total = states.groupBy(*keys).agg(
        F.sum("n").alias("_n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_mean")
    )
    j = order.join_null_safe(states.where(F.col("n") > 0), total, list(keys))
    return j.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.max("_mean").alias("mean"),
        F.sum(F.col("m2") + F.col("n") * F.pow(F.col("mean") - F.col("_mean"), F.lit(2.0))).alias("m2"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        F.kll_merge_agg_double("sketch").alias("sketch"),
    )


def finish_moments(states: DataFrame, probs: Sequence[float] = (0.02, 0.98)) -> DataFrame:
    """Sample standard deviation (0 for a single pixel) and percentiles from a state."""
    var = F.col("m2") / (F.col("n") - 1)
    out = states.withColumn("std", F.when(F.col("n") > 1, F.sqrt(var)).otherwise(F.lit(0.0)))
    return out.withColumns({f"p{p * 100:g}": sketch_quantile("sketch", p) for p in probs}).drop("sketch")


def approx_band_percentiles(df: DataFrame, keys: Sequence[str], probs: Sequence[float], value: str = "value", k: int = SKETCH) -> DataFrame:
    """Bounded-memory percentiles from mergeable KLL sketches."""
    sk = df.groupBy(*keys).agg(quantile_sketch(value, k).alias("_s"))
    return sk.select(*keys, *[sketch_quantile("_s", p).alias(f"p{p * 100:g}") for p in probs])


def percentile_ranks(df: DataFrame, quantiles: DataFrame, keys: Sequence[str], probs: Sequence[float], value: str = "value", error: float = rank_error()) -> DataFrame:
    """Per group and percentile column, whether its true rank is within ``error`` of the one asked for: one scan."""
    names = [f"p{p * 100:g}" for p in probs]
    v = F.col(value)
    j = order.join_group_stats(df.where(v.isNotNull()), quantiles.select(*keys, *names), list(keys))
    below = [F.avg((v < F.col(n)).cast("double")).alias(f"_b{n}") for n in names]
    upto = [F.avg((v <= F.col(n)).cast("double")).alias(f"_u{n}") for n in names]
    g = j.groupBy(*keys).agg(*below, *upto)
    return g.select(*keys, *[((F.col(f"_b{n}") <= p + error) & (F.col(f"_u{n}") >= p - error)).alias(f"{n}_within") for n, p in zip(names, probs)])


def spectral_drift(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("band",)) -> DataFrame:
    """Per band: change of mean and std, absolute and in percent, and of range."""
    k = list(keys)
    names = ["mean", "std", "min", "max"]
    left = a.select(*k, *[F.col(n).alias(f"a_{n}") for n in names])
    right = b.select(*k, *[F.col(n).alias(f"b_{n}") for n in names])
    j = left.join(right, k)
    range_a, range_b = F.col("a_max") - F.col("a_min"), F.col("b_max") - F.col("b_min")
    return j.select(
        *k,
        (F.col("b_mean") - F.col("a_mean")).alias("mean_diff"),
        exprs.percent_change(F.col("a_mean"), F.col("b_mean")).alias("mean_pct_change"),
        (F.col("b_std") - F.col("a_std")).alias("std_change"),
        exprs.percent_change(F.col("a_std"), F.col("b_std")).alias("std_pct_change"),
        (range_b - range_a).alias("range_change"),
    )


def spectral_drift_wide(
    df: DataFrame, keys: Sequence[str], a: str, b: str, value: str = "value", view: str = "view"
) -> DataFrame:
    """Same result from one table holding both views: one aggregation, no join."""
    aggs = []
    for tag, name in (("a", a), ("b", b)):
        v = F.when(F.col(view) == name, F.col(value))
        aggs += [
            F.avg(v).alias(f"{tag}_mean"), F.stddev_pop(v).alias(f"{tag}_std"),
            F.min(v).alias(f"{tag}_min"), F.max(v).alias(f"{tag}_max"),
        ]
    g = valid_pixels(df.where(F.col(view).isin(a, b)), value).groupBy(*keys).agg(*aggs)
    zero = [F.coalesce(c, F.lit(0.0)).alias(c) for c in g.columns if c not in keys]
    g = g.select(*keys, *zero)
    return _changes(g, keys)


def _changes(g: DataFrame, keys: Sequence[str]) -> DataFrame:
    return g.select(
        *keys,
        (F.col("b_mean") - F.col("a_mean")).alias("mean_diff"),
        exprs.percent_change(F.col("a_mean"), F.col("b_mean")).alias("mean_pct_change"),
        (F.col("b_std") - F.col("a_std")).alias("std_change"),
        exprs.percent_change(F.col("a_std"), F.col("b_std")).alias("std_pct_change"),
        ((F.col("b_max") - F.col("b_min")) - (F.col("a_max") - F.col("a_min"))).alias("range_change"),
    )


def _counted(value: Column) -> Column:
    """A pixel's value where it counts (:func:`valid_pixels`), else null."""
    return F.when(~F.isnan(value) & (value > 0), value)


def spectral_drift_columns(df: DataFrame, keys: Sequence[str], bands: dict[str, tuple[str, str]]) -> DataFrame:
    """Same result from a table with a column per view and band, by ``band: (a, b)``: a pixel stays one row.

    Rows of a key meet first, so that what moves is the pixels' columns and not the
    state of every group; without keys only states move. Bands without a valid pixel
    in either view are left out.
    """
    columns = list(dict.fromkeys(c for pair in bands.values() for c in pair))
    df = order.together(df.select(*keys, *columns), keys) if keys else df
    aggs = []
    for i, pair in enumerate(bands.values()):
        for tag, c in zip("ab", pair):
            v = _counted(F.col(c))
            aggs += [F.avg(v).alias(f"_{tag}_mean{i}"), F.stddev_pop(v).alias(f"_{tag}_std{i}"), F.min(v).alias(f"_{tag}_min{i}"), F.max(v).alias(f"_{tag}_max{i}")]
    g = df.groupBy(*keys).agg(*aggs)
    names = [f"{tag}_{n}" for tag in "ab" for n in ("mean", "std", "min", "max")]
    each = [F.struct(F.lit(b).alias("band"), *[F.col(f"_{n}{i}").alias(n) for n in names]) for i, b in enumerate(bands)]
    g = g.select(*keys, F.inline(F.array(*each))).where("a_mean IS NOT NULL OR b_mean IS NOT NULL")
    return _changes(g.select(*keys, "band", *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names]), [*keys, "band"])


def image_stats(df: DataFrame, keys: Sequence[str], columns: dict[tuple[str, str], str]) -> DataFrame:
    """:func:`band_stats` per image from a table with a column per ``(view, band)``; groups without a valid pixel get zeros.

    An image's pixels are one group, held at once; they meet before they are put
    out by view and band, and nothing is joined.
    """
    df, aggs = order.together(df.select(*keys, *dict.fromkeys(columns.values())), keys), []
    for i, c in enumerate(columns.values()):
        v = _counted(F.col(c))
        aggs += [F.avg(v).alias(f"_mean{i}"), F.stddev_pop(v).alias(f"_std{i}"), F.min(v).alias(f"_min{i}"), F.max(v).alias(f"_max{i}"), F.sort_array(F.collect_list(v)).alias(f"_all{i}")]
    g = df.groupBy(*keys).agg(*aggs)

    def at(values: Column, p: float) -> Column:
        place = (F.size(values) - 1) * F.lit(p)
        low, share = F.floor(place).cast("int"), place - F.floor(place)
        return F.get(values, low) * (1.0 - share) + F.get(values, F.ceil(place).cast("int")) * share

    each = [
        F.struct(F.lit(view).alias("view"), F.lit(band).alias("band"), *[F.col(f"_{n}{i}").alias(n) for n in ("mean", "std", "min", "max")],
                 *[at(F.col(f"_all{i}"), p).alias(n) for n, p in (("median", 0.5), ("p25", 0.25), ("p75", 0.75))])
        for i, (view, band) in enumerate(columns)
    ]
    out = g.select(*keys, F.inline(F.array(*each)))
    return out.select(*keys, "view", "band", *[F.coalesce(n, F.lit(0.0)).alias(n) for n in ("mean", "std", "min", "max", "median", "p25", "p75")])


def spectral_drift_summary(drift: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Average and largest absolute change over bands."""
    aggs = [
        F.avg(F.abs("mean_diff")).alias("avg_mean_difference"),
        F.max(F.abs("mean_diff")).alias("max_mean_difference"),
        F.avg(F.abs("std_change")).alias("avg_std_change"),
        F.max(F.abs("std_change")).alias("max_std_change"),
    ]
    return drift.groupBy(*keys).agg(*aggs) if keys else drift.agg(*aggs)


def folder_spectral_summary(per_pair: DataFrame) -> DataFrame:
    """Average over pairs of the per-pair averages, and the overall maxima."""
    return per_pair.agg(
        F.count(F.lit(1)).alias("pairs"),
        F.avg("avg_mean_difference").alias("avg_mean_difference"),
        F.max("max_mean_difference").alias("max_mean_difference"),
        F.avg("avg_std_change").alias("avg_std_change"),
        F.max("max_std_change").alias("max_std_change"),
    )


def _root(c: Column) -> Column:
    """Square root space, negative values as 0; it keeps the order, so percentiles there are those of the roots of their neighbours."""
    return F.sqrt(F.greatest(c, F.lit(0.0)))


#: The percentiles of the spectral tables: per view and band, and the clip over a view's bands.
TAILS, QUARTILES, CLIP = select.Wanted(("view", "band"), (0.02, 0.5, 0.98)), select.Wanted(("view", "band"), (0.25, 0.5, 0.75)), select.Wanted(("view",), (0.999,))


#: The same for histogram edges over all rows, and over positive values the medians of signatures and the lower edge in logarithms.
TRIM, MEDIAN, LOW = select.Wanted((), (0.005, 0.995)), select.Wanted(("view", "band"), (0.5,)), select.Wanted((), (0.005,))


def spectral_selection(df: DataFrame, value: str = "value", ceiling: float = 4095.0, wanted: Sequence[select.Wanted] = (TAILS, QUARTILES, CLIP)) -> select.Selection:
    """Two scans that serve :func:`domain_stats`, :func:`spectral_stats_table` and the quartiles of :func:`box_stats` together, or those of them ``wanted``."""
    v, root = F.col(value), _root(F.col(value))
    aggs = [
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.avg(root).alias("sqrt_mean"), F.stddev_pop(root).alias("sqrt_std"),
        (F.avg((v <= 0).cast("double")) * 100.0).alias("pct_zero"),
        (F.avg((v >= ceiling).cast("double")) * 100.0).alias("pct_at_4095"),
    ]
    return select.select(df, ("view", "band"), value, wanted, aggs)


def domain_stats(df: DataFrame, value: str = "value", selection: select.Selection | None = None) -> DataFrame:
    """Mean and std in square-root space per band; clip = pooled p99.9 per view."""
    s = selection or spectral_selection(df, value, wanted=[CLIP])
    clip = s.percentiles(CLIP, through=_root).select("view", F.col("pct")[0].alias("clip"))
    return order.join_null_safe(s.groups.select("view", "band", F.col("sqrt_mean").alias("mean"), F.col("sqrt_std").alias("std")), clip, ["view"])


def spectral_stats_table(df: DataFrame, value: str = "value", ceiling: float = 4095.0, selection: select.Selection | None = None) -> DataFrame:
    """One row per view and band, with zero and saturation shares in percent."""
    s = selection or spectral_selection(df, value, ceiling, [TAILS])
    t = order.join_null_safe(s.groups, s.percentiles(TAILS), ["view", "band"], "left")
    return t.select(
        "view", "band", "mean", "std", "min", F.col("pct")[0].alias("p2"), F.col("pct")[1].alias("median"),
        F.col("pct")[2].alias("p98"), "max", "sqrt_mean", "sqrt_std", "pct_zero", "pct_at_4095",
    )


def box_stats(df: DataFrame, z: bool = False, value: str = "value", selection: select.Selection | None = None) -> DataFrame:
    """Quartiles and whiskers (furthest point within 1.5 IQR) per view and band.

    After the quartiles one scan finds the extreme values inside the fences. ``z``
    takes standardised square roots; as those rise with the value, quartiles and
    whiskers are shifted and scaled instead of the data.
    """
    k = ["view", "band"]
    s = selection or spectral_selection(df, value, wanted=[QUARTILES])
    to = _root if z else (lambda c: c)
    q = order.join_null_safe(s.groups.select(*k, F.col("sqrt_mean").alias("_m"), F.col("sqrt_std").alias("_s")), s.percentiles(QUARTILES, through=to), k)
    q = q.select(*k, "_m", "_s", F.col("pct")[0].alias("q1"), F.col("pct")[1].alias("median"), F.col("pct")[2].alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    src = df.select(*k, to(F.col(value)).alias("_v"))
    inside = (F.col("_v") >= F.col("q1") - 1.5 * iqr) & (F.col("_v") <= F.col("q3") + 1.5 * iqr)
    out = (
        order.join_group_stats(src, q, k).where(inside)
        .groupBy(*k, "_m", "_s", "q1", "median", "q3")
        .agg(F.min("_v").alias("whisker_low"), F.max("_v").alias("whisker_high"))
    )
    names = ["q1", "median", "q3", "whisker_low", "whisker_high"]
    if z:
        return out.select(*k, *[((F.col(n) - F.col("_m")) / F.col("_s")).alias(n) for n in names])
    return out.select(*k, *names)


def spectral_signature(stats: DataFrame) -> DataFrame:
    """Band median relative to the mean of the view's medians."""
    ref = stats.groupBy("view").agg(F.avg("median").alias("_ref"))
    return stats.join(ref, "view").select("view", "band", (F.col("median") / F.col("_ref")).alias("signature"))


def sensor_transfer_fit(pairs: DataFrame, keys: Sequence[str] = ("band",), target: str = "target", reference: str = "reference") -> DataFrame:
    """Line reference = slope * target + intercept, Pearson and Spearman, per band."""
    k = list(keys)
    line = pairs.groupBy(*k).agg(
        F.regr_slope(reference, target).alias("slope"),
        F.regr_intercept(reference, target).alias("intercept"),
        F.corr(target, reference).alias("pearson"),
    )
    return order.join_null_safe(line, spearman(pairs, k, target, reference), k)


def sensor_transfer_fit_wide(wide: DataFrame, bands: dict[str, tuple[str, str]], rho: DataFrame | None = None) -> DataFrame:
    """The same from one table with a column per view and band, by ``band: (target, reference)``.

    ``rho`` may hold the :func:`rank_correlations` of these pairs and of others.
    """
    fits = [F.struct(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(x, y).alias("pearson"), F.lit(b).alias("band"), F.lit(x).alias("x"), F.lit(y).alias("y"))
            for b, (x, y) in bands.items()]
    names = [f"_f{i}" for i in range(len(fits))]
    line = wide.agg(*[f.alias(n) for f, n in zip(fits, names)]).select(F.inline(F.array(*names)))
    rho = rank_correlations(wide, list(bands.values())) if rho is None else rho
    return line.join(F.broadcast(rho), ["x", "y"]).select("band", "slope", "intercept", "pearson", "spearman")


def spearman(pairs: DataFrame, keys: Sequence[str], x: str, y: str, weight: str | None = None) -> DataFrame:
    """Rank correlation with mean ranks for ties, over rows where both exist; a row may stand for ``weight`` rows.

    Equal pairs are counted first, so repeated values cross the network once, and each
    cell gets its ranks from running counts over the cells in value order: nothing is
    joined on a value.
    """
    k = list(keys)
    both = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    cells = both.groupBy(*k, x, y).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_n"))
    ranked = order.weighted_ranks(order.weighted_ranks(cells, k, x, "_n", "_rx"), k, y, "_n", "_ry")
    # ranks come centred, so one aggregation of products is enough
    r = ranked.groupBy(*k).agg(
        F.sum(F.col("_n") * F.col("_rx") * F.col("_ry")).alias("_xy"),
        F.sum(F.col("_n") * F.col("_rx") * F.col("_rx")).alias("_xx"),
        F.sum(F.col("_n") * F.col("_ry") * F.col("_ry")).alias("_yy"),
    )
    den = F.sqrt("_xx") * F.sqrt("_yy")
    return r.select(*k, F.when(den > 0, F.col("_xy") / den).alias("spearman"))


def rank_correlations(wide: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Spearman of pairs of columns of one table: ``x``, ``y``, ``spearman``, each over the rows where both have a value.

    Equal rows are counted once for all pairs, and a column is ranked once however many
    pairs it is in: its values are counted, ranked by running counts and handed back to
    the counted rows, so no table grows with the number of pairs. Two columns that lack
    values in different rows have ranks of their own (:func:`spearman`).
    """
    pairs, columns = list(dict.fromkeys(pairs)), list(dict.fromkeys(c for p in pairs for c in p))
    cells = wide.select(*[F.col(c).cast("double").alias(c) for c in columns]).groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    cells = stored(cells, "cells")
    has = lambda x, y: F.sum(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.col("_n")).otherwise(F.lit(0)))
    held = cells.agg(*[has(c, c).alias(f"_c{i}") for i, c in enumerate(columns)], *[has(*p).alias(f"_p{i}") for i, p in enumerate(pairs)]).first()
    rows = dict(zip(columns, held))
    same = [p for i, p in enumerate(pairs) if held[f"_p{i}"] and held[f"_p{i}"] == rows[p[0]] == rows[p[1]]]
    out = []
    if same:
        ranked = list(dict.fromkeys(c for p in same for c in p))
        long = cells.select("_n", F.inline(F.array(*[F.struct(F.lit(c).alias("_of"), F.col(c).alias("_v")) for c in ranked]))).where("_v IS NOT NULL")
        values = long.groupBy("_of", "_v").agg(F.sum("_n").alias("_n"))
        ranks = stored(order.weighted_ranks(values, ["_of"], "_v", "_n", "_r").select("_of", "_v", "_r"), "ranks")
        many = {r["_of"] for r in ranks.groupBy("_of").count().where(F.col("count") > order.BROADCAST_ROWS).collect()}
        by_row = cells
        for c in ranked:
            mine = ranks.where(F.col("_of") == c).select(F.col("_v").alias(c), F.col("_r").alias("_r"))
            by_row = by_row.join(mine if c in many else F.broadcast(mine), c, "left").withColumn(c, F.col("_r")).drop("_r")
        # ranks come centred, so sums of products are enough
        product = lambda x, y: F.sum(F.col("_n") * F.col(x) * F.col(y))
        sums = by_row.agg(*[product(c, c).alias(f"_s{i}") for i, c in enumerate(ranked)], *[product(*p).alias(f"_p{i}") for i, p in enumerate(same)])
        den = [F.sqrt(f"_s{ranked.index(x)}") * F.sqrt(f"_s{ranked.index(y)}") for x, y in same]
        out.append(sums.select(F.inline(F.array(*[
            F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.when(d > 0, F.col(f"_p{i}") / d).alias("spearman")) for i, ((x, y), d) in enumerate(zip(same, den))]))))
    other = [p for p in pairs if p not in same]
    if other:
        long = cells.select("_n", F.inline(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(x).alias("_x"), F.col(y).alias("_y")) for x, y in other])))
        out.append(spearman(long, ["x", "y"], "_x", "_y", "_n"))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def band_correspondence(wide: DataFrame, stored_: Sequence[str], reference: Sequence[str], rho: DataFrame | None = None) -> DataFrame:
    """Spearman of every stored band against every reference band, the first best one flagged.

    ``rho`` may hold the :func:`rank_correlations` of these pairs. Ranks are over the
    rows where both bands have a value; a pair without such a row is left out.
    """
    place = F.array_position(F.array(*[F.lit(r) for r in reference]), F.col("reference"))
    rho = stored(rank_correlations(wide, [(s, r) for s in stored_ for r in reference]), "rho") if rho is None else rho
    rho = rho.where(F.col("x").isin(list(stored_)) & F.col("y").isin(list(reference))).select(F.col("x").alias("stored"), F.col("y").alias("reference"), F.col("spearman").alias("rho"))
    best = rho.groupBy("stored").agg(F.max_by("reference", F.struct("rho", -place)).alias("_best"))
    return rho.join(F.broadcast(best), "stored").select("stored", "reference", "rho", (F.col("reference") == F.col("_best")).alias("is_best"))


def value_histogram(df: DataFrame, keys: Sequence[str], bins: int = 50, log: bool = False,
                    trim: tuple[float, float] = (0.005, 0.995), value: str = "value", shared: Sequence[str] = (),
                    pct: DataFrame | None = None, above: DataFrame | None = None) -> DataFrame:
    """Density over edges that span the trim percentiles of the rows that share them.

    ``shared`` names the keys that have edges of their own (``band``: one set of
    edges per band, the same for all views); without it all rows share one. The
    upper edge belongs to the last bin; rows outside the edges do not count towards
    the density. ``log`` takes equal steps of the logarithm, from the lower trim of
    the positive values, 1 at least. ``pct`` and ``above`` may hold the trim percentiles
    of all values and the lower one of the positive values, as arrays in ``pct``.
    """
    shared = list(shared)
    src = df.where(F.col(value).isNotNull())
    both = src if log is False else src.withColumn("_above", F.when(F.col(value) > 0, F.col(value)))
    pct = select.grouped_percentiles(both, shared, value, list(trim)) if pct is None else pct
    ends = pct.select(*shared, F.col("pct")[0].alias("_lo"), F.col("pct")[1].alias("_hi"))
    if log:
        low = (select.grouped_percentiles(both, shared, "_above", [trim[0]]) if above is None else above).select(*shared, F.col("pct")[0].alias("_low"))
        ends = (order.join_null_safe(ends, low, shared, "left") if shared else ends.withColumn("_low", low.scalar())).withColumn("_lo", F.greatest("_low", F.lit(1.0))).drop("_low")
    tf = (lambda c: F.log10(c)) if log else (lambda c: c)
    e = src.select(*dict.fromkeys([*keys, *shared]), F.col(value).alias("_v"))
    if shared:
        e = order.join_group_stats(e, ends, shared)
    else:
        end = ends.select(F.struct("_lo", "_hi")).scalar()
        e = e.select("*", end["_lo"].alias("_lo"), end["_hi"].alias("_hi"))
    e = e.where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
    pos = (tf(F.col("_v")) - tf(F.col("_lo"))) / (tf(F.col("_hi")) - tf(F.col("_lo")))
    e = e.withColumn("bin", F.least(F.floor(pos * bins), F.lit(bins - 1)).cast("int"))
    counts = stored(e.groupBy(*keys, "bin", "_lo", "_hi").agg(F.count(F.lit(1)).alias("n")), "counts")
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("_t"))
    step = (tf(F.col("_hi")) - tf(F.col("_lo"))) / bins

    def edge(i):
        x = tf(F.col("_lo")) + i * step
        return F.pow(F.lit(10.0), x) if log else x

    j = order.join_null_safe(counts, totals, list(keys))
    left, right = edge(F.col("bin")), edge(F.col("bin") + 1)
    return j.select(
        *keys, "bin", "n", left.alias("left"), right.alias("right"),
        (F.col("n") / (F.col("_t") * (right - left))).alias("density"),
    )


def approximation_error(a_cols: Sequence[str], b_cols: Sequence[str]):
    """Mean over bands of the absolute difference of two normalised views."""
    s = F.lit(0.0)
    for a, b in zip(a_cols, b_cols):
        s = s + F.abs(F.col(a) - F.col(b))
    return s / F.lit(float(len(a_cols)))


def class_error_stats(df: DataFrame, error: str = "error", label: str = "label") -> DataFrame:
    """Mean, std, count of the error per class with the pixel-weighted overall mean."""
    g = (
        df.where(F.col(label) != C.IGNORE_LABEL)
        .groupBy(label)
        .agg(
            F.avg(error).alias("mean"), F.stddev_pop(error).alias("std"), F.count(error).alias("n"), F.sum(error).alias("_s")
        )
    )
    t = g.agg(F.struct(F.sum("n").alias("n"), F.sum("_s").alias("s"))).scalar()
    return g.select(
        label, "mean", "std", "n", (F.col("n") * 100.0 / t["n"]).alias("share_pct"), (t["s"] / t["n"]).alias("overall_mean")
    )


# --- preparation ---------------------------------------------------------------
def select_bands(df: DataFrame, bands: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Band subset or permutation of a wide table; only these columns are read."""
    return df.select(*keep, *bands)


def reorder_stack(stack, order_: Sequence[int]):
    """The array form: elements of a band stack picked by position (from 0)."""
    return F.transform(F.array(*[F.lit(i) for i in order_]), lambda i: F.element_at(stack, (i + 1).cast("int")))


def normalize_by_stats(df: DataFrame, stats: DataFrame, value: str = "value", out: str = "norm") -> DataFrame:
    """Square root, clip and z-score with the statistics of each (view, band)."""
    j = order.join_group_stats(df, stats.select("view", "band", "mean", "std", "clip", "clip_mode"), ["view", "band"])
    root = exprs.clipped_sqrt(F.col(value), F.col("clip"), F.col("clip_mode"))
    return j.withColumn(out, exprs.zscore(root, F.col("mean"), F.col("std"))).drop("mean", "std", "clip", "clip_mode")


def percentile_stretch(df: DataFrame, keys: Sequence[str], value: str = "value", lo: float = 0.02, hi: float = 0.98,
                       reference=None, out: str = "stretched") -> DataFrame:
    """(x - p_lo) / (p_hi - p_lo) clipped to [0, 1], percentiles per group.

    ``reference`` is a condition choosing the rows that fix the percentiles; the
    stretch then applies to every row of the group.
    """
    base = df if reference is None else df.where(reference)
    p = select.grouped_percentiles(base, keys, value, [lo, hi])
    j = order.join_group_stats(df, p, list(keys), "left") if keys else df.withColumn("pct", p.select("pct").scalar())
    return j.withColumn(out, exprs.stretch(F.col(value), F.col("pct")[0], F.col("pct")[1])).drop("pct")


def minmax_scale(df: DataFrame, keys: Sequence[str], value: str = "value", eps: float = 1e-6, out: str = "scaled") -> DataFrame:
    m = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    j = order.join_group_stats(df, m, list(keys))
    return j.withColumn(out, (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + F.lit(eps))).drop("_lo", "_hi")


def above_median_label(df: DataFrame, col: str, out: str = "label") -> DataFrame:
    """1 above the median, 0 otherwise, null where the value is null."""
    med = select.grouped_percentiles(df, [], col, [0.5]).select(F.col("pct")[0]).scalar()
    return df.withColumn(out, (F.col(col) > med).cast("int"))


def pixel_max_diff(pairs: DataFrame, keys: Sequence[str], a: Sequence[str], b: Sequence[str]) -> DataFrame:
    """Largest absolute pixel difference over all bands, per key."""
    diffs = [F.max(F.abs(F.col(x) - F.col(y))) for x, y in zip(a, b)]
    worst = F.greatest(*diffs) if len(diffs) > 1 else diffs[0]
    g = pairs.groupBy(*keys) if keys else pairs.groupBy()
    return g.agg(worst.alias("pixel_max_diff"))
