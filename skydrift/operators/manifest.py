"""What a dataset consists of, read off its manifest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import exprs, order, select
from ..session import stored
from . import pairing


def class_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("wc_frac_")]


def lag_histogram(df: DataFrame, width: float = 0.5, lag: str = "patch_delta_days") -> DataFrame:
    """Rows per bin of ``width`` days, with the median and longest lag alongside."""
    d = df.where(F.col(lag).isNotNull())
    med = select.grouped_percentiles(d, [], lag, [0.5]).select(F.col("pct")[0]).scalar()
    h = d.groupBy((F.floor(F.col(lag) / width) * width).alias("bin_start")).agg(F.count(F.lit(1)).alias("n"))
    return h.select("bin_start", "n", med.alias("lag_median"), d.agg(F.max(lag)).scalar().cast("double").alias("lag_max"))


def monthly_coverage(df: DataFrame, date: str = "date_phi") -> DataFrame:
    """Rows per calendar month, with first and last month and the months covered."""
    m = df.where(F.col(date).isNotNull()).groupBy(F.date_format(date, "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    t = m.agg(F.struct(F.min("month").alias("a"), F.max("month").alias("b"), F.count(F.lit(1)).alias("k"))).scalar()
    return m.select("month", "n", t["a"].alias("first_month"), t["b"].alias("last_month"), t["k"].alias("months"))


def ecdf(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Share of rows at or below every value that occurs, per column."""
    long = df.unpivot([], list(cols), "variable", "value").where(F.col("value").isNotNull())
    n = long.groupBy("variable", "value").agg(F.count(F.lit(1)).alias("n"))
    run = order.prefix_sum(n, ["variable"], "value", "n", "upto", "total")
    return run.select("variable", "value", (F.col("upto") / F.col("total")).alias("share"))


def pct_below(df: DataFrame, cols: Sequence[str], threshold: float) -> DataFrame:
    """Percent of rows whose sum over ``cols`` (null as 0) is under the threshold."""
    s = F.lit(0.0)
    for c in cols:
        s = s + F.coalesce(F.col(c), F.lit(0.0))
    return df.agg((F.avg((s < threshold).cast("double")) * 100.0).alias("pct_below"))


def class_prior(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean class share in percent, overall or per split."""
    cols = class_columns(df)
    means = df.groupBy(*by).agg(*[(F.avg(c) * 100.0).alias(c) for c in cols])
    return means.unpivot(list(by), cols, "code", "pct").withColumn(
        "code", F.regexp_extract("code", r"(\d+)$", 1).cast("int")
    )


def rank_by_value(df: DataFrame, value: str, ascending: bool = False) -> DataFrame:
    """Small result in value order, null as 0."""
    c = F.coalesce(F.col(value), F.lit(0.0))
    return df.orderBy(c.asc() if ascending else c.desc())


def dominant_counts(df: DataFrame, codes: Sequence[int] = C.LAND_COVER_CODES) -> DataFrame:
    """Rows per dominant class in legend order, classes without rows included."""
    n = df.where(F.col("wc_dominant_class").isNotNull()).groupBy(F.col("wc_dominant_class").alias("code")).agg(F.count(F.lit(1)).alias("n"))
    legend = df.sparkSession.createDataFrame([(i, int(c)) for i, c in enumerate(codes)], "position int, code int")
    med = select.grouped_percentiles(df, [], "wc_dominant_frac", [0.5]).select(F.col("pct")[0]).scalar()
    return F.broadcast(legend).join(n, "code", "left").select(
        "position", "code", F.coalesce("n", F.lit(0)).alias("n"), med.alias("median_dominance")
    )


def density_grid(df: DataFrame, x: str, y: str, nx: int, ny: int, x_range: tuple[float, float], y_range: tuple[float, float]) -> DataFrame:
    """Points per cell of a square grid; the far edge belongs to the last cell."""

    def cell(col, n, lo, hi):
        i = F.floor((F.col(col) - lo) / F.lit((hi - lo) / n))
        return F.least(i, F.lit(n - 1)).cast("int")

    inside = F.col(x).between(*x_range) & F.col(y).between(*y_range)
    return df.where(inside).groupBy(cell(x, nx, *x_range).alias("cell_x"), cell(y, ny, *y_range).alias("cell_y")).agg(
        F.count(F.lit(1)).alias("n")
    )


def climate_counts(df: DataFrame, zone: str = "koppen_zone") -> DataFrame:
    """Rows and percent of all rows per climate group."""
    total = df.agg(F.count(F.lit(1))).scalar()
    g = df.select(exprs.koppen_group(F.col(zone)).alias("climate_group")).where(F.col("climate_group").isNotNull())
    n = g.groupBy("climate_group").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("pct", F.col("n") * 100.0 / total)


def group_sizes(df: DataFrame, key: str = "product_id") -> DataFrame:
    """Number of groups, and median and largest group size."""
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    t = select.stats_with_percentiles(g, [], "n", [F.count(F.lit(1)).alias("groups"), F.max("n").alias("largest")], [0.5])
    return t.select("groups", F.col("pct")[0].alias("median_size"), "largest")


def group_size_histogram(df: DataFrame, key: str = "product_id") -> DataFrame:
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("size"))
    return g.groupBy("size").agg(F.count(F.lit(1)).alias("groups"))


def manifest_summary(raw: DataFrame, bad_ids: Sequence[int] = tuple(C.BAD_PRODUCT_IDS), split: str = "split") -> DataFrame:
    """One row about the whole manifest. ``raw`` already carries a split column.

    The manifest is read once; what the summary needs of it is kept in the shared
    folder, and a second table has one row per product. Both medians are one selection.
    """
    raw = stored(raw.select("product_id", split, "patch_delta_days", "thick_cloud_pct", "thin_cloud_pct", "wc_nodata_frac", "date_phi", *class_columns(raw)), "manifest")
    kept = pairing.drop_bad_products(raw, bad_ids)
    here = F.col(split)
    products = stored(kept.groupBy("product_id").agg(F.count(F.lit(1)).alias("n"), (F.count_if(here == "test") > 0).alias("test"), (F.count_if(here == "train") > 0).alias("train")), "products")
    both = kept.select(F.lit("days").alias("of"), F.col("patch_delta_days").cast("double").alias("value")).unionByName(products.select(F.lit("size").alias("of"), F.col("n").cast("double").alias("value")))
    medians = select.grouped_percentiles(both, ["of"], "value", [0.5])
    median = medians.agg(F.struct(*[F.max(F.when(F.col("of") == name, F.col("pct")[0])).alias(name) for name in ("days", "size")])).scalar()
    per = products.agg(F.struct(F.max("n").alias("largest"), F.count("product_id").alias("products"), F.count_if(F.col("test") & F.col("train")).alias("shared"), F.count_if("test").alias("tested"))).scalar()
    cloud = F.coalesce("thick_cloud_pct", F.lit(0.0)) + F.coalesce("thin_cloud_pct", F.lit(0.0))
    prior = F.create_map(*[x for c in class_columns(raw) for x in (F.lit(c[len("wc_frac_"):]), F.avg(c) * 100.0)])
    one = kept.agg(
        F.count(F.lit(1)).alias("patches"), F.avg("patch_delta_days").alias("delta_days_mean"), F.max("patch_delta_days").cast("double").alias("delta_days_max"),
        (F.avg((cloud < 5).cast("double")) * 100.0).alias("pct_under_5pct_cloud"), (F.avg("wc_nodata_frac") * 100.0).alias("unlabelled_pixel_pct"),
        F.min("date_phi").alias("first_date"), F.max("date_phi").alias("last_date"),
        *[F.count_if(here == name).alias(f"n_{name}") for name in ("train", "val", "test")], prior.alias("class_prior_pct"),
    )
    return one.select(
        raw.agg(F.count(F.lit(1))).scalar().alias("patches_in_manifest"), "patches", per["products"].alias("products"),
        median["size"].alias("patches_per_product_median"), per["largest"].alias("patches_per_product_max"),
        median["days"].alias("delta_days_median"), "delta_days_mean", "delta_days_max", "pct_under_5pct_cloud",
        "unlabelled_pixel_pct", "first_date", "last_date", "n_train", "n_val", "n_test",
        per["shared"].alias("leaked_products"), per["tested"].alias("test_products"),
        "class_prior_pct",
    )
