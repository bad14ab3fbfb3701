from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import select
from ...operators import manifest as M
from ...operators import pairing as P
from ...operators import splits as S
from .. import adapters as A
from ..adapters import r, rnd, with_ctes
from ..registry import query
from .pairs import SPLIT_CTES

# products left out here: a literal list, as the reference's own is for other ids
BAD = [0, 3, 17, 42, 99, 123, 250, 777]
_BAD_SQL = "product_id NOT IN (" + ", ".join(map(str, BAD)) + ") OR product_id IS NULL"
CODES = [10, 20, 30]


@query("lag_histogram", with_ctes("manifest", """
    SELECT floor(patch_delta_days / 0.5) * 0.5::DOUBLE AS bin_start, count(*) AS n, any_value(med) AS lag_median, any_value(mx) AS lag_max
    FROM manifest, (SELECT quantile_cont(patch_delta_days, 0.5) AS med, max(patch_delta_days) AS mx FROM manifest) WHERE patch_delta_days IS NOT NULL GROUP BY 1"""))
def lag_histogram(spark, sf):
    return M.lag_histogram(A.manifest(spark, sf))


@query("monthly_coverage", with_ctes("manifest", """
    SELECT month, n, min(month) OVER () AS first_month, max(month) OVER () AS last_month, count(*) OVER () AS months FROM (SELECT strftime(date_phi, '%Y-%m') AS month, count(*) AS n FROM manifest GROUP BY 1)"""))
def monthly_coverage(spark, sf):
    return M.monthly_coverage(A.manifest(spark, sf))


@query("ecdf", with_ctes("manifest", f"""
    SELECT variable, {r('value')} AS value, {r('sum(n) OVER (PARTITION BY variable ORDER BY value) / sum(n) OVER (PARTITION BY variable)')} AS share FROM (
        SELECT variable, value, count(*) AS n FROM (SELECT 'thick_cloud_pct' AS variable, thick_cloud_pct AS value FROM manifest UNION ALL SELECT 'thin_cloud_pct', thin_cloud_pct FROM manifest
        UNION ALL SELECT 'patch_delta_days', patch_delta_days FROM manifest) WHERE value IS NOT NULL GROUP BY ALL)"""))
def ecdf(spark, sf):
    return A.rounded(M.ecdf(A.manifest(spark, sf), ["thick_cloud_pct", "thin_cloud_pct", "patch_delta_days"]))


@query("pct_below", with_ctes("manifest", f"SELECT {r('100.0 * avg((coalesce(thick_cloud_pct, 0) + coalesce(thin_cloud_pct, 0) < 5)::INT)')} AS pct_below FROM manifest"))
def pct_below(spark, sf):
    return A.rounded(M.pct_below(A.manifest(spark, sf), ["thick_cloud_pct", "thin_cloud_pct"], 5.0))


_PRIOR = " UNION ALL ".join(f"SELECT {c} AS code, avg(wc_frac_{c}) * 100 AS pct FROM manifest" for c in CODES)


@query("class_prior", with_ctes("manifest", f"SELECT code, {r('pct')} AS pct FROM ({_PRIOR})"))
def class_prior(spark, sf):
    return A.rounded(M.class_prior(A.manifest(spark, sf)))


@query("rank_by_value", with_ctes("manifest", f"SELECT code, {r('pct')} AS pct, row_number() OVER (ORDER BY coalesce(pct, 0) DESC) AS place FROM ({_PRIOR})"))
def rank_by_value(spark, sf):
    """Largest class first; the place makes the order part of the result."""
    from pyspark.sql import Window

    p = M.rank_by_value(M.class_prior(A.manifest(spark, sf)), "pct")
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(F.coalesce("pct", F.lit(0.0))))).cast("long")
    return p.select("code", rnd("pct").alias("pct"), place.alias("place"))


@query("class_prior_by_split", with_ctes("manifest", " UNION ALL ".join(f"SELECT split, {c} AS code, {r(f'avg(wc_frac_{c}) * 100')} AS pct FROM sp GROUP BY split" for c in CODES), SPLIT_CTES))
def class_prior_by_split(spark, sf):
    return A.rounded(M.class_prior(S.random_split(A.manifest(spark, sf), ["patch_index"]), ["split"]))


@query("dominant_counts", with_ctes("manifest", f"""
    SELECT position, c.code, coalesce(n, 0) AS n, (SELECT {r('quantile_cont(wc_dominant_frac, 0.5)')} FROM manifest) AS median_dominance
    FROM (SELECT unnest(range(0, 4))::INT AS position, unnest([10, 20, 30, 40])::INT AS code) c LEFT JOIN (SELECT wc_dominant_class AS code, count(*) AS n FROM manifest GROUP BY 1) USING (code)"""))
def dominant_counts(spark, sf):
    return A.rounded(M.dominant_counts(A.manifest(spark, sf), [*CODES, 40]))


@query("density_grid", with_ctes("manifest", """
    SELECT least(floor((center_lon + 180) / 10.0), 35)::INT AS cell_x, least(floor((center_lat + 90) / 10.0), 17)::INT AS cell_y, count(*) AS n FROM manifest
    WHERE center_lon BETWEEN -180 AND 180 AND center_lat BETWEEN -90 AND 90 GROUP BY ALL"""))
def density_grid(spark, sf):
    return M.density_grid(A.manifest(spark, sf), "center_lon", "center_lat", 36, 18, (-180.0, 180.0), (-90.0, 90.0))


@query("climate_counts", with_ctes("manifest", f"""
    SELECT climate_group, n, {r('100.0 * n / (SELECT count(*) FROM manifest)')} AS pct FROM (
        SELECT CASE WHEN koppen_zone = 0 THEN 'no data' WHEN koppen_zone <= 3 THEN 'A  Tropical' WHEN koppen_zone <= 7 THEN 'B  Arid' WHEN koppen_zone <= 16 THEN 'C  Temperate'
               WHEN koppen_zone <= 28 THEN 'D  Continental' WHEN koppen_zone <= 30 THEN 'E  Polar' END AS climate_group, count(*) AS n FROM manifest GROUP BY 1) WHERE climate_group IS NOT NULL"""))
def climate_counts(spark, sf):
    return A.rounded(M.climate_counts(A.manifest(spark, sf)))


@query("group_sizes", with_ctes("manifest", "SELECT count(*) AS groups, quantile_cont(n, 0.5)::DOUBLE AS median_size, max(n) AS largest FROM (SELECT count(*) AS n FROM manifest GROUP BY product_id)"))
def group_sizes(spark, sf):
    return M.group_sizes(A.manifest(spark, sf).select("product_id"))


@query("group_size_histogram", with_ctes("manifest", "SELECT size, count(*) AS groups FROM (SELECT count(*) AS size FROM manifest GROUP BY product_id) GROUP BY size"))
def group_size_histogram(spark, sf):
    return M.group_size_histogram(A.manifest(spark, sf).select("product_id"))


def flat_summary(summary):
    """The summary row with its class prior as columns."""
    pct = F.col("class_prior_pct")
    s = summary.select(
        *[c for c in summary.columns if c not in ("class_prior_pct", "first_date", "last_date")],
        F.col("first_date").cast("string").alias("first_date"), F.col("last_date").cast("string").alias("last_date"),
        *[F.try_element_at(pct, F.lit(str(c))).alias(f"prior_{c}") for c in CODES],
    )
    return A.rounded(s, 4)


SUMMARY_SQL = with_ctes("manifest", f"""
    SELECT (SELECT count(*) FROM manifest) AS patches_in_manifest, count(*) AS patches, count(DISTINCT product_id) AS products, (SELECT quantile_cont(n, 0.5)::DOUBLE FROM gs) AS patches_per_product_median,
           (SELECT max(n) FROM gs) AS patches_per_product_max, {r('quantile_cont(patch_delta_days, 0.5)', 4)} AS delta_days_median, {r('avg(patch_delta_days)', 4)} AS delta_days_mean,
           {r('max(patch_delta_days)', 4)} AS delta_days_max, {r('100.0 * avg((coalesce(thick_cloud_pct, 0) + coalesce(thin_cloud_pct, 0) < 5)::INT)', 4)} AS pct_under_5pct_cloud,
           {r('100.0 * avg(wc_nodata_frac)', 4)} AS unlabelled_pixel_pct, min(date_phi)::VARCHAR AS first_date, max(date_phi)::VARCHAR AS last_date, count(*) FILTER (WHERE split = 'train') AS n_train,
           count(*) FILTER (WHERE split = 'val') AS n_val, count(*) FILTER (WHERE split = 'test') AS n_test,
           (SELECT count(*) FROM (SELECT product_id FROM kp WHERE split = 'train' INTERSECT SELECT product_id FROM kp WHERE split = 'test')) AS leaked_products,
           (SELECT count(DISTINCT product_id) FROM kp WHERE split = 'test') AS test_products, {', '.join(f'{r(f"100.0 * avg(wc_frac_{c})", 4)} AS prior_{c}' for c in CODES)} FROM kp""",
    {**SPLIT_CTES, "kp": f"SELECT * FROM sp WHERE {_BAD_SQL}", "gs": "SELECT count(*) AS n FROM kp GROUP BY product_id"})


@query("manifest_summary", SUMMARY_SQL)
def manifest_summary(spark, sf):
    return flat_summary(M.manifest_summary(S.random_split(A.manifest(spark, sf), ["patch_index"]), BAD))


# --- splits and samples -------------------------------------------------------------
@query("random_split", with_ctes("manifest", "SELECT patch_index, split FROM sp", SPLIT_CTES))
def random_split(spark, sf):
    return S.random_split(A.manifest(spark, sf).select("patch_index"), ["patch_index"])


_SLOT = "('0x' || md5('42:' || product_id)[1:13])::BIGINT"
_GSPLIT = {"gsp": f"SELECT patch_index, product_id, CASE WHEN slot < {int(0.8 * 2**52)} THEN 'train' WHEN slot < {int(0.9 * 2**52)} THEN 'val' ELSE 'test' END AS split FROM (SELECT *, {_SLOT} AS slot FROM manifest)"}


@query("group_split", with_ctes("manifest", "SELECT * FROM gsp", _GSPLIT))
def group_split(spark, sf):
    return S.group_split(A.manifest(spark, sf).select("patch_index", "product_id"), "product_id")


@query("group_split_leakage", with_ctes("manifest", "SELECT 0::BIGINT AS shared, count(DISTINCT product_id) AS total FROM gsp WHERE split = 'test'", _GSPLIT))
def group_split_leakage(spark, sf):
    """Whole products go to one split, so none is shared."""
    return P.split_leakage(S.group_split(A.manifest(spark, sf).select("patch_index", "product_id"), "product_id"), "product_id")


@query("sample_n", with_ctes("manifest", "SELECT patch_index, product_id FROM (SELECT * FROM manifest ORDER BY md5('42:' || patch_index) LIMIT 200)"))
def sample_n(spark, sf):
    return S.sample_n(A.manifest(spark, sf).select("patch_index", "product_id"), 200, ["patch_index"])


@query("sample_pixels", with_ctes("pixels_long", """
    SELECT patch_index, y, x, view, band FROM pixels_long SEMI JOIN (SELECT patch_index, y, x FROM (SELECT DISTINCT patch_index, y, x FROM pixels_long)
        QUALIFY row_number() OVER (PARTITION BY patch_index ORDER BY md5('42:' || patch_index || ':' || y || ':' || x)) <= 3) USING (patch_index, y, x)"""))
def sample_pixels(spark, sf):
    return S.sample_pixels(A.pixels_long(spark, sf).drop("value"), 3)


@query("balanced_sample", with_ctes("masks", """
    SELECT patch_index, y, x, label FROM masks WHERE label <> -1 QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5('42:' || patch_index || ':' || y || ':' || x)) <= 500"""))
def balanced_sample(spark, sf):
    return S.balanced_sample(A.masks(spark, sf).select("patch_index", "y", "x", "label"), "label", 500, ["patch_index", "y", "x"])


@query("train_test_70_30", with_ctes("layer_embeddings", """
    SELECT item_id, domain, layer, CASE WHEN rn < floor(0.7::DOUBLE * n) THEN 'train' ELSE 'test' END AS split FROM layer_embeddings
    JOIN (SELECT vec_id AS item_id, row_number() OVER (ORDER BY md5('42:' || vec_id)) - 1 AS rn, count(*) OVER () AS n FROM embeddings) USING (item_id)"""))
def train_test_70_30(spark, sf):
    return S.train_test_70_30(A.layer_embeddings(spark, sf).select("item_id", "domain", "layer"))


@query("permute_labels", with_ctes("vectors", """
    SELECT item_id, label, permuted FROM (SELECT item_id, label, row_number() OVER (ORDER BY item_id) AS i FROM vectors) JOIN (
        SELECT label AS permuted, row_number() OVER (ORDER BY md5('1:' || item_id)) AS i FROM vectors) USING (i)"""))
def permute_labels(spark, sf):
    return S.permute_labels(A.vectors(spark, sf).select("item_id", "label"), "item_id", "label")


@query("range_percentiles", with_ctes("pixels_long", f"SELECT view, band, {r('quantile_cont(value, 0.02)', 4)} AS p2, {r('quantile_cont(value, 0.5)', 4)} AS p50, {r('quantile_cont(value, 0.999)', 4)} AS p999 FROM pixels_long GROUP BY ALL"))
def range_percentiles(spark, sf):
    """Exact percentiles on the large-table path, whatever the size of the data."""
    px = A.pixels_long(spark, sf)
    p = select.grouped_percentiles(px, ["view", "band"], "value", [0.02, 0.5, 0.999])
    return A.rounded(p.select("view", "band", *[F.col("pct")[i].alias(n) for i, n in enumerate(("p2", "p50", "p999"))]), 4)
