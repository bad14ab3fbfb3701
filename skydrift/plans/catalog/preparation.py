from __future__ import annotations

from pyspark.sql import functions as F

from ... import constants as C
from ...functions import exprs as X
from ...operators import bands as B
from ...operators import embedding as emb
from ...operators import pairing as P
from ...operators import raster as R
from .. import adapters as A
from ..adapters import r, rnd, with_ctes
from ..registry import query

_KEY = ("patch_index", "y", "x")


@query("select_bands", with_ctes("pixels_wide", f"SELECT patch_index, y, x, {r('a_nir')} AS nir, {r('a_red')} AS red, {r('a_green')} AS green FROM pixels_wide"))
def select_bands(spark, sf):
    return A.rounded(B.select_bands(A.pixels_view(spark, sf, "a"), ["nir", "red", "green"], _KEY))


@query("reorder_stack", with_ctes("pixels_wide", f"SELECT patch_index, y, x, {r('a_nir')} AS s0, {r('a_blue')} AS s1, {r('a_red')} AS s2 FROM pixels_wide"))
def reorder_stack(spark, sf):
    p = A.pixels_view(spark, sf, "a").withColumn("s", B.reorder_stack(F.array(*A.BANDS), [3, 0, 2]))
    return p.select(*_KEY, *[rnd(F.col("s")[i]).alias(f"s{i}") for i in range(3)])



@query("drop_bad_products", with_ctes("manifest", f"SELECT patch_index, product_id FROM manifest WHERE product_id NOT IN ({', '.join(map(str, C.BAD_PRODUCT_IDS))}) OR product_id IS NULL"))
def drop_bad_products(spark, sf):
    return P.drop_bad_products(A.manifest(spark, sf), C.BAD_PRODUCT_IDS).select("patch_index", "product_id")


@query("filter_cloud", with_ctes("manifest", f"SELECT patch_index, {r('thick_cloud_pct')} AS thick_cloud_pct FROM manifest WHERE thick_cloud_pct + thin_cloud_pct <= 5"))
def filter_cloud(spark, sf):
    return A.rounded(B.filter_cloud(A.manifest(spark, sf), 5.0).select("patch_index", "thick_cloud_pct"))


@query("valid_pixels", with_ctes("pixels_long", "SELECT view, band, count(*) AS n FROM pixels_long WHERE value <> 2000 AND value > 0 GROUP BY ALL"))
def valid_pixels(spark, sf):
    return B.valid_pixels(A.pixels_long(spark, sf), nodata=2000.0).groupBy("view", "band").agg(F.count(F.lit(1)).alias("n"))


@query("scale_clip", with_ctes("pixels_long", f"SELECT patch_index, y, x, view, band, {r('least(greatest(value / 4000.0::DOUBLE, 0), 1)')} AS scaled FROM pixels_long"))
def scale_clip(spark, sf):
    return A.pixels_long(spark, sf).select(*_KEY, "view", "band", rnd(X.scale_clip(F.col("value"), 4000.0)).alias("scaled"))


def _stats_table(spark):
    """Published statistics of two views for the bands used here (fixed size)."""
    pos = {"blue": 0, "green": 1, "red": 2, "nir": 6}
    rows = [
        (view, band, C.DOMAIN_STATS[name]["mean"][i], C.DOMAIN_STATS[name]["std"][i], C.DOMAIN_STATS[name]["clip"], C.DOMAIN_STATS[name]["clip_mode"])
        for view, name in (("a", "real"), ("b", "s2b")) for band, i in pos.items()
    ]
    return rows, spark.createDataFrame(rows, "view string, band string, mean double, std double, clip double, clip_mode string") if spark else None


def _stats_sql():
    rows, _ = _stats_table(None)
    return "SELECT * FROM (VALUES " + ", ".join(f"('{v}', '{b}', {m}::DOUBLE, {s}::DOUBLE, {c}::DOUBLE, '{k}')" for v, b, m, s, c, k in rows) + ") t(view, band, mean, std, clip, clip_mode)"


_SMOOTH = "clip - (greatest(z, 0) + ln(1 + exp(-abs(z)))) / (4.0::DOUBLE / 6.0::DOUBLE)"


@query("sqrt_clip_zscore", with_ctes("pixels_long", f"""
    SELECT patch_index, y, x, view, band, {r(f"(CASE WHEN clip_mode = 'smooth' THEN {_SMOOTH} ELSE least(root, clip) END - mean) / std")} AS norm
    FROM (SELECT *, sqrt(greatest(value, 0)) AS root, 4.0::DOUBLE / 6.0::DOUBLE * (clip - sqrt(greatest(value, 0))) AS z FROM pixels_long JOIN st USING (view, band))""", {"st": _stats_sql()}))
def sqrt_clip_zscore(spark, sf):
    n = B.normalize_by_stats(A.pixels_long(spark, sf), _stats_table(spark)[1])
    return n.select(*_KEY, "view", "band", rnd("norm").alias("norm"))


@query("smooth_clip", with_ctes("pixels_long", f"""
    SELECT patch_index, y, x, view, band, {r(_SMOOTH)} AS clipped FROM (SELECT *, 38.729::DOUBLE AS clip, 4.0::DOUBLE / 6.0::DOUBLE * (38.729::DOUBLE - sqrt(greatest(value, 0))) AS z FROM pixels_long)"""))
def smooth_clip(spark, sf):
    root = F.sqrt(F.greatest(F.col("value"), F.lit(0.0)))
    return A.pixels_long(spark, sf).select(*_KEY, "view", "band", rnd(X.smooth_clip(root, 38.729)).alias("clipped"))


@query("plain_zscore", with_ctes("pixels_long", f"SELECT patch_index, y, x, view, band, {r('(value / 10000.0::DOUBLE - 0.1137::DOUBLE) / 0.0931::DOUBLE')} AS z FROM pixels_long"))
def plain_zscore(spark, sf):
    return A.pixels_long(spark, sf).select(*_KEY, "view", "band", rnd(X.zscore(F.col("value") / 10000.0, F.lit(0.1137), F.lit(0.0931))).alias("z"))


_STRETCH = "least(greatest((value - lo) / greatest(hi - lo, 1e-6), 0), 1)"


@query("percentile_stretch", with_ctes("pixels_long", f"""
    SELECT patch_index, y, x, view, band, {r(_STRETCH)} AS stretched FROM pixels_long
    JOIN (SELECT view, band, quantile_cont(value, 0.02) AS lo, quantile_cont(value, 0.98) AS hi FROM pixels_long GROUP BY ALL) USING (view, band)"""))
def percentile_stretch(spark, sf):
    s = B.percentile_stretch(A.pixels_long(spark, sf), ["view", "band"])
    return s.select(*_KEY, "view", "band", rnd("stretched").alias("stretched"))


@query("reference_stretch", with_ctes("pixels_long", f"""
    SELECT patch_index, y, x, view, band, {r(_STRETCH)} AS stretched FROM pixels_long
    JOIN (SELECT band, quantile_cont(value, 0.02) AS lo, quantile_cont(value, 0.98) AS hi FROM pixels_long WHERE view = 'a' GROUP BY ALL) USING (band)"""))
def reference_stretch(spark, sf):
    """Percentiles of view a fix the stretch of both views."""
    s = B.percentile_stretch(A.pixels_long(spark, sf), ["band"], reference=F.col("view") == "a")
    return s.select(*_KEY, "view", "band", rnd("stretched").alias("stretched"))


@query("minmax_scale", with_ctes("pixels_long", f"""
    SELECT patch_index, y, x, view, band, {r('(value - lo) / (hi - lo + 1e-6)')} AS scaled FROM pixels_long
    JOIN (SELECT view, band, min(value) AS lo, max(value) AS hi FROM pixels_long GROUP BY ALL) USING (view, band)"""))
def minmax_scale(spark, sf):
    return B.minmax_scale(A.pixels_long(spark, sf), ["view", "band"]).select(*_KEY, "view", "band", rnd("scaled").alias("scaled"))


@query("remap_labels", """
    SELECT l_orderkey, l_linenumber, CASE code WHEN 10 THEN 0 WHEN 20 THEN 1 WHEN 30 THEN 2 WHEN 40 THEN 3 WHEN 50 THEN 4 WHEN 60 THEN 5 WHEN 70 THEN 6 WHEN 80 THEN 7 WHEN 90 THEN 8
           WHEN 95 THEN 9 WHEN 100 THEN 10 ELSE -1 END AS label FROM (SELECT *, (l_quantity::INT % 25) * 5 AS code FROM lineitem)""")
def remap_labels(spark, sf):
    code = (F.col("l_quantity").cast("int") % 25) * 5
    return A.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", X.remap_labels(code).alias("label"))


@query("binary_mask", """
    SELECT l_orderkey, l_linenumber, CASE code WHEN 1 THEN 1 WHEN -1 THEN -1 ELSE 0 END AS mask, CASE code WHEN 1 THEN 1 WHEN 0 THEN 0 ELSE -1 END AS strict_mask
    FROM (SELECT *, l_quantity::INT % 4 - 1 AS code FROM lineitem)""")
def binary_mask(spark, sf):
    code = F.col("l_quantity").cast("int") % 4 - 1
    return A.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", X.binary_mask(code).alias("mask"), X.binary_mask(code, strict=True).alias("strict_mask"))


@query("counterpart_key", with_ctes("split_rows", "SELECT doc_id, replace(s1_file, 'S1Hand', 'S2Hand') AS partner, s1_file AS bare FROM split_rows"))
def counterpart_key(spark, sf):
    s = A.split_rows(spark, sf)
    sim = F.concat(F.lit("simulated_"), "s1_file")
    return s.select("doc_id", X.counterpart_key(F.col("s1_file"), "S1Hand", "S2Hand").alias("partner"), X.strip_prefix(sim).alias("bare"))


@query("name_parts", with_ctes("split_rows", """
    SELECT doc_id, split_part(s1_file, '_', 1) AS location, split_part(s1_file, '_', 1) || '_' || doc_id AS sample_id FROM split_rows"""))
def name_parts(spark, sf):
    return A.split_rows(spark, sf).select("doc_id", X.stem_id(F.col("s1_file")).alias("location"), X.sample_id(F.col("s1_file")).alias("sample_id"))


@query("parse_variant", r"""
    SELECT event_id, CASE WHEN v = 'clean' THEN 'none' WHEN regexp_matches(v, '^.+_l\d+$') THEN regexp_extract(v, '^(.+)_l(\d+)$', 1) ELSE v END AS factor,
           CASE WHEN v = 'clean' THEN 0 WHEN regexp_matches(v, '^.+_l\d+$') THEN regexp_extract(v, '^(.+)_l(\d+)$', 2)::INT ELSE -1 END AS level
    FROM (SELECT event_id, CASE WHEN user_id % 5 = 0 THEN 'clean' WHEN user_id % 5 = 1 THEN event_type ELSE event_type || '_l' || (user_id % 5) END AS v FROM events)""")
def parse_variant(spark, sf):
    m = F.col("user_id") % 5
    v = F.when(m == 0, "clean").when(m == 1, F.col("event_type")).otherwise(F.concat("event_type", F.lit("_l"), m.cast("string")))
    e = A.table(spark, sf, "events").select("event_id", v.alias("v"))
    return e.select("event_id", X.variant_factor(F.col("v")).alias("factor"), X.variant_level(F.col("v")).alias("level"))


@query("scl_flags", "SELECT l_orderkey, l_linenumber, (scl IN (8, 9)) AS cloud, scl = 3 AS shadow, scl = 10 AS cirrus FROM (SELECT *, l_quantity::INT % 12 AS scl FROM lineitem)")
def scl_flags(spark, sf):
    scl = F.col("l_quantity").cast("int") % 12
    return A.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *[c.alias(n) for n, c in X.scl_flags(scl).items()])


_W = 0.21594369 + 0.28731533 + 0.25719303


@query("add_pan", with_ctes("pixels_wide", f"""
    SELECT patch_index, y, x, {r(f'a_blue * {0.21594369 / _W}::DOUBLE + a_green * {0.28731533 / _W}::DOUBLE + a_red * {0.25719303 / _W}::DOUBLE', 4)} AS pan,
           {r('(a_blue + a_green + a_red) / 3.0::DOUBLE', 4)} AS simple_pan FROM pixels_wide"""))
def add_pan(spark, sf):
    pan = R.pan_column({"B02": "blue", "B03": "green", "B04": "red", "B08": "nir"})
    return A.rounded(A.pixels_view(spark, sf, "a").select(*_KEY, pan.alias("pan"), R.visible_pan("blue", "green", "red").alias("simple_pan")), 4)


def _scene_meta(spark, sf):
    """Two metadata values and four band irradiances per supplier (a scene)."""
    s = A.table(spark, sf, "supplier")
    cells = F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.lit(1900.0 - 200.0 * i).alias("irradiance")) for i, b in enumerate(A.BANDS)]))
    return s.select(
        F.col("s_suppkey").alias("scene_id"), (F.col("s_nationkey") * 2.5).alias("sun_zenith"), (1.0 + F.col("s_acctbal") / 1037213.0).alias("earth_sun_dist"), cells.alias("c")
    ).select("scene_id", "sun_zenith", "earth_sun_dist", "c.*")


_META = """SELECT s_suppkey AS scene_id, s_nationkey * 2.5::DOUBLE AS sun_zenith, 1.0::DOUBLE + s_acctbal / 1037213.0::DOUBLE AS earth_sun_dist,
    unnest(['blue', 'green', 'red', 'nir']) AS band, unnest([1900.0::DOUBLE, 1700.0::DOUBLE, 1500.0::DOUBLE, 1300.0::DOUBLE]) AS irradiance FROM supplier"""
_SCENE_PX = "SELECT *, x % 100000 AS scene_id FROM pixels_long WHERE view = 'a'"
_FACTOR = "cos(radians(sun_zenith)) * earth_sun_dist / pi() * irradiance"


def _scene_pixels(spark, sf):
    return A.pixels_long(spark, sf).where("view = 'a'").withColumn("scene_id", F.col("x") % 100000)


@query("to_radiance", with_ctes("pixels_long", f"SELECT patch_index, y, x, band, {r(f'value / 10000.0::DOUBLE * ({_FACTOR})')} AS radiance FROM p JOIN m USING (scene_id, band)", {"p": _SCENE_PX, "m": _META}))
def to_radiance(spark, sf):
    p = _scene_pixels(spark, sf).withColumn("value", F.col("value") / 10000.0)
    return R.to_radiance(p, _scene_meta(spark, sf)).select(*_KEY, "band", rnd("radiance").alias("radiance"))


@query("to_reflectance", with_ctes("pixels_long", f"SELECT patch_index, y, x, band, {r(f'value / ({_FACTOR})')} AS reflectance FROM p JOIN m USING (scene_id, band)", {"p": _SCENE_PX, "m": _META}))
def to_reflectance(spark, sf):
    p = _scene_pixels(spark, sf).withColumnRenamed("value", "radiance")
    return R.to_reflectance(p, _scene_meta(spark, sf)).select(*_KEY, "band", rnd("reflectance").alias("reflectance"))


@query("irradiance_with_pan", f"""
    SELECT scene_id, band, {r('irradiance', 4)} AS irradiance FROM m
    UNION ALL SELECT scene_id, 'PAN', {r("sum(irradiance * CASE band WHEN 'B02' THEN 0.21594369::DOUBLE WHEN 'B03' THEN 0.28731533::DOUBLE WHEN 'B04' THEN 0.25719303::DOUBLE ELSE 0 END)", 4)} FROM m GROUP BY scene_id"""
       .replace("FROM m", f"FROM (SELECT scene_id, CASE band WHEN 'blue' THEN 'B02' WHEN 'green' THEN 'B03' WHEN 'red' THEN 'B04' ELSE 'B08' END AS band, irradiance * earth_sun_dist AS irradiance FROM ({_META}))"))
def irradiance_with_pan(spark, sf):
    ids = F.create_map(*[F.lit(x) for kv in (("blue", "B02"), ("green", "B03"), ("red", "B04"), ("nir", "B08")) for x in kv])
    m = _scene_meta(spark, sf).select("scene_id", F.try_element_at(ids, F.col("band")).alias("band"), (F.col("irradiance") * F.col("earth_sun_dist")).alias("irradiance"))
    return A.rounded(R.irradiance_with_pan(m), 4)


@query("doy_to_date", """
    SELECT o_orderkey, strftime(make_date(2024, 1, 1) + (o_orderkey % 366)::INT, '%Y-%m-%d') AS base0, strftime(make_date(2024, 1, 1) + (o_orderkey % 366)::INT - 1, '%Y-%m-%d') AS base1 FROM orders""")
def doy_to_date(spark, sf):
    doy = F.col("o_orderkey") % 366
    return A.table(spark, sf, "orders").select("o_orderkey", *[X.doy_to_date(F.lit(2024), doy, b).cast("string").alias(f"base{b}") for b in (0, 1)])


@query("scene_bbox", with_ctes("manifest", f"""
    SELECT patch_index, {r('center_lon - 256 * 2.375::DOUBLE / 111320.0')} AS min_x, {r('center_lat - 256 * 2.375::DOUBLE / 111320.0')} AS min_y,
           {r('center_lon + 256 * 2.375::DOUBLE / 111320.0')} AS max_x, {r('center_lat + 256 * 2.375::DOUBLE / 111320.0')} AS max_y FROM manifest"""))
def scene_bbox(spark, sf):
    box = X.scene_bbox(F.col("center_lat"), F.col("center_lon"), F.lit(256), F.lit(256), 4.75)
    return A.rounded(A.manifest(spark, sf).select("patch_index", *[c.alias(n) for n, c in box.items()]))


@query("error_class", with_ctes("masks", """
    SELECT error_class, count(*) AS n FROM (SELECT CASE WHEN label = 1 AND pred_a = 1 THEN 'correct_water' WHEN label = 1 AND pred_a = 0 THEN 'missed_water' WHEN label = 0 AND pred_a = 1 THEN 'false_alarm'
        WHEN label = 0 AND pred_a = 0 THEN 'correct_land' ELSE 'nodata' END AS error_class FROM masks) GROUP BY error_class"""))
def error_class(spark, sf):
    m = A.masks(spark, sf).select(X.error_class(F.col("label"), F.col("pred_a")).alias("error_class"))
    return m.groupBy("error_class").agg(F.count(F.lit(1)).alias("n"))


@query("above_median_label", with_ctes("manifest", "SELECT patch_index, coalesce((wc_frac_10 > (SELECT quantile_cont(wc_frac_10, 0.5) FROM manifest))::INT, -1) AS label FROM manifest"))
def above_median_label(spark, sf):
    return B.above_median_label(A.manifest(spark, sf).select("patch_index", "wc_frac_10"), "wc_frac_10").select("patch_index", F.coalesce("label", F.lit(-1)).alias("label"))


@query("pick_metric", f"""
    SELECT event_id, {r("CASE WHEN event_type = 'view' THEN value WHEN event_type = 'click' THEN value * 2 END")} AS test_iou FROM events""")
def pick_metric(spark, sf):
    """Runs log the same quantity under different names; some log neither."""
    kind = F.col("event_type")
    m = (
        F.when(kind == "view", F.create_map(F.lit("test/student_target_iou"), "value", F.lit("test/mIoU"), -F.col("value")))
        .when(kind == "click", F.create_map(F.lit("test/mIoU"), F.col("value") * 2)).otherwise(F.create_map(F.lit("test/loss"), "value"))
    )
    return A.table(spark, sf, "events").select("event_id", rnd(X.pick_metric(m, C.METRIC_KEYS["test_iou"])).alias("test_iou"))


@query("koppen_group", with_ctes("manifest", """
    SELECT patch_index, CASE WHEN koppen_zone = 0 THEN 'no data' WHEN koppen_zone <= 3 THEN 'A  Tropical' WHEN koppen_zone <= 7 THEN 'B  Arid' WHEN koppen_zone <= 16 THEN 'C  Temperate'
           WHEN koppen_zone <= 28 THEN 'D  Continental' WHEN koppen_zone <= 30 THEN 'E  Polar' END AS climate_group FROM manifest"""))
def koppen_group(spark, sf):
    return A.manifest(spark, sf).select("patch_index", X.koppen_group(F.col("koppen_zone")).alias("climate_group"))


@query("run_label", """
    SELECT event_id, concat_ws(', ', CASE WHEN user_id % 2 = 0 THEN 'inst=0.' || (user_id % 10) || ', pix=0.5' ELSE 'plain_' || event_type END,
           CASE WHEN event_type = 'view' THEN 'focal γ=2.0' END, CASE WHEN event_type = 'click' THEN 'weighted' END, CASE WHEN event_type = 'error' THEN 'kd=mse' END,
           CASE WHEN event_type = 'purchase' THEN 'crd=0.1' END, CASE WHEN event_type = 'signup' THEN 'DSBN' END) AS run_label FROM events""")
def run_label(spark, sf):
    m = F.col("user_id")
    path = F.when(m % 2 == 0, F.concat(F.lit("kd_inst0."), (m % 10).cast("string"), F.lit("_pix0.5"))).otherwise(F.concat(F.lit("plain_"), "event_type"))
    kind, none = F.col("event_type"), F.lit(None).cast("string")
    cfg = F.map_from_arrays(
        F.array(*[F.lit(k) for k in ("task_loss", "focal_gamma", "class_weights", "kd_mode", "w_crd", "use_dsbn")]),
        F.array(
            F.when(kind == "view", "focal").otherwise("ce"), F.lit("2.0"), F.when(kind == "click", "inverse_sqrt").otherwise(none),
            F.when(kind == "error", "mse").otherwise("kl"), F.when(kind == "purchase", "0.1").otherwise("0"), F.when(kind == "signup", "true").otherwise("false"),
        ),
    )
    return A.table(spark, sf, "events").select("event_id", X.run_label(path, cfg).alias("run_label"))


# --- raster tables: every order is a scene of seven rows, its lines are pixels ----------------
_RASTER = """SELECT l_orderkey AS scene, l_linenumber - 1 AS y, (l_partkey % (4 + l_orderkey % 5))::INT AS x, (4 + l_orderkey % 5)::INT AS width, 7 AS height, l_quantity AS value FROM lineitem"""


def _raster(spark, sf):
    width = (4 + F.col("l_orderkey") % 5).cast("int")
    return A.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("scene"), (F.col("l_linenumber") - 1).alias("y"), (F.col("l_partkey") % width).cast("int").alias("x"),
        width.alias("width"), F.lit(7).alias("height"), F.col("l_quantity").alias("value"),
    )


@query("crop", with_ctes("", "SELECT scene, y - 1 AS y, x - 1 AS x, height - 2 AS height, width - 2 AS width, value FROM g WHERE y BETWEEN 1 AND height - 2 AND x BETWEEN 1 AND width - 2", {"g": _RASTER}))
def crop(spark, sf):
    return R.crop(_raster(spark, sf), 1)


@query("center_crop", with_ctes("", """
    SELECT scene, (y - (height - 4) // 2)::INT AS y, (x - (width - 4) // 2)::INT AS x, 4 AS height, 4 AS width, value
    FROM g WHERE y - (height - 4) // 2 BETWEEN 0 AND 3 AND x - (width - 4) // 2 BETWEEN 0 AND 3""", {"g": _RASTER}))
def center_crop(spark, sf):
    return R.center_crop(_raster(spark, sf), 4)


@query("regrid_nearest", with_ctes("", """
    SELECT t.scene, t.y, t.x, t.nh AS height, t.nw AS width, g.value FROM (
        SELECT scene, height, width, nh, nw, y, unnest(range(0, nw))::INT AS x FROM (
            SELECT *, unnest(range(0, nh))::INT AS y FROM (SELECT DISTINCT scene, height, width, floor(height * (10.0::DOUBLE / 4.75::DOUBLE))::INT AS nh, floor(width * (10.0::DOUBLE / 4.75::DOUBLE))::INT AS nw FROM g))) t
    JOIN g ON g.scene = t.scene AND g.y = t.y * t.height // t.nh AND g.x = t.x * t.width // t.nw""", {"g": _RASTER}))
def regrid_nearest(spark, sf):
    return R.regrid_nearest(_raster(spark, sf), 10.0, 4.75, ["scene"]).select("scene", "y", "x", "height", "width", "value")


_TILES = """SELECT scene, height, width, tx AS tile_x, ty AS tile_y, greatest(0, least(tx * 3 + 4, width) - 4) AS x1, least(tx * 3 + 4, width) AS x2,
    greatest(0, least(ty * 3 + 4, height) - 4) AS y1, least(ty * 3 + 4, height) AS y2 FROM (
    SELECT *, unnest(range(0, (width - 1) // 3 + 1))::INT AS tx FROM (SELECT *, unnest(range(0, (height - 1) // 3 + 1))::INT AS ty FROM (SELECT DISTINCT scene, height, width FROM g)))"""


@query("tile_grid", with_ctes("", f"""
    SELECT scene, height, width, tile_x, tile_y, x1, x2, y1, y2, {r('1000.0 + 4.75 * x1', 4)} AS map_x1, {r('5000.0 - 4.75 * y1', 4)} AS map_y1, {r('1000.0 + 4.75 * x2', 4)} AS map_x2,
           {r('5000.0 - 4.75 * y2', 4)} AS map_y2 FROM ({_TILES})""", {"g": _RASTER}))
def tile_grid(spark, sf):
    s = _raster(spark, sf).select("scene", "height", "width").distinct()
    s = s.withColumn("transform", F.array(*[F.lit(v) for v in (1000.0, 4.75, 0.0, 5000.0, 0.0, -4.75)]))
    return A.rounded(R.tile_grid(s, 4, 0.25).drop("transform"), 4)


@query("assign_tiles", with_ctes("", f"SELECT scene, tile_x, tile_y, count(*) AS pixels, sum(value) AS total FROM g JOIN ({_TILES}) t USING (scene) WHERE x >= x1 AND x < x2 AND y >= y1 AND y < y2 GROUP BY ALL", {"g": _RASTER}))
def assign_tiles(spark, sf):
    t = R.assign_tiles(_raster(spark, sf), 4, 0.25)
    return t.groupBy("scene", "tile_x", "tile_y").agg(F.count(F.lit(1)).alias("pixels"), F.sum("value").alias("total"))


@query("top_k_classes", with_ctes("top3", f"SELECT item_id, classes[1] AS c1, classes[2] AS c2, classes[3] AS c3, predicted_class, {r('probability')} AS probability FROM top3 WHERE view = 'a'"))
def top_k_classes(spark, sf):
    from ...functions import vec

    p = A.logits(spark, sf).select("item_id", vec.softmax(F.col("za")).alias("probs"))
    t = p.select("item_id", X.top_k_classes(F.col("probs"), 3).alias("t"), vec.argmax(F.col("probs")).alias("predicted_class"))
    return t.select("item_id", *[F.col("t")[i]["class"].alias(f"c{i + 1}") for i in range(3)], "predicted_class", rnd(F.col("t")[0]["p"]).alias("probability"))


@query("pool_tokens", with_ctes("vectors", f"SELECT item_id, dim, {r('v')} AS value FROM (SELECT item_id, unnest(range(0, 16))::INT AS dim, unnest([(a[i] + a[i + 16] + a[i + 32] + a[i + 48]) / 4 FOR i IN range(1, 17)]) AS v FROM vectors)"))
def pool_tokens(spark, sf):
    v = A.vectors(spark, sf).select("item_id", F.array(*[F.slice("a", k * 16 + 1, 16) for k in range(4)]).alias("tokens"))
    return emb.pool_tokens(v, ["item_id"]).select("item_id", F.posexplode("embedding").alias("dim", "value")).select("item_id", "dim", rnd("value").alias("value"))
