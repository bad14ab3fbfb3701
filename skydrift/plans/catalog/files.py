"""Sources and sinks. Each query writes what Spark derives from the tables and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import bands as B
from ...operators import embedding as E
from ...operators import raster
from ...session import shared_dir
from ...sources import scans, sinks
from .. import adapters as A
from ..adapters import r, rnd, with_ctes
from ..registry import query
from .experiments import run_records


@query("scan_patch_bands", """
    SELECT band, (i // 2)::INT AS y, (i % 2)::INT AS x, count(*) AS n, sum(v)::BIGINT AS total FROM (
        SELECT l_returnflag AS band, unnest([0, 1, 2, 3]) AS i, unnest([l_quantity::INT, l_linenumber, round(l_discount * 100)::INT, round(l_tax * 100)::INT]) AS v FROM lineitem) GROUP BY ALL""")
def scan_patch_bands(spark, sf):
    """A two by two band per line, stored as parquet, scanned and flattened."""
    px = F.array("l_quantity", "l_linenumber", F.round(F.col("l_discount") * 100), F.round(F.col("l_tax") * 100)).cast("array<smallint>")
    p = A.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("patch_index"), F.lit("a").alias("view"), F.col("l_returnflag").alias("band"), F.lit(2).alias("height"), F.lit(2).alias("width"), px.alias("pixels")
    )
    path = shared_dir(spark, "patch-bands")
    p.write.parquet(path)
    flat = raster.explode_pixels(scans.scan_patch_bands(spark, path))
    return flat.groupBy("band", "y", "x").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("scan_manifest", with_ctes("manifest", f"""
    SELECT patch_index, product_id, CASE WHEN patch_index % 10 = 4 THEN 'none' ELSE date_phi::VARCHAR END AS date_phi, coalesce(date_s2b::VARCHAR, 'none') AS date_s2b,
           {r('coalesce(patch_delta_days, -1)')} AS patch_delta_days, koppen_zone FROM manifest"""))
def scan_manifest(spark, sf):
    """CSV with some dates that are no dates."""
    m = A.manifest(spark, sf).withColumn("date_phi", F.when(F.col("patch_index") % 10 == 4, "soon").otherwise(F.col("date_phi").cast("string")))
    from pyspark.sql.types import _parse_datatype_string

    from ...sources import schemas

    cols = _parse_datatype_string(schemas.MANIFEST).fields
    m = m.select(*[F.col(f.name) if f.name in m.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in cols])
    path = shared_dir(spark, "manifest")
    m.write.csv(path, header=True)
    s = scans.scan_manifest(spark, path)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none")).alias(c)
    return s.select("patch_index", "product_id", text("date_phi"), text("date_s2b"), rnd(F.coalesce("patch_delta_days", F.lit(-1.0))).alias("patch_delta_days"), "koppen_zone")


@query("scan_split_list", with_ctes("split_rows", """
    SELECT CASE WHEN doc_id % 3 <> 0 THEN s1_file END AS s1_file, CASE WHEN doc_id % 3 <> 0 THEN label_file END AS label_file, CASE WHEN doc_id % 3 = 0 THEN s1_file END AS stem FROM split_rows"""))
def scan_split_list(spark, sf):
    """Pairs, stems and blank lines in one set of text files."""
    s = A.split_rows(spark, sf)
    line = F.when(F.col("doc_id") % 3 == 0, F.concat("s1_file", F.lit("  "))).otherwise(F.concat("s1_file", F.lit(", "), "label_file"))
    path = shared_dir(spark, "split-list")
    s.select(line.alias("value")).unionByName(s.where(F.col("doc_id") % 5 == 0).select(F.lit("   ").alias("value"))).write.text(path)
    return scans.scan_split_list(spark, path)


def _write_records(spark, sf):
    """One JSON file per run record; the records of seed 1 trained on clean data are cut short."""
    rec = run_records(spark, sf)
    body = F.to_json(F.struct(*rec.columns))
    broken = (F.col("seed") == 1) & F.col("tag").contains("__clean__")
    path = shared_dir(spark, "records")
    rec.select("tag", F.when(broken, F.substring(body, 1, 40)).otherwise(body).alias("value")).write.partitionBy("tag").text(path)
    return scans.scan_run_records(spark, f"{path}/*/*")


@query("scan_run_records", with_ctes("run_cells", f"""
    SELECT init || '__' || train_variant || '__s' || seed AS tag, seed, {r('max(test_iou)')} AS best_val_iou FROM run_cells WHERE NOT (seed = 1 AND train_variant = 'clean') GROUP BY ALL"""))
def scan_run_records(spark, sf):
    return A.rounded(_write_records(spark, sf)[0].select("tag", "seed", "best_val_iou"))


@query("unreadable_run_records", with_ctes("run_cells", "SELECT DISTINCT init || '__' || train_variant || '__s' || seed AS tag FROM run_cells WHERE seed = 1 AND train_variant = 'clean'"))
def unreadable_run_records(spark, sf):
    return _write_records(spark, sf)[1].select(F.regexp_extract("path", r"tag=([^/]+)/", 1).alias("tag"))


@query("scan_run_history", f"""
    SELECT run, metric, epoch, count(*) AS n, {r('max(value)')} AS value FROM (
        SELECT event_type AS run, (day(ts) - 1)::INT AS epoch, unnest(['val.iou', 'val.gap', 'lr']) AS metric, unnest([value, json_extract_string(props, '$.k')::DOUBLE, event_id::DOUBLE]) AS value FROM events) GROUP BY ALL""")
def scan_run_history(spark, sf):
    """JSON lines with nested keys, a boolean and a text among the numbers."""
    e = A.table(spark, sf, "events")
    line = F.to_json(
        F.struct(
            (F.dayofmonth("ts") - 1).alias("epoch"), F.struct(F.col("value").alias("iou"), F.get_json_object("props", "$.k").cast("int").alias("gap")).alias("val"),
            F.col("event_id").alias("lr"), F.lit(True).alias("resumed"), F.lit("x").alias("note"),
        )
    )
    path = shared_dir(spark, "history")
    e.select(F.col("event_type").alias("run"), line.alias("value")).write.partitionBy("run").text(path)
    h = scans.scan_run_history(spark, f"{path}/*/*")
    g = h.groupBy(F.regexp_replace("run", "^run=", "").alias("run"), "metric", "epoch").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("value"))
    return A.rounded(g)


@query("list_files", "SELECT source, sum(strlen(text) + 1)::BIGINT AS bytes FROM documents GROUP BY source")
def list_files(spark, sf):
    path = shared_dir(spark, "listing")
    A.table(spark, sf, "documents").select("source", F.col("text").alias("value")).write.partitionBy("source").text(path)
    f = scans.list_files(spark, path, "*.txt")
    return f.groupBy(F.regexp_extract("path", r"source=([^/]+)/", 1).alias("source")).agg(F.sum("length").alias("bytes"))


@query("scan_geojson", with_ctes("manifest", f"SELECT patch_index::VARCHAR AS scene, date_phi::VARCHAR AS acquired, {r('center_lon')} AS lon, {r('center_lat')} AS lat FROM manifest"))
def scan_geojson(spark, sf):
    """Feature collections of at most 1000 scenes each, one file per collection."""
    m = A.manifest(spark, sf)
    feature = F.struct(
        F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array("center_lon", "center_lat").alias("coordinates")).alias("geometry"),
        F.struct(F.col("patch_index").cast("string").alias("scene"), F.col("date_phi").cast("string").alias("acquired")).alias("properties"),
    )
    fc = m.groupBy(F.floor(F.col("patch_index") / 1000).alias("part")).agg(F.collect_list(feature).alias("features"))
    path = shared_dir(spark, "geojson")
    fc.select("part", F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("value")).write.partitionBy("part").text(path)
    g = scans.scan_geojson(spark, f"{path}/*/*")
    p = F.col("properties")
    return A.rounded(g.select(F.try_element_at(p, F.lit("scene")).alias("scene"), F.try_element_at(p, F.lit("acquired")).alias("acquired"), "lon", "lat"))


def _write_xml(spark, sf):
    """Metadata documents of twenty suppliers per file."""
    s = A.table(spark, sf, "supplier")
    irr = F.concat(*[F.concat(F.lit(f'<SOLAR_IRRADIANCE bandId="{i}" unit="W">'), (F.col("s_acctbal") + 1000.0 * i).cast("string"), F.lit("</SOLAR_IRRADIANCE>")) for i in (1, 2)])
    row = lambda k: F.concat(F.lit("<VALUES>"), *[x for j in range(3) for x in ((F.col("s_nationkey") * 2 + k * 3 + j).cast("string"), F.lit(" "))], F.lit("NaN</VALUES>"))
    grid = F.concat(F.lit("<Sun_Angles_Grid><Zenith><Values_List>"), row(0), row(1), F.lit("</Values_List></Zenith></Sun_Angles_Grid>"))
    doc = F.concat(F.lit("<Scene>"), irr, grid, F.lit("</Scene>"))
    path = shared_dir(spark, "xml")
    whole = s.groupBy(F.floor(F.col("s_suppkey") / 20).alias("tile")).agg(F.array_join(F.collect_list(doc), "").alias("d"))
    whole.select("tile", F.concat(F.lit("<Scenes>"), "d", F.lit("</Scenes>")).alias("value")).write.partitionBy("tile").text(path)
    return scans.scan_scene_xml(spark, f"{path}/*/*", {1: 1900.0, 2: 1800.0, 3: 1700.0})


@query("scan_scene_xml", f"""
    SELECT tile, band_id, {r('sum(irradiance)', 3)} AS irradiance FROM (
        SELECT (s_suppkey // 20)::VARCHAR AS tile, unnest([1, 2]) AS band_id, unnest([s_acctbal + 1000, s_acctbal + 2000]) AS irradiance FROM supplier
        UNION ALL SELECT DISTINCT (s_suppkey // 20)::VARCHAR, 3, 1700.0 FROM supplier) GROUP BY ALL""")
def scan_scene_xml(spark, sf):
    """Band 3 is stated nowhere and comes from the defaults, once per file."""
    irr = _write_xml(spark, sf)[0]
    g = irr.groupBy(F.regexp_extract("path", r"tile=(\d+)/", 1).alias("tile"), "band_id").agg(F.sum("irradiance").alias("irradiance"))
    return A.rounded(g, 3)


@query("scan_scene_xml_zenith", f"""
    SELECT tile, "row", col, {r('avg(z)')} AS zenith FROM (
        SELECT (s_suppkey // 20)::VARCHAR AS tile, "row", unnest([0, 1, 2])::INT AS col, unnest([s_nationkey * 2 + "row" * 3, s_nationkey * 2 + "row" * 3 + 1, s_nationkey * 2 + "row" * 3 + 2]) AS z
        FROM (SELECT *, unnest([0, 1])::INT AS "row" FROM supplier)) GROUP BY ALL""")
def scan_scene_xml_zenith(spark, sf):
    z = _write_xml(spark, sf)[1].where(~F.isnan("zenith"))
    return A.rounded(z.groupBy(F.regexp_extract("path", r"tile=(\d+)/", 1).alias("tile"), "row", "col").agg(F.avg("zenith").alias("zenith")))


@query("scan_scene_metadata_json", f"SELECT (s_suppkey % 50)::VARCHAR AS scene_id, {r('avg(s_acctbal / 1e4)')} AS earth_sun_dist, {r('sum(s_acctbal + 7)', 3)} AS irradiance_b02 FROM supplier GROUP BY 1")
def scan_scene_metadata_json(spark, sf):
    s = A.table(spark, sf, "supplier").groupBy((F.col("s_suppkey") % 50).alias("k")).agg(F.avg(F.col("s_acctbal") / 1e4).alias("d"), F.sum(F.col("s_acctbal") + 7).alias("i"))
    body = F.to_json(F.struct(F.col("d").alias("earth_sun_dist"), F.create_map(F.lit("B02"), F.col("i")).alias("solar_irradiances")))
    path = shared_dir(spark, "scene-meta")
    s.select(F.concat(F.col("k").cast("string"), F.lit("_S2B_metadata.json")).alias("scene"), body.alias("value")).write.partitionBy("scene").text(path)
    m = scans.scan_scene_metadata_json(spark, f"{path}/*/*")
    return m.select("scene_id", rnd("earth_sun_dist").alias("earth_sun_dist"), rnd(F.try_element_at("solar_irradiances", F.lit("B02")), 3).alias("irradiance_b02"))


@query("drift_report_roundtrip", with_ctes("layer_metrics", f"""
    SELECT item_id::VARCHAR AS pair_id, {r('avg(cosine)')} AS cosine, {r('avg(mse)', 9)} AS mse, CASE WHEN item_id % 2 = 0 THEN 1 ELSE 2 END::BIGINT AS pairs_processed,
           CASE WHEN item_id % 2 = 0 THEN {r('avg(cosine)')} ELSE {r('(avg(cosine) + 1) / 2')} END AS run_cosine FROM layer_metrics GROUP BY item_id"""))
def drift_report_roundtrip(spark, sf):
    """Summary form for even items, the older per-file form (with an unknown field) for odd ones."""
    d = E.embedding_drift(A.paired_layers(spark, sf))
    emb = F.struct("cosine_similarity", "mse_error", "mae_error", "layer_cosine_similarities").alias("embedding_drift")
    base = [F.lit("ok").alias("status"), F.col("item_id").cast("string").alias("pair_id"), emb]
    one = lambda c: F.struct(c.alias("cosine_similarity"), F.col("mse_error"))
    path = shared_dir(spark, "reports")
    sinks.write_drift_report(d.where("item_id % 2 = 0").select(*base, F.lit(1).cast("long").alias("pairs_processed"), F.col("cosine_similarity").alias("avg_cosine_similarity")), f"{path}/new")
    sinks.write_drift_report(d.where("item_id % 2 = 1").select(*base, F.array(one(F.col("cosine_similarity")), one(F.lit(1.0))).alias("results"), F.lit("z").alias("extra")), f"{path}/old")
    x = scans.read_drift_reports(spark, f"{path}/*")
    return x.select("pair_id", rnd("embedding_drift.cosine_similarity").alias("cosine"), rnd("embedding_drift.mse_error", 9).alias("mse"), "pairs_processed", rnd("avg_cosine_similarity").alias("run_cosine"))


@query("write_stats_csv", with_ctes("pixels_long", f"SELECT view, band, {r('avg(value)', 3)} AS mean, {r('stddev_pop(value)', 3)} AS std, {r('quantile_cont(value, 0.98)', 3)} AS p98 FROM pixels_long GROUP BY ALL"))
def write_stats_csv(spark, sf):
    path = shared_dir(spark, "stats-csv")
    sinks.write_stats_csv(B.spectral_stats_table(A.pixels_long(spark, sf)).select("view", "band", "mean", "std", "p98"), path)
    return spark.read.csv(path, header=True, schema="view STRING, band STRING, mean DOUBLE, std DOUBLE, p98 DOUBLE")


@query("normalization_config", with_ctes("pixels_long", f"SELECT band, {r('avg(value)', 4)} AS mean, {r('coalesce(stddev_samp(value), 0)', 4)} AS std FROM pixels_long WHERE view = 'a' GROUP BY band"))
def normalization_config(spark, sf):
    path = shared_dir(spark, "normalization")
    sinks.write_normalization_config(B.finish_moments(B.band_moments(A.pixels_long(spark, sf).where("view = 'a'"), ["band"])), path)
    return A.rounded(scans.load_normalization(spark, path), 4)


@query("embedding_cache", with_ctes("layer_embeddings", f"SELECT item_id, {r('list_sum([x::FLOAT::DOUBLE FOR x IN embedding])', 5)} AS total FROM layer_embeddings WHERE domain = 'b' AND layer = 2"))
def embedding_cache(spark, sf):
    """Stored by domain and layer; the read touches one folder."""
    path = shared_dir(spark, "embeddings")
    e = sinks.cached_embeddings(spark, path, lambda: A.layer_embeddings(spark, sf))
    e = sinks.cached_embeddings(spark, path, lambda: e).where("domain = 'b' AND layer = 2")
    from ...functions import vec

    return A.rounded(e.select("item_id", vec.total(vec.as_double("embedding")).alias("total")), 5)
