"""The plans are the ones wanted on a cluster."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

# built by running jobs first: fits, streams, files
EAGER = {"probing", "files", "streams", "whole_reports"}
QUERIES = {n: f for n, f in entry.queries().items() if f.__module__.split(".")[-1] not in EAGER and n != "domain_gap_table"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_product(spark, sf, name):
    p = plan(QUERIES[name](spark, sf))
    assert "CartesianProduct" not in p
    assert "BroadcastNestedLoopJoin" not in p


def test_scan_reads_only_what_is_used(spark, sf):
    p = plan(QUERIES["select_bands"](spark, sf))
    assert "l_shipdate" not in p and "l_returnflag" not in p
    p = plan(QUERIES["class_fraction"](spark, sf))
    assert "l_extendedprice" not in p


def test_bad_products_are_filtered_in_the_scan(spark, tmp_path):
    from skydrift.operators import pairing

    spark.range(100).selectExpr("id AS product_id").write.parquet(str(tmp_path / "m"))
    p = plan(pairing.drop_bad_products(spark.read.parquet(str(tmp_path / "m")), [1, 2, 3]))
    assert "Join" not in p and "PushedFilters: [Or(" in p


def test_two_views_in_one_table_need_one_shuffle(spark, sf):
    p = plan(QUERIES["spectral_drift_per_patch"](spark, sf))
    assert p.count("Exchange") == 1 and "Join" not in p


def test_regrid_and_tiles_do_not_shuffle(spark):
    from skydrift.operators import raster

    px = spark.createDataFrame([(1, 0, 0, 4, 4, 5)], "patch_index int, y int, x int, height int, width int, value int")
    for df in (raster.regrid_nearest(px, 10.0, 4.75), raster.assign_tiles(px, 4, 0.5)):
        assert "Exchange" not in plan(df)


def test_cached_embeddings_prune_folders(spark, tmp_path):
    from skydrift.sources import scans, sinks

    df = spark.createDataFrame([(1, "a", 0, [1.0]), (1, "b", 1, [2.0])], "item_id long, domain string, layer int, embedding array<double>")
    sinks.save_embeddings(df, str(tmp_path / "e"))
    p = plan(scans.load_embeddings(spark, str(tmp_path / "e")).where("domain = 'a' AND layer = 0"))
    assert "PartitionFilters: [isnotnull(domain" in p


def test_stored_views_join_without_an_exchange(spark, sf, tmp_path):
    """Labels by patch, statistics per patch, and views aligned by position."""
    from skydrift.operators import bands, pairing
    from skydrift.plans import adapters as A
    from skydrift.sources import sinks

    masks = A.masks(spark, sf).select(F.col("patch_index").alias("label_h5_index"), "y", "x", "label")
    manifest = A.manifest(spark, sf).select("patch_index", "label_h5_index")
    want = pairing.join_labels(manifest, masks)
    m, k = (sinks.write_bucketed(d, str(tmp_path / n), ["label_h5_index"], 8) for d, n in ((manifest, "m"), (masks, "k")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        labels = pairing.join_labels(m, k)
        assert "Exchange" not in plan(labels) and "SortMergeJoin" in plan(labels)
        assert sorted(labels.select(*want.columns).collect()) == sorted(want.collect())
        px = A.pixels_long(spark, sf)
        drift = bands.spectral_drift_wide(sinks.write_bucketed(px, str(tmp_path / "px"), ["patch_index"], 8), ["patch_index", "band"], "a", "b")
        assert "Exchange" not in plan(drift) and drift.count() == bands.spectral_drift_wide(px, ["patch_index", "band"], "a", "b").count()
        p = ["patch_index", "y", "x"]
        a, b = (sinks.write_bucketed(A.pixels_view(spark, sf, v), str(tmp_path / v), p, 8) for v in "ab")
        aligned = pairing.coregister(a, b, A.BANDS)
        assert "Exchange" not in plan(aligned)
        assert aligned.count() == pairing.coregister(A.pixels_view(spark, sf, "a"), A.pixels_view(spark, sf, "b"), A.BANDS).count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
