"""Hand fixtures: the edge rows every family must hold, and invariants."""

import datetime as dt
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skydrift import constants as C
from skydrift.functions import exprs, tails, vec
from skydrift.operators import bands, embedding, manifest, pairing, prediction, probes, raster, runs, segmentation, significance, splits
from skydrift.plans import reports
from skydrift.sources import scans, sinks
from skydrift.streaming import monitors


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# --- bands ---------------------------------------------------------------------------
def long(spark, data):
    return spark.createDataFrame(data, "view string, band string, value double")


def test_band_without_valid_pixel_gets_zeros(spark):
    df = long(spark, [("a", "x", 1.0), ("a", "x", 3.0), ("a", "y", 0.0), ("a", "y", -2.0)])
    s = {r["band"]: r for r in bands.band_stats(df, expected=df).collect()}
    assert s["y"]["mean"] == 0 and s["y"]["max"] == 0 and s["x"]["std"] == 1.0 and s["x"]["median"] == 2.0


def test_percent_change_is_zero_for_a_zero_base(spark):
    a = spark.createDataFrame([("x", 0.0, 0.0, 0.0, 0.0)], "band string, mean double, std double, min double, max double")
    b = spark.createDataFrame([("x", 5.0, 2.0, 1.0, 9.0)], "band string, mean double, std double, min double, max double")
    d = bands.spectral_drift(a, b).first()
    assert d["mean_diff"] == 5 and d["mean_pct_change"] == 0 and d["std_pct_change"] == 0 and d["range_change"] == 8


def test_single_pixel_has_no_spread(spark):
    m = bands.finish_moments(bands.band_moments(long(spark, [("a", "x", 4.0)]))).first()
    assert m["std"] == 0.0 and m["n"] == 1


def test_merged_moments_equal_one_pass(spark):
    data = [("a", "x", float(i) + 1e6) for i in range(40)]
    df = long(spark, data).withColumn("part", (F.col("value") % 7).cast("int"))
    one = bands.finish_moments(bands.band_moments(df)).first()
    two = bands.finish_moments(bands.merge_band_moments(bands.band_moments(df, ["view", "band", "part"]))).first()
    assert two["std"] == pytest.approx(one["std"], rel=1e-12) and two["n"] == one["n"] and two["mean"] == pytest.approx(one["mean"])


def test_sketch_percentiles_are_close(spark):
    df = long(spark, [("a", "x", float(i)) for i in range(5001)])
    p = bands.approx_band_percentiles(df, ["view", "band"], [0.02, 0.98]).first()
    assert p["p2"] == pytest.approx(100, abs=75) and p["p98"] == pytest.approx(4900, abs=75)


def test_affine_view_gives_its_line_back(spark):
    df = spark.createDataFrame([("x", float(i), 3.0 * i + 7) for i in range(20)], "band string, target double, reference double")
    f = bands.sensor_transfer_fit(df).first()
    assert (f["slope"], f["intercept"]) == (pytest.approx(3), pytest.approx(7)) and f["spearman"] == pytest.approx(1) and f["pearson"] == pytest.approx(1)


def test_correspondence_finds_the_identity(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(60, 3))
    df = spark.createDataFrame([tuple(float(x) for x in [*r, *np.exp(r)]) for r in m], "a0 double, a1 double, a2 double, b0 double, b1 double, b2 double")
    best = bands.band_correspondence(df, ["a0", "a1", "a2"], ["b0", "b1", "b2"]).where("is_best")
    assert rows(best, "stored", "reference") == [("a0", "b0"), ("a1", "b1"), ("a2", "b2")]


def test_smooth_clip_limits_and_overflow(spark):
    x = spark.createDataFrame([(0.0,), (38.729,), (1e6,)], "v double").select(exprs.smooth_clip(F.col("v"), 38.729).alias("c")).collect()
    assert x[0]["c"] == pytest.approx(0, abs=1e-6) and x[1]["c"] == pytest.approx(38.729 - math.log(2) * 1.5) and x[2]["c"] == pytest.approx(38.729)


def test_cloud_filter(spark):
    df = spark.createDataFrame([(1.0, 1.0), (5.0, 1.0), (None, 1.0)], "thick_cloud_pct double, thin_cloud_pct double")
    assert bands.filter_cloud(df).count() == 1 and bands.filter_cloud(df, None).count() == 3


# --- raster --------------------------------------------------------------------------
def image(spark, h, w):
    return spark.createDataFrame([(1, y, x, h, w, y * w + x) for y in range(h) for x in range(w)], "patch_index long, y int, x int, height int, width int, value int")


def test_explode_and_pack(spark):
    df = spark.createDataFrame([(1, "a", "x", 2, 3, [1, 2, 3, 4, 5, 6])], "patch_index long, view string, band string, height int, width int, pixels array<smallint>")
    px = raster.explode_pixels(df)
    assert rows(px, "y", "x", "value") == [(0, 0, 1), (0, 1, 2), (0, 2, 3), (1, 0, 4), (1, 1, 5), (1, 2, 6)]
    assert raster.pack_pixels(px).first()["pixels"] == [1, 2, 3, 4, 5, 6]


@pytest.mark.parametrize("h,w,src,dst", [(5, 7, 10.0, 4.75), (9, 4, 4.75, 10.0), (6, 6, 1.0, 1.0)])
def test_regrid_reads_the_nearest_cell(spark, h, w, src, dst):
    got = {(r["y"], r["x"]): r["value"] for r in raster.regrid_nearest(image(spark, h, w), src, dst).collect()}
    nh, nw = int(h * src / dst), int(w * src / dst)
    assert got == {(i, j): (i * h // nh) * w + j * w // nw for i in range(nh) for j in range(nw)}


@pytest.mark.parametrize("h,w,size,overlap", [(7, 10, 4, 0.5), (3, 9, 4, 0.0), (8, 8, 4, 0.25), (5, 5, 5, 0.0)])
def test_tiles(spark, h, w, size, overlap):
    scene = spark.createDataFrame([(1, h, w)], "patch_index long, height int, width int")
    stride = int(size * (1 - overlap))
    want = {}
    for i, x in enumerate(range(0, w, stride)):
        for j, y in enumerate(range(0, h, stride)):
            x2, y2 = min(x + size, w), min(y + size, h)
            want[(i, j)] = (max(0, x2 - size), x2, max(0, y2 - size), y2)
    got = {(r["tile_x"], r["tile_y"]): (r["x1"], r["x2"], r["y1"], r["y2"]) for r in raster.tile_grid(scene, size, overlap).collect()}
    assert got == want
    hit = {(r["tile_x"], r["tile_y"]): r["n"] for r in raster.assign_tiles(image(spark, h, w), size, overlap).groupBy("tile_x", "tile_y").agg(F.count("*").alias("n")).collect()}
    assert hit == {k: (x2 - x1) * (y2 - y1) for k, (x1, x2, y1, y2) in want.items()}


def test_crop_and_centre(spark):
    c = raster.center_crop(image(spark, 5, 6), 2)
    assert rows(c, "y", "x", "value") == [(0, 0, 8), (0, 1, 9), (1, 0, 14), (1, 1, 15)]
    assert raster.crop(image(spark, 5, 6), 2).count() == 2


def test_radiance_round_trip(spark):
    px = spark.createDataFrame([(1, "B02", 0.3)], "scene_id int, band string, value double")
    meta = spark.createDataFrame([(1, "B02", 1900.0, 1.01, 40.0)], "scene_id int, band string, irradiance double, earth_sun_dist double, sun_zenith double")
    rad = raster.to_radiance(px, meta)
    assert rad.first()["radiance"] == pytest.approx(0.3 * math.cos(math.radians(40)) * 1.01 / math.pi * 1900)
    assert raster.to_reflectance(rad, meta).first()["reflectance"] == pytest.approx(0.3)
    assert raster.to_radiance(px, meta, "L1B").first()["radiance"] == 0.3


def test_pan_weights_are_renormalised(spark):
    df = spark.createDataFrame([(1.0, 3.0, 9.0)], "b2 double, b3 double, q double")
    w2, w3 = C.PAN_WEIGHTS["B02"], C.PAN_WEIGHTS["B03"]
    p = df.select(raster.pan_column({"B02": "b2", "B03": "b3"}).alias("p"), raster.pan_column({"X": "q", "Y": "b2"}).alias("m")).first()
    assert p["p"] == pytest.approx((w2 + 3 * w3) / (w2 + w3)) and p["m"] == 5.0


# --- pairing -------------------------------------------------------------------------
def test_partner_rules_in_order(spark):
    names = ["G_1", "G_2", "G_3", "G_4", "G_5", "G_6"]
    split = spark.createDataFrame([(f"{n}_S1Hand.tif", f"{n}_L.tif") for n in names], "s1_file string, label_file string")
    images = spark.createDataFrame([(f"{n}_S2Hand.tif",) for n in names if n != "G_6"], "name string")
    labels = spark.createDataFrame([(f"{n}_L.tif",) for n in names if n != "G_5"], "name string")
    sim = spark.createDataFrame(
        [("simulated_train/simulated_G_1_S2Hand.tif",), ("simulated_G_1_S2Hand.tif",), ("simulated_train/simulated_G_2_S2Hand.tif",), ("simulated_G_3_.tif.tif",)], "name string"
    )
    p = pairing.pair_with_fallback(split, images, labels, sim)
    assert sorted((r["s2_file"], r["rule"]) for r in p.collect() if r["rule"] is not None) == [("G_1_S2Hand.tif", 0), ("G_2_S2Hand.tif", 1), ("G_3_S2Hand.tif", 2)]
    assert pairing.split_info(p).first().asDict() == {"total": 4, "with_partner": 3, "without_partner": 1}


def test_empty_output_counts_as_missing(spark):
    e = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    p = spark.createDataFrame([("a", 3), ("b", 0)], "name string, length long")
    assert rows(pairing.missing_outputs(e, p), "name") == [("b",), ("c",)]


def test_layers_of_other_size_are_skipped(spark):
    df = spark.createDataFrame(
        [(1, "a", 0, [1.0, 0.0]), (1, "b", 0, [0.0, 2.0]), (1, "a", 1, [1.0]), (1, "b", 1, [1.0, 2.0]), (2, "a", 0, [1.0])],
        "item_id long, domain string, layer int, embedding array<double>",
    )
    d = {r["item_id"]: r for r in embedding.embedding_drift(pairing.pair_embeddings(df, "a", "b"), df).collect()}
    assert d[1]["layer_cosine_similarities"] == [0.0] and d[1]["mse_error"] == 2.5
    assert d[2]["cosine_similarity"] == 0 and d[2]["layer_cosine_similarities"] == []


def test_pairwise_delta_of_few_names(spark):
    v = spark.createDataFrame(
        [("m1", "w", [1.0, 2.0]), ("m2", "w", [1.0, 5.0]), ("m3", "w", [1.0]), ("m1", "b", [0.0]), ("m3", "b", [0.5]), ("m4", "c", None)], "name string, key string, values array<double>"
    )
    want = [("m1", "m2", 3.0), ("m1", "m3", 0.5), ("m1", "m4", None), ("m2", "m3", None), ("m2", "m4", None), ("m3", "m4", None)]
    for block in (1, 2, 32):
        assert rows(pairing.pairwise_max_delta(v, F.lit("all"), block), "a", "b", "max_delta") == want
    assert pairing.pairwise_max_delta(v.limit(0), F.lit("all")).count() == 0


def test_pairwise_delta_of_seventy_names(spark):
    """Every pair of names is there; pairs without a shared key are null."""
    rng = np.random.default_rng(2)
    data = [(f"n{i:02d}", f"k{k}", [float(x) for x in rng.normal(size=3 if (i + k) % 5 else 2)]) for i in range(70) for k in range(12) if (i * 7 + k) % 3]
    v = spark.createDataFrame(data, "name string, key string, values array<double>")
    want, by = {}, {}
    for n, k, x in data:
        by.setdefault(n, {})[k] = x
    for a in sorted(by):
        for b in sorted(by):
            if a < b:
                for g in ("even", "odd"):
                    shared = [max(abs(p - q) for p, q in zip(by[a][k], by[b][k])) for k in by[a] if k in by[b] and len(by[a][k]) == len(by[b][k]) and (int(k[1:]) % 2 == 0) == (g == "even")]
                    want[a, b, g] = max(shared) if shared else None
    group = F.when(F.substring("key", 2, 9).cast("int") % 2 == 0, "even").otherwise("odd")
    for size in (4096, 100):
        got = {(r.a, r.b, r.key_group): r.max_delta for r in pairing.pairwise_max_delta(v, group, 16, size).collect()}
        assert len(got) == 70 * 69 and got == want


def test_last_result_of_a_split_counts(spark):
    jobs = spark.createDataFrame([("v", "train", "failed", 1.0, 0, 1), ("v", "train", "done", 2.0, 5, 2), ("v", "test", "skipped", 0.5, 0, 1), ("w", None, "done", 1.0, 2, 1)], "variant string, split string, status string, seconds double, n_files int, finished_at int")
    got = {r.variant: r for r in runs.job_status_summary(jobs).collect()}
    v = got["v"]
    assert (v.done, v.skipped, v.failed, v.seconds, v.n_files) == (1, 1, 1, 3.5, 5)
    assert {k: tuple(x) for k, x in v.runs.items()} == {"test": ("skipped", 0, 0.5), "train": ("done", 5, 2.0)} and got["w"].runs == {}


def test_status_is_in_number_order_with_totals(spark):
    names = spark.createDataFrame([("10_s.tif",), ("9_s.tif",), ("x_s.tif",), ("100_s.tif",)], "name string")
    outputs = spark.createDataFrame([("simulated_9_s.tif", "/o/9"), ("simulated_x_s.tif", "/o/x")], "name string, path string")
    status = pairing.processing_status(names, outputs)
    assert [r.product_id for r in status.collect()] == [9, 10, 100, None]
    assert tuple(pairing.processing_totals(status).first()) == (4, 2, 2)


def test_leakage_and_group_split(spark):
    df = spark.createDataFrame([(i, i % 20) for i in range(400)], "patch_index long, product_id long")
    leak = pairing.split_leakage(splits.random_split(df, ["patch_index"]), "product_id").first()
    assert leak["shared"] > 0
    assert pairing.split_leakage(splits.group_split(df, "product_id"), "product_id").first()["shared"] == 0


# --- predictions and embeddings --------------------------------------------------------
def test_identical_views_do_not_drift(spark):
    df = spark.createDataFrame([(i, [0.1 * i, 0.5, 1.0 - 0.1 * i]) for i in range(6)], "item_id long, probs array<double>")
    p = pairing.stack_domains({"a": df, "b": df}, "view")
    s = prediction.class_flip_summary(prediction.class_drift(prediction.pair_predictions(prediction.predictions_from_probs(p), "a", "b"))).first()
    assert s["class_flip_rate"] == 0 and s["avg_top3_consistency"] == 1 and s["max_probability_change"] == 0
    e = df.select("item_id", F.lit(0).alias("layer"), F.col("probs").alias("emb_a"), F.col("probs").alias("emb_b"))
    d = embedding.embedding_drift_summary(embedding.embedding_drift(e))[0].first()
    assert d["avg_cosine_similarity"] == pytest.approx(1) and d["avg_mse_error"] == 0
    z = embedding.two_sample(df.select("item_id", F.lit(0).alias("batch"), F.col("probs").alias("embedding")), df.select("item_id", F.lit(0).alias("batch"), F.col("probs").alias("embedding")))
    assert embedding.mmd2_biased(z).first()["mmd2"] == pytest.approx(0, abs=1e-12)


def test_ties_take_the_lower_class(spark):
    df = spark.createDataFrame([([0.3, 0.4, 0.4],)], "p array<double>")
    t = df.select(exprs.top_k_classes(F.col("p"), 2).alias("t"), vec.argmax(F.col("p")).alias("m")).first()
    assert [x["class"] for x in t["t"]] == [1, 2] and t["m"] == 1


def test_batch_of_one(spark):
    p = spark.createDataFrame([(1, 0, [1.0, 0.0], [0.0, 1.0])], "item_id long, batch long, emb_a array<double>, emb_b array<double>")
    a = embedding.alignment_metrics(p).first()
    assert a["cos_unpaired"] == 0 and embedding.retrieval_top1(p).first()["retrieval_top1"] == 1
    z = embedding.two_sample(p.select("item_id", "batch", F.col("emb_a").alias("embedding")), p.select("item_id", "batch", F.col("emb_b").alias("embedding")))
    assert embedding.mmd2_biased(z).first()["mmd2"] == 0


def test_losses(spark):
    df = spark.createDataFrame([(0, [2.0, 0.0]), (-1, [9.0, 1.0]), (1, [1000.0, 1000.0])], "label int, z array<double>")
    want = (math.log(1 + math.exp(-2)) + math.log(2)) / 2
    assert prediction.log_loss(df, "z", "label").first()["loss"] == pytest.approx(want)
    assert prediction.log_loss(df, "z", "label", gamma=2.0).first()["loss"] < want
    assert prediction.log_loss(df.where("label = -1"), "z", "label").first()["loss"] == 0
    same = df.withColumn("y", F.col("z"))
    assert prediction.prediction_divergence(same, "z", "y").first()["divergence"] == pytest.approx(0)
    assert prediction.prediction_divergence(same, "z", "y", valid=F.lit(False)).first()["divergence"] == 0


# --- segmentation ------------------------------------------------------------------------
def test_confusion_family(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 3), (-1, 1)], "label int, pred int")
    pc = segmentation.per_class_iou(segmentation.confusion_matrix(df), classes=[0, 1, 2, 3, 4])
    got = {r["class"]: (r["support"], r["iou"]) for r in pc.collect()}
    assert got == {0: (2, 0.5), 1: (1, 0.5), 2: (1, 0.0), 3: (0, 0.0), 4: (0, None)}
    assert segmentation.mean_iou(pc).first()[0] == pytest.approx(0.25)
    assert segmentation.mean_iou_fixed(pc, 5).first()[0] == pytest.approx(0.2)
    assert rows(segmentation.dead_classes(pc), "class") == [(2,), (3,), (4,)]


def test_no_positive_anywhere(spark):
    df = spark.createDataFrame([(1, 0, 0, 0), (1, -1, 1, 1)], "patch_index long, label int, pred_a int, pred_b int")
    d = segmentation.segmentation_drift(df).first()
    assert d["raw_iou"] == 0 and d["raw_accuracy"] == 1 and d["agreement_iou"] == 1
    assert segmentation.per_scene_iou(df, "patch_index", pred="pred_a").first()["iou"] is None
    empty = segmentation.segmentation_drift_summary(segmentation.segmentation_drift(df.where("false"))).first()
    assert empty["total_pairs"] == 0 and empty["avg_raw_iou"] == 0


def test_dominant_class_ties_and_nothing_valid(spark):
    df = spark.createDataFrame([(1, 3), (1, 3), (1, 2), (1, 2), (2, -1)], "patch_index long, label int")
    assert rows(segmentation.dominant_class(df), "patch_index", "dominant_class") == [(1, 2), (2, -1)]
    assert [r["fraction"] for r in segmentation.class_fraction(df, 3).orderBy("patch_index").collect()] == [0.5, None]


def test_chance_level_of_the_published_frequencies(spark):
    total = sum(C.LAND_COVER_PIXEL_FREQ)
    f = spark.createDataFrame([(i, x / total) for i, x in enumerate(C.LAND_COVER_PIXEL_FREQ)], "class int, freq double")
    assert segmentation.chance_miou(f).first()["chance_miou"] == pytest.approx(0.0376, abs=5e-5)
    w = segmentation.class_weights(f, "inverse").toPandas()
    assert w.weight.mean() == pytest.approx(1) and not w.near_uniform.any()
    assert segmentation.class_weights(f, "effective", beta=0.9).toPandas().near_uniform.all()


# --- manifest ------------------------------------------------------------------------------
def test_manifest_edges(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 4.0), (9.0, 1.0)], "a double, b double")
    assert manifest.pct_below(df, ["a", "b"], 5).first()[0] == pytest.approx(100 / 3)
    e = manifest.ecdf(df, ["b"])
    assert rows(e, "value", "share") == [(1.0, 0.5), (4.0, 1.0)]
    z = spark.createDataFrame([(0,), (3,), (4,), (30,), (31,)], "koppen_zone int")
    assert rows(manifest.climate_counts(z), "climate_group", "n") == [("A  Tropical", 1), ("B  Arid", 1), ("E  Polar", 1), ("no data", 1)]


# --- runs -----------------------------------------------------------------------------------
def test_first_epoch_wins_ties(spark):
    c = spark.createDataFrame([("r", 1, "m", 5.0), ("r", 2, "m", 7.0), ("r", 3, "m", 7.0), ("r", 4, "m", 5.0)], "run string, epoch int, metric string, value double")
    assert runs.best_epoch(c).first()["best_epoch"] == 2 and runs.best_epoch(c, "min").first()["best_epoch"] == 1
    s = runs.run_summary(c, ["m"], "m", warmup=3).first()
    assert (s["epochs"], s["best_epoch"], s["m_mean"]) == (5, 2, 6.0) and s["m_sd"] == pytest.approx(math.sqrt(2))


def test_verdicts(spark):
    data = [("d", "clean", "clean", s, 0.8) for s in (0, 1, 2)] + [("d", "clean", "psf_l1", s, v) for s, v in ((0, 0.7), (1, 0.7), (2, 0.7))]
    data += [("d", "clean", "snr_l1", 0, 0.5), ("d", "clean", "joint_l1", 7, 0.6), ("d", "clean", "snr_l2", 0, 0.9), ("d", "clean", "snr_l2", 1, 0.6)]
    df = spark.createDataFrame(data, "init string, train_variant string, variant string, seed int, test_iou_water double")
    v = {r["variant"]: r for r in runs.paired_seed_delta(df).collect()}
    assert v["psf_l1"]["delta"] == pytest.approx(-0.1)
    assert v["snr_l1"]["verdict"] == "n/a (1 seed)" and v["snr_l2"]["verdict"] == "within noise"
    assert v["joint_l1"]["n_pairs"] == 0 and v["joint_l1"]["delta"] == pytest.approx(-0.2)


def test_flatten_keeps_the_matched_row(spark):
    rec = [
        ("t1", "/x/psf_l2/v1.1", None, 1, True, None, 3, 0.5, {"test/mIoU": 0.4}, {"clean": {"test/mIoU": 0.6}}),
        ("t2", "/x/clean", "terramind_b", 1, False, None, 3, 0.5, {"test/IoU_flood": 0.7, "test_per_class/IoU_water": 0.9}, None),
    ]
    df = spark.createDataFrame(rec, "tag string, sim_root string, model string, seed int, scratch boolean, freeze string, epochs_run int, best_val_iou double, test map<string,double>, cross_condition map<string,map<string,double>>")
    f = runs.flatten_run_records(df)
    assert rows(f, "tag", "variant", "init", "level") == [("t1", "clean", "scratch", 0), ("t1", "psf_l2", "scratch", 2), ("t2", "clean", "pretrained", 0)]
    assert f.where("tag = 't2'").first()["test_iou_water"] == 0.9


def test_ladder_order_and_null_groups(spark):
    df = spark.createDataFrame([("scratch", "clean", "zz", 1), ("distilled", "clean", "joint_l4", 1), ("distilled", "clean", "clean", 1)], "init string, train_variant string, variant string, seed int")
    assert [r["variant"] for r in runs.custom_order(df).collect()] == ["clean", "joint_l4", "zz"]
    s = runs.sweep_ranking(spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 9.0)], "k string, v double"), ["k"], "v").collect()
    assert [(r["k"], r["count"], r["std"]) for r in s] == [("a", 1, None), (None, 2, pytest.approx(math.sqrt(2)))]


# --- significance and probes -------------------------------------------------------------------
def test_tail_probabilities():
    # tabulated two-sided values
    assert tails.t_two_sided(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert tails.t_two_sided(12.706, 1) == pytest.approx(0.05, abs=1e-5)
    assert tails.t_two_sided(1.96, 1e7) == pytest.approx(0.05, abs=1e-4)
    assert tails.normal_two_sided(1.959964) == pytest.approx(0.05, abs=1e-6)
    assert tails.t_two_sided(0.0, 5) == pytest.approx(1.0)


def test_welch_flags_a_real_difference(spark):
    rng = np.random.default_rng(0)
    data = [("m", "p", float(x)) for x in rng.normal(0, 1, 60)] + [("m", "q", float(x)) for x in rng.normal(2, 3, 40)] + [("k", "p", 1.0), ("k", "q", 1.0)]
    w = {r["metric"]: r for r in significance.welch_ttest(spark.createDataFrame(data, "metric string, run string, value double"), "p", "q").collect()}
    assert w["m"]["significant"] and w["m"]["p_value"] < 0.01 and 40 < w["m"]["dof"] < 60
    assert not w["k"]["significant"]


def test_wilcoxon_drops_zeros(spark):
    df = spark.createDataFrame([(1.0, 1.0), (3.0, 1.0), (1.0, 2.0), (5.0, 1.0)], "x double, y double")
    w = significance.wilcoxon_signed_rank(df, "x", "y").first()
    assert (w["n"], w["w_plus"], w["w_minus"]) == (3, 5.0, 1.0) and 0 < w["p_value"] < 1


@pytest.fixture(scope="module")
def shifted(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(240, 4))
    y = (x[:, 0] > 0).astype(int)
    mk = lambda m: spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(m)], "item_id long, embedding array<double>")
    labels = spark.createDataFrame([(i, int(v) if i % 29 else -1) for i, v in enumerate(y)], "item_id long, label int")
    return mk(x), mk(x + np.array([0, 9.0, 0, 0])), mk(rng.normal(size=(240, 4))), labels


def test_proxy_distance_ends_of_the_scale(shifted):
    a, far, other, _ = shifted
    assert probes.proxy_a_distance(a, far).first()["pad"] == pytest.approx(2, abs=0.05)
    assert probes.proxy_a_distance(a, far, standardize="per_domain").first()["pad"] < 0.4
    assert abs(probes.proxy_a_distance(a, other, permute=True).first()["pad"]) < 0.6


def test_transfer_retains_what_the_shift_leaves(shifted):
    a, far, _, labels = shifted
    t = probes.probe_transfer(a, far, labels, standardize=False).first()
    assert t["same"] > 0.9 and t["cross"] <= t["same"] + 1e-9
    assert probes.probe_transfer(a, a, labels).first()["retention"] == pytest.approx(1)


def test_projection_of_equal_sets_links_at_zero(shifted):
    a = shifted[0]
    assert probes.paired_link_median(probes.pca_project(a, a)).first()[0] == pytest.approx(0, abs=1e-9)


# --- sources ------------------------------------------------------------------------------------
def test_broken_record_is_reported(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"tag": "a", "seed": 1, "test": {"m": 1.0}}, indent=1))
    (tmp_path / "b.json").write_text('{"tag": "b", ')
    good, bad = scans.scan_run_records(spark, str(tmp_path))
    assert [r["tag"] for r in good.collect()] == ["a"] and bad.count() == 1


def test_history_keeps_numbers_only(spark, tmp_path):
    (tmp_path / "run1").mkdir()
    (tmp_path / "run1" / "try.jsonl").write_text('{"epoch": 3, "val": {"iou": 0.5, "ok": true}, "done": false, "lr": 1e-3, "note": "x"}\n')
    h = scans.scan_run_history(spark, str(tmp_path / "*" / "*"))
    assert rows(h, "run", "attempt", "epoch", "metric", "value") == [("run1", "try", 3, "lr", 0.001), ("run1", "try", 3, "val.iou", 0.5)]


def test_bad_dates_become_null(spark, tmp_path):
    from skydrift.sources import schemas

    n = schemas.MANIFEST.count(",") + 1
    line = ["1", "1", "7", "2024-02-30x", "2024-03-01"] + [""] * (n - 5)
    (tmp_path / "m.csv").write_text("h\n" + ",".join(line) + "\n")
    r = scans.scan_manifest(spark, str(tmp_path / "m.csv")).first()
    assert r["date_phi"] is None and r["date_s2b"] == dt.date(2024, 3, 1)


def test_old_and_new_reports(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"status":"ok","avg_cosine_similarity":0.5,"pairs_processed":3}\n{"status":"ok","results":[{"cosine_similarity":1.0,"mse_error":2.0},{"cosine_similarity":0.0,"mse_error":4.0}],"other":1}\n')
    r = scans.read_drift_reports(spark, str(tmp_path / "r.json")).collect()
    assert [(x["pairs_processed"], x["avg_cosine_similarity"], x["avg_mse_error"]) for x in r] == [(3, 0.5, None), (2, 0.5, 3.0)]


def test_normalisation_round_trip(spark, tmp_path):
    s = spark.createDataFrame([("x", 1.0, 2.0), ("y", 3.0, 4.0)], "band string, mean double, std double")
    sinks.write_normalization_config(s, str(tmp_path / "n"))
    assert rows(scans.load_normalization(spark, str(tmp_path / "n")), "band", "mean", "std") == [("x", 1.0, 2.0), ("y", 3.0, 4.0)]


# --- streams ------------------------------------------------------------------------------------
def test_late_rows_are_dropped_after_the_watermark(spark, tmp_path):
    src = str(tmp_path / "src")
    t = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    for i, rows_ in enumerate([[("x", t(1), 1.0), ("x", t(1, 30), 3.0), ("x", t(5), 9.0)], [("x", t(9), 1.0)], [("x", t(1, 10), 100.0), ("x", t(9), 1.0)]]):
        spark.createDataFrame(rows_, "band string, ts timestamp, value double").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("band string, ts timestamp, value double").option("maxFilesPerTrigger", 1).parquet(src)
    got = monitors.run_to_table(monitors.stream_band_stats(stream, "1 hour", "10 minutes"), "late").where(F.hour("window_start") == 1).collect()
    assert [(r["n"], r["mean"], r["std"]) for r in got] == [(2, 2.0, 1.0)]


def test_stream_join_equals_batch(spark, sf):
    from skydrift.plans import registry

    registry.load_all()
    got = registry.QUERIES["stream_prediction_drift"](spark, sf).agg(F.sum("pairs"), F.sum("flips")).first()
    e = spark.read.parquet(f"{sf}/events.parquet").select(F.get_json_object("props", "$.k").cast("int").alias("k"))
    flips = e.where((F.col("k") % 7 == 0) & (F.col("k") % 4 != 0)).count()
    assert e.count() - 5 <= got[0] <= e.count() and flips - 5 <= got[1] <= flips


def test_report_collections_build(spark, sf):
    from skydrift.plans import adapters as A
    from skydrift.plans.catalog import datasets, experiments

    m = splits.random_split(A.manifest(spark, sf), ["patch_index"])
    t = reports.dataset_report(m, datasets.BAD, [10, 20, 30])
    assert all(df.count() > 0 for df in t.values())
    c = reports.run_comparison(A.run_history(spark, sf), experiments.METRICS, "iou", "view", "error")
    assert c["tests"].count() == 2 and c["curves"].count() > 0
