"""The composite reports: what a user of the library calls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import select
from ..operators import bands as B
from ..operators import distance as D
from ..operators import embedding as E
from ..operators import manifest as M
from ..operators import pairing as P
from ..operators import prediction as Q
from ..operators import probes as Pr
from ..operators import runs as R
from ..operators import segmentation as S
from ..operators import significance as T
from ..session import stored


def pair_drift_report(pixels: DataFrame, layers: DataFrame, classes: DataFrame, max_diff: DataFrame | None = None,
                      key: str = "item_id", a: str = "a", b: str = "b") -> DataFrame:
    """One row per pair: spectral, embedding and class drift as structs.

    ``pixels`` is (key, view, band, value), ``layers`` (item_id, layer, emb_a,
    emb_b), ``classes`` paired predictions. Each family is one aggregation on the
    pair key; a pair lacking one family keeps the others.
    """
    bands = B.spectral_drift_wide(pixels, [key, "band"], a, b)
    spectral = bands.groupBy(key).agg(
        F.struct(
            F.map_from_entries(F.collect_list(F.struct("band", F.struct("mean_diff", "mean_pct_change", "std_change", "std_pct_change", "range_change")))).alias("bands"),
            F.avg(F.abs("mean_diff")).alias("avg_mean_difference"), F.max(F.abs("mean_diff")).alias("max_mean_difference"),
            F.avg(F.abs("std_change")).alias("avg_std_change"), F.max(F.abs("std_change")).alias("max_std_change"),
        ).alias("spectral_drift")
    )
    e = E.embedding_drift(layers)
    if max_diff is not None:
        e = e.join(max_diff.withColumnRenamed(key, "item_id"), "item_id", "left")
    e = e.select(F.col("item_id").alias(key), F.struct(*[c for c in e.columns if c != "item_id"]).alias("embedding_drift"))
    c = Q.class_drift(classes)
    c = c.select(F.col("item_id").alias(key), F.struct(*[x for x in c.columns if x != "item_id"]).alias("class_drift"))
    return spectral.join(e, key, "full").join(c, key, "full")


def directory_drift(reports: DataFrame) -> DataFrame:
    """Run summary of pair reports: embedding and pixel averages, the average of every layer, and class flips.

    One aggregation by layer; a report counts for the run where its first layer does.
    """
    e, c = F.col("embedding_drift"), F.col("class_drift")
    pixel = F.avg(e["pixel_max_diff"]) if "pixel_max_diff" in reports.schema["embedding_drift"].dataType.names else F.lit(None).cast("double")
    run = {
        "pairs_processed": F.count(F.lit(1)),
        "avg_cosine_similarity": F.avg(e["cosine_similarity"]), "avg_mse_error": F.avg(e["mse_error"]), "avg_mae_error": F.avg(e["mae_error"]), "avg_pixel_max_diff": pixel,
        "total_pairs": F.count(c["class_flip"]), "class_flips_count": F.count_if(c["class_flip"]),
        "class_flip_rate": F.avg(c["class_flip"].cast("double")), "avg_probability_change": F.avg(c["probability_change"]),
        "max_probability_change": F.max(F.abs(c["probability_change"])), "avg_top3_consistency": F.avg(c["top3_consistency"]),
    }
    each = reports.select("embedding_drift", "class_drift", F.posexplode_outer(e["layer_cosine_similarities"]).alias("_i", "_c")).withColumn("_i", F.coalesce("_i", F.lit(0)))
    per = each.groupBy("_i").agg(F.avg("_c").alias("_m"), *[a.alias(n) for n, a in run.items()])
    layers = F.transform(F.array_sort(F.collect_list(F.when(F.col("_m").isNotNull(), F.struct("_i", "_m")))), lambda s: s["_m"])
    first = lambda n: F.max(F.when(F.col("_i") == 0, F.col(n)))
    none = ("pairs_processed", "total_pairs", "class_flips_count")
    return per.agg(*[(F.coalesce(first(n), F.lit(0)) if n in none else first(n)).alias(n) for n in run], layers.alias("per_layer_avg_cosine_similarity"))


def folder_drift(files_a: DataFrame, files_b: DataFrame, old: str, new: str, pixels: DataFrame, pixel_pairs: DataFrame, bands_a: Sequence[str], bands_b: Sequence[str],
                 layers: DataFrame, classes: DataFrame, key: str = "item_id", a: str = "a", b: str = "b") -> dict[str, DataFrame]:
    """Two folders compared: files paired by name, a report per pair, the run summary, the pairs whose class flips, files without a partner.

    ``files_a`` and ``files_b`` are (key, name); a file of the first meets the one
    whose name has ``new`` for ``old``. The other tables hold both folders' pixels,
    layers and predictions by the key of the first; only rows of pairs count.
    """
    pairs, lone = P.match_counterparts(files_a, files_b.select("name"), old, new)
    mine = pairs.select(key).distinct()
    here = lambda df, k=key: df.join(mine.withColumnRenamed(key, k), k, "left_semi")
    diff = B.pixel_max_diff(here(pixel_pairs), [key], bands_a, bands_b)
    reports = pair_drift_report(here(pixels), here(layers, "item_id"), here(classes, "item_id"), diff, key, a, b)
    reports = stored(pairs.select(key, "name", F.col("right_name").alias("partner")).join(reports, key, "left"), "reports")
    c = F.col("class_drift")
    flipped = reports.where(c["class_flip"]).select(key, "name", "partner", c["a_predicted_class"].alias("from_class"), c["b_predicted_class"].alias("to_class"), c["probability_change"].alias("probability_change"))
    return {"reports": reports, "summary": directory_drift(reports), "flipped": flipped, "without_partner": lone}


def segmentation_drift_report(pairs: DataFrame, pixels: DataFrame, masks: DataFrame, key: str = "patch_index") -> DataFrame:
    """Segmentation and spectral drift over pairs that have a partner, and the pair counts.

    ``pairs`` is (key, simulated_file); rows without a file are counted, not compared.
    """
    with_partner = pairs.where(F.col("simulated_file").isNotNull()).select(key)
    seg = S.segmentation_drift_summary(S.segmentation_drift(masks.join(with_partner, key, "left_semi"), [key]))
    px = pixels.join(with_partner, key, "left_semi")
    spec = B.folder_spectral_summary(B.spectral_drift_summary(B.spectral_drift_wide(px, [key, "band"], "a", "b"), [key]))
    info = P.split_info(pairs)
    row = lambda df, names: [df.select(F.struct(*names)).scalar()[n].alias(n) for n in names]
    return seg.select(
        "*", *row(spec, ["avg_mean_difference", "max_mean_difference", "avg_std_change", "max_std_change"]),
        *row(info, ["total", "with_partner", "without_partner"]),
    )


def dataset_report(manifest: DataFrame, bad_ids: Sequence[int] = tuple(C.BAD_PRODUCT_IDS), codes: Sequence[int] = C.LAND_COVER_CODES, only: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Every table of the manifest report, by name, or ``only`` those named: nothing is run for the others. The manifest is made once."""
    manifest = stored(manifest, "manifest")
    kept = P.drop_bad_products(manifest, bad_ids)
    make = {
        "summary": lambda: M.manifest_summary(manifest, bad_ids),
        "lags": lambda: M.lag_histogram(kept),
        "months": lambda: M.monthly_coverage(kept),
        "cloud_ecdf": lambda: M.ecdf(kept, ["thick_cloud_pct", "thin_cloud_pct"]),
        "prior": lambda: M.rank_by_value(M.class_prior(kept), "pct"),
        "prior_by_split": lambda: M.class_prior(kept, ["split"]),
        "dominant": lambda: M.dominant_counts(kept, codes),
        "geography": lambda: M.density_grid(kept, "center_lon", "center_lat", 72, 36, (-180.0, 180.0), (-90.0, 90.0)),
        "climate": lambda: M.climate_counts(kept),
        "under_5pct_cloud": lambda: M.pct_below(kept, ["thick_cloud_pct", "thin_cloud_pct"], 5.0),
        "group_sizes": lambda: M.group_sizes(kept),
        "leakage": lambda: P.split_leakage(kept, "product_id"),
    }
    return {n: table() for n, table in make.items() if only is None or n in only}


def sensor_report(pixels: DataFrame, wide: DataFrame, bands: dict[str, tuple[str, str]], bins: int = 60, only: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Every table of the spectral report, by name, or ``only`` those named: nothing is run for the others.

    ``pixels`` is (view, band, value), ``wide`` has the same with a column per view and
    band, ``bands`` names both columns of a band. One selection serves the first four and
    the edges of the histogram, one over positive values the signature and the lower
    edge, one ranking the transfer fit and the correspondence.
    """
    names = ["domain_stats", "spectral_stats", "boxes", "boxes_standardised", "signature", "transfer", "correspondence", "histogram"]
    here = [n for n in names if only is None or n in only]
    needs = lambda table: list(dict.fromkeys(w for n, w in table if n in here))
    of_all = needs([("domain_stats", B.CLIP), ("spectral_stats", B.TAILS), ("boxes", B.QUARTILES), ("boxes_standardised", B.QUARTILES), ("histogram", B.TRIM)])
    of_positive = needs([("signature", B.MEDIAN), ("histogram", B.LOW)])
    shared = B.spectral_selection(pixels, wanted=of_all) if of_all else None
    above = select.select(B.valid_pixels(pixels), ("view", "band"), "value", of_positive) if of_positive else None
    targets, references = ([p[i] for p in bands.values()] for i in (0, 1))
    every = [(t, r) for t in targets for r in references] if "correspondence" in here else list(bands.values())
    rho = stored(B.rank_correlations(wide, every), "rho") if {"transfer", "correspondence"} & set(here) else None
    make = {
        "domain_stats": lambda: B.domain_stats(pixels, selection=shared),
        "spectral_stats": lambda: B.spectral_stats_table(pixels, selection=shared),
        "boxes": lambda: B.box_stats(pixels, selection=shared),
        "boxes_standardised": lambda: B.box_stats(pixels, z=True, selection=shared),
        "signature": lambda: B.spectral_signature(above.percentiles(B.MEDIAN).select("view", "band", F.col("pct")[0].alias("median"))),
        "transfer": lambda: B.sensor_transfer_fit_wide(wide, bands, rho),
        "correspondence": lambda: B.band_correspondence(wide, targets, references, rho),
        "histogram": lambda: B.value_histogram(pixels, ["view"], bins, log=True, pct=shared.percentiles(B.TRIM), above=above.percentiles(B.LOW)),
    }
    return {n: make[n]() for n in here}


def domain_gap_table(embeddings: DataFrame, labels: DataFrame, pairs: Sequence[tuple[str, str]], dim: int) -> DataFrame:
    """One row per pair of domains: MMD^2 and its standard error, PAD, probe error, paired cosine, retention.

    MMD^2 is that of the two complete sets (:func:`distance.mmd2_whole`).
    """
    out = None
    for a, b in pairs:
        side = lambda d: embeddings.where(F.col("domain") == d)
        x, y = side(a), side(b)
        pad = Pr.proxy_a_distance(x.select("item_id", "embedding"), y.select("item_id", "embedding"))
        mmd = D.mmd2_whole(E.two_sample(*[d.withColumn("batch", F.lit(0)) for d in (x, y)]), dim).select(F.struct("mmd2", "std_error")).scalar()
        cos = E.layer_metrics(
            x.select("item_id", F.col("embedding").alias("emb_a")).join(y.select("item_id", F.col("embedding").alias("emb_b")), "item_id")
        ).agg(F.avg("cosine").alias("paired_cosine"))
        t = Pr.probe_transfer(x, y, labels)
        row = t.select(
            F.lit(f"{a} vs {b}").alias("pair"), mmd["mmd2"].alias("mmd2"), mmd["std_error"].alias("mmd2_std_error"), pad.select("pad").scalar().alias("pad"), pad.select("error").scalar().alias("error"),
            cos.scalar().alias("paired_cosine"), F.col("same").alias("probe_same"), F.col("cross").alias("probe_cross"), "retention",
        )
        out = row if out is None else out.unionByName(row)
    return out


def ladder_report(records: DataFrame, severity: DataFrame | None = None, metric: str = "test_iou_water") -> dict[str, DataFrame]:
    rows = R.flatten_run_records(records, severity)
    return {"results": R.custom_order(rows), "summary": R.custom_order(R.ladder_summary(rows, metric)), "deltas": R.paired_seed_delta(rows, metric)}


def run_comparison(history: DataFrame, metrics: Sequence[str], best_metric: str, run_a: str | None = None, run_b: str | None = None,
                   per_class: DataFrame | None = None, warmup: int = C.WARMUP_EPOCHS) -> dict[str, DataFrame]:
    """Summary per run, and for two runs the Welch tests on per-epoch values."""
    attempt = R.longest_attempt(history).select("run", "attempt")
    curve = R.collapse_epochs(history.join(attempt, ["run", "attempt"], "left_semi"))
    out = {"summary": R.run_summary(curve, metrics, best_metric, warmup), "curves": R.metric_curve(curve, metrics)}
    if run_a and run_b:
        out["tests"] = T.welch_ttest(curve.where(F.col("epoch") >= warmup), run_a, run_b)
    if per_class is not None:
        out["dead_classes"] = S.dead_classes(per_class)
    return out
