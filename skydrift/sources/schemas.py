"""Schemas of every table read from files; nothing is inferred."""

PATCH_BANDS = "patch_index BIGINT, view STRING, band STRING, height INT, width INT, pixels ARRAY<SMALLINT>"

_FRACTIONS = ", ".join(f"wc_frac_{c} DOUBLE" for c in (10, 20, 30, 40, 50, 60, 70, 80, 90, 95, 100))
MANIFEST = (
    "patch_index BIGINT, label_h5_index BIGINT, product_id BIGINT, date_phi STRING, date_s2b STRING, "
    "patch_delta_days DOUBLE, thick_cloud_pct DOUBLE, thin_cloud_pct DOUBLE, " + _FRACTIONS + ", "
    "wc_nodata_frac DOUBLE, wc_dominant_class INT, wc_dominant_frac DOUBLE, center_lon DOUBLE, center_lat DOUBLE, koppen_zone INT"
)

RUN_RECORD = (
    "tag STRING, sim_root STRING, model STRING, seed INT, scratch BOOLEAN, freeze STRING, epochs_run INT, best_val_iou DOUBLE, "
    "test MAP<STRING,DOUBLE>, cross_condition MAP<STRING,MAP<STRING,DOUBLE>>, _corrupt STRING"
)

_CLASS = "predicted_class:INT, probability:DOUBLE"
DRIFT_REPORT = (
    "status STRING, pair_id STRING, "
    "spectral_drift STRUCT<avg_mean_difference:DOUBLE, max_mean_difference:DOUBLE, avg_std_change:DOUBLE, max_std_change:DOUBLE>, "
    "embedding_drift STRUCT<cosine_similarity:DOUBLE, mse_error:DOUBLE, mae_error:DOUBLE, pixel_max_diff:DOUBLE, "
    "layer_cosine_similarities:ARRAY<DOUBLE>>, "
    "class_drift STRUCT<class_flip:BOOLEAN, probability_change:DOUBLE, top3_consistency:DOUBLE>, "
    "results ARRAY<STRUCT<cosine_similarity:DOUBLE, mse_error:DOUBLE, mae_error:DOUBLE, pixel_max_diff:DOUBLE>>, "
    "pairs_processed BIGINT, avg_cosine_similarity DOUBLE, avg_mse_error DOUBLE, avg_mae_error DOUBLE, avg_pixel_max_diff DOUBLE, "
    "per_layer_avg_cosine_similarity ARRAY<DOUBLE>"
)

FEATURE_COLLECTION = (
    "type STRING, features ARRAY<STRUCT<type:STRING, "
    "geometry:STRUCT<type:STRING, coordinates:ARRAY<DOUBLE>>, properties:MAP<STRING,STRING>>>"
)

SCENE_METADATA = "earth_sun_dist DOUBLE, solar_irradiances MAP<STRING,DOUBLE>, sun_zenith DOUBLE"
