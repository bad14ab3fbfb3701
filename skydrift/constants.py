"""Fixed values the results depend on. They are data, not logic."""

from __future__ import annotations

# --- fixed values: band names and orders -----------------------------------
BAND_NAMES = ["blue", "green", "red", "re1", "re2", "re3", "nir"]
S2_BANDS = ["B02", "B03", "B04", "B08", "B05", "B06", "B07"]
SIMULATED_BANDS = ["B02", "B03", "B04", "PAN", "B08", "B05", "B06", "B07"]

# --- fixed values: panchromatic weights per S2 band ------------------------
PAN_WEIGHTS = {
    "B02": 0.21594369,
    "B03": 0.28731533,
    "B04": 0.25719303,
    "B08": 0.0,
    "B05": 0.12275664,
    "B06": 0.11679131,
    "B07": 0.0,
}

# --- fixed values: per-view normalisation in square-root space -------------
DOMAIN_STATS = {
    "real": {
        "mean": [14.5305, 14.4030, 15.4191, 13.6231, 14.2143, 14.7041, 13.1745],
        "std": [10.6197, 9.4811, 9.0923, 10.5712, 10.4277, 10.3784, 9.7216],
        "clip": 38.729,
        "clip_mode": "smooth",
    },
    "s2b": {
        "mean": [49.0215, 48.4241, 49.2270, 51.1619, 55.4031, 57.3537, 56.7685],
        "std": [6.5464, 6.9918, 9.1444, 8.3999, 7.9740, 8.3373, 8.4429],
        "clip": 100.0,
        "clip_mode": "hard",
    },
    "sim": {
        "mean": [49.0253, 48.4297, 49.2364, 51.1648, 55.4065, 57.3572, 56.7808],
        "std": [6.5203, 6.9570, 9.0981, 8.3858, 7.9555, 8.3155, 8.3664],
        "clip": 100.0,
        "clip_mode": "hard",
    },
}
SMOOTH_CLIP_SOFTNESS = 6.0
REFLECTANCE_SCALE = 10000.0

# --- fixed values: land-cover codes, names, pixel shares (percent) ---------
LAND_COVER_CODES = [10, 20, 30, 40, 50, 60, 70, 80, 90, 95, 100]
LAND_COVER_NAMES = [
    "tree_cover", "shrubland", "grassland", "cropland", "built_up",
    "bare_sparse_veg", "snow_ice", "water", "herbaceous_wetland",
    "mangroves", "moss_lichen",
]
LAND_COVER_PIXEL_FREQ = [
    19.995, 6.006, 20.777, 13.422, 14.400, 16.196, 0.497, 6.233, 1.423, 0.521, 0.331,
]
IGNORE_LABEL = -1

# --- fixed values: product ids left out of every analysis ------------------
BAD_PRODUCT_IDS = [
    1294, 1296, 1342, 1385, 1397, 1420, 1460, 1497, 1647, 1854, 2223, 2246,
    2259, 2373, 2631, 2640, 2743, 2834, 2853, 3374, 3619, 4071, 4693, 4813,
    4942, 2352, 2882, 3322, 3914, 4702, 1333, 1466, 1615, 2460, 2729, 2763,
]

# --- fixed values: climate groups as (label, low, high) zone ranges --------
KOPPEN_RANGES = [
    ("A  Tropical", 1, 3),
    ("B  Arid", 4, 7),
    ("C  Temperate", 8, 16),
    ("D  Continental", 17, 28),
    ("E  Polar", 29, 30),
    ("no data", 0, 0),
]

# --- fixed values: degradation ladder --------------------------------------
LADDER_FACTORS = ["snr", "psf", "misalign", "joint"]
LADDER_LEVELS = [1, 2, 3, 4]
UNKNOWN_VARIANT_POSITION = 99

# --- fixed values: metric keys, in order of preference ---------------------
METRIC_KEYS = {
    "test_iou": ["test/student_target_iou", "test/mIoU"],
    "test_iou_fixed": ["test/student_target_iou_fixed"],
    "test_iou_water": ["test_per_class/IoU_water", "test/IoU_flood"],
    "test_iou_not_water": ["test_per_class/IoU_not_water", "test/IoU_background"],
    "test_loss": ["test/loss"],
}
WARMUP_EPOCHS = 8

# --- fixed values: model families whose alternative to scratch is pretrained
PRETRAINED_MODEL_PREFIXES = ["terramind"]

# --- fixed values: kernel widths of the multi-kernel MMD -------------------
MMD_SIGMAS = [1.0, 2.0, 4.0, 8.0, 16.0]

# --- fixed values: scene-class codes ---------------------------------------
SCL_CLOUD, SCL_SHADOW, SCL_CIRRUS = [8, 9], [3], [10]

METERS_PER_DEGREE = 111320.0


def ladder_order() -> list[str]:
    """Clean first, then every factor from mild to strong."""
    return ["clean"] + [f"{f}_l{n}" for f in LADDER_FACTORS for n in LADDER_LEVELS]
