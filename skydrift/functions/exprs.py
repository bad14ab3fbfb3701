"""Row expressions: scaling, normalising, label rules, names and dates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C


# --- values ------------------------------------------------------------------
def scale_clip(v: Column, scale: float = C.REFLECTANCE_SCALE) -> Column:
    return F.least(F.greatest(v / F.lit(float(scale)), F.lit(0.0)), F.lit(1.0))


def softplus(z: Column) -> Column:
    """log(1 + e^z) without overflow on either side."""
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def smooth_clip(x: Column, clip: Column | float, softness: float = C.SMOOTH_CLIP_SOFTNESS) -> Column:
    """A ceiling approached smoothly within about ``softness`` units of it."""
    clip = F.lit(float(clip)) if not isinstance(clip, Column) else clip
    beta = F.lit(4.0 / softness)
    return clip - softplus(beta * (clip - x)) / beta


def clipped_sqrt(v: Column, clip: Column, clip_mode: Column, softness: float = C.SMOOTH_CLIP_SOFTNESS) -> Column:
    root = F.sqrt(F.greatest(v, F.lit(0.0)))
    return F.when(clip_mode == "smooth", smooth_clip(root, clip, softness)).otherwise(F.least(root, clip))


def zscore(v: Column, mean: Column, std: Column) -> Column:
    return (v - mean) / std


def stretch(v: Column, lo: Column, hi: Column, floor: float = 1e-6) -> Column:
    return F.least(F.greatest((v - lo) / F.greatest(hi - lo, F.lit(floor)), F.lit(0.0)), F.lit(1.0))


def percent_change(before: Column, after: Column) -> Column:
    """0 when there is nothing to relate the change to."""
    return F.when(before == 0, F.lit(0.0)).otherwise((after - before) / before * 100.0)


# --- labels ------------------------------------------------------------------
def remap_labels(code: Column, mapping: Mapping[int, int] | None = None, default: int = C.IGNORE_LABEL) -> Column:
    mapping = mapping if mapping is not None else {c: i for i, c in enumerate(C.LAND_COVER_CODES)}
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.try_element_at(table, code), F.lit(default))


def binary_mask(label: Column, strict: bool = False) -> Column:
    """1 stays 1 and -1 stays ignored; other codes become 0, or -1 when strict."""
    keep = F.when(label == 1, 1).when(label == C.IGNORE_LABEL, C.IGNORE_LABEL)
    if strict:
        return keep.when(label == 0, 0).otherwise(C.IGNORE_LABEL)
    return keep.otherwise(0)


def error_class(label: Column, pred: Column) -> Column:
    return (
        F.when((label == 1) & (pred == 1), "correct_water")
        .when((label == 1) & (pred == 0), "missed_water")
        .when((label == 0) & (pred == 1), "false_alarm")
        .when((label == 0) & (pred == 0), "correct_land")
        .otherwise("nodata")
    )


def scl_flags(scl: Column) -> dict[str, Column]:
    return {
        "cloud": scl.isin(C.SCL_CLOUD),
        "shadow": scl.isin(C.SCL_SHADOW),
        "cirrus": scl.isin(C.SCL_CIRRUS),
    }


def koppen_group(zone: Column) -> Column:
    """Climate group by zone range; a fixed table of six ranges folds to a CASE."""
    out = None
    for name, lo, hi in C.KOPPEN_RANGES:
        hit = zone.between(lo, hi)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


# --- names -------------------------------------------------------------------
def counterpart_key(name: Column, old: str, new: str) -> Column:
    return F.replace(name, F.lit(old), F.lit(new))


def strip_prefix(name: Column, prefix: str = "simulated_") -> Column:
    return F.when(name.startswith(prefix), F.substr(name, F.lit(len(prefix) + 1))).otherwise(name)


def stem_id(name: Column) -> Column:
    """First token before an underscore."""
    return F.split_part(name, F.lit("_"), F.lit(1))


def sample_id(name: Column) -> Column:
    """File name without extension and without its sensor suffix."""
    return F.regexp_replace(name, r"(_S[12]Hand|_LabelHand)?\.[A-Za-z0-9]+$", "")


def variant_factor(name: Column) -> Column:
    found = F.regexp_extract(name, r"^(.+)_l(\d+)$", 1)
    return F.when(name == "clean", "none").when(found != "", found).otherwise(name)


def variant_level(name: Column) -> Column:
    found = F.regexp_extract(name, r"^(.+)_l(\d+)$", 2)
    return F.when(name == "clean", 0).when(found != "", found.cast("int")).otherwise(-1)


def pick_metric(metrics: Column, keys: Sequence[str]) -> Column:
    """Value of the first key that is present."""
    return F.coalesce(*[F.try_element_at(metrics, F.lit(k)) for k in keys])


def run_label(path: Column, config: Column) -> Column:
    """Loss weights from the folder name plus the settings that are not default."""
    inst = F.regexp_extract(path, r"inst([\d.]+)_pix([\d.]+)", 1)
    pix = F.regexp_extract(path, r"inst([\d.]+)_pix([\d.]+)", 2)
    get = lambda k: F.try_element_at(config, F.lit(k))
    on = lambda k: get(k).isNotNull() & ~F.lower(get(k)).isin("", "0", "0.0", "false", "none")
    return F.concat_ws(
        ", ",
        F.when(inst != "", F.concat(F.lit("inst="), inst, F.lit(", pix="), pix)).otherwise(path),
        F.when(get("task_loss") == "focal", F.concat(F.lit("focal γ="), get("focal_gamma"))),
        F.when(on("class_weights"), F.lit("weighted")),
        F.when(on("kd_mode") & (get("kd_mode") != "kl"), F.concat(F.lit("kd="), get("kd_mode"))),
        F.when(on("w_crd"), F.concat(F.lit("crd="), get("w_crd"))),
        F.when(on("use_dsbn"), F.lit("DSBN")),
    )


# --- dates and places ---------------------------------------------------------
def doy_to_date(year: Column, doy: Column, base: int = 1) -> Column:
    return F.date_add(F.make_date(year, F.lit(1), F.lit(1)), (doy - base).cast("int"))


def scene_bbox(lat: Column, lon: Column, h: Column, w: Column, res: float) -> dict[str, Column]:
    """Square degrees around a centre, one degree-per-metre factor for both axes."""
    dy = h * F.lit(res / 2.0) / F.lit(C.METERS_PER_DEGREE)
    dx = w * F.lit(res / 2.0) / F.lit(C.METERS_PER_DEGREE)
    return {"min_x": lon - dx, "min_y": lat - dy, "max_x": lon + dx, "max_y": lat + dy}


# --- class scores --------------------------------------------------------------
def top_k_classes(probs: Column, k: int = 3) -> Column:
    """Best ``k`` (class, p) pairs, larger p first, lower class first on ties."""
    ranked = F.sort_array(
        F.transform(probs, lambda p, i: F.struct(p.alias("p"), (-i).alias("neg"))), asc=False
    )
    return F.transform(
        F.slice(ranked, 1, k), lambda s: F.struct((-s["neg"]).cast("int").alias("class"), s["p"].alias("p"))
    )
