"""Raster tables: panchromatic band, radiometry, cropping, regridding, tiling."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C


def explode_pixels(patch_bands: DataFrame, keep: Sequence[str] = ("patch_index", "view", "band")) -> DataFrame:
    """One row per pixel; y and x follow from the position in the band array."""
    return patch_bands.select(*keep, "width", F.posexplode("pixels").alias("_pos", "value")).select(
        *keep,
        (F.col("_pos") / F.col("width")).cast("int").alias("y"),
        (F.col("_pos") % F.col("width")).cast("int").alias("x"),
        "value",
    )


def pack_pixels(pixels: DataFrame, keys: Sequence[str] = ("patch_index", "view", "band")) -> DataFrame:
    """Inverse of ``explode_pixels``; a group is one image, so its size is fixed."""
    g = pixels.groupBy(*keys).agg(
        (F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"),
        F.array_sort(F.collect_list(F.struct("y", "x", "value"))).alias("_p"),
    )
    return g.select(*keys, "height", "width", F.transform("_p", lambda s: s["value"]).alias("pixels"))


def pan_column(bands: Mapping[str, str], weights: Mapping[str, float] = C.PAN_WEIGHTS):
    """Weighted mean of the bands present (``band id -> column``), weights renormalised.

    Without any known band it is the plain mean.
    """
    known = [(col, weights[b]) for b, col in bands.items() if weights.get(b, 0.0) > 0]
    total = sum(w for _, w in known)
    if total <= 0:
        s = F.lit(0.0)
        for col in bands.values():
            s = s + F.col(col)
        return s / F.lit(float(len(bands)))
    s = F.lit(0.0)
    for col, w in known:
        s = s + F.col(col) * F.lit(w / total)
    return s


def visible_pan(blue: str, green: str, red: str):
    return (F.col(blue) + F.col(green) + F.col(red)) / F.lit(3.0)


def irradiance_with_pan(irradiance: DataFrame, weights: Mapping[str, float] = C.PAN_WEIGHTS) -> DataFrame:
    """Adds a PAN row per scene: the weighted sum of the scene's band irradiances."""
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    pan = irradiance.where(F.col("band") != "PAN").groupBy("scene_id").agg(
        F.sum(F.col("irradiance") * F.coalesce(F.try_element_at(table, F.col("band")), F.lit(0.0))).alias("irradiance")
    )
    pan = pan.join(irradiance.where(F.col("band") == "PAN").select("scene_id"), "scene_id", "left_anti")
    return irradiance.select("scene_id", "band", "irradiance").unionByName(
        pan.select("scene_id", F.lit("PAN").alias("band"), "irradiance")
    )


def _radiance_factor():
    return F.cos(F.radians("sun_zenith")) * F.col("earth_sun_dist") / F.lit(math.pi) * F.col("irradiance")


def to_radiance(pixels: DataFrame, meta: DataFrame, level: str = "L1C", value: str = "value") -> DataFrame:
    """Reflectance to radiance; anything but L1C passes through unchanged.

    ``meta`` holds (scene_id, band, irradiance, earth_sun_dist, sun_zenith). The
    distance factor multiplies as given; use its inverse square for the textbook form.
    """
    if level != "L1C":
        return pixels.withColumn("radiance", F.col(value))
    j = pixels.join(meta, ["scene_id", "band"])
    return j.withColumn("radiance", F.col(value) * _radiance_factor()).drop("irradiance", "earth_sun_dist", "sun_zenith")


def to_reflectance(pixels: DataFrame, meta: DataFrame, level: str = "L1C", value: str = "radiance") -> DataFrame:
    if level != "L1C":
        return pixels.withColumn("reflectance", F.col(value))
    j = pixels.join(meta, ["scene_id", "band"])
    return j.withColumn("reflectance", F.col(value) / _radiance_factor()).drop("irradiance", "earth_sun_dist", "sun_zenith")


def crop(pixels: DataFrame, edge: int, height: str = "height", width: str = "width") -> DataFrame:
    """Drop ``edge`` border pixels on each side; coordinates restart at 0."""
    inside = F.col("y").between(F.lit(edge), F.col(height) - edge - 1) & F.col("x").between(F.lit(edge), F.col(width) - edge - 1)
    return (
        pixels.where(inside)
        .withColumn("y", F.col("y") - edge).withColumn("x", F.col("x") - edge)
        .withColumn(height, F.col(height) - 2 * edge).withColumn(width, F.col(width) - 2 * edge)
    )


def center_crop(pixels: DataFrame, size: int, height: str = "height", width: str = "width") -> DataFrame:
    """Centre window; the offset is the floor of half the spare border."""
    top, left = F.floor((F.col(height) - size) / 2), F.floor((F.col(width) - size) / 2)
    y, x = F.col("y") - top, F.col("x") - left
    return (
        pixels.where(y.between(0, size - 1) & x.between(0, size - 1))
        .withColumn("y", y.cast("int")).withColumn("x", x.cast("int"))
        .withColumn(height, F.lit(size)).withColumn(width, F.lit(size))
    )


def regrid_nearest(pixels: DataFrame, src_res: float, dst_res: float, keys: Sequence[str] = ("patch_index",),
                   height: str = "height", width: str = "width") -> DataFrame:
    """Nearest-cell resampling to a new pixel size, values untouched.

    New size is int(n * src / dst) and target cell i reads source cell
    floor(i * n_src / n_dst). Turned around, each source pixel knows which target
    cells read it, so the whole operator is a projection with an explode: no
    target grid is built and nothing is joined or shuffled.
    """
    ratio = src_res / dst_res
    nh = F.floor(F.col(height) * F.lit(ratio)).cast("int")
    nw = F.floor(F.col(width) * F.lit(ratio)).cast("int")

    def targets(pos, n_src, n_dst):
        # floor(i * n_src / n_dst) = pos  <=>  ceil(pos*n_dst/n_src) <= i < ceil((pos+1)*n_dst/n_src)
        first = F.ceil(pos * n_dst / n_src).cast("int")
        last = (F.ceil((pos + 1) * n_dst / n_src) - 1).cast("int")
        return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

    p = pixels.withColumn("_nh", nh).withColumn("_nw", nw)
    p = p.withColumn("_ys", targets(F.col("y"), F.col(height), F.col("_nh")))
    p = p.withColumn("_xs", targets(F.col("x"), F.col(width), F.col("_nw")))
    p = p.withColumn("_y", F.explode("_ys")).withColumn("_x", F.explode("_xs"))
    return (
        p.withColumn("y", F.col("_y")).withColumn("x", F.col("_x"))
        .withColumn(height, F.col("_nh")).withColumn(width, F.col("_nw"))
        .drop("_nh", "_nw", "_ys", "_xs", "_y", "_x")
    )


def _axis_tiles(n, size: int, stride: int):
    """(number, start, end) along one axis; late tiles are pulled back inside."""
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(stride))
    return F.transform(
        starts,
        lambda s, i: F.struct(
            i.alias("i"),
            F.greatest(F.lit(0), F.least(s + size, n) - size).alias("lo"),
            F.least(s + size, n).alias("hi"),
        ),
    )


def tile_grid(scenes: DataFrame, size: int, overlap: float = 0.0, height: str = "height", width: str = "width") -> DataFrame:
    """One row per tile of every scene, with pixel bounds (end exclusive).

    With an affine ``transform`` column [x0, dx, rx, y0, ry, dy] the bounds in
    map units are added.
    """
    stride = int(size * (1 - overlap))
    t = scenes.where((F.col(height) > 0) & (F.col(width) > 0))
    t = t.withColumn("_tx", F.explode(_axis_tiles(F.col(width), size, stride)))
    t = t.withColumn("_ty", F.explode(_axis_tiles(F.col(height), size, stride)))
    out = t.withColumn("tile_x", F.col("_tx.i")).withColumn("tile_y", F.col("_ty.i"))
    for a in ("x", "y"):
        out = out.withColumn(f"{a}1", F.col(f"_t{a}.lo")).withColumn(f"{a}2", F.col(f"_t{a}.hi"))
    out = out.drop("_tx", "_ty")
    if "transform" in scenes.columns:
        m = F.col("transform")
        for n, (cx, cy) in {"1": ("x1", "y1"), "2": ("x2", "y2")}.items():
            out = out.withColumn(f"map_x{n}", m[0] + m[1] * F.col(cx) + m[2] * F.col(cy))
            out = out.withColumn(f"map_y{n}", m[3] + m[4] * F.col(cx) + m[5] * F.col(cy))
    return out


def assign_tiles(pixels: DataFrame, size: int, overlap: float = 0.0, height: str = "height", width: str = "width") -> DataFrame:
    """Every tile a pixel falls into.

    The tiles of an axis follow from its length alone, so membership is plain
    arithmetic on the pixel's position and the range join disappears.
    """
    stride = int(size * (1 - overlap))

    def hits(pos, n):
        first = F.greatest(F.floor((pos - size) / stride) + 1, F.lit(0))
        # tiles pulled back from the far edge cover the last ``size`` pixels
        last = F.when(pos >= n - size, F.floor((n - 1) / stride)).otherwise(F.floor(pos / stride))
        return F.sequence(first.cast("int"), last.cast("int"))

    p = pixels.withColumn("tile_x", F.explode(hits(F.col("x"), F.col(width))))
    return p.withColumn("tile_y", F.explode(hits(F.col("y"), F.col(height))))
