"""Reproducible splits and samples, ordered by a hash of the row's key.

The hash order is the same on every engine and every run. Exact cuts are found
from digest ranges (``order.hash_thresholds``); no full sort takes place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import order


def random_split(df: DataFrame, keys: Sequence[str], seed=42, cuts: Sequence[float] = (0.8, 0.9),
                 names: Sequence[str] = ("train", "val", "test"), out: str = "split") -> DataFrame:
    """Exact sizes int(c*n) by rank of the key's digest; keys must be unique."""
    d = df.withColumn("_h", order.hash_key(seed, *[F.col(k) for k in keys]))
    t = order.hash_thresholds(d, "_h", cuts)
    d = d.withColumn("_t", t.select(F.struct(*t.columns)).scalar())
    col = None
    for i, _ in enumerate(cuts):
        hit = F.col("_h") < F.col(f"_t.t{i}")
        col = F.when(hit, names[i]) if col is None else col.when(hit, names[i])
    return d.withColumn(out, col.otherwise(names[len(cuts)])).drop("_h", "_t")


def train_test_70_30(df: DataFrame, key: str = "item_id", seed=42, out: str = "split") -> DataFrame:
    """One split over distinct items, the same for every variant of an item."""
    items = random_split(df.select(key).distinct(), [key], seed, (0.7,), ("train", "test"), out)
    return df.join(items, key)


def group_split(df: DataFrame, group: str, seed=42, cuts: Sequence[float] = (0.8, 0.9),
                names: Sequence[str] = ("train", "val", "test"), out: str = "split") -> DataFrame:
    """Whole groups go to one split: a projection on the group's digest, no shuffle. Cuts are exact to 52 bits of it."""
    place = F.conv(F.substring(order.hash_key(seed, F.col(group)), 1, 13), 16, 10).cast("long")
    col = None
    for i, c in enumerate(cuts):
        hit = place < int(c * 2**52)
        col = F.when(hit, names[i]) if col is None else col.when(hit, names[i])
    return df.withColumn(out, col.otherwise(names[len(cuts)]))


def sample_n(df: DataFrame, n: int, keys: Sequence[str], seed=42) -> DataFrame:
    """n rows without replacement, those with the lowest digests of their keys; all rows where there are no more.

    The n-th digest is found by counting digest ranges; then rows are filtered, and
    never meet in one task, however large n is. Keys are unique.
    """
    d = df.withColumn("_h", order.hash_key(seed, *[F.col(k) for k in keys]))
    t = order.hash_thresholds(d, "_h", ranks=[n])
    return d.where(F.coalesce(F.col("_h") < t.scalar(), F.lit(True))).drop("_h").orderBy(*keys)


def sample_pixels(df: DataFrame, per_patch: int, seed=42, patch: str = "patch_index", pos: Sequence[str] = ("y", "x")) -> DataFrame:
    """The same ``per_patch`` positions in every view of a patch.

    Positions are ranked once per patch, on the digest, without the view; a patch is
    one image, so its positions fit a task.
    """
    p = [patch, *pos]
    spots = df.select(*p).distinct().withColumn("_h", order.hash_key(seed, *[F.col(c) for c in p]))
    w = Window.partitionBy(patch).orderBy("_h")
    kept = spots.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_patch)
    return df.join(kept.select(*p), p, "left_semi")


def balanced_sample(df: DataFrame, label: str, cap: int, keys: Sequence[str], seed=42, ignore=-1, digits: int = 4) -> DataFrame:
    """At most ``cap`` rows per class, by digest; classes are few and may be huge."""
    d = df.where(F.col(label) != ignore).withColumn("_h", order.hash_key(seed, *[F.col(k) for k in keys]))
    return order.lowest_per_group(d, [label], "_h", cap, digits).drop("_h")


def permute_labels(df: DataFrame, key: str, label: str, seed=1, out: str = "permuted") -> DataFrame:
    """Each row gets the label of another row; label counts are unchanged.

    Row r of the key order takes the label of row r of a second, hashed order.
    Both orders are numbered range by range (``order.ordinal``).
    """
    rows = order.ordinal(df, key, "_i")
    hashed = df.select(F.col(label).alias(out), order.hash_key(seed, F.col(key)).alias("_h"))
    donor = order.ordinal(hashed, "_h", "_i").drop("_h")
    return rows.join(donor, "_i").drop("_i")


def head_n(df: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    return df.orderBy(*by).limit(n)
