"""Pairing records of two sides, and what is missing on either."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs, order
from ..session import stored


def match_counterparts(left: DataFrame, right: DataFrame, old: str, new: str, name: str = "name") -> tuple[DataFrame, DataFrame]:
    """Pairs by rewritten file name, and the left rows without a partner."""
    keyed = left.withColumn("_key", exprs.counterpart_key(F.col(name), old, new))
    r = right.select(F.col(name).alias("_key"), *[F.col(c).alias(f"right_{c}") for c in right.columns])
    return keyed.join(r, "_key").drop("_key"), keyed.join(r.select("_key"), "_key", "left_anti").drop("_key")


def partner_candidates(name: Column, split_dir: str) -> Column:
    """Names under which a partner may be stored, best first."""
    full = F.concat(F.lit("simulated_"), name)
    base = F.regexp_replace(F.replace(name, F.lit("S2Hand"), F.lit("")), "^_+|_+$", "")
    short = F.concat(F.lit("simulated_"), base, F.lit(".tif"))
    folder = F.lit(f"{split_dir}/")
    rules = [full, F.concat(folder, full), short, F.concat(folder, short)]
    return F.array(*[F.struct(F.lit(i).alias("priority"), r.alias("name")) for i, r in enumerate(rules)])


def pair_with_fallback(split: DataFrame, images: DataFrame, labels: DataFrame, simulated: DataFrame,
                       split_dir: str = "simulated_train", require_partner: bool = False) -> DataFrame:
    """Split rows whose image and label exist, with the first partner name found.

    ``split`` has (s1_file, label_file); the others have (name). Candidate names
    are exploded and met by one equi-join, then the best priority is kept.
    """
    s = split.withColumn("s2_file", exprs.counterpart_key(F.col("s1_file"), "S1Hand", "S2Hand"))
    s = s.join(images.select(F.col("name").alias("s2_file")), "s2_file", "left_semi")
    s = s.join(labels.select(F.col("name").alias("label_file")), "label_file", "left_semi")
    cand = s.select("s2_file", F.explode(partner_candidates(F.col("s2_file"), split_dir)).alias("c"))
    found = (
        cand.select("s2_file", "c.priority", F.col("c.name").alias("name"))
        .join(simulated.select("name"), "name", "left_semi")
        .groupBy("s2_file")
        .agg(F.min_by("name", "priority").alias("simulated_file"), F.min("priority").alias("rule"))
    )
    return s.join(found, "s2_file", "inner" if require_partner else "left")


def split_info(pairs: DataFrame, partner: str = "simulated_file") -> DataFrame:
    """How many pairs have a partner and how many do not."""
    n, k = F.count(F.lit(1)), F.count(partner)
    return pairs.agg(n.alias("total"), k.alias("with_partner"), (n - k).alias("without_partner"))


def join_labels(manifest: DataFrame, masks: DataFrame, key: str = "label_h5_index") -> DataFrame:
    return manifest.join(masks, key)


def coregister(a: DataFrame, b: DataFrame, bands: Sequence[str], keys: Sequence[str] = ("patch_index", "y", "x")) -> DataFrame:
    """Pixel-aligned views, columns prefixed a_ and b_."""
    left = a.select(*keys, *[F.col(c).alias(f"a_{c}") for c in bands])
    right = b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in bands])
    return left.join(right, list(keys))


def coregister_pivot(df: DataFrame, views: Sequence[str], keys: Sequence[str] = ("patch_index", "y", "x", "band")) -> DataFrame:
    """The same from one long table: a single shuffle instead of two."""
    picks = [F.first(F.when(F.col("view") == v, F.col("value")), ignorenulls=True).alias(v) for v in views]
    out = df.where(F.col("view").isin(list(views))).groupBy(*keys).agg(*picks)
    for v in views:
        out = out.where(F.col(v).isNotNull())
    return out


def unique_positions(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose ``keys`` no other row has. Rows of a key meet first and stay together: later groupings by ``keys`` and more move nothing."""
    rest = [c for c in df.columns if c not in keys]
    once = order.together(df, keys).groupBy(*keys).agg(*[F.first(c).alias(c) for c in rest], F.count(F.lit(1)).alias("_n"))
    return once.where("_n = 1").drop("_n")


def pair_embeddings(df: DataFrame, a: str, b: str) -> DataFrame:
    """Same item and layer in two domains; layers of different size are skipped."""
    side = lambda d, n: df.where(F.col("domain") == d).select("item_id", "layer", F.col("embedding").alias(n))
    return side(a, "emb_a").join(side(b, "emb_b"), ["item_id", "layer"]).where(F.size("emb_a") == F.size("emb_b"))


def attach_scene_metadata(scenes: DataFrame, meta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scenes with the metadata of their id prefix, and the scenes without any."""
    keyed = scenes.withColumn("scene_key", exprs.stem_id(F.col("name")))
    m = meta.withColumnRenamed("scene_id", "scene_key")
    return keyed.join(m, "scene_key", "left"), keyed.join(m.select("scene_key"), "scene_key", "left_anti")


def processing_status(inputs: DataFrame, outputs: DataFrame, prefix: str = "simulated_") -> DataFrame:
    """Every input with SUCCESS and its output path, or FAILED and NOT_FOUND, by number; names without a number come last."""
    i = inputs.withColumn("product_id", exprs.stem_id(F.col("name")).try_cast("bigint"))
    o = outputs.select(F.expr(f"substring(name, {len(prefix) + 1})").alias("_k"), F.col("path").alias("_p"))
    o = o.groupBy("_k").agg(F.min("_p").alias("_p"))
    j = i.join(o, i["name"] == o["_k"], "left")
    return j.select(
        "product_id", "name",
        F.when(F.col("_p").isNotNull(), "SUCCESS").otherwise("FAILED").alias("simulation_status"),
        F.coalesce("_p", F.lit("NOT_FOUND")).alias("simulation_path"),
    ).orderBy(F.col("product_id").asc_nulls_last(), "name")


def processing_totals(status: DataFrame) -> DataFrame:
    """How many inputs there are, and how many of them succeeded and failed."""
    ok = F.col("simulation_status") == "SUCCESS"
    return status.agg(F.count(F.lit(1)).alias("processed"), F.count_if(ok).alias("success"), F.count_if(~ok).alias("failed"))


def missing_outputs(expected: DataFrame, present: DataFrame, key: str = "name") -> DataFrame:
    """Expected names not present; an empty file counts as missing."""
    return expected.join(present.where(F.col("length") > 0).select(key), key, "left_anti")


def sweep_matrix(dimensions: Sequence[DataFrame], done: DataFrame | None = None) -> DataFrame:
    """Every combination of the (small, user-made) dimension tables, minus done ones.

    The combinations are the result asked for; each dimension is nested as an
    array of a single row and exploded, so no table is joined to another.
    """
    out = None
    for d in dimensions:
        packed = d.agg(F.collect_set(F.struct(*d.columns)).alias("_all")).select("_all").scalar()
        spark = d.sparkSession
        base = spark.range(1).select(F.lit(0).alias("_z")) if out is None else out
        out = base.withColumn("_d", F.explode(packed)).select(
            *[c for c in base.columns if c != "_z"], *[F.col(f"_d.{c}").alias(c) for c in d.columns]
        )
    return out if done is None else out.join(done, [c for c in done.columns if c in out.columns], "left_anti")


def split_leakage(df: DataFrame, group: str, split: str = "split", a: str = "train", b: str = "test") -> DataFrame:
    """How many groups of ``b`` also occur in ``a``, of how many; one aggregation."""
    g = df.where(F.col(split).isin(a, b)).groupBy(group).agg(
        F.max((F.col(split) == a).cast("int")).alias("_a"), F.max((F.col(split) == b).cast("int")).alias("_b")
    )
    return g.agg(
        F.coalesce(F.sum(F.col("_a") * F.col("_b")), F.lit(0)).cast("long").alias("shared"),
        F.coalesce(F.sum("_b"), F.lit(0)).cast("long").alias("total"),
    )


def pairwise_max_delta(vectors: DataFrame, group: Column, block: int = 32, rows_per_task: int = 4096) -> DataFrame:
    """For every two names and key group: largest absolute difference over shared keys of equal size, null without one.

    ``vectors`` has (name, key, values), a name and key once. Names are numbered and
    cut into blocks; two blocks meet in tasks by a hash of the key, where the
    differences of all their names are one array operation per key. A task returns a
    row per pair of names it compared, not per key. Any number of names goes this way.
    """
    keyed = vectors.withColumn("_g", group).where(F.col("_g").isNotNull() & F.col("values").isNotNull())
    names = order.ordinal(vectors.select("name").distinct(), "name", "_no")
    blocks = -(-names.count() // block) or 1
    names = stored(names.withColumn("_block", F.floor(F.col("_no") / block).cast("int")), "names")
    beside = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    meet = lambda df: df.withColumn("_other", beside).withColumn("_lo", F.least("_block", "_other")).withColumn("_hi", F.greatest("_block", "_other")).drop("_other")
    placed = meet(order.join_few(keyed, names, ["name"]))
    shards = max(1, 2 * block * keyed.select("key").distinct().count() // rows_per_task)
    placed = placed.withColumn("_shard", F.pmod(F.xxhash64("key"), F.lit(shards)))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi, found = pdf["_lo"].iat[0], pdf["_hi"].iat[0], {}
        for (g, _, _), rows in pdf.groupby(["_g", "key", pdf["values"].map(len)], sort=False):
            rows = rows.sort_values("_no")
            left, right = rows[rows["_block"] == lo], rows[rows["_block"] == hi]
            if len(left) and len(right) and len(left["values"].iat[0]):
                x, y = np.stack(left["values"].to_numpy()), np.stack(right["values"].to_numpy())
                for i, a in enumerate(left["_no"]):
                    for j, d in zip(right["_no"], np.abs(x[i] - y).max(axis=1)):
                        if a < j:
                            found[a, j, g] = max(found.get((a, j, g), 0.0), d) if d == d else d
        return pd.DataFrame([(*k, v) for k, v in found.items()], columns=["_a", "_b", "key_group", "d"])

    seen = (
        placed.select("_lo", "_hi", "_shard", "_block", "_no", "_g", "key", F.col("values").cast("array<double>").alias("values"))
        .groupBy("_lo", "_hi", "_shard").applyInPandas(compare, "_a long, _b long, key_group string, d double")
        .groupBy("_a", "_b", "key_group").agg(F.max("d").alias("max_delta"))
    )
    side = lambda n: meet(names).select("_lo", "_hi", "_block", F.col("name").alias(n), F.col("_no").alias(f"_{n}"))
    l, r = side("a").where(F.col("_block") == F.col("_lo")), side("b").where(F.col("_block") == F.col("_hi"))
    pairs = l.drop("_block").join(r.drop("_block"), ["_lo", "_hi"]).where(F.col("_a") < F.col("_b"))
    groups = sorted(row["_g"] for row in keyed.select("_g").distinct().collect())  # the labels that ``group`` gives
    pairs = pairs.select("a", "b", "_a", "_b", F.explode(F.array(*[F.lit(g) for g in groups]).cast("array<string>")).alias("key_group"))
    return pairs.join(seen, ["_a", "_b", "key_group"], "left").select("a", "b", "key_group", "max_delta")


def next_in_order(df: DataFrame, key: str, out: str = "next_key") -> DataFrame:
    """The following key by ascending order, the last followed by the first.

    Keys are unique. Within a range it is a ``lead``; the last key of a range
    takes the first key of the next filled range, a table of one row per range.
    """
    b = order.ranged(df, key)
    heads = b.groupBy("_bucket").agg(F.min(key).alias("_head"))
    hw = Window.partitionBy(F.lit(0))
    heads = heads.select("_bucket", F.coalesce(F.lead("_head").over(hw.orderBy("_bucket")), F.min("_head").over(hw)).alias("_after"))
    j = order.join_group_stats(b, heads, ["_bucket"])
    lead = F.lead(key).over(Window.partitionBy("_bucket").orderBy(key))
    return j.withColumn(out, F.coalesce(lead, "_after")).drop("_bucket", "_after")


def negative_control_pairs(df: DataFrame, key: str = "item_id", payload: str = "embedding") -> DataFrame:
    """Each item with the payload of the next one, as an unmatched control."""
    nxt = next_in_order(df.select(key, payload), key)
    other = df.select(F.col(key).alias("next_key"), F.col(payload).alias(f"next_{payload}"))
    return nxt.join(other, "next_key")


def baseline_join(rows: DataFrame, metric: str, baseline: str = "clean") -> DataFrame:
    """Every non-baseline row with the baseline value of the same init, training and seed."""
    k = ["init", "train_variant", "seed"]
    base = rows.where(F.col("variant") == baseline).where(F.col(metric).isNotNull()).select(*k, F.col(metric).alias("baseline"))
    return rows.where((F.col("variant") != baseline) & F.col(metric).isNotNull()).join(base, k)


# --- set operations ---------------------------------------------------------------
def stack_domains(parts: dict[str, DataFrame], label: str = "domain") -> DataFrame:
    out = None
    for name, df in parts.items():
        d = df.withColumn(label, F.lit(name))
        out = d if out is None else out.unionByName(d)
    return out


def union_distinct(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for d in parts[1:]:
        out = out.union(d)
    return out.distinct()


def common_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def missing_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def drop_bad_products(df: DataFrame, ids: Sequence[int], key: str = "product_id") -> DataFrame:
    """A literal list stays a pushed-down filter; rows without an id are kept."""
    return df.where(F.col(key).isNull() | ~F.col(key).isin(list(ids)))
