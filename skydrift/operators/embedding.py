"""Embedding drift: paired vectors, and whole vector sets against each other."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import order, select, vec


def layer_metrics(pairs: DataFrame) -> DataFrame:
    """Cosine, MSE and MAE of every paired layer vector; rows stay rows."""
    a, b = vec.as_double("emb_a"), vec.as_double("emb_b")
    n = F.size("emb_a")
    keep = [c for c in pairs.columns if c not in ("emb_a", "emb_b")]
    return pairs.select(
        *keep,
        vec.cosine(a, b).alias("cosine"),
        (vec.sq_dist(a, b) / n).alias("mse"),
        (vec.abs_dist(a, b) / n).alias("mae"),
    )


def embedding_drift(pairs: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """Per item: the mean over layers and the values layer by layer.

    ``items`` lists items that must appear; one without a comparable layer gets
    zeros and empty arrays. A group is the layers of one item.
    """
    m = layer_metrics(pairs).groupBy("item_id").agg(
        F.avg("cosine").alias("cosine_similarity"), F.avg("mse").alias("mse_error"), F.avg("mae").alias("mae_error"),
        F.array_sort(F.collect_list(F.struct("layer", "cosine", "mse", "mae"))).alias("layers"),
    )
    if items is not None:
        m = items.select("item_id").distinct().join(m, "item_id", "left")
    z = F.lit(0.0)
    pick = lambda n: F.coalesce(F.transform("layers", lambda s: s[n]), F.array().cast("array<double>"))
    return m.select(
        "item_id",
        F.coalesce("cosine_similarity", z).alias("cosine_similarity"),
        F.coalesce("mse_error", z).alias("mse_error"),
        F.coalesce("mae_error", z).alias("mae_error"),
        pick("cosine").alias("layer_cosine_similarities"),
        pick("mse").alias("layer_mse_errors"),
        pick("mae").alias("layer_mae_errors"),
    )


def embedding_drift_summary(drift: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Run averages, and per layer position the average over items that have it."""
    run = drift.agg(
        F.count(F.lit(1)).alias("pairs_processed"),
        F.avg("cosine_similarity").alias("avg_cosine_similarity"),
        F.avg("mse_error").alias("avg_mse_error"),
        F.avg("mae_error").alias("avg_mae_error"),
    )
    per = drift.select(F.posexplode("layer_cosine_similarities").alias("layer", "cosine"))
    return run, per.groupBy("layer").agg(F.avg("cosine").alias("avg_cosine"), F.count(F.lit(1)).alias("items"))


def layer_cosine_curve(pairs: DataFrame, keys: Sequence[str] = ("pair", "layer")) -> DataFrame:
    """Mean, population std and median of the cosine per layer and domain pair."""
    m = layer_metrics(pairs)
    t = select.stats_with_percentiles(
        m, list(keys), "cosine",
        [F.avg("cosine").alias("mean"), F.stddev_pop("cosine").alias("std"), F.count("cosine").alias("n")],
        [0.5],
    )
    return t.select(*keys, "mean", "std", F.col("pct")[0].alias("median"), "n")


def pool_tokens(df: DataFrame, keys: Sequence[str], tokens: str = "tokens", out: str = "embedding") -> DataFrame:
    """Mean over the tokens of each row's token matrix, inside the row."""
    t = F.col(tokens).cast("array<array<double>>")
    summed = F.aggregate(
        F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), t[0], lambda s, x: F.zip_with(s, x, lambda p, q: p + q)
    )
    return df.select(*keys, F.when(F.size(t) > 0, F.transform(summed, lambda v: v / F.size(t))).alias(out))


def mean_vector(df: DataFrame, keys: Sequence[str], embedding: str = "embedding", out: str = "mean_vec") -> DataFrame:
    """Per-dimension mean with a mergeable JVM aggregate; vectors are not exploded."""
    return df.groupBy(*keys).agg(
        vector_to_array(Summarizer.mean(array_to_vector(vec.as_double(embedding)))).alias(out),
        F.count(F.lit(1)).alias("n"),
    )


# --- alignment inside a batch ------------------------------------------------------
def alignment_metrics(pairs: DataFrame, batch: Sequence[str] = ("batch",)) -> DataFrame:
    """cos_paired, cos_unpaired and their margin per batch.

    The mean over all unequal pairs needs no pairs: the sum over all pairs is
    the product of the two sums of unit vectors. A batch of one has 0 there.
    """
    k = list(batch)
    u = pairs.select(
        *k, vec.normalize(vec.as_double("emb_a")).alias("u"), vec.normalize(vec.as_double("emb_b")).alias("v")
    ).withColumn("_d", vec.dot(F.col("u"), F.col("v")))
    g = u.groupBy(*k).agg(
        F.count(F.lit(1)).alias("n"), F.sum("_d").alias("_paired"),
        vector_to_array(Summarizer.mean(array_to_vector("u"))).alias("_mu"),
        vector_to_array(Summarizer.mean(array_to_vector("v"))).alias("_mv"),
    )
    n = F.col("n")
    every = vec.dot(F.col("_mu"), F.col("_mv")) * n * n
    unpaired = F.when(n > 1, (every - F.col("_paired")) / (n * (n - 1))).otherwise(F.lit(0.0))
    return g.select(
        *k, "n", (F.col("_paired") / n).alias("cos_paired"), unpaired.alias("cos_unpaired"),
        (F.col("_paired") / n - unpaired).alias("align_margin"),
    )


def _tiles(df: DataFrame, batch: str, item: str, block: int) -> DataFrame:
    """Rows copied to every block pair (lo, hi) of their batch they take part in.

    A batch is cut into blocks of about ``block`` rows, so a group below holds
    at most two blocks, whatever the size of the batch.
    """
    n = df.groupBy(batch).agg(F.ceil(F.count(F.lit(1)) / F.lit(float(block))).cast("int").alias("_k"))
    d = df.join(n, batch).withColumn("_c", F.pmod(F.xxhash64(item), F.col("_k")).cast("int"))
    d = d.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    return d.withColumn("_lo", F.least("_c", "_o")).withColumn("_hi", F.greatest("_c", "_o"))


def _matrix(s: pd.Series) -> np.ndarray:
    return np.vstack(s.to_numpy()).astype("float64") if len(s) else np.zeros((0, 1))


def _sq_dists(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2.0 * (x @ y.T)
    return np.maximum(d, 0.0)


def retrieval_top1(pairs: DataFrame, batch: str = "batch", block: int = 1024) -> DataFrame:
    """Share of a-vectors whose most similar b-vector in the batch is their own.

    Blocks compare vectors with numpy and emit one best candidate per query and
    block; the best over blocks decides. Ties go to the lower item id.
    """
    u = pairs.select(
        F.col(batch).alias("batch"), "item_id",
        vec.normalize(vec.as_double("emb_a")).alias("u"), vec.normalize(vec.as_double("emb_b")).alias("v"),
    )
    best = (
        _tiles(u, "batch", "item_id", block).groupBy("batch", "_lo", "_hi")
        .applyInPandas(_best_in_tile, "batch long, item_id long, best_id long, sim double")
        .groupBy("batch", "item_id")
        .agg(F.max(F.struct("sim", (-F.col("best_id")).alias("neg"))).alias("_m"))
    )
    return best.groupBy("batch").agg(
        F.avg((-F.col("_m.neg") == F.col("item_id")).cast("double")).alias("retrieval_top1"), F.count(F.lit(1)).alias("n")
    ).withColumnRenamed("batch", batch)


def _best_in_tile(pdf: pd.DataFrame) -> pd.DataFrame:
    lo, hi = pdf["_lo"].iat[0], pdf["_hi"].iat[0]
    pdf = pdf.sort_values("item_id", kind="stable")
    p, q = pdf[pdf["_c"] == lo], pdf[pdf["_c"] == hi]
    sides = [(p, q)] if lo == hi else [(p, q), (q, p)]
    out = []
    for left, right in sides:
        if len(left) == 0 or len(right) == 0:
            continue
        sims = _matrix(left["u"]) @ _matrix(right["v"]).T
        j = sims.argmax(axis=1)
        out.append(pd.DataFrame({
            "batch": left["batch"].to_numpy(), "item_id": left["item_id"].to_numpy(),
            "best_id": right["item_id"].to_numpy()[j], "sim": sims[np.arange(len(left)), j],
        }))
    return pd.concat(out) if out else pd.DataFrame({"batch": [], "item_id": [], "best_id": [], "sim": []})


def similarity_profile(pairs: DataFrame, batch: str = "batch") -> DataFrame:
    """The batch similarity matrix reduced to one row per a-item.

    Own similarity, mean over the whole batch, and mean over the others; the row
    means come from the batch's mean vector, not from its pairs.
    """
    u = pairs.select(
        F.col(batch), "item_id",
        vec.normalize(vec.as_double("emb_a")).alias("u"), vec.normalize(vec.as_double("emb_b")).alias("v"),
    )
    m = u.groupBy(batch).agg(vector_to_array(Summarizer.mean(array_to_vector("v"))).alias("_mv"), F.count(F.lit(1)).alias("n"))
    j = u.join(m, batch)
    own, mean_all = vec.dot(F.col("u"), F.col("v")), vec.dot(F.col("u"), F.col("_mv"))
    other = F.when(F.col("n") > 1, (mean_all * F.col("n") - own) / (F.col("n") - 1)).otherwise(F.lit(0.0))
    return j.select(batch, "item_id", "n", own.alias("own_sim"), mean_all.alias("mean_sim"), other.alias("mean_other_sim"))


def matched_gap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cosine with the item's own counterpart minus that with the next item's."""
    from .pairing import next_in_order

    nxt = next_in_order(b.select("item_id"), "item_id")
    emb_b = b.select("item_id", F.col("embedding").alias("emb_b"))
    wrong = nxt.join(b.select(F.col("item_id").alias("next_key"), F.col("embedding").alias("emb_next")), "next_key").drop("next_key")
    j = a.select("item_id", F.col("embedding").alias("emb_a")).join(emb_b, "item_id").join(wrong, "item_id")
    ea = vec.as_double("emb_a")
    m, n = vec.cosine(ea, vec.as_double("emb_b")), vec.cosine(ea, vec.as_double("emb_next"))
    return j.select("item_id", m.alias("matched"), n.alias("unmatched")).withColumn("gap", F.col("matched") - F.col("unmatched"))


# --- distance between two sets -------------------------------------------------------
def _kernel_sums(df: DataFrame, block: int, gammas: Sequence[float] | None = None) -> DataFrame:
    """Per batch: kernel sums within a, within b and across, over ordered pairs.

    ``df`` has (batch, item, side, embedding) and, without fixed ``gammas``, an
    array column ``gammas`` per batch. Only sums leave a task.
    """
    fixed = None if gammas is None else list(gammas)

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = pdf["_lo"].iat[0], pdf["_hi"].iat[0]
        gs = fixed if fixed is not None else list(pdf["gammas"].iat[0])
        p, q = pdf[pdf["_c"] == lo], pdf[pdf["_c"] == hi]
        sums = np.zeros(3)
        if len(p) and len(q):
            d2 = _sq_dists(_matrix(p["embedding"]), _matrix(q["embedding"]))
            if lo == hi:
                np.fill_diagonal(d2, 0.0)
            k = np.zeros_like(d2)
            for g in gs:
                k += np.exp(-d2 * g)
            pa, qa = (p["side"] == "a").to_numpy(), (q["side"] == "a").to_numpy()
            twice = 1.0 if lo == hi else 2.0
            sums[0] = twice * k[np.ix_(pa, qa)].sum()
            sums[1] = twice * k[np.ix_(~pa, ~qa)].sum()
            cross = k[np.ix_(pa, ~qa)].sum()
            sums[2] = cross if lo == hi else cross + k[np.ix_(~pa, qa)].sum()
        return pd.DataFrame({"batch": [pdf["batch"].iat[0]], "saa": [sums[0]], "sbb": [sums[1]], "sab": [sums[2]]})

    return (
        _tiles(df, "batch", "item", block).groupBy("batch", "_lo", "_hi")
        .applyInPandas(tile, "batch long, saa double, sbb double, sab double")
        .groupBy("batch").agg(F.sum("saa").alias("saa"), F.sum("sbb").alias("sbb"), F.sum("sab").alias("sab"))
    )


def two_sample(a: DataFrame, b: DataFrame, batch: str = "batch") -> DataFrame:
    """Pooled table (batch, item, side, embedding) of two sets."""
    side = lambda d, s: d.select(
        F.col(batch).cast("long").alias("batch"), F.concat(F.lit(s), F.col("item_id").cast("string")).alias("item"),
        F.lit(s).alias("side"), vec.as_double("embedding").alias("embedding"),
    )
    return side(a, "a").unionByName(side(b, "b"))


def _sizes(z: DataFrame) -> DataFrame:
    return z.groupBy("batch").agg(
        F.count_if(F.col("side") == "a").alias("n"), F.count_if(F.col("side") == "b").alias("m")
    )


def mmd2_biased(z: DataFrame, sigmas: Sequence[float] = tuple(C.MMD_SIGMAS), block: int = 1024) -> DataFrame:
    """Multi-kernel RBF MMD^2 per batch, floored at 0; 0 when a side has under two rows."""
    sums = _kernel_sums(z, block, [1.0 / (2.0 * s * s) for s in sigmas])
    n, m, k = F.col("n"), F.col("m"), float(len(sigmas))
    est = (F.col("saa") / (n * n) + F.col("sbb") / (m * m) - 2.0 * F.col("sab") / (n * m)) / k
    return sums.join(_sizes(z), "batch").select(
        "batch", "n", "m", F.when((n < 2) | (m < 2), F.lit(0.0)).otherwise(F.greatest(est, F.lit(0.0))).alias("mmd2")
    )


def mmd2_unbiased(z: DataFrame, bandwidth: float | None = None, block: int = 1024) -> DataFrame:
    """Unbiased MMD^2 per batch, kernel exp(-d2/bandwidth), diagonals left out.

    Without a bandwidth it is the lower median of the pooled off-diagonal
    squared distances of the batch.
    """
    if bandwidth is None:
        bw = median_sq_distance(z, block)
        z = z.join(bw.select("batch", F.array(1.0 / F.greatest("bandwidth", F.lit(1e-12))).alias("gammas")), "batch")
        sums = _kernel_sums(z, block).join(bw, "batch")
    else:
        sums = _kernel_sums(z, block, [1.0 / bandwidth]).withColumn("bandwidth", F.lit(float(bandwidth)))
    n, m = F.col("n"), F.col("m")
    est = (F.col("saa") - n) / (n * (n - 1)) + (F.col("sbb") - m) / (m * (m - 1)) - 2.0 * F.col("sab") / (n * m)
    return sums.join(_sizes(z), "batch").select("batch", "n", "m", "bandwidth", est.alias("mmd2"))


def median_sq_distance(z: DataFrame, block: int = 1024, bins: int = 4096, rounds: int = 5) -> DataFrame:
    """Lower median of the squared distances between unequal rows, per batch.

    A batch that fits one block takes it directly. Larger ones narrow an interval
    by counting distances per bin, round after round, over all block pairs; only
    bin counts leave a task, and the last round returns a distance that occurs.
    """
    largest = z.groupBy("batch").count().agg(F.max("count")).first()[0] or 0
    if largest <= block:

        def whole(pdf: pd.DataFrame) -> pd.DataFrame:
            x = _matrix(pdf["embedding"])
            d = _sq_dists(x, x)[np.triu_indices(len(x), 1)]
            mid = np.nan if len(d) == 0 else np.partition(d, (len(d) - 1) // 2)[(len(d) - 1) // 2]
            return pd.DataFrame({"batch": [pdf["batch"].iat[0]], "bandwidth": [mid]})

        return z.groupBy("batch").applyInPandas(whole, "batch long, bandwidth double")

    tiles = _tiles(z.select("batch", "item", "embedding"), "batch", "item", block)
    # squared distances lie in [0, (2 * longest vector)^2]
    span = z.groupBy("batch").agg(
        F.count(F.lit(1)).alias("_n"), (4.0 * F.max(F.pow(vec.l2(F.col("embedding")), 2.0)) * 1.0001 + 1e-12).alias("hi")
    )
    state = span.select(
        "batch", F.lit(0.0).alias("lo"), "hi",
        F.floor((F.col("_n") * (F.col("_n") - 1) / 2 - 1) / 2).cast("long").alias("rank"),
    )
    for i in range(rounds):
        last = i == rounds - 1

        def count(pdf: pd.DataFrame) -> pd.DataFrame:
            a, b = pdf["_lo"].iat[0], pdf["_hi"].iat[0]
            lo, hi = pdf["lo"].iat[0], pdf["hi"].iat[0]
            p, q = pdf[pdf["_c"] == a], pdf[pdf["_c"] == b]
            d = np.zeros(0)
            if len(p) and len(q):
                d2 = _sq_dists(_matrix(p["embedding"]), _matrix(q["embedding"]))
                d = d2[np.triu_indices(len(p), 1)] if a == b else d2.ravel()
            d = d[(d >= lo) & (d < hi)]
            which = np.minimum(((d - lo) / (hi - lo) * bins).astype("int64"), bins - 1)
            found, first, n = np.unique(which, return_index=True, return_counts=True)
            low = np.full(len(found), np.inf)
            np.minimum.at(low, np.searchsorted(found, which), d)
            return pd.DataFrame({"batch": pdf["batch"].iat[0], "bin": found, "n": n, "low": low})

        c = (
            tiles.join(state, "batch").groupBy("batch", "_lo", "_hi")
            .applyInPandas(count, "batch long, bin long, n long, low double")
            .groupBy("batch", "bin").agg(F.sum("n").alias("n"), F.min("low").alias("low"))
        )
        c = order.prefix_sum(c, ["batch"], "bin", "n", "_upto")
        hit = c.join(state, "batch").where((F.col("rank") >= F.col("_upto") - F.col("n")) & (F.col("rank") < F.col("_upto")))
        if last:
            return hit.select("batch", F.col("low").alias("bandwidth"))
        width = (F.col("hi") - F.col("lo")) / bins
        state = hit.select(
            "batch", (F.col("lo") + F.col("bin") * width).alias("lo"), (F.col("lo") + (F.col("bin") + 1) * width).alias("hi"),
            (F.col("rank") - (F.col("_upto") - F.col("n"))).alias("rank"),
        )
        from ..session import cut_lineage

        state = cut_lineage(state)


def mean_sq_distance(z: DataFrame) -> DataFrame:
    """Mean squared distance between unequal rows, from sums alone (no pairs)."""
    g = z.groupBy("batch").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.pow(vec.l2(F.col("embedding")), 2.0)).alias("_sq"),
        vector_to_array(Summarizer.mean(array_to_vector("embedding"))).alias("_mu"),
    )
    n = F.col("_n")
    both = 2.0 * n * F.col("_sq") - 2.0 * n * n * F.pow(vec.l2(F.col("_mu")), 2.0)
    return g.select("batch", (both / (n * (n - 1))).alias("bandwidth"))


def mmd_mean_bandwidth(z: DataFrame, mul: float = 2.0, num: int = 5, block: int = 1024) -> DataFrame:
    """Summed kernels over a geometric ladder around the mean squared distance.

    Both sides of a batch have equal size; diagonals count.
    """
    bw = mean_sq_distance(z)
    ladder = F.array(*[1.0 / (F.col("bandwidth") / (mul ** (num // 2)) * (mul**i)) for i in range(num)])
    sums = _kernel_sums(z.join(bw.select("batch", ladder.alias("gammas")), "batch"), block)
    n = F.col("n")
    est = (F.col("saa") + F.col("sbb") - 2.0 * F.col("sab")) / (n * n)
    return sums.join(_sizes(z), "batch").join(bw, "batch").select("batch", "n", "bandwidth", est.alias("mmd"))


# --- class centroids --------------------------------------------------------------------
def class_centroids(df: DataFrame, label: str = "label", embedding: str = "embedding") -> DataFrame:
    """Unit-length class means over the rows of all domains."""
    ok = df.where(F.col(label) >= 0)
    return mean_vector(ok, [label], embedding, "_m").select(F.col(label), vec.normalize(F.col("_m")).alias("centroid"), "n")


def nearest_centroid(df: DataFrame, centroids: DataFrame, label: str = "label", embedding: str = "embedding", tau: float = 0.1) -> DataFrame:
    """Class of the most similar centroid and its softmax(cos/tau) probability.

    Centroids (one per class) travel as a single array value.
    """
    table = centroids.agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("c"), F.col("centroid").alias("v")))).alias("t"))
    d = df.withColumn("_u", vec.normalize(vec.as_double(embedding))).withColumn("_t", table.select("t").scalar())
    d = d.withColumn("_s", F.transform("_t", lambda s: vec.dot(F.col("_u"), s["v"])))
    d = d.withColumn("_i", vec.argmax(F.col("_s")))
    p = vec.softmax(F.col("_s"), tau)
    return (
        d.withColumn("predicted_class", F.col("_t")[F.col("_i")]["c"])
        .withColumn("cosine", F.col("_s")[F.col("_i")]).withColumn("probability", p[F.col("_i")])
        .drop("_u", "_t", "_s", "_i")
    )
