"""Linear probes between domains; training runs on the executors, all folds, layers and variants of a call in one fit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import order, select, vec
from ..session import cut_lineage, stored
from . import linear
from . import splits as sp

FOLDS = 5


def _scale(df: DataFrame, how: str) -> DataFrame:
    """none, pooled or per_domain z-scores; constant dimensions become 0."""
    if how == "none":
        return df
    by = [] if how == "pooled" else ["domain"]
    v = array_to_vector("embedding")
    m = df.groupBy(*by).agg(vector_to_array(Summarizer.mean(v)).alias("_m"), vector_to_array(Summarizer.variance(v)).alias("_v"), F.count(F.lit(1)).alias("_n"))
    j = order.join_group_stats(df, m, by) if by else df.withColumn("_s", m.select(F.struct("_m", "_v", "_n")).scalar()).select("*", "_s.*").drop("_s")
    pop = (F.col("_n") - 1) / F.col("_n")
    z = F.zip_with(
        F.zip_with("embedding", "_m", lambda x, mu: x - mu), "_v",
        lambda c, s2: F.when(s2 > 0, c / F.sqrt(s2 * pop)).otherwise(F.lit(0.0)),
    )
    return j.withColumn("embedding", z).drop("_m", "_v", "_n")


def _fold(seed) -> Column:
    """The item alone fixes the fold, so every fold holds both domains in equal shares."""
    return (F.conv(F.substring(order.hash_key(seed, F.col("item_id")), 1, 8), 16, 10).cast("long") % FOLDS).cast("int")


def _probe_table(a: DataFrame, b: DataFrame, standardize: str, permute: bool, seed) -> DataFrame:
    side = lambda d, n: d.select(F.col("item_id"), F.lit(n).alias("domain"), vec.as_double("embedding").alias("embedding"))
    z = side(a, "a").unionByName(side(b, "b"))
    if standardize == "per_domain":
        z = _scale(z, standardize)
    z = z.withColumn("label", (F.col("domain") == "b").cast("double"))
    if permute:
        z = z.withColumn("_key", F.concat_ws(":", "domain", F.col("item_id").cast("string")))
        z = sp.permute_labels(z, "_key", "label", seed).drop("label").withColumnRenamed("permuted", "label")
    z = z.select("item_id", F.col("domain").alias("source"), _fold(seed).alias("fold"), F.col("label").cast("double").alias("label"), F.col("embedding").alias("x"))
    return stored(z, "probe")  # read once per step


LOSS = {"logistic": "logistic", "svm": "squared_hinge"}


def out_of_fold(a: DataFrame, b: DataFrame, probe: str = "logistic", standardize: str = "pooled", permute: bool = False, seed=0) -> DataFrame:
    """Held-out prediction and decision score of every row."""
    z = _probe_table(a, b, standardize, permute, seed)
    problem = [linear.Problem("probe", {"a": None, "b": None})]
    fitted = linear.fit(z, problem, LOSS[probe], FOLDS, "pooled" if standardize == "pooled" else "none")
    p = linear.held_out(z, problem, fitted, ["item_id"])
    return p.select("item_id", F.col("source").alias("domain"), "fold", "label", (F.col("score") > 0).cast("double").alias("prediction"), "score")


def proxy_a_distance(a: DataFrame, b: DataFrame, probe: str = "logistic", standardize: str = "pooled", permute: bool = False, seed=0) -> DataFrame:
    """2(1 - 2 err) with the mean held-out error over folds; 0 cannot tell, 2 always can."""
    p = out_of_fold(a, b, probe, standardize, permute, seed)
    per = p.groupBy("fold").agg(F.avg((F.col("prediction") != F.col("label")).cast("double")).alias("err"))
    return per.agg(F.avg("err").alias("error")).select("error", (2.0 * (1.0 - 2.0 * F.col("error"))).alias("pad"))


def proxy_a_distances(rows: DataFrame, problems: Sequence[linear.Problem], probe: str = "logistic", standardize: str = "pooled") -> DataFrame:
    """(name, error, pad, gradient, steps) of many problems over one stored table (source, fold, label, x)."""
    fitted = linear.fit(rows, problems, LOSS[probe], FOLDS, standardize)
    wrong = ((F.col("score") > 0).cast("double") != F.col("label")).cast("double")
    per = linear.held_out(rows, problems, fitted).groupBy("name", "fold").agg(F.avg(wrong).alias("err"))
    pad = per.groupBy("name").agg(F.avg("err").alias("error")).withColumn("pad", 2.0 * (1.0 - 2.0 * F.col("error")))
    return pad.join(F.broadcast(linear.summary(rows, fitted)), "name")


def layer_distances(a: DataFrame, b: DataFrame, probe: str = "logistic", standardize: str = "pooled", seed=0) -> DataFrame:
    """(layer, error, pad, gradient, steps): all layers in one stacked fit. Both sides are (item_id, layer, embedding)."""
    side = lambda d, n: d.select(F.concat_ws(":", F.lit(n), "layer").alias("source"), _fold(seed).alias("fold"), F.lit(None).cast("double").alias("label"), vec.as_double("embedding").alias("x"), "layer")
    rows = stored(side(a, "a").unionByName(side(b, "b")), "probe")
    layers = [r.layer for r in rows.select("layer").distinct().orderBy("layer").collect()]  # a model's depth
    t = proxy_a_distances(rows, [linear.Problem(str(k), {f"a:{k}": 0.0, f"b:{k}": 1.0}) for k in layers], probe, standardize)
    return t.select(F.col("name").cast("int").alias("layer"), "error", "pad", "gradient", "steps")


def probe_scores(a: DataFrame, b: DataFrame, **kw) -> DataFrame:
    return out_of_fold(a, b, **kw).select("item_id", "domain", "score")


def _label_probe(train: DataFrame, features: str = "features", max_iter: int = 2000):
    """Multinomial logistic regression at C = 1, run to its optimum."""
    # a penalty of 1/2 |w|^2 on the summed loss is 1/rows on the mean loss
    reg = 1.0 / max(train.count(), 1)
    model = LogisticRegression(featuresCol=features, labelCol="label", regParam=reg, maxIter=max_iter, tol=1e-6, standardization=False).fit(train)
    if model.summary.totalIterations >= max_iter:
        raise RuntimeError(f"no optimum after {max_iter} steps")
    return model


def probe_transfer(src: DataFrame, tgt: DataFrame, labels: DataFrame, train_frac: float = 0.7, standardize: bool = True, seed=0) -> DataFrame:
    """Fit on source items, score source and target on the same held-out items.

    Scaling uses the source training rows only. Labels below 0 are left out.
    """
    one = lambda d, n: d.select("item_id", F.lit(n).alias("variant"), "embedding")
    t = transfer_table(one(src, "source").unionByName(one(tgt, "target")), labels, "source", train_frac, standardize, seed)
    hit = lambda n: F.max(F.when(F.col("variant") == n, F.col("accuracy")))
    return t.agg(hit("source").alias("same"), hit("target").alias("cross")).withColumn("retention", F.col("cross") / F.greatest("same", F.lit(1e-9)))


def transfer_table(df: DataFrame, labels: DataFrame, baseline: str, train_frac: float = 0.7, standardize: bool = True, seed=0) -> DataFrame:
    """(variant, accuracy): one probe fitted on the baseline's training items, all variants scored on the same held-out items."""
    ok = labels.where(F.col("label") >= 0).select("item_id", F.col("label").cast("double").alias("label"))
    ok = sp.random_split(ok, ["item_id"], seed, (train_frac,), ("train", "test"))
    z = cut_lineage(df.select("item_id", "variant", array_to_vector(vec.as_double("embedding")).alias("raw")).join(ok, "item_id"))
    train, col = z.where((F.col("variant") == baseline) & (F.col("split") == "train")), "raw"
    if standardize:
        scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True).fit(train)
        z, train, col = scaler.transform(z), scaler.transform(train), "features"
    hit = (F.col("prediction") == F.col("label")).cast("double")
    return _label_probe(train, col).transform(z.where(F.col("split") == "test")).groupBy("variant").agg(F.avg(hit).alias("accuracy"))


def factor_response(df: DataFrame, labels: DataFrame, variants: Sequence[str], baseline: str = "clean", seed=0) -> DataFrame:
    """Per degraded variant: cosine, PAD and its null, probe accuracy, retention, and cosine and PAD of every layer.

    ``df`` is (item_id, variant, layer, embedding). Everything but the layer columns is
    of the last layer. All separations - variants x layers x folds, and those under
    permuted labels - are one stacked fit; ``gradient`` is the largest left at any of a
    variant's optima. The label probe is fitted once, on the baseline.
    """
    names = [baseline, *variants]
    df = df.where(F.col("variant").isin(*names))
    side = F.when(F.col("variant") == baseline, "a").otherwise("b")
    items = df.select("item_id", side.alias("side")).distinct().withColumn("label", (F.col("side") == "b").cast("int"))
    null = sp.permute_labels(items.withColumn("_key", F.concat_ws(":", "side", F.col("item_id").cast("string"))), "_key", "label", seed)
    rows = df.withColumn("side", side).join(null.select("item_id", "side", F.col("permuted").cast("double").alias("label")), ["item_id", "side"])
    rows = stored(rows.select("item_id", "variant", "layer", F.concat_ws(":", "variant", "layer").alias("source"), _fold(seed).alias("fold"), "label", vec.as_double("embedding").alias("x")), "ladder")
    layers = sorted(r.layer for r in rows.select("layer").distinct().collect())
    last = layers[-1]
    shown = {(v, k): f"{v}:{k}" for v in variants for k in layers}
    problems = [linear.Problem(n, {f"{baseline}:{k}": 0.0, f"{v}:{k}": 1.0}) for (v, k), n in shown.items()]
    problems += [linear.Problem(f"{v}:null", {f"{baseline}:{last}": None, f"{v}:{last}": None}) for v in variants]
    pads = proxy_a_distances(rows, problems, "svm", "none").withColumn("variant", F.substring_index("name", ":", 1)).withColumn("layer", F.substring_index("name", ":", -1))
    depth = F.array_sort(F.collect_list(F.when(F.col("layer") != "null", F.struct(F.col("layer").cast("int").alias("layer"), "pad"))))
    pads = pads.groupBy("variant").agg(
        F.max(F.when(F.col("layer") == str(last), F.col("pad"))).alias("pad"), F.max(F.when(F.col("layer") == "null", F.col("pad"))).alias("pad_null"),
        F.transform(depth, lambda s: s["pad"]).alias("layer_pads"), F.max("gradient").alias("gradient"))

    clean = rows.where(F.col("variant") == baseline).select("item_id", "layer", F.col("x").alias("emb_a"))
    pairs = rows.where(F.col("variant") != baseline).select("item_id", "layer", "variant", F.col("x").alias("emb_b")).join(clean, ["item_id", "layer"])
    cosine = pairs.select("variant", "layer", vec.cosine(F.col("emb_a"), F.col("emb_b")).alias("c")).groupBy("variant", "layer").agg(F.avg("c").alias("m"), F.stddev_pop("c").alias("s"))
    at_last = lambda c: F.max(F.when(F.col("layer") == last, F.col(c)))
    cosine = cosine.groupBy("variant").agg(at_last("m").alias("cos_mean"), at_last("s").alias("cos_std"), F.transform(F.array_sort(F.collect_list(F.struct("layer", "m"))), lambda s: s["m"]).alias("layer_cosines"))

    scored = transfer_table(rows.where(F.col("layer") == last).select("item_id", "variant", F.col("x").alias("embedding")), labels, baseline, standardize=False, seed=seed)
    scored = cut_lineage(scored)
    own = scored.where(F.col("variant") == baseline).select("accuracy").scalar()
    kept = scored.where(F.col("variant") != baseline).select("variant", own.alias("probe_clean"), F.col("accuracy").alias("probe_degraded"), (F.col("accuracy") / F.greatest(own, F.lit(1e-9))).alias("retention"))
    return cosine.join(pads, "variant").join(kept, "variant", "left").select(
        "variant", "cos_mean", "cos_std", "pad", "pad_null", "probe_clean", "probe_degraded", "retention", "layer_cosines", "layer_pads", "gradient")


def pca_project(a: DataFrame, b: DataFrame, k: int = 2) -> DataFrame:
    """Both domains, each standardised on its own, in one shared k-dim projection."""
    side = lambda d, n: d.select("item_id", F.lit(n).alias("domain"), vec.as_double("embedding").alias("embedding"))
    z = _scale(side(a, "a").unionByName(side(b, "b")), "per_domain")
    z = cut_lineage(z.select("item_id", "domain", array_to_vector("embedding").alias("features")))
    model = PCA(k=k, inputCol="features", outputCol="pc").fit(z)
    return model.transform(z).select("item_id", "domain", vector_to_array("pc").alias("pc"))


def paired_link_median(projected: DataFrame) -> DataFrame:
    """Median distance between the two projections of an item."""
    a = projected.where("domain = 'a'").select("item_id", F.col("pc").alias("_a"))
    b = projected.where("domain = 'b'").select("item_id", F.col("pc").alias("_b"))
    d = a.join(b, "item_id").select(F.sqrt(vec.sq_dist(F.col("_a"), F.col("_b"))).alias("dist"))
    return select.grouped_percentiles(d, [], "dist", [0.5]).select(F.col("pct")[0].alias("link_median"))
