"""Probe results depend on solver and folds, so these have no SQL form; tests check their invariants."""

from __future__ import annotations

from pyspark.sql import functions as F

from ... import constants as C
from ...operators import bands as B
from ...operators import probes as Pr
from .. import adapters as A
from ..registry import query


def _sides(spark, sf):
    v = A.vectors(spark, sf)
    return v.select("item_id", F.col("a").alias("embedding")), v.select("item_id", F.col("b").alias("embedding"))


def _labels(spark, sf):
    return A.vectors(spark, sf).select("item_id", "label")


@query("proxy_a_distance")
def proxy_a_distance(spark, sf):
    """Pooled z-scores, logistic probe."""
    return Pr.proxy_a_distance(*_sides(spark, sf))


@query("proxy_a_distance_svm")
def proxy_a_distance_svm(spark, sf):
    """Raw vectors, linear SVM."""
    return Pr.proxy_a_distance(*_sides(spark, sf), probe="svm", standardize="none")


@query("proxy_a_distance_per_domain")
def proxy_a_distance_per_domain(spark, sf):
    """Every domain standardised on its own moments first."""
    return Pr.proxy_a_distance(*_sides(spark, sf), standardize="per_domain")


@query("proxy_a_distance_null")
def proxy_a_distance_null(spark, sf):
    """Domain labels permuted: the level that means nothing."""
    return Pr.proxy_a_distance(*_sides(spark, sf), permute=True)


@query("proxy_a_distance_per_layer")
def proxy_a_distance_per_layer(spark, sf):
    e = A.layer_embeddings(spark, sf)
    side = lambda d: e.where(F.col("domain") == d).select("item_id", "layer", "embedding")
    return Pr.layer_distances(side("a"), side("b"))


@query("probe_scores")
def probe_scores(spark, sf):
    return Pr.probe_scores(*_sides(spark, sf))


@query("probe_score_histogram")
def probe_score_histogram(spark, sf):
    s = Pr.probe_scores(*_sides(spark, sf)).withColumnRenamed("score", "value")
    return B.value_histogram(s, ["domain"], 30)


@query("probe_transfer")
def probe_transfer(spark, sf):
    return Pr.probe_transfer(*_sides(spark, sf), _labels(spark, sf))


def variants(spark, sf):
    """(item_id, variant, layer, embedding): the clean view and all sixteen rungs, each bent further from it by its level, in all layers."""
    bent = [F.struct(F.lit(n).alias("variant"), (F.lit(0.0) if n == "clean" else F.lit(0.2 * int(n[-1]))).alias("c"), F.lit(float(C.LADDER_FACTORS.index(n.split("_l")[0]) if n != "clean" else 0)).alias("f")) for n in C.ladder_order()]
    e = A.layer_embeddings(spark, sf).where("domain = 'a'").withColumn("rung", F.explode(F.array(*bent)))
    c, f = F.col("rung.c"), F.col("rung.f")
    bend = F.transform("embedding", lambda x, i: x * (1.0 - c) + c * F.sin(x * (40.0 + 10.0 * f) + i) * 0.12)
    return e.select("item_id", F.col("rung.variant").alias("variant"), "layer", bend.alias("embedding"))


@query("factor_response")
def factor_response(spark, sf):
    return Pr.factor_response(variants(spark, sf), _labels(spark, sf), C.ladder_order()[1:])


@query("pca_project")
def pca_project(spark, sf):
    return Pr.pca_project(*_sides(spark, sf))


@query("paired_link_median")
def paired_link_median(spark, sf):
    return Pr.paired_link_median(Pr.pca_project(*_sides(spark, sf)))
