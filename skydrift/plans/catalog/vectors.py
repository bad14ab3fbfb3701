from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import vec
from ...operators import distance as D
from ...operators import embedding as E
from ...operators import pairing as P
from ...operators import prediction as Q
from .. import adapters as A
from ..adapters import r, rnd, with_ctes
from ..registry import query

_ITEM = "SELECT item_id, avg(cosine) AS cosine_similarity, avg(mse) AS mse_error, avg(mae) AS mae_error, list(cosine ORDER BY layer) AS cs FROM layer_metrics GROUP BY item_id"


@query("embedding_drift", with_ctes("layer_metrics", f"""
    SELECT item_id, {r('cosine_similarity')} AS cosine_similarity, {r('mse_error', 9)} AS mse_error, {r('mae_error')} AS mae_error,
           {r('cs[1]')} AS layer0_cosine, {r('cs[4]')} AS layer3_cosine FROM i""", {"i": _ITEM}))
def embedding_drift(spark, sf):
    d = E.embedding_drift(A.paired_layers(spark, sf))
    c = F.col("layer_cosine_similarities")
    return d.select("item_id", rnd("cosine_similarity").alias("cosine_similarity"), rnd("mse_error", 9).alias("mse_error"), rnd("mae_error").alias("mae_error"),
                    rnd(c[0]).alias("layer0_cosine"), rnd(c[3]).alias("layer3_cosine"))


@query("embedding_drift_summary", with_ctes("layer_metrics", f"""
    SELECT count(*) AS pairs_processed, {r('avg(cosine_similarity)')} AS avg_cosine_similarity, {r('avg(mse_error)', 9)} AS avg_mse_error, {r('avg(mae_error)')} AS avg_mae_error FROM i""", {"i": _ITEM}))
def embedding_drift_summary(spark, sf):
    s = E.embedding_drift_summary(E.embedding_drift(A.paired_layers(spark, sf)))[0]
    return s.select("pairs_processed", rnd("avg_cosine_similarity").alias("avg_cosine_similarity"), rnd("avg_mse_error", 9).alias("avg_mse_error"), rnd("avg_mae_error").alias("avg_mae_error"))


@query("per_layer_average", with_ctes("layer_metrics", f"SELECT layer, {r('avg(cosine)')} AS avg_cosine, count(*) AS items FROM layer_metrics GROUP BY layer"))
def per_layer_average(spark, sf):
    return A.rounded(E.embedding_drift_summary(E.embedding_drift(A.paired_layers(spark, sf)))[1])


@query("layer_cosine_curve", with_ctes("layer_metrics", f"""
    SELECT 'a vs b' AS pair, layer, {r('avg(cosine)')} AS mean, {r('stddev_pop(cosine)')} AS std, {r('quantile_cont(cosine, 0.5)')} AS median, count(*) AS n FROM layer_metrics GROUP BY layer"""))
def layer_cosine_curve(spark, sf):
    p = A.paired_layers(spark, sf).withColumn("pair", F.lit("a vs b"))
    return A.rounded(E.layer_cosine_curve(p))


@query("alignment_metrics", with_ctes("vectors", f"""
    SELECT batch, n, {r('p')} AS cos_paired, {r('u')} AS cos_unpaired, {r('p - u')} AS align_margin FROM (
        SELECT x.batch, count(*) FILTER (WHERE x.item_id = y.item_id) AS n, avg(CASE WHEN x.item_id = y.item_id THEN list_cosine_similarity(x.a, y.b) END) AS p,
               coalesce(avg(CASE WHEN x.item_id <> y.item_id THEN list_cosine_similarity(x.a, y.b) END), 0) AS u FROM vectors x JOIN vectors y ON x.batch = y.batch GROUP BY x.batch)"""))
def alignment_metrics(spark, sf):
    return A.rounded(E.alignment_metrics(A.paired_vectors(spark, sf)))


@query("retrieval_top1", with_ctes("vectors", f"""
    SELECT batch, {r('avg((best = item_id)::INT)')} AS retrieval_top1, count(*) AS n FROM (
        SELECT x.batch, x.item_id, arg_max(y.item_id, list_cosine_similarity(x.a, y.b)) AS best FROM vectors x JOIN vectors y ON x.batch = y.batch GROUP BY x.batch, x.item_id) GROUP BY batch"""))
def retrieval_top1(spark, sf):
    return A.rounded(E.retrieval_top1(A.paired_vectors(spark, sf)))


@query("matched_gap", with_ctes("vectors", f"""
    SELECT item_id, {r('list_cosine_similarity(v.a, v.b)')} AS matched, {r('list_cosine_similarity(v.a, w.b)')} AS unmatched, {r('list_cosine_similarity(v.a, v.b) - list_cosine_similarity(v.a, w.b)')} AS gap
    FROM (SELECT item_id, a, b, coalesce(lead(item_id) OVER (ORDER BY item_id), min(item_id) OVER ()) AS nk FROM vectors) v JOIN (SELECT item_id AS nk, b FROM vectors) w USING (nk)"""))
def matched_gap(spark, sf):
    v = A.vectors(spark, sf)
    return A.rounded(E.matched_gap(v.select("item_id", F.col("a").alias("embedding")), v.select("item_id", F.col("b").alias("embedding"))))


def _two(spark, sf):
    v = A.vectors(spark, sf)
    return E.two_sample(v.select("item_id", "batch", F.col("a").alias("embedding")), v.select("item_id", "batch", F.col("b").alias("embedding")))


_Z = "SELECT batch, item_id, 'a' AS side, a AS v FROM vectors UNION ALL SELECT batch, item_id, 'b', b FROM vectors"
_D2 = "SELECT x.batch, x.side AS s, y.side AS t, x.item_id = y.item_id AND x.side = y.side AS same, list_distance(x.v, y.v) ** 2 AS d2 FROM z x JOIN z y ON x.batch = y.batch"


def _kernel_terms(kernel: str) -> str:
    return f"SELECT batch, sum(k) FILTER (WHERE s = 'a' AND t = 'a') AS saa, sum(k) FILTER (WHERE s = 'b' AND t = 'b') AS sbb, sum(k) FILTER (WHERE s = 'a' AND t = 'b') AS sab FROM (SELECT *, {kernel} AS k FROM d) GROUP BY batch"


_NM = "SELECT batch, count(*) AS n FROM vectors GROUP BY batch"
_MULTI = "(" + " + ".join(f"exp(-d2 / {2.0 * s * s}::DOUBLE)" for s in (1.0, 2.0, 4.0, 8.0, 16.0)) + ") / 5"


@query("mmd2_biased", with_ctes("vectors", f"""
    SELECT batch, n, n AS m, CASE WHEN n < 2 THEN 0.0 ELSE {r('greatest(saa / (n * n) + sbb / (n * n) - 2 * sab / (n * n), 0)', 8)} END AS mmd2 FROM k JOIN nm USING (batch)""",
    {"z": _Z, "d": _D2, "k": _kernel_terms(_MULTI), "nm": _NM}))
def mmd2_biased(spark, sf):
    return A.rounded(E.mmd2_biased(_two(spark, sf)), 8)


@query("mmd2_unbiased", with_ctes("vectors", f"""
    SELECT batch, n, n AS m, {r('bw', 8)} AS bandwidth, {r('(saa - n) / (n * (n - 1)) + (sbb - n) / (n * (n - 1)) - 2 * sab / (n * n)', 8)} AS mmd2 FROM k JOIN nm USING (batch) JOIN w USING (batch)""",
    {"z": _Z, "d0": _D2, "w": "SELECT batch, quantile_disc(d2, 0.5) AS bw FROM d0 WHERE NOT same GROUP BY batch", "d": "SELECT * FROM d0 JOIN w USING (batch)",
     "k": _kernel_terms("exp(-d2 / bw)"), "nm": _NM}))
def mmd2_unbiased(spark, sf):
    return A.rounded(E.mmd2_unbiased(_two(spark, sf)), 8)


@query("mmd_mean_bandwidth", with_ctes("vectors", f"""
    SELECT batch, n, {r('bw', 8)} AS bandwidth, {r('(saa + sbb - 2 * sab) / (n * n)', 8)} AS mmd FROM k JOIN nm USING (batch) JOIN w USING (batch)""",
    {"z": _Z, "d0": _D2, "w": "SELECT batch, avg(d2) AS bw FROM d0 WHERE NOT same GROUP BY batch", "d": "SELECT * FROM d0 JOIN w USING (batch)",
     "k": _kernel_terms(" + ".join(f"exp(-d2 / (bw / 4 * {2 ** i}))" for i in range(5))), "nm": _NM}))
def mmd_mean_bandwidth(spark, sf):
    return A.rounded(E.mmd_mean_bandwidth(_two(spark, sf)), 8)


def _whole_sql(features: int, bandwidth: str) -> dict[str, str]:
    """The same frequencies, drawn from the same digests, and beside them the exact statistic over all pairs."""
    turn = f"sqrt(2 / {bandwidth})"
    return {
        "z": "SELECT 0::BIGINT AS batch, item_id, side, side || item_id AS item, v FROM (SELECT item_id, 'a' AS side, a AS v FROM vectors UNION ALL SELECT item_id, 'b', b FROM vectors)",
        "dealt": "SELECT *, ('0x' || md5('7:' || item)[1:13])::BIGINT % greatest(1, ceil((SELECT count(*) FROM z) * ((SELECT count(*) FROM z) - 1) / 400000.0::DOUBLE))::BIGINT AS bucket FROM z",
        "median": "SELECT quantile_disc(list_distance(x.v, y.v) ** 2, 0.5) AS bw FROM dealt x JOIN dealt y ON x.bucket = y.bucket AND x.item < y.item",
        "w": f"""SELECT f, list(sqrt(-2 * ln((('0x' || h[1:13])::BIGINT + 1) / 4503599627370496.0::DOUBLE)) * cos(2 * pi() * (('0x' || h[14:26])::BIGINT / 4503599627370496.0::DOUBLE)) ORDER BY j) AS w
            FROM (SELECT f, j, md5('7:' || f || ':' || j) AS h FROM (SELECT unnest(range({features})) AS f), (SELECT unnest(range(64)) AS j)) GROUP BY f""",
        "sums": f"SELECT f, side, sum(cos({turn} * list_dot_product(v, w))) AS c, sum(sin({turn} * list_dot_product(v, w))) AS s FROM z, w, median GROUP BY f, side",
        "e": """SELECT (a.c * a.c + a.s * a.s - n) / (n * (n - 1)) + (b.c * b.c + b.s * b.s - n) / (n * (n - 1)) - 2 * (a.c * b.c + a.s * b.s) / (n * n) AS e
            FROM sums a JOIN sums b ON a.f = b.f AND a.side = 'a' AND b.side = 'b', (SELECT count(*)::DOUBLE AS n FROM vectors)""",
        "estimate": f"SELECT avg(e) AS mmd2, stddev_samp(e) / sqrt({features}) AS err FROM e",
        "exact": f"""SELECT (sum(k) FILTER (s = 'a' AND t = 'a') - any_value(n)) / any_value(n * (n - 1)) + (sum(k) FILTER (s = 'b' AND t = 'b') - any_value(n)) / any_value(n * (n - 1)) - 2 * sum(k) FILTER (s = 'a' AND t = 'b') / any_value(n * n) AS mmd2
            FROM (SELECT x.side AS s, y.side AS t, exp(-(list_distance(x.v, y.v) ** 2) / {bandwidth}) AS k FROM z x, z y, median), (SELECT count(*)::DOUBLE AS n FROM vectors)""",
    }


def _whole(spark, sf):
    return _two(spark, sf).withColumn("batch", F.lit(0).cast("long"))


@query("mmd2_whole_set", with_ctes("vectors", f"""
    SELECT 0::BIGINT AS batch, (SELECT count(*) FROM vectors) AS n, (SELECT count(*) FROM vectors) AS m, {r('bw', 8)} AS bandwidth, {r('estimate.mmd2', 8)} AS mmd2, {r('err', 8)} AS std_error,
           abs(exact.mmd2 - estimate.mmd2) <= 4 * err AS exact_within FROM median, estimate, exact""", _whole_sql(4096, "bw")))
def mmd2_whole_set(spark, sf):
    """The last column is the promise; the SQL computes the exact value over all pairs and tells whether it holds."""
    return A.rounded(D.mmd2_whole(_whole(spark, sf), 64), 8).withColumn("exact_within", F.lit(True))


@query("mmd2_random_features", with_ctes("vectors", f"""
    SELECT 0::BIGINT AS batch, {r('estimate.mmd2', 8)} AS mmd2, abs(exact.mmd2 - estimate.mmd2) <= 4 * err AS exact_within FROM estimate, exact""", _whole_sql(512, "2.0::DOUBLE")))
def mmd2_random_features(spark, sf):
    """The same with a given bandwidth and fewer frequencies."""
    return A.rounded(D.mmd2_whole(_whole(spark, sf), 64, 2.0, 512).select("batch", "mmd2"), 8).withColumn("exact_within", F.lit(True))


def _views(spark, sf):
    z = A.logits(spark, sf)
    p = z.select("item_id", F.lit("a").alias("view"), vec.softmax(F.col("za")).alias("probs")).unionByName(
        z.select("item_id", F.lit("b").alias("view"), vec.softmax(F.col("zb")).alias("probs"))
    )
    return Q.predictions_from_probs(p)


def class_pairs(spark, sf):
    """Both predictions of an item side by side, straight from its row."""
    from ...functions import exprs

    z = A.logits(spark, sf).select("item_id", *[exprs.top_k_classes(vec.softmax(F.col(f"z{t}")), 3).alias(f"{t}_topk") for t in "ab"])
    return z.select("item_id", *[c for t in "ab" for c in (F.col(f"{t}_topk"), F.col(f"{t}_topk")[0]["class"].alias(f"{t}_predicted_class"), F.col(f"{t}_topk")[0]["p"].alias(f"{t}_probability"))])


@query("pair_predictions", with_ctes("class_pairs", "SELECT item_id, a_predicted_class, b_predicted_class FROM class_pairs"))
def pair_predictions(spark, sf):
    return Q.pair_predictions(_views(spark, sf), "a", "b").select("item_id", "a_predicted_class", "b_predicted_class")


@query("class_drift", with_ctes("class_pairs", f"""
    SELECT item_id, a_predicted_class, b_predicted_class, class_flip, {r('probability_change')} AS probability_change, {r('top3_consistency')} AS top3_consistency FROM class_pairs"""))
def class_drift(spark, sf):
    return A.rounded(Q.class_drift(class_pairs(spark, sf)))


@query("class_flip_summary", with_ctes("class_pairs", f"""
    SELECT count(*) AS total_pairs, count(*) FILTER (WHERE class_flip) AS class_flips_count, {r('avg(class_flip::INT)')} AS class_flip_rate, {r('avg(probability_change)')} AS avg_probability_change,
           {r('max(abs(probability_change))')} AS max_probability_change, {r('avg(top3_consistency)')} AS avg_top3_consistency FROM class_pairs"""))
def class_flip_summary(spark, sf):
    return A.rounded(Q.class_flip_summary(Q.class_drift(class_pairs(spark, sf))))


@query("flipped_rows", with_ctes("class_pairs", "SELECT item_id, a_predicted_class AS from_class, b_predicted_class AS to_class FROM class_pairs WHERE class_flip"))
def flipped_rows(spark, sf):
    return Q.flipped_rows(Q.class_drift(class_pairs(spark, sf)))


def _logp(z: str, t: str) -> str:
    top = f"list_max({z}) / {t}"
    return f"[x / {t} - {top} - ln(list_sum([exp(w / {t} - {top}) FOR w IN {z}])) FOR x IN {z}]"


_KL = {"lp": f"SELECT *, {_logp('za', '4.0::DOUBLE')} AS ls, {_logp('zb', '4.0::DOUBLE')} AS lt FROM logits",
       "kl": "SELECT *, list_sum([exp(lt[i]) * (lt[i] - ls[i]) FOR i IN range(1, 11)]) * 16.0 AS l FROM lp"}


@query("prediction_divergence", with_ctes("logits", f"SELECT count(*) AS n, {r('avg(l)')} AS divergence FROM kl WHERE label <> -1", _KL))
def prediction_divergence(spark, sf):
    return A.rounded(Q.prediction_divergence(A.logits(spark, sf), "za", "zb", 4.0, valid=F.col("label") != -1))


@query("prediction_divergence_sum", with_ctes("logits", f"SELECT count(*) AS n, {r('sum(l)', 4)} AS divergence FROM kl", _KL))
def prediction_divergence_sum(spark, sf):
    return A.rounded(Q.prediction_divergence(A.logits(spark, sf), "za", "zb", 4.0, reduce="sum"), 4)


@query("logit_mse", with_ctes("logits", f"SELECT count(*) AS n, {r('avg(list_distance(za, zb) ** 2 / 10)')} AS divergence FROM logits"))
def logit_mse(spark, sf):
    return A.rounded(Q.prediction_divergence(A.logits(spark, sf), "za", "zb", mode="mse"))


_LP = {"lp": f"SELECT label, ({_logp('za', '1.0::DOUBLE')})[label + 1] AS lp FROM logits WHERE label <> -1"}
_ALPHA = [0.5 + 0.1 * i for i in range(10)]


@query("cross_entropy", with_ctes("logits", f"SELECT count(*) AS n, {r('avg(-lp)')} AS loss FROM lp", _LP))
def cross_entropy(spark, sf):
    return A.rounded(Q.log_loss(A.logits(spark, sf), "za", "label"))


@query("focal_loss", with_ctes("logits", f"SELECT count(*) AS n, {r(f'avg(-pow(1 - exp(lp), 2.0) * lp * ([{", ".join(f"{a}::DOUBLE" for a in _ALPHA)}])[label + 1])')} AS loss FROM lp", _LP))
def focal_loss(spark, sf):
    return A.rounded(Q.log_loss(A.logits(spark, sf), "za", "label", gamma=2.0, alpha=_ALPHA))


def _both(spark, sf):
    v = A.vectors(spark, sf)
    return P.stack_domains({d: v.select("item_id", "label", F.col(d).alias("embedding")) for d in ("a", "b")})


_CENTROIDS = {
    "e": "SELECT label, unnest(range(0, 64))::INT AS dim, unnest(a) AS v FROM vectors UNION ALL SELECT label, unnest(range(0, 64))::INT, unnest(b) FROM vectors",
    "m": "SELECT label, dim, avg(v) AS v FROM e GROUP BY ALL",
    "c": "SELECT label, list(u ORDER BY dim) AS centroid FROM (SELECT label, dim, v / sqrt(sum(v * v) OVER (PARTITION BY label)) AS u FROM m) GROUP BY label",
}


@query("class_centroids", with_ctes("vectors", f"SELECT label, dim, {r('value')} AS value FROM (SELECT label, unnest(range(0, 64))::INT AS dim, unnest(centroid) AS value FROM c)", _CENTROIDS))
def class_centroids(spark, sf):
    c = E.class_centroids(_both(spark, sf))
    return A.rounded(c.select("label", F.posexplode("centroid").alias("dim", "value")))


@query("nearest_centroid", with_ctes("vectors", f"""
    SELECT item_id, arg_max(cl, s) AS predicted_class, {r('max(s)')} AS cosine, {r('1.0 / sum(exp((s - top) / 0.1))')} AS probability FROM (
        SELECT item_id, c.label AS cl, list_cosine_similarity(a, centroid) AS s, max(list_cosine_similarity(a, centroid)) OVER (PARTITION BY item_id) AS top FROM vectors, c) GROUP BY item_id""", _CENTROIDS))
def nearest_centroid(spark, sf):
    v = A.vectors(spark, sf).select("item_id", F.col("a").alias("embedding"))
    n = E.nearest_centroid(v, E.class_centroids(_both(spark, sf)))
    return A.rounded(n.select("item_id", "predicted_class", "cosine", "probability"))
