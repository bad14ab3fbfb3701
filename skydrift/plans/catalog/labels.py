from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import segmentation as S
from .. import adapters as A
from ..adapters import r, rnd, with_ctes
from ..registry import query

CLASSES = list(range(5))


def _long(spark, sf):
    """Truth and prediction of both views as rows."""
    m = A.masks(spark, sf)
    return m.select("patch_index", "scene", "label", F.explode(F.array(*[F.struct(F.lit(v).alias("view"), F.col(f"pred_{v}").alias("pred")) for v in "ab"])).alias("c")).select(
        "patch_index", "scene", "label", "c.*"
    )


_LONG = "SELECT patch_index, scene, label, 'a' AS view, pred_a AS pred FROM masks UNION ALL SELECT patch_index, scene, label, 'b', pred_b FROM masks"
_CM = "SELECT view, label, pred, count(*) AS n FROM ml WHERE label <> -1 GROUP BY ALL"
_PC = """SELECT view, class, sum(support)::BIGINT AS support, sum(guessed)::BIGINT AS guessed, sum(hit)::BIGINT AS hit FROM (
    SELECT view, label AS class, n AS support, 0 AS guessed, CASE WHEN label = pred THEN n ELSE 0 END AS hit FROM cm UNION ALL SELECT view, pred, 0, n, 0 FROM cm) GROUP BY ALL"""
_IOU = "SELECT *, hit / (support + guessed - hit) AS iou, 2 * hit / (support + guessed) AS f1 FROM pc"
_BASE = {"ml": _LONG, "cm": _CM}
_FULL = {**_BASE, "pc": _PC, "ci": _IOU}


@query("confusion_matrix", with_ctes("masks", "SELECT * FROM cm", _BASE))
def confusion_matrix(spark, sf):
    return S.confusion_matrix(_long(spark, sf), ["view"])


def _binary(tp, fp, fn, tn):
    z = lambda a, b: f"CASE WHEN ({b}) > 0 THEN ({a}) / ({b}) ELSE 0 END"
    return {"iou": z(tp, f"{tp} + {fp} + {fn}"), "dice": z(f"2 * {tp}", f"2 * {tp} + {fp} + {fn}"), "accuracy": z(f"{tp} + {tn}", f"{tp} + {fp} + {fn} + {tn}"),
            "f1_score": z(f"2 * {tp}", f"2 * {tp} + {fp} + {fn}")}


_CONF = """SELECT view, coalesce(sum(n) FILTER (WHERE label = 1 AND pred = 1), 0)::BIGINT AS tp, coalesce(sum(n) FILTER (WHERE label <> 1 AND pred = 1), 0)::BIGINT AS fp,
    coalesce(sum(n) FILTER (WHERE label = 1 AND pred <> 1), 0)::BIGINT AS fn, coalesce(sum(n) FILTER (WHERE label <> 1 AND pred <> 1), 0)::BIGINT AS tn FROM cm GROUP BY view"""


@query("binary_metrics", with_ctes("masks", "SELECT view, tp, fp, fn, tn, " + ", ".join(f"{r(e)} AS {k}" for k, e in _binary("tp", "fp", "fn", "tn").items()) + " FROM b", {**_BASE, "b": _CONF}))
def binary_metrics(spark, sf):
    return A.rounded(S.binary_metrics(S.confusion_matrix(_long(spark, sf), ["view"]), ["view"]))


_OK = "label <> -1"
_SEG_COUNTS = ", ".join(
    f"count(*) FILTER (WHERE {cond} AND {where}) AS {t}_{n}"
    for t, y, p, where in (("a", "label", "pred_a", _OK), ("b", "label", "pred_b", _OK), ("ab", "pred_a", "pred_b", "true"))
    for n, cond in (("tp", f"{y} = 1 AND {p} = 1"), ("fp", f"{y} <> 1 AND {p} = 1"), ("fn", f"{y} = 1 AND {p} <> 1"), ("tn", f"{y} <> 1 AND {p} <> 1")))
_M = {t: _binary(*[f"{t}_{n}" for n in ("tp", "fp", "fn", "tn")]) for t in ("a", "b", "ab")}
_SHORT = {"iou": "iou", "dice": "dice", "accuracy": "accuracy", "f1_score": "f1"}
_SEG = "SELECT patch_index, " + ", ".join(
    [f"{_M['a'][k]} AS raw_{s}" for k, s in _SHORT.items()] + [f"{_M['b'][k]} AS simulated_{s}" for k, s in _SHORT.items()]
    + [f"{_M['ab']['iou']} AS agreement_iou", f"{_M['ab']['dice']} AS agreement_dice"]) + f" FROM (SELECT patch_index, {_SEG_COUNTS} FROM masks GROUP BY patch_index)"
_SEG_CTES = {"s": _SEG}
_COLS = [f"{side}_{s}" for side in ("raw", "simulated") for s in _SHORT.values()] + ["agreement_iou", "agreement_dice"]


@query("segmentation_drift", with_ctes("masks", "SELECT patch_index, " + ", ".join(f"{r(c)} AS {c}" for c in _COLS) + ", " + ", ".join(
    f"{r(f'simulated_{s} - raw_{s}')} AS {s}_drift" for s in _SHORT.values()) + " FROM s", _SEG_CTES))
def segmentation_drift(spark, sf):
    return A.rounded(S.segmentation_drift(A.masks(spark, sf)))


@query("segmentation_drift_summary", with_ctes("masks", "SELECT count(*) AS total_pairs, " + ", ".join(
    f"{r(f'avg({side}_{m})')} AS avg_{side}_{m}, {r(f'stddev_pop({side}_{m})')} AS std_{side}_{m}" for side in ("raw", "simulated") for m in ("iou", "dice", "f1")) + ", " + ", ".join(
    f"{r(f'avg(simulated_{m} - raw_{m})')} AS avg_{m}_drift, {r(f'max(abs(simulated_{m} - raw_{m}))')} AS max_{m}_drift" for m in ("iou", "dice", "f1"))
    + f", {r('avg(agreement_iou)')} AS avg_prediction_agreement, {r('min(agreement_iou)')} AS min_prediction_agreement FROM s", _SEG_CTES))
def segmentation_drift_summary(spark, sf):
    return A.rounded(S.segmentation_drift_summary(S.segmentation_drift(A.masks(spark, sf))))


def _per_class(spark, sf, classes=None):
    return S.per_class_iou(S.confusion_matrix(_long(spark, sf), ["view"]), ["view"], classes)


@query("per_class_iou", with_ctes("masks", f"""
    SELECT view, class, coalesce(support, 0) AS support, {r('coalesce(iou, -1)')} AS iou, {r('coalesce(f1, -1)')} AS f1
    FROM (SELECT view, unnest(range(0, 5))::INT AS class FROM (SELECT DISTINCT view FROM cm)) LEFT JOIN ci USING (view, class)""", _FULL))
def per_class_iou(spark, sf):
    """Five classes: three with labels, one only predicted, one absent (shown as -1)."""
    p = _per_class(spark, sf, CLASSES)
    return p.select("view", "class", "support", rnd(F.coalesce("iou", F.lit(-1.0))).alias("iou"), rnd(F.coalesce("f1", F.lit(-1.0))).alias("f1"))


@query("mean_iou", with_ctes("masks", f"SELECT view, {r('avg(iou)')} AS mean_iou FROM ci GROUP BY view", _FULL))
def mean_iou(spark, sf):
    return A.rounded(S.mean_iou(_per_class(spark, sf), ["view"]))


@query("mean_iou_fixed", with_ctes("masks", f"SELECT view, {r('sum(iou) / 5')} AS mean_iou_fixed FROM ci GROUP BY view", _FULL))
def mean_iou_fixed(spark, sf):
    return A.rounded(S.mean_iou_fixed(_per_class(spark, sf), 5, ["view"]))


@query("accuracy", with_ctes("masks", f"SELECT view, {r('sum(CASE WHEN label = pred THEN n ELSE 0 END) / sum(n)')} AS accuracy FROM cm GROUP BY view", _BASE))
def accuracy(spark, sf):
    return A.rounded(S.accuracy(S.confusion_matrix(_long(spark, sf), ["view"]), ["view"]))


@query("macro_f1", with_ctes("masks", f"SELECT view, {r('avg(f1)')} AS macro_f1 FROM ci GROUP BY view", _FULL))
def macro_f1(spark, sf):
    return A.rounded(S.macro_f1(_per_class(spark, sf), ["view"]))


@query("domain_gap_iou", with_ctes("masks", f"""
    SELECT {r('s')} AS source_iou, {r('t')} AS target_iou, {r('s - t')} AS domain_gap_iou FROM (SELECT avg(iou) FILTER (WHERE view = 'a') AS s, avg(iou) FILTER (WHERE view = 'b') AS t FROM ci)""", _FULL))
def domain_gap_iou(spark, sf):
    return A.rounded(S.domain_gap_iou(S.confusion_matrix(_long(spark, sf), ["view"]), "a", "b"))


@query("per_scene_iou", with_ctes("masks", f"""
    SELECT patch_index, count(*) FILTER (WHERE label <> -1 AND label = 1 AND pred_a = 1) AS inter, count(*) FILTER (WHERE label <> -1 AND (label = 1 OR pred_a = 1)) AS union_px,
           {r('coalesce(count(*) FILTER (WHERE label <> -1 AND label = 1 AND pred_a = 1) / nullif(count(*) FILTER (WHERE label <> -1 AND (label = 1 OR pred_a = 1)), 0), -1)')} AS iou FROM masks GROUP BY patch_index"""))
def per_scene_iou(spark, sf):
    p = S.per_scene_iou(A.masks(spark, sf), "patch_index", pred="pred_a")
    return p.select("patch_index", "inter", "union_px", rnd(F.coalesce("iou", F.lit(-1.0))).alias("iou"))


@query("dominant_class", with_ctes("masks", """
    SELECT k.patch_index, coalesce(d.label, -1)::INT AS dominant_class FROM (SELECT DISTINCT patch_index FROM masks) k LEFT JOIN (
        SELECT patch_index, label FROM (SELECT patch_index, label, count(*) AS n FROM masks WHERE label <> -1 GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY patch_index ORDER BY n DESC, label) = 1) d
    USING (patch_index)"""))
def dominant_class(spark, sf):
    return S.dominant_class(A.masks(spark, sf))


@query("class_fraction", with_ctes("masks", f"SELECT patch_index, {r('coalesce(avg((label = 1)::INT) FILTER (WHERE label <> -1), -1)')} AS fraction FROM masks GROUP BY patch_index"))
def class_fraction(spark, sf):
    c = S.class_fraction(A.masks(spark, sf), 1)
    return c.select("patch_index", rnd(F.coalesce("fraction", F.lit(-1.0))).alias("fraction"))


_FREQ = {"fr": "SELECT label AS class, count(*) AS n, count(*) / sum(count(*)) OVER () AS freq FROM masks WHERE label <> -1 GROUP BY label"}


@query("class_frequencies", with_ctes("masks", f"SELECT class, n, {r('freq')} AS freq FROM fr", _FREQ))
def class_frequencies(spark, sf):
    return A.rounded(S.class_frequencies(A.masks(spark, sf)))


_SCHEMES = {"none": "1.0::DOUBLE", "inverse": "1.0 / freq", "inverse_sqrt": "1.0 / sqrt(freq)", "effective": "0.001 / (1 - pow(0.999::DOUBLE, greatest(freq * 10000, 1)))"}


@query("class_weights", with_ctes("masks", " UNION ALL ".join(
    f"""SELECT '{s}' AS scheme, class, {r(f'({e}) / avg({e}) OVER ()')} AS weight, {'false' if s == 'none' else f'(max({e}) OVER () / min({e}) OVER ()) < 1.05'} AS near_uniform FROM fr"""
    for s, e in _SCHEMES.items()), _FREQ))
def class_weights(spark, sf):
    f = S.class_frequencies(A.masks(spark, sf)).select("class", "freq")
    out = None
    for s in _SCHEMES:
        w = S.class_weights(f, s).select(F.lit(s).alias("scheme"), "class", rnd("weight").alias("weight"), "near_uniform")
        out = w if out is None else out.unionByName(w)
    return out


@query("chance_miou", with_ctes("masks", f"""
    SELECT {r('avg((freq / c) / (freq + 1.0 / c - freq / c))')} AS chance_miou, {r('avg(freq * freq / (2 * freq - freq * freq))')} AS prior_matched_miou FROM (SELECT freq, (count(*) OVER ())::DOUBLE AS c FROM fr)""", _FREQ))
def chance_miou(spark, sf):
    return A.rounded(S.chance_miou(S.class_frequencies(A.masks(spark, sf))))


@query("dead_classes", with_ctes("masks", f"SELECT class, {r('max(coalesce(iou, 0))')} AS best_iou FROM g GROUP BY class HAVING max(coalesce(iou, 0)) <= 0.01", {
    **_FULL, "g": "SELECT view, class, iou FROM (SELECT view, unnest(range(0, 5))::INT AS class FROM (SELECT DISTINCT view FROM cm)) LEFT JOIN ci USING (view, class)"}))
def dead_classes(spark, sf):
    """A class is dead when no view (here: run) ever gets it right."""
    return A.rounded(S.dead_classes(_per_class(spark, sf, CLASSES)))
