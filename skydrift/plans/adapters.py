"""The given tables in the shapes the operators work on, and the same in SQL.

Each Spark adapter has a CTE of the same name in ``CTES`` with the same
arithmetic, so a query and its SQL check start from identical rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import order

BANDS = ["blue", "green", "red", "nir"]
LAYERS, LAYER_DIM = 4, 16


KEYS = {"lineitem": "l_orderkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id", "embeddings": "vec_id"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    t = spark.read.parquet(f"{sf}/{name}.parquet")
    return order.spread(t, KEYS[name]) if name in KEYS else t


# --- rounding shared with SQL ---------------------------------------------------
def rnd(c: Column | str, digits: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits) + F.lit(0.0)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[rnd(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def r(expr: str, digits: int = 6) -> str:
    return f"(round(({expr})::DOUBLE, {digits}) + 0.0::DOUBLE)"


# --- pixels -----------------------------------------------------------------------
def pixels_wide(spark: SparkSession, sf: str, as_read: bool = False) -> DataFrame:
    """Two views of every line as four bands: b is a known affine mix of a. ``as_read`` leaves the dealing of rows to a shuffle that follows."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet") if as_read else table(spark, sf, "lineitem")
    a = li.select(
        F.col("l_orderkey").alias("patch_index"), F.col("l_linenumber").alias("y"),
        (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("x"),
        ((F.col("l_quantity") - 1.0) * 80.0).alias("a_blue"), (F.col("l_extendedprice") / 19.73205).alias("a_green"),
        (F.round(F.col("l_discount") * 100.0) * 40.0).alias("a_red"), (F.round(F.col("l_tax") * 100.0) * 500.0).alias("a_nir"),
    )
    return a.select(
        "*",
        (F.col("a_blue") * 0.9 + 25.0 + F.col("a_green") * 0.01).alias("b_blue"), (F.col("a_green") * 1.1 + F.col("a_red") * 0.02).alias("b_green"),
        (F.col("a_red") * 0.8 + F.col("a_blue") * 0.05).alias("b_red"), (F.col("a_nir") * 1.05 + 10.0 + F.col("a_green") * 0.03).alias("b_nir"),
    )


def pixels_view(spark: SparkSession, sf: str, view: str) -> DataFrame:
    return pixels_wide(spark, sf).select("patch_index", "y", "x", *[F.col(f"{view}_{b}").alias(b) for b in BANDS])


def pixels_long(spark: SparkSession, sf: str) -> DataFrame:
    """(patch_index, y, x, view, band, value): one scan, no join."""
    return pixels_wide(spark, sf).select("patch_index", "y", "x", cells())


def cells() -> Column:
    """view, band and value of a wide pixel: a row for each."""
    return F.inline(F.array(*[F.struct(F.lit(v).alias("view"), F.lit(b).alias("band"), F.col(f"{v}_{b}").alias("value")) for v in ("a", "b") for b in BANDS]))


def band_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """(patch_index, y, x, band, target, reference)."""
    cells = F.explode(
        F.array(*[F.struct(F.lit(b).alias("band"), F.col(f"a_{b}").alias("target"), F.col(f"b_{b}").alias("reference")) for b in BANDS])
    )
    return pixels_wide(spark, sf).select("patch_index", "y", "x", cells.alias("c")).select("patch_index", "y", "x", "c.*")


def masks(spark: SparkSession, sf: str) -> DataFrame:
    """Truth 0..2 with -1 for some rows; predictions a and b, of which class 3 is never true."""
    li = table(spark, sf, "lineitem")
    disc, tax = F.round(F.col("l_discount") * 100.0).cast("int"), F.round(F.col("l_tax") * 100.0).cast("int")
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    label = F.when((F.col("l_linestatus") == "F") & (F.col("l_linenumber") >= 6), -1).otherwise(flag)
    return li.select(
        F.col("l_orderkey").alias("patch_index"), F.col("l_linenumber").alias("y"),
        (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("x"), F.col("l_suppkey").alias("scene"), label.alias("label"),
        F.when(disc <= 6, flag).otherwise(disc % 4).alias("pred_a"), F.when(tax <= 4, flag).otherwise(tax % 3).alias("pred_b"),
    )


# --- manifest -----------------------------------------------------------------------
def manifest(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    q = lambda f: F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity")).otherwise(0.0))
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.min("l_shipdate").alias("ship"), F.sum("l_quantity").alias("qty"), q("A").alias("qa"), q("N").alias("qn"), q("R").alias("qr"),
        F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_quantity")).otherwise(0.0)).alias("qf"), F.max("l_discount").alias("disc"),
        F.max("l_tax").alias("tax"),
    )
    j = o.join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    top = F.greatest("qa", "qn", "qr")
    return j.select(
        F.col("o_orderkey").alias("patch_index"), F.col("o_orderkey").alias("label_h5_index"), F.col("o_custkey").alias("product_id"),
        F.col("o_orderdate").cast("date").alias("date_phi"), F.col("ship").cast("date").alias("date_s2b"),
        (F.abs(F.datediff("ship", "o_orderdate")) / 4.0).alias("patch_delta_days"),
        (F.round(F.col("disc") * 100.0) * 0.5).alias("thick_cloud_pct"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.round(F.col("tax") * 100.0) * 0.25).alias("thin_cloud_pct"),
        (F.col("qa") / F.col("qty")).alias("wc_frac_10"), (F.col("qn") / F.col("qty")).alias("wc_frac_20"),
        (F.col("qr") / F.col("qty")).alias("wc_frac_30"), (F.col("qf") / F.col("qty") * 0.1).alias("wc_nodata_frac"),
        F.when(F.col("qty").isNotNull(), F.when(F.col("qa") == top, 10).when(F.col("qn") == top, 20).otherwise(30)).alias("wc_dominant_class"),
        (top / F.col("qty")).alias("wc_dominant_frac"),
        (F.col("o_custkey") * 7 % 360 - 180).cast("double").alias("center_lon"), (F.col("o_orderkey") * 11 % 180 - 90).cast("double").alias("center_lat"),
        (F.col("o_custkey") % 32).cast("int").alias("koppen_zone"),
    )


# --- embeddings -----------------------------------------------------------------------
def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """(item_id, label, batch, a, b): two domains of every vector, as doubles."""
    e = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("item_id"), "label", F.col("embedding").cast("array<double>").alias("a")
    )
    gain = 1.0 + F.col("label") / 20.0
    return e.select(
        "item_id", "label", F.floor(F.col("item_id") / 64).cast("long").alias("batch"), "a",
        F.transform("a", lambda x, i: x * gain + (i % 3) * 0.02).alias("b"),
    )


def layer_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """(item_id, label, batch, domain, layer, embedding): slices of 16 as layers."""
    v = vectors(spark, sf)
    cells = F.explode(
        F.array(
            *[
                F.struct(F.lit(d).alias("domain"), F.lit(k).alias("layer"), F.slice(d, k * LAYER_DIM + 1, LAYER_DIM).alias("embedding"))
                for d in ("a", "b") for k in range(LAYERS)
            ]
        )
    )
    return v.select("item_id", "label", "batch", cells.alias("c")).select("item_id", "label", "batch", "c.*")


def paired_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return vectors(spark, sf).select("item_id", "label", "batch", F.col("a").alias("emb_a"), F.col("b").alias("emb_b"))


def paired_layers(spark: SparkSession, sf: str) -> DataFrame:
    """(item_id, layer, emb_a, emb_b) from one row, so nothing has to be joined."""
    cells = F.explode(
        F.array(
            *[
                F.struct(F.lit(k).alias("layer"), F.slice("a", k * LAYER_DIM + 1, LAYER_DIM).alias("emb_a"),
                         F.slice("b", k * LAYER_DIM + 1, LAYER_DIM).alias("emb_b"))
                for k in range(LAYERS)
            ]
        )
    )
    return vectors(spark, sf).select("item_id", cells.alias("c")).select("item_id", "c.*")


def logits(spark: SparkSession, sf: str) -> DataFrame:
    """(item_id, label, za, zb): ten class scores in both domains; a class sums every tenth component."""
    v = vectors(spark, sf)
    ten = lambda d: F.array(*[F.aggregate(F.filter(d, lambda x, i: i % 10 == k), F.lit(0.0), lambda s, x: s + x) * 20.0 for k in range(10)])  # noqa: E731, B023
    label = F.when(F.col("item_id") % 13 == 0, -1).otherwise(F.col("label")).alias("label")
    # a generator in between: else filters above would be pushed down with copies of these sums
    return v.select("item_id", label, F.inline(F.array(F.struct(ten("a").alias("za"), ten("b").alias("zb")))))


# --- runs -------------------------------------------------------------------------------
def run_history(spark: SparkSession, sf: str) -> DataFrame:
    """(run, attempt, epoch, metric, value) from the event log."""
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    cells = F.explode(
        F.array(
            F.struct(F.lit("iou").alias("metric"), (F.col("value") / 600.0).alias("value")),
            F.struct(F.lit("gap").alias("metric"), (k / 100.0).alias("value")),
        )
    )
    return e.select(
        F.col("event_type").alias("run"), F.concat(F.lit("attempt_"), (F.col("user_id") % 3).cast("string")).alias("attempt"),
        (F.dayofmonth("ts") - 1).alias("epoch"), cells.alias("c"),
    ).select("run", "attempt", "epoch", "c.*")


def run_cells(spark: SparkSession, sf: str) -> DataFrame:
    """(init, train_variant, variant, seed, test_iou_water, test_iou, severity): one row per cell."""
    from .. import constants as C

    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    ladder = F.array(*[F.lit(v) for v in C.ladder_order()])
    rows = e.select(
        F.when(F.col("event_type").isin("view", "click"), "distilled").otherwise("scratch").alias("init"),
        F.when(F.col("event_type").isin("view", "purchase"), "clean").otherwise("joint_l4").alias("train_variant"),
        F.get(ladder, k % 17).alias("variant"), (F.col("user_id") % 3).cast("int").alias("seed"), (F.col("value") / 600.0).alias("v"), F.round(F.col("value") * 100).cast("long").alias("cents"),
        ((k % 17) / 16.0).alias("severity"),
    )
    return rows.groupBy("init", "train_variant", "variant", "seed").agg(
        (F.sum("cents") / (F.count("cents") * 60000.0)).alias("test_iou_water"), F.max("v").alias("test_iou"), F.max("severity").alias("severity")
    )


# --- files -------------------------------------------------------------------------------
def split_rows(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, s1_file, label_file) named after documents."""
    d = table(spark, sf, "documents").select("doc_id", "source")
    stem = F.concat("source", F.lit("_"), F.col("doc_id").cast("string"))
    return d.select("doc_id", F.concat(stem, F.lit("_S1Hand.tif")).alias("s1_file"), F.concat(stem, F.lit("_LabelHand.tif")).alias("label_file"))


def image_files(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, name, path, length): optical files of all documents but every eleventh."""
    d = table(spark, sf, "documents").select("doc_id", "source", "n_chars").where(F.col("doc_id") % 11 != 3)
    name = F.concat("source", F.lit("_"), F.col("doc_id").cast("string"), F.lit("_S2Hand.tif"))
    return d.select("doc_id", name.alias("name"), F.concat(F.lit("/data/s2/"), name).alias("path"), F.col("n_chars").alias("length"))


def simulated_files(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, name, path, length): partners exist for labelled documents, under one of the four names."""
    d = table(spark, sf, "labels").select("doc_id").join(table(spark, sf, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    stem = F.concat("source", F.lit("_"), F.col("doc_id").cast("string"))
    full, short = F.concat(F.lit("simulated_"), stem, F.lit("_S2Hand.tif")), F.concat(F.lit("simulated_"), stem, F.lit("_.tif.tif"))
    k = F.col("doc_id") % 4
    name = (
        F.when(k == 0, full).when(k == 1, F.concat(F.lit("simulated_train/"), full)).when(k == 2, short)
        .otherwise(F.concat(F.lit("simulated_train/"), short))
    )
    return d.select(
        "doc_id", name.alias("name"), F.concat(F.lit("/data/sim/"), name).alias("path"),
        F.when(F.col("doc_id") % 9 == 0, 0).otherwise(F.col("n_chars")).cast("long").alias("length"),
    )


# --- the same in SQL -----------------------------------------------------------------------
_BAND_SQL = {"blue", "green", "red", "nir"}

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "pixels_wide": ((), """
        SELECT *, a_blue * 0.9::DOUBLE + 25.0::DOUBLE + a_green * 0.01::DOUBLE AS b_blue, a_green * 1.1::DOUBLE + a_red * 0.02::DOUBLE AS b_green,
               a_red * 0.8::DOUBLE + a_blue * 0.05::DOUBLE AS b_red, a_nir * 1.05::DOUBLE + 10.0::DOUBLE + a_green * 0.03::DOUBLE AS b_nir
        FROM (SELECT l_orderkey AS patch_index, l_linenumber AS y, l_partkey * 100000 + l_suppkey AS x,
                     (l_quantity - 1.0::DOUBLE) * 80.0::DOUBLE AS a_blue, l_extendedprice / 19.73205::DOUBLE AS a_green,
                     round(l_discount * 100.0::DOUBLE) * 40.0::DOUBLE AS a_red, round(l_tax * 100.0::DOUBLE) * 500.0::DOUBLE AS a_nir
              FROM lineitem)"""),
    "pixels_long": (("pixels_wide",), " UNION ALL ".join(
        f"SELECT patch_index, y, x, '{v}' AS view, '{b}' AS band, {v}_{b} AS value FROM pixels_wide" for v in ("a", "b") for b in BANDS)),
    "band_pairs": (("pixels_wide",), " UNION ALL ".join(
        f"SELECT patch_index, y, x, '{b}' AS band, a_{b} AS target, b_{b} AS reference FROM pixels_wide" for b in BANDS)),
    "masks": ((), """
        SELECT l_orderkey AS patch_index, l_linenumber AS y, l_partkey * 100000 + l_suppkey AS x, l_suppkey AS scene,
               CASE WHEN l_linestatus = 'F' AND l_linenumber >= 6 THEN -1 ELSE flag END AS label,
               CASE WHEN disc <= 6 THEN flag ELSE disc % 4 END AS pred_a, CASE WHEN tax <= 4 THEN flag ELSE tax % 3 END AS pred_b
        FROM (SELECT *, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS flag,
                     round(l_discount * 100.0::DOUBLE)::INT AS disc, round(l_tax * 100.0::DOUBLE)::INT AS tax FROM lineitem)"""),
    "manifest": ((), """
        SELECT o_orderkey AS patch_index, o_orderkey AS label_h5_index, o_custkey AS product_id, o_orderdate::DATE AS date_phi, ship::DATE AS date_s2b,
               abs(date_diff('day', o_orderdate::DATE, ship::DATE)) / 4.0::DOUBLE AS patch_delta_days,
               round(disc * 100.0::DOUBLE) * 0.5::DOUBLE AS thick_cloud_pct,
               CASE WHEN o_orderpriority <> '5-LOW' THEN round(tax * 100.0::DOUBLE) * 0.25::DOUBLE END AS thin_cloud_pct,
               qa / qty AS wc_frac_10, qn / qty AS wc_frac_20, qr / qty AS wc_frac_30, qf / qty * 0.1::DOUBLE AS wc_nodata_frac,
               CASE WHEN qty IS NOT NULL THEN CASE WHEN qa = greatest(qa, qn, qr) THEN 10 WHEN qn = greatest(qa, qn, qr) THEN 20 ELSE 30 END END AS wc_dominant_class,
               greatest(qa, qn, qr) / qty AS wc_dominant_frac,
               (o_custkey * 7 % 360 - 180)::DOUBLE AS center_lon, (o_orderkey * 11 % 180 - 90)::DOUBLE AS center_lat, (o_custkey % 32)::INT AS koppen_zone
        FROM orders LEFT JOIN (
            SELECT l_orderkey, min(l_shipdate) AS ship, sum(l_quantity) AS qty, max(l_discount) AS disc, max(l_tax) AS tax,
                   sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0.0 END) AS qa, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0.0 END) AS qn,
                   sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0.0 END) AS qr, sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0.0 END) AS qf
            FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey"""),
    "vectors": ((), """
        SELECT item_id, label, item_id // 64 AS batch, a, [a[i + 1] * (1.0::DOUBLE + label / 20.0::DOUBLE) + (i % 3) * 0.02::DOUBLE FOR i IN range(0, len(a))] AS b
        FROM (SELECT vec_id AS item_id, label, [x::DOUBLE FOR x IN embedding] AS a FROM embeddings)"""),
    "layer_embeddings": (("vectors",), " UNION ALL ".join(
        f"SELECT item_id, label, batch, '{d}' AS domain, {k} AS layer, {d}[{k * 16 + 1}:{k * 16 + 16}] AS embedding FROM vectors"
        for d in ("a", "b") for k in range(4))),
    "paired_layers": (("vectors",), " UNION ALL ".join(
        f"SELECT item_id, {k} AS layer, a[{k * 16 + 1}:{k * 16 + 16}] AS emb_a, b[{k * 16 + 1}:{k * 16 + 16}] AS emb_b FROM vectors" for k in range(4))),
    "layer_metrics": (("paired_layers",), """
        SELECT item_id, layer, list_cosine_similarity(emb_a, emb_b) AS cosine,
               list_sum([(emb_a[i] - emb_b[i]) * (emb_a[i] - emb_b[i]) FOR i IN range(1, len(emb_a) + 1)]) / len(emb_a) AS mse,
               list_sum([abs(emb_a[i] - emb_b[i]) FOR i IN range(1, len(emb_a) + 1)]) / len(emb_a) AS mae
        FROM paired_layers"""),
    "logits": (("vectors",), """
        SELECT item_id, CASE WHEN item_id % 13 = 0 THEN -1 ELSE label END AS label, [list_sum([a[i + 1] FOR i IN range(k, 64, 10)]) * 20.0::DOUBLE FOR k IN range(0, 10)] AS za, [list_sum([b[i + 1] FOR i IN range(k, 64, 10)]) * 20.0::DOUBLE FOR k IN range(0, 10)] AS zb
        FROM vectors"""),
    "probs": (("logits",), """
        SELECT item_id, label, [exp(x - ma) / list_sum([exp(w - ma) FOR w IN za]) FOR x IN za] AS pa, [exp(x - mb) / list_sum([exp(w - mb) FOR w IN zb]) FOR x IN zb] AS pb
        FROM (SELECT *, list_max(za) AS ma, list_max(zb) AS mb FROM logits)"""),
    "top3": (("probs",), """
        SELECT item_id, view, list(cls ORDER BY rk) AS classes, max(CASE WHEN rk = 1 THEN cls END) AS predicted_class, max(CASE WHEN rk = 1 THEN p END) AS probability
        FROM (SELECT *, row_number() OVER (PARTITION BY item_id, view ORDER BY p DESC, cls) AS rk
              FROM (SELECT item_id, 'a' AS view, unnest(range(0, 10))::INT AS cls, unnest(pa) AS p FROM probs
                    UNION ALL SELECT item_id, 'b', unnest(range(0, 10))::INT, unnest(pb) FROM probs))
        WHERE rk <= 3 GROUP BY item_id, view"""),
    "class_pairs": (("top3",), """
        SELECT a.item_id, a.predicted_class AS a_predicted_class, b.predicted_class AS b_predicted_class, a.predicted_class <> b.predicted_class AS class_flip,
               b.probability - a.probability AS probability_change, len(list_intersect(a.classes, b.classes)) / 3.0::DOUBLE AS top3_consistency
        FROM top3 a JOIN top3 b ON a.item_id = b.item_id AND a.view = 'a' AND b.view = 'b'"""),
    "run_history": ((), """
        SELECT event_type AS run, 'attempt_' || (user_id % 3) AS attempt, (day(ts) - 1)::INT AS epoch, unnest(['iou', 'gap']) AS metric,
               unnest([value / 600.0::DOUBLE, (json_extract_string(props, '$.k')::INT) / 100.0::DOUBLE]) AS value FROM events"""),
    "run_curve": (("run_history",), "SELECT run, epoch, metric, max(value) AS value FROM run_history GROUP BY ALL"),
    "run_cells": ((), """
        SELECT init, train_variant, variant, seed, sum(cents)::DOUBLE / (count(cents) * 60000.0::DOUBLE) AS test_iou_water, max(v) AS test_iou, max(severity) AS severity FROM (
            SELECT CASE WHEN event_type IN ('view', 'click') THEN 'distilled' ELSE 'scratch' END AS init,
                   CASE WHEN event_type IN ('view', 'purchase') THEN 'clean' ELSE 'joint_l4' END AS train_variant,
                   (['clean', 'snr_l1', 'snr_l2', 'snr_l3', 'snr_l4', 'psf_l1', 'psf_l2', 'psf_l3', 'psf_l4', 'misalign_l1', 'misalign_l2', 'misalign_l3', 'misalign_l4',
                     'joint_l1', 'joint_l2', 'joint_l3', 'joint_l4'])[k % 17 + 1] AS variant, (user_id % 3)::INT AS seed, value / 600.0::DOUBLE AS v, round(value * 100)::BIGINT AS cents, (k % 17) / 16.0::DOUBLE AS severity
            FROM (SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events)) GROUP BY ALL"""),
    "split_rows": ((), """
        SELECT doc_id, source || '_' || doc_id || '_S1Hand.tif' AS s1_file, source || '_' || doc_id || '_LabelHand.tif' AS label_file FROM documents"""),
    "image_files": ((), """
        SELECT doc_id, source || '_' || doc_id || '_S2Hand.tif' AS name, '/data/s2/' || source || '_' || doc_id || '_S2Hand.tif' AS path, n_chars AS length
        FROM documents WHERE doc_id % 11 <> 3"""),
    "simulated_files": ((), """
        SELECT doc_id, name, '/data/sim/' || name AS path, CASE WHEN doc_id % 9 = 0 THEN 0 ELSE n_chars END::BIGINT AS length FROM (
            SELECT l.doc_id, n_chars, CASE l.doc_id % 4 WHEN 0 THEN 'simulated_' || source || '_' || l.doc_id || '_S2Hand.tif'
                   WHEN 1 THEN 'simulated_train/simulated_' || source || '_' || l.doc_id || '_S2Hand.tif'
                   WHEN 2 THEN 'simulated_' || source || '_' || l.doc_id || '_.tif.tif'
                   ELSE 'simulated_train/simulated_' || source || '_' || l.doc_id || '_.tif.tif' END AS name
            FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""),
}


def with_ctes(names: str, body: str, extra: dict[str, str] | None = None) -> str:
    """``WITH`` clause for the named adapters (and what they build on), then the body."""
    seen: list[str] = []

    def visit(n: str) -> None:
        for d in CTES[n][0]:
            visit(d)
        if n not in seen:
            seen.append(n)

    for n in names.split():
        visit(n)
    parts = [f"{n} AS ({CTES[n][1]})" for n in seen] + [f"{n} AS ({q})" for n, q in (extra or {}).items()]
    return ("WITH " + ", ".join(parts) + " " if parts else "") + body
