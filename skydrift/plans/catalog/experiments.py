from __future__ import annotations

from pyspark.sql import functions as F

from ... import constants as C
from ...operators import runs as R
from ...operators import significance as T
from .. import adapters as A
from ..adapters import r, rnd, with_ctes
from ..registry import query

METRICS = ["iou", "gap"]
LADDER = C.ladder_order()


def curve(spark, sf):
    return R.collapse_epochs(A.run_history(spark, sf))


@query("collapse_epochs", with_ctes("run_curve", f"SELECT run, epoch, metric, {r('value')} AS value FROM run_curve"))
def collapse_epochs(spark, sf):
    return A.rounded(curve(spark, sf))


@query("longest_attempt", with_ctes("run_history", """
    SELECT run, attempt, epochs FROM (SELECT run, attempt, count(DISTINCT epoch) AS epochs FROM run_history GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY run ORDER BY epochs DESC, attempt) = 1"""))
def longest_attempt(spark, sf):
    return R.longest_attempt(A.run_history(spark, sf))


@query("latest_per_group", """
    SELECT event_type, user_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY events.ts DESC, event_id DESC) = 1""")
def latest_per_group(spark, sf):
    e = A.table(spark, sf, "events").select("event_type", "user_id", "ts", "event_id")
    n = R.latest_per_group(e, ["event_type", "user_id"], "ts")
    return n.select("event_type", "user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "event_id")


_BEST = """SELECT run, metric, value AS best_value, epoch AS best_epoch FROM run_curve QUALIFY row_number() OVER (PARTITION BY run, metric ORDER BY value {}, epoch) = 1"""


@query("best_epoch", with_ctes("run_curve", f"SELECT run, metric, {r('best_value')} AS best_value, best_epoch FROM ({_BEST.format('DESC')})"))
def best_epoch(spark, sf):
    return A.rounded(R.best_epoch(curve(spark, sf)))


@query("best_epoch_lowest", with_ctes("run_curve", f"SELECT run, metric, {r('best_value')} AS best_value, best_epoch FROM ({_BEST.format('ASC')})"))
def best_epoch_lowest(spark, sf):
    return A.rounded(R.best_epoch(curve(spark, sf), "min"))


@query("metric_curve", with_ctes("run_curve", f"""
    SELECT run, epoch, {r('iou')} AS iou, {r('gap')} AS gap, {r('coalesce(iou - lag(iou) OVER w, 0)')} AS iou_change, {r('coalesce(gap - lag(gap) OVER w, 0)')} AS gap_change FROM (
        SELECT run, epoch, max(value) FILTER (WHERE metric = 'iou') AS iou, max(value) FILTER (WHERE metric = 'gap') AS gap FROM run_curve GROUP BY ALL) WINDOW w AS (PARTITION BY run ORDER BY epoch)"""))
def metric_curve(spark, sf):
    return A.rounded(R.metric_curve(curve(spark, sf), METRICS).fillna(0.0, ["iou_change", "gap_change"]))


RUN_SUMMARY_SQL = with_ctes("run_curve", f"""
    SELECT run, max(epoch) + 1 AS epochs, {r("max(value) FILTER (WHERE metric = 'iou')")} AS best_value, arg_max(epoch, value * 1e6 - epoch * 1e-9) FILTER (WHERE metric = 'iou') AS best_epoch,
           {', '.join(f"{r(f'''avg(value) FILTER (WHERE metric = '{m}' AND epoch >= 8)''')} AS {m}_mean, {r(f'''stddev_samp(value) FILTER (WHERE metric = '{m}' AND epoch >= 8)''')} AS {m}_sd" for m in METRICS)}
    FROM run_curve GROUP BY run""")


@query("run_summary", RUN_SUMMARY_SQL)
def run_summary(spark, sf):
    return A.rounded(R.run_summary(curve(spark, sf), METRICS, "iou"))


def run_records(spark, sf):
    """One record per init, training variant and seed; every third has no cross results."""
    c = A.run_cells(spark, sf)
    k = ["init", "train_variant", "seed"]
    model = F.when(F.col("seed") == 2, "terramind_v1_base")
    water = F.when(F.col("seed") == 2, "test/IoU_flood").otherwise("test_per_class/IoU_water")
    metrics = F.create_map(water, "test_iou_water", F.lit("test/mIoU"), "test_iou")
    g = c.groupBy(*k).agg(
        F.map_from_entries(F.collect_list(F.struct("variant", metrics.alias("m")))).alias("cross_all"),
        F.max("test_iou").alias("best_val_iou"),
    )
    keep = F.map_filter("cross_all", lambda v, _: v != F.col("train_variant"))
    return g.select(
        F.concat_ws("__", *k[:2], F.concat(F.lit("s"), F.col("seed").cast("string"))).alias("tag"), F.concat(F.lit("/ladder/"), "train_variant", F.lit("/v1.1")).alias("sim_root"),
        model.alias("model"), "seed", (F.col("init") == "scratch").alias("scratch"), F.lit("encoder").alias("freeze"), (F.col("seed") * 10).alias("epochs_run"), "best_val_iou",
        F.try_element_at("cross_all", F.col("train_variant")).alias("test"),
        F.when(F.col("seed") == 0, F.lit(None)).when(F.col("seed") == 1, keep).otherwise(F.col("cross_all")).alias("cross_condition"),
    )


_SEV = "SELECT variant AS name, max(severity) AS severity FROM run_cells GROUP BY variant"


@query("flatten_run_records", with_ctes("run_cells", f"""
    SELECT init || '__' || train_variant || '__s' || seed AS tag, train_variant, variant, CASE WHEN variant = 'clean' THEN 'none' ELSE split_part(variant, '_l', 1) END AS factor,
           CASE WHEN variant = 'clean' THEN 0 ELSE split_part(variant, '_l', 2)::INT END AS level,
           CASE WHEN seed = 2 THEN CASE WHEN init = 'scratch' THEN 'random' ELSE 'pretrained' END ELSE init END AS init, seed, CASE WHEN seed = 2 THEN 'terramind_v1_base' ELSE 'student' END AS model,
           {r('test_iou')} AS test_iou, {r('test_iou_water')} AS test_iou_water, {r('s.severity')} AS severity
    FROM run_cells JOIN s ON variant = s.name WHERE seed <> 0 OR variant = train_variant""", {"s": _SEV}))
def flatten_run_records(spark, sf):
    sev = A.run_cells(spark, sf).groupBy(F.col("variant").alias("name")).agg(F.max("severity").alias("severity"))
    f = R.flatten_run_records(run_records(spark, sf), sev)
    return A.rounded(f.select("tag", "train_variant", "variant", "factor", "level", "init", "seed", "model", "test_iou", "test_iou_water", "severity"))


LADDER_SQL = f"""
    SELECT init, train_variant, variant, CASE WHEN variant = 'clean' THEN 'none' ELSE split_part(variant, '_l', 1) END AS factor, CASE WHEN variant = 'clean' THEN 0 ELSE split_part(variant, '_l', 2)::INT END AS level,
           {r('max(severity)')} AS severity, count(*) AS n_seeds, {r('avg(test_iou_water)')} AS mean, {r('coalesce(stddev_samp(test_iou_water), 0)')} AS std, {r('min(test_iou_water)')} AS min,
           {r('max(test_iou_water)')} AS max, {r('avg(test_iou)')} AS mean_test_iou FROM run_cells GROUP BY ALL"""


@query("ladder_summary", with_ctes("run_cells", LADDER_SQL))
def ladder_summary(spark, sf):
    return A.rounded(R.ladder_summary(A.run_cells(spark, sf)))


@query("paired_seed_delta", with_ctes("run_cells", f"""
    SELECT init, train_variant, variant, n_pairs, {r('d')} AS delta, {r('sd')} AS sd, {r('coalesce(CASE WHEN n_pairs >= 2 AND sd > 0 THEN abs(d) / sd END, -1)', 4)} AS ratio,
           CASE WHEN n_pairs < 2 THEN 'n/a (1 seed)' WHEN sd = 0 THEN 'exact' WHEN abs(d) / sd < 2 THEN 'within noise' ELSE 'clear' END AS verdict FROM (
        SELECT m.init, m.train_variant, m.variant, coalesce(n_pairs, 0) AS n_pairs, coalesce(pd, m.mean - b.mean) AS d, coalesce(ps, 0) AS sd
        FROM mm m JOIN mm b ON b.variant = 'clean' AND b.init = m.init AND b.train_variant = m.train_variant AND m.variant <> 'clean'
        LEFT JOIN (SELECT r.init, r.train_variant, r.variant, count(*) AS n_pairs, avg(r.test_iou_water - c.test_iou_water) AS pd, stddev_samp(r.test_iou_water - c.test_iou_water) AS ps
                   FROM run_cells r JOIN run_cells c ON c.variant = 'clean' AND c.init = r.init AND c.train_variant = r.train_variant AND c.seed = r.seed GROUP BY ALL) p
        ON p.init = m.init AND p.train_variant = m.train_variant AND p.variant = m.variant)""", {"mm": "SELECT init, train_variant, variant, avg(test_iou_water) AS mean FROM run_cells GROUP BY ALL"}))
def paired_seed_delta(spark, sf):
    p = R.paired_seed_delta(A.run_cells(spark, sf))
    return p.select("init", "train_variant", "variant", "n_pairs", rnd("delta").alias("delta"), rnd("sd").alias("sd"), rnd(F.coalesce("ratio", F.lit(-1.0)), 4).alias("ratio"), "verdict")


@query("custom_order", with_ctes("run_cells", f"""
    SELECT init, train_variant, variant, seed, row_number() OVER (ORDER BY init <> 'distilled', list_position({LADDER!r}, train_variant), list_position({LADDER!r}, variant), seed) AS place FROM run_cells"""))
def custom_order(spark, sf):
    """Ladder order; the place (by the same keys, on a small table) makes it part of the result."""
    from pyspark.sql import Window

    o = R.custom_order(A.run_cells(spark, sf).select("init", "train_variant", "variant", "seed"))
    w = Window.partitionBy(F.lit(0)).orderBy(F.col("init") != "distilled", R.variant_position(F.col("train_variant")), R.variant_position(F.col("variant")), "seed")
    return o.withColumn("place", F.row_number().over(w).cast("long"))


@query("sweep_ranking", f"""
    SELECT shots, event_type, count(value) AS count, {r('avg(value)')} AS mean, {r('coalesce(stddev_samp(value), 0)')} AS std, {r('max(value)')} AS max FROM (
        SELECT CASE WHEN user_id % 4 = 0 THEN 'none' ELSE 'n' || (user_id % 4) END AS shots, event_type, value FROM events) GROUP BY ALL""")
def sweep_ranking(spark, sf):
    """Runs without a shot count form a group of their own."""
    e = A.table(spark, sf, "events")
    m = F.col("user_id") % 4
    shots = F.when(m != 0, F.concat(F.lit("n"), m.cast("string")))
    s = R.sweep_ranking(e.select(shots.alias("shots"), "event_type", "value"), ["shots", "event_type"], "value")
    return A.rounded(s.select(F.coalesce("shots", F.lit("none")).alias("shots"), "event_type", "count", "mean", F.coalesce("std", F.lit(0.0)).alias("std"), "max"))


@query("job_status_summary", f"""
    WITH l AS (SELECT event_type, string_agg(split || '=' || status || ':' || k, ',' ORDER BY split) AS runs FROM (
        SELECT event_type, 'split' || (user_id % 3) AS split, arg_max(CASE WHEN k < 80 THEN 'done' WHEN k < 90 THEN 'skipped' ELSE 'failed' END, event_id) AS status, arg_max(k, event_id) AS k
        FROM (SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events) GROUP BY ALL) GROUP BY event_type)
    SELECT event_type AS variant, count(*) FILTER (WHERE k < 80) AS done, count(*) FILTER (WHERE k BETWEEN 80 AND 89) AS skipped, count(*) FILTER (WHERE k >= 90) AS failed, {r('sum(value)', 3)} AS seconds,
           sum(k)::BIGINT AS n_files, any_value(runs) AS runs FROM (SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events) JOIN l USING (event_type) GROUP BY event_type""")
def job_status_summary(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    status = F.when(k < 80, "done").when(k < 90, "skipped").otherwise("failed")
    split = F.concat(F.lit("split"), (F.col("user_id") % 3).cast("string"))
    j = A.table(spark, sf, "events").select(F.col("event_type").alias("variant"), split.alias("split"), status.alias("status"), F.col("value").alias("seconds"), k.alias("n_files"), "event_id")
    listed = F.array_join(F.transform(F.map_entries("runs"), lambda e: F.concat(e["key"], F.lit("="), e["value"]["status"], F.lit(":"), e["value"]["n_files"].cast("string"))), ",")
    return A.rounded(R.job_status_summary(j, at="event_id").withColumn("runs", listed), 3)


_WELCH = {"w": """SELECT metric, count(*) FILTER (WHERE run = 'view') AS n_a, count(*) FILTER (WHERE run = 'error') AS n_b, avg(value) FILTER (WHERE run = 'view') AS mean_a, avg(value) FILTER (WHERE run = 'error') AS mean_b,
    var_samp(value) FILTER (WHERE run = 'view') / count(*) FILTER (WHERE run = 'view') AS va, var_samp(value) FILTER (WHERE run = 'error') / count(*) FILTER (WHERE run = 'error') AS vb
    FROM run_curve WHERE epoch >= 8 GROUP BY metric"""}


def _warm(spark, sf):
    return curve(spark, sf).where(F.col("epoch") >= C.WARMUP_EPOCHS)


@query("welch_ttest", with_ctes("run_curve", f"""
    SELECT metric, n_a, n_b, {r('mean_a')} AS mean_a, {r('mean_b')} AS mean_b, {r('CASE WHEN va + vb > 0 THEN (mean_a - mean_b) / sqrt(va + vb) END')} AS t,
           {r('CASE WHEN va + vb > 0 THEN (va + vb) ** 2 / (va ** 2 / (n_a - 1) + vb ** 2 / (n_b - 1)) END', 4)} AS dof FROM w""", _WELCH))
def welch_ttest(spark, sf):
    w = T.welch_ttest(_warm(spark, sf), "view", "error", with_p=False)
    return w.select("metric", "n_a", "n_b", *[rnd(c).alias(c) for c in ("mean_a", "mean_b", "t")], rnd("dof", 4).alias("dof"))


@query("welch_ttest_pvalue")
def welch_ttest_pvalue(spark, sf):
    """The tail probability has no SQL form; it is checked against tabulated values in tests."""
    return T.welch_ttest(_warm(spark, sf), "view", "error")


_WIL = {"dd": "SELECT a_red - b_blue AS d FROM pixels_wide WHERE a_red <> b_blue", "rr": "SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0::DOUBLE AS rk, (count(*) OVER (PARTITION BY abs(d)))::DOUBLE AS t FROM dd",
        "ss": "SELECT count(*) AS n, sum(rk) FILTER (WHERE d > 0) AS w_plus, sum(rk) FILTER (WHERE d < 0) AS w_minus, sum(t * t - 1) AS ties FROM rr"}


@query("wilcoxon_signed_rank", with_ctes("pixels_wide", f"""
    SELECT n, w_plus, w_minus, least(w_plus, w_minus) AS statistic,
           {r('(least(w_plus, w_minus) - n::DOUBLE * (n + 1) / 4) / sqrt(n::DOUBLE * (n + 1) * (2 * n + 1) / 24 - ties / 48)', 4)} AS z FROM ss""", _WIL))
def wilcoxon_signed_rank(spark, sf):
    w = T.wilcoxon_signed_rank(A.pixels_wide(spark, sf), "a_red", "b_blue", with_p=False)
    return w.select("n", "w_plus", "w_minus", "statistic", rnd("z", 4).alias("z"))
