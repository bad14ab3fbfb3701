"""Every table of a report in one result: a row per table, key and measure.

The SQL of a table is that of its own query, over the same rows as the report's.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...operators import splits
from ...session import stored
from .. import adapters as A
from .. import registry, reports
from ..adapters import r, rnd, with_ctes
from ..registry import query
from . import datasets, experiments
from .pairs import SPLIT_CTES


@dataclass(frozen=True)
class Shape:
    """How one table of a report enters the result: its keys, its measures with their digits, and its SQL."""

    name: str
    keys: Sequence[str]
    measures: dict[str, int]
    sql: str
    fix: Callable[[DataFrame], DataFrame] = lambda df: df

    def rows(self, tables: dict[str, DataFrame]) -> DataFrame:
        df = self.fix(tables[self.name])
        key: Column = F.concat_ws("|", *[F.col(k).cast("string") for k in self.keys]) if self.keys else F.lit("")
        cells = F.array(*[F.struct(F.lit(m).alias("measure"), rnd(F.col(m).cast("double"), d).alias("value")) for m, d in self.measures.items()])
        return df.select(F.lit(self.name).alias("part"), key.alias("key"), F.explode(cells).alias("c")).select("part", "key", "c.*")

    def select(self) -> str:
        key = f"concat_ws('|', {', '.join(f'{k}::VARCHAR' for k in self.keys)})" if self.keys else "''"
        measures, values = (", ".join(x) for x in ([f"'{m}'" for m in self.measures], [r(f'"{m}"', d) for m, d in self.measures.items()]))
        return f"SELECT '{self.name}' AS part, {key} AS key, unnest([{measures}]) AS measure, unnest([{values}]) AS value FROM ({self.sql})"


def whole(shapes: Sequence[Shape], tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for s in shapes:
        out = s.rows(tables) if out is None else out.unionByName(s.rows(tables))
    return out


def whole_sql(shapes: Sequence[Shape]) -> str:
    return " UNION ALL ".join(f"({s.select()})" for s in shapes)


def _own(name: str) -> str:
    return registry.ORACLE[name]


def _over(name: str, adapter: str, table: str, extra: dict[str, str], base: str = "") -> str:
    """A query's SQL with ``adapter`` taken from another table of the same columns."""
    prefix = with_ctes(adapter, "")
    body = registry.ORACLE[name]
    assert body.startswith(prefix.rstrip()), name
    return with_ctes(base or adapter, body[len(prefix):].replace(f"FROM {adapter}", f"FROM {table}"), extra)


SENSOR = [
    Shape("domain_stats", ["view", "band"], {"mean": 4, "std": 4, "clip": 3}, _own("domain_stats")),
    Shape("spectral_stats", ["view", "band"], {c: 3 for c in ("mean", "std", "min", "p2", "median", "p98", "max", "sqrt_mean", "sqrt_std", "pct_zero", "pct_at_4095")}, _own("spectral_stats_table")),
    Shape("boxes", ["view", "band"], {c: 4 for c in ("q1", "median", "q3", "whisker_low", "whisker_high")}, _own("box_stats")),
    Shape("boxes_standardised", ["view", "band"], {c: 4 for c in ("q1", "median", "q3", "whisker_low", "whisker_high")}, _own("box_stats_standardised")),
    Shape("signature", ["view", "band"], {"signature": 4}, _own("spectral_signature")),
    Shape("transfer", ["band"], {"slope": 6, "intercept": 4, "pearson": 6, "spearman": 6}, _own("sensor_transfer_fit")),
    Shape("correspondence", ["stored", "reference", "is_best"], {"rho": 6}, _own("band_correspondence"), lambda d: d.withColumn("stored", F.substring("stored", 3, 20)).withColumn("reference", F.substring("reference", 3, 20))),
    Shape("histogram", ["view", "bin"], {"n": 0, "left": 3, "right": 3, "density": 9}, _own("value_histogram_log")),
]


@query("sensor_report_tables", whole_sql(SENSOR))
def sensor_report_tables(spark, sf):
    t = reports.sensor_report(A.pixels_long(spark, sf), A.pixels_wide(spark, sf), {b: (f"a_{b}", f"b_{b}") for b in A.BANDS}, 50)
    return whole(SENSOR, t)


_KEPT = {**SPLIT_CTES, "kp": f"SELECT * FROM sp WHERE {datasets._BAD_SQL}"}


def _kept(name: str) -> str:
    return _over(name, "manifest", "kp", _KEPT)


DATASET = [
    Shape("summary", ["first_date", "last_date"], {c: 4 for c in (
        "patches_in_manifest", "patches", "products", "patches_per_product_median", "patches_per_product_max", "delta_days_median", "delta_days_mean", "delta_days_max", "pct_under_5pct_cloud",
        "unlabelled_pixel_pct", "n_train", "n_val", "n_test", "leaked_products", "test_products", *[f"prior_{c}" for c in datasets.CODES])}, datasets.SUMMARY_SQL, datasets.flat_summary),
    Shape("lags", ["bin_start"], {"n": 0, "lag_median": 6, "lag_max": 6}, _kept("lag_histogram")),
    Shape("months", ["month", "first_month", "last_month"], {"n": 0, "months": 0}, _kept("monthly_coverage")),
    Shape("cloud_ecdf", ["variable", "value"], {"share": 6}, f"SELECT * FROM ({_kept('ecdf')}) WHERE variable <> 'patch_delta_days'", lambda d: d.withColumn("value", rnd("value"))),
    Shape("prior", ["code"], {"pct": 6}, _kept("class_prior")),
    Shape("prior_by_split", ["split", "code"], {"pct": 6}, with_ctes("manifest", " UNION ALL ".join(f"SELECT split, {c} AS code, avg(wc_frac_{c}) * 100 AS pct FROM kp GROUP BY split" for c in datasets.CODES), _KEPT)),
    Shape("dominant", ["position", "code"], {"n": 0, "median_dominance": 6}, _kept("dominant_counts")),
    Shape("geography", ["cell_x", "cell_y"], {"n": 0}, _kept("density_grid").replace("/ 10.0), 35)", "/ 5.0), 71)").replace("/ 10.0), 17)", "/ 5.0), 35)")),
    Shape("climate", ["climate_group"], {"n": 0, "pct": 6}, _kept("climate_counts")),
    Shape("under_5pct_cloud", [], {"pct_below": 6}, _kept("pct_below")),
    Shape("group_sizes", [], {"groups": 0, "median_size": 6, "largest": 0}, _kept("group_sizes")),
    Shape("leakage", [], {"shared": 0, "total": 0}, with_ctes("manifest", """
        SELECT count(*) FILTER (WHERE product_id IN (SELECT product_id FROM kp WHERE split = 'train')) AS shared, count(*) AS total FROM (SELECT DISTINCT product_id FROM kp WHERE split = 'test')""", _KEPT)),
]


@query("dataset_report_tables", whole_sql(DATASET))
def dataset_report_tables(spark, sf):
    m = splits.random_split(stored(A.manifest(spark, sf), "manifest"), ["patch_index"])
    return whole(DATASET, reports.dataset_report(m, datasets.BAD, [*datasets.CODES, 40]))


# the flattened records under the names that the queries over cells use
_FLAT = {"f": """SELECT CASE WHEN seed = 2 THEN CASE WHEN init = 'scratch' THEN 'random' ELSE 'pretrained' END ELSE init END AS init, train_variant, variant, seed, test_iou, test_iou_water, NULL::DOUBLE AS severity
    FROM run_cells WHERE seed <> 0 OR variant = train_variant"""}


def _flat(name: str) -> str:
    body = registry.ORACLE[name].removeprefix(with_ctes("run_cells", "").rstrip()).lstrip(" ,")
    body = body.replace("FROM run_cells", "FROM f").replace("JOIN run_cells", "JOIN f")
    ctes = with_ctes("run_cells", "", _FLAT).rstrip()
    return f"{ctes}, {body}" if body.startswith("mm AS") else f"{ctes} {body}"


LADDER = [
    Shape("results", ["tag", "train_variant", "variant"], {"test_iou": 6, "test_iou_water": 6}, _own("flatten_run_records")),
    Shape("summary", ["init", "train_variant", "variant"], {c: 6 for c in ("n_seeds", "mean", "std", "min", "max", "mean_test_iou")}, _flat("ladder_summary")),
    Shape("deltas", ["init", "train_variant", "variant", "verdict"], {"n_pairs": 0, "delta": 6, "sd": 6, "ratio": 4}, _flat("paired_seed_delta"), lambda d: d.withColumn("ratio", F.coalesce("ratio", F.lit(-1.0)))),
]


@query("ladder_report_tables", whole_sql(LADDER))
def ladder_report_tables(spark, sf):
    return whole(LADDER, reports.ladder_report(experiments.run_records(spark, sf)))


_LONGEST = {"longest": """SELECT run, epoch, metric, max(value) AS value FROM run_history SEMI JOIN (
    SELECT run, attempt FROM (SELECT run, attempt, count(DISTINCT epoch) AS epochs FROM run_history GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY run ORDER BY epochs DESC, attempt) = 1)
    USING (run, attempt) GROUP BY ALL"""}


def _longest(name: str) -> str:
    body = registry.ORACLE[name].removeprefix(with_ctes("run_curve", "").rstrip()).lstrip(" ,").replace("FROM run_curve", "FROM longest")
    ctes = with_ctes("run_history", "", _LONGEST).rstrip()
    return f"{ctes}, {body}" if body.startswith("w AS") else f"{ctes} {body}"


COMPARISON = [
    Shape("summary", ["run"], {c: 6 for c in ("epochs", "best_value", "best_epoch", *[f"{m}_{s}" for m in experiments.METRICS for s in ("mean", "sd")])}, _longest("run_summary")),
    Shape("curves", ["run", "epoch"], {c: 6 for c in ("iou", "gap", "iou_change", "gap_change")}, _longest("metric_curve"), lambda d: d.fillna(0.0, ["iou_change", "gap_change"])),
    Shape("tests", ["metric"], {"n_a": 0, "n_b": 0, "mean_a": 6, "mean_b": 6, "t": 6, "dof": 4}, _longest("welch_ttest")),
]


@query("run_comparison_tables", whole_sql(COMPARISON))
def run_comparison_tables(spark, sf):
    return whole(COMPARISON, reports.run_comparison(A.run_history(spark, sf), experiments.METRICS, "iou", "view", "error"))
