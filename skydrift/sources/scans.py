"""Readers: pixels, manifests, split lists, run logs, file listings, scene metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas


def scan_patch_bands(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PATCH_BANDS).parquet(path)


def _date(col: str):
    """Dates that cannot be read become null."""
    return F.try_to_timestamp(F.col(col)).cast("date").alias(col)


def scan_manifest(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, header=True, schema=schemas.MANIFEST, mode="PERMISSIVE")
    return raw.select(*[_date(c) if c in ("date_phi", "date_s2b") else F.col(c) for c in raw.columns])


def scan_split_list(spark: SparkSession, path: str) -> DataFrame:
    """``s1,label`` rows, or one stem per line; blank lines are dropped."""
    t = spark.read.text(path).select(F.trim("value").alias("line")).where(F.col("line") != "")
    parts = F.split("line", ",")
    two = F.size(parts) >= 2
    return t.select(
        F.when(two, F.trim(parts[0])).alias("s1_file"), F.when(two, F.trim(F.get(parts, F.lit(1)))).alias("label_file"),
        F.when(~two, F.col("line")).alias("stem"),
    )


def scan_run_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Readable JSON records (one per file), and the files that are not readable.

    Files are small, so each is one row of text; a record that does not parse
    keeps its text in the corrupt column.
    """
    t = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    opts = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    r = t.select("path", F.from_json("value", schemas.RUN_RECORD, opts).alias("r")).select("path", "r.*")
    return r.where(F.col("_corrupt").isNull()).drop("_corrupt"), r.where(F.col("_corrupt").isNotNull()).select("path", "_corrupt")


def scan_run_history(spark: SparkSession, path: str) -> DataFrame:
    """Ragged metric rows, one JSON object per line, as (run, attempt, epoch, metric, value).

    Nested keys are joined with a dot; numbers stay, booleans and texts go.
    The run and attempt are the folder and file names.
    """
    lines = spark.read.text(path).select(
        F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1).alias("run"),
        F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]+)?$", 1).alias("attempt"),
        F.col("value").alias("_line"),
    )
    return flatten_history(lines)


def flatten_history(lines: DataFrame) -> DataFrame:
    """Metric rows from JSON objects in column ``_line``; nested keys are joined by dots, to any depth."""
    top = lines.withColumn("_m", F.from_json("_line", "map<string,string>"))
    keep = [c for c in lines.columns if c != "_line"]
    epoch = F.try_element_at("_m", F.lit("epoch")).try_cast("double").cast("int")
    rows = top.select(*keep, epoch.alias("epoch"), F.explode("_m").alias("metric", "_v")).where(F.col("metric") != "epoch")
    flat, nested = rows.where(~F.col("_v").startswith("{")), rows.where(F.col("_v").startswith("{"))
    while not nested.isEmpty():  # once per level that the objects have
        rows = nested.select(*keep, "epoch", "metric", F.explode(F.from_json("_v", "map<string,string>")).alias("_k", "_v"))
        rows = rows.select(*keep, "epoch", F.concat_ws(".", "metric", "_k").alias("metric"), "_v")
        flat, nested = flat.unionByName(rows.where(~F.col("_v").startswith("{"))), rows.where(F.col("_v").startswith("{"))
    return flat.select(*keep, "epoch", "metric", F.col("_v").try_cast("double").alias("value")).where(F.col("value").isNotNull())


def list_files(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """File inventory; only the listing is read, never the content."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return f.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length")


def scan_geojson(spark: SparkSession, path: str) -> DataFrame:
    """One row per feature: properties and its point, where it has one."""
    fc = spark.read.schema(schemas.FEATURE_COLLECTION).json(path, multiLine=True)
    f = fc.select(F.explode("features").alias("f"))
    return f.select(
        F.col("f.properties").alias("properties"), F.get(F.col("f.geometry.coordinates"), F.lit(0)).alias("lon"),
        F.get(F.col("f.geometry.coordinates"), F.lit(1)).alias("lat"),
    )


def scan_scene_xml(spark: SparkSession, path: str, defaults: dict[str, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """Solar irradiance by band, and the rows of the sun-zenith grid, per file.

    ``defaults`` fills bands a file does not state, of every file.
    """
    schema = "_bandId INT, _VALUE DOUBLE"
    irr = spark.read.format("xml").option("rowTag", "SOLAR_IRRADIANCE").schema(schema).load(path)
    irr = irr.select(F.input_file_name().alias("path"), F.col("_bandId").alias("band_id"), F.col("_VALUE").alias("irradiance"))
    if defaults:
        files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path")).distinct()  # those that state nothing as well
        known = F.explode(F.create_map(*[F.lit(x) for k, v in defaults.items() for x in (int(k), float(v))]))
        grid = files.select("path", known.alias("band_id", "_default"))
        irr = grid.join(irr, ["path", "band_id"], "left").select("path", "band_id", F.coalesce("irradiance", "_default").alias("irradiance"))
    zen = spark.read.format("xml").option("rowTag", "Sun_Angles_Grid").schema("Zenith STRUCT<Values_List: STRUCT<VALUES: ARRAY<STRING>>>").load(path)
    rows = zen.select(F.input_file_name().alias("path"), F.posexplode("Zenith.Values_List.VALUES").alias("row", "_t"))
    cells = F.transform(F.split(F.trim("_t"), r"\s+"), lambda s: s.try_cast("double"))
    return irr, rows.select("path", "row", F.posexplode(cells).alias("col", "zenith"))


def scan_scene_metadata_json(spark: SparkSession, path: str) -> DataFrame:
    """``<id>_..._metadata.json`` files keyed by the id in their name."""
    m = spark.read.schema(schemas.SCENE_METADATA).json(path, multiLine=True)
    return m.select(F.regexp_extract(F.input_file_name(), r"(?:^|[/=])([^/_=]+)_[^/]*metadata\.json", 1).alias("scene_id"), "*")


def read_drift_reports(spark: SparkSession, path: str) -> DataFrame:
    """Reports in the summary form or the older per-file form; unknown fields are ignored."""
    r = spark.read.schema(schemas.DRIFT_REPORT).json(path)
    mean = lambda n: F.aggregate(
        F.transform("results", lambda s: s[n]), F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size("results"), F.lit(0))
    return r.select(
        *[c for c in r.columns if c not in ("results", "pairs_processed", "avg_cosine_similarity", "avg_mse_error", "avg_mae_error", "avg_pixel_max_diff")],
        F.coalesce("pairs_processed", F.when(F.col("results").isNotNull(), F.size("results")).cast("long")).alias("pairs_processed"),
        F.coalesce("avg_cosine_similarity", mean("cosine_similarity")).alias("avg_cosine_similarity"),
        F.coalesce("avg_mse_error", mean("mse_error")).alias("avg_mse_error"),
        F.coalesce("avg_mae_error", mean("mae_error")).alias("avg_mae_error"),
        F.coalesce("avg_pixel_max_diff", mean("pixel_max_diff")).alias("avg_pixel_max_diff"),
    )


def load_normalization(spark: SparkSession, path: str) -> DataFrame:
    """(band, mean, std) from a ``{band: {mean, std}}`` file."""
    m = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,struct<mean:double,std:double>>").alias("m"))
    return m.select(F.explode("m").alias("band", "s")).select("band", "s.mean", "s.std")


def load_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """Cached embeddings; filters on domain and layer prune folders."""
    return spark.read.schema("item_id BIGINT, embedding ARRAY<FLOAT>, domain STRING, layer INT").parquet(path)
