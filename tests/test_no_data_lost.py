"""Rows that earlier versions dropped without a word."""

from pyspark.sql import functions as F

from skydrift.operators import pairing
from skydrift.sources import scans


def test_history_of_any_depth(spark):
    lines = spark.createDataFrame([('{"epoch": 3, "a": 1, "val": {"iou": 0.5, "cls": {"water": {"f1": 0.7}}}}',)], "_line string")
    got = {(r.epoch, r.metric, r.value) for r in scans.flatten_history(lines).collect()}
    assert got == {(3, "a", 1.0), (3, "val.iou", 0.5), (3, "val.cls.water.f1", 0.7)}


def test_file_without_irradiance_gets_defaults(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<m><SOLAR_IRRADIANCE bandId="0">10.5</SOLAR_IRRADIANCE></m>')
    (tmp_path / "b.xml").write_text("<m><other>1</other></m>")
    irr, _ = scans.scan_scene_xml(spark, str(tmp_path), {"0": 1.0, "1": 2.0})
    got = {(r.path.rsplit("/", 1)[-1], r.band_id, r.irradiance) for r in irr.collect()}
    assert got == {("a.xml", 0, 10.5), ("a.xml", 1, 2.0), ("b.xml", 0, 1.0), ("b.xml", 1, 2.0)}


def test_long_ids_stay(spark):
    inputs = spark.createDataFrame([("1234567890123456_S2Hand.tif",)], "name string")
    out = pairing.processing_status(inputs, inputs.select(F.concat(F.lit("simulated_"), "name").alias("name"), F.lit("p").alias("path"))).first()
    assert out.simulation_status == "SUCCESS" and out.product_id == 1234567890123456
