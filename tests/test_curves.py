"""Integrals of curves: the same as resampling and integrating row by row, without a row per wavelength."""

from pyspark.sql import functions as F

from lumenfield.operators import calibrate as K
from lumenfield.plans import QUERIES


def test_integrals_equal_those_row_by_row(spark):
    knots = {1: [(380.0, 1.0), (420.0, 3.0), (500.0, 2.0), (505.0, 2.0), (640.0, 0.0)], 2: [(400.0, 1.0), (401.0, 5.0)], 3: [(450.0, 1.0)], 4: [(700.0, 1.0), (800.0, 2.0)],
             5: [(390.0, 1.0), (450.0, None), (500.0, 2.0), (600.0, 4.0), (640.0, 1.0)], 6: [(500.5, 1.0), (500.9, 2.0)]}
    curve = spark.createDataFrame([(k, x, v) for k, rows in knots.items() for x, v in rows], "curve int, nm double, v1 double").repartition(3)
    grid = spark.range(385, 640, 3).select(F.col("id").cast("double").alias("nm"))
    resp = grid.select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("receptor"), "nm", F.when(F.col("receptor") == "a", F.sin("nm") + 2).otherwise(F.nullif(F.col("nm"), F.lit(520.0))).alias("v1"))
    want = {(r[0], r[1]): r[2] for r in K.spectral_integral(K.resample_curve(curve, grid, ["curve"]), resp, ("curve", "receptor")).collect()}
    got = {(r[0], r[1]): r[2] for r in K.curve_integral(curve, resp, ("curve", "receptor")).collect()}
    assert got.keys() == want.keys() and {k for k, _ in got} == {1, 2, 5}
    for k, v in want.items():
        assert (v is None) == (got[k] is None) and (v is None or abs(got[k] - v) <= 1e-9 * abs(v))


def test_no_row_per_curve_and_wavelength_is_made(spark):
    plan = QUERIES["co10_spectral_integration"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1  # the given points of the curves
