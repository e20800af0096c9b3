"""Rows of one task stay near the set number, whatever the size of the archive."""

import pytest
from pyspark.sql import functions as F

from lumenfield.operators import stencil, volume
from lumenfield.plans import QUERIES


def most_rows(df):
    return max(r[0] for r in df.groupBy(F.spark_partition_id()).agg(F.count("*")).select("count(1)").collect())


def test_tiles(spark, monkeypatch):
    monkeypatch.setattr("lumenfield.session.PART_ROWS", 4096)
    px = spark.range(64 * 4096, numPartitions=8).select(
        F.floor(F.col("id") / 4096).alias("image_id"), (F.floor(F.col("id") / 64) % 64).cast("int").alias("y"), (F.col("id") % 64).cast("int").alias("x"), F.lit(64).alias("width"), F.lit(64).alias("height"),
    )
    assert most_rows(stencil.tiles(px, (2, 2))) <= 6 * 4096


@pytest.mark.parametrize("sent", [0, 100_000])
def test_stitched_faces(spark, monkeypatch, sent):
    """Sent or joined, the taps give the same picture: depths between those of the tiles, the best pixel covered whole."""
    monkeypatch.setattr(volume, "SENT", sent)
    got = QUERIES["vv1_stitch_faces"](spark, "/root/testdata/sf0.001").orderBy("image_id", "y", "x")
    n, pixels, best, total = got.agg(F.count("*"), F.count_distinct("image_id", "y", "x"), F.max("coverage"), F.sum("depth_m")).first()
    monkeypatch.setattr("lumenfield.session.PART_ROWS", 1000)
    again = QUERIES["vv1_stitch_faces"](spark, "/root/testdata/sf0.001").agg(F.count("*"), F.sum("depth_m")).first()
    assert n == pixels == again[0] > 0 and best == 1.0 and again[1] == pytest.approx(total, rel=1e-9)


def test_window_distance_rows_that_meet_their_picture_follow_a_count(spark, monkeypatch):
    from lumenfield import session
    from lumenfield.operators import ranking, volume

    px = spark.range(3 * 400).selectExpr(
        "id % 3 image_id", "cast(id div 60 as int) y", "cast(id % 60 as int) x", "0.2 + (id % 7) / 10D dy", "2D + (id * 37 % 101) / 20D depth_m", "1D + (id * 37 % 101) / 20D ref_m",
        "id % 3 = 0 or id % 2 = 0 inside", "id % 3 = 0 outside", "id % 3 = 1 near_window")
    usual = sorted(volume.window_distance(px).collect())
    q = spark.createDataFrame([(i, 1.0) for i in range(3)], "image_id long, v double")
    sent = volume._of_picture(px, q, ["image_id"])
    assert "BroadcastHashJoin" in sent._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(ranking, "SENT", 0)
    monkeypatch.setattr(session, "PART_ROWS", 10)
    dealt = volume._of_picture(px, q, ["image_id"])
    assert "REPARTITION_BY_NUM" in dealt._jdf.queryExecution().executedPlan().toString() and dealt.rdd.getNumPartitions() >= 120
    assert sorted(dealt.collect()) == sorted(sent.collect())
    monkeypatch.setattr(session, "PART_ROWS", 300)
    assert sorted(volume.window_distance(px).collect()) == usual and len(usual) == 3
