"""Queries against their SQL on pictures that the smallest scale lacks: sources whose centroid leaves the circle, and partly captured pictures."""

import duckdb
import pytest

from lumenfield.plans import ORACLE, QUERIES
from tests.oracle_check import compare, connect

GLARE = "gl12_locate gl13_background gl15_dgi gl16_ugr gl17_dgr_vcp gl18_cgi gl19_veil gl22_contributions gl26_multi_picture glare_evaluate".split()


def _pictures(folder, where):
    duckdb.sql(f"COPY (SELECT * FROM read_parquet('/root/testdata/sf0.1/embeddings.parquet') WHERE {where}) TO '{folder}/embeddings.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.fixture(scope="module")
def edge(tmp_path_factory):
    """A plain picture, two with a source whose truncated centroid lies outside the circle, and one of 16 rows."""
    return _pictures(tmp_path_factory.mktemp("edge"), "vec_id//64 IN (0, 20, 23, 31)")


@pytest.mark.parametrize("name", GLARE)
def test_sources_at_the_edge_of_the_circle(spark, edge, name):
    message, _, rows = compare(spark, connect(edge), name, QUERIES[name], ORACLE[name], edge)
    assert message == ""
    assert rows > 0


def test_every_picture_is_scanned(spark, edge):
    got = QUERIES["gl26_multi_picture"](spark, edge)
    assert {(r.image_id, r.scan) for r in got.collect()} == {(i, s) for i in (0, 20, 23, 31) for s in (0, 1)}


def test_band_of_a_picture_without_its_middle_row(spark, tmp_path):
    sf = _pictures(tmp_path, "vec_id < 64 + 31")
    message, _, rows = compare(spark, connect(sf), "rg6_band", QUERIES["rg6_band"], ORACLE["rg6_band"], sf)
    assert message == ""
    assert rows == 2
