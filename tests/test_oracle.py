"""Spark against DuckDB at the smallest scale. LUMENFIELD_ALL=1 runs every registered query."""

import os

import pytest

from lumenfield.plans import ORACLE, QUERIES
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
SOME = """capture_summary co1_matrix co4_luminance co9_equivalent_luminance ge1_crop_shift_lift ge6_quad_solid_angle ge9_position_index ge13_rotate
ge16_calibrated_lens ge20_resample ge21_vignetting_table ge24_polygon_mask rg2_circle rg6_band rg11_mask_union rg14_iou ag2_median ag3_paired_percentile
ag6_row_profile ag8_ranked_list ag9_luminance_distribution ag11_tail_table ag17_rollup br5_validate br8_normalise br14_merge_pixel
br15_merge_neighbourhood br19_bad_pixels br21_interpolate_colours hd1_describing_values hd6_luminance_weights io2_decode_pictures io12_rgbe_round_trip
gl6_group_sources gl9_split_peaks gl14_dgp gl22_contributions nb1_box_mean nb3_gaussian cv3_view_summary ca2_chain_sequences ca8_fit_matrix
ca10_candidate_table vv5_category_summary gz2_adaptation su4_sun_position su6_blend st1_brackets st2_window_stats""".split()
NAMES = list(ORACLE) if os.environ.get("LUMENFIELD_ALL") else SOME


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, con, name):
    message, _, rows = compare(spark, con, name, QUERIES[name], ORACLE[name], SF)
    assert message == ""
    assert rows > 0


def test_every_check_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
    assert set(SOME) <= set(ORACLE)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 8
