"""Streams over an event table of many files: a part of the arriving frames may then be written as many files as well."""

import pytest

from lumenfield.plans import ORACLE, QUERIES
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["st1_brackets_stream", "st2_sliding_stream", "st3_late_frames"])
def test_parts_of_many_files(spark, tmp_path, name):
    spark.read.parquet(f"{SF}/events.parquet").repartition(8).write.parquet(f"{tmp_path}/events.parquet")
    message, _, rows = compare(spark, connect(SF), name, lambda s, _: QUERIES[name](s, str(tmp_path)), ORACLE[name], SF)
    assert message == ""
    assert rows > 0
