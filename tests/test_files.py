"""Input lists, heads of large files and the sink for named files."""

import io
import json

import pytest
from pyspark.sql import functions as F

from lumenfield.sources import files as FI
from lumenfield.sources import pictures as P

HEAD = b"#?RADIANCE\nEXPOSURE=2\n\n-Y 3 +X 5\n"


class Counting(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        piece = super().read(n)
        self.taken += len(piece)
        return piece


@pytest.mark.parametrize("head", [HEAD, b"#?RADIANCE\n" + b"NOTE= " + b"x" * 100_000 + b"\n\n-Y 3 +X 5\n", b"a" * (FI.CHUNK - 1) + b"\n\n-Y 3 +X 5\n", b"a" * (FI.CHUNK - 14) + b"\n\n-Y 3 +X 5\n"])
def test_reading_stops_behind_the_header(head):
    file = Counting(head + b"\0" * 5_000_000)
    assert FI.read_head(file).startswith(head)
    assert file.taken <= len(head) + 2 * FI.CHUNK
    assert FI.parse_head(FI.read_head(io.BytesIO(head)))[1:] == (5, 3, None)


def test_heads_without_end_or_size():
    assert FI.parse_head(FI.read_head(io.BytesIO(b"#?RADIANCE\nEXPOSURE=1")))[3] == "no blank line after the header"
    assert FI.parse_head(FI.read_head(io.BytesIO(b"")))[3] == "no blank line after the header"
    file = Counting(b"#?RADIANCE\n\n" + b"\0" * 5_000_000)
    assert FI.parse_head(FI.read_head(file))[3] == "no size line" and file.taken < 5 * FI.CHUNK


def test_a_large_picture_costs_its_head(spark, tmp_path):
    FI.register(spark)
    path = tmp_path / "large.hdr"
    with path.open("wb") as f:
        f.write(HEAD)
        f.truncate(300 << 30)  # sparse; more than any task could hold
    r = spark.read.format("picture_headers").load(str(path)).first()
    assert (r.length, r.header_lines, r.width, r.height, r.problem) == (300 << 30, ["#?RADIANCE", "EXPOSURE=2"], 5, 3, None)
    assert P.header_scan(P.list_inputs(spark, [str(path)])).first().width == 5


@pytest.fixture
def folder(tmp_path):
    for name in ["a_000", "a_001", "a_002", "a_004", "a_1", "a_copy", "b1", "b2", "b3", "b5", "[c]", "d%d", "100%", "e-1", "e0", "g2", "g3"]:
        (tmp_path / f"{name}.hdr").write_bytes(HEAD)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a_000.hdr").write_bytes(HEAD)
    return tmp_path


CASES = {
    "a_%03d.hdr": ["a_000", "a_001", "a_002"], "b%d.hdr": ["b1", "b2", "b3"], "[c].hdr": ["[c]"], "d%d.hdr": ["d%d"], "100%.hdr": ["100%"], "e%d.hdr": ["e0"],
    "a_0*.hdr": ["a_000", "a_001", "a_002", "a_004"], "[bg]?.hdr": ["b1", "b2", "b3", "b5", "g2", "g3"], "sub": ["sub/a_000"],
}


@pytest.mark.parametrize("pattern", CASES)
def test_input_lists(spark, folder, pattern):
    want = [f"{folder}/{n}.hdr" for n in CASES[pattern]]
    assert FI.expand([f"{folder}/{pattern}"]) == want
    listed = P.list_inputs(spark, [f"{folder}/{pattern}"]).orderBy("path").collect()
    assert sorted(FI.store(r.path)[1] for r in listed) == want


@pytest.mark.parametrize("pattern", ["g%d.hdr", "none*.hdr", "none.hdr", "a_%02d.hdr", "%d_%d.hdr"])
def test_inputs_without_files(spark, folder, pattern):
    inputs = [f"{folder}/b1.hdr", f"{folder}/{pattern}"]
    with pytest.raises(ValueError, match="no input files"):
        FI.expand(inputs)
    with pytest.raises(ValueError, match="no input files"):
        P.list_inputs(spark, inputs)
    with pytest.raises(ValueError, match="no input files"):
        FI.expand([])


def test_many_files_are_dealt_to_tasks(spark, tmp_path):
    FI.register(spark)
    spark.range(500).select(F.format_string("f%d.hdr", "id").alias("name"), F.lit(HEAD).alias("content")).write.format("named_files").mode("append").save(str(tmp_path))
    paths = json.dumps([f"{tmp_path}/f%d.hdr"])
    df = spark.read.format("picture_headers").option("paths", paths).option("filesPerPartition", 64).load()
    assert df.select(F.spark_partition_id()).distinct().count() == 8
    assert df.where("width = 5").count() == 500
    assert not list(tmp_path.glob("_staging*"))


def test_named_files_are_all_or_nothing(spark, tmp_path):
    FI.register(spark)
    write = lambda rows, mode: spark.createDataFrame(rows, "name string, content binary").write.format("named_files").mode(mode).save(str(tmp_path))
    write([("x/1.hdr", b"one"), ("2.hdr", None)], "append")
    assert (tmp_path / "x/1.hdr").read_bytes() == b"one" and (tmp_path / "2.hdr").read_bytes() == b""
    for bad in ([("3.hdr", b""), ("3.hdr", b"")], [("4.hdr", b""), ("../5.hdr", b"")], [("6.hdr", b""), (None, b"")]):
        with pytest.raises(Exception, match="file name|not a file name"):
            write(bad, "append")
    assert sorted(FI.expand([str(tmp_path)])) == [f"{tmp_path}/2.hdr", f"{tmp_path}/x/1.hdr"]
    write([("7.hdr", b"x")], "overwrite")
    assert FI.expand([str(tmp_path)]) == [f"{tmp_path}/7.hdr"]


def test_scanline_that_ends_early():
    with pytest.raises(ValueError, match="ends early"):
        list(P.scanlines(b"#?RADIANCE\n\n-Y 1 +X 64\n\x02\x02\x00\x40\x85\x01"))
