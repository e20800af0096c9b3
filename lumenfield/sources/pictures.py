"""Picture archives: header-only scan and the ingest job that turns encoded pictures into pixel rows."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfield.sources.files import frame_pattern, head_of, parse_head

PIXEL_SCHEMA = "path string, width int, height int, y int, x int, r double, g double, b double"


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _listed(spark: SparkSession, pattern: str, suffix: str, columns: Sequence[str]) -> DataFrame:
    df = spark.read.format("binaryFile").option("pathGlobFilter", suffix).option("recursiveFileLookup", "true").load(pattern)
    return df.select(*columns)


def _frames(files: DataFrame, name: str) -> DataFrame:
    """Of the listed files those whose names are the pattern with a number, from 0, or 1 if there is no 0, up to the first gap."""
    found = frame_pattern(name)
    before, after = (re.escape(t.replace("%%", "%")) for t in (name[: found.start()], name[found.end() :]))
    base = F.element_at(F.split("path", "/"), -1)
    number = F.regexp_extract(base, f"^{before} *([-+]?[0-9]+) *{after}$", 1).try_cast("long")
    # only names that the pattern itself would write: 7 is not %03d
    same = F.format_string(name.replace("%u", "%d").replace("%i", "%d"), number) == base
    rows = files.withColumn("_n", number).where(F.col("_n").isNotNull() & same)
    ahead = rows.select((F.col("_n") - 1).alias("_n"))
    start = rows.agg(F.when(F.count_if(F.col("_n") == 0) > 0, F.lit(0)).otherwise(F.lit(1)).alias("_start"), F.count_if(F.col("_n") == 1).alias("_one"))
    ends = rows.join(ahead, "_n", "left_anti").crossJoin(start).where("_n >= _start AND (_start = 0 OR _one > 0)").agg(F.min("_start").alias("_start"), F.min("_n").alias("_last"))
    return rows.crossJoin(ends).where("_n BETWEEN _start AND _last").select(*files.columns)


def _inputs(spark: SparkSession, inputs: Sequence[str], suffix: str, columns: Sequence[str]) -> DataFrame:
    plain = lambda text: re.sub(r"([\\*?\[\]{}])", r"\\\1", text)
    out = None
    for item in inputs:
        where, path = _hadoop(spark, item)
        folder, _, name = item.rstrip("/").rpartition("/")
        found, numbered = item, frame_pattern(name)
        if where.exists(path):
            found, numbered = plain(item), None  # its signs are no pattern
        elif numbered:
            around = (plain(t.replace("%%", "%")) for t in (name[: numbered.start()], name[numbered.end() :]))
            found = (plain(folder) + "/" if folder or item.startswith("/") else "") + "*".join(around)
        if not where.globStatus(_hadoop(spark, found)[1]):
            raise ValueError(f"no input files in {item}")
        df = _listed(spark, found, suffix, columns)
        df = _frames(df, name) if numbered else df
        if df.isEmpty():
            raise ValueError(f"no input files in {item}")
        out = df if out is None else out.unionByName(df)
    if out is None:
        raise ValueError("no input files")
    return out


def list_inputs(spark: SparkSession, inputs: Sequence[str], suffix: str = "*") -> DataFrame:
    """Files behind literals, folders, wildcards and frame patterns, by the rules of ``files.expand``: (path, length, modificationTime), each file once.

    The listing is Spark's own, so any store it reads will do. An input without files raises, and so does an empty list.
    """
    return _inputs(spark, inputs, suffix, ("path", "length", "modificationTime")).dropDuplicates(["path"])


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the files behind one input."""
    return _inputs(spark, [path], "*", ("path", "content"))


def header_scan(files: DataFrame) -> DataFrame:
    """(path, header_lines, width, height, problem) without decoding pixels: everything up to the first blank line, however long.

    Where ``files`` has no column ``content``, each file is opened on the executors and read up to that line only, so a picture costs its head, whatever its size;
    with ``content``, for stores that only Spark reaches, whole files pass through. A file without that line or without a size line behind it keeps its row: the
    size is NULL and ``problem`` says why.
    """
    whole = "content" in files.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if whole:
                rows = [parse_head(memoryview(cell.as_buffer()) if cell.is_valid else b"") for cell in batch.column(1)]
            else:
                rows = [head_of(path) for path in batch.column(0).to_pylist()]
            lines, width, height, problem = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lines, pa.list_(pa.string())), pa.array(width, pa.int32()), pa.array(height, pa.int32()), pa.array(problem, pa.string())],
                names=["path", "header_lines", "width", "height", "problem"],
            )

    return files.select("path", *(["content"] if whole else [])).mapInArrow(run, "path string, header_lines array<string>, width int, height int, problem string")


def _plane(data: memoryview, at: int, width: int) -> tuple[bytes, int]:
    """One channel of a run-length scanline: a code above 128 repeats the next byte code - 128 times, any other is followed by that many bytes."""
    pieces, filled = [], 0
    while filled < width:
        if at >= len(data):
            raise ValueError("picture data ends early")
        code = data[at]
        repeat = code > 128
        size = code - 128 if repeat else code
        piece = bytes(data[at + 1 : at + 2]) * size if repeat else bytes(data[at + 1 : at + 1 + size])
        if not size or len(piece) != size:
            raise ValueError("run or literal without content")
        pieces.append(piece)
        filled += size
        at += 2 if repeat else 1 + size
    if filled != width:
        raise ValueError("run or literal leaves the scanline")
    return b"".join(pieces), at


def _quads(data: memoryview, at: int, width: int) -> tuple[np.ndarray, int]:
    """A scanline of four-byte pixels. 1, 1, 1, n repeats the pixel before it n times; the k-th such mark in a row counts n * 256 ** (k - 1).

    All pixels are taken from the buffer at once; repeats are expanded only where a mark is among them.
    """
    take = width
    while True:
        quads = np.frombuffer(data[at : at + 4 * take], np.uint8)
        quads = quads[: len(quads) // 4 * 4].reshape(-1, 4)
        mark = (quads[:, :3] == 1).all(axis=1)
        mark[:1] = False
        if not mark.any():
            times = np.ones(len(quads), np.int64)
        else:
            place = np.arange(len(quads))
            since = place - np.maximum.accumulate(np.where(mark, -1, place))
            times = np.where(mark, quads[:, 3].astype(np.int64) << np.minimum(8 * (since - 1).clip(0), 40), 1)
        filled = np.cumsum(times)
        end = int(np.searchsorted(filled, width))
        if end < len(quads):
            break
        if len(quads) < take:
            raise ValueError("picture data ends early")
        take *= 2  # marks of no repeats
    if filled[end] != width:
        raise ValueError("run leaves the scanline")
    used = end + 1
    source = np.maximum.accumulate(np.where(mark[:used], 0, np.arange(used)))
    return np.repeat(quads[source], times[:used], axis=0), at + 4 * used


def _scanline(data: memoryview, at: int, width: int) -> tuple[np.ndarray, int]:
    """One scanline as (width, 4) bytes and the position behind it."""
    head = bytes(data[at : at + 4])
    if head[:2] != b"\x02\x02" or len(head) < 4 or head[2] > 127:
        return _quads(data, at, width)
    if int.from_bytes(head[2:], "big") != width:
        raise ValueError("scanline length differs from the picture width")
    at, planes = at + 4, []
    for _ in range(4):
        plane, at = _plane(data, at, width)
        planes.append(np.frombuffer(plane, np.uint8))
    return np.stack(planes, axis=1), at


def scanlines(content: bytes, half_step: bool = True) -> Iterator[tuple[int, int, int, bool, np.ndarray]]:
    """(width, height, row from the top, unused, rgb) per scanline; X-major pictures are stored transposed."""
    end = content.find(b"\n\n")
    if not content.startswith(b"#?RADIANCE") or end < 0:
        raise ValueError("not a supported picture")
    stop = content.index(b"\n", end + 2)
    res = content[end + 2 : stop].decode("ascii")
    m = {a: (s, int(n)) for s, a, n in re.findall(r"([-+])([XY])\s*(\d+)", res)}
    if set(m) != {"X", "Y"}:
        raise ValueError(f"resolution line not understood: {res}")
    width, height = m["X"][1], m["Y"][1]
    if res.index("X") < res.index("Y"):
        width, height = height, width
    down = m["Y"][0] == "-"
    data, at = memoryview(content), stop + 1
    for i in range(height):
        row, at = _scanline(data, at, width)
        e = row[:, 3].astype(np.int32)
        scale = np.where(e > 0, np.ldexp(1.0, e - 136), 0.0)
        rgb = (row[:, :3].astype(np.float64) + (0.5 if half_step else 0.0)) * scale[:, None]
        yield width, height, (i if down else height - 1 - i), down, rgb


def decode(files: DataFrame, half_step: bool = True, rows_per_batch: int = 256) -> DataFrame:
    """Encoded pictures (path, content) → pixel rows. Batches of scanlines leave the decoder, never a whole picture."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                held: list = []
                for line in scanlines(content.as_py(), half_step):
                    held.append(line)
                    if len(held) == rows_per_batch:
                        yield _batch(path, held)
                        held = []
                if held:
                    yield _batch(path, held)

    return files.select("path", "content").mapInArrow(run, PIXEL_SCHEMA)


def _batch(path: str, lines: list) -> pa.RecordBatch:
    width, height = lines[0][0], lines[0][1]
    n = width * len(lines)
    rgb = np.concatenate([ln[4] for ln in lines])
    i32 = pa.int32()
    return pa.RecordBatch.from_arrays(
        [
            pa.array([path] * n), pa.array(np.full(n, width), i32), pa.array(np.full(n, height), i32),
            pa.array(np.repeat([ln[2] for ln in lines], width), i32), pa.array(np.tile(np.arange(width), len(lines)), i32),
            *[pa.array(rgb[:, k]) for k in range(3)],
        ],
        names=["path", "width", "height", "y", "x", "r", "g", "b"],
    )


def read_pictures(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(images, pixels) of an archive."""
    files = list_inputs(spark, [path])
    return header_scan(files), decode(read_files(spark, path))


def write_pixels(pixels: DataFrame, path: str) -> None:
    """Archive layout: clustered by picture and row band so that row filters prune row groups."""
    pixels.repartition("image_id", F.floor(F.col("y") / 256)).sortWithinPartitions("image_id", "y", "x").write.mode("overwrite").parquet(path)
