"""Header lines → values. Indentation marks headers copied from earlier pictures."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfield.functions.colour import primaries_to_weights
from lumenfield.functions.numeric import Num, c, mat_inverse

# Keys that describe colour, and the weights assumed for plain Radiance RGB.
COLOUR_KEYS = (
    "LuminanceRGB", "PRIMARIES", "TargetPrimaries", "TargetWhitePoint", "SENSOR2XYZ", "XYZCAM", "CAM_PREMULTIPLIERS",
    "Camera2RGB",
)
PLAIN_WEIGHTS = (0.265074126, 0.670114631, 0.064811243)


@dataclass(frozen=True)
class Marks:
    """Keys that a writing program marks its pictures with: its own name, an underscore and a fixed word. Only these exact keys count."""

    program: str = "RIG"

    @property
    def colour(self) -> str:
        return f"{self.program}_COLOR"

    @property
    def projection(self) -> str:
        return f"{self.program}_PROJECTION"

    @property
    def step(self) -> str:
        return f"{self.program}_STEP_"


def _strip(v: Column) -> Column:
    return F.trim(v, F.lit(" \t\r\n"))


def _is_colour(key: Column, marks: Marks) -> Column:
    return key.isin(*COLOUR_KEYS, marks.colour)


def describe(images: DataFrame, lines: str = "header_lines", name: str = "header", marks: Marks = Marks()) -> DataFrame:
    """Add the MAP of values that describe a picture.

    Left-justified keys count, the last line of a key wins. Without any colour key there, all colour keys of the least-indented
    copied header are taken. Works inside each row, without a shuffle.
    """

    def indent(line: Column, pos: Column) -> Column:
        body = F.ltrim(line, F.lit(" \t"))
        return F.struct(pos.alias("pos"), (F.length(line) - F.length(body)).alias("depth"), body.alias("body"))

    def parse(e: Column) -> Column:
        at = F.instr(e["body"], F.lit("="))
        return F.struct(
            _strip(F.substr(e["body"], F.lit(1), at - 1)).alias("key"), e["pos"].alias("pos"), e["depth"].alias("depth"), _strip(F.substr(e["body"], at + 1)).alias("value")
        )

    d = images.withColumn("_b", F.transform(lines, indent))
    d = d.withColumn("_b", F.filter("_b", lambda e: e["body"].contains("=") & ~e["body"].startswith("#")))
    d = d.withColumn("_all", F.transform("_b", parse))
    d = d.withColumns({
        "_top": F.filter("_all", lambda e: (e["depth"] == 0) & (e["key"] != "")),
        "_copied": F.filter("_all", lambda e: (e["depth"] > 0) & _is_colour(e["key"], marks)),
    })
    d = d.withColumn("_near", F.array_min(F.transform("_copied", lambda e: e["depth"])))
    d = d.withColumn("_take", F.when(
        F.exists("_top", lambda e: _is_colour(e["key"], marks)), F.col("_top")
    ).otherwise(F.concat("_top", F.filter("_copied", lambda e: e["depth"] == F.col("_near")))))
    # sorted by (key, position): the last of each run of equal keys counts
    d = d.withColumn("_take", F.array_sort("_take")).withColumn("_n", F.size("_take"))
    last = F.filter("_take", lambda e, i: (i == F.col("_n") - 1) | (F.get("_take", i + 1)["key"] != e["key"]))
    d = d.withColumn(name, F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], e["value"]))))
    return d.drop("_b", "_all", "_top", "_copied", "_near", "_take", "_n")


def header_rows(images: DataFrame, keys: Sequence[str] = ("image_id",), name: str = "header") -> DataFrame:
    """(keys, key, value) rows. The outer form of explode keeps Spark from testing the map in a filter first, which would build it twice."""
    return images.select(*keys, F.explode_outer(name)).filter("key is not null")


def values_of(images: DataFrame, key: str, keys: Sequence[str] = ("image_id",), name: str = "value", header: str = "header") -> DataFrame:
    """(keys, value) of the pictures that declare ``key``. The generator keeps the test for NULL above the parsing steps; a plain
    filter would be pushed through all of them and repeat their expressions."""
    return images.select(*keys, F.explode_outer(F.array(F.col(header)[key])).alias(name)).filter(F.col(name).isNotNull())


def number(text: Column) -> Column:
    """Leading number of a text, NULL when there is none."""
    return F.nullif(F.regexp_extract(text, r"^\s*([-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?)", 1), F.lit("")).cast("double")


def numbers(text: Column, n: int) -> list[Column]:
    """The first ``n`` numbers of a blank-separated text, all NULL unless there are that many."""
    parts = F.split(_strip(text), r"\s+")
    ok = F.size(parts) >= n
    return [F.when(ok, F.get(parts, F.lit(i)).try_cast("double")) for i in range(n)]


def exposure_product(lines: Column) -> Column:
    """Product of the positive values of left-justified EXPOSURE lines."""
    v = F.transform(F.filter(lines, lambda s: s.startswith("EXPOSURE=")), lambda s: number(F.substr(s, F.lit(len("EXPOSURE=") + 1))))
    return F.aggregate(F.filter(v, lambda e: e > 0), F.lit(1.0), lambda a, e: a * e)


def in_cdm2(header: Column, marks: Marks = Marks()) -> Column:
    return F.coalesce(F.lower(header[marks.colour]).contains("cd/m2"), F.lit(False))


def parse_view(text: Column) -> dict[str, Column]:
    """Options of a VIEW text as columns; NULL where an option is absent."""

    def opt(name: str, group: int = 1) -> Column:
        return F.nullif(F.regexp_extract(text, rf"(?:^|\s)-{name}\s+(\S+)(?:\s+(\S+)\s+(\S+))?", group), F.lit(""))

    out = {"vtype": F.nullif(F.regexp_extract(text, r"(?:^|\s)-vt(\w)", 1), F.lit(""))}
    for k in ("vh", "vv", "vs", "vl"):
        out[k] = opt(k).try_cast("double")
    for k in ("vd", "vu"):
        for i, a in enumerate("xyz", 1):
            out[f"{k}{a}"] = opt(k, i).try_cast("double")
    return out


def projection(header: Column, override: str | None = None, marks: Marks = Marks()) -> Column:
    """View letter from VIEW, else the declared projection name, else perspective; ``override`` wins."""
    if override:
        return F.lit(override)
    name = F.lower(header[marks.projection])
    declared = (
        F.when(name.rlike("equidistant|equiangular|angular"), "a").when(name.contains("equisolid"), "e")
        .when(name.rlike("hemispherical|orthographic") | (name == "vth"), "h")
    )
    return F.coalesce(parse_view(header["VIEW"])["vtype"], declared, F.lit("v"))


def _usable(w: Sequence[Column]) -> Column:
    return (w[0] > 0) | (w[1] > 0) | (w[2] > 0)


def with_weights(images: DataFrame, lines: str = "header_lines", header: str = "header", monochrome: Column | None = None, marks: Marks = Marks()) -> DataFrame:
    """Add ``wr, wg, wb``, ``weight_source`` and ``efficacy`` by priority: monochrome, LuminanceRGB, sensor matrix, target
    primaries, PRIMARIES, vendor files, plain Radiance RGB; ``unavailable`` otherwise."""
    h = F.col(header)
    d = images
    stages: list[tuple[str, list[Column]]] = [("LuminanceRGB", numbers(h["LuminanceRGB"], 3))]
    sensor = numbers(h["SENSOR2XYZ"], 9)
    cam = numbers(h["XYZCAM"], 9)
    d = d.withColumns({f"_c{i}": v for i, v in enumerate(cam)})
    stages.append(("SENSOR2XYZ", sensor[3:6]))
    stages.append(("XYZCAM", mat_inverse([f"_c{i}" for i in range(9)])[3:6]))
    d = d.withColumns({f"_t{i}": v for i, v in enumerate(numbers(h["TargetPrimaries"], 6) + numbers(h["TargetWhitePoint"], 2))})
    d = d.withColumns({f"_p{i}": v for i, v in enumerate(numbers(h["PRIMARIES"], 8))})
    stages.append(("TargetPrimaries", primaries_to_weights([f"_t{i}" for i in range(8)])))
    stages.append(("PRIMARIES", primaries_to_weights([f"_p{i}" for i in range(8)])))
    for n, w in stages:
        d = d.withColumns({f"_{n}{i}": v for i, v in enumerate(w)})
    text = F.lower(F.array_join(lines, "\n"))
    # Marks of vendor files.
    vendor = text.rlike(r"technoteam|lmk|pftopic|pcftoxyz|programversion= ?standard color|camera= ?svs|camera= ?tt")
    fmt = F.filter(lines, lambda s: F.lower(_strip(F.substring_index(s, "=", 1))) == "format")
    rgbe = F.when(F.size(fmt) > 0, F.exists(fmt, lambda s: F.lower(s).endswith("32-bit_rle_rgbe"))).otherwise(
        F.lower(_strip(F.get(F.col(lines), F.lit(0)))) == "#?radiance"
    )
    colour = [h[k].isNull() for k in ("LuminanceRGB", "SENSOR2XYZ", "XYZCAM", "TargetPrimaries", "TargetWhitePoint", "PRIMARIES")]
    plain = rgbe
    for missing in colour:
        plain = plain & missing
    src = F.when(monochrome, "monochrome") if monochrome is not None else F.when(F.lit(False), "")
    value = [F.when(monochrome, v) if monochrome is not None else F.when(F.lit(False), v) for v in (F.lit(0.0), F.lit(1.0), F.lit(0.0))]
    for n, _ in stages:
        cols = [F.col(f"_{n}{i}") for i in range(3)]
        ok = cols[0].isNotNull() & cols[1].isNotNull() & cols[2].isNotNull()
        ok = ok & _usable(cols) if n != "LuminanceRGB" else ok
        src = src.when(ok, n)
        value = [e.when(ok, k) for e, k in zip(value, cols)]
    src = src.when(vendor, "vendor").when(plain, "radiance").otherwise("unavailable")
    value = [e.when(vendor | plain, F.lit(k)) for e, k in zip(value, PLAIN_WEIGHTS)]
    d = d.withColumns({
        "weight_source": src, "wr": value[0], "wg": value[1], "wb": value[2],
        "efficacy": F.when(in_cdm2(h, marks), F.lit(1.0)).otherwise(F.lit(179.0)),
    })
    return d.drop(*[f"_c{i}" for i in range(9)], *[f"_t{i}" for i in range(8)], *[f"_p{i}" for i in range(8)], *[f"_{n}{i}" for n, _ in stages for i in range(3)])


def next_step(lines: Column, marks: Marks = Marks()) -> Column:
    """Number of the next processing step: one above the highest step key, at least 2."""
    n = F.transform(lines, lambda s: F.nullif(F.regexp_extract(s, rf"^\s*{re.escape(marks.step)}(\d+)\s*=", 1), F.lit("")).cast("int"))
    return F.greatest(F.lit(1), F.coalesce(F.array_max(n), F.lit(1))) + 1


def unique_lines(lines: Column) -> Column:
    """Trimmed, non-empty lines, first occurrence kept."""
    return F.array_distinct(F.filter(F.transform(lines, _strip), lambda s: F.length(s) > 0))


def without_keys(lines: Column, keys: Sequence[str]) -> Column:
    """Lines whose key is not replaced (FORMAT is always rewritten)."""
    drop = [k.lower() for k in (*keys, "FORMAT")]
    return F.filter(lines, lambda s: ~F.lower(_strip(F.substring_index(s, "=", 1))).isin(*drop))


def capture_span(frames: DataFrame, by: Sequence[str], time: str = "capture_time") -> DataFrame:
    """``first-last`` of a sequence, only the clock part of the last; empty times are skipped."""
    t = F.nullif(F.col(time), F.lit(""))
    return frames.groupBy(*by).agg(F.concat(F.min(t), F.lit("-"), F.substring_index(F.max(t), " ", -1)).alias("span"))


def crop_view(view: dict[str, Num], size: tuple[Num, Num], left: Num, top: Num, width: Num, height: Num) -> dict[str, Column]:
    """View angles and offsets of a crop such that every pixel keeps its direction."""
    w0, h0 = c(size[0]), c(size[1])
    rx, ry = c(width) / w0, c(height) / h0
    t, vh, vv = c(view["vtype"]), c(view["vh"]), c(view["vv"])

    def tan(a: Column, r: Column, parts: float) -> Column:
        return F.degrees(F.atan(F.tan(F.radians(a / parts)) * r)) * parts

    def asin(a: Column, r: Column) -> Column:
        return F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(a / 2.0)) * r))) * 2.0

    bottom = h0 - c(top) - c(height)
    return {
        "vh": F.when(t.isin("v"), tan(vh, rx, 2.0)).when(t == "h", asin(vh, rx)).when(t == "s", tan(vh, rx, 4.0)).otherwise(vh * rx),
        "vv": F.when(t.isin("v", "c"), tan(vv, ry, 2.0)).when(t == "h", asin(vv, ry)).when(t == "s", tan(vv, ry, 4.0)).otherwise(vv * ry),
        "hoff": (c(left) + c(view["hoff"]) * w0 - w0 * 0.5 + c(width) * 0.5) / c(width),
        "voff": (bottom + c(view["voff"]) * h0 - h0 * 0.5 + c(height) * 0.5) / c(height),
    }


def pixels_per_degree(width: Num, fov: Num) -> Column:
    """Width over horizontal field of view; 30 when the field of view is unknown."""
    return F.coalesce(F.when(c(fov) > 0, c(width) / c(fov)), F.lit(30.0))


def window_distance(path: Column) -> Column:
    """Distance in metres from a file stem holding ``view_<n>m``; 0 without one."""
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")
    return F.coalesce(F.nullif(F.regexp_extract(stem, r"(?i)(?:^|_)view_(\d+(?:\.\d+)?)m(?:_|$)", 1), F.lit("")).cast("double"), F.lit(0.0))

