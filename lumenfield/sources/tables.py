"""Small text sources (profiles, tables, manifests) and text/CSV sinks.

Text sources take ``(path, value)`` rows holding one whole file each, as ``read_texts`` gives them; the files are small by nature and
any number of them is parsed in parallel.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")


def _lines(texts: DataFrame, comment: str) -> DataFrame:
    """(path, pos, line): trimmed, without comments and blanks."""
    d = texts.select("path", F.posexplode(F.split("value", "\r?\n")).alias("pos", "line"))
    line = F.regexp_replace("line", "#.*$", "") if comment == "anywhere" else F.col("line")
    d = d.withColumn("line", F.regexp_replace(line, r"^\s+|\s+$", "")).filter("line <> ''")
    return d if comment == "anywhere" else d.filter(~F.col("line").startswith("#"))


def _columns(line: Column) -> Column:
    return F.transform(F.split(line, r"\s+"), lambda t: t.try_cast("double"))


def vignetting_tables(texts: DataFrame) -> DataFrame:
    """(path, angle, fr, fg, fb, problem): ``problem`` names the rule a row breaks, NULL when it is fine."""
    d = _lines(texts, "anywhere").withColumn("v", _columns(F.col("line")))
    w = W.partitionBy("path").orderBy("pos")
    n = F.size("v")
    angle = F.get("v", F.lit(0))
    d = d.withColumns({"_n": n, "angle": angle})
    d = d.withColumns({"_first": F.first("_n").over(w), "_prev": F.lag("angle").over(w), "_rows": F.count("*").over(W.partitionBy("path"))})
    problem = (
        F.when(F.exists("v", lambda e: e.isNull() | F.isnan(e)), "not a number").when(~F.col("_n").isin(2, 4), "columns")
        .when(F.col("_n") != F.col("_first"), "mixed columns").when(F.col("angle") <= F.col("_prev"), "angle not increasing")
        .when(F.col("_rows") < 2, "too short")
    )
    pick = lambda i: F.when(F.col("_n") == 4, F.get("v", F.lit(i))).otherwise(F.get("v", F.lit(1)))
    return d.select("path", "angle", pick(1).alias("fr"), pick(2).alias("fg"), pick(3).alias("fb"), problem.alias("problem"))


def checked(table: DataFrame) -> DataFrame:
    """Raise on the first broken row when the table is used."""
    msg = F.concat(F.col("path"), F.lit(": "), F.col("problem"))
    return table.filter(F.when(F.col("problem").isNotNull(), F.raise_error(msg).cast("boolean")).otherwise(F.lit(True))).drop("problem")


def chart_cells(texts: DataFrame) -> DataFrame:
    """(path, cell_id, x, y, w, h, problem) from rows ``x y w h``; cells are numbered in file order."""
    d = _lines(texts, "leading").withColumn("v", _columns(F.col("line")))
    w = W.partitionBy("path").orderBy("pos")
    part = [F.get("v", F.lit(i)).cast("int") for i in range(4)]
    problem = F.when(F.size("v") < 4, "columns").when(F.exists(F.slice("v", 1, 4), lambda e: e.isNull()), "not a number").when((part[2] <= 0) | (part[3] <= 0), "size")
    return d.select("path", F.row_number().over(w).alias("cell_id"), *[p.alias(n) for p, n in zip(part, "xywh")], problem.alias("problem"))


def patch_data(texts: DataFrame) -> DataFrame:
    """(path, patch_id, v1, v2, v3, problem) from one or three numeric columns."""
    d = _lines(texts, "leading").withColumn("v", _columns(F.col("line")))
    w = W.partitionBy("path").orderBy("pos")
    d = d.withColumns({"_n": F.size("v"), "_first": F.first(F.size("v")).over(w), "patch_id": F.row_number().over(w)})
    problem = F.when(F.exists("v", lambda e: e.isNull()), "not a number").when(~F.col("_n").isin(1, 3), "columns").when(F.col("_n") != F.col("_first"), "mixed columns")
    return d.select("path", "patch_id", *[F.get("v", F.lit(i)).alias(f"v{i + 1}") for i in range(3)], problem.alias("problem"))


def profiles(texts: DataFrame) -> DataFrame:
    """(path, key, value) of the global part of profile files; a later line of a key wins."""
    d = _lines(texts, "leading")
    section = F.when(F.col("line").rlike(r"^\[.*\]$"), F.lower(F.regexp_extract("line", r"^\[(.*)\]$", 1)))
    w = W.partitionBy("path").orderBy("pos")
    d = d.withColumn("_s", F.coalesce(F.last(section, ignorenulls=True).over(w), F.lit("globals")))
    d = d.filter((F.col("_s") == "globals") & F.col("line").contains("=") & ~F.col("line").rlike(r"^\[.*\]$"))
    key = F.lower(F.regexp_replace(F.substring_index("line", "=", 1), r"\s+$", ""))
    value = F.regexp_replace(F.regexp_replace("line", r"^[^=]*=", ""), r"^\s+", "")
    return d.groupBy("path", key.alias("key")).agg(F.max_by(value, "pos").alias("value"))


def pivot_profiles(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per profile with the wanted keys as columns."""
    return rows.groupBy("path").agg(*[F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in keys])


def spectral_curves(spark: SparkSession, path: str, columns: int = 1) -> DataFrame:
    """(nm, v1 …) rows; lines that do not hold numbers are left out."""
    names = ["nm", *[f"v{i + 1}" for i in range(columns)]]
    raw = spark.read.csv(path, schema=", ".join(f"{n} string" for n in names), comment="#")
    return raw.select(*[F.col(n).try_cast("double").alias(n) for n in names]).na.drop()


def mask_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Candidate masks (filename, kind, score) from a tab-separated list; an unreadable score counts as 0."""
    raw = spark.read.csv(path, sep="\t", header=True, schema="filename string, kind string, score string")
    return manifest_rows(raw)


def manifest_rows(raw: DataFrame) -> DataFrame:
    kind = F.lower("kind")
    return raw.filter(kind.isin("semantic", "instance")).select("filename", kind.alias("kind"), F.coalesce(F.col("score").try_cast("double"), F.lit(0.0)).alias("score"))


def write_csv(df: DataFrame, path: str) -> None:
    """Statistics export with a header; quotes are doubled."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


# Order of the totals in the text summary.
SUMMARY = ("dgp", "dgi", "ugr", "vcp", "cgi", "lveil", "dgm")
DETAIL = (
    "dgp", "av_lum", "e_v", "lum_backg", "e_v_dir", "dgi", "ugr", "vcp", "cgi", "lum_sources", "omega_sources", "lveil", "lveil_cie",
    "dgr", "ugp", "ugr_exp", "dgi_mod", "av_lum_pos", "av_lum_pos2", "med_lum", "med_lum_pos", "med_lum_pos2", "ugp2", "dgm",
)


def summary_line(columns: Sequence[str] = SUMMARY, decimals: int = 6) -> Column:
    """``name,name,…: value value …`` with fixed decimals; undefined values print −99."""
    fmt = ",".join(columns) + ": " + " ".join([f"%.{decimals}f"] * len(columns))
    return F.format_string(fmt, *[F.coalesce(F.col(k), F.lit(-99.0)) for k in columns])


def write_text(df: DataFrame, line: Column, path: str) -> None:
    df.select(line.alias("value")).write.mode("overwrite").text(path)


def region_image(pixels: DataFrame, region: DataFrame, channels: Sequence[str] = ("r", "g", "b"), keys: Sequence[str] = ("image_id", "y", "x")) -> DataFrame:
    """Full picture with pixels outside the region set to 0; headers travel with the image table unchanged."""
    r = region.select(*keys).distinct().withColumn("_in", F.lit(True))
    return pixels.join(r, list(keys), "left").withColumns({ch: F.when(F.col("_in"), F.col(ch)).otherwise(F.lit(0.0)) for ch in channels}).drop("_in")
