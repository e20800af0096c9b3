"""Ingest of arriving captures. Every transformation takes a streaming or a batch DataFrame unless it says otherwise."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumenfield.session import work_folder


def read_captures(spark: SparkSession, folder: str, schema: T.StructType, glob: str = "*.parquet", files_per_batch: int = 1000) -> DataFrame:
    """Stream of capture rows from files that appear in a folder."""
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def _watermarked(frames: DataFrame, time: str, late: str | None) -> DataFrame:
    """Watermark on streams; ``late=None`` where the stream already has one."""
    return frames.withWatermark(time, late) if late and frames.isStreaming else frames


def brackets(frames: DataFrame, gap: str, late: str | None = "10 minutes", keys: Sequence[str] = ("camera",), time: str = "ts") -> DataFrame:
    """Group frames into brackets: frames of one camera less than ``gap`` apart belong together."""
    d = _watermarked(frames, time, late)
    g = d.groupBy(*keys, F.session_window(time, gap).alias("w")).agg(
        F.count("*").alias("n_frames"), F.min(time).alias("first"), F.max(time).alias("last"), F.min("value").alias("v_min"), F.max("value").alias("v_max")
    )
    return g.drop("w")


def window_stats(frames: DataFrame, length: str, slide: str | None = None, late: str | None = "10 minutes", keys: Sequence[str] = ("kind",), time: str = "ts") -> DataFrame:
    """Tumbling or sliding statistics of a measured value."""
    d = _watermarked(frames, time, late)
    w = F.window(time, length, slide) if slide else F.window(time, length)
    return d.groupBy(*keys, w.alias("w")).agg(
        F.count("*").alias("n"), F.min("value").alias("v_min"), F.max("value").alias("v_max"), F.avg("value").alias("v_mean")
    ).select(*keys, F.col("w.start").alias("start"), "n", "v_min", "v_max", "v_mean")


def observed(frames: DataFrame, late: str, name: str = "frames", time: str = "ts") -> DataFrame:
    """Watermarked stream whose progress reports rows and time span per trigger."""
    d = _watermarked(frames, time, late)
    return d.observe(name, F.count("*").alias("rows"), F.min(time).alias("oldest"), F.max(time).alias("newest"))


def late_rows(progress: Sequence) -> int:
    """Frames that came after the watermark, over the given progress reports."""
    total = 0
    for p in progress:
        for op in p.stateOperators if hasattr(p, "stateOperators") else p.get("stateOperators", []):
            total += op.numRowsDroppedByWatermark if hasattr(op, "numRowsDroppedByWatermark") else op.get("numRowsDroppedByWatermark", 0)
    return total


def late_table(frames: DataFrame, late: str, time: str = "ts", arrivals: Iterable = (None,)) -> DataFrame:
    """Frames of a stream that came after the watermark, as a table; they are those a stateful query over the same stream leaves out before it looks at windows.

    The watermark is that of a query with the delay ``late``: the latest time of all earlier micro-batches less the delay. Times seen are kept per micro-batch, so a
    repeated micro-batch finds the same watermark and overwrites its own rows. ``arrivals`` as in ``run_available``.
    """
    spark = frames.sparkSession
    folder = work_folder(spark)

    def route(df: DataFrame, number: int) -> None:
        seen = spark.read.schema("newest timestamp, batch bigint").parquet(f"{folder}/seen").where(F.col("batch") < number).agg(F.max("newest")).first()[0] if number else None
        mark = F.lit(seen) - F.expr(f"INTERVAL {late}")
        out = df.where(F.lit(False) if seen is None else F.col(time) < mark)
        out.write.mode("overwrite").parquet(f"{folder}/late/batch={number}")
        df.agg(F.max(time).alias("newest")).write.mode("overwrite").parquet(f"{folder}/seen/batch={number}")

    w = frames.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(route)
    for _ in arrivals:
        w.start().awaitTermination()
    return spark.read.schema(frames.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/late")


def first_seen(frames: DataFrame, key: Sequence[str], late: str = "10 minutes", time: str = "ts") -> DataFrame:
    """Suppress repeated frames; state is kept only as long as the watermark asks for."""
    if frames.isStreaming:
        return frames.withWatermark(time, late).dropDuplicatesWithinWatermark(list(key))
    return frames.dropDuplicates(list(key))


def with_profile(frames: DataFrame, profiles: DataFrame, key: str = "camera") -> DataFrame:
    """Stream–static join: each frame gets its camera's profile columns; frames of unknown cameras stay."""
    return frames.join(profiles, key, "left")


CHAIN_OUT = "camera bigint, seq bigint, scale double, n_shared int"
CHAIN_STATE = "keys array<bigint>, vals array<double>"


def running_chain(sequences: DataFrame) -> DataFrame:
    """Running chain of shutter calibration per camera (streaming only): rows ``(camera, seq, shutter_key, value)``.

    State is one value per shutter key, a few dozen numbers per camera. A sequence is scaled by its mean ratio to the merge on
    shared keys; the first sequence defines the scale and one without shared keys keeps NULL.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        merged = dict(zip(*state.get)) if state.exists else {}
        pdf = pd.concat(list(batches))
        pdf = pdf.groupby(["seq", "shutter_key"], as_index=False)["value"].mean()
        out = []
        for seq, part in pdf.groupby("seq", sort=True):
            ratio = [merged[k] / v for k, v in zip(part["shutter_key"], part["value"]) if k in merged and v > 0]
            scale = 1.0 if not merged else (sum(ratio) / len(ratio) if ratio else None)
            if scale is not None:
                merged.update({int(k): float(v) * scale for k, v in zip(part["shutter_key"], part["value"])})
            out.append((key[0], int(seq), scale, len(ratio)))
        state.update((list(merged.keys()), list(merged.values())))
        yield pd.DataFrame(out, columns=["camera", "seq", "scale", "n_shared"])

    return sequences.groupBy("camera").applyInPandasWithState(step, CHAIN_OUT, CHAIN_STATE, "update", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, mode: str = "append", arrivals: Iterable = (None,)):
    """Process what is there now into a Parquet table and return (table, query). Only append results can go to files;
    update-mode results are written per micro-batch. ``arrivals``: every step of it lets more rows arrive, and the query
    goes on, from its saved state, after each."""
    spark = stream.sparkSession
    folder = work_folder(spark)
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if mode == "append":
        w = w.format("parquet").option("path", f"{folder}/out")
    else:
        # a re-run of a micro-batch after a failure overwrites its own folder
        w = w.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/out/batch={n}"))
    for _ in arrivals:
        q = w.start()
        q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out"), q
