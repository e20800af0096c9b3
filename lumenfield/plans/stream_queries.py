"""Queries on arriving captures: batch forms where they equal the stream's result, else a stream run over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfield.plans import fixtures as X
from lumenfield.plans.registry import query
from lumenfield.plans.views import view
from lumenfield.session import work_folder
from lumenfield.streaming import captures as ST

view("ev", "SELECT CAST(user_id AS BIGINT) camera, event_type kind, ts, CAST(value AS DOUBLE) val, event_id FROM events")


def _frames(df):
    return df.select(
        F.col("user_id").cast("bigint").alias("camera"), F.col("event_type").alias("kind"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value"), "event_id"
    )


def frames(spark, sf):
    return _frames(X.table(spark, sf, "events"))


def stream(spark, sf):
    schema = X.table(spark, sf, "events").schema
    return _frames(ST.read_captures(spark, sf, schema, "events.parquet"))


def _text(k):
    return F.date_format(k, "yyyy-MM-dd HH:mm:ss").alias(k)


_TS = "strftime({0}, '%Y-%m-%d %H:%M:%S') {0}"


_SESSIONS = (
    f"""SELECT camera, n_frames, {_TS.format('first')}, {_TS.format('last')}, v_min, v_max FROM (SELECT camera, grp, count(*) n_frames, min(ts) AS first, max(ts) AS last, min(val) v_min, max(val) v_max FROM
        (SELECT *, sum(CASE WHEN prev IS NULL OR ts>prev+INTERVAL 45 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY camera ORDER BY ts, event_id) grp FROM (SELECT *, lag(ts) OVER (PARTITION BY camera ORDER BY ts, event_id) prev FROM {{src}})) GROUP BY camera, grp)"""
)


@query(
    "st1_brackets",
    _SESSIONS.format(src="ev"),
    "ev",
    "v_min v_max",
)
def st1(spark, sf):
    d = ST.brackets(frames(spark, sf), "45 minutes")
    return d.select("camera", "n_frames", _text("first"), _text("last"), "v_min", "v_max")


@query(
    "st2_window_stats",
    f"SELECT kind, {_TS.format('start')}, n, v_min, v_max, v_mean FROM (SELECT kind, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) n, min(val) v_min, max(val) v_max, avg(val) v_mean FROM ev GROUP BY ALL)",
    "ev",
    "v_min v_max v_mean:9",
)
def st2(spark, sf):
    return ST.window_stats(frames(spark, sf), "1 hour").select("kind", _text("start"), "n", "v_min", "v_max", "v_mean")


_SLIDING = (
    f"""SELECT kind, {_TS.format('start')}, n, v_min, v_max, v_mean FROM (SELECT kind, time_bucket(INTERVAL 1 HOUR, ts)-INTERVAL 1 HOUR*k AS start, count(*) n, min(val) v_min, max(val) v_max, avg(val) v_mean FROM {{src}}, (SELECT unnest(range(3)) k) GROUP BY ALL)"""
)


@query(
    "st2_sliding_stats",
    _SLIDING.format(src="ev"),
    "ev",
    "v_min v_max v_mean:9",
)
def st2b(spark, sf):
    return ST.window_stats(frames(spark, sf), "3 hours", "1 hour").select("kind", _text("start"), "n", "v_min", "v_max", "v_mean")


# Frames arrive in four parts: up to three fifths of the time span, the rest, stragglers of the first part that are more than two days old by then, and one frame
# long after, which closes all windows before it.
view(
    "arriving",
    """SELECT ev.*, event_id%50=7 AND epoch_us(ts)<t1-2*86400000000 late FROM ev, (SELECT (2*epoch_us(min(ts))+3*epoch_us(max(ts)))//5 t1 FROM ev)""",
    "ev",
)
view("intime", "SELECT * FROM arriving WHERE NOT late", "arriving")


def arriving(spark, sf):
    """(stream, arrivals): the event table as a stream, and the steps that let its parts arrive in that order. A part may have any number of files: all of them arrive at once."""
    e = X.table(spark, sf, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    t1 = e.agg(F.floor((F.min(us) * 2 + F.max(us) * 3) / 5)).first()[0]
    late = (F.col("event_id") % 50 == 7) & (us < t1 - 2 * 86_400_000_000)
    last = e.orderBy(F.desc("ts"), "event_id").limit(1).withColumn("ts", (F.col("ts").cast("timestamp") + F.expr("INTERVAL 400 DAYS")).cast(e.schema["ts"].dataType))
    folder = work_folder(spark)
    e.where(~late & (us < t1)).write.parquet(f"{folder}/part=0")

    def arrivals():
        yield
        for i, part in enumerate((e.where(~late & (us >= t1)), e.where(late), last), 1):
            part.write.parquet(f"{folder}/part={i}")
            yield

    return _frames(spark.readStream.schema(e.schema).option("recursiveFileLookup", "true").parquet(folder)), arrivals()


@query("st1_brackets_stream", _SESSIONS.format(src="intime"), "intime", "v_min v_max")
def st1s(spark, sf):
    """Session windows of the stream in append mode; late frames are left out."""
    frames_, arrivals = arriving(spark, sf)
    d, _ = ST.run_available(ST.brackets(frames_, "45 minutes", "1 hour"), arrivals=arrivals)
    return d.select("camera", "n_frames", _text("first"), _text("last"), "v_min", "v_max")


@query("st2_sliding_stream", _SLIDING.format(src="intime"), "intime", "v_min v_max v_mean:9")
def st2s(spark, sf):
    frames_, arrivals = arriving(spark, sf)
    d, _ = ST.run_available(ST.window_stats(frames_, "3 hours", "1 hour", "1 hour"), arrivals=arrivals)
    return d.select("kind", _text("start"), "n", "v_min", "v_max", "v_mean")


@query("st3_late_frames", f"SELECT event_id, camera, kind, {_TS.format('ts')} FROM arriving WHERE late", "arriving")
def st3s(spark, sf):
    """Side table of the frames that the two queries above leave out."""
    frames_, arrivals = arriving(spark, sf)
    return ST.late_table(frames_, "1 hour", arrivals=arrivals).select("event_id", "camera", "kind", _text("ts"))


@query("st3_watermarked_stream", "SELECT kind, count(*) n FROM ev GROUP BY kind", "ev")
def st3(spark, sf):
    """A watermarked stream with observed metrics keeps every frame that is not late; one file holds no late ones."""
    d, _ = ST.run_available(ST.observed(stream(spark, sf), "30 days"))
    return d.groupBy("kind").agg(F.count("*").alias("n"))


@query("st4_running_chain", dbl="scale")
def st4(spark, sf):
    e = F.col("event_id")
    seq = (F.floor(e / 20) % 6).cast("bigint")
    s = stream(spark, sf).select(
        (F.col("camera") % 5).alias("camera"), seq.alias("seq"), (seq * 2 + e % 6).cast("bigint").alias("shutter_key"),
        ((F.lit(100.0) + e % 7) / (F.lit(1.0) + F.lit(0.1) * (seq * 2 + e % 6))).alias("value"),
    )
    d, _ = ST.run_available(ST.running_chain(s), "update")
    return d


@query(
    "st5_profile_join",
    "SELECT event_id, ev.camera, val*CASE WHEN ev.camera%3=0 THEN 1.1e0 ELSE 1e0 END v FROM ev",
    "ev",
    "v",
)
def st5(spark, sf):
    """Real stream joined with a static profile of every third camera."""
    prof = frames(spark, sf).filter("camera % 3 = 0").select("camera").distinct().withColumn("gain", F.lit(1.1))
    d, _ = ST.run_available(ST.with_profile(stream(spark, sf), prof).select("event_id", "camera", (F.col("value") * F.coalesce("gain", F.lit(1.0))).alias("v")))
    return d


@query("st6_first_seen", "SELECT camera, kind, count(*) n FROM (SELECT DISTINCT camera, kind, event_id//7 shot FROM ev) GROUP BY ALL", "ev")
def st6(spark, sf):
    """Repeated (camera, kind, shot) frames are dropped by the stream's state."""
    s = stream(spark, sf).withColumn("shot", F.floor(F.col("event_id") / 7))
    d, _ = ST.run_available(ST.first_seen(s, ["camera", "kind", "shot"], "3650 days"))
    return d.groupBy("camera", "kind").agg(F.count("*").alias("n"))
