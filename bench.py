"""Headline queries on $BENCH_SF_DIR; prints one JSON line. Each query is written to a no-op sink, best of two runs after a warm-up of the session."""

from __future__ import annotations

import json
import os
import sys
import time

from lumenfield.plans import QUERIES
from lumenfield.session import builder

HEADLINE = (
    "capture_summary", "br14_merge_pixel", "br15_merge_neighbourhood", "bracket_to_luminance", "ge13_rotate", "ge16_calibrated_lens", "ge20_resample", "ag1_wide", "ag2_median",
    "ag8_ranked_list", "ag8_ranked_weighted", "ag9_luminance_distribution", "ag10_threshold_table", "ag17_rollup", "nb1_box_mean", "nb3_gaussian", "gl6_group_sources",
    "glare_evaluate", "cv3_view_summary", "ca10_candidate_table", "vv5_category_summary", "gz2_adaptation", "hd1_describing_values", "io2_decode_pictures", "st1_brackets",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (
        builder("bench").master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    for n in ("capture_summary", "nb3_gaussian"):  # code generation and Python workers
        QUERIES[n](spark, sf).write.format("noop").mode("overwrite").save()
    times = {}
    for n in names:
        best = None
        for _ in range(2):
            t = time.perf_counter()
            QUERIES[n](spark, sf).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - t
            best = took if best is None else min(best, took)
        times[n] = round(best, 3)
        print(f"{n} {best:.2f}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
