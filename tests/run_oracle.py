"""python tests/run_oracle.py [sf_dir] [name-prefix …] – print a line per query."""

from __future__ import annotations

import pathlib
import sys
import traceback

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

import __spark_entry__ as registered  # noqa: E402
from lumenfield.session import builder  # noqa: E402
from tests.oracle_check import compare, connect  # noqa: E402


ORACLE, QUERIES = registered.oracle_sql(), registered.queries()


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    pick = sys.argv[2:]
    spark = (
        builder().master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    fails = 0
    for name, run in QUERIES.items():
        if pick and not any(name.startswith(p) for p in pick):
            continue
        try:
            if name in ORACLE:
                msg, took, n = compare(spark, con, name, run, ORACLE[name], sf)
            else:
                import time

                t = time.time()
                n, msg = run(spark, sf).count(), ""
                took = time.time() - t
        except Exception as e:  # noqa: BLE001
            traceback.print_exc(limit=3) if "-v" in pick else None
            msg, took, n = f"{type(e).__name__}: {str(e)[:600]}", 0.0, 0
        fails += bool(msg)
        print(f"{'FAIL' if msg else 'ok  '} {name:40s} {took:6.2f}s {n:7d} {'' if name in ORACLE else '(rows only)'} {msg}", flush=True)
    print("failures:", fails)


if __name__ == "__main__":
    main()
