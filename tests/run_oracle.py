"""Runs queries against their oracles: ``python tests/run_oracle.py [sf_dir] [key ..]``."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tests.oracle import connect, difference, spark_rows  # noqa: E402

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from tablesmith.session import local_session  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:]
    fast = bool(os.environ.get("FAST"))  # no separate timing run, queries with an oracle only
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = connect(sf), oracle_sql()
    bad = 0
    for key, fn in queries().items():
        if keys and not any(key == k or (k.endswith("*") and key.startswith(k[:-1])) for k in keys):
            continue
        if fast and key not in sql:
            continue
        t, took = time.time(), 0.0
        try:
            df = fn(spark, sf)
            if not fast:
                df.write.format("noop").mode("overwrite").save()
            took = time.time() - t
            if key in sql:
                found = difference(df, con, sql[key])
                state = "ok" if found is None else "DIFF " + found[:600]
            else:
                rows = spark_rows(df)[1]
                state = f"rows {len(rows)} {rows[:3]}"[:300]
        except Exception as e:
            state = f"ERROR {type(e).__name__}: {str(e)[:700]}"
        bad += state.startswith(("DIFF", "ERROR"))
        print(f"{key:28s} {took:6.1f}s {state}", flush=True)
    print("bad:", bad)


main()
