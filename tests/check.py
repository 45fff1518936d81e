"""python tests/check.py [folder] [name ...]: run queries against their SQL and print the outcome."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry
from lexiloom.session import local_session
from tests import oracle


def main(folder: str, names: list[str]) -> int:
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, queries = oracle.connect(folder), entry.oracle_sql(), entry.queries()
    bad = 0
    for name in names or queries:
        start = time.time()
        try:
            if name in sql:
                df = queries[name](spark, folder)
                built = time.time() - start
                problem = oracle.compare(df, con, sql[name])
                state = f"({built + oracle.spark_seconds:.2f}s) " + ("ok" if problem is None else f"DIFF {problem}")
            else:
                state = f"rows {queries[name](spark, folder).count()}"
        except Exception as e:  # noqa: BLE001  (the report names every failure)
            state = f"FAIL {type(e).__name__}: {str(e)[:1200]}"
        bad += ("DIFF" in state[:20] or state.startswith("FAIL"))
        print(f"{name:28s} {time.time() - start:6.2f}s {state}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    args = sys.argv[1:]
    folder = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    sys.exit(1 if main(folder, args) else 0)
