"""Compare queries with their SQL: python tests/check.py SF_DIR [name ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from oracle import compare  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from vigilake.session import local_session  # noqa: E402

if __name__ == "__main__":
    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    queries, sqls = entry.queries(), entry.oracle_sql()
    for name in names or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in sqls:
                message, n = compare(df, sqls[name], sf_dir)
            else:
                n = len(df.collect())
                message = None if n else "no rows"
        except Exception as error:  # noqa: BLE001
            message, n = f"{type(error).__name__}: {str(error)[:1500]}", 0
        state = "ok  " if message is None else "FAIL"
        print(f"{state} {name:24s} {n:8d} rows {time.time() - start:6.1f}s {message or ''}", flush=True)
