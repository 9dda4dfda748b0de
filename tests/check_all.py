"""Run registered queries against their SQL: python tests/check_all.py [sf_dir] [name-prefix ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from evalspark.session import local_session  # noqa: E402
from tests import oracle  # noqa: E402

if __name__ == "__main__":
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark = local_session(8)
    con = oracle.connect(sf_dir)
    bad = 0
    oracles = entry.oracle_sql()
    for name, query in entry.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            if name in oracles:
                problem = oracle.difference(df, con, oracles[name])
                state = "ok" if problem is None else f"DIFF {problem}"
            else:
                state = f"rows {len(df.collect())}"
        except Exception as error:
            state = f"ERROR {str(error)[:1500]}"
        bad += state.startswith(("DIFF", "ERROR"))
        print(f"{name:32s} {time.time() - start:6.2f}s {state}", flush=True)
    print("problems:", bad)
