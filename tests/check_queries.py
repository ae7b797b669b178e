"""Check registered queries against DuckDB: check_queries.py SF_DIR [name prefix ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from compare import connect, differences  # noqa: E402

from tidewatch.catalog import registered  # noqa: E402
from tidewatch.session import build_session  # noqa: E402


def main(sf, prefixes):
    spark, con, bad = build_session(), connect(sf), 0
    for name, q in registered().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            found = differences(q.build(spark, sf), con, q.oracle) if q.oracle else [] * q.build(spark, sf).count()
        except Exception as exc:  # report every query, then fail
            found = [f"ERROR {str(exc)[:500]}"]
        bad += bool(found)
        print(f"{name:32s} {'BAD' if found else 'ok'} {time.time() - start:.1f}s", *found, flush=True)
    print("bad", bad)
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1], sys.argv[2:])))
