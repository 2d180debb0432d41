"""Run registered queries against their SQL text: ``python check.py [prefix ...]``."""

import os
import sys
import time

from spendlake.plans.catalog import ORACLES, callables
from spendlake.session import local_session
from tests.oracle import compare, connect


def main(prefixes: list[str]) -> int:
    folder = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    spark, con, bad = local_session(), connect(folder), 0
    for name, build in callables().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            if name in ORACLES:
                problem = compare(build(spark, folder), con, ORACLES[name])
            else:
                problem = None if build(spark, folder).collect() else "no rows"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.2f}s {problem or ''}", flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
