"""Times the registered queries and prints one JSON line.

Each query is planned and timed into a sink that discards rows, so every column
is computed.  One query runs beforehand to start the engine; ``BENCH_WARMUP=1``
also runs each query once before it is timed.  ``BENCH_QUERIES`` names prefixes
to run, ``BENCH_REPEATS`` the timed runs of which the median counts.
"""

import json
import os
import statistics
import sys
import time

from spendlake.plans.catalog import callables
from spendlake.session import local_session

HEADLINE = [
    "agg6_employee_ranking",
    "agg14_employer_facets",
    "agg3_category_months",
    "agg19_product_stats",
    "joi3_user_history",
    "joi8_near_pairs",
    "ano2_duplicates",
    "ano3_outliers",
    "set1_all_anomalies",
    "set3_all_insights",
    "win2_employer_forecast",
    "win14_running_quality",
    "lim4_transaction_validation",
    "rul3_evaluation",
    "geo3_place_stats",
    "geo8_trips",
    "met1_usage",
    "rec1_validated_totals",
    "upd5_categories_corrected",
    "txt5_rule_category",
    "txt10_header",
    "txt12_product_lines",
    "txt23_language",
    "txt24_product_matches",
    "con1_vendor_consensus",
    "con2_amount_consensus",
]


def run(build, spark, folder) -> float:
    start = time.perf_counter()
    build(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    wanted = os.environ.get("BENCH_QUERIES", "").split()
    spark = local_session(cores, "spendlake-bench")
    known = callables()
    names = [n for n in known if any(n.startswith(w) for w in wanted)] if wanted else [n for n in HEADLINE if n in known]
    warm = os.environ.get("BENCH_WARMUP", "0") == "1"
    times = {}
    run(known[names[0]], spark, folder)
    for name in names:
        if warm:
            run(known[name], spark, folder)
        times[name] = round(statistics.median(run(known[name], spark, folder) for _ in range(repeats)), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total wall time of headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")),
                "cores": int(cores),
                "spark": spark.version,
            }
        )
    )


if __name__ == "__main__":
    main()
