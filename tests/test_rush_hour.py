"""Running quality where one hour of one engine holds nine tenths of the events."""

import datetime as dt
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from spendlake.functions.core import _cut_buckets
from spendlake.operators import series

START = dt.datetime(2024, 5, 10, 8, 0)


def rush():
    rows = [(i, START + dt.timedelta(seconds=(i * 7919) % 3600), "x", (i % 10) / 10, 1.0 + i % 3, i % 7 == 0) for i in range(4500)]
    return rows + [(4500 + i, START + dt.timedelta(hours=1 + i % 9, seconds=i), ("x", "y", None)[i % 3], 0.5, 2.0, False) for i in range(500)]


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(rush(), "event_id long, ts timestamp, engine string, confidence double, processing_time double, error boolean").repartition(4)


def test_no_bucket_is_more_than_twice_the_limit(events):
    base = events.withColumn("_bucket", F.date_trunc("hour", "ts"))
    cut = _cut_buckets(base, ["engine"], "ts", 200)
    sizes = [r["count"] for r in cut.groupBy("engine", "_bucket").count().collect()]
    assert sum(sizes) == 5000 and max(sizes) <= 2 * 200
    heavy = cut.filter("engine = 'x' AND ts < '2024-05-10 09:00:00'").groupBy("_bucket").count().collect()
    assert len(heavy) == 23


def test_running_quality_equals_a_plain_loop(events):
    got = {r.event_id: r for r in series.running_quality(events.filter("engine IS NOT NULL"), rows_per_bucket=200).collect()}
    for engine in ("x", "y"):
        rows = sorted((r for r in rush() if r[2] == engine), key=lambda r: (r[1], r[0]))
        for n, row, conf, bad in zip(range(1, len(rows) + 1), rows, accumulate(r[3] for r in rows), accumulate(r[5] for r in rows)):
            found = got.pop(row[0])
            assert (found.samples, found.failures, found.successes) == (n, bad, n - bad)
            assert found.avg_confidence == pytest.approx(conf / n)
    assert not got
