"""Round trips through files and the streaming runners."""

from pyspark.sql import functions as F

from spendlake.operators import metrics
from spendlake.plans.filters import queue
from spendlake.session import checkpoint_dir
from spendlake.sources import logs
from spendlake.sources.canonical import EVENTS_AS_OF, RECEIPTS_AS_OF, Tables
from spendlake.sources.receipts import scan
from spendlake.streaming import jobs
from tests.conftest import SMALL


def test_log_round_trip(spark, small, tmp_path):
    path = str(tmp_path / "log")
    logs.append_log(small.processing_metrics, path)
    logs.append_log(small.processing_metrics.limit(0), path)
    spark.createDataFrame([("{broken",), ('{"timestamp":"soon"}',), ('{"engine_used":"x"}',)], "value string").write.mode("append").text(path)
    back = logs.read_log(spark, path)
    assert back.count() == small.processing_metrics.count()
    one = metrics.usage(back, EVENTS_AS_OF).first()
    two = metrics.usage(small.processing_metrics, EVENTS_AS_OF).first()
    assert (one.total_requests, one.error_count, one.cache_hits) == (two.total_requests, two.error_count, two.cache_hits)


def test_a_repeated_batch_changes_nothing(spark, small, tmp_path):
    path = str(tmp_path / "log")
    one, two = small.processing_metrics.filter("event_id % 2 = 0"), small.processing_metrics.filter("event_id % 2 = 1")
    assert logs.commit_log(one, path, "2024-05-10") and not logs.commit_log(one, path, "2024-05-10")
    # an attempt that died before its commit
    logs.log_lines(two).write.text(f"{path}/lines/batch=0011/attempt=lost")
    assert logs.read_commits(spark, path).count() == one.count()
    assert logs.commit_log(two, path, "0011") and not logs.commit_log(two, path, "0011")
    back = logs.read_commits(spark, path)
    assert sorted(r[0] for r in back.select("event_id").collect()) == sorted(r[0] for r in small.processing_metrics.select("event_id").collect())


def test_stream_reads_its_own_table_only(spark, small, tmp_path):
    small.raw("events").write.parquet(f"{tmp_path}/events.parquet")
    small.raw("events").write.parquet(f"{tmp_path}/events.parquet.bak")
    stream = Tables(spark, str(tmp_path), ("events",))
    assert jobs.run_available(stream.raw("events")).count() == small.raw("events").count()


def test_reports_are_written(spark, small, tmp_path):
    logs.write_summary(small.processing_metrics, EVENTS_AS_OF, str(tmp_path / "summary"))
    assert spark.read.json(str(tmp_path / "summary")).first().status == "degraded"
    logs.write_approval_details(queue(small), RECEIPTS_AS_OF, str(tmp_path / "report"))
    report = spark.read.csv(str(tmp_path / "report"), header=True)
    assert report.count() == queue(small).count()


def test_receipt_scan_pushes_the_owner(spark, small, tmp_path):
    path = str(tmp_path / "receipts")
    small.receipts.write.parquet(path)
    rows = scan(spark, path, [1, 2])
    assert rows.count() == small.receipts.filter(F.col("user_id").isin(1, 2)).count()
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan


def test_alert_stream_equals_batch(spark, small):
    stream = Tables(spark, SMALL, ("events",))
    got = jobs.run_available(jobs.alert_stream(stream.processing_metrics))
    assert got.count() == metrics.alerts(small.processing_metrics).count()


class Session:
    """Just enough of a session to hold one setting."""

    def __init__(self, path):
        self.path, self.used = path, None
        self.conf = self.sparkContext = self

    def get(self, key, default):
        return self.path if key == "spark.checkpoint.dir" else default

    def setCheckpointDir(self, path):
        self.used = path


def test_checkpoint_folder_comes_from_the_session():
    session = Session("hdfs://shared/checkpoints")
    assert checkpoint_dir(session) == session.used == "hdfs://shared/checkpoints"
    unset = Session(None)
    assert checkpoint_dir(unset) == unset.used is not None
