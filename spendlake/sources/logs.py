"""Metrics log: JSON lines in, JSON lines out, and the exported summary (SRC3 to SRC6)."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlake.functions.core import AsOf, ts
from spendlake.operators import metrics

LOG_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("event_id", T.LongType()),
        T.StructField("engine_used", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("processing_time", T.DoubleType()),
        T.StructField("cache_hit", T.BooleanType()),
        T.StructField("google_vision_used", T.BooleanType()),
        T.StructField("error_occurred", T.BooleanType()),
        T.StructField("error_type", T.StringType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("_corrupt", T.StringType()),
    ]
)


def parse_lines(lines: DataFrame) -> DataFrame:
    """SRC3: log lines to events.

    A corrupt line, a bad or a missing timestamp drops the line; any other
    missing field gets its default.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    rows = lines.select(F.from_json("value", LOG_SCHEMA, options).alias("m")).select("m.*")
    when = F.col("timestamp").try_cast("timestamp")

    def default(name: str, value) -> Column:
        return F.coalesce(F.col(name), F.lit(value))

    kept = rows.filter(F.col("_corrupt").isNull() & when.isNotNull())
    return kept.select(
        "event_id",
        when.alias("ts"),
        default("engine_used", "unknown").alias("engine"),
        default("confidence", 0.0).alias("confidence"),
        default("processing_time", 0.0).alias("processing_time"),
        default("cache_hit", False).alias("cache_hit"),
        default("google_vision_used", False).alias("paid_call"),
        default("error_occurred", False).alias("error"),
        "error_type",
        "user_id",
    )


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """SRC3: a folder of log files as events."""
    return parse_lines(spark.read.text(path))


def log_lines(events: DataFrame) -> DataFrame:
    """SRC4: events as log lines, with the estimated cost of a paid call."""
    priced = metrics.with_cost(events)
    record = F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        "event_id",
        F.col("engine").alias("engine_used"),
        "confidence",
        "processing_time",
        "cache_hit",
        F.col("paid_call").alias("google_vision_used"),
        F.col("error").alias("error_occurred"),
        "error_type",
        "user_id",
        "cost_estimate",
    )
    return priced.select(F.to_json(record).alias("value"))


def append_log(events: DataFrame, path: str) -> None:
    """SRC4: appends events to the log folder; tasks write their own files."""
    log_lines(events).write.mode("append").text(path)


def commit_log(events: DataFrame, path: str, batch: str) -> bool:
    """SRC4 with a commit: appends ``batch`` to the log once, however often the job runs; False if it was there.

    The lines go to a folder of their own for each attempt.  A batch counts once
    the record that names its attempt lies in ``commits``, and that record is
    created only where there is none, so of two jobs at once one wins.  What an
    attempt that failed or lost has written is never read.
    """
    spark = events.sparkSession
    jvm = spark._jvm.org.apache.hadoop.fs
    record = jvm.Path(f"{path}/commits/{batch}.json")
    files = record.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(record):
        return False
    attempt = uuid.uuid4().hex
    log_lines(events).write.text(f"{path}/lines/batch={batch}/attempt={attempt}")
    try:
        out = files.create(record, False)
    except Py4JJavaError as error:
        if files.exists(record):
            return False
        raise error
    out.write(bytearray(json.dumps({"batch": batch, "attempt": attempt}).encode()))
    out.close()
    return True


def read_commits(spark: SparkSession, path: str) -> DataFrame:
    """The events of all committed batches, each batch once."""
    commits = spark.read.schema("batch string, attempt string").json(f"{path}/commits")
    # without the partition columns' own types, which would be guessed from their names
    lines = spark.read.schema("value string, batch string, attempt string").text(f"{path}/lines")
    return parse_lines(lines.join(commits, ["batch", "attempt"], "left_semi").select("value"))


def export_summary(events: DataFrame, as_of: AsOf, days: int = 30) -> DataFrame:
    """SRC5: usage, alert counts and health as one record; healthy means no alert at all."""
    used = metrics.usage(events, as_of, days)
    counts = metrics.alert_summary(metrics.all_alerts(events, as_of)).select(
        F.col("total_count").alias("total_alerts"),
        F.col("critical").alias("critical_alerts"),
        F.when(F.col("total_count") == 0, "healthy").otherwise("degraded").alias("status"),
    )
    # Two records of one row each, folded into one.
    both = used.unionByName(counts, allowMissingColumns=True)
    one = both.agg(*[F.max(c).alias(c) for c in both.columns])
    return one.select(ts(as_of).alias("export_timestamp"), F.lit(days).alias("period_days"), "*")


def write_summary(events: DataFrame, as_of: AsOf, path: str, days: int = 30) -> None:
    export_summary(events, as_of, days).write.mode("overwrite").json(path)


def approval_details(queue: DataFrame, as_of: AsOf) -> DataFrame:
    """SRC6: one report row per pending approval, with the days it has waited, rounded up."""
    days = F.ceil((F.unix_timestamp(ts(as_of)) - F.unix_timestamp("created_at")) / 86400)
    return queue.select(
        F.col("receipt_id").alias("id"),
        F.col("created_at").alias("created"),
        F.col("name").alias("requester"),
        "category",
        F.col("company_name").alias("vendor"),
        F.col("total_amount").alias("amount"),
        F.lit("CLP").alias("currency"),
        "urgency",
        F.lit("PENDIENTE").alias("status"),
        days.alias("days_pending"),
    )


def write_approval_details(queue: DataFrame, as_of: AsOf, path: str) -> None:
    """SRC6: the report as CSV files with a header."""
    approval_details(queue, as_of).write.mode("overwrite").csv(path, header=True)
