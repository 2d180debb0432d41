"""Structured Streaming forms of the event-driven parts (STR1 to STR5).

Each job is a transformation of a streaming frame, most of them the batch
operator itself, plus a small runner that drives it to files with a checkpoint
so that a lost executor or driver resumes where it stopped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlake.functions.core import ratio
from spendlake.operators import metrics, rules
from spendlake.session import checkpoint_dir


def alert_stream(events: DataFrame) -> DataFrame:
    """STR1: threshold alerts of every event; stateless."""
    return metrics.alerts(events)


def daily_stream(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """STR2: the daily roll-up; a day is final once the watermark has passed its end.

    Days are summed per user first and then over users, so distinct users are
    exact and no task or state row holds all users of a day.  Events later than
    ``lateness`` are dropped.
    """
    plain = F.col("engine") == "tesseract"
    counts = {
        "total_requests": F.count(F.lit(1)),
        "tesseract_requests": F.count_if(plain),
        "google_vision_requests": F.count_if(~plain & F.col("paid_call")),
        "cache_hits": F.count_if("cache_hit"),
        "error_count": F.count_if("error"),
    }
    means = {f"average_{name}": name for name in ("confidence", "processing_time")}
    users = events.withWatermark("ts", lateness).groupBy(F.window("ts", "1 day"), "user_id").agg(
        *[value.alias(name) for name, value in counts.items()],
        *[fold(name).alias(f"{label}_{name}") for name in means.values() for label, fold in (("sum", F.sum), ("n", F.count))],
    )
    days = users.groupBy("window").agg(
        *[F.sum(name).alias(name) for name in counts],
        *[(F.sum(f"sum_{name}") / F.sum(f"n_{name}")).alias(label) for label, name in means.items()],
        F.count("user_id").alias("unique_users"),
    )
    return days.select(F.to_date("window.start").alias("day"), *counts, *means, "unique_users")


def approval_stream(receipts: DataFrame, users: DataFrame, workflows: DataFrame) -> DataFrame:
    """STR3: rule evaluation and approval instance of every receipt, as stream-static joins with users and workflows."""
    return rules.instances(rules.evaluate(rules.facts(receipts, users), workflows))


def quality_stream(events: DataFrame, share: float, key: str = "engine") -> DataFrame:
    """STR4: running quality per phase and the rollout gate on it, in update mode.

    The running means are sums and counts, so the built-in aggregate keeps them
    with partial sums per task; a phase with most events does not meet in one.
    """
    sums = events.groupBy(key).agg(
        F.count(F.lit(1)).alias("samples"),
        F.avg("confidence").alias("average_confidence"),
        ratio(F.count_if("error"), F.count(F.lit(1))).alias("error_rate"),
        F.avg("processing_time").alias("average_processing_time"),
    )
    after = metrics.gate(
        F.col("samples"), F.col("average_confidence"), F.col("error_rate"), F.col("average_processing_time"), F.lit(share)
    )
    return sums.withColumn("rollout_percentage", after)


# Titles of receipt notifications by status.
TITLES = {"aceptada": "Recibo aceptado", "rechazada": "Recibo rechazado", "en_revision": "Nuevo recibo en revisión"}


def notification_stream(receipts: DataFrame, users: DataFrame) -> DataFrame:
    """STR5: a notification to the employer for every receipt event; events of unknown users keep a null employer."""
    title = None
    for status, text in TITLES.items():
        hit = F.col("status") == status
        title = F.when(hit, text) if title is None else title.when(hit, text)
    people = users.select("user_id", "employer_id", "name")
    return receipts.join(people, "user_id", "left").select(
        "receipt_id",
        F.col("employer_id").alias("recipient_id"),
        F.concat(F.lit("receipt_"), F.col("status")).alias("type"),
        title.alias("title"),
        F.concat_ws(" ", F.coalesce("name", F.lit("Empleado")), "company_name", F.col("total_amount").cast("string")).alias("message"),
        F.lit(False).alias("read"),
        "created_at",
    )


def run_available(stream: DataFrame, folder: str | None = None, state_store: str | None = None) -> DataFrame:
    """Drives a stream over all input there is and returns what it appended to files.

    With the ``folder`` of an earlier run it goes on from that run's checkpoint.
    ``state_store`` is the provider class that custom state needs.
    """
    spark = stream.sparkSession
    folder = folder or f"{checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}"
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    if state_store:
        spark.conf.set(provider, state_store)
    try:
        query = (
            stream.writeStream.format("parquet")
            .outputMode("append")
            .option("path", f"{folder}/out")
            .option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        if state_store:
            spark.conf.unset(provider) if before is None else spark.conf.set(provider, before)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def run_updates(stream: DataFrame, key: str, folder: str | None = None) -> DataFrame:
    """Drives an updating stream over all input there is; returns the last row per key.

    Every micro-batch writes its changed rows to a folder of its own, named by
    the batch, so that a repeated batch replaces what it wrote before.
    """
    spark = stream.sparkSession
    folder = folder or f"{checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}"

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/out/batch={batch}")

    query = (
        stream.writeStream.outputMode("update")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .foreachBatch(write)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    written = spark.read.parquet(f"{folder}/out")
    last = written.groupBy(key).agg(F.max_by(F.struct(*stream.columns), "batch").alias("_l"))
    return last.select("_l.*")
