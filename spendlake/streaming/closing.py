"""Event-time state that closes days by timers: the daily roll-up and the rollout gate (STR2, STR4).

Rows are summed by key and day inside every task before they are dealt to the state,
so a key with most rows sends a few sums and not its rows.  A day's timer fires once
the watermark has passed its end; rows of days already closed are late, and counted
instead of dropped in silence.  A source that falls silent would leave its last day
open, so a heartbeat stream moves the watermark on.  All state lies in the checkpoint:
a restarted query goes on with its open days, its phase and the history of its phases.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

DAY_MS = 86_400_000
#: Users in one entry of a day's state.
USERS_A_LIST = 4096
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: What is summed of a day, in the order of a state row.
SUMS = ("total_requests", "tesseract_requests", "google_vision_requests", "cache_hits", "error_count", "confidence", "confidences", "processing_time", "processing_times")
_SUMS_DDL = ", ".join(f"{n} {'double' if n in ('confidence', 'processing_time') else 'long'}" for n in SUMS)
_WHOLE = [n not in ("confidence", "processing_time") for n in SUMS]
_NO_SUMS = tuple(0 if whole else 0.0 for whole in _WHOLE)


def _added(a: tuple, b: tuple) -> tuple:
    return tuple(x + y for x, y in zip(a, b))


def with_heartbeats(events: DataFrame, beats: DataFrame) -> DataFrame:
    """Events and rows of ``beats(ts)``, which carry no data but time."""
    return events.withColumn("beat", F.lit(False)).unionByName(beats.select("ts", F.lit(True).alias("beat")), allowMissingColumns=True)


def write_heartbeat(spark: SparkSession, folder: str, at: datetime) -> None:
    """Tell the streams over ``folder`` that no event before ``at`` is to come, lateness aside."""
    spark.createDataFrame([(at,)], "ts timestamp").coalesce(1).write.mode("append").parquet(folder)


def read_heartbeats(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema("ts timestamp").parquet(folder)


def _summed(keys: list[str]):
    """Sums of a task's rows by key and day, one row each.

    Heartbeats end here: a filter would be moved below the watermark, which they are to move.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table.filter(pc.invert(table.column("beat")))
            sums = table.group_by([*keys, "day"]).aggregate([(n, "sum") for n in SUMS])
            yield from sums.rename_columns([*keys, "day", *SUMS]).to_batches()

    return run


def day_sums(events: DataFrame, keys: list[str], lateness: str) -> DataFrame:
    """``keys, day`` (days since 1970, UTC) and :data:`SUMS`, summed per task and batch."""
    if "beat" not in events.columns:
        events = events.withColumn("beat", F.lit(False))
    plain = F.col("engine") == "tesseract"
    flags = [F.lit(True), plain, ~plain & F.col("paid_call"), F.col("cache_hit"), F.col("error"), None, F.col("confidence").isNotNull(), None, F.col("processing_time").isNotNull()]
    columns = [F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) if f is None else F.coalesce(f.cast("long"), F.lit(0).cast("long")).alias(n) for n, f in zip(SUMS, flags)]
    rows = events.withWatermark("ts", lateness)
    rows = rows.select("beat", *keys, F.floor(F.unix_micros("ts") / (1000 * DAY_MS)).cast("long").alias("day"), *columns)
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.mapInArrow(_summed(keys), f"{kinds}, day long, {_SUMS_DDL}")


class _OpenDays(StatefulProcessor):
    """Sums of open days by key; subclasses say what a closed day gives."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.days = handle.getMapState("days", "day long", _SUMS_DDL)
        self.closed = handle.getValueState("closed", "until long")

    def closed_until(self) -> int:
        """Days before this one are closed."""
        return self.closed.get()[0] if self.closed.exists() else -(2**62)

    def enter(self, day: int, sums: tuple, timers) -> bool:
        """Add to an open day; False if it is closed, for this key or by the watermark."""
        if day < self.closed_until() or (day + 1) * DAY_MS <= timers.getCurrentWatermarkInMs():
            return False
        if self.days.containsKey((day,)):
            sums = _added(tuple(self.days.getValue((day,))), sums)
        else:
            self.handle.registerTimer((day + 1) * DAY_MS)
        self.days.updateValue((day,), sums)
        return True

    def closing(self, expiry_ms: int) -> list[tuple[int, tuple]]:
        """Open days that end by ``expiry_ms``, in order, closed from now on."""
        until = expiry_ms // DAY_MS
        due = sorted(k[0] for k in self.days.keys() if k[0] < until)
        out = [(day, tuple(self.days.getValue((day,)))) for day in due]
        for day in due:
            self.days.removeKey((day,))
        self.closed.update((max(until, self.closed_until()),))
        return out

    def close(self) -> None:
        pass


class _Daily(StatefulProcessor):
    """A bucket of users on one day: their sums and number once the day has closed, and late rows as they come.

    What a batch brings for a day is summed before the state is touched, and its
    users go there as a few lists, so the calls to the state grow with buckets
    and days, not with users.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", _SUMS_DDL)
        self.users = handle.getListState("users", "users array<long>")

    def handleInputRows(self, key, rows, timerValues):
        sums, users = _NO_SUMS, set()
        for frame in rows:
            sums = _added(sums, tuple(frame[n].sum().item() for n in SUMS))
            users.update(frame["user_id"].dropna().astype("int64").unique().tolist())
        end = (key[1] + 1) * DAY_MS
        if end <= timerValues.getCurrentWatermarkInMs():  # the day's timer has fired, or fires in this batch
            yield self._rows([(*key, *_NO_SUMS, 0, sums[0])])
            return
        if self.sums.exists():
            sums = _added(tuple(self.sums.get()), sums)
        else:
            self.handle.registerTimer(end)
        self.sums.update(sums)
        listed = list(users)
        if listed:
            self.users.appendList([(listed[i : i + USERS_A_LIST],) for i in range(0, len(listed), USERS_A_LIST)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        seen = set().union(*(users for (users,) in self.users.get()))
        sums = tuple(self.sums.get())
        self.users.clear()
        self.sums.clear()
        yield self._rows([(*key, *sums, len(seen), 0)])

    def close(self) -> None:
        pass

    @staticmethod
    def _rows(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["bucket", "day", *SUMS, "unique_users", "late_rows"])


def closed_days(events: DataFrame, lateness: str = "1 hour", buckets: int = 64) -> DataFrame:
    """STR2: a row for each user bucket and closed day, and one for rows that came after their day had closed.

    :func:`daily_totals` adds them up.  A user is in one bucket, so users are
    distinct; no state row holds all users of a day.  Rows without a user count
    as requests.
    """
    rows = day_sums(events.withColumn("bucket", F.pmod(F.hash("user_id"), F.lit(buckets)).cast("int")).withColumn("user_id", F.col("user_id").cast("long")), ["bucket", "user_id"], lateness)
    return rows.groupBy("bucket", "day").transformWithStateInPandas(_Daily(), f"bucket int, day long, {_SUMS_DDL}, unique_users long, late_rows long", outputMode="Append", timeMode="EventTime")


def daily_totals(closed: DataFrame) -> DataFrame:
    """The days of a written :func:`closed_days`; a day that has late rows only was closed before its first row came."""
    counts = [n for n, whole in zip(SUMS, _WHOLE) if whole and n not in ("confidences", "processing_times")]
    mean = {n: F.try_divide(F.sum(n), F.sum(f"{n}s")).alias(f"average_{n}") for n in ("confidence", "processing_time")}
    sums = closed.groupBy("day").agg(*[F.sum(n).alias(n) for n in counts], *mean.values(), F.sum("unique_users").alias("unique_users"), F.sum("late_rows").alias("late_rows"))
    return sums.withColumn("day", F.date_from_unix_date(F.col("day").cast("int")))


GRADUAL, FULL, ROLLED_BACK = "gradual_rollout", "full_deployment", "rollback"


@dataclass(frozen=True)
class Gate:
    """What a phase has to reach before its share of traffic grows."""

    samples: int = 50
    confidence: float = 0.95
    errors: float = 0.05
    seconds: float = 10.0
    step: float = 0.2
    start: float = 0.2

    def after(self, phase: str, share: float, n: int, confidence: float, errors: float, seconds: float) -> tuple[str, float, str]:
        """Phase, share and what was done; only a gradual rollout moves."""
        if phase != GRADUAL:
            return phase, share, "none"
        if n < self.samples:
            return phase, share, "wait"
        if confidence >= self.confidence and errors <= self.errors and seconds <= self.seconds:
            share = min(round(share + self.step, 9), 1.0)
            return (FULL if share >= 1.0 else GRADUAL), share, "advance"
        return ROLLED_BACK, 0.0, "roll_back"


CHANGES = "key string, day long, samples long, average_confidence double, error_rate double, average_processing_time double, phase string, rollout_percentage double, action string, late_rows long, changes int"


class _Rollout(_OpenDays):
    """Running quality of a key, its phase, and every change of phase or share so far."""

    def __init__(self, gate: Gate):
        self.gate = gate

    def init(self, handle):
        super().init(handle)
        self.totals = handle.getValueState("totals", f"phase string, share double, late long, {_SUMS_DDL}")
        self.history = handle.getListState("history", "day long, phase string, share double, action string")

    def _state(self) -> tuple:
        return tuple(self.totals.get()) if self.totals.exists() else (GRADUAL, self.gate.start, 0, *_NO_SUMS)

    def handleInputRows(self, key, rows, timerValues):
        late = 0
        for frame in rows:
            for day, *sums in zip(frame["day"].tolist(), *(frame[n].tolist() for n in SUMS)):
                if not self.enter(day, tuple(sums), timerValues):
                    late += sums[0]
        if late:
            phase, share, before, *sums = self._state()
            self.totals.update((phase, share, before + late, *sums))
            yield self._rows([self._row(key, self.closed_until() - 1, phase, share, "late", before + late, tuple(sums))])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        out = []
        for day, sums in self.closing(expiredTimerInfo.getExpiryTimeInMs()):
            phase, share, late, *before = self._state()
            total = _added(tuple(before), sums)
            n, errors, confidence, confidences, seconds, times = total[0], total[4], *total[5:]
            phase, share, action = self.gate.after(phase, share, n, confidence / max(confidences, 1), errors / n, seconds / max(times, 1))
            self.totals.update((phase, share, late, *total))
            if action in ("advance", "roll_back"):
                self.history.appendValue((day, phase, share, action))
            out.append(self._row(key, day, phase, share, action, late, total))
        if out:
            yield self._rows(out)

    def _row(self, key, day, phase, share, action, late, total) -> tuple:
        n, errors, confidence, confidences, seconds, times = total[0], total[4], *total[5:]
        changes = sum(1 for _ in self.history.get())
        return (key[0], day, n, confidence / max(confidences, 1), errors / max(n, 1), seconds / max(times, 1), phase, share, action, late, changes)

    @staticmethod
    def _rows(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[c.strip().split(" ")[0] for c in CHANGES.split(",")])


def rollout_stream(events: DataFrame, gate: Gate = Gate(), key: str = "engine", lateness: str = "1 hour") -> DataFrame:
    """STR4: after each closed day the running quality of every key, its phase, its share and what the gate did.

    ``late_rows`` counts rows that came after their day had closed, ``changes``
    the entries of the key's history of phases.  Rows of closed days change
    neither means nor phases.
    """
    rows = day_sums(events.withColumn("key", F.col(key).cast("string")), ["key"], lateness)
    return rows.groupBy("key").transformWithStateInPandas(_Rollout(gate), CHANGES, outputMode="Append", timeMode="EventTime")


def day_end(at: datetime, lateness_hours: float = 1.0) -> datetime:
    """A heartbeat at this time closes the day of ``at``, which is in UTC."""
    stamp = at.replace(tzinfo=timezone.utc).timestamp()
    return datetime.fromtimestamp((stamp // 86400 + 1) * 86400 + lateness_hours * 3600 + 1, timezone.utc)
