"""Streams that close days by timers: restarts, late rows, heartbeats and the history of phases."""

from datetime import datetime, timezone

import pytest

from spendlake.streaming import closing, jobs

COLUMNS = "event_id long, ts timestamp, user_id long, engine string, confidence double, processing_time double, cache_hit boolean, paid_call boolean, error boolean"


def at(day, hour=12):
    return datetime(2024, 5, day, hour, tzinfo=timezone.utc)


def events(*rows):
    return [(i, at(day, hour), user, "x", confidence, 1.0, True, False, error) for i, (day, hour, user, confidence, error) in enumerate(rows)]


@pytest.fixture
def source(spark, tmp_path):
    class Source:
        folder = str(tmp_path)

        def add(self, *rows):
            spark.createDataFrame(events(*rows), COLUMNS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")

        def beat(self, when):
            closing.write_heartbeat(spark, f"{tmp_path}/beats", when)

        def run(self, build, name):
            stream = closing.with_heartbeats(spark.readStream.schema(COLUMNS).parquet(f"{tmp_path}/events"), closing.read_heartbeats(spark, f"{tmp_path}/beats"))
            return jobs.run_available(build(stream), f"{tmp_path}/{name}", closing.STATE_STORE)

    out = Source()
    out.beat(at(1, 0))
    return out


def test_phase_survives_restarts_and_counts_late_rows(source):
    gate = closing.Gate(samples=3, confidence=0.5, errors=0.3, seconds=5.0, step=0.4, start=0.2)

    def run():
        found = source.run(lambda s: closing.rollout_stream(s, gate), "phases")
        return [(r.day - 19843, r.samples, r.phase, round(r.rollout_percentage, 6), r.action, r.late_rows, r.changes) for r in found.orderBy("samples", "late_rows").collect()]

    source.add((1, 1, 1, 0.9, False), (1, 2, 2, 0.9, False), (2, 1, 1, 0.9, False), (3, 2, 1, 0.9, False))
    first = [(1, 2, closing.GRADUAL, 0.2, "wait", 0, 0), (2, 3, closing.GRADUAL, 0.6, "advance", 0, 1)]
    assert run() == first  # 1 May is day 19844; the third day is still open
    # a restart from the checkpoint: one late row, one more for the open day, and the next day
    source.add((1, 5, 9, 0.0, True), (3, 5, 1, 0.9, False), (4, 3, 1, 0.0, True), (4, 4, 1, 0.0, True))
    second = [(2, 3, closing.GRADUAL, 0.6, "late", 1, 1), (3, 5, closing.FULL, 1.0, "advance", 1, 2)]
    assert run() == first + second
    source.beat(closing.day_end(at(4)))
    assert run() == first + second + [(4, 7, closing.FULL, 1.0, "none", 1, 2)]
    assert run() == first + second + [(4, 7, closing.FULL, 1.0, "none", 1, 2)]


def test_bad_quality_rolls_back_for_good(source):
    gate = closing.Gate(samples=1, confidence=0.5, errors=0.3, seconds=5.0)
    source.add((1, 1, 1, 0.9, False), (2, 1, 1, 0.0, True), (3, 1, 1, 1.0, False))
    source.beat(closing.day_end(at(3)))
    found = source.run(lambda s: closing.rollout_stream(s, gate), "phases").orderBy("day").collect()
    assert [(r.phase, round(r.rollout_percentage, 6), r.action, r.changes) for r in found] == [(closing.GRADUAL, 0.4, "advance", 1), (closing.ROLLED_BACK, 0.0, "roll_back", 2), (closing.ROLLED_BACK, 0.0, "none", 2)]


def test_days_close_with_exact_users_and_late_rows(source):
    source.add((1, 1, 1, 0.5, False), (1, 2, 1, None, False), (1, 3, 2, 1.0, True), (1, 4, None, 0.0, False), (2, 1, 1, 0.5, False))
    source.run(closing.closed_days, "days")
    source.add((3, 9, 5, 0.5, False))
    source.run(closing.closed_days, "days")
    source.add((1, 9, 7, 0.5, False), (1, 9, 1, 0.5, False))
    source.beat(closing.day_end(at(3)))
    found = closing.daily_totals(source.run(closing.closed_days, "days")).orderBy("day").collect()
    got = [(r.day.day, r.total_requests, r.error_count, r.unique_users, r.late_rows) for r in found]
    # users 7 and 1 are in different buckets, only one of which has seen the day: it is closed for both
    assert got == [(1, 4, 1, 2, 2), (2, 1, 0, 1, 0), (3, 1, 0, 1, 0)]
    assert found[0].average_confidence == pytest.approx(0.5)


class _Counted:
    """Stands for a state and its handle: holds what is put and counts the calls."""

    def __init__(self):
        self.calls, self.held, self.states = 0, [], {}

    def __getattr__(self, name):
        if name.startswith("get") and name.endswith("State"):
            return lambda state, schema: self.states.setdefault(state, _Counted())

        def call(*args):
            self.calls += 1
            if name == "update":
                self.held = [args[0]]
            elif name == "appendList":
                self.held += args[0]
            return bool(self.held) if name == "exists" else self.held[0] if name == "get" and isinstance(self.held[0][0], int) else iter(self.held)

        return call


def test_calls_to_the_state_do_not_grow_with_users():
    import pandas as pd

    class Timers:
        getCurrentWatermarkInMs = staticmethod(lambda: 0)  # noqa: N815
        getExpiryTimeInMs = staticmethod(lambda: 20_000 * closing.DAY_MS)  # noqa: N815

    handle, n = _Counted(), 30_000
    days = closing._Daily()
    days.init(handle)
    frame = pd.DataFrame({"bucket": 1, "day": 19_844, "user_id": [None, *range(n - 1)], **{s: 0.5 if s in ("confidence", "processing_time") else 1 for s in closing.SUMS}})
    for _ in range(2):
        assert not list(days.handleInputRows((1, 19_844), iter([frame[: n // 2], frame[n // 2 :]]), Timers))
    (closed,) = days.handleExpiredTimer((1, 19_844), Timers, Timers)
    assert closed[["total_requests", "unique_users", "late_rows", "confidence"]].values.tolist() == [[2 * n, n - 1, 0, float(n)]]
    assert handle.calls + sum(s.calls for s in handle.states.values()) < 100
