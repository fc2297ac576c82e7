import glob
import os
import shutil
from datetime import datetime, timedelta

import numpy as np
import pytest

from plumbline.streaming import streams as R


def brute(rows, limit, seconds):
    accepted, out = {}, {}
    for user, i, ts in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        live = [t for t in accepted.get(user, []) if (ts - t).total_seconds() < seconds]
        out[i] = len(live) < limit
        accepted[user] = live + [ts] if out[i] else live
    return out


@pytest.fixture(scope="module")
def log(spark):
    """One user sends a third of everything, in bursts."""
    rng = np.random.default_rng(9)
    start = datetime(2024, 1, 1)
    rows = []
    for i in range(1500):
        user = 0 if rng.random() < 0.34 else int(rng.integers(1, 8))
        burst = rng.random() < 0.5
        at = rng.normal(900, 40) if burst else rng.uniform(0, 3600)
        rows.append((user, i, start + timedelta(milliseconds=int(abs(at) * 1000))))
    return rows, spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp")


def test_rate_violations(log):
    rows, df = log
    got = {r["event_id"]: r["allowed"] for r in R.rate_violations(df, 5, 60.0).collect()}
    want = brute(rows, 5, 60.0)
    assert got == want
    assert 0 < sum(not v for v in want.values()) < len(rows)


def test_stream_gives_the_same_answers(log, spark, tmp_path):
    rows, df = log
    path = str(tmp_path / "events")
    df.orderBy("ts").coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(df.schema).parquet(path)
    got = {r["event_id"]: r["allowed"] for r in R.run_to_table(R.rate_limiter_stream(stream, 5, 60.0)).collect()}
    assert got == brute(rows, 5, 60.0)


def test_profile_over_many_batches_equals_batch(spark, tmp_path):
    df = spark.range(1000).selectExpr("cast(id % 37 as double) as a", "cast(id as double) as b")
    path = str(tmp_path / "p")
    df.repartition(5).write.parquet(path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = {r["col"]: r for r in R.run_to_table(R.stream_profile(stream, ["a", "b"]), "complete").collect()}
    want = {r["col"]: r for r in R.stream_profile(df, ["a", "b"]).collect()}
    for c in ("a", "b"):
        for k in ("count", "sum", "mean", "std", "min", "max"):
            assert got[c][k] == pytest.approx(want[c][k])


def in_turn(spark, folder, frames):
    """One file after another, each a batch of its own: files are read in the order of their times."""
    os.makedirs(folder)
    for k, df in enumerate(frames):
        df.coalesce(1).write.parquet(f"{folder}-{k}")
        shutil.copy(glob.glob(f"{folder}-{k}/part-*")[0], f"{folder}/{k}.parquet")
        os.utime(f"{folder}/{k}.parquet", (1_700_000_000 + 60 * k,) * 2)
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_repeated_and_late_updates_are_dropped_and_counted(spark, tmp_path):
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    shape = "update_id long, ts timestamp"
    batches = [[(1, at(0)), (2, at(1)), (2, at(1))], [(1, at(2)), (3, at(60))], [(8, at(61))], [(4, at(61)), (5, at(3)), (6, at(4))], [(3, at(62)), (7, at(90))]]  # a watermark holds from the batch after next on
    stream = in_turn(spark, str(tmp_path / "u"), [spark.createDataFrame(b, shape) for b in batches])
    rows, counts = R.run_counted(R.distinct_updates(stream))
    assert sorted(r["update_id"] for r in rows.collect()) == [1, 2, 3, 4, 7, 8]
    assert counts == {"input_rows": 11, "late_rows": 2, "duplicate_rows": 3}
    assert R.distinct_updates(spark.createDataFrame(batches[0], shape)).count() == 2


def test_late_requests_get_the_answers_of_the_batch_and_state_goes(log, spark, tmp_path):
    rows, df = log
    last = max(r[2] for r in rows)
    shuffled = [df.filter(f"event_id % 3 = {k} AND ts < '{last - timedelta(minutes=20)}'") for k in range(3)]
    tail = [df.filter(f"ts >= '{last - timedelta(minutes=20)}'"), spark.createDataFrame([(0, 9999, last + timedelta(hours=3))], df.schema), spark.createDataFrame([(7, 10_000, last + timedelta(hours=6))], df.schema)]
    stream = in_turn(spark, str(tmp_path / "e"), shuffled + tail)
    with R.rocksdb_state(spark):
        out, counts = R.run_counted(R.ordered_limiter_stream(stream, 5, 60.0, "2 hours"))
    want = brute([*rows, (0, 9999, last + timedelta(hours=3))], 5, 60.0)
    assert {r["event_id"]: r["allowed"] for r in out.collect()} == want and counts["late_rows"] == 0
    processor, kept = R.SlidingLimit(5, 60_000_000, "k", "i", "long"), {}

    class Values:
        def __init__(self):
            self.values = []

        def get(self):
            return iter(self.values)

        exists = lambda self: bool(self.values)
        appendList = lambda self, more: self.values.extend(more)  # noqa: E731, N815
        put = lambda self, values: setattr(self, "values", list(values))
        clear = lambda self: self.values.clear()

    class Handle:
        timers = []
        getListState = lambda self, name, _: kept.setdefault(name, Values())  # noqa: E731, N815
        registerTimer = lambda self, ms: self.timers.append(ms)  # noqa: E731, N815

    class Clock:
        getCurrentWatermarkInMs = lambda self: self.now  # noqa: E731, N815

    import pandas as pd

    clock = Clock()
    processor.init(Handle())
    list(processor.handleInputRows((1,), iter([pd.DataFrame({"us": [5_000_000, 1_000_000], "i": [1, 2]})]), clock))
    clock.now = 6_000
    assert [r for f in processor.handleExpiredTimer((1,), clock, None) for r in f["i"]] == [2, 1] and kept["accepted"].exists() and not kept["waiting"].exists()
    clock.now = 65_001
    assert Handle.timers[-1] == 65_001 and not list(processor.handleExpiredTimer((1,), clock, None)) and not kept["accepted"].exists()
