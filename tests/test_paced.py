"""Pacing and shards as streams against a plain simulation, cut into batches in several ways."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lakequill.streaming import paced as C

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def simulated(calls, every, capacity, backoff, retries):
    """A bucket that is filled and emptied step by step."""
    tokens, since, out = float(capacity), None, {}
    for at, i, failures in sorted(calls):
        now = at if since is None else max(at, since)
        tokens = min(capacity, tokens + (now - (since if since is not None else now)) / every)
        if tokens < 1 - 1e-9:
            now += round((1 - tokens) * every)
            tokens = 1.0
        tokens, since = tokens - 1, now
        slept = min(failures, retries)
        out[i] = (at, now, slept + 1, failures <= retries, now + sum(backoff * 2**k for k in range(slept)))
    return out


def run(spark, folder, batches, schema, operator):
    source, target, checkpoint = (f"file://{folder}/{x}" for x in ("in", "out", "state"))
    with C.with_state(spark):
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
            out = operator(spark.readStream.schema(schema).parquet(source))
            out.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(target).collect()


@pytest.mark.parametrize("cuts", [1, 3])
def test_paced(spark, tmp_path, cuts):
    rng = random.Random(cuts)
    calls = [(k, 100 * k + i, rng.randrange(0, 3_600_000), rng.choice([0, 0, 1, 3, 5])) for k in range(3) for i in range(25)]
    calls += [(0, 900 + i, 5000, 0) for i in range(4)]  # ties
    rows = sorted(((k, i, START + dt.timedelta(milliseconds=at), f) for k, i, at, f in calls), key=lambda r: r[2])
    rows.append((7, 999, START + dt.timedelta(hours=9), None))  # takes the watermark past all others
    step = -(-len(rows) // cuts)
    batches = [rows[i : i + step] for i in range(0, len(rows), step)]
    for b in batches:
        rng.shuffle(b)
    batches[0] += [(None, 5, START, 0), (1, None, START, 0), (1, 6, None, 0)]
    got = run(spark, tmp_path, batches, "k long, id long, ts timestamp, f int", lambda s: C.paced(s, "ts", "k", "id", "f", 200_000, 2, 10_000, 3, "0 seconds"))
    zero = int(START.timestamp() * 1000)
    assert len([r for r in got if r.key != 7]) == len(calls)
    for k in range(3):
        expected = simulated([(at, i, f) for c, i, at, f in calls if c == k], 200_000, 2, 10_000, 3)
        assert {r.id: (r.arrived - zero, r.released - zero, r.attempts, r.ok, r.done - zero) for r in got if r.key == k} == expected


class _State:
    """A value of state and the timers, with what is asked of them counted."""

    def __init__(self):
        self.value, self.timers, self.asked = None, [], 0

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def getMapState(self, name, keys, values):  # noqa: N802
        return None  # keys with few calls have none

    def exists(self):
        self.asked += 1
        return self.value is not None

    def get(self):
        self.asked += 1
        return self.value

    def update(self, value):
        self.asked += 1
        self.value = value

    def registerTimer(self, at):  # noqa: N802
        self.asked += 1
        self.timers.append(at)


class _At:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.ms

    getExpiryTimeInMs = getCurrentWatermarkInMs  # noqa: N815


def test_a_batch_asks_the_state_a_few_times_for_each_key():
    state, processor = _State(), C._Paced(1000, 2, 10, 3, 1000)
    processor.init(state)
    calls = [(10 * i, i, i % 6) for i in range(300)]
    list(processor.handleInputRows((1,), iter([{"at": at, "id": i, "failures": f} for at, i, f in reversed(calls)]), _At(0)))
    assert state.timers == [0]
    got, past = [], 100_000
    got += processor.handleExpiredTimer((1,), _At(past), _At(0))
    assert state.asked <= 8  # several for each call before
    got += processor.handleExpiredTimer((1,), _At(10**9), _At(state.timers[-1]))
    assert {r.id: (r.arrived, r.released, r.attempts, r.ok, r.done) for r in got} == simulated(calls, 1000, 2, 10, 3)


@pytest.mark.parametrize("most", [0, 10])
def test_hot_keys_are_paced_from_maps(spark, tmp_path, most):
    rng = random.Random(most)
    calls = [(k, 100 * k + i, rng.randrange(0, 3_600_000), rng.choice([0, 0, 1, 3, 5])) for k, n in ((0, 30), (1, 4)) for i in range(n)]
    rows = sorted(((k, i, START + dt.timedelta(milliseconds=at), f) for k, i, at, f in calls), key=lambda r: r[2])
    rows.append((7, 999, START + dt.timedelta(hours=9), None))
    got = run(spark, tmp_path, [rows[:12], rows[12:]], "k long, id long, ts timestamp, f int", lambda s: C.paced(s, "ts", "k", "id", "f", 200_000, 2, 10_000, 3, "0 seconds", most))
    zero = int(START.timestamp() * 1000)
    for k in range(2):
        expected = simulated([(at, i, f) for c, i, at, f in calls if c == k], 200_000, 2, 10_000, 3)
        assert {r.id: (r.arrived - zero, r.released - zero, r.attempts, r.ok, r.done - zero) for r in got if r.key == k} == expected


def test_shards(spark, tmp_path):
    at = lambda s: START + dt.timedelta(seconds=s)
    batches = [
        [(1, "a", at(5), 2), (1, "a", at(2), 2), (2, "a", at(1), 1), (3, "a", at(1), 3), (None, "a", at(0), 1), (4, None, at(0), 1)],
        [(1, "b", at(9), 2), (1, "b", at(8), 2), (2, "b", at(7), 1), (3, "b", at(3), 3), (3, "a", at(4), 3)],
        [(1, "c", at(20), 2)],
    ]
    got = run(spark, tmp_path, batches, "s long, part string, ts timestamp, n int", lambda s: C.complete_shards(s, "ts", "s", "part", "n"))
    zero = int(START.timestamp() * 1000)
    assert sorted((r.shard, r.keys, r.completed - zero) for r in got) == [(1, 2, 8000), (2, 1, 1000)]


def test_provider_is_put_back(spark):
    before = spark.conf.get(C._PROVIDER)
    with pytest.raises(KeyError), C.with_state(spark):
        assert "RocksDB" in spark.conf.get(C._PROVIDER)
        raise KeyError
    assert spark.conf.get(C._PROVIDER) == before
