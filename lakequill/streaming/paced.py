"""Calls paced by a token bucket for each key, retried with back-off, and shards released when complete: state and timers of a stream.

Everything is told by event time, so that a stream gives the same rows whenever it runs and however it is cut into batches.
State must lie in RocksDB (`with_state` sets it); the waiting calls of a hot key are entries of a map, none of which is read before
its time, so it costs as much state as it has calls within the watermark, and no more memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def with_state(spark: SparkSession) -> Iterator[None]:
    """The session with its state store in RocksDB, which timers and maps of state need."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


class _Paced(StatefulProcessor):
    """A call waits for its turn until the watermark is past its arrival, then for its last attempt; timers wake it up.

    A key with at most `most` calls on their way has them in one value, which a batch reads and writes once, and one timer. Of a key with
    more, each instant is an entry of a map with a timer of its own, so that memory stays bounded; it stays that way from then on.
    """

    def __init__(self, every: int, capacity: int, backoff: int, retries: int, most: int):
        self.every, self.capacity, self.backoff, self.retries, self.most = every, capacity, backoff, retries, most

    def init(self, handle) -> None:  # noqa: ANN001
        self.handle = handle
        # full: when the bucket is full again, if nobody calls (null: nobody has); wake: the timer that is set; hot: calls lie in the maps
        self.head = handle.getValueState("head", "full long, wake long, hot boolean, waiting array<struct<at: long, id: long, failures: int>>, running array<struct<done: long, id: long, arrived: long, released: long, attempts: int, ok: boolean>>")
        self.waiting = handle.getMapState("waiting", "at long", "ids array<long>, failures array<int>")
        self.running = handle.getMapState("running", "at long", "ids array<long>, arrived array<long>, released array<long>, attempts array<int>, ok array<boolean>")

    def _read(self) -> tuple:
        full, wake, hot, waiting, running = self.head.get() if self.head.exists() else (None, None, False, [], [])
        return full, wake, hot, [tuple(x) for x in waiting or ()], [tuple(x) for x in running or ()]

    def _add(self, state, at: int, *new) -> None:  # noqa: ANN001
        old = state.getValue((at,)) if state.containsKey((at,)) else [()] * len(new)
        state.updateValue((at,), tuple([*(o or ()), x] for o, x in zip(old, new, strict=True)))

    def _wait(self, at: int, i: int, failures: int) -> None:
        self._add(self.waiting, at, i, failures)
        self.handle.registerTimer(at)

    def _run(self, done: int, *call) -> None:  # noqa: ANN002
        self._add(self.running, done, *call)
        self.handle.registerTimer(done)

    def _keep(self, full: int | None, wake: int | None, waiting: list, running: list, woken: bool) -> None:
        """Writes a key that is not hot, with a timer for what comes first, unless an earlier one is set and still to come."""
        first = min((x[0] for x in (*waiting, *running)), default=None)
        if first is not None and (woken or wake is None or first < wake):
            self.handle.registerTimer(first)
            wake = first
        self.head.update((full, None if first is None else wake, False, waiting, running))

    def handleInputRows(self, key, rows, timerValues):  # noqa: ANN001, ANN201, N802, N803
        full, wake, hot, waiting, running = self._read()
        for r in rows:
            call = r["at"], r["id"], r["failures"] or 0
            if hot:
                self._wait(*call)
                continue
            waiting.append(call)
            if len(waiting) + len(running) > self.most:
                hot = True
                for x in waiting:
                    self._wait(*x)
                for x in running:
                    self._run(*x)
                self.head.update((full, None, True, [], []))
        if not hot:
            self._keep(full, wake, waiting, running, False)
        yield from ()

    def _released(self, full: int | None, at: int, i: int, failures: int) -> tuple[int, int, tuple]:
        full = at if full is None else full
        released = max(at, full - (self.capacity - 1) * self.every)
        slept = min(failures, self.retries)
        return max(full, released) + self.every, released + self.backoff * (2**slept - 1), (i, at, released, slept + 1, failures <= self.retries)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: ANN001, ANN201, N802, N803
        past = timerValues.getCurrentWatermarkInMs()
        full, wake, hot, waiting, running = self._read()
        if hot:
            yield from self._instant(key, expiredTimerInfo.getExpiryTimeInMs(), past, full)
            return
        if wake is None or wake > past:  # an earlier timer of this batch has done all
            return
        later = [x for x in running if x[0] > past]
        yield from (self._row(key, *x[1:], x[0]) for x in running if x[0] <= past)
        for at, i, failures in sorted(x for x in waiting if x[0] <= past):
            full, done, call = self._released(full, at, i, failures)
            if done <= past:
                yield self._row(key, *call, done)
            else:
                later.append((done, *call))
        self._keep(full, wake, [x for x in waiting if x[0] > past], later, True)

    def _instant(self, key, now: int, past: int, full: int | None):  # noqa: ANN001, ANN202
        """What a hot key has at a time."""
        if self.running.containsKey((now,)):
            ids, arrived, released, attempts, ok = self.running.getValue((now,))
            self.running.removeKey((now,))
            yield from (self._row(key, *x, now) for x in zip(ids, arrived, released, attempts, ok, strict=True))
        if not self.waiting.containsKey((now,)):
            return
        for i, failures in sorted(zip(*self.waiting.getValue((now,)), strict=True)):
            full, done, call = self._released(full, now, i, failures)
            if done <= past:
                yield self._row(key, *call, done)
            else:
                self._run(done, *call)
        self.waiting.removeKey((now,))
        self.head.update((full, None, True, [], []))

    @staticmethod
    def _row(key, i, arrived, released, attempts, ok, done) -> Row:  # noqa: ANN001
        return Row(key=key[0], id=i, arrived=arrived, released=released, attempts=attempts, ok=ok, done=done)


def paced(stream: DataFrame, ts: str, key: str, id_: str, failures: str, every: int, capacity: int = 1, backoff: int = 1000, retries: int = 3, late: str = "10 minutes", most: int = 50_000) -> DataFrame:
    """(key, id, arrived, released, attempts, ok, done), times in milliseconds, of each call once the watermark has passed its end.

    A key's bucket holds `capacity` tokens, at first all of them, and gets one each `every` milliseconds; calls take one in order of
    arrival, then of id. A call that fails is tried again after backoff, 2 backoff, 4 backoff, ...; `failures` says how often it fails
    (null: never), and after `retries` more attempts it is given up (ok is false). Rows without key, id or time are left out.
    A task holds `most` calls of a key at once; a key with more on their way is paced from entries of the state.
    """
    at = F.unix_millis(ts)
    rows = stream.withWatermark(ts, late).where(F.col(key).isNotNull() & F.col(id_).isNotNull() & F.col(ts).isNotNull())
    rows = rows.select(F.col(key).cast("long").alias("key"), F.col(id_).cast("long").alias("id"), ts, at.alias("at"), F.col(failures).cast("int").alias("failures"))
    out = "key long, id long, arrived long, released long, attempts int, ok boolean, done long"
    return rows.groupBy("key").transformWithState(_Paced(every, capacity, backoff, retries, most), out, "append", "eventTime")


class _Shards(StatefulProcessor):
    """Which keys of a shard are there, and since when."""

    def init(self, handle) -> None:  # noqa: ANN001
        self.keys = handle.getMapState("keys", "key string", "at long")
        self.count = handle.getValueState("count", "n int, last long, released boolean")

    def handleInputRows(self, key, rows, timerValues):  # noqa: ANN001, ANN201, N802, N803
        n, last, released = self.count.get() if self.count.exists() else (0, None, False)
        if released:
            return
        first: dict[str, int] = {}
        expected = None
        for r in rows:
            first[r["part"]] = min(r["at"], first.get(r["part"], r["at"]))
            expected = r["expected"] if expected is None else max(expected, r["expected"])
        for part, at in first.items():
            if not self.keys.containsKey((part,)):
                self.keys.updateValue((part,), (at,))
                n, last = n + 1, at if last is None else max(last, at)
        released = n >= expected
        if released:
            self.keys.clear()
            yield Row(shard=key[0], keys=n, completed=last)
        self.count.update((n, last, released))


def complete_shards(stream: DataFrame, ts: str, shard: str, part: str, expected: str) -> DataFrame:
    """(shard, keys, completed): a shard, once, in the batch in which the last of its `expected` different parts has come; completed is
    that part's first time in milliseconds. Parts that come again change nothing; a shard that misses one is not given."""
    known = F.col(shard).isNotNull() & F.col(part).isNotNull() & F.col(ts).isNotNull() & F.col(expected).isNotNull()
    rows = stream.where(known).select(F.col(shard).cast("long").alias("shard"), F.col(part).cast("string").alias("part"), F.unix_millis(ts).alias("at"), F.col(expected).cast("int").alias("expected"))
    return rows.groupBy("shard").transformWithState(_Shards(), "shard long, keys int, completed long", "append", "none")
