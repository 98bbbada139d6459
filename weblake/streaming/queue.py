"""A crawl's queue as a stream: jobs and acknowledgements come in, timers let jobs go."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Rows in a block of state. A step holds the first and the last block of each row of blocks, never a whole queue.
BLOCK = 1024
#: Keys that jobs without a group are dealt over: each key costs calls, though such jobs keep no state.
LOOSE = 4096
#: Kinds of rows of blocks: events that the watermark has not passed, and jobs that wait for a slot.
PENDING, WAITING = 0, 1
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def timers_allowed(spark: SparkSession):
    """While streams are started: the state store that timers need. A running stream keeps it."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def packed(rows: list[list[int]]) -> bytes:
    return np.array(rows, np.int64).tobytes()


def unpacked(stored: bytes, width: int) -> list[list[int]]:
    return np.frombuffer(stored, np.int64).reshape(-1, width).tolist()


class Blocks:
    """Rows (at, index, priority, done) in order of arrival, by kind and bucket, in blocks of a map state.

    ``ends``: for each kind and bucket the first block, how many of its rows are taken, the last block, how many
    rows it holds, the least time in it, and whether that last block is in ``held``, not in the map. Last blocks
    are held there while they have no more rows than one block together: a group with few rows is one read and one write.
    """

    def __init__(self, state, ends: bytes, held: bytes):
        self.state, self.cached, self.kept, self.ends = state, {}, set(), ({}, {})
        rows, taken = unpacked(held, 4), 0
        for kind, bucket, *e in unpacked(ends, 8):
            self.ends[kind][bucket] = e
            if e[5]:
                self.cached[(kind, bucket, e[2])] = rows[taken : taken + e[3]]
                taken += e[3]

    def _block(self, kind: int, bucket: int, n: int) -> list:
        key = (kind, bucket, n)
        rows = self.cached.get(key)
        if rows is None:
            rows = self.cached[key] = unpacked(self.state.getValue(key)[0], 4)
            self.kept.add(key)
        return rows

    def _removed(self, kind: int, bucket: int, n: int) -> None:
        key = (kind, bucket, n)
        if self.cached.pop(key, None) is None or key in self.kept:
            self.state.removeKey(key)
            self.kept.discard(key)

    def push(self, kind: int, bucket: int, rows: list[list[int]]) -> None:
        e = self.ends[kind].get(bucket)
        if e is None:
            e = self.ends[kind][bucket] = [0, 0, 0, 0, rows[0][0], 0]
            self.cached[(kind, bucket, 0)] = []
        e[4] = min(e[4], min(r[0] for r in rows))
        done = 0
        while done < len(rows):
            if e[3] == BLOCK:
                full = self.cached.pop((kind, bucket, e[2]), None)
                if full is not None:
                    self.state.updateValue((kind, bucket, e[2]), (packed(full),))
                e[2], e[3] = e[2] + 1, 0
                self.cached[(kind, bucket, e[2])] = []
            more = rows[done : done + BLOCK - e[3]]
            self._block(kind, bucket, e[2]).extend(more)
            e[3], done = e[3] + len(more), done + len(more)

    def pop(self, kind: int, bucket: int, newest: bool = False) -> list[int]:
        e = self.ends[kind][bucket]
        if newest:
            row, e[3] = self._block(kind, bucket, e[2]).pop(), e[3] - 1
        else:
            row, e[1] = self._block(kind, bucket, e[0])[e[1]], e[1] + 1
        if e[0] == e[2] and e[1] == e[3]:
            self._removed(kind, bucket, e[0])
            del self.ends[kind][bucket]
        elif newest and e[3] == 0:
            self._removed(kind, bucket, e[2])
            e[2], e[3] = e[2] - 1, BLOCK
        elif not newest and e[1] == BLOCK:
            self._removed(kind, bucket, e[0])
            e[0], e[1] = e[0] + 1, 0
        return row

    def drained(self, kind: int, bucket: int) -> list[list[int]]:
        first, taken, last, *_ = self.ends[kind].pop(bucket)
        rows = []
        for n in range(first, last + 1):
            rows += self._block(kind, bucket, n)
            self._removed(kind, bucket, n)
        return rows[taken:]

    def saved(self) -> tuple[bytes, bytes]:
        """Writes the open blocks that are not held; returns the ends and the rows that are."""
        ends = [(kind, bucket, e) for kind in (PENDING, WAITING) for bucket, e in self.ends[kind].items()]
        last = [(kind, bucket, e[2]) in self.cached for kind, bucket, e in ends]
        fits = sum(e[3] for (_, _, e), opened in zip(ends, last) if opened) <= BLOCK
        held = []
        for (kind, bucket, e), opened in zip(ends, last):
            e[5] = int(fits and opened)
            if e[5]:
                held += self._block(kind, bucket, e[2])
                self._removed(kind, bucket, e[2])
        for key, rows in self.cached.items():
            self.state.updateValue(key, (packed(rows),))
        return packed([[kind, bucket, *e] for kind, bucket, e in ends]), packed(held)


class Releases(StatefulProcessor):
    """Plays the jobs and acknowledgements of a group again in order of time, as far as the watermark."""

    def __init__(self, throttle: int, parallelism: int, lifo: bool, period: int):
        self.throttle, self.parallelism, self.lifo, self.period = throttle, parallelism, lifo, period

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "ends binary, held binary, doing binary, now bigint, free bigint, timer bigint")
        self.blocks = handle.getMapState("blocks", "kind int, bucket bigint, block bigint", "rows binary")

    def _loaded(self, known: bool):
        ends, held, doing, now, free, timer = self.head.get() if known or self.head.exists() else (b"", b"", b"", 0, 0, 0)
        return Blocks(self.blocks, ends, held), np.frombuffer(doing, np.int64).tolist(), now, free, timer

    def _play(self, group: str, blocks: Blocks, doing: list[int], now: int, free: int, timer: int, watermark: int) -> Iterator[pd.DataFrame]:
        known, out, due = watermark * 1000, [], []
        pending, queued = blocks.ends
        while True:
            if not due:
                slices = [b for b, e in pending.items() if e[4] <= known]
                if slices:
                    rows = blocks.drained(PENDING, min(slices))
                    due = sorted((r for r in rows if r[0] <= known), reverse=True)
                    later = [r for r in rows if r[0] > known]
                    if later:
                        blocks.push(PENDING, min(slices), later)
            start = max(now, free) if queued and len(doing) < self.parallelism else None
            if due and (start is None or due[-1][0] <= start):
                at, index, priority, done = row = due.pop()
                now = max(now, at)
                if done:
                    if index in doing:
                        doing.remove(index)
                        free = now + self.throttle if self.throttle else free
                elif queued or len(doing) >= self.parallelism or max(now, free) > at or (due and due[-1][0] == at):
                    blocks.push(WAITING, priority, [row])
                else:
                    doing.append(index)
                    out.append((index, at))
            elif start is not None and start <= known:
                now = start
                index = blocks.pop(WAITING, min(queued), self.lifo)[1]
                doing.append(index)
                out.append((index, now))
            else:
                break
            if len(out) == 10_000:
                yield self._frame(group, out)
                out = []
        if out:
            yield self._frame(group, out)
        if not pending and not queued and not doing and free <= known:
            self.head.clear()
            next_ = 0
        else:
            times = [e[4] for e in pending.values()]
            times += [start] if start is not None else [] if pending or queued or doing else [free]
            next_ = -(-min(times) // 1000) if times else 0
            self.head.update((*blocks.saved(), packed(doing), now, free, next_))
        if next_ != timer:
            if timer > watermark:
                self.handle.deleteTimer(timer)
            if next_:
                self.handle.registerTimer(next_)

    @staticmethod
    def _frame(group: str, out: list) -> pd.DataFrame:
        found = np.array(out, np.int64)
        return pd.DataFrame({"index": found[:, 0], "group": group, "release": found[:, 1] / 1_000_000})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if key[0][0] == "-":
            for frame in rows:
                alone = frame[~frame["done"].astype(bool)]
                if len(alone):
                    yield pd.DataFrame({"index": alone["index"], "group": None, "release": alone["at"] / 1_000_000})
            return
        blocks, doing, now, free, timer = self._loaded(False)
        for frame in rows:
            periods = {}
            for row in zip(*(frame[c].tolist() for c in ("at", "index", "priority", "done"))):
                periods.setdefault(row[0] // self.period, []).append([*row])
            for bucket, arrived in periods.items():
                blocks.push(PENDING, bucket, arrived)
        yield from self._play(key[0][1:], blocks, doing, now, free, timer, max(timerValues.getCurrentWatermarkInMs(), 0))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._play(key[0][1:], *self._loaded(True), timerValues.getCurrentWatermarkInMs())


def stream_released_jobs(
    stream: DataFrame, group: str, index: str, ts: str, done: str, priority: str | None = None, throttle: float = 0.2, parallelism: int = 1, lifo: bool = False, watermark: str = "1 minute", period: float = 60.0
) -> DataFrame:
    """index, group, release (seconds of event time): the jobs of a queue as they may start.

    A row is a job that arrives or, where ``done`` is true, the acknowledgement of the job of that group and
    index. A group has at most ``parallelism`` jobs under way; an acknowledgement frees a slot, and the group then
    rests for ``throttle`` seconds. Of the jobs that wait the one of least priority goes (null: 0), of these the first that
    came (by time, then index), or the last if ``lifo``. Jobs without a group go as they come and keep no state.
    Jobs of one index each need an acknowledgement of their own; one of a job that is not under way is void.

    All is decided in event time: rows are kept until the watermark passes them, and timers play them in order then,
    so the answer does not depend on batches; rows later than the watermark are dropped by the stream. A row without a time
    comes first. State is in blocks: events by periods of ``period`` seconds, one of which is sorted at a time,
    and the waiting jobs by priority, of which first and last blocks are opened, so a long queue is never held as a whole.
    A group's last blocks lie in one value while they have at most ``BLOCK`` rows together. A group that has nothing waiting,
    under way or resting has no state. Start the stream under ``timers_allowed``.
    """
    rows = stream.withColumn("event_time", F.col(ts).cast("timestamp")).withWatermark("event_time", watermark).where(F.col(index).isNotNull())
    rank = F.coalesce(F.col(priority).cast("long"), F.lit(0)) if priority else F.lit(0)
    number = F.col(index).cast("long")
    key = F.coalesce(F.concat(F.lit("g"), F.col(group).cast("string")), F.concat(F.lit("-"), F.pmod(F.hash(number), F.lit(LOOSE)).cast("string")))
    keyed = rows.select(
        key.alias("key"), number.alias("index"), F.coalesce(F.unix_micros("event_time"), F.lit(0)).alias("at"),
        rank.cast("long").alias("priority"), F.coalesce(F.col(done), F.lit(False)).alias("done"), "event_time",
    )
    releases = Releases(round(throttle * 1_000_000), parallelism, lifo, max(round(period * 1_000_000), 1))
    return keyed.groupBy("key").transformWithStateInPandas(releases, "index long, group string, release double", "append", "eventtime")
