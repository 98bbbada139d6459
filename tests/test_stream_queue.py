import random

import pandas as pd
import pytest

from weblake.streaming import queue, streams

SCHEMA = "index long, site string, at double, finished boolean, rank int"


def played(rows, throttle, parallelism, lifo):
    """Second by second: all that arrives, then all that may go."""
    found = []
    for site in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == site]
        if site is None:
            found += [(r[0], None, r[2]) for r in mine if not r[3]]
            continue
        waiting, doing, free = [], [], 0
        for now in range(2000):
            for r in sorted(r for r in mine if r[2] == now):
                if not r[3]:
                    waiting.append((r[4] or 0, r[2], r[0]))
                elif r[0] in doing:
                    doing.remove(r[0])
                    free = now + throttle
            order = lambda w: (w[0], (-w[1], -w[2]) if lifo else (w[1], w[2]))
            while waiting and len(doing) < parallelism and now >= free:
                first = min(waiting, key=order)
                waiting.remove(first)
                doing.append(first[2])
                found.append((first[2], site, float(now)))
    return found


def run(spark, tmp_path, batches, **options):
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        with queue.timers_allowed(spark):
            stream = streams.read_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], SCHEMA).schema, 1)
            out = queue.stream_released_jobs(stream, "site", "index", "at", "finished", "rank", **options)
            out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(str(tmp_path / "out")).collect()


@pytest.mark.parametrize("parallelism, lifo, seed", [(3, False, 2), (2, True, 3)])
def test_batches_give_what_a_replay_gives(spark, tmp_path, parallelism, lifo, seed):
    rng = random.Random(seed)
    jobs = [(i, rng.choice(["a", "b", "b", "b", None]), float(rng.randrange(1, 900)), False, rng.choice([None, 0, 1, 5])) for i in range(300)]
    acks = [(i, s, min(at + rng.randrange(1, 700), 1900.0), True, None) for i, s, at, _, _ in jobs]
    rows = sorted(jobs + acks, key=lambda r: r[2])
    cuts = [rows[:150], rows[150:400], rows[400:] + [(9999, "tick", 5000.0, False, None)]]
    got = run(spark, tmp_path, cuts, throttle=2.0, parallelism=parallelism, lifo=lifo, watermark="1 second", period=100.0)
    assert sorted((r[0], r[1] or "", r[2]) for r in got if r[1] != "tick") == sorted((i, s or "", t) for i, s, t in played(rows, 2.0, parallelism, lifo))


def test_nulls_repeats_and_long_queues(spark, tmp_path):
    rows = [(i, "hot", 1.0, False, 0) for i in range(3000)] + [(i, "hot", 10.0 + i, True, None) for i in range(2600)]
    rows += [(None, "hot", 1.0, False, 0), (7, "x", None, False, None), (8, "y", 3.0, True, None), (9, "z", 4.0, None, None), (9, "z", 4.0, False, 1), (9, "z", 6.0, True, 1)]
    got = run(spark, tmp_path, [rows, [(1, "tick", 90000.0, False, None)]], throttle=0.0, parallelism=1, watermark="1 second")
    hot = sorted((r["release"], r["index"]) for r in got if r["group"] == "hot")
    assert hot == [(1.0, 0)] + [(10.0 + i, i + 1) for i in range(2600)]
    assert sorted((r[1], r[0], r[2]) for r in got if r[1] in "xyz") == [("x", 7, 0.0), ("z", 9, 4.0), ("z", 9, 6.0)]


class Kept:
    """State of one group without Spark: counts the calls that read or write a value or a block of the map."""

    def __init__(self):
        self.value, self.map, self.calls, self.timer = None, {}, [], 0

    def getValueState(self, *_):
        return self

    def getMapState(self, *_):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        self.calls.append("head")
        return self.value

    def update(self, value):
        self.calls.append("head")
        self.value = value

    def clear(self):
        self.value = None

    def getValue(self, key):
        self.calls.append("block")
        return self.map[key]

    def updateValue(self, key, value):
        self.calls.append("block")
        self.map[key] = value

    def removeKey(self, key):
        self.calls.append("block")
        del self.map[key]

    def registerTimer(self, at):
        self.timer = at

    def deleteTimer(self, _):
        self.timer = 0


class Watermark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def replayed(batches, **options):
    """What a group releases over batches of (watermark in seconds, rows); its state."""
    kept, found = Kept(), []
    releases = queue.Releases(options["throttle"] * 1_000_000, options["parallelism"], options["lifo"], options["period"] * 1_000_000)
    releases.init(kept)
    for seconds, rows in batches:
        frame = pd.DataFrame({"group": "ga", "index": [r[0] for r in rows], "at": [int(r[2] * 1_000_000) for r in rows], "priority": [r[4] or 0 for r in rows], "done": [r[3] for r in rows]})
        outs = list(releases.handleInputRows(("ga",), iter([frame[:7], frame[7:]] if len(frame) > 7 else [frame]), Watermark(seconds * 1000)))
        if 0 < kept.timer <= seconds * 1000:
            outs += list(releases.handleExpiredTimer(("ga",), Watermark(seconds * 1000), None))
        found += [(int(i), r) for out in outs for i, r in zip(out["index"], out["release"])]
    return found, kept


def test_a_group_with_few_rows_is_one_read_and_one_write():
    """each period of a group was a block of its own, with calls to write, read and remove it."""
    jobs = [(i, "a", i * 20_000.0 + 1, False, None) for i in range(66)]
    rows = jobs + [(i, "a", at + 500, True, None) for i, _, at, _, _ in jobs]
    options = {"throttle": 30, "parallelism": 1, "lifo": False, "period": 50_000}
    _, kept = replayed([(0, rows)], **options)
    assert kept.calls == ["head"] and not kept.map
    found, kept = replayed([(0, rows), (2_000_000, [(99, "a", 2_000_001.0, False, None)])], **options)
    assert [i for i, _ in found] == list(range(66)) and "block" not in kept.calls


@pytest.mark.parametrize("seed, block, parallelism, lifo, period", [(s, b, p, f, d) for s, (b, p, f, d) in enumerate([(3, 1, False, 50), (4, 2, True, 20), (8, 3, False, 1000), (16, 1, True, 100), (64, 2, False, 7), (1024, 1, True, 300)])])
def test_blocks_of_any_size_give_what_a_replay_gives(monkeypatch, seed, block, parallelism, lifo, period):
    monkeypatch.setattr(queue, "BLOCK", block)
    rng = random.Random(seed)
    jobs = [(i, "a", float(rng.randrange(1, 900)), False, rng.choice([None, 0, 1, 5])) for i in range(120)]
    acks = [(i, s, min(at + rng.randrange(1, 700), 1900.0), True, None) for i, s, at, _, _ in jobs]
    rows = sorted(jobs + acks, key=lambda r: r[2])
    batches = [(max(int(rows[n - 1][2]) - 1, 0) if n else 0, rows[n : n + 10]) for n in range(0, len(rows), 10)]
    found, kept = replayed([*batches, (5000, [(9999, "a", 5000.0, True, None)])], throttle=2, parallelism=parallelism, lifo=lifo, period=period)
    assert sorted(found) == sorted((i, t) for i, _, t in played(rows, 2, parallelism, lifo))


def test_jobs_without_a_group_share_few_keys(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queue, "LOOSE", 2)
    rows = [(i, None, float(i), i % 5 == 0, None) for i in range(1, 60)]
    got = run(spark, tmp_path, [rows], throttle=2.0, watermark="1 second")
    assert sorted((r[0], r[1], r[2]) for r in got) == [(i, None, float(i)) for i in range(1, 60) if i % 5]
