"""Streams with state equal their batch form however their rows are split, across restarts; crawls merge by key."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from textlake.streaming import crawl, stateful

CHUNKS = "stream_id long, seq long, chunk binary"


def run(spark, tmp_path, parts, schema, make):
    """Each part is a run of its own over one checkpoint."""
    for part in parts:
        spark.createDataFrame(part, schema).write.mode("append").parquet(f"{tmp_path}/in")
        with stateful.rocksdb(spark):
            stream = make(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
            stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    return spark.read.parquet(f"{tmp_path}/out")


def sound(rng):
    """Noise, then speech, then noise, a click, silence: 16 bits a sample."""
    levels = [(20, 30), (4, 9000), (30, 9000), (45, 30), (3, 20000), (60, 30), (10, 0)]
    frames = [np.full(320, a) * rng.uniform(0.9, 1.1, 320) * rng.choice([-1, 1], 320) for n, a in levels for _ in range(n)]
    return np.concatenate(frames).astype("<i2").tobytes()


@pytest.mark.parametrize("seed", [1, 2])
def test_any_split(spark, tmp_path, seed):
    rng = random.Random(seed)
    whole = {1: sound(np.random.default_rng(seed)), 2: sound(np.random.default_rng(seed + 9))[:9_001], 3: b"x"}
    parts = [[] for _ in range(3)]
    for key, data in whole.items():
        cuts = sorted(rng.sample(range(1, len(data)), min(12, len(data) - 1)))
        for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(data)], strict=True)):
            parts[i * 3 // (len(cuts) + 1)].append((key, i, data[a:b]))
    parts[1].append((3, 50, None))
    for p in parts:
        rng.shuffle(p)
    one = spark.createDataFrame([x for p in parts for x in p], CHUNKS)
    for make, folder in ((lambda s: stateful.reframed(s, 100), "frames"), (stateful.listened, "heard")):
        want = sorted(map(tuple, make(one).collect()))
        got = sorted(map(tuple, run(spark, tmp_path / folder, parts, CHUNKS, make).collect()))
        assert got == want
        if folder == "frames":
            assert b"".join(bytes(f) for k, _, f in sorted(want) if k == 1) == whole[1][: len(whole[1]) // 100 * 100]
        else:
            kinds = [k for s, _, k, _ in want if s == 1]
            assert kinds.count("start") == 2 and "end" in kinds and "level" in kinds


EVENTS = "user_id long, ts timestamp, kind string, code long, due timestamp"


def test_pledges(spark, tmp_path):
    t = datetime(2024, 1, 1)
    at = lambda h: t + timedelta(hours=h)
    parts = [
        [(1, at(0), "pawn", 10, at(5)), (1, at(1), "pawn", 11, at(30)), (2, at(1), "pawn", 20, at(4)), (2, at(2), "redeem", 99, None)],
        [(1, at(5), "redeem", 10, None), (2, at(9), "redeem", 20, None), (3, at(9), "pawn", 30, at(10))],
        [(4, at(40), "pawn", 40, at(90))],
        [(4, at(41), "none", 0, None)],
    ]
    one = spark.createDataFrame([x for p in parts for x in p], EVENTS)
    want = {(1, 10, "redeemed", at(5)), (1, 11, "lost", at(30)), (2, 20, "lost", at(4)), (3, 30, "lost", at(10))}
    assert set(map(tuple, stateful.pledges(one).collect())) == want
    got = run(spark, tmp_path, parts, EVENTS, lambda s: stateful.pledges(s, "1 hour"))
    assert set(map(tuple, got.collect())) == want and got.count() == len(want)


FILES = "path string, content string"


def test_crawl_goes_on(spark, tmp_path):
    target, checkpoint = f"{tmp_path}/log", f"{tmp_path}/c"
    runs = [[("b", "1"), ("a", "2"), ("c", ""), ("z", None)], [("b", "1"), ("a", "3"), ("d", "4"), ("c", None)], [], [("c", "5"), ("e", "6"), ("e", "7")]]
    for rows in runs:
        if rows:
            spark.createDataFrame(rows, FILES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        crawl.start(spark.readStream.schema(FILES).parquet(f"{tmp_path}/in"), target, checkpoint).awaitTermination()
    now = {r["path"]: (r["doc_id"], r["content"], r["batch"]) for r in crawl.current(crawl.log(spark, target)).collect()}
    assert now == {"a": (1, "3", 1), "b": (2, "1", 0), "c": (3, "5", 2), "d": (4, "4", 1), "e": (5, "7", 2)}
    states = {(r["path"], r["batch"]): r["state"] for r in crawl.log(spark, target).collect()}
    assert states == {("a", 0): "new", ("b", 0): "new", ("c", 0): "new", ("a", 1): "changed", ("d", 1): "new", ("c", 1): "gone", ("c", 2): "changed", ("e", 2): "new"}
    crawl.merge(spark.createDataFrame(runs[3], FILES), target, 2)  # a batch that is run again logs the same
    assert {(r["path"], r["batch"]): r["state"] for r in crawl.log(spark, target).collect()} == states
    assert not crawl.log(spark, f"{tmp_path}/none").count()


def test_numbers(spark):
    rows = spark.createDataFrame([(f"{i:03d}",) for i in range(300)], "p string").repartition(7)
    assert sorted(map(tuple, crawl.numbered(rows, "p").collect())) == [(f"{i:03d}", i + 1) for i in range(300)]
