"""Operators that keep state of a key between batches: bytes that wait for the rest of their frame, deadlines.

Each also runs on a batch, with the same rows. Streams need RocksDB for their state (rocksdb()).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import UTC, datetime

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from textlake.streaming.events import STATE, Vad

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started within keep their state in RocksDB."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def _in_order(rows: Iterator[pd.DataFrame]) -> list[bytes]:
    """Chunks of a key by rising seq; nulls are empty."""
    every = pd.concat(list(rows)).sort_values("seq", kind="stable")
    return [bytes(c) if c is not None else b"" for c in every["chunk"]]


FRAMES = "stream_id long, frame long, data binary"


def _frames(rest: bytes, at: int, chunks: list[bytes], size: int) -> tuple[list[tuple[int, bytes]], bytes]:
    data = rest + b"".join(chunks)
    whole = len(data) // size
    return [(at + i, data[i * size : (i + 1) * size]) for i in range(whole)], data[whole * size :]


def reframed(chunks: DataFrame, size: int) -> DataFrame:
    """chunks(stream_id, seq, chunk) -> (stream_id, frame, data): the bytes of a stream in frames of equal size, numbered
    from 0, however they were cut. Chunks of a key come by rising seq from batch to batch; what is left at the end waits."""
    if not chunks.isStreaming:

        def whole(pdf: pd.DataFrame) -> pd.DataFrame:
            done, _ = _frames(b"", 0, _in_order(iter([pdf])), size)
            return pd.DataFrame([(pdf["stream_id"].iloc[0], *f) for f in done], columns=["stream_id", "frame", "data"])

        return chunks.groupBy("stream_id").applyInPandas(whole, FRAMES)

    class Reframe(StatefulProcessor):
        def init(self, handle) -> None:
            self.kept = handle.getValueState("kept", "rest binary, frames long")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            rest, at = self.kept.get() if self.kept.exists() else (b"", 0)
            done, rest = _frames(bytes(rest), at, _in_order(rows), size)
            self.kept.update((rest, at + len(done)))
            yield pd.DataFrame([(key[0], *f) for f in done], columns=["stream_id", "frame", "data"])

        def close(self) -> None:
            pass

    return chunks.groupBy("stream_id").transformWithStateInPandas(Reframe(), FRAMES, "Append", "None")


#: Samples of a frame of 20 ms at 16 kHz, two bytes each; frames between two reports of the level; silence.
SAMPLES, LEVEL_FRAMES, SILENCE = 320, 5, -100.0
HEARD = "stream_id long, frame long, kind string, value double"
_KEPT = f"rest binary, frames long, peak double, {STATE}"


class Ear:
    """One stream of sound: frames, the loudest level of every LEVEL_FRAMES, and where speech begins and ends."""

    def __init__(self, kept: tuple | None = None):
        self.rest, self.frames, self.peak = (bytes(kept[0]), kept[1], kept[2]) if kept else (b"", 0, SILENCE)
        self.voice = Vad(tuple(kept[3:]) if kept else None)

    def state(self) -> tuple:
        return self.rest, self.frames, self.peak, *self.voice.state()

    def feed(self, chunks: list[bytes]) -> list[tuple[int, str, float]]:
        done, self.rest = _frames(self.rest, self.frames, chunks, 2 * SAMPLES)
        out = []
        for frame, data in done:
            power = float(np.mean((np.frombuffer(data, "<i2") / 32768.0) ** 2))
            level = max(10 * math.log10(power), SILENCE) if power > 0 else SILENCE
            self.frames, self.peak = frame + 1, max(self.peak, level)
            out += [(frame, kind, float(n)) for kind, n in self.voice.push(level)]
            if self.frames % LEVEL_FRAMES == 0:
                out.append((frame, "level", round(self.peak, 1)))
                self.peak = SILENCE
        return out


def listened(chunks: DataFrame) -> DataFrame:
    """chunks(stream_id, seq, chunk) of 16-bit sound -> (stream_id, frame, kind, value): `start`, `end` and `drop` of speech
    (value: its frames), and `level` in dB. Chunks may be cut anywhere, within a sample too."""
    columns = ["stream_id", "frame", "kind", "value"]
    if not chunks.isStreaming:

        def whole(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame([(pdf["stream_id"].iloc[0], *e) for e in Ear().feed(_in_order(iter([pdf])))], columns=columns)

        return chunks.groupBy("stream_id").applyInPandas(whole, HEARD)

    class Listen(StatefulProcessor):
        def init(self, handle) -> None:
            self.kept = handle.getValueState("kept", _KEPT)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            ear = Ear(self.kept.get() if self.kept.exists() else None)
            found = ear.feed(_in_order(rows))
            self.kept.update(ear.state())
            yield pd.DataFrame([(key[0], *e) for e in found], columns=columns)

        def close(self) -> None:
            pass

    return chunks.groupBy("stream_id").transformWithStateInPandas(Listen(), HEARD, "Append", "None")


OUTCOME = "user_id long, code long, outcome string, at timestamp"


def pledges(events: DataFrame, late: str = "1 hour", now: datetime | None = None) -> DataFrame:
    """events(user_id, ts, kind, code, due) -> (user_id, code, outcome, at): what became of each pledge.

    A `pawn` row gives a code to be redeemed up to `due`; a `redeem` row at that time at the latest gets it back
    (`redeemed`, at its ts); else it is `lost`, at due. A code is pawned once; what is redeemed without being pawned has no
    outcome. Batches name what is lost up to `now`, without it up to the last ts; streams when the watermark has passed it.
    """
    if not events.isStreaming:
        pawned = events.filter("kind = 'pawn'").groupBy("user_id", "code").agg(F.min(F.struct("ts", "due")).alias("p")).select("user_id", "code", F.col("p.ts").alias("ts"), F.col("p.due").alias("due"))
        back = events.filter("kind = 'redeem'").select("user_id", "code", F.col("ts").alias("_back"))
        met = pawned.join(back, ["user_id", "code"], "left").groupBy("user_id", "code", "ts", "due").agg(F.min(F.when((F.col("_back") >= F.col("ts")) & (F.col("_back") <= F.col("due")), F.col("_back"))).alias("_back"))
        end = events.agg(F.max("ts").alias("_end")) if now is None else events.sparkSession.createDataFrame([(now,)], "_end timestamp")
        out = met.join(F.broadcast(end)).withColumn("outcome", F.when(F.col("_back").isNotNull(), "redeemed").when(F.col("due") < F.col("_end"), "lost"))
        return out.filter("outcome IS NOT NULL").select("user_id", "code", "outcome", F.coalesce("_back", "due").alias("at"))

    class Pledges(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.due = handle.getMapState("due", "code long", "due timestamp, ts timestamp")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            every, out = pd.concat(list(rows)), []
            for r in every[every["kind"] == "pawn"].sort_values("ts").itertuples():
                if not self.due.containsKey((r.code,)):
                    self.due.updateValue((r.code,), (r.due.to_pydatetime(), r.ts.to_pydatetime()))
                    self.handle.registerTimer(int(r.due.timestamp() * 1000))
            for r in every[every["kind"] == "redeem"].sort_values("ts").itertuples():
                if self.due.containsKey((r.code,)):
                    due, ts = self.due.getValue((r.code,))
                    if ts <= r.ts <= due:
                        out.append((key[0], r.code, "redeemed", r.ts))
                        self.due.removeKey((r.code,))
            yield pd.DataFrame(out, columns=["user_id", "code", "outcome", "at"])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            until = datetime.fromtimestamp(expiredTimerInfo.getExpiryTimeInMs() / 1000, UTC).replace(tzinfo=None)
            lost = [(code, value[0]) for (code,), value in list(self.due.iterator()) if value[0].replace(tzinfo=None) <= until]
            for code, _ in lost:
                self.due.removeKey((code,))
            yield pd.DataFrame([(key[0], code, "lost", due) for code, due in lost], columns=["user_id", "code", "outcome", "at"])

        def close(self) -> None:
            pass

    rows = events.withWatermark("ts", late)
    return rows.groupBy("user_id").transformWithStateInPandas(Pledges(), OUTCOME, "Append", "EventTime")

