"""Structured Streaming over event streams, each with the same plan for batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet files that appear at path."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and type; a stream drops what is later than `late`."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "1 hour", step: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", size, step)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, started, n): session windows; events exactly the gap apart are one session."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("started"), "n")


def first_of_day(events: DataFrame, late: str = "1 day") -> DataFrame:
    """One event per user and day: the daily coupon."""
    rows = events.withColumn("day", F.to_date("ts"))
    if events.isStreaming:
        return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["user_id", "day"])
    return rows.dropDuplicates(["user_id", "day"])


class Vad:
    """Voice activity over frames of one stream, by level with a noise floor that follows slowly up and fast down.

    Opens when enough of the last frames are loud, closes after quiet frames or at the longest length; a
    segment with too few loud frames is dropped. Fixed values in frames of 20 ms.
    """

    WARM, RISE, FALL, ABOVE, OPEN, RECENT, QUIET, LONGEST, LEAST = 15, 0.04, 0.25, 10.0, 3, 5, 35, 750, 8

    def __init__(self, state: tuple | None = None):
        self.seen, self.floor, self.recent, self.open, self.quiet, self.length, self.loud, self.warm = state or (0, 0.0, "", False, 0, 0, 0, "")

    def state(self) -> tuple:
        return self.seen, self.floor, self.recent, self.open, self.quiet, self.length, self.loud, self.warm

    def push(self, level: float) -> list[tuple[str, int]]:
        """Events (kind, frames) of one frame: start, end or drop."""
        self.seen += 1
        if self.seen <= self.WARM:
            self.warm += f"{level},"
            if self.seen == self.WARM:
                levels = sorted(float(x) for x in self.warm.split(",") if x)
                self.floor, self.warm = levels[len(levels) // 2], ""
            return []
        loud = level > self.floor + self.ABOVE
        self.recent = (self.recent + "01"[loud])[-self.RECENT :]
        if not self.open:
            self.floor += (self.RISE if level > self.floor else self.FALL) * (level - self.floor)
            if self.recent.count("1") >= self.OPEN:
                self.open, self.quiet, self.length, self.loud = True, 0, 0, self.recent.count("1")
                return [("start", 0)]
            return []
        self.length += 1
        self.loud += loud
        self.quiet = 0 if loud else self.quiet + 1
        if self.quiet < self.QUIET and self.length < self.LONGEST:
            return []
        kind = "end" if self.loud >= self.LEAST else "drop"
        out, self.open, self.recent = [(kind, self.length)], False, ""
        return out


STATE = "seen int, floor double, recent string, open boolean, quiet int, length int, loud int, warm string"
OUTPUT = "stream_id long, seq long, kind string, frames int"


def vad(frames: DataFrame) -> DataFrame:
    """frames(stream_id, seq, level_db) -> (stream_id, seq, kind, frames). Frames of a key are taken by rising seq;
    a stream keeps each key's state between batches."""
    if not frames.isStreaming:

        def whole(pdf: pd.DataFrame) -> pd.DataFrame:
            own, out = Vad(), []
            for r in pdf.sort_values("seq").itertuples():
                out += [(r.stream_id, r.seq, kind, n) for kind, n in own.push(float(r.level_db))]
            return pd.DataFrame(out, columns=["stream_id", "seq", "kind", "frames"])

        return frames.groupBy("stream_id").applyInPandas(whole, OUTPUT)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own, out = Vad(state.get if state.exists else None), []
        for r in pd.concat(list(batches)).sort_values("seq").itertuples():
            out += [(key[0], r.seq, kind, n) for kind, n in own.push(float(r.level_db))]
        state.update(own.state())
        yield pd.DataFrame(out, columns=["stream_id", "seq", "kind", "frames"])

    return frames.groupBy("stream_id").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def countdown(events: DataFrame, uses: int = 3) -> DataFrame:
    """A modifier bought at an event of type `purchase` holds for the user's next `uses` events: how many have it."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    bought = F.last(F.when(F.col("event_type") == "purchase", F.col("n")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    numbered = events.withColumn("n", F.row_number().over(w)).withColumn("bought", bought)
    return numbered.withColumn("left", F.greatest(F.lit(0), uses - (F.col("n") - F.col("bought") - 1))).select("event_id", "user_id", F.coalesce("left", F.lit(0)).alias("left"))
