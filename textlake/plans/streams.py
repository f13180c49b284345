"""Registered queries that run as streams: their rows come in parts, each part a run that goes on from the last one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.plans.evaluation import written
from textlake.plans.queries import query, table
from textlake.streaming import crawl, stateful


def _run(spark: SparkSession, parts: list[DataFrame], make: Callable[[DataFrame, str, str], object]) -> str:
    """A folder that holds what `make(stream, output, checkpoint)` started for each part, one after the other."""
    root = written(spark, lambda path: None)
    for part in parts:
        part.write.mode("append").parquet(f"{root}/in")
        started = make(spark.readStream.schema(parts[0].schema).parquet(f"{root}/in"), f"{root}/out", f"{root}/checkpoint")
        started.awaitTermination()
    return f"{root}/out"


@query("""WITH d AS (SELECT doc_id AS k, coalesce(source, '-') || '/' || doc_id AS path, coalesce(text, '') AS text FROM documents WHERE doc_id IS NOT NULL),
a AS (SELECT *, row_number() OVER (ORDER BY path) AS doc_id FROM d WHERE k % 2 = 0), b AS (SELECT *, row_number() OVER (ORDER BY path) + (SELECT count(*) FROM a) AS doc_id FROM d WHERE k % 2 = 1)
SELECT path, doc_id, sha1(CASE WHEN k % 10 = 0 THEN 'new ' || text ELSE text END) AS hash, CAST(CASE WHEN k % 10 = 0 THEN 1 ELSE 0 END AS BIGINT) AS batch FROM a WHERE k % 14 <> 0 OR k % 10 = 0 UNION ALL SELECT path, doc_id, sha1(text), 1 FROM b""")
def crawled_stream(spark, sf_dir):
    """Documents found in two runs: first the even ones; then the odd ones, changes of every tenth, and every fourteenth gone."""
    rows = table(spark, sf_dir, "documents").filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("k"), F.concat_ws("/", F.coalesce("source", F.lit("-")), F.col("doc_id").cast("string")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    first = rows.filter("k % 2 = 0").select("path", F.col("text").alias("content"))
    changed = F.when(F.col("k") % 10 == 0, F.concat(F.lit("new "), "text")).when(F.col("k") % 2 == 1, F.col("text"))
    second = rows.filter("k % 2 = 1 OR k % 10 = 0 OR k % 14 = 0").select("path", changed.alias("content"))
    out = _run(spark, [first, second], crawl.start)
    return crawl.current(crawl.log(spark, out)).select("path", "doc_id", "hash", "batch")


def _append(stream: DataFrame, output: str, checkpoint: str):
    with stateful.rocksdb(stream.sparkSession):
        return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(output)


@query("""WITH c AS (SELECT conv_id, encode(string_agg(coalesce(text, ''), '' ORDER BY turn)) AS b FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id)
SELECT conv_id AS stream_id, i AS frame, sha256(b[i * 64 + 1:i * 64 + 64]) AS digest FROM c, range(0, octet_length(b) // 64) t(i)""")
def reframed_turns(spark, sf_dir):
    """The bytes of every conversation in frames of 64, from a stream of its turns in three parts."""
    rows = table(spark, sf_dir, "conversations").filter("conv_id IS NOT NULL AND turn IS NOT NULL").select(F.col("conv_id").alias("stream_id"), F.col("turn").alias("seq"), F.coalesce("text", F.lit("")).cast("binary").alias("chunk"))
    parts = [rows.filter(c) for c in ("seq < 2", "seq BETWEEN 2 AND 4", "seq > 4")]
    out = _run(spark, parts, lambda s, o, c: _append(stateful.reframed(s, 64), o, c))
    return spark.read.schema(stateful.FRAMES).parquet(out).select("stream_id", "frame", F.sha2("data", 256).alias("digest"))


@query("""WITH p AS (SELECT user_id, event_id AS code, ts, ts + INTERVAL 6 HOUR AS due FROM events WHERE event_type = 'purchase'),
r AS (SELECT user_id, ts FROM events WHERE event_type <> 'purchase'),
m AS (SELECT p.user_id, p.code, p.due, min(r.ts) AS back FROM p LEFT JOIN r ON r.user_id = p.user_id AND r.ts >= p.ts AND r.ts <= p.due GROUP BY ALL)
SELECT user_id, code, CASE WHEN back IS NULL THEN 'lost' ELSE 'redeemed' END AS outcome, coalesce(back, due) AS ended FROM m WHERE back IS NOT NULL OR due < (SELECT max(ts) FROM events)""")
def pledge_outcomes(spark, sf_dir):
    """Purchases as pledges of six hours, redeemed by the user's next event of another kind."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_type", F.col("event_id").alias("code"))
    pawned = events.filter("event_type = 'purchase'").select("user_id", "ts", F.lit("pawn").alias("kind"), "code", (F.col("ts") + F.expr("INTERVAL 6 HOURS")).alias("due"))
    back = events.filter("event_type <> 'purchase'").select("user_id", F.col("ts").alias("_ts"))
    near = pawned.join(back, "user_id").filter("_ts >= ts AND _ts <= due").select("user_id", F.col("_ts").alias("ts"), F.lit("redeem").alias("kind"), "code", F.lit(None).cast("timestamp").alias("due"))
    last = events.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("long").alias("user_id"), "ts", F.lit("none").alias("kind"), F.lit(-1).cast("long").alias("code"), F.lit(None).cast("timestamp").alias("due"))
    return stateful.pledges(pawned.union(near).union(last)).withColumnRenamed("at", "ended")
