"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.llm.shared import Scratch


def _print(edges: DataFrame) -> tuple:
    """A digest of an edge set: equal sets give equal digests."""
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges(u, v) of longs -> (node, root): each node that has an edge, and the smallest node it can reach.

    Every round links the neighbours of a node to its smallest neighbour, first those above it, then those
    below, which halves the depth of what is left; the rounds grow as the logarithm of the longest chain.
    A round is two groupings and joins of the edge table, whose join Spark may split at a hot node; each
    round's table is written to the shared folder and the one before deleted. No edges give no rows.
    """
    spark = edges.sparkSession
    now = scratch.write(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        e = spark.read.parquet(now)
        if (digest := _print(e)) == before or not digest[0]:
            break
        before = digest
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        high = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # each node of `high` now links to smaller nodes only; link those and the node to the least of them
        low = high.groupBy("u").agg(F.min("v").alias("m"))
        new = high.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        then = scratch.write(new.filter("u <> v").distinct())
        scratch.drop(now)
        now = then
    stars = spark.read.parquet(now)
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).union(stars.select("v", "v").distinct())
