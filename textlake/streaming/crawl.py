"""An incremental crawl as a stream: changed rows are logged batch by batch, ids go on from the highest one logged."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LOG = "path string, doc_id long, hash string, content string, state string, batch long"


def numbered(rows: DataFrame, order: str, name: str = "n") -> DataFrame:
    """Rows with numbers from 1 by a column of different values, without one task for all: rows are dealt by ranges and
    counted there; what stands before a range is the sum of a row for each range."""
    dealt = rows.repartitionByRange(F.col(order)).withColumn("_range", F.spark_partition_id())
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_size"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(order))
    return dealt.withColumn("_own", own).join(before.drop("_size"), "_range").withColumn(name, F.col("_own") + F.col("_before")).drop("_range", "_own", "_before")


def log(spark: SparkSession, target: str) -> DataFrame:
    """Everything logged so far; no rows if nothing is."""
    try:
        return spark.read.schema(LOG).parquet(target)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], LOG)


def current(logged: DataFrame) -> DataFrame:
    """(path, doc_id, hash, content, batch): the last that is logged of every path that is not gone."""
    last = logged.groupBy("path").agg(F.max_by(F.struct("doc_id", "hash", "content", "state", "batch"), "batch").alias("x"))
    return last.select("path", "x.*").filter("state <> 'gone'").drop("state")


def merge(files: DataFrame, target: str, batch: int) -> None:
    """Log what is new, changed or gone among files(path, content), as batch `batch`; the same batch twice is the same log.

    A null content says that a path is gone. Of a path that stands twice the greatest content counts. A path that comes
    back has its old id. Unchanged paths and paths gone before they were known are not logged.
    """
    spark = files.sparkSession
    before = log(spark, target).filter(F.col("batch") < batch)
    seen = before.groupBy("path").agg(F.max_by(F.struct("doc_id", "hash", "state"), "batch").alias("x")).select("path", F.col("x.doc_id").alias("known"), F.col("x.hash").alias("old"), F.col("x.state").alias("was"))
    rows = files.groupBy("path").agg(F.max("content").alias("content")).withColumn("hash", F.sha1("content"))
    met = rows.join(seen, "path", "left")
    gone, fresh = F.col("content").isNull(), F.col("known").isNull()
    state = F.when(gone & ~fresh & (F.col("was") != "gone"), "gone").when(~gone & fresh, "new").when(~gone & ((F.col("was") == "gone") | (F.col("hash") != F.col("old"))), "changed")
    changed = met.withColumn("state", state).filter("state IS NOT NULL")
    mark = before.agg(F.coalesce(F.max("doc_id"), F.lit(0)).alias("mark"))  # one row
    ids = numbered(changed.filter("state = 'new'").select("path"), "path").join(F.broadcast(mark)).select("path", (F.col("n") + F.col("mark")).alias("given"))
    out = changed.join(ids, "path", "left").select("path", F.coalesce("known", "given").alias("doc_id"), "hash", "content", "state")
    out.write.mode("overwrite").parquet(f"{target}/batch={batch}")


def start(files: DataFrame, target: str, checkpoint: str):
    """A query that logs a stream of files(path, content) as they come, until none is left; it goes on where the last one
    with the same checkpoint ended."""

    def each(rows: DataFrame, batch: int) -> None:
        merge(rows, target, batch)

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
