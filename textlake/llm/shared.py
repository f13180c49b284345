"""What the operators of this subpackage share: reading, cutting lineage, Arrow mapping."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters up to which a word or piece is remembered by a worker: longer ones hardly repeat, and fill it.
SHORT = 64
#: Remainder of crc32(doc_id as text) mod 4 that marks a held-out document.
HELD_OUT = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables in sf_dir."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """True for documents that no model may learn from; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == HELD_OUT


#: Folders made in local mode, by application.
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Unset, a temporary one, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", "")
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _local:
        _local[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='textlake-')}"
    return _local[context.applicationId]


#: What is opened inside the caller's closing(), of its own thread or task alone.
_opened: ContextVar[list | None] = ContextVar("opened", default=None)


class Scratch:
    """Tables written to the shared folder to cut lineage, so that a lost executor costs no recomputation.

    What an operator returns still reads its tables; close() deletes them once its result is written, and
    closing() does so for every Scratch that was opened inside it.
    """

    opened: list[Scratch] = []

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/textlake-{uuid.uuid4().hex}"
        self.made = 0
        Scratch.opened.append(self)
        if (opened := _opened.get()) is not None:
            opened.append(self)

    def write(self, df: DataFrame) -> str:
        self.made += 1
        path = f"{self.root}/{self.made}"
        df.write.parquet(path)
        return path

    def cut(self, df: DataFrame) -> DataFrame:
        """The same rows, read back from a written table."""
        return self.spark.read.schema(df.schema).parquet(self.write(df))

    def drop(self, path: str) -> None:
        """Delete a table that nothing reads any more."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)

    def close(self) -> None:
        """Delete all tables."""
        self.drop(self.root)
        if self in Scratch.opened:
            Scratch.opened.remove(self)

    @staticmethod
    @contextmanager
    def closing() -> Iterator[None]:
        """Close, at the end or when something fails, what this caller opened inside."""
        opened: list[Scratch] = []
        before = _opened.set(opened)
        try:
            yield
        finally:
            _opened.reset(before)
            for one in opened:
                one.close()


def fresh(columns: list[str], stem: str) -> str:
    """A column name that none of `columns` has, whatever their case."""
    taken = {c.lower() for c in columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def small_batches(spark: SparkSession, size: str = "8m") -> None:
    """Bound the bytes of an Arrow batch: ten thousand long texts would else fill a worker. Spark has no such
    option of one frame, so this holds for the session."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def pieces(batches: Iterator[pa.RecordBatch], text: str, budget: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `budget` characters of `text` (a longer text makes a slice of its own)."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        start = used = 0
        for i, size in enumerate(pa.compute.binary_length(column).to_pylist()):
            if i > start and used + (size or 0) > budget:
                yield batch.slice(start, i - start)
                start, used = i, 0
            used += size or 0
        if start < batch.num_rows:
            yield batch.slice(start)


def add_columns(df: DataFrame, text: str, make: Callable[[list], dict[str, pa.Array]], schema: str, budget: int = 2_000_000) -> DataFrame:
    """Append the columns that make(list of texts, null for null) gives; columns of those names are replaced.

    schema is a DDL string of the new columns. Rows stay where they are: no shuffle. Other columns pass
    through, whatever their names; no rows give no rows.
    """
    spark = df.sparkSession
    small_batches(spark)
    new = spark.createDataFrame([], schema).schema
    kept = df.drop(*[f.name for f in new])
    out = type(new)([*kept.schema.fields, *new.fields])
    names, added, own = kept.columns, [f.name for f in new], fresh(df.columns, "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, own, budget):
            made = make(part.column(part.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *[made[n] for n in added]], names=[*names, *added])

    return kept.withColumn(own, F.col(text).cast("string") if text in kept.columns else df[text]).mapInArrow(run, out)
