"""Sessions, and getting this package to the executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once a Spark application: their Python workers import it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    made = Path(tempfile.mkdtemp()) / "textlake.zip"
    with zipfile.ZipFile(made, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    context.addPyFile(str(made))
    _shipped.add(context.applicationId)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written once to a folder that driver and executors share and read back: spark.checkpoint.dir, or in
    local mode a temporary one. For what a plan reads several times and what is dear to make."""
    spark = df.sparkSession
    shared, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not shared and master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"{shared.rstrip('/') if shared else 'file://' + tempfile.mkdtemp(prefix='spark-')}/textlake-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session on this machine, for tests and benches."""
    conf = {"spark.sql.shuffle.partitions": partitions, "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"}
    spark = SparkSession.builder.master(f"local[{cores}]").appName("textlake").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
