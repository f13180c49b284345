"""Models as tables: weights and classes in versioned folders, read back without the trainer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textlake.operators.parsing import Parser
from textlake.operators.tagger import Tagger

WEIGHTS = "part string, feature string, class string, weight double"
CLASSES = "part string, place int, class string"


def _weights(part: str, weights: dict) -> list[tuple]:
    return [(part, f, c, float(w)) for f, table in weights.items() for c, w in table.items()]


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions of a model that are whole, rising."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(root):
        return []
    names = [str(s.getPath().getName()) for s in store.listStatus(root)]
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    whole = [n for n in names if n.startswith("version=") and store.exists(done(f"{path}/{n}/weights/_SUCCESS"))]
    return sorted(int(n.split("=")[1]) for n in whole)


def save_tables(weights: DataFrame, classes: DataFrame, path: str) -> int:
    """Write a new version of weights(part, feature, class, weight) and classes(part, place, class); its number. The weights
    are written last, so a version that lacks them was never finished and is passed over."""
    spark = weights.sparkSession
    number = max(versions(spark, path), default=0) + 1
    classes.select("part", "place", "class").write.mode("overwrite").parquet(f"{path}/version={number}/classes")
    weights.select("part", "feature", "class", "weight").write.mode("overwrite").parquet(f"{path}/version={number}/weights")
    return number


def load_tables(spark: SparkSession, path: str, version: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(weights, classes) of a version, without a number of the last."""
    found = versions(spark, path)
    if not found or (version is not None and version not in found):
        raise FileNotFoundError(f"no version {version or ''} of a model at {path}")
    at = f"{path}/version={version or found[-1]}"
    return spark.read.schema(WEIGHTS).parquet(f"{at}/weights"), spark.read.schema(CLASSES).parquet(f"{at}/classes")


def pruned(weights: DataFrame, least: float) -> DataFrame:
    """Without the weights that are smaller than `least` either way."""
    return weights.filter(F.abs("weight") >= least)


def _classes(rows: DataFrame, part: str) -> list[str]:
    return [r["class"] for r in rows.filter(F.col("part") == part).orderBy("place").collect()]


def _dict(rows: DataFrame, part: str) -> dict:
    out: dict = {}
    for r in rows.filter(F.col("part") == part).toLocalIterator():
        out.setdefault(r["feature"], {})[r["class"]] = r["weight"]
    return out


def save_tagger(spark: SparkSession, model: Tagger, path: str, least: float = 0.0) -> int:
    weights = spark.createDataFrame(_weights("tags", model.weights), WEIGHTS)
    return save_tables(pruned(weights, least), spark.createDataFrame([("tags", i, c) for i, c in enumerate(model.classes)], CLASSES), path)


def load_tagger(spark: SparkSession, path: str, version: int | None = None) -> Tagger:
    weights, classes = load_tables(spark, path, version)
    return Tagger(_classes(classes, "tags"), _dict(weights, "tags"))


def save_parser(spark: SparkSession, model: Parser, path: str, least: float = 0.0) -> int:
    weights = spark.createDataFrame(_weights("moves", model.moves) + _weights("arcs", model.arcs), WEIGHTS)
    return save_tables(pruned(weights, least), spark.createDataFrame([("labels", i, c) for i, c in enumerate(model.labels)], CLASSES), path)


def load_parser(spark: SparkSession, path: str, version: int | None = None) -> Parser:
    weights, classes = load_tables(spark, path, version)
    return Parser(_dict(weights, "moves"), _classes(classes, "labels"), _dict(weights, "arcs"))


def save_profiles(profiles: DataFrame, path: str) -> int:
    """Profiles (owner, feature, n, rank, weight): the owner is the class, the count a part of its own. Never on the driver."""
    counts = profiles.select(F.lit("count").alias("part"), "feature", F.col("owner").alias("class"), F.col("n").cast("double").alias("weight"))
    shares = profiles.select(F.lit("share").alias("part"), "feature", F.col("owner").alias("class"), "weight")
    owners = profiles.select("owner").distinct().withColumn("place", F.row_number().over(Window.orderBy("owner")) - 1)
    return save_tables(shares.union(counts), owners.select(F.lit("owners").alias("part"), "place", F.col("owner").alias("class")), path)


def load_profiles(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """Profiles as they were, ranked anew by falling count, then feature."""
    weights, _ = load_tables(spark, path, version)
    shares = weights.filter("part = 'share'").select(F.col("class").alias("owner"), "feature", "weight")
    counts = weights.filter("part = 'count'").select(F.col("class").alias("owner"), "feature", F.col("weight").cast("long").alias("n"))
    rank = F.row_number().over(Window.partitionBy("owner").orderBy(F.desc("n"), "feature")) - 1
    return shares.join(counts, ["owner", "feature"]).withColumn("rank", rank).select("owner", "feature", "n", "rank", "weight")
