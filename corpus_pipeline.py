"""A training-data pipeline over `documents`: each stage reads what the one before it wrote."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.llm import bpe, decontam, jaccard, quality, queries, secrets
from textlake.llm.shared import Scratch, fresh, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from labelled ones of `documents`.

    Null and empty texts have the prior's score. Without labels every score is 0.5, so nothing stays.
    """
    model = queries.quality_model(spark, table(spark, sf_dir, "documents"), sf_dir)
    name = fresh(docs.columns, "_score")
    return quality.score(docs, model, name=name).filter(F.col(name) >= queries.GOOD).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, Jaccard similarity 0.8 or more.

    SimHash fingerprints within two bits (op4's) are candidates, the sets decide. Few pairs of that similarity are so near
    (README has figures), so MinHash bands bring the candidates that fingerprints miss.
    Null and empty texts are one group; of a group the least id stays, null ids last.
    """
    return jaccard.drop_near_duplicates(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item of any length; null and empty texts hold none."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), shortest=1)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced in text; n_chars follows. Null texts stay null."""
    done = secrets.scan(docs, secrets.fit(docs))
    text, size = F.col("redacted"), F.length("redacted").cast("long")
    return done.select(*[{"text": text, "n_chars": size}.get(c, F.col(c)).alias(c) for c in docs.columns])


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, checked by decoding: round_trip is whether the text comes back (null: empty)."""
    done = bpe.encode(docs, public_tokenizers.path(queries.BPE_FILE), public_tokenizers.PATTERN, decoded=True)
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return done.select("doc_id", "lang", "source", "n_tokens", "token_ids", same.alias("round_trip"))


STAGES = [("quality", good_quality), ("near_duplicates", one_of_each), ("decontamination", without_benchmark), ("secrets", without_secrets), ("tokens", encoded)]

#: SQL can express none of the trained stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each one's rows written to the shared folder and read again.

    What a stage wrote is deleted once the next one's rows are written.
    """
    scratch, docs, read = Scratch(spark), table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        with Scratch.closing():
            out = stage(spark, docs, sf_dir)
            path = scratch.write(out)
        if read:
            scratch.drop(read)
        docs, read = spark.read.schema(out.schema).parquet(path), path
    return docs
