"""A training-data pipeline over `documents`: five stages, each on all that the one before kept."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import table
from tickloom.llm.decontam import drop_contaminated
from tickloom.llm.lines import drop_duplicate_lines
from tickloom.llm.mixing import mix_sources
from tickloom.llm.near import drop_near_duplicates
from tickloom.llm.toxicity import drop_toxic, learn_lexicon


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches 0.7 go."""
    return drop_toxic(docs, learn_lexicon(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines with an earlier copy, of any length, or near copy go, and documents of which no word is left; n_chars follows the text."""
    left = drop_duplicate_lines(docs, short=True, words=True)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with `repeats` and the words taken."""
    return mix_sources(docs).where("repeats > 0")


STAGES = [("toxicity", toxicity), ("line dedup", line_dedup), ("near dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing)]

#: The toxicity lexicon is learned, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def _folder(spark: SparkSession) -> str:
    """A new folder in the one that driver and executors share; a temporary one only where all run on this machine."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(named or tempfile.mkdtemp(prefix='spark-')).rstrip('/')}/pipeline-{uuid.uuid4().hex}"


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each returns is written as Parquet and read again for the next."""
    docs, folder = table(spark, sf_dir, "documents"), _folder(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
