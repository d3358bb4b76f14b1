"""Archive, read model and result documents."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.ticks import utc_date


def shared_folder(spark: SparkSession, prefix: str) -> str:
    """A new folder that driver and executors share: below the one that spark.checkpoint.dir names, or a temporary one where all run on this machine."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(named or tempfile.mkdtemp(prefix='spark-')).rstrip('/')}/{prefix}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the shared folder, for what several steps read: it is computed once, and a lost executor takes nothing with it."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def archive_write(rows: DataFrame, symbols: DataFrame, path: str, time_col: str, unit_ns: int | None = None) -> None:
    """Rows to <path>/symbol=../date=..[/unit=..], zstd; an unknown symbol becomes id=<n>.

    Paths follow from the data and only the partitions present are replaced,
    so writing a unit again leaves the same rows.
    """
    from tickloom.functions.ticks import bucket, unit_label

    name = F.coalesce(F.col("name"), F.concat(F.lit("id="), F.col("symbol_id").cast("string")))
    x = rows.join(F.broadcast(symbols.select("symbol_id", "name")), "symbol_id", "left").withColumn("symbol", name).drop("name").withColumn("date", utc_date(time_col))
    by = ["symbol", "date"]
    if unit_ns:
        x, by = x.withColumn("unit", unit_label(bucket(time_col, unit_ns))), [*by, "unit"]
    x.repartition(*by).write.mode("overwrite").option("compression", "zstd").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def archive_scan(spark: SparkSession, path: str, symbols: list[str] | None = None, first: str | None = None, last: str | None = None) -> DataFrame:
    """The archive, pruned by symbol and date partitions."""
    x = spark.read.parquet(path)
    if symbols is not None:
        x = x.where(F.col("symbol").isin(symbols))
    if first is not None:
        x = x.where(F.col("date") >= F.lit(first).cast("date"))
    if last is not None:
        x = x.where(F.col("date") <= F.lit(last).cast("date"))
    return x


def archive_stats(spark: SparkSession, path: str) -> DataFrame:
    """Files and bytes by symbol partition, from the listing only."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select("path", "length")
    return files.groupBy(F.regexp_extract("path", "symbol=([^/]*)", 1).alias("symbol")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def upsert(old: DataFrame, changed: DataFrame, keys: list[str], gone: str | None = None) -> DataFrame:
    """The old table with changed keys replaced; changed rows for which the SQL condition `gone` holds leave it."""
    kept = old.join(changed.select(*keys).distinct(), keys, "left_anti")
    new = changed if gone is None else changed.where(f"not ({gone})")
    return kept.unionByName(new.select(old.columns))


def result_json(rows: DataFrame, text: str) -> DataFrame:
    """Adds `document`: the row as JSON with sorted keys and a text on its limits."""
    cols = sorted([*rows.columns, "limitations"])
    return rows.withColumn("document", F.to_json(F.struct(*[F.lit(text).alias(c) if c == "limitations" else F.col(c) for c in cols])))
