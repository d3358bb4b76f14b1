"""Typed views of an exchange's log over the `events` table, and the other inputs of the operators.

`events` is ordered by `event_id` and its time never goes back, so every
view is a projection of it; only the account records need a window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Symbol, name, ticks of one unit, lot size.
SYMBOLS = [
    (1, "QAA", 100, 1), (2, "QAB", 100, 1), (3, "QAC", 100, 1), (4, "QAD", 100, 1), (5, "QAE", 10_000, 10),
    (6, "QAF", 10_000, 10), (7, "QAG", 100_000, 100), (8, "QAH", 1_000, 1), (9, "QAI", 1_000, 1), (10, "QAJ", 1_000, 1),
]
INITIAL_CASH = 10_000_000
MARKET_MAKERS = 10  # users below are market makers
SEQ = ("seq_ms", "seq_ord")


def symbol_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SYMBOLS, "symbol_id int, name string, tick_size_ticks long, lot_size long")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark.read.parquet(f"{sf_dir}/events.parquet"))


def view(events: DataFrame) -> DataFrame:
    """The log's base view of an events table or stream."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return events.select(
        F.call_function("div", us, F.lit(1000)).alias("seq_ms"),
        F.col("event_id").alias("seq_ord"),
        (us * 1000).alias("timestamp_ns"),
        (F.col("event_id") % 10 + 1).cast("int").alias("symbol_id"),
        "user_id",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        "event_type",
        F.round(F.col("value") * 100).cast("long").alias("price_ticks"),
    )


def accepts(b: DataFrame) -> DataFrame:
    """OrderAccepted records: each view is a buy, each click a sell."""
    return b.where(F.col("event_type").isin("view", "click")).select(
        *SEQ, "timestamp_ns", "symbol_id", "user_id", F.col("seq_ord").alias("order_id"), F.col("seq_ord").alias("client_order_id"),
        F.when(F.col("event_type") == "view", 1).otherwise(2).alias("side"), "price_ticks", (1 + F.col("k")).alias("qty"),
    )


def fills(b: DataFrame) -> DataFrame:
    """Fill records: each purchase."""
    k = F.col("k")
    return b.where("event_type = 'purchase'").select(
        *SEQ, "timestamp_ns", "symbol_id", "price_ticks", (1 + k % 20).alias("qty"), (1 + k % 2).cast("int").alias("aggressor_side"),
        (F.col("seq_ord") - 10 * (1 + k % 50)).alias("maker_order_id"), (F.col("seq_ord") - 10 * (1 + (k + 7) % 50)).alias("taker_order_id"),
        F.col("user_id").alias("maker_user_id"), ((F.col("user_id") * 7 + 3) % 150).alias("taker_user_id"),
    )


def cancels(b: DataFrame) -> DataFrame:
    """OrderCancelled records: each error."""
    k = F.col("k")
    return b.where("event_type = 'error'").select(
        *SEQ, "timestamp_ns", "symbol_id", "user_id", (F.col("seq_ord") - 10 * (1 + k % 20)).alias("order_id"),
        (1 + k % 10).alias("remaining_qty"), (1 + k % 2).cast("int").alias("reason"),
    )


def account_records(b: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """AccountCreated (a user's first signup) and CashCredited (later ones); users in `known` have signed up before."""
    first = F.row_number().over(W.partitionBy("user_id").orderBy(*SEQ)) == 1
    b = b.where("event_type = 'signup'")
    if known is not None:
        b = b.join(known.select("user_id", F.lit(True).alias("_known")), "user_id", "left")
        first = first & F.col("_known").isNull()
    return b.select(
        *SEQ, "timestamp_ns", "user_id", first.alias("created"), F.when(first, F.lit(INITIAL_CASH)).otherwise(F.col("price_ticks")).cast("long").alias("amount_ticks")
    )


def inbound(b: DataFrame) -> DataFrame:
    """SubmitOrder for each view or click and CancelOrder for each error, a millisecond before the answer."""
    k, is_cancel = F.col("k"), F.col("event_type") == "error"
    return b.where(F.col("event_type").isin("view", "click", "error")).select(
        (F.col("seq_ms") - 1).alias("seq_ms"), "seq_ord", (F.col("timestamp_ns") - 1_000_000).alias("timestamp_ns"),
        F.when(is_cancel, "cancel").otherwise("submit").alias("record_type"), "user_id", "symbol_id",
        F.col("seq_ord").alias("client_order_id"), F.when(F.col("event_type") == "click", 2).otherwise(1).alias("side"),
        F.when(k % 10 == 0, 2).otherwise(1).alias("tif"), "price_ticks", (1 + k).alias("qty"),
        F.when(is_cancel, F.col("seq_ord") - 10 * (1 + k % 20)).alias("target_client_order_id"),
    )


def numbered(rows: DataFrame, by: str, name: str, width: int = 1_000_000) -> DataFrame:
    """Adds `name`: 0, 1, 2, .. within `by` in the order of seq_ord.

    Rows are numbered in ranges of `width` ids, which hold so many rows at
    most, and each range goes on from the count of those before it.
    """
    x = rows.withColumn("_part", F.call_function("div", F.col("seq_ord"), F.lit(width)))
    sizes = x.groupBy(by, "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(by).orderBy("_part")) - F.col("_n")
    starts = sizes.select(by, "_part", before.alias("_before"))
    own = F.row_number().over(W.partitionBy(by, "_part").orderBy("seq_ord")) - 1
    return x.withColumn("_own", own).join(starts, [by, "_part"]).withColumn(name, (F.col("_own") + F.col("_before")).cast("long")).drop("_part", "_own", "_before")


def price_history(b: DataFrame) -> DataFrame:
    return numbered(b.select("symbol_id", "seq_ord", F.col("price_ticks").alias("close_ticks")), "symbol_id", "minute_index").select("symbol_id", "minute_index", "close_ticks")


def load_samples(b: DataFrame) -> DataFrame:
    """Load samples: intended, sent and acknowledged times and a status for each event."""
    sent = F.col("timestamp_ns") + F.col("k") * 1000
    status = F.expr("case event_type when 'view' then 202 when 'click' then 202 when 'purchase' then 200 when 'error' then 429 else 500 end")
    return b.select(F.col("seq_ord").alias("client_order_id"), F.col("timestamp_ns").alias("intended_ns"), sent.alias("sent_ns"), (sent + F.col("price_ticks") * 1000).alias("acked_ns"), status.alias("status"), "k")
