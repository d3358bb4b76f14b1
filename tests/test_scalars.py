"""Display and conversion functions against plain Python."""

import hashlib
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tickloom.functions import ticks as X


def test_amounts(spark):
    d = spark.createDataFrame([(0, 100), (5, 100), (99999, 100), (12345678901, 100), (-1234567, 1000), (None, 100)], "t long, size long")
    got = [tuple(r) for r in d.select(X.grouped_ticks("t", "size"), X.grouped_ticks("t", "size", currency=True, sign=True)).collect()]
    assert got[:5] == [("0.00", "₹0.00"), ("0.05", "+₹0.05"), ("999.99", "+₹999.99"), ("12,34,56,789.01", "+₹12,34,56,789.01"), ("-1,234.567", "-₹1,234.567")]
    assert got[5] == (None, None)


def test_percent_tone_and_clock(spark):
    d = spark.createDataFrame([(1.234, 0), (-0.5, 3_723_000), (0.0, 86_399_999)], "v double, ms long")
    assert [tuple(r) for r in d.select(X.signed_percent("v"), X.tone("v"), X.clock("ms")).collect()] == [("+1.23%", "up", "00:00:00"), ("-0.50%", "down", "01:02:03"), ("0.00%", "flat", "23:59:59")]


def test_day_ranges(spark):
    d = spark.createDataFrame([(1, 1), (2, 5)], "a int, b int").select(X.day_range_minutes("a", "b").alias("m")).select("m.*")
    assert [tuple(r) for r in d.collect()] == [(0, 1440), (1440, 7200)]
    for bad in [(0, 1), (3, 2)]:
        with pytest.raises(Exception, match="days must be"):
            spark.createDataFrame([bad], "a int, b int").select(X.day_range_minutes("a", "b")).collect()


def test_hash_halves(spark):
    h = hashlib.sha256(b"config").hexdigest()
    r = spark.range(1).select(X.hash_halves(F.lit(h)).alias("x")).select("x.*").first()
    assert (int(r["hi"]), int(r["lo"])) == (int(h[:16], 16), int(h[16:32], 16))


def test_wrapped(spark):
    n = [0, 1, -1, (1 << 63) - 1, 1 << 63, (1 << 63) + 5, (1 << 64) - 1, 1 << 64, (1 << 64) + 7, 10**30, -(1 << 63), -(1 << 63) - 1, None]
    d = spark.createDataFrame([(k, None if x is None else Decimal(x)) for k, x in enumerate(n)], "k int, n decimal(38,0)")
    got = [r["w"] for r in d.select("k", X.wrapped("n").alias("w")).orderBy("k").collect()]
    assert got == [None if x is None else (x + (1 << 63)) % (1 << 64) - (1 << 63) for x in n]
    assert d.select(X.wrapped("n").alias("w")).schema["w"].dataType.simpleString() == "bigint"


def test_state_snapshot_beyond_a_long(spark, tmp_path):
    """70,000 accounts, whose 48-bit hashes sum up to more than 2^63."""
    from tickloom.plans import market
    from tickloom.sources.market import INITIAL_CASH

    users = 70_000
    e = spark.range(users).select(F.col("id").alias("event_id"), F.lit("2024-01-01").cast("timestamp_ntz").alias("ts"), F.col("id").alias("user_id"), F.lit("signup").alias("event_type"), F.lit(1.0).alias("value"), F.lit('{"k": 1}').alias("props"))
    e.write.parquet(f"{tmp_path}/events.parquet")
    total = sum(int(hashlib.sha256(f"{u}:{INITIAL_CASH}".encode()).hexdigest()[:12], 16) for u in range(users))
    assert total >= 1 << 63
    got = {r["tbl"]: (r["n"], r["digest"]) for r in market.queries()["state_snapshot"](spark, str(tmp_path)).collect()}
    assert got == {"cash": (users, total - (1 << 64))}
