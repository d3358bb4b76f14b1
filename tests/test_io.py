"""Ingestion, sinks, functions and streams on small hand-made inputs."""

import hashlib
import json
import struct

import pytest
from pyspark.sql import functions as F

from tickloom.functions import ticks as X
from tickloom.operators import bars as B
from tickloom.operators import ledger as L
from tickloom.operators import risk as R
from tickloom.sources import ingest, market, sinks
from tickloom.streaming import queries as S
from tickloom.streaming import readmodel as RM

EVENTS = "/root/testdata/sf0.001/events.parquet"


def test_decode(spark):
    head = lambda t, v=2: struct.pack("<HHQQq", v, t, 0, 0, -5)
    big = (1 << 64) - 3
    rows = [
        ("17-3", head(12) + struct.pack("<QQQQqqhB", 1, 2, big, 4, -7, 9, -2, 1)), ("18", head(1) + struct.pack("<QQqqhBB", big, 2, 3, 4, 5, 1, 2)),
        ("19-0", head(12, 1) + b"x"), ("19-1", head(99)), ("19-2", head(12) + b"x"), ("19-3", b"abc"), ("19-4", None),
    ]
    good, bad = ingest.decode_wire_log(spark.createDataFrame([(a, bytearray(b) if b is not None else None) for a, b in rows], "stream_id string, payload binary"))
    g = {r["stream_id"]: r for r in good.collect()}
    f = g["17-3"]
    assert (f["seq_ms"], f["seq_ord"], f["timestamp_ns"], f["record"]) == (17, 3, -5, "Fill")
    assert (int(f["maker_user_id"]), f["price_ticks"], f["qty"], f["symbol_id"], f["aggressor_side"]) == (big, -7, 9, -2, 1)
    assert int(g["18"]["client_order_id"]) == big and g["18"]["seq_ord"] == 0
    assert {r["stream_id"]: r["reason"] for r in bad.collect()} == {"19-0": "schema_version", "19-1": "record_type", "19-2": "size", "19-3": "short", "19-4": "short"}


def test_frames_and_breaches(spark):
    lines = [json.dumps({"ch": "book:QAA", "seq": "1-2", "bids": [[5, 1], [4, 2]], "asks": []}), "{broken", json.dumps({"ch": "tape:QAB", "price_ticks": 7, "qty": 3})]
    f = ingest.parse_frames(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r["kind"], r["subject"]) for r in f] == [("book", "QAA"), (None, None), ("tape", "QAB")]
    assert [tuple(x) for x in f[0]["bids"]] == [(5, 1), (4, 2)] and f[0]["asks"] == []
    text = [
        'bots-1 | 2026-01-02T03:04:05Z obligation_breach {"kind": "not_two_sided"}', "2026-01-02T03:04:05Z obligation_breach {broken",
        'no time obligation_breach {"kind": "x"}', "2026-01-02T03:04:05Z obligation_breach {}", "other line",
    ]
    b = ingest.parse_breaches(spark.createDataFrame([(x,) for x in text], "value string")).collect()
    assert sorted(r["kind"] for r in b) == ["not_two_sided", "unknown"]


def test_verify_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"one")
    d = spark.createDataFrame([("a.bin", hashlib.sha256(b"one").hexdigest()), ("b.bin", "00")], "name string, expected string")
    assert {r["name"]: r["ok"] for r in ingest.verify_files(spark, str(tmp_path), d).collect()} == {"a.bin": True, "b.bin": False}


def test_archive(spark, tmp_path):
    day = 86_400 * B.NS
    rows = spark.createDataFrame([(1, 10, 0), (1, 11, day), (99, 12, day)], "symbol_id int, price_ticks long, timestamp_ns long")
    path = str(tmp_path / "trades")
    for _ in range(2):  # writing again leaves the same rows
        sinks.archive_write(rows, market.symbol_dim(spark), path, "timestamp_ns", day)
    assert {(r["symbol"], str(r["date"]), r["price_ticks"]) for r in sinks.archive_scan(spark, path).collect()} == {("QAA", "1970-01-01", 10), ("QAA", "1970-01-02", 11), ("id=99", "1970-01-02", 12)}
    assert sinks.archive_scan(spark, path, ["QAA"], "1970-01-02").count() == 1
    stats = {r["symbol"]: r["files"] for r in sinks.archive_stats(spark, path).collect()}
    assert sum(stats.values()) == 3
    b = sinks.archive_scan(spark, path).withColumn("open_ns", F.col("timestamp_ns"))
    assert B.misfiled(b).count() == 0 and B.misfiled(b.withColumn("open_ns", F.col("open_ns") + day)).count() == 3


def test_read_model_upsert(spark):
    old = spark.createDataFrame([(1, 1, 5), (1, 2, 6), (2, 1, 7)], "user_id long, symbol_id int, position long")
    new = spark.createDataFrame([(1, 1, 0), (2, 1, 8), (3, 1, 9)], old.schema)
    got = {tuple(r) for r in sinks.upsert(old, new, ["user_id", "symbol_id"], "position = 0").collect()}
    assert got == {(1, 2, 6), (2, 1, 8), (3, 1, 9)}
    doc = json.loads(sinks.result_json(old.limit(1), "none").first()["document"])
    assert list(doc) == ["limitations", "position", "symbol_id", "user_id"]


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_functions(spark):
    lit = lambda x: F.lit(x).cast("long")
    r = one(spark, a=X.floor_div(lit(-7), 2), b=X.ceil_div(lit(-7), 2), c=X.ceil_div(lit(7), 2), d=X.bucket(lit(-1), 10), e=X.fee(lit(100_000), lit(5), 10), f=X.buy_cost(lit(101), lit(3)))
    assert tuple(r) == (-4, -3, 4, -10, 500, 306)
    r = one(spark, a=X.format_ticks(lit(-12345), lit(100)), b=X.format_ticks(lit(7), lit(1000)), c=X.to_ticks(F.lit(1.25), lit(100)), d=X.stream_ms(F.lit("12-3")), e=X.stream_ord(F.lit("12")), f=X.utc_date(lit(86_400 * B.NS)), g=X.unit_label(lit(3_661 * B.NS)))
    assert tuple(r) == ("-123.45", "0.007", 125, 12, 0, "1970-01-02", "010101")
    r = one(spark, **{f"w{w}_{k}": X.width_label(lit(w), k) for w, k in ((1, 1), (60, 1), (300, 1), (30, 60), (3600, 60))})
    assert tuple(r) == ("1m", "1h", "300m", "30s", "1h")
    with pytest.raises(Exception, match="scale"):
        one(spark, a=X.format_ticks(lit(1), F.lit(None).cast("long")))
    r = one(spark, a=X.half_even(F.lit("2.5").cast("decimal(10,3)")), b=X.half_even(F.lit("3.5").cast("decimal(10,3)")))
    assert tuple(r) == (2, 4)


def parts(spark, folder, n=3):
    """The events in files whose order of arrival is their order of time."""
    e = spark.read.parquet(EVENTS).orderBy("event_id").toPandas()
    import os
    import time

    os.makedirs(folder, exist_ok=True)
    for i in range(n):
        piece = e.iloc[i * len(e) // n : (i + 1) * len(e) // n]
        piece.to_parquet(f"{folder}/p{i}.parquet", index=False, coerce_timestamps="us")
        os.utime(f"{folder}/p{i}.parquet", (time.time() - 100 + i, time.time() - 100 + i))


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_streams_in_batches(spark, tmp_path):
    folder = str(tmp_path / "in")
    parts(spark, folder)
    b = market.view(spark.read.parquet(EVENTS))
    log = lambda: S.stream_log(spark, folder, 1)
    got = S.with_rocks(spark, lambda: S.run_to_end(S.stream_bars_on_next_trade(log(), 86_400), str(tmp_path / "bars")))
    want = B.split_open(B.bars(B.tape(market.fills(b)), [86_400])).where("closed")
    cols = ["symbol_id", "open_ns", "open_ticks", "high_ticks", "low_ticks", "close_ticks", "volume", "trades"]
    assert rows(got, *cols) == rows(want, *cols)
    got = S.with_rocks(spark, lambda: S.run_to_end(S.stream_private(log()), str(tmp_path / "private")))
    assert got.count() == b.count() and got.groupBy("user_id").agg((F.max("user_seq") - F.count("*")).alias("d")).where("d <> 0").count() == 0


def model_tables(model, version):
    return {t: sorted(map(tuple, model.read(t, version).collect())) for t in RM.TABLES}


def batch_tables(b):
    """The model's tables by the batch operators."""
    acc, legs = market.account_records(b), L.fill_legs(market.fills(b))
    cash = {r["user_id"]: r["cash_ticks"] for r in L.cash_balances(L.cash_events(acc, legs)).collect()}
    created = {r["user_id"] for r in acc.where("created").collect()}
    orders = L.open_orders(market.accepts(b), legs, market.cancels(b)).select("order_id", "user_id", "symbol_id", "side", "price_ticks", "qty", "remaining")
    fees = L.house_fees(market.fills(b)).where("date is not null").select("symbol_id", "date", "fees", "fills")
    found = {"positions": L.positions(legs), "open_orders": orders, "house_fees": fees}
    return {"accounts": sorted((u, c, u in created) for u, c in cash.items())} | {t: sorted(map(tuple, df.collect())) for t, df in found.items()}


def test_read_model_of_a_stream(spark, tmp_path):
    """Six batches, in which users trade before they sign up, against the batch operators; then a batch that runs again, and old versions that go."""
    b = market.view(spark.read.parquet("/root/testdata/sf0.01/events.parquet").where("event_id <= 600"))
    source = str(tmp_path / "in")
    files = S.write_in_order(spark.read.parquet("/root/testdata/sf0.01/events.parquet").where("event_id <= 600"), source, 6)
    model = RM.ReadModel(spark, str(tmp_path / "m"), 4)
    q = RM.stream_read_model(S.stream_log(spark, source, files), model)
    q.awaitTermination()
    version = RM.last_version(q)
    assert version == 5
    want = batch_tables(b)
    assert model_tables(model, version) == want
    low, high = b.agg(F.min("seq_ord"), F.max("seq_ord")).first()
    model.apply(b.where(F.col("seq_ord") >= low + (high - low + 1) * 5 // 6), version)
    assert model_tables(model, version) == want
    before = model.manifest(version - 1)
    assert model.vacuum(version, 2) > 0
    assert model_tables(model, version) == want and model.manifest(version - 1) == before
    model_tables(model, version - 1)
    # a batch of one user's signup touches one bucket of one table
    model.apply(b.where("event_type = 'signup'").limit(1), version + 1)
    changed = {k for k, v in model.manifest(version + 1).items() if v == version + 1}
    assert len(changed) == 1 and next(iter(changed))[0] == "accounts"


def test_read_model_of_an_emptied_bucket(spark, tmp_path):
    """An order that goes leaves its bucket empty, and a later order comes to it."""
    b = market.view(spark.read.parquet("/root/testdata/sf0.01/events.parquet"))
    model = RM.ReadModel(spark, str(tmp_path / "m"), 1)
    first = b.where("event_type in ('view', 'click')").orderBy("seq_ord").limit(1)
    order = first.first()
    gone = spark.createDataFrame([order]).withColumn("event_type", F.lit("error")).withColumn("k", F.lit(0).cast("long")).withColumn("seq_ord", F.col("seq_ord") + 10).selectExpr(*b.columns)
    model.apply(first, 0)
    assert model.read("open_orders", 0).count() == 1
    for v in range(1, 60):  # the cancel takes one unit at a time
        if not model.read("open_orders", v - 1).count():
            break
        model.apply(gone.withColumn("k", F.lit(9).cast("long")).withColumn("seq_ord", F.lit(order["seq_ord"] + 10 * (1 + 9 % 20))), v)
    assert model.read("open_orders", v - 1).count() == 0
    model.apply(first, v)
    assert model.read("open_orders", v).count() == 1


def test_stream_restart(spark, tmp_path):
    """A query that goes on where it ended neither loses nor repeats a row."""
    folder = str(tmp_path / "in")
    parts(spark, folder, 4)
    import os

    os.makedirs(tmp_path / "later")
    os.rename(f"{folder}/p3.parquet", tmp_path / "later" / "p3.parquet")
    run = lambda: S.run_to_end(S.stream_tape(S.stream_log(spark, folder)), str(tmp_path / "tape"))
    first = run().count()
    os.rename(tmp_path / "later" / "p3.parquet", f"{folder}/p3.parquet")
    got = run()
    want = B.tape(market.fills(market.view(spark.read.parquet(EVENTS))))
    assert 0 < first < want.count() and rows(got, "seq", "price_ticks") == rows(want, "seq", "price_ticks")


def test_stream_archive_and_others(spark, tmp_path):
    folder = str(tmp_path / "in")
    parts(spark, folder)
    log = lambda: S.stream_log(spark, folder, 1)
    archive = S.SealedArchive(spark, market.symbol_dim(spark), str(tmp_path / "a"), 86_400)
    q = S.stream_archive(log(), archive)
    q.awaitTermination()
    b = market.view(spark.read.parquet(EVENTS))
    tape = B.tape(market.fills(b))
    last = b.agg(F.max("timestamp_ns")).first()[0] // (86_400 * B.NS) * 86_400 * B.NS
    archived = lambda: rows(sinks.archive_scan(spark, f"{tmp_path}/a/trades"), "seq_ord", "price_ticks")
    assert archived() == rows(tape.where(F.col("timestamp_ns") < last), "seq_ord", "price_ticks")
    assert archive.late().count() == 0
    archive.apply(spark.createDataFrame(b.orderBy(F.desc("seq_ord")).limit(5).collect(), b.schema), q.lastProgress["batchId"] + 1)  # an old batch again, under a later number
    late = spark.createDataFrame(b.orderBy("seq_ord").limit(7).collect(), b.schema).withColumn("seq_ms", F.col("seq_ms") + 10**10)
    before = archived()
    archive.apply(late, q.lastProgress["batchId"] + 2)
    archive.apply(late, q.lastProgress["batchId"] + 2)
    assert archived() == before and archive.late().agg(F.sum("late")).first()[0] == 7
    got = S.with_rocks(spark, lambda: S.run_to_end(S.stream_conflated(log(), 50_000_000), str(tmp_path / "c")))
    from tickloom.operators import book as K

    changes = K.level_changes(K.order_states(K.order_events(market.accepts(b), market.fills(b), market.cancels(b))))
    seen = b.agg(F.max("seq_ms")).first()[0] * 1_000_000 - B.NS
    want = K.conflated(changes, 50_000_000).where(F.col("window_ns") + 50_000_000 <= seen)
    assert rows(got, "symbol_id", "side", "price_ticks", "window_ns", "qty", "seq_ord") == rows(want, "symbol_id", "side", "price_ticks", "window_ns", "qty", "seq_ord")
    frames = log().select(F.concat(F.lit("tape:"), F.col("symbol_id")).alias("channel"), F.lit(False).alias("private"), F.col("seq_ord").alias("arrival"), F.col("seq_ms").alias("seq_a"), F.col("seq_ord").alias("seq_b"))
    got = S.with_rocks(spark, lambda: S.run_to_end(S.stream_gaps(frames), str(tmp_path / "g")))
    assert {r["verdict"] for r in got.collect()} == {"ok"}
    orders = market.inbound(log()).where("record_type = 'submit'").withColumn("event_time", F.timestamp_micros(F.call_function("div", F.col("timestamp_ns"), F.lit(1000)))).withColumn("client_order_id", F.col("qty") % 3).drop("record_type")
    for ttl in (3600, 86_400, 3650 * 86_400):  # in seconds; the state of a key outlives a file, or does not
        got = S.with_rocks(spark, lambda: S.run_to_end(S.stream_dedupe(orders, ttl * B.NS), str(tmp_path / f"d{ttl}")))  # noqa: B023
        s = market.inbound(market.view(spark.read.parquet(EVENTS))).where("record_type = 'submit'").withColumn("client_order_id", F.col("qty") % 3)
        assert rows(got, "seq_ord", "duplicate") == rows(R.first_outcomes(s.select("user_id", "client_order_id", "seq_ord", "timestamp_ns"), ttl * B.NS), "seq_ord", "duplicate")


@pytest.mark.parametrize("slots", [{}, {"slots": 1}])
def test_stream_dedupe_by_slots(spark, tmp_path, slots):
    """5,000 keys cost calls and state by slots, and what has passed its TTL goes."""
    hour = 3600 * B.NS
    n = F.col("id")
    s = spark.range(15_000).select((n % 5000).alias("user_id"), (n % 2).alias("client_order_id"), n.alias("seq_ord"), (1_704_067_200 * B.NS + n * 250_000_000).alias("timestamp_ns"))
    s = s.union(spark.createDataFrame([(1, 1, 15_000, 1_704_067_200 * B.NS + 99 * hour)], s.schema))
    seen, want = 0, rows(R.first_outcomes(s, hour // 2), "seq_ord", "user_id", "client_order_id", "duplicate")
    for low, high in ((0, 7500), (7500, 15_000), (15_000, 15_001)):
        s.where(F.col("seq_ord").between(low, high - 1)).repartition(3).write.mode("append").parquet(f"{tmp_path}/in")
        x = spark.readStream.schema(s.schema).parquet(f"{tmp_path}/in").withColumn("event_time", F.timestamp_micros(F.call_function("div", F.col("timestamp_ns"), F.lit(1000))))

        def run():
            q = S.stream_dedupe(x, hour // 2, **slots).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()  # noqa: B023
            q.awaitTermination()
            return [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress]

        seen = S.with_rocks(spark, run)
        assert 0 < max(seen) <= slots.get("slots", 512)
    assert seen[-1] == 1  # the slot of the last row
    assert rows(spark.read.parquet(f"{tmp_path}/out"), "seq_ord", "user_id", "client_order_id", "duplicate") == want


def test_stream_dedupe_with_null_ids(spark, tmp_path):
    """A null is a key of its own, and ids beside it stay whole numbers, also in the state between batches."""
    big, t = 2**60, 1_704_067_200 * B.NS
    keys = [(big + 1, 1), (big + 2, 1), (None, 1), (1, None), (None, None), (0, 1), (0, 0), (1, 0)]
    s = spark.createDataFrame([(u, c, i * 100 + j, t + i * 1800 * B.NS + j) for i in range(4) for j, (u, c) in enumerate(keys)], "user_id long, client_order_id long, seq_ord long, timestamp_ns long")
    for i in range(4):
        s.where(F.col("seq_ord").between(i * 100, i * 100 + 99)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        x = spark.readStream.schema(s.schema).parquet(f"{tmp_path}/in").withColumn("event_time", F.timestamp_micros(F.call_function("div", F.col("timestamp_ns"), F.lit(1000))))
        S.with_rocks(spark, lambda: S.run_to_end(S.stream_dedupe(x, 3600 * B.NS, slots=1), str(tmp_path / "d")))  # noqa: B023
    got = {r["seq_ord"]: (r["user_id"], r["client_order_id"], r["duplicate"]) for r in spark.read.parquet(f"{tmp_path}/d/out").collect()}
    want = {r["seq_ord"]: (r["user_id"], r["client_order_id"], r["duplicate"]) for r in R.first_outcomes(s, 3600 * B.NS).collect()}
    assert got == want and sum(x[2] for x in want.values()) == 16


def test_stream_dedupe_takes_the_log_by_time(spark, tmp_path):
    """Of a second copy with later ids at the same times, no row is late."""
    from tickloom.plans import market as plans

    e = spark.read.parquet(EVENTS)
    e.union(e.withColumn("event_id", F.col("event_id") + 1000).withColumn("user_id", F.col("user_id") + F.col("event_id") % 2)).write.parquet(f"{tmp_path}/events.parquet")
    cols = ["user_id", "client_order_id", "seq_ord", "duplicate"]
    want = rows(plans.queries()["first_outcome_dedupe"](spark, str(tmp_path)), *cols)
    assert len(want) > 700 and rows(plans.queries()["stream_dedupe"](spark, str(tmp_path)), *cols) == want


def test_outcomes_and_verdicts(spark):
    hour = 3600 * B.NS
    s = spark.createDataFrame([(1, 7, 0, 0), (1, 7, 1, hour // 2), (1, 7, 2, hour + 1), (1, 7, 3, hour + 2), (2, 7, 4, 5)], "user_id long, client_order_id long, seq_ord long, timestamp_ns long")
    assert {r["seq_ord"]: r["duplicate"] for r in R.first_outcomes(s, hour).collect()} == {0: False, 1: True, 2: False, 3: True, 4: False}
    f = spark.createDataFrame([("p", 0, True, 0, 1), ("p", 1, True, 0, 3), ("p", 2, True, 0, 3), ("p", 3, True, 0, 2), ("t", 0, False, 1, 1), ("t", 1, False, 9, 0)], "channel string, arrival long, private boolean, seq_a long, seq_b long")
    assert [r["verdict"] for r in R.sequence_verdicts(f).orderBy("channel", "arrival").collect()] == ["ok", "gap", "duplicate", "out_of_order", "ok", "ok"]
