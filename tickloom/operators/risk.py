"""Order checks and risk audits over the log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def reject_reason(orders: DataFrame, symbols: DataFrame) -> DataFrame:
    """Adds `reason`: the first rule an order fails, null if none."""
    known = symbols.select("symbol_id", F.lit(True).alias("known"))
    reason = (
        F.when(~F.coalesce(F.col("side").isin(1, 2), F.lit(False)), "INVALID_SIDE")
        .when(~F.coalesce(F.col("tif").isin(1, 2), F.lit(False)), "INVALID_TIF")
        .when(~F.coalesce(F.col("price_ticks") > 0, F.lit(False)), "INVALID_PRICE")
        .when(~F.coalesce(F.col("qty") > 0, F.lit(False)), "INVALID_QUANTITY")
        .when(F.col("known").isNull(), "UNKNOWN_SYMBOL")
    )
    return orders.join(F.broadcast(known), "symbol_id", "left").withColumn("reason", reason).drop("known")


def reservations(resting: DataFrame) -> DataFrame:
    """Cash tied up in resting buys and units in resting sells, by user and symbol."""
    from tickloom.functions.ticks import buy_cost

    return resting.groupBy("user_id", "symbol_id").agg(
        F.sum(F.when(F.col("side") == 1, buy_cost("price_ticks", "rem")).otherwise(0)).alias("cash"), F.sum(F.when(F.col("side") == 2, F.col("rem")).otherwise(0)).alias("units")
    )


def available(balances: DataFrame, held: DataFrame, reserved: DataFrame) -> DataFrame:
    """(user_id, symbol_id, cash, units): settled less reserved; the cash row has a null symbol."""
    cash = balances.join(reserved.groupBy("user_id").agg(F.sum("cash").alias("r")), "user_id", "full")
    cash = cash.select("user_id", F.lit(None).cast("int").alias("symbol_id"), (F.coalesce("cash_ticks", F.lit(0)) - F.coalesce("r", F.lit(0))).alias("available"))
    units = held.join(reserved.where("units > 0").select("user_id", "symbol_id", "units"), ["user_id", "symbol_id"], "full")
    return cash.unionByName(units.select("user_id", "symbol_id", (F.coalesce("position", F.lit(0)) - F.coalesce("units", F.lit(0))).alias("available")))


def cash_moves(cash_events: DataFrame, states: DataFrame) -> DataFrame:
    """Every change of settled cash and of cash reserved by resting buys, by user and record."""
    from tickloom.functions.ticks import buy_cost

    r = states.where((F.col("side") == 1) & (F.col("delta") != 0))
    r = r.select("user_id", "seq_ms", "seq_ord", F.lit(3).alias("leg"), F.lit(False).alias("created"), F.lit(0).cast("long").alias("delta"), buy_cost("price_ticks", "delta").alias("reserve"))
    return cash_events.withColumn("reserve", F.lit(0).cast("long")).unionByName(r)


def running_available(moves: DataFrame) -> DataFrame:
    """Adds `settled`, `reserved` and `free` after each move."""
    order = W.partitionBy("user_id").orderBy("seq_ms", "seq_ord", "leg").rowsBetween(W.unboundedPreceding, 0)
    m = moves.withColumn("epoch", F.sum(F.col("created").cast("int")).over(order)).withColumn("reserved", F.sum("reserve").over(order))
    inside = W.partitionBy("user_id", "epoch").orderBy("seq_ms", "seq_ord", "leg").rowsBetween(W.unboundedPreceding, 0)
    return m.withColumn("settled", F.sum("delta").over(inside)).withColumn("free", F.col("settled") - F.col("reserved"))


def running_units(legs: DataFrame, states: DataFrame) -> DataFrame:
    """Units free to sell after each record, by user and symbol."""
    s = states.where((F.col("side") == 2) & (F.col("delta") != 0)).select("user_id", "symbol_id", "seq_ms", "seq_ord", (-F.col("delta")).alias("d"))
    moves = legs.select("user_id", "symbol_id", "seq_ms", "seq_ord", F.col("signed_qty").alias("d")).unionByName(s)
    moves = moves.groupBy("user_id", "symbol_id", "seq_ms", "seq_ord").agg(F.sum("d").alias("d"))
    return moves.withColumn("free_units", F.sum("d").over(W.partitionBy("user_id", "symbol_id").orderBy("seq_ms", "seq_ord")))


def admission_audit(accepts: DataFrame, free_cash: DataFrame, free_units: DataFrame, makers_below: int) -> DataFrame:
    """(order_id, reason): accepted orders that the cash or position check would have refused just before them."""
    from tickloom.functions.ticks import buy_cost
    from tickloom.operators.book import as_of

    last = F.max_by("free", "leg").alias("free")
    c = free_cash.groupBy("user_id", "seq_ms", "seq_ord").agg(last)
    a = accepts.select("order_id", "user_id", "symbol_id", "side", "price_ticks", "qty", "seq_ms", "seq_ord")
    a = as_of(a, c, "user_id", ["free"])
    key = F.struct("user_id", "symbol_id")
    a = as_of(a.withColumn("us", key), free_units.withColumn("us", key), "us", ["free_units"])
    poor = (F.col("side") == 1) & (F.coalesce("free", F.lit(0)) < buy_cost("price_ticks", "qty"))
    short = (F.col("side") == 2) & (F.col("user_id") >= makers_below) & (F.coalesce("free_units", F.lit(0)) < F.col("qty"))
    return a.withColumn("reason", F.when(poor, "INSUFFICIENT_CASH").when(short, "INSUFFICIENT_POSITION")).where(F.col("reason").isNotNull()).select("order_id", "reason")


def retail_shorts(legs: DataFrame, makers_below: int) -> DataFrame:
    """Records after which a user who is no market maker is short."""
    x = legs.where(F.col("user_id") >= makers_below).groupBy("user_id", "symbol_id", "seq_ms", "seq_ord").agg(F.sum("signed_qty").alias("d"))
    x = x.withColumn("position", F.sum("d").over(W.partitionBy("user_id", "symbol_id").orderBy("seq_ms", "seq_ord")))
    return x.where("position < 0").drop("d")


def first_outcomes(submissions: DataFrame, ttl_ns: int) -> DataFrame:
    """Adds `duplicate`: within the TTL of the kept first submission of the same key (user_id, client_order_id).

    The TTL counts from the kept one, so each key is folded in order. Rows
    come sorted by key and time and are folded as a stream: no key's rows
    are held together, and a task serves all keys of its partition.
    """
    import pyarrow as pa

    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in submissions.schema)}, duplicate boolean"

    def run(batches):
        key, kept = None, 0
        for b in batches:
            flags = []
            for k, t in zip(zip(b.column("user_id").to_pylist(), b.column("client_order_id").to_pylist(), strict=True), b.column("timestamp_ns").to_pylist(), strict=True):
                dup = k == key and t - kept < ttl_ns
                if not dup:
                    key, kept = k, t
                flags.append(dup)
            yield b.append_column("duplicate", pa.array(flags, pa.bool_()))

    keys = ["user_id", "client_order_id"]
    return submissions.repartition(*keys).sortWithinPartitions(*keys, "timestamp_ns", "seq_ord").mapInArrow(run, schema)


def rate_limited(orders: DataFrame, rate_per_second: float) -> DataFrame:
    """Adds `allowed` by a token bucket per user: full at first, refilled by time, never above the rate.

    Path dependent. Rows come sorted by user and time and are folded as a
    stream, so that no user's orders are held in memory together.
    """
    import pyarrow as pa

    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in orders.schema)}, allowed boolean"

    def run(batches):
        user, tokens, last = None, 0.0, 0
        for b in batches:
            flags = []
            for u, t in zip(b.column("user_id").to_pylist(), b.column("timestamp_ns").to_pylist(), strict=True):
                if u != user:
                    user, tokens = u, float(rate_per_second)
                else:
                    tokens = min(float(rate_per_second), tokens + max(0, t - last) / 1e9 * rate_per_second)
                last = t
                ok = tokens >= 1.0
                tokens -= ok
                flags.append(ok)
            yield b.append_column("allowed", pa.array(flags, pa.bool_()))

    return orders.repartition("user_id").sortWithinPartitions("user_id", "timestamp_ns", "seq_ord").mapInArrow(run, schema)


def reject_summary(rejects: DataFrame, symbols: DataFrame) -> DataFrame:
    names = F.broadcast(symbols.select("symbol_id", "name"))
    return rejects.join(names, "symbol_id", "left").groupBy("name", "reason").agg(F.count("*").alias("orders"), F.countDistinct("user_id").alias("users"))


def recovery_check(expected: DataFrame, accepted: DataFrame, fills: DataFrame) -> DataFrame:
    """(problem, id): expected client ids that are missing, accepted ones that are extra, fills that come twice."""
    e, a = expected.select("client_order_id").distinct(), accepted.select("client_order_id").distinct()
    p = lambda name, df, c: df.select(F.lit(name).alias("problem"), F.col(c).cast("long").alias("id"))
    twice = fills.groupBy("maker_order_id", "taker_order_id").count().where("count > 1")
    return p("missing", e.join(a, "client_order_id", "left_anti"), "client_order_id").unionByName(p("extra", a.join(e, "client_order_id", "left_anti"), "client_order_id")).unionByName(p("duplicate_fill", twice, "taker_order_id"))


def sequence_verdicts(frames: DataFrame) -> DataFrame:
    """Adds `verdict` to (channel, arrival, private, seq_a, seq_b): against the frame that came before on the channel.

    Market data moves by stream id and has no gaps; private channels count densely.
    """
    w = W.partitionBy("channel").orderBy("arrival")
    now, was = F.struct("seq_a", "seq_b"), F.lag(F.struct("seq_a", "seq_b")).over(w)
    f = frames.withColumn("was", was)
    verdict = F.when(F.col("was").isNull(), "ok").when(now == F.col("was"), "duplicate").when(now < F.col("was"), "out_of_order").when(F.col("private") & (F.col("seq_b") > F.col("was.seq_b") + 1), "gap").otherwise("ok")
    return f.withColumn("verdict", verdict).drop("was")
