"""Cash, positions, fees and private messages from the log; all are aggregates of the fill legs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions.ticks import MAKER_BPS, TAKER_BPS, fee
from tickloom.sources.market import SEQ


def fees(fills: DataFrame) -> DataFrame:
    m, t = fee("price_ticks", "qty", MAKER_BPS), fee("price_ticks", "qty", TAKER_BPS)
    return fills.select(*SEQ, "symbol_id", (F.col("price_ticks") * F.col("qty")).alias("notional"), m.alias("maker_fee"), t.alias("taker_fee"), (m + t).alias("total_fee"))


def fill_legs(fills: DataFrame) -> DataFrame:
    """Two rows per fill: who, in which role, signed quantity and cash net of the own fee."""
    taker_side, maker_side = F.col("aggressor_side"), 3 - F.col("aggressor_side")

    def leg(role, user, order, side, bps):
        return F.struct(F.lit(role).alias("role"), F.col(user).alias("user_id"), F.col(order).alias("order_id"), side.cast("int").alias("side"), fee("price_ticks", "qty", bps).alias("fee"))

    both = F.explode(F.array(leg("maker", "maker_user_id", "maker_order_id", maker_side, MAKER_BPS), leg("taker", "taker_user_id", "taker_order_id", taker_side, TAKER_BPS)))
    x = fills.select(*SEQ, "timestamp_ns", "symbol_id", "price_ticks", "qty", both.alias("leg")).select(*SEQ, "timestamp_ns", "symbol_id", "price_ticks", "qty", "leg.*")
    sign = F.when(F.col("side") == 1, 1).otherwise(-1)
    return x.withColumn("signed_qty", sign * F.col("qty")).withColumn("cash_delta", -sign * F.col("price_ticks") * F.col("qty") - F.col("fee"))


def cash_events(accounts: DataFrame, legs: DataFrame) -> DataFrame:
    """(user_id, seq, leg, created, delta): every record that moves cash."""
    a = accounts.select("user_id", *SEQ, F.lit(0).alias("leg"), "created", F.col("amount_ticks").alias("delta"))
    x = legs.select("user_id", *SEQ, F.when(F.col("role") == "maker", 1).otherwise(2).alias("leg"), F.lit(False).alias("created"), F.col("cash_delta").alias("delta"))
    return a.unionByName(x)


def cash_balances(events: DataFrame) -> DataFrame:
    """Balance per user: the last creation sets it, what comes later adds. Two aggregations, no window over a user."""
    at = F.struct(*SEQ, "leg")
    created = events.where("created").groupBy("user_id").agg(F.max(at).alias("since"))
    e = events.join(created, "user_id", "left")
    counts = F.col("since").isNull() | (at >= F.col("since"))
    return e.groupBy("user_id").agg(F.sum(F.when(counts, F.col("delta")).otherwise(0)).alias("cash_ticks"))


def cash_history(events: DataFrame) -> DataFrame:
    """Running balance after each record."""
    order = W.partitionBy("user_id").orderBy(*SEQ, "leg").rowsBetween(W.unboundedPreceding, 0)
    e = events.withColumn("epoch", F.sum(F.col("created").cast("int")).over(order))
    inside = W.partitionBy("user_id", "epoch").orderBy(*SEQ, "leg").rowsBetween(W.unboundedPreceding, 0)
    return e.withColumn("balance", F.sum("delta").over(inside))


def positions(legs: DataFrame) -> DataFrame:
    return legs.groupBy("user_id", "symbol_id").agg(F.sum("signed_qty").alias("position")).where("position <> 0")


def open_orders(accepts: DataFrame, legs: DataFrame, cancels: DataFrame) -> DataFrame:
    """The ledger's rule: fills and cancelled quantities are taken off, and an order that reaches zero is gone for good."""
    moves = legs.select("order_id", *SEQ, F.col("qty").alias("off")).unionByName(cancels.select("order_id", *SEQ, F.col("remaining_qty").alias("off")))
    a = accepts.select("order_id", "user_id", "symbol_id", "side", "price_ticks", "qty", F.struct(*SEQ).alias("a"))
    off = moves.join(a.select("order_id", "a"), "order_id").where(F.struct(*SEQ) > F.col("a")).groupBy("order_id").agg(F.sum("off").alias("off"))
    left = F.col("qty") - F.coalesce("off", F.lit(0))
    return a.join(off, "order_id", "left").withColumn("remaining", left).where("remaining > 0").drop("a", "off")


def house_fees(fills: DataFrame) -> DataFrame:
    """Fees by symbol and UTC day, by symbol, and in all (nulls), in one pass."""
    from tickloom.functions.ticks import utc_date

    f = fees(fills).join(fills.select(*SEQ, utc_date("timestamp_ns").alias("date")), list(SEQ))
    return f.groupingSets([["symbol_id", "date"], ["symbol_id"], []], "symbol_id", "date").agg(F.sum("total_fee").alias("fees"), F.count("*").alias("fills"))


def conservation(accounts: DataFrame, fills: DataFrame) -> DataFrame:
    """Cash held, fees, deposits and their difference. Creations set a balance but count as deposits, so the difference is what they wiped."""
    legs = fill_legs(fills)
    cash = cash_balances(cash_events(accounts, legs)).agg(F.sum("cash_ticks").alias("cash"))
    f = fees(fills).agg(F.sum("total_fee").alias("fees"))
    dep = accounts.agg(F.sum("amount_ticks").alias("deposits"))
    net = positions(legs).groupBy("symbol_id").agg(F.sum("position").alias("net")).agg(F.coalesce(F.max(F.abs("net")), F.lit(0)).alias("largest_net_position"))
    one = cash.withColumn("k", F.lit(1))
    for x in (f, dep, net):
        one = one.join(x.withColumn("k", F.lit(1)), "k")
    return one.drop("k").withColumn("difference", F.col("cash") + F.col("fees") - F.col("deposits"))


def portfolio(balances: DataFrame, held: DataFrame, symbols: DataFrame, users: DataFrame) -> DataFrame:
    """Cash (0 without an account) and positions of each user; symbols that aren't listed are left out."""
    p = held.join(F.broadcast(symbols.select("symbol_id", "name")), "symbol_id")
    p = p.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("name", "position"))).alias("p"))
    text = F.array_join(F.transform(F.coalesce("p", F.array().cast("array<struct<name:string,position:bigint>>")), lambda x: F.concat(x["name"], F.lit(":"), x["position"].cast("string"))), " ")
    u = users.join(balances, "user_id", "left").join(p, "user_id", "left")
    return u.select("user_id", F.coalesce("cash_ticks", F.lit(0)).cast("long").alias("cash_ticks"), F.coalesce(F.size("p"), F.lit(0)).cast("long").alias("n_positions"), text.alias("positions"))


def private_timeline(accepts: DataFrame, legs: DataFrame, cancels: DataFrame, accounts: DataFrame, symbols: DataFrame) -> DataFrame:
    """All messages of each user with a dense number of their own."""
    none = lambda t: F.lit(None).cast(t)
    rows = [
        accepts.select("user_id", *SEQ, F.lit(0).alias("leg"), F.lit("accepted").alias("kind"), none("string").alias("role"), "symbol_id", "order_id", "qty"),
        legs.select("user_id", *SEQ, F.when(F.col("role") == "maker", 1).otherwise(2).alias("leg"), F.lit("fill").alias("kind"), "role", "symbol_id", "order_id", "qty"),
        cancels.select("user_id", *SEQ, F.lit(0).alias("leg"), F.lit("cancelled").alias("kind"), none("string").alias("role"), "symbol_id", "order_id", F.col("remaining_qty").alias("qty")),
        accounts.select("user_id", *SEQ, F.lit(0).alias("leg"), F.when(F.col("created"), "account_created").otherwise("cash_credited").alias("kind"), none("string").alias("role"), none("int").alias("symbol_id"), none("long").alias("order_id"), F.col("amount_ticks").alias("qty")),
    ]
    u = rows[0]
    for r in rows[1:]:
        u = u.unionByName(r)
    u = u.join(F.broadcast(symbols.select("symbol_id", F.col("name").alias("symbol"))), "symbol_id", "left")
    return u.withColumn("user_seq", F.row_number().over(W.partitionBy("user_id").orderBy(*SEQ, "leg")))


def changed_keys(accepts: DataFrame, legs: DataFrame, cancels: DataFrame, accounts: DataFrame, batch: Column) -> DataFrame:
    """(batch, kind, user_id, other): accounts, positions and orders that the records of each batch touch; `batch` numbers a record by its columns."""
    t = lambda df, kind, other: df.select(batch.cast("long").alias("batch"), F.lit(kind).alias("kind"), F.col("user_id").cast("long").alias("user_id"), (F.lit(None) if other is None else F.col(other)).cast("long").alias("other"))
    rows = t(accounts, "account", None).union(t(legs, "account", None)).union(t(legs, "position", "symbol_id"))
    return rows.union(t(accepts, "order", "order_id")).union(t(legs, "order", "order_id")).union(t(cancels, "order", "order_id")).distinct()


def mark_to_market(balances: DataFrame, held: DataFrame, last: DataFrame) -> DataFrame:
    v = held.join(F.broadcast(last.select("symbol_id", "price_ticks")), "symbol_id").groupBy("user_id").agg(F.sum(F.col("position") * F.col("price_ticks")).alias("holdings"))
    h = F.coalesce("holdings", F.lit(0))
    return balances.join(v, "user_id", "left").select("user_id", "cash_ticks", h.cast("long").alias("holdings"), (F.col("cash_ticks") + h).alias("equity"))
